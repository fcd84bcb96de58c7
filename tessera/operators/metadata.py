"""Metadata records as a small DataFrame, keyed by (name, record_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.model import identifier

SCHEMA = "name string, record_id int, type string, ints array<long>, doubles array<double>, string string, bytes binary, description string"
# Types, with the range of the integer ones.
TYPES = {
    "unspecified": None, "byte": (-128, 127), "short": (-32768, 32767), "unsigned_short": (0, 65535),
    "integer": (-(1 << 31), (1 << 31) - 1), "unsigned_integer": (0, (1 << 32) - 1), "float": None, "double": None, "string": None, "ascii": None,
}
# Names with an agreed meaning.
STANDARD_NAMES = ("Author", "Copyright", "TermsOfUse", "Disclaimers", "TIFF", "WKT")


def record(name: str, value, type: str = "string", record_id: int | None = None, description: str = "") -> tuple:
    """A row for `write`; without record_id the next free one of its name is taken."""
    if not identifier(name):
        raise ValueError(f"not an identifier: {name!r}")
    if type not in TYPES:
        raise ValueError(f"no metadata type {type!r}")
    ints = doubles = string = raw = None
    if TYPES[type]:
        ints = list(value) if isinstance(value, (list, tuple)) else [value]
        low, high = TYPES[type]
        if not all(isinstance(v, int) and low <= v <= high for v in ints):
            raise ValueError(f"not of type {type}: {value!r}")
    elif type in ("float", "double"):
        doubles = [float(v) for v in (value if isinstance(value, (list, tuple)) else [value])]
    elif type in ("string", "ascii"):
        string = str(value)
        if type == "ascii" and not string.isascii():
            raise ValueError("not ASCII")
    else:
        raw = bytes(value)
    return name, record_id, type, ints, doubles, string, raw, description


def as_integers(row) -> list[int]:
    if not TYPES.get(row["type"]):
        raise TypeError(f"{row['type']} has no integers")
    return row["ints"]


def as_doubles(row) -> list[float]:
    if row["type"] in ("string", "ascii", "unspecified"):
        raise TypeError(f"{row['type']} has no numbers")
    return row["doubles"] if row["doubles"] is not None else [float(v) for v in row["ints"]]


def as_string(row) -> str:
    if row["type"] not in ("string", "ascii"):
        raise TypeError(f"{row['type']} is no string")
    return row["string"]


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def write(records: DataFrame, new: DataFrame) -> DataFrame:
    """records with the new ones: the same key is replaced, a null id becomes the greatest of its name plus one, from 1.

    `new` is in the order of its rows (one partition's, or by a column `_order`).
    """
    order = F.col("_order") if "_order" in new.columns else F.monotonically_increasing_id()
    new = new.withColumn("_o", order)
    top = records.groupBy("name").agg(F.max("record_id").alias("_top"))
    given = new.filter("record_id is not null").groupBy("name").agg(F.max("record_id").alias("_new"))
    nth = F.row_number().over(Window.partitionBy("name").orderBy("_o"))
    auto = new.filter("record_id is null").withColumn("_n", nth).join(top, "name", "left").join(given, "name", "left")
    auto = auto.withColumn("record_id", (F.greatest(F.coalesce("_top", F.lit(0)), F.coalesce("_new", F.lit(0))) + F.col("_n")).cast("int"))
    last = F.row_number().over(Window.partitionBy("name", "record_id").orderBy(F.desc("_o")))
    fresh = new.filter("record_id is not null").withColumn("_l", last).filter("_l = 1").select(records.columns).unionByName(auto.select(records.columns))
    return records.join(fresh.select("name", "record_id"), ["name", "record_id"], "left_anti").select(records.columns).unionByName(fresh)


def delete(records: DataFrame, name: str, record_id: int) -> DataFrame:
    return records.filter(~((F.col("name") == name) & (F.col("record_id") == record_id)))


def read(records: DataFrame, name: str | None = None, record_id: int | None = None) -> DataFrame:
    """All records, or those of a name, or the one of a key, by name and id."""
    if name is not None:
        records = records.filter(F.col("name") == name)
    if record_id is not None:
        records = records.filter(F.col("record_id") == record_id)
    return records.orderBy("name", "record_id")
