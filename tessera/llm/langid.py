"""Language identification by a string kernel.

The kernel of two texts is the number of character n-grams (n = 1 to 3) that both have,
over the geometric mean of the numbers each has: a blended-spectrum presence kernel,
normalised.  `landmarks` texts give a Nystroem map, on which one-versus-rest kernel ridge
regression is fitted; a batch of texts is scored by two matrix products.

Fitting takes at most `per_language` labelled texts of each language, chosen by hash, however
many languages there are.  Their n-grams are numbered where the texts are; the driver gets those
of the landmarks, and sums of features: a square matrix, and a row for each language.  Scoring
is one scan with no shuffle; the broadcast model has at most 2**BITS x landmarks cells, and a
column for each language, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, pick

BITS = 16
_STEP = np.array([2654435761, 2246822519, 3266489917], np.uint64)
#: Texts scored at once.
ROWS = 128


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def grams(text: str) -> np.ndarray:
    """The distinct hashed 1-, 2- and 3-grams of a text, lower-cased, everything but letters as one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    table, inverse = np.unique(points, return_inverse=True) if len(points) < 64 else _table(points)
    letters = np.fromiter((chr(c).isalpha() for c in table.tolist()), bool, len(table))
    x = np.where(letters, table, 32).astype(np.uint64)[inverse]
    if len(x):
        x = x[np.r_[True, (x[1:] != 32) | (x[:-1] != 32)]]  # runs of spaces are one
    seen = np.zeros(1 << BITS, bool)
    h = np.zeros(len(x), np.uint64)
    for n in range(min(3, len(x))):
        h = (h[: len(x) - n] + (x[n:] + np.uint64(n + 1)) * _STEP[n]) & np.uint64(0xFFFFFFFF)
        mixed = (h ^ (h >> np.uint64(15))) * np.uint64(0x9E3779B1)
        seen[(mixed & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - BITS)] = True
    return np.flatnonzero(seen)


def _table(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with inverse, without sorting."""
    present = np.zeros(0x110000 if points.max() > 0xFFFF else 0x10000, bool)
    present[points] = True
    table = np.flatnonzero(present)
    place = np.zeros(len(present), np.int32)
    place[table] = np.arange(len(table))
    return table, place[points]


#: Tasks that sum features, and sampled rows up to which their keys are broadcast; beyond, they are joined by shuffle.
TASKS, BROADCAST_KEYS = 16, 100_000


class Landmarks:
    """The Nystroem map: features of a text are its kernels with the landmarks, decorrelated, and a one.

    Only n-grams of landmarks have a column, and texts are taken ROWS at a time, so memory
    is bounded by the landmarks' n-grams.
    """

    def __init__(self, chosen: list[np.ndarray]):
        used = np.unique(np.concatenate(chosen))
        self.used = np.full(1 << BITS, -1, np.int32)
        self.used[used] = np.arange(len(used))
        self.marks = np.zeros((len(used), len(chosen)), np.float32)
        for j, g in enumerate(chosen):
            self.marks[self.used[g], j] = max(1, len(g)) ** -0.5
        values, vectors = np.linalg.eigh((self.marks.T @ self.marks).astype(np.float64))
        good = values > 1e-6 * values.max()
        self.root = vectors[:, good] / np.sqrt(values[good])

    def kernel(self, found: list[np.ndarray]) -> np.ndarray:
        """texts (as their n-grams) x landmarks."""
        x, size = np.zeros((len(found), self.marks.shape[0]), np.float32), np.ones((len(found), 1), np.float32)
        for i, at in enumerate(found):
            size[i] = max(1, len(at)) ** 0.5
            at = self.used[at]
            x[i, at[at >= 0]] = 1
        return x @ self.marks / size

    def features(self, found: list[np.ndarray]) -> np.ndarray:
        return np.c_[self.kernel(found).astype(np.float64) @ self.root, np.ones(len(found))]


class Model:
    """labels, and matrices that take a presence row to one score for each label."""

    def __init__(self, marks: Landmarks | None, labels: list[str], square: np.ndarray | None, sums: np.ndarray | None, ridge: float):
        self.marks, self.labels = marks, labels
        if labels:
            w = np.linalg.solve(square + ridge * np.eye(len(square)), sums)
            self.weights, self.bias = (marks.root @ w[:-1]).astype(np.float32), w[-1].astype(np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.marks.kernel([grams(t) for t in texts]) @ self.weights + self.bias


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [grams(t).astype(np.int32) for t in batch.column(2).to_pylist()]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["lang", "key", "grams"])


def training_sample(docs: DataFrame, held_out: Column, per_language: int) -> DataFrame:
    """lang, key, grams of at most per_language texts of each language: the first by hash in each of so many hash buckets."""
    rows = docs.filter(~held_out & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    keyed = rows.select("lang", F.xxhash64("doc_id", "text").alias("key"))
    first = materialize(keyed.groupBy("lang", F.pmod("key", F.lit(per_language)).alias("bucket")).agg(F.min("key").alias("key")).select("lang", "key"))
    few = first.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    chosen = rows.withColumn("key", F.xxhash64("doc_id", "text")).join(F.broadcast(first) if few else first, ["lang", "key"], "left_semi")
    return materialize(chosen.select("lang", "key", "text").dropDuplicates(["lang", "key"]).mapInArrow(_numbered, "lang string, key long, grams array<int>"))


def _sums(shared):
    """Weighted sums of features: for each language (lang, values), and of their products (null, values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, square, sums = shared.value, 0, {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                phi = marks.features([np.array(g, np.int64) for g in part.column("grams").to_pylist()])
                weight = part.column("weight").to_numpy()[:, None]
                square = square + (phi * weight).T @ phi
                for lang, row in zip(part.column("lang").to_pylist(), phi * weight, strict=True):
                    sums[lang] = sums.get(lang, 0) + row
        rows = [*sums.items(), *([(None, square.reshape(-1))] if sums else [])]
        yield pa.record_batch([pa.array([k for k, _ in rows], pa.string()), pa.array([v.tolist() for _, v in rows], pa.list_(pa.float64()))], names=["lang", "values"])

    return run


def fit(sample: DataFrame, landmarks: int, ridge: float) -> Model:
    """One-versus-rest ridge regression on the sample's features; languages weigh the same, whatever their number of texts."""
    spark = sample.sparkSession
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("key"))  # at most per_language rows each
    # The same number of landmarks for each language, in turn: at most `landmarks` rows, of at most 2**BITS numbers.
    chosen = sample.withColumn("turn", turn).orderBy("turn", "key", "lang").limit(landmarks).select("grams").collect()
    if not chosen:
        return Model(None, [], None, None, ridge)
    marks = Landmarks([np.array(r.grams, np.int64) for r in chosen])
    shared = spark.sparkContext.broadcast(marks)
    counts = sample.groupBy("lang").agg(F.count("*").alias("n"))
    total = counts.agg(F.count("*").alias("langs"), F.sum("n").alias("n")).first()
    weighted = sample.join(counts, "lang").select("lang", "grams", (F.lit(total.n) / (F.col("n") * total.langs)).alias("weight"))
    parts = weighted.repartition(TASKS).mapInArrow(_sums(shared), "lang string, values array<double>").collect()  # TASKS matrices and TASKS rows a language
    labels = sorted({r.lang for r in parts if r.lang is not None})
    place, size = {k: i for i, k in enumerate(labels)}, marks.root.shape[1] + 1
    square, sums = np.zeros((size, size)), np.zeros((size, len(labels)))
    for r in parts:
        if r.lang is None:
            square += np.array(r["values"]).reshape(size, size)
        else:
            sums[:, place[r.lang]] += r["values"]
    return Model(marks, labels, square, sums, ridge)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            todo = [i for i, t in enumerate(texts) if has_letter(t)] if model.labels else []
            for at in range(0, len(todo), ROWS):
                part = todo[at : at + ROWS]
                s = model.scores([texts[i] for i in part])
                for i, k, v in zip(part, s.argmax(1), s.max(1), strict=True):
                    langs[i], scores[i] = model.labels[k], min(1.0, max(0.0, float(v)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, per_language: int = 200, landmarks: int = 256, ridge: float = 1e-2) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of docs.

    Rows whose crc32 of the doc_id as text leaves 1 modulo 3 are held out; the others with
    a language teach.  A null doc_id is not held out.  A text that is null or has no letter
    is `und` with score 0, as is every text if nothing teaches.  Whole texts are read, in
    fitting and scoring; nothing but the text decides a prediction, so repeated texts get
    equal ones.  Other columns are ignored; an empty table gives an empty result.
    """
    own = pick(docs, doc_id="long", text="string", lang="string")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = fit(training_sample(own, held_out, per_language), landmarks, ridge)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return own.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(_score(shared), "doc_id long, held_out boolean, lang_pred string, score double")
