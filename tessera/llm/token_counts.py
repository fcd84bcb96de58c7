"""Token counts without token ids.

The pieces of a text are the pieces of its pre-tokens one after another, so a text's
count is the sum, over its distinct pre-tokens, of frequency times pieces.  A pre-token
is a run of spaces with the characters up to the next space or line feed.  That is exact
for a piece vocabulary in which no piece has a word boundary after its first other
character and none contains a line feed; `boundaries_hold` checks the vocabulary.

Plan.  One scan counts pre-tokens per task and keeps what is frequent there; the sums
give a head of at most `head` pre-tokens of at most LONGEST characters (a fixed bound of
bytes, so it is broadcast with its piece counts).  A second scan resolves each document's head pre-tokens on the spot and
emits (pre-token, document, frequency) for the others only.  Those are shuffled by
pre-token, each distinct one is encoded once, and the products are summed per document.
The choice of head moves work, never results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import pick

BOUNDARY = "▁"
#: Characters of the longest pre-token that the head can hold.
LONGEST = 64
UNIT = re.compile(r" *[^ \n]+| +")
_loaded: dict = {}


def piece_model(path: str):
    """The model, once per process."""
    if path not in _loaded:
        import sentencepiece

        _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _loaded[path]


def boundaries_hold(path: str) -> bool:
    model = piece_model(path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return not any(BOUNDARY in p.lstrip(BOUNDARY) or "\n" in p for p in pieces)


def units(text: str) -> tuple[list[str], int]:
    """The pre-tokens of a text, in order, and its number of line feeds."""
    if not text:
        return [], 0
    text = " " + text.replace(BOUNDARY, " ")
    return UNIT.findall(text), text.count("\n")


def count_pieces(path: str, pretokens: list[str]) -> list[int]:
    """Pieces of each pre-token as it stands within a text."""
    model = piece_model(path)
    # The library puts a space before what it encodes; pre-tokens that begin without one
    # follow a line feed, so they are encoded behind one.
    feed = len(model.encode("\n"))  # the space and the line feed
    texts = [u[1:] if u[0] == " " else "\n" + u for u in pretokens]
    counts = [len(x) if u[0] == " " else len(x) - feed for u, x in zip(pretokens, model.encode(texts, num_threads=1), strict=True)]
    for i, u in enumerate(pretokens):
        if u == " ":  # the library returns nothing for an empty text
            counts[i] = 1
        elif u == "\n":
            counts[i] = feed - 1
    return counts


def _frequent(least: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            kept = [(u, n) for u, n in seen.items() if n >= least and len(u) <= LONGEST]
            seen.clear()
            return pa.record_batch([pa.array([u for u, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["unit", "n"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(units(text.as_py())[0])
                if len(seen) > most:
                    yield out()
        yield out()

    return run


def _resolve(shared, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        feed = count_pieces(path, ["\n"])[0]
        for batch in batches:
            known, of, rest, times = [], [], [], []
            for i, text in enumerate(batch.column(2)):
                found, feeds = units(text.as_py())
                counts = [get(u) for u in found]
                if None in counts:
                    tail = Counter(u for u, n in zip(found, counts, strict=True) if n is None)
                    of.extend([i] * len(tail))
                    rest.extend(tail.keys())
                    times.extend(tail.values())
                    known.append(sum(n for n in counts if n is not None) + feeds * feed)
                else:
                    known.append(sum(counts) + feeds * feed)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.compute.cast(pa.compute.binary_length(batch.column(2)), pa.int64()), pa.array(known, pa.int64()), pa.nulls(len(known), pa.string()), pa.nulls(len(known), pa.int64())],
                names=_PARTS,
            )
            none = pa.nulls(len(of), pa.int64())
            at = pa.array(of, pa.int32())
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), none, none, pa.array(rest, pa.string()), pa.array(times, pa.int64())], names=_PARTS)

    return run


_PARTS = ["row", "doc_id", "n_bytes", "known", "unit", "times"]


def _encode_sorted(path: str):
    """Rows sorted by unit: pieces times frequency, each distinct unit encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pieces = None, 0
        for batch in batches:
            found = batch.column(4).dictionary_encode()
            words = found.dictionary.to_pylist()
            todo = [w for w in words if w != last]
            counts = dict(zip(todo, count_pieces(path, todo), strict=True))
            counts.setdefault(last, pieces)
            n = pa.compute.multiply(pa.array([counts[w] for w in words], pa.int64()).take(found.indices), batch.column(5))
            if words:
                last = words[-1]
                pieces = counts[last]
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.compute.coalesce(batch.column(3), n)], names=_PARTS[:4])

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, head: int = 1 << 17) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for each row of docs.

    A null or empty text has 0 bytes and 0 tokens.  Repeated rows and rows without a
    doc_id are counted each for itself.  No text is cut, whatever its length; other
    columns are ignored; an empty table gives an empty result.
    """
    if not boundaries_hold(path):
        raise ValueError("this vocabulary has pieces that cross word boundaries")
    spark = docs.sparkSession
    # Rows are named by content, so that a recomputed task gives the same names; equal rows share theirs, and their sum.
    own = pick(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    frequent = own.select("text").mapInArrow(_frequent(8, 1 << 20), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    top = [r.unit for r in frequent.orderBy(F.desc("n"), "unit").limit(head).collect()]  # at most `head` short strings
    shared = spark.sparkContext.broadcast(dict(zip(top, count_pieces(path, top), strict=True)))
    return (
        own.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
        .mapInArrow(_resolve(shared, path), "row long, doc_id long, n_bytes long, known long, unit string, times long")
        .repartition(F.coalesce("unit", F.col("row").cast("string")))
        .sortWithinPartitions("unit")
        .mapInArrow(_encode_sorted(path), "row long, doc_id long, n_bytes long, known long")
        .groupBy("row", "doc_id")
        .agg(F.max("n_bytes").alias("n_bytes"), F.sum("known").alias("known"), F.count("n_bytes").alias("copies"))
        .select("doc_id", "n_bytes", F.expr("known div copies").alias("n_tokens"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
