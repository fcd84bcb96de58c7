"""Packing of tokenised documents into sequences of a fixed capacity, by best fit.

Documents are cut into pieces of at most `capacity` tokens, so piece lengths and gaps
are whole numbers from 1 to `capacity`, and pieces (or gaps) of one size are
interchangeable.  The bulk-synchronous rounds therefore run over size classes: each
round takes the largest class with unplaced pieces, sweeps the gaps upwards from the
first that holds it (its successor), fills them, and opens new sequences for what is
left.  Within a class conflicts are resolved by rank: piece number r of its class takes
slot number r of the sweep.  The sweep's state has at most `capacity` classes of each
kind, whatever the number of documents.

The documents themselves stay distributed: they are range-sorted by size, ranked within
their class by partition offsets, and each finds its slot by binary search.
"""

from __future__ import annotations

import gc
import heapq
import os
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, pick

#: Chunks (twice as many at the most) and words whose ids a worker remembers, and the longest one remembered.
CHUNKS, WORDS, LONGEST = 250_000, 1_000_000, 64
#: The tokenizer's own words, fixed by its file.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: What can end a chunk of letters and is a word by itself.
_STOPS = frozenset(".,;:!?")
#: A byte's name in a byte-level vocabulary: itself if it can be printed, else the next free code point from 256.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_NAMES = {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*_SHOWN}))}
_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]
_loaded: dict = {}


def tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


class Ids(dict):
    """The ids of a text as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and no token spans it, so the ids of a text are those
    of its chunks between spaces and line feeds, each looked up.  The ids of a chunk of
    plain Latin characters are those of its lower-cased words, each encoded once while it
    is remembered; other chunks are encoded whole.  A chunk not met while CHUNKS others came
    in is forgotten, so that rare ones don't push out common ones.
    """

    def __init__(self, path: str):
        super().__init__({"": b""})
        self.encode, self.before, self.words = tokenizer(path).encode, {}, {}
        self.merge = tokenizer(path).model.tokenize  # what encode does with a word once it is folded and cut out
        gc.freeze()  # what is remembered holds no cycles; collections needn't walk it

    def __missing__(self, chunk: str) -> bytes:
        ids = self.before.get(chunk)
        if ids is None:
            ids = self._new(chunk)
            if len(chunk) > LONGEST:
                return ids
        if len(self) > CHUNKS:
            self.before = dict(self)
            self.clear()
        self[chunk] = ids
        return ids

    def _new(self, chunk: str) -> bytes:
        words = self.words
        if len(chunk) <= LONGEST and chunk.isascii():  # most chunks: letters, with a stop at the end or without
            low = chunk.lower()
            if low.isalpha():
                return words.get(low) or self._merged(low)
            if low[-1] in _STOPS and (head := low[:-1]).isalpha():
                return (words.get(head) or self._merged(head)) + (words.get(low[-1]) or self._merged(low[-1]))
        parts = self._parts(chunk)
        if parts is None:
            return np.array(self.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join([words.get(w) or self._merged(w) for w in parts])

    def _merged(self, word: str) -> bytes:
        if len(self.words) > WORDS:
            self.words.clear()
        found = self.merge(word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_NAMES))
        ids = self.words[word] = _PACK[len(found)](*[t.id for t in found]) if len(found) < len(_PACK) else np.array([t.id for t in found], "<u4").tobytes()
        return ids

    @staticmethod
    def _parts(chunk: str) -> list[str] | None:
        if len(chunk) > LONGEST or not (chunk.isascii() or max(chunk) < "\u0100") or not chunk.isprintable() or "<|" in chunk:
            return None
        low = chunk.lower()
        if low.isalpha():
            return [low]
        return [low[:-1], low[-1]] if low[-1] in _STOPS and low[:-1].isalpha() else _WORD.findall(low)

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_ids: dict[str, Ids] = {}  # by path, kept by a worker from task to task


def _pieces(path: str, capacity: int, end: int):
    mark = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids[path] if path in _ids else _ids.setdefault(path, Ids(path))
        for batch in batches:
            of, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                all_ids = memoryview(ids.of(text.as_py()) + mark)
                for k, at in enumerate(range(0, len(all_ids), 4 * capacity)):
                    part = all_ids[at : at + 4 * capacity]
                    of.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.record_batch(
                [batch.column(0).take(pa.array(of, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots for counts[size] pieces of each size, largest first, each in the smallest gap
    that holds it: (size, first rank, pieces per sequence, first sequence, offset).

    A run of slots has `per` pieces in each of consecutive sequences; the next run of the
    same size begins where its ranks end.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, number) of the sequences that have it
    order: list[int] = []  # the gaps there are, ascending
    opened = 0

    def leave(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            heapq.heappush(gaps[gap], (first, number))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect_left(order, size)
            if at < len(order):
                gap = order[at]
                first, number = heapq.heappop(gaps[gap])
                if not gaps[gap]:
                    del gaps[gap], order[at]
            else:
                gap, first = capacity, opened
                number = -(-left // (capacity // size))
                opened += number
            per = min(gap // size, left)
            full = min(number, left // per)  # sequences that take `per` pieces each
            runs.append((size, rank, per, first, capacity - gap))
            leave(gap - per * size, first, full)
            rank, left = rank + full * per, left - full * per
            if full < number:
                # What is left, if anything, is too little to fill one more sequence so.
                leave(gap, first + full, number - full)
    return runs


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first_rank, per, first, offset = shared.value
        key = size * (1 << 45) + first_rank
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            k = np.searchsorted(key, length * (1 << 45) + rank, "right") - 1
            nth, place = np.divmod(rank - first_rank[k], per[k]) if len(k) else (k, k)
            yield pa.record_batch([*batch.columns[:5], pa.array(first[k] + nth, pa.int64()), pa.array(offset[k] + place * length, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece.

    Every row of docs is packed, repeated ones and those without a doc_id too.  A null or
    empty text has one piece, the end id alone.  Ties in size go by doc_id, piece and
    checksum.  Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    own = pick(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    # Kept, as range-sorting reads its input twice.
    pieces = materialize(own.mapInArrow(_pieces(path, capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    keys = ["length", "doc_id", "piece", "ids_crc32"]
    sorted_ = materialize(pieces.repartitionByRange(*keys).sortWithinPartitions(*keys))
    # A file's rows keep their order and its number; (file, place in it) is a total order.
    placed = sorted_.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    # One row for each (file, size), at most the files and the sizes together, as files don't overlap but in one size.
    classes = placed.groupBy("length", "_file").agg(F.min("_row").alias("_from"), F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = classes.select("length", "_file", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")).alias("_shift"))
    counts = {r.length: r.n for r in classes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    runs = np.array(sorted(sweep(counts, capacity)), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(tuple(np.ascontiguousarray(c) for c in runs.T))
    return (
        placed.join(starts, ["length", "_file"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_row") + F.col("_shift")).alias("rank"))
        .mapInArrow(_place(shared), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    )
