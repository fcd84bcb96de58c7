"""Exact repeats of `length` bytes across documents, cut from all but the first document.

Sorting all suffixes of a corpus moves several bytes for each byte of text.  Here a cover
of positions is chosen by content instead: a position is in the cover if the hash of the
`GRAM` bytes from it is the least of those that begin in some window, the window being
such that every string of `length` bytes holds a whole gram of the cover, at a place that
the string alone decides.  So equal strings hold equal cover grams at equal places.

1. Cover grams are ranked by the documents they occur in (summed per task first); those
   of one document only can't lie in a repeat.
2. A string belongs to the least gram in it.  The bytes of the strings of each of the other
   grams are dealt into buckets by gram.  A bucket is sorted one block of whole grams at a
   time, once for each place the gram can have in a string; rows that tie have equal strings,
   and the least document id of a tie decides.  The table that names the grams grows with
   their number; where it or the rows would be too many, ranges of grams are done one after
   another, each with a scan of its own, and the files of one are deleted before the next.
3. Where a string has an earlier document, its span is sent to its document, and the
   spans' union is cut.

A gram with more than `HOT` rows isn't gathered, and its rows aren't shuffled.  Two more scans
of the texts do its strings: one reduces them by hash to their least and greatest document,
in each task and then over all; the other looks up those of several documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bitmap, drop, forget_shuffles, in_batches, materialize, pick, small_batches

#: Bytes of a gram; rows of a gram that one task takes; bits of the table that names cut documents (fixed).
GRAM, HOT, CUT = 20, 50_000, 1 << 24
#: Bits of the table that names shared grams: for each gram where they fit and at the least, and of all of it at the least and most.
WIDE, TIGHT, SHARED = 14, 4, (1 << 16, 1 << 29)
#: Bytes of text for which one row may be dealt into buckets at once (a row takes about 60 bytes of disk), and rows that always may.
TEXT, FEW = 36, 100_000
#: Grams that are treated as hot at most, the most frequent ones, and strings of theirs up to which a table is broadcast; beyond, strings are joined by shuffle.
BROADCAST_HOT, BROADCAST_STRINGS = 1_000_000, 2_000_000
#: The bit of a gram's hash from which passes are told apart; cells of the table are named by lower ones.
PASS = 40
_BYTES = np.array([xxhash.xxh3_64_intdigest(bytes([i]), seed=1) for i in range(256)], np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _extreme(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every `width` consecutive values, in a logarithm of steps."""
    done = 1
    while done * 2 <= width:
        x = op(x[:-done], x[done:])
        done *= 2
    return op(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def cover(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the cover in ascending order, the hashes of their grams, and the least hash of each string."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = _BYTES[np.frombuffer(data, np.uint8)]
    sums, done, at = None, 0, 0  # hashes of runs whose lengths are powers of two, put together to GRAM
    run = 1
    while True:
        if GRAM & run:
            part = h[at : len(data) - (GRAM - at - run)]
            sums = part[: len(data) - GRAM + 1] if sums is None else sums * _P + part[: len(data) - GRAM + 1]
            at += run
        if run * 2 > GRAM:
            break
        h = _mixed(h[:-run] * _P + h[run:])
        run *= 2
    sums = _mixed(sums)
    window = length - GRAM + 1
    least = _extreme(sums, window, np.minimum)
    edge = np.zeros(window - 1, np.uint64)
    reach = _extreme(np.concatenate([edge, least, edge]), window, np.maximum)
    at = np.flatnonzero(reach == sums)
    return at, sums[at], least


def _owned(data: bytes, at: np.ndarray, h: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and last start of the strings whose least gram is the one at each position of the cover."""
    ends = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, [len(least)]])
    # Runs of one least hash come in the order of its positions; equal neighbours in the cover share a run.
    run = np.zeros(len(h), np.int64)
    np.cumsum(h[1:] != h[:-1], out=run[1:])
    return np.maximum(ends[run], at - (length - GRAM)), np.minimum(ends[run + 1] - 1, at)


def _ranked(length: int, limit: int = 8 << 20, rows: int = 1 << 16):
    """gram, first, last, n: the least and greatest document and the number of each gram in about `limit` bytes of text, in batches of so many rows."""

    def summed(grams: list[np.ndarray], docs: list[int]) -> Iterator[pa.RecordBatch]:
        h, d = np.concatenate(grams).view(np.int64), np.repeat(np.array(docs, np.int64), [len(x) for x in grams])
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        out = pa.record_batch([pa.array(h[at]), pa.array(np.minimum.reduceat(d, at)), pa.array(np.maximum.reduceat(d, at)), pa.array(np.diff(np.r_[at, len(h)]))], names=["gram", "first", "last", "n"])
        yield from (out.slice(i, rows) for i in range(0, len(at), rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, docs, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                h = cover(data, length)[1]
                if not len(h):
                    continue
                grams.append(h)
                docs.append(doc)
                size += len(data)
                if size >= limit:
                    yield from summed(grams, docs)
                    grams, docs, size = [], [], 0
        if grams:
            yield from summed(grams, docs)

    return run


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # of _P and of its inverse


def _strings(data: bytes, hot: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the strings of `length` bytes whose least gram is hot, and their hashes."""
    at, h, least = cover(data, length)
    keep = _among(h, hot)
    if not keep.any():
        return at[keep], np.zeros(0, np.uint64)
    low, high = (x[keep] for x in _owned(data, at, h, least, length))
    n = len(data)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, low, 1)
    np.add.at(edge, high + 1, -1)
    starts = np.flatnonzero(edge.cumsum() > 0)
    if len(_powers[0]) < n:
        for i, p in enumerate((int(_P), pow(int(_P), -1, 1 << 64))):
            _powers[i] = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, p, np.uint64)])
    sums = np.r_[np.uint64(0), np.cumsum(_BYTES[np.frombuffer(data, np.uint8)] * _powers[1][:n])]
    return starts, _mixed((sums[starts + length] - sums[starts]) * _powers[0][starts])


def _hot_reduced(shared, length: int):
    """h, first, last: the least and greatest document of each string whose least gram is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches, 4 << 20):
            found = [(doc, np.unique(_strings(text.as_py().encode("utf-8", "surrogatepass"), shared.value, length)[1])) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            h, d = np.concatenate([x for _, x in found]), np.repeat([doc for doc, _ in found], [len(x) for _, x in found])
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")
            h, d = h[order].view(np.int64), d[order]
            at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            yield pa.record_batch([pa.array(h[at]), pa.array(np.minimum.reduceat(d, at)), pa.array(np.maximum.reduceat(d, at))], names=["h", "first", "last"])

    return run


def _hot_looked_up(shared, length: int):
    """Spans of strings whose least gram is hot that a table (sorted hashes, least documents) gives an earlier document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, known, least = shared.value
        for batch in in_batches(batches, 4 << 20):
            keys, begins, ends = [], [], []
            for key, doc, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2), strict=True):
                starts, h = _strings(text.as_py().encode("utf-8", "surrogatepass"), hot, length)
                if not len(starts):
                    continue
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                starts = starts[(known[at] == h) & (least[at] < doc)]
                if len(starts):
                    new = np.flatnonzero(np.r_[True, np.diff(starts) > length])
                    keys.append(np.full(len(new), key))
                    begins.append(starts[new])
                    ends.append(starts[np.r_[new[1:] - 1, len(starts) - 1]] + length)
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in (keys, begins, ends)], names=["key", "begin", "end"])

    return run


def _hot_listed(shared, length: int):
    """key, doc_id, begin, h of every string whose least gram is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches, 1 << 20):
            for key, doc, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2), strict=True):
                starts, h = _strings(text.as_py().encode("utf-8", "surrogatepass"), shared.value, length)
                if len(starts):
                    yield pa.record_batch([pa.array(np.full(len(h), key)), pa.array(np.full(len(h), doc)), pa.array(starts), pa.array(h.view(np.int64))], names=["key", "doc_id", "begin", "h"])

    return run


def _within(first: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """For each row, which of `width` places are among `size` ones from the first."""
    places, first, end = np.arange(width, dtype=np.int32), first.astype(np.int32), (first + size).astype(np.int32)
    return (places >= first[:, None]) & (places < end[:, None])


def _around(shared, length: int, number: int = 0, passes: int = 1):
    """For each shared gram of a pass: the bytes of the strings whose least gram it is, and (first start, place of the gram from there) as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, hot = np.frombuffer(shared.value[0], np.uint8), shared.value[1]
        bits = np.uint64(8 * len(marks))
        side = length - GRAM
        width, edge = 2 * side + GRAM, bytes(side)
        for batch in in_batches(batches, 4 << 20):
            grams, keys, docs, starts, sizes, bytes_ = [], [], [], [], [], []
            for key, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                at, h, least = cover(data, length)
                cell = h % bits
                keep = (marks[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
                keep &= ((h >> np.uint64(PASS)) & np.uint64(passes - 1)) == number
                keep &= ~_among(h, hot)
                if not keep.any():
                    continue
                low, high = (x[keep] for x in _owned(data, at, h, least, length))
                padded = np.frombuffer(edge + data + edge, np.uint8)
                bytes_.append(np.lib.stride_tricks.sliding_window_view(padded, width)[at[keep]])
                sizes.append(high - low + length)
                grams.append(h[keep].view(np.int64))
                keys.append(np.full(len(low), key))
                docs.append(np.full(len(low), doc))
                starts.append(low << 16 | at[keep] - low)
            if grams:
                size, start = np.concatenate(sizes), np.concatenate(starts)
                flat = np.concatenate(bytes_)[_within(side - (start & 0xFFFF), size, width)]
                around = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.py_buffer(flat)])
                yield pa.record_batch([*(pa.array(np.concatenate(c).astype(np.int64)) for c in (grams, keys, docs, starts)), around], names=["gram", "key", "doc_id", "start", "around"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram, in blocks of whole grams of about so many rows."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        g = t.column(0).to_numpy()
        last = int(np.searchsorted(g, g[-1]))
        if last:
            yield t.slice(0, last)
        held, count = [t.slice(last)], t.num_rows - last
    if count:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _earlier(length: int):
    """Rows sorted by gram: spans of strings that also start in a document with a smaller id."""
    side = length - GRAM
    power = np.uint64(pow(int(_P), length, 1 << 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            doc, start = (block.column(i).to_numpy() for i in (2, 3))
            low, left = start >> 16, start & 0xFFFF
            ends = np.frombuffer(block.column(4).buffers()[1], np.int32)[block.column(4).offset :][: len(doc) + 1].astype(np.int64)
            size, flat = np.diff(ends), np.frombuffer(block.column(4).buffers()[2], np.uint8)[ends[0] : ends[-1]]
            # Aligned by the gram; what lies beyond a row's bytes is in none of its strings.
            wide = np.zeros((len(doc), 2 * side + GRAM), np.uint8)
            wide[_within(side - left, size, 2 * side + GRAM)] = flat
            prefix = np.zeros((2 * side + GRAM + 1, len(doc)), np.uint64)
            for j in range(2 * side + GRAM):
                prefix[j + 1] = prefix[j] * _P + _BYTES[wide[:, j]]
            repeated = np.zeros((len(doc), side + 3), bool)  # by place of the gram in the string, with an empty column at either end
            for o in range(side + 1):
                ok = np.flatnonzero((left >= o) & (left - o + length <= size))
                b = side - o
                h = (prefix[b + length] - prefix[b] * power)[ok]
                order = np.argsort(h)
                h, d = h[order], doc[ok][order]
                first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
                if len(first) == len(h):
                    continue
                least = np.repeat(np.minimum.reduceat(d, first), np.diff(np.r_[first, len(h)]))
                repeated[ok[order][d > least], o + 1] = True
            step = np.diff(repeated.astype(np.int8), axis=1)
            r, near = np.nonzero(step == 1)
            far = np.nonzero(step == -1)[1] - 1  # the runs end in the same order
            at = (low + left)[r]
            yield pa.record_batch([block.column(1).take(pa.array(r)), pa.array(at - far), pa.array(at - near + length)], names=["key", "begin", "end"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in range(5)]
        for doc, text, begin, end in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3), strict=True):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            kept, n, spans, at = [], 0, 0, 0
            if begin.is_valid and len(begin.values):
                b, e = begin.values.to_numpy(), end.values.to_numpy()
                order = np.argsort(b, kind="stable")
                b, e = b[order], np.maximum.accumulate(e[order])
                new = np.flatnonzero(np.r_[True, b[1:] > e[:-1]])
                for s, t in zip(b[new].tolist(), e[np.r_[new[1:] - 1, len(e) - 1]].tolist(), strict=True):
                    kept.append(data[at:s])
                    n, spans, at = n + t - s, spans + 1, t
            kept.append(data[at:])
            left = b"".join(kept)
            for c, v in zip(columns, (doc, len(data), n, spans, hashlib.sha256(left).hexdigest()), strict=True):
                c.append(v)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _hot_spans(rows: DataFrame, hot: np.ndarray, length: int) -> DataFrame:
    """As _earlier, for grams (a sorted array) whose rows no task should gather.  rows: key, doc_id, text."""
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast(hot)
    parts = rows.select("doc_id", "text").mapInArrow(_hot_reduced(shared, length), "h long, first long, last long")
    parts = parts.groupBy("h").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    least = materialize(parts.filter("first < last").select("h", F.col("first").alias("least")))
    if least.count() <= BROADCAST_STRINGS:
        table = least.toArrow()
        known = table["h"].to_numpy().view(np.uint64)
        order = np.argsort(known)
        if not len(order):
            return rows.sparkSession.createDataFrame([], "key long, begin long, end long")
        return rows.mapInArrow(_hot_looked_up(sc.broadcast((hot, known[order], table["least"].to_numpy()[order])), length), "key long, begin long, end long")
    strings = rows.mapInArrow(_hot_listed(shared, length), "key long, doc_id long, begin long, h long")
    return strings.join(least, "h").filter("doc_id > least").select("key", "begin", (F.col("begin") + length).alias("end"))


def _few_files(df: DataFrame, column: str) -> DataFrame:
    """df dealt by a column into partitions of the size that Spark aims at, for writing.

    A task writes a file at least, however little it has left, and Hadoop's local file system
    starts up to three processes a file.  Until such a process executes it counts with all the
    memory of its JVM, so tasks with much work and few rows shouldn't write.
    """
    return df.hint("rebalance", column)


def _plan(grams: int, rows: int, size: int) -> tuple[int, int]:
    """Bits of the table that names shared grams, and passes (a power of two), for so many grams and rows of them in so many bytes of text."""
    passes = 1
    while passes < 1 << 15 and (TIGHT * grams > passes * SHARED[1] or rows > passes * max(FEW, size // TEXT)):
        passes *= 2
    bits = SHARED[0]
    while bits < min(SHARED[1], WIDE * grams // passes):
        bits *= 2
    return bits, passes


def cut_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row for each row of docs.

    Texts are UTF-8 bytes, null being empty.  A byte goes if a string of `length` bytes
    that covers it also starts in a document with a smaller doc_id, as the texts came in;
    repeats inside a document, or between rows that share a doc_id, don't count.  Rows
    without a doc_id neither lose anything nor take from others.  Strings are told apart by
    64-bit hashes.  Other columns are ignored; an empty table gives an empty result.
    The session gets common.BATCH_BYTES, unless it has a limit for Arrow batches of its own.
    """
    sc = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    own = pick(docs, doc_id="long", text="string").withColumn("key", F.xxhash64("doc_id", "text"))
    long_ = own.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    ranks = long_.select("doc_id", "text").mapInArrow(_ranked(length), "gram long, first long, last long, n long")
    ranks = ranks.groupBy("gram").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    common = materialize(_few_files(ranks.filter("first < last").select("gram", "n"), "gram"))
    frequent = common.filter(F.col("n") > HOT).orderBy(F.desc("n"), "gram").limit(BROADCAST_HOT).select("gram").toArrow()
    hot = np.sort(frequent["gram"].to_numpy().view(np.uint64))
    forget_shuffles(docs.sparkSession)
    shared, rows = common.filter(F.col("n") <= HOT).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    size = long_.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    bits, passes = _plan(shared, rows, size)
    found = []
    for k in range(passes):
        own_grams = common.filter((F.shiftrightunsigned("gram", PASS).bitwiseAND(F.lit(passes - 1))) == k)
        marks = sc.broadcast((bitmap(own_grams, "gram", bits), hot))
        rest = long_.select("key", "doc_id", "text").mapInArrow(_around(marks, length, k, passes), "gram long, key long, doc_id long, start long, around binary")
        found.append(rest.repartition("gram").sortWithinPartitions("gram").mapInArrow(_earlier(length), "key long, begin long, end long"))
        if passes > 1:
            found[-1] = materialize(_few_files(found[-1], "key"))
            marks.unpersist()
            forget_shuffles(docs.sparkSession)
    if len(hot):
        found.append(_hot_spans(long_.select("key", "doc_id", "text"), hot, length))
    spans = reduce(DataFrame.unionByName, found)
    spans = materialize(spans.groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("s")).select("key", F.col("s.begin").alias("begin"), F.col("s.end").alias("end")))
    drop(common, *found)
    if passes == 1:
        marks.unpersist()
    touched = sc.broadcast(bitmap(spans, "key", CUT))
    forget_shuffles(docs.sparkSession)  # once more: as drop() asked, Spark could still be handling the end of the last job
    return _joined(own, spans, touched)


def _maybe_cut(batch: pa.RecordBatch, touched) -> np.ndarray:
    """Which rows (the first column is their key) the table of documents that lose something may hold."""
    marks, cell = np.frombuffer(touched.value, np.uint8), batch.column(0).to_numpy() & (CUT - 1)
    return (marks[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1


def _touched(touched):
    """key, doc_id, text of the rows that may lose something."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_maybe_cut(batch, touched)))

    return run


def _whole(touched):
    """As _cut, for the other rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rest() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = batch.filter(pa.array(~_maybe_cut(batch, touched)))
                none = pa.nulls(kept.num_rows, pa.list_(pa.int64()))
                yield pa.record_batch([kept.column(1), kept.column(2), none, none], names=["doc_id", "text", "begin", "end"])

        yield from _cut(rest())

    return run


def _joined(own: DataFrame, spans: DataFrame, touched) -> DataFrame:
    """own without what its spans cover; texts without any aren't shuffled.

    No task has two functions in Python: each would have a worker of its own, and an executor
    keeps its workers, so that all later tasks' memory would come on top of theirs.  (Hence
    no broadcast join, which would leave two functions in one task.)
    """
    rows = own.select("key", "doc_id", "text")
    cut = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    shuffled = rows.mapInArrow(_touched(touched), "key long, doc_id long, text string").join(spans.hint("merge"), "key", "left").select("doc_id", "text", "begin", "end")
    return _few_files(rows.mapInArrow(_whole(touched), cut).unionByName(shuffled.mapInArrow(_cut, cut)), "doc_id")


#: The same in DuckDB, with every string of 50 bytes.
ORACLE = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT doc_id, i, array_slice(b, i, i + 49) AS g FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS i FROM d WHERE doc_id IS NOT NULL)),
m AS (SELECT g, min(doc_id) AS least FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)),
f AS (SELECT doc_id, i FROM s JOIN m USING (g) WHERE doc_id > least),
o AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM f),
r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
u AS (SELECT doc_id, run, min(i) AS b, max(i) + 50 AS e FROM r GROUP BY 1, 2),
k AS (SELECT doc_id, b AS cut, e AS next, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 1) AS prior FROM u),
c AS (SELECT doc_id, sum(next - cut) AS gone, count(*) AS spans, max(next) AS tail, list({'b': prior, 'e': cut - 1} ORDER BY cut) AS kept FROM k GROUP BY 1)
SELECT d.doc_id, CAST(octet_length(d.b) AS BIGINT) AS n_bytes, CAST(coalesce(c.gone, 0) AS BIGINT) AS n_removed, coalesce(c.spans, 0) AS n_spans,
  sha256(CASE WHEN c.doc_id IS NULL THEN d.b ELSE list_reduce(list_transform(kept, lambda p: array_slice(d.b, p.b, p.e)) || [array_slice(d.b, tail, octet_length(d.b))], lambda x, y: x || y) END) AS kept_sha256
FROM d LEFT JOIN c ON c.doc_id = d.doc_id
"""
