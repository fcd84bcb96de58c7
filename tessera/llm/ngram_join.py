"""Similarity self-join of documents on word shingles, by rare-first prefix filtering.

A document is the set of its hashed shingles.  Sets are ordered rare-first: by frequency
class, then by hash.  Shingles are counted over all documents, block by block; what occurs
more than once in a block is summed in a hashed table of fixed size, so that the order's
size never grows with the corpus, and one-off shingles don't blur it.  Any order gives
right results; this one puts common passages behind what tells documents apart.
Two sets with Jaccard similarity of at least t share an element of their prefixes, so
only prefixes are shuffled.  Documents with equal sets are one set from then on.

Groups of near copies aren't expanded into pairs.  In each posting list, a set is first
compared with a few pivots of its size class (stars); what links is one component, and
two sets of one component are never compared again.  After these rounds every pair of
different components that shares a prefix element and passes the filters is compared, each
once, so no link between components is lost: a linked pair's first common element passes
them.  Long lists are cut into blocks, and pairs of blocks meet in tasks of their own.

The suffix filter runs before a pair is written: a posting carries the parities of its
set's elements in BITS classes of hashes.  Two sets differ in at least as many elements
as their parities differ, so a pair that differs too much can't link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bitmap, delete, drop, forget_shuffles, in_batches, materialize, new_path, pick
from tessera.llm.components import components

#: Cells of the frequency table; bits of the largest table that names wanted sets, which spares hashing and shuffling others.
FREQUENCIES, WANTED = 1 << 20, 1 << 26
#: Dropped rows up to which their keys are broadcast; beyond, they are joined by shuffle.
BROADCAST_KEYS = 500_000
#: Shingles counted at once, rounds of comparison with pivots, pivots of a size class in a list, sets compared with one
#: set in one task, lists that are compared side by side, rows of a block of a longer one, pairs compared at once.
BLOCK, STARS, PIVOTS, FAN, SIDE, ROWS, PAIRS = 2_000_000, 2, 8, 2_000, 32, 1_024, 200_000
#: Sets that a worker remembers having seen; bytes up to which words are hashed side by side.
REMEMBERED, LONG = 300_000, 64
#: Classes of hashes whose parities stand for a set in the suffix filter; bytes of text hashed at once.
BITS, TEXT = 1024, 2 << 20
#: Parts in which sets are loaded, one scan of the texts for each, and in which pairs are compared; the files of one are deleted before the next.
LOADS, PARTS = 2, 3
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the words of all texts, one after another, and the numbers of words up to the end of each text.

    All words are hashed at once, eight bytes at a time; words of more than LONG bytes by
    xxhash, so that one of them doesn't hold up the others.
    """
    found = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    ends = np.cumsum([len(f) + 1 for f in found])
    data = b" ".join(found) + bytes(9)
    raw = np.frombuffer(data, np.uint8)[:-9]
    word = np.zeros(len(raw) + 2, bool)
    np.not_equal(raw, 32, out=word[1:-1])
    word[1:-1] &= (raw - np.uint8(9)) > 4  # 9 to 13; the subtraction is modulo 256
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, size = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each place
    h = _mixed(size.astype(np.uint64) * _PRIME + np.uint64(1))
    rows, at, left = np.flatnonzero(size <= LONG), starts, size
    at, left = at[rows], left[rows]
    while len(rows):
        part = eight[at] & _LOW[np.minimum(left, 8)]
        h[rows] = _mixed(_mixed(part + _PRIME) ^ h[rows])
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + size[i]])
    return h, np.searchsorted(starts, ends)


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of a text.

    A-Z count as a-z, words end at space and U+0009 to U+000D; fewer than `width` words
    are one shingle, none are the empty set.
    """
    return _distinct(word_hashes([text])[0], width)


def _distinct(h: np.ndarray, width: int) -> np.ndarray:
    """shingles(), from the hashes of a text's words."""
    if not len(h):
        return np.zeros(0, np.uint64)
    n = min(width, len(h))
    total = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        total = _mixed(total) + h[k : len(h) - n + 1 + k] * _PRIME
    total = np.sort(_mixed(total + np.uint64(n)))
    return total[np.r_[True, total[1:] != total[:-1]]]


def batch_shingles(texts: list[str | None], width: int) -> list[np.ndarray]:
    """shingles() of each text, with the hashing done for all of them at once."""
    h, ends = word_hashes(texts)
    total = len(h)
    if total >= width:
        out = h[: total - width + 1].copy()
        for k in range(1, width):
            out = _mixed(out) + h[k : total - width + 1 + k] * _PRIME
        out = _mixed(out + np.uint64(width))
    sets, start = [], 0
    for end in ends.tolist():
        if end - start >= width:
            s = np.sort(out[start : end - width + 1])
            sets.append(s[np.concatenate([_TRUE, s[1:] != s[:-1]])])
        else:
            sets.append(_distinct(h[start:end], width))
        start = end
    return sets


_TRUE = np.ones(1, bool)
#: Masks of the first bytes of eight, by their number.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _scan(width: int):
    """A row for each document; and the shingles that a block of documents has more than once, by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, block = np.zeros(FREQUENCIES, np.int64), 0, []

        def count() -> None:
            h = np.sort(np.concatenate([np.zeros(0, np.uint64), *block]))
            at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
            n = np.diff(np.r_[at, len(h)])
            at, n = at[n > 1], n[n > 1]
            np.add.at(seen, _cell(h[at]), n)
            block.clear()

        for batch in in_batches(batches, TEXT):
            sets = batch_shingles(batch.column(1).to_pylist(), width)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.nulls(len(sets), pa.int64())], names=["doc_id", "text_key", "set_id", "n", "cell"])
            block.extend(sets)
            held += sum(map(len, sets))
            if held > BLOCK:
                count()
                held = 0
        count()
        at = np.flatnonzero(seen)
        none = pa.nulls(len(at), pa.int64())
        yield pa.record_batch([none, none, none, pa.array(seen[at]), pa.array(at)], names=["doc_id", "text_key", "set_id", "n", "cell"])

    return run


def _cell(s: np.ndarray) -> np.ndarray:
    return ((s >> np.uint64(20)) % np.uint64(FREQUENCIES)).astype(np.int64)


def frequency_classes(counts: np.ndarray) -> np.ndarray:
    """Twice the binary logarithm."""
    return np.round(2 * np.log2(np.maximum(counts, 1))).astype(np.uint8)


def rare_first(s: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return s[np.argsort(classes[_cell(s)], kind="stable")]  # s is sorted by hash


def _prefixes(shared, width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, classes = set(), shared.value
        for batch in in_batches(batches, TEXT):
            tokens, ids, places = [], [], []
            for s in batch_shingles(batch.column(0).to_pylist(), width):
                if not len(s) or (own := set_id(s)) in done:
                    continue
                if len(done) >= REMEMBERED:
                    done.clear()
                done.add(own)
                p = rare_first(s, classes)[: prefix_length(len(s), percent)]
                tokens.append(p)
                ids.append(np.full(len(p), own))
                places.append((len(s) << 32) + np.arange(len(p)))
            if tokens:
                yield pa.record_batch([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(places))], names=["token", "set_id", "place"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], names: list[str], bits: str | None = None, most: int | None = None) -> Iterator[tuple[dict[str, np.ndarray], bool]]:
    """Rows sorted by the first column, in arrays that end where its value changes, and True.

    bits: a binary column of BITS / 8 bytes.  A value with more than `most` rows comes in
    parts, each by itself and with False.
    """
    rest: dict[str, np.ndarray] | None = None
    over = None
    for batch in batches:
        part = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
        if bits is not None:
            part[bits] = np.frombuffer(b"".join(batch.column(bits).to_pylist()), np.uint64).reshape(-1, BITS // 64)
        if rest is not None:
            part = {n: np.concatenate([rest[n], v]) for n, v in part.items()}
        if not len(part[names[0]]):
            continue
        if over is not None:
            cut = int(np.searchsorted(part[names[0]], over, "right"))
            if cut:
                yield {n: v[:cut] for n, v in part.items()}, False
                part = {n: v[cut:] for n, v in part.items()}
            rest = None
            if not len(part[names[0]]):
                continue
            over = None
        key = part[names[0]]
        last = int(np.searchsorted(key, key[-1]))
        if last:
            yield {n: v[:last] for n, v in part.items()}, True
        rest = {n: v[last:] for n, v in part.items()}
        if most is not None and len(rest[names[0]]) > most:
            yield rest, False
            rest, over = None, key[-1]
    if rest is not None and len(rest[names[0]]):
        yield rest, True


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)


def required(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least number of common elements of two linked sets: J >= t is overlap >= t / (1 + t) (n + m)."""
    return -(-percent * (n + m) // (100 + percent))


def _may_link(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Length and positional filters, from places (size << 32 | position), for a first common element."""
    n, i, m, j = x >> 32, x & 0xFFFFFFFF, y >> 32, y & 0xFFFFFFFF
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (1 + np.minimum(n - i - 1, m - j - 1) >= required(n, m, percent))


def _pairs(g: dict[str, np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (r, c) of pairs in one list that may link, r before c, in parts.  Rows are sorted by (token, place)."""
    token, place = g["token"], g["place"]
    starts = _starts(token)
    size = np.diff(np.r_[starts, len(token)])
    small = np.repeat(size <= SIDE, size)
    for k in range(1, SIDE):
        r = np.flatnonzero((token[k:] == token[:-k]) & small[:-k])
        if not len(r):
            break
        r = r[_may_link(place[r], place[r + k], percent)]
        yield r, r + k
    for a, b in zip(starts[size > SIDE], (starts + size)[size > SIDE], strict=True):
        sizes = place[a:b] >> 32
        for low in range(0, b - a, ROWS):
            high = min(low + ROWS, b - a)
            # Sizes ascend, so partners end where they are too large for the last of these rows.
            for to in range(low, int(np.searchsorted(sizes * percent, sizes[high - 1] * 100, "right")), ROWS):
                end = min(to + ROWS, b - a)
                r, c = np.nonzero(_may_link(place[a + low : a + high, None], place[None, a + to : a + end], percent))
                keep = r + low < c + to
                yield r[keep] + a + low, c[keep] + a + to


def _lists(percent: int):
    """Postings that may be the first common element of a linked pair; a set once in a list."""
    names = ["token", "place", "set_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, whole in _groups(batches, names, most=8 * ROWS):
            same = np.r_[False, (g["token"][1:] == g["token"][:-1]) & (g["set_id"][1:] == g["set_id"][:-1])]
            g = {n: v[~same] for n, v in g.items()}
            size = np.diff(np.r_[_starts(g["token"]), len(g["token"])])
            keep = np.repeat(size > (SIDE if whole else 0), size)
            small = np.repeat((size > 1) & (size <= SIDE), size) & ~keep
            few = {n: v[small] for n, v in g.items()}
            used = np.zeros(len(few["token"]), bool)
            for r, c in _pairs(few, percent):
                used[r] = used[c] = True
            keep[np.flatnonzero(small)[used]] = True
            if keep.any():
                yield pa.record_batch([pa.array(g[n][keep]) for n in names], names=names)

    return run


def signature(s: np.ndarray) -> bytes:
    """The parity of the number of elements in each of BITS classes of hashes."""
    return np.packbits(np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS).astype(np.uint8) & 1).tobytes()


def _differences(bits: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A lower bound of the number of elements that are in one of two sets only."""
    return np.concatenate([np.zeros(0, np.int64), *(np.bitwise_count(bits[r[at : at + PAIRS]] ^ bits[c[at : at + PAIRS]]).sum(1, dtype=np.int64) for at in range(0, len(r), PAIRS))])


def _close(g: dict[str, np.ndarray], r: np.ndarray, c: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix filter: which pairs of rows differ by no more than linked sets do, and that bound of each."""
    n, m = g["place"][r] >> 32, g["place"][c] >> 32
    far = _differences(g["bits"], r, c)
    return far <= n + m - 2 * required(n, m, percent), far


def _stars(percent: int, turn: int):
    """For each posting the closest pivot of another component that it may link with: x, y, far."""
    names = ["list", "place", "set_id", "root", "side"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, _ in _groups(batches, names, "bits"):
            size_class = np.floor(np.log(g["place"] >> 32) / np.log(100 / percent)).astype(np.int64)
            at = np.flatnonzero(np.r_[True, (g["list"][1:] != g["list"][:-1]) | (size_class[1:] != size_class[:-1])])
            number = np.diff(np.r_[at, len(size_class)])
            best = np.full(len(size_class), -1)
            least = np.full(len(size_class), np.iinfo(np.int64).max)
            for k in range(PIVOTS):
                pivot = np.repeat(at + (number * (STARS * k + turn)) // (STARS * PIVOTS), number)
                r = np.flatnonzero((g["root"] != g["root"][pivot]) & _may_link(g["place"], g["place"][pivot], percent))
                if not len(r):
                    continue
                ok, far = _close(g, r, pivot[r], percent)
                r, far = r[ok], far[ok]
                better = far < least[r]
                best[r[better]], least[r[better]] = pivot[r[better]], far[better]
            r = np.flatnonzero(best >= 0)
            if len(r):
                yield pa.record_batch([pa.array(g["set_id"][r]), pa.array(g["set_id"][best[r]]), pa.array(least[r])], names=["x", "y", "far"])

    return run


def _crossings(percent: int):
    """All pairs of a list that are of different components and pass the filters; side: 0, or which of two blocks."""
    names = ["list", "place", "set_id", "root", "side"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def out() -> pa.RecordBatch:
            pairs = np.unique(np.concatenate(held), axis=0)  # many lists give the same pair
            held.clear()
            return pa.record_batch([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["x", "y"])

        for g, _ in _groups(batches, names, "bits"):
            g["token"] = g["list"]
            for r, c in _pairs(g, percent):
                ok = (g["root"][r] != g["root"][c]) & ((g["side"][r] == 0) | (g["side"][r] != g["side"][c]))
                r, c = r[ok], c[ok]
                ok, _ = _close(g, r, c, percent)
                if ok.any():
                    a, b = g["set_id"][r[ok]], g["set_id"][c[ok]]
                    held.append(np.c_[np.minimum(a, b), np.maximum(a, b)])
                    count += len(a)
            if count > PAIRS:
                yield out()
                count = 0
        if held:
            yield out()

    return run


def _sets(shared, width: int, part: int = 0, parts: int = 1):
    """The shingles of the sets of a part that the table of wanted ones may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, wanted = set(), shared.value
        bits = len(wanted) * 8
        for batch in in_batches(batches, TEXT):
            ids, parities, sets = [], [], []
            for s in batch_shingles(batch.column(0).to_pylist(), width):
                cell = (own := set_id(s)) % bits
                if len(s) and wanted[cell >> 3] >> (cell & 7) & 1 and (own >> 32) % parts == part and own not in done:
                    if len(done) >= REMEMBERED:
                        done.clear()
                    done.add(own)
                    ids.append(own)
                    parities.append(signature(s))
                    sets.append(s.tobytes())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(parities, pa.binary()), pa.array(sets, pa.binary())], names=["set_id", "bits", "elements"])

    return run


def _linked(percent: int):
    """Rows sorted by y and part, y's own set first: (x, y) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, name = None, None
        for batch in batches:
            found_x, found_y = [], []
            for y, x, data in zip(batch.column("y").to_pylist(), batch.column("x").to_pylist(), batch.column("elements"), strict=True):
                s = np.frombuffer(data.as_buffer(), np.uint64)
                if x is None:
                    own, name = s.copy(), y
                    continue
                if name != y:
                    raise RuntimeError("a compared set is missing")
                at = np.searchsorted(own, s)
                at[at == len(own)] = 0
                if int((own[at] == s).sum()) >= int(required(np.int64(len(s)), np.int64(len(own)), percent)):
                    found_x.append(x)
                    found_y.append(y)
            yield pa.record_batch([pa.array(found_x, pa.int64()), pa.array(found_y, pa.int64())], names=["a", "b"])

    return run


class _Join:
    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.width, self.percent, self.spark = width, percent, docs.sparkSession
        self.own = pick(docs, doc_id="long", text="string")
        scanned = materialize(self.own.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(_scan(width), "doc_id long, text_key long, set_id long, n long, cell long"))
        self.rows = scanned.filter("cell is null").select("doc_id", "text_key", "set_id", F.col("n").alias("n_shingles"))
        cells = scanned.filter("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most FREQUENCIES rows
        counts = np.zeros(FREQUENCIES, np.int64)
        counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
        self.classes = self.spark.sparkContext.broadcast(frequency_classes(counts))
        self.made: list[DataFrame] = []
        self.tables: dict[str, str] = {}  # name: path

    def kept(self, df: DataFrame) -> DataFrame:
        self.made.append(materialize(df))
        return self.made[-1]

    def lists(self) -> DataFrame:
        """token, place, set_id, blocks: the postings, and into how many blocks a list is cut."""
        postings = self.own.select("text").mapInArrow(_prefixes(self.classes, self.width, self.percent), "token long, set_id long, place long")
        lists = self.kept(postings.repartition("token").sortWithinPartitions("token", "place", "set_id").mapInArrow(_lists(self.percent), "token long, place long, set_id long"))
        long_ = self.kept(lists.groupBy("token").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("blocks")).filter("blocks > 1"))
        return lists.join(long_, "token", "left").select("token", "place", "set_id", F.coalesce("blocks", F.lit(1)).alias("blocks"))

    def load(self, ids: DataFrame) -> DataFrame:
        """set_id, bits, elements of these ids (a column set_id), from the texts; bucketed by set_id, so that joins on it don't shuffle it."""
        ids = self.kept(ids)
        bits = 1 << 16
        while bits < min(WANTED, 8 * ids.count()):
            bits *= 2
        shared = self.spark.sparkContext.broadcast(bitmap(ids, "set_id", bits))
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        path = new_path(self.spark)
        forget_shuffles(self.spark)
        name = "tessera_" + path.rpartition("-")[2]
        self.tables[name] = path
        for k in range(LOADS):
            sets = self.own.select("text").mapInArrow(_sets(shared, self.width, k, LOADS), "set_id long, bits binary, elements binary")
            sets = sets.repartition(parts, "set_id").join(ids, "set_id", "left_semi").dropDuplicates(["set_id"])
            sets.write.mode("append").bucketBy(parts, "set_id").sortBy("set_id").option("path", path).format("parquet").saveAsTable(name)
            del sets
            forget_shuffles(self.spark)
        return self.spark.table(name)

    def linked(self, pairs: DataFrame) -> DataFrame:
        """pairs: x, y, each once -> a, b: those that link."""
        forget_shuffles(self.spark)  # of what found the pairs
        return reduce(DataFrame.unionByName, [self._linked_part(pairs.filter(F.pmod(F.xxhash64("y"), F.lit(PARTS)) == k)) for k in range(PARTS)])

    def _linked_part(self, pairs: DataFrame) -> DataFrame:
        fan = self.kept(pairs.groupBy("y").agg(F.ceil(F.count("*") / FAN).cast("int").alias("parts")))
        x = pairs.join(fan, "y").select("y", F.pmod(F.xxhash64("x"), "parts").cast("int").alias("part"), "x").join(self.sets.select(F.col("set_id").alias("x"), "elements"), "x").select("y", "part", "x", "elements")
        y = fan.join(self.sets.select(F.col("set_id").alias("y"), "elements"), "y").select("y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("x"), "elements")
        met = y.unionByName(x).repartition("y", "part").sortWithinPartitions("y", "part", F.col("x").asc_nulls_first())
        found = self.kept(met.mapInArrow(_linked(self.percent), "a long, b long"))
        forget_shuffles(self.spark)
        return found

    def met(self, lists: DataFrame, both: bool) -> DataFrame:
        """Lists (with roots) and the sets' parities, rows of a list and block together, by size; both: two blocks at a time."""
        rows = lists.join(self.sets.select("set_id", "bits"), "set_id").withColumn("own", F.pmod(F.xxhash64("set_id"), "blocks").cast("int"))
        one = F.when(F.col("blocks") == 1, F.col("token"))
        if both:
            rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            name = F.coalesce(one, F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")))
            side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        else:
            name, side = F.coalesce(one, F.xxhash64("token", "own")), F.lit(0)
        return rows.select(name.alias("list"), "place", "set_id", "root", side.cast("int").alias("side"), "bits").repartition("list").sortWithinPartitions("list", "place", "set_id")

    def roots(self) -> DataFrame:
        """set_id, root of every set that is linked with another."""
        lists = self.lists()
        self.sets = self.load(lists.select("set_id").distinct())
        links, tried, roots = None, None, None
        open_ = self.kept(lists.withColumn("root", F.col("set_id")))
        for turn in range(STARS):
            seen = self.met(open_, False).mapInArrow(_stars(self.percent, turn), "x long, y long, far long")
            if tried is not None:
                seen = seen.join(tried, ["x", "y"], "left_anti")
            best = seen.groupBy("x").agg(F.min(F.struct("far", "y")).alias("best")).select("x", F.col("best.y").alias("y"))
            pairs = self.kept(best)
            tried = pairs if tried is None else tried.unionByName(pairs)
            new = self.linked(pairs)
            if not new.take(1):
                break
            links = new if links is None else links.unionByName(new)
            roots = components(links)
            # Only lists of several components are compared again.
            rooted = open_.drop("root").join(roots.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
            mixed = rooted.groupBy("token").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most").select("token")
            open_ = self.kept(rooted.join(mixed, "token", "left_semi").select("token", "place", "set_id", "blocks", "root"))
        pairs = self.met(open_, True).mapInArrow(_crossings(self.percent), "x long, y long").distinct()
        once = tried.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        new = self.linked(self.kept(pairs.join(once, ["x", "y"], "left_anti")))
        if links is None:
            return components(new).withColumnRenamed("id", "set_id")
        if new.take(1):
            roots = components(links.unionByName(new))
        return roots.withColumnRenamed("id", "set_id")

    def close(self) -> None:
        """Delete what only the join itself read."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, list(self.tables.values()))
        drop(*self.made)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, text_key: one row for each row of docs.

    Documents link when their sets of distinct shingles have a Jaccard similarity of at
    least `percent` per cent, equal sets included; component_id is the smallest doc_id that
    links reach.  Null, empty and blank texts have no shingles and link with nothing; so
    component_id is their doc_id.  Repeated rows are in one component.  A null doc_id
    counts as none: a component of such rows has a null component_id.  Shingles are told
    apart by 64-bit hashes.  Other columns are ignored; an empty table gives an empty result.
    """
    join = _Join(docs, width, percent)
    roots = join.roots()
    join.close()
    classes = join.rows.filter("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    classes = materialize(classes.join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id")))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(classes.select("set_id", "root").join(least, "root").select("set_id", "component_id"))
    alone = join.rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_key")
    return join.rows.filter("n_shingles > 0").join(named, "set_id").select("doc_id", "n_shingles", "component_id", "text_key").unionByName(alone)


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id, all columns kept.

    Documents without shingles stay.  Of repeated rows (equal doc_id and text) one stays;
    rows without a doc_id go if their component has one, and stay otherwise.
    """
    rows = materialize(near_duplicates(docs, width, percent).filter("n_shingles > 0"))
    named = rows.withColumn("_key", F.xxhash64("doc_id", "text_key"))
    gone = named.filter("component_id is not null and not (doc_id <=> component_id)").select("_key").distinct()
    # What the smallest doc_id of a component has in several rows.
    twice = named.filter("doc_id = component_id").groupBy("component_id").agg(F.count("*").alias("n"), F.min("_key").alias("_key")).filter("n > 1")
    special = materialize(gone.withColumn("rows", F.lit(0)).unionByName(twice.select("_key", F.lit(1).alias("rows"))).unionByName(named.join(twice.select("component_id"), "component_id").filter("doc_id = component_id").select("_key", F.lit(0).alias("rows"))).groupBy("_key").agg(F.max("rows").alias("rows")))
    few = special.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    # The caller's columns by place, so that none has the name of the key.
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = dict(zip(docs.columns, names, strict=True))
    key = F.xxhash64(F.col(place["doc_id"]).cast("long"), F.xxhash64(F.col(place["text"]).cast("string")))
    keyed = docs.toDF(*names).withColumn("_key", key)
    rest = keyed.join(F.broadcast(special) if few else special, "_key", "left_anti")
    once = special.filter("rows = 1").select("_key")
    if once.take(1):
        rest = rest.unionByName(keyed.join(F.broadcast(once) if few else once, "_key", "left_semi").dropDuplicates(["_key"]))
    return rest.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


#: The same in DuckDB, over all pairs that share a shingle.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id WHERE r.root < e.y)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
