"""Quality by an interpolated modified Kneser-Ney model of character n-grams.

The model is trained on trusted texts.  Its symbols are the characters of those texts as
they are, none folded; one that no trusted text holds is OTHER.  An n-gram is its context,
a number below symbols**(order - 1), and its last symbol.

Counts are summed by n-gram over the whole trusted corpus, sharded by n-gram; those of
lower orders count distinct continuations.  Each order's counts are joined with the
totals of their contexts, sharded by context, to give discounted probabilities and
back-off weights, which stay in the shared folder.  Up to `BROADCAST_GRAMS` of them are
taken to the documents: one scan, no shuffle of text.  Beyond, the documents' distinct
n-grams are joined to them in shards, with the same results.  A document is rejected if
its perplexity is above a quantile of its language, taken over trusted documents that were
held out from training and allowing for the length of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_batches, materialize, pick

ORDER = 4
#: Symbols that stand for no one character: start of text, other.
START, OTHER, FIRST = 0, 1, 2
#: Trusted rows up to which their ids are broadcast; beyond, they are joined by shuffle.
BROADCAST_IDS = 500_000
#: Languages up to which their limits are broadcast; beyond, they are joined by shuffle.
BROADCAST_LANGS = 100_000
#: N-grams of all orders up to which the model is broadcast; beyond, it is joined by shuffle.
BROADCAST_GRAMS = 2_000_000
#: Bytes of text counted or scored at once, which a worker's memory grows with.
TEXT = 1 << 18


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def symbols(points: np.ndarray, table: np.ndarray) -> np.ndarray:
    """points: code points of one text; table: symbol of each code point."""
    return table[points]


def symbol_table(alphabet: list[str]) -> np.ndarray:
    table = np.full(0x110000, OTHER, np.int64)
    table[[ord(c) for c in alphabet]] = FIRST + np.arange(len(alphabet))
    return table


def ngrams(text: str, table: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and last symbol of the n-gram that ends at each character."""
    s = np.r_[np.full(ORDER - 1, START, np.int64), symbols(_points(text), table)]
    n = len(s) - ORDER + 1
    context = s[:n].copy()
    for k in range(1, ORDER - 1):
        context *= base
        context += s[k : n + k]
    return context, s[ORDER - 1 :]


def ngram_codes(text: str, table: np.ndarray, base: int) -> np.ndarray:
    """The number of the n-gram that ends at each character, for a small alphabet."""
    context, last = ngrams(text, table, base)
    return context * base + last


def _distinct(context: np.ndarray, last: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams as context and last symbol, and the place of each given one among them."""
    if base**ORDER < 1 << 63:
        code, at = np.unique(context * base + last, return_inverse=True)
        return code // base, code % base, at
    known, at = np.unique(context, return_inverse=True)
    code, at = np.unique(at * base + last, return_inverse=True)
    return known[code // base], code % base, at


def _characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(0x110000, np.int64)
    for batch in in_batches(batches, TEXT):
        seen += np.bincount(_points("".join(batch.column(0).to_pylist())), minlength=len(seen))
    at = np.flatnonzero(seen)
    yield pa.record_batch([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["point", "n"])


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, base = shared.value
        table = symbol_table(alphabet)
        for batch in in_batches(batches, TEXT):
            parts = [ngrams(text, table, base) for text in batch.column(0).to_pylist()]
            context, last, at = _distinct(*(np.concatenate(x) for x in zip(*parts, strict=True)), base)
            yield pa.record_batch([pa.array(context, pa.int64()), pa.array(last, pa.int64()), pa.array(np.bincount(at, minlength=len(last)), pa.int64())], names=["context", "last", "n"])

    return run


class Grams:
    """Discounted probabilities and back-off weights of each order, as sorted arrays."""

    def __init__(self, alphabet: list[str], base: int, levels: list[pa.Table]):
        self.alphabet, self.base, self.orders = alphabet, base, []
        for t in levels:
            context, first, at = np.unique(t["context"].to_numpy(), return_index=True, return_inverse=True)
            code = at * base + t["last"].to_numpy()
            order = np.argsort(code)
            self.orders.append((context, t["back_off"].to_numpy()[first], code[order], t["p"].to_numpy()[order]))

    def log_probabilities(self, context: np.ndarray, last: np.ndarray) -> np.ndarray:
        p = np.full(len(context), 1 / self.base)
        for k, (contexts, back_off, codes, discounted) in enumerate(self.orders):
            if not len(codes):
                continue
            own = context % self.base**k
            at = np.minimum(np.searchsorted(contexts, own), len(contexts) - 1)
            known = contexts[at] == own
            code = at * self.base + last
            found = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            p = np.where(known, back_off[at], 1) * p + np.where(known & (codes[found] == code), discounted[found], 0)
        return np.log(p)


class Model:
    """levels: for each order a table of context, last, p, back_off in the shared folder; size: rows of all."""

    def __init__(self, alphabet: list[str], base: int, levels: list[DataFrame]):
        self.alphabet, self.base, self.levels = alphabet, base, levels
        self.size = sum(level.count() for level in levels)

    def grams(self) -> Grams:
        return Grams(self.alphabet, self.base, [level.toArrow() for level in self.levels])

    def log_probabilities(self) -> np.ndarray:
        """One number for each n-gram there can be, for a small alphabet."""
        code = np.arange(self.base**ORDER)
        return self.grams().log_probabilities(code // self.base, code % self.base).astype(np.float32)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more from the counts of counts."""
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5
    return tuple(min(max(d, 0.05), k - 0.05) for d, k in zip(found, (1, 2, 3), strict=True))


def train(texts: DataFrame, alphabet: int | None = None) -> Model:
    """texts: one column of trusted texts, none null; alphabet: the number of characters told apart, by default all."""
    spark = texts.sparkSession
    texts = texts.toDF("text")
    seen = texts.mapInArrow(_characters, "point long, n long").groupBy("point").agg(F.sum("n").alias("n")).toArrow()  # at most all of Unicode
    order = np.lexsort((seen["point"].to_numpy(), -seen["n"].to_numpy()))[:alphabet]
    chosen = [chr(c) for c in seen["point"].to_numpy()[order]]
    base = FIRST + len(chosen)
    shared = spark.sparkContext.broadcast((chosen, base))
    counts = materialize(texts.mapInArrow(_count(shared), "context long, last long, n long").groupBy("context", "last").agg(F.sum("n").alias("n")))
    levels = [counts]
    for k in range(ORDER - 2, -1, -1):  # the number of symbols seen before each shorter n-gram
        levels.insert(0, levels[0].groupBy((F.col("context") % F.lit(base**k)).cast("long").alias("context"), "last").agg(F.count("*").alias("n")))
    done = []
    for level in levels:
        n = {r.n: r["count"] for r in level.filter("n <= 4").groupBy("n").count().collect()}
        one, two, more = discounts(*(n.get(i, 0) for i in (1, 2, 3, 4)))
        rows = level.withColumn("less", F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(more))
        totals = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("less").alias("freed"))
        done.append(materialize(rows.join(totals, "context").select("context", "last", ((F.col("n") - F.col("less")) / F.col("total")).alias("p"), (F.col("freed") / F.col("total")).alias("back_off"))))
    return Model(chosen, base, done)


def _score(shared, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = shared.value
        table = symbol_table(grams.alphabet)
        for batch in in_batches(batches, TEXT, None):
            parts = [ngrams(text or "", table, grams.base) for text in batch.column(batch.num_columns - 1).to_pylist()]
            size = np.array([len(last) for _, last in parts], np.int64)
            context, last, at = _distinct(*(np.concatenate(x) for x in zip(*parts, strict=True)), grams.base)
            logs = grams.log_probabilities(context, last)[at]
            loss = [-float(x.sum()) for x in np.split(logs, np.cumsum(size)[:-1])]
            n = batch.num_columns - (not keep)
            yield pa.record_batch([*batch.columns[:n], pa.array(loss, pa.float64()), pa.array(size, pa.int64())], names=[*batch.schema.names[:n], "loss", "size"])

    return run


def _held(shared):
    """The distinct n-grams of each text, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, base = shared.value
        table = symbol_table(alphabet)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                context, last, at = _distinct(*ngrams(text, table, base), base)
                yield pa.record_batch([pa.array(np.full(len(last), key), pa.int64()), pa.array(context, pa.int64()), pa.array(last, pa.int64()), pa.array(np.bincount(at, minlength=len(last)), pa.int64())], names=["key", "context", "last", "n"])

    return run


def _joined(docs: DataFrame, model: Model) -> DataFrame:
    """score() for a model of any size: n-grams meet it in shards, texts are known by a 64-bit hash."""
    shared = docs.sparkSession.sparkContext.broadcast((model.alphabet, model.base))
    own = docs.withColumn("key", F.xxhash64("text"))
    held = materialize(own.filter(F.length("text") > 0).select("key", "text").mapInArrow(_held(shared), "key long, context long, last long, n long"))
    p = held.select("context", "last").distinct().withColumn("q", F.lit(1 / model.base))
    for k, level in enumerate(model.levels):
        p = p.withColumn("own", (F.col("context") % F.lit(model.base**k)).cast("long"))
        weights = level.groupBy(F.col("context").alias("own")).agg(F.first("back_off").alias("weight"))
        found = level.select(F.col("context").alias("own"), "last", "p")
        p = p.join(weights, "own", "left").join(found, ["own", "last"], "left").select("context", "last", (F.coalesce("weight", F.lit(1.0)) * F.col("q") + F.coalesce("p", F.lit(0.0))).alias("q"))
    # Repeated texts have the same mean, however many there are.
    means = held.join(p, ["context", "last"]).groupBy("key").agg((-F.sum(F.col("n") * F.log("q")) / F.sum("n")).alias("mean"))
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    rows = own.join(means, "key", "left")
    return rows.select(*docs.columns[:-1], F.coalesce(F.col("mean") * size, F.lit(0.0)).alias("loss"), size.alias("size"))


def trusted_rows(docs: DataFrame, trusted: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows of docs whose doc_id is in trusted."""
    ids = trusted.select(F.col(column).cast("long").alias(column)).filter(F.col(column).isNotNull()).distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, column, "left_semi")


def score(docs: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """docs with its last column, a text, replaced (or, to keep it, followed) by loss (nats) and size (characters)."""
    if model.size > BROADCAST_GRAMS:
        if keep:
            name = docs.columns[-1]
            docs = docs.withColumn("_scored", F.col(f"`{name}`"))
        return _joined(docs.toDF(*docs.columns[:-1], "text"), model)
    shared = docs.sparkSession.sparkContext.broadcast(model.grams())
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[: len(docs.columns) - (not keep)])
    return docs.mapInArrow(_score(shared, keep), f"{kept}, loss double, size long")


def _spread(good: DataFrame, quantile: float, least: int) -> DataFrame:
    """For each language of held-out texts (lang, mean, size): center, far, near and z of its limit, and their number.

    The variance of a text's mean loss about the center is far + near / size, by least squares;
    z is the quantile of the distance from the center in such standard deviations.
    """
    square, share = F.pow(F.col("mean") - F.col("center"), 2), 1 / F.col("size")
    center = good.groupBy("lang").agg((F.sum(F.col("mean") * F.col("size")) / F.sum("size")).alias("center"))
    rows = good.join(center, "lang")
    slope, level = F.regr_slope(square, share), F.regr_intercept(square, share)
    fit = rows.groupBy("lang", "center").agg(slope.alias("slope"), level.alias("level"), F.avg(square).alias("square"), F.avg(share).alias("share"), F.count("*").alias("number"))
    flat, steep = F.col("slope").isNull() | (F.col("slope") <= 0), F.col("level") <= 0
    fit = fit.select(
        "lang", "center", "number",
        F.greatest(F.when(flat, F.col("square")).when(steep, F.lit(0.0)).otherwise(F.col("level")), F.lit(1e-12)).alias("far"),
        F.when(flat, F.lit(0.0)).when(steep, F.col("square") / F.col("share")).otherwise(F.col("slope")).alias("near"),
    )
    fit = fit.filter(F.col("number") >= least)
    rows = good.join(fit, "lang")
    z = (F.col("mean") - F.col("center")) / F.sqrt(F.col("far") + F.col("near") / F.col("size"))
    return rows.groupBy("lang", "center", "far", "near").agg(F.percentile_approx(z, F.lit(quantile), F.lit(10_000)).alias("z"))


class Judge:
    """A model of all trusted texts, and the limits that texts held out from training set.

    The trusted texts are dealt into two folds by document; each fold is scored by a model
    of the other.  A language's limit for a text of n characters is center + z * sqrt(far +
    near / n), see _spread.
    """

    def __init__(self, docs: DataFrame, trusted: DataFrame, quantile: float = 0.995, least: int = 30):
        own = trusted_rows(pick(docs, doc_id="long", text="string", lang="string"), trusted).filter(F.length("text") > 0)
        own = materialize(own.select("lang", "text", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2).alias("fold")))
        self.model = train(own.select("text"))
        folds = [own.filter(F.col("fold") == k) for k in (0, 1)]
        if all(f.take(1) for f in folds):
            held = [score(folds[k].select("lang", "text"), train(folds[1 - k].select("text"))) for k in (0, 1)]
            held = held[0].unionByName(held[1])
        else:
            held = score(own.select("lang", "text"), self.model)
        good = materialize(held.select("lang", "size", (F.col("loss") / F.col("size")).alias("mean")))
        by_lang = materialize(_spread(good.filter("lang is not null"), quantile, least))
        self.by_lang = F.broadcast(by_lang) if by_lang.count() <= BROADCAST_LANGS else by_lang
        self.overall = _spread(good.withColumn("lang", F.lit("")), quantile, 1).first()

    def limited(self, scored: DataFrame) -> DataFrame:
        """scored (lang, size, ...) with the limit of each row."""
        if self.overall is None:
            return scored.withColumn("limit", F.lit(float("inf")))
        rows = scored.join(self.by_lang, "lang", "left")
        center, far, near, z = (F.coalesce(c, F.lit(self.overall[c])) for c in ("center", "far", "near", "z"))
        return rows.select(*scored.columns, (center + z * F.sqrt(far + near / F.greatest("size", F.lit(1)))).alias("limit"))


def _mean() -> Column:
    return F.when(F.col("size") > 0, F.col("loss") / F.col("size")).otherwise(F.lit(0.0))


def judge(docs: DataFrame, trusted: DataFrame, **settings: float) -> DataFrame:
    """doc_id, lang, size, perplexity, threshold, rejected: one row for each row of docs.

    docs: doc_id, text, lang; trusted: the doc_ids of texts to train on, of which the
    texts are in docs.  A threshold is `quantile` of what trusted documents of the language
    reach that the model wasn't trained on, in standard deviations for the length of the
    text (see Judge).  A language of fewer than `least` trusted documents, and a null one, has
    the threshold of all.  A null or empty text has perplexity 1 and is kept, as is everything if nothing is
    trusted.  Repeated rows are judged alike.  Other columns are ignored; an empty table
    gives an empty result.
    """
    by = Judge(docs, trusted, **settings)
    scored = by.limited(score(pick(docs, doc_id="long", lang="string", text="string"), by.model))
    limit = F.col("limit")
    return scored.select("doc_id", "lang", "size", F.exp(_mean()).alias("perplexity"), F.exp(limit).alias("threshold"), (_mean() > limit).alias("rejected"))


def keep(docs: DataFrame, trusted: DataFrame, **settings: float) -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns."""
    by = Judge(docs, trusted, **settings)
    text = docs.columns.index("text")
    names = [f"c{i}" for i in range(len(docs.columns))]
    lang = F.col(names[docs.columns.index("lang")]).cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    # The text comes last and goes through the model once.
    own = docs.toDF(*names).select(*(n for n in names if n != names[text]), lang.alias("lang"), F.col(names[text]).cast("string").alias(names[text]))
    scored = by.limited(score(own, by.model, keep=True)).filter(_mean() <= F.col("limit"))
    return scored.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
