"""Personal data: patterns, and contexts learned from what they find.

Base spans are leftmost non-overlapping matches of four kinds.  They are the seeds.  What
precedes or follows a span, one word, is a lexical pattern (a context); tokens with a digit
or an @ that no base span touches are further instances.  Contexts and instances form a
bipartite graph that Spark scores in rounds.  An instance's belief in a kind is 1 for a
seed, else the noisy-or of the scores of its trusted contexts.  A context's support is the
sum of its distinct instances' beliefs, and its score that sum over their number; it is
trusted from `seeds` of support and a score of `score` on.  So discovered instances support
further contexts, which need no seed of their own.  Instances in trusted contexts are spans.

Everything is DataFrame expressions.  Regular expressions are possessive, or anchored
where a run begins, so that they take time linear in the text.  A row's matches are
computed once, in a projection of their own; positions are running sums, taken in blocks of
about the square root of the number of matches, as a fold that extends an array copies it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, pick

#: Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
# Each finds what its plain form finds.  A match of the plain form that starts inside a
# run of its first class could start where the run does, or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_WS = r"\x20\x09-\x0D"
#: A token with a digit or an @, tried once where a token begins.
CANDIDATE = rf"(?<![^{_WS}])[^{_WS}0-9@]*+[0-9@][^{_WS}]*+"
#: Contexts up to which they are literals of a projection, rows up to which a table is broadcast; beyond, both are joined.
LITERALS, BROADCAST = 2_000, 100_000
#: Characters of a segment of a text that is masked.
SEGMENT = 4096
_PLACE = "struct<at:int,rows:array<struct<begin:int,end:int>>>"


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""

    def digit(i: Column) -> Column:
        d = F.substring(digits, -i, 1) if isinstance(i, int) else digits.substr(F.length(digits) - i + 1, F.lit(1))
        d = d.cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + digit(i)) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(found, "[ -]", "")
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(found, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _blocks(rows: Column, work) -> Column:
    """The concatenation of work(block number, block) over blocks of rows, an attribute that is used twice and so not recomputed."""
    n = F.size(rows)
    size = F.greatest(F.lit(64), F.ceil(F.sqrt(n)).cast("int"))
    numbers = F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))
    blocks = F.transform(numbers, lambda k: F.slice(rows, k * size + 1, size))
    return F.when(n > 0, F.flatten(F.transform(blocks, lambda b, k: work(k, b))))


def _sum(rows: Column) -> Column:
    return F.aggregate(rows, F.lit(0), lambda total, p: total + p["gap"] + p["n"])


def _running(start: Column, rows: Column) -> Column:
    """begin and end of each of rows (gap, n), of which the first gap begins at start."""

    def step(state: Column, p: Column) -> Column:
        begin = state["at"] + p["gap"]
        row = F.struct(begin.alias("begin"), (begin + p["n"]).alias("end"))
        return F.struct((begin + p["n"]).alias("at"), F.concat(state["rows"], F.array(row)).alias("rows"))

    return F.aggregate(rows, F.struct(start.alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("rows")), step, lambda s: s["rows"])


def _hint(kind: str, text: Column) -> Column:
    """A cheap test that no text with a match fails."""
    return {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "tokens": text.rlike("[0-9@]")}.get(kind, text.rlike("[0-9]"))


#: The last word of what precedes a match, and the first of what follows it.
_LEFT = rf"(?:^|[{_WS}])([^{_WS}]++)[{_WS}]++$"
_RIGHT = rf"^[^{_WS}\p{{L}}\p{{N}}]*+[{_WS}]++([^{_WS}]++)"


def located(rows: DataFrame, text: str) -> DataFrame:
    """rows with base and others: spans, and candidates apart from them, each with the words around it.

    text: a column without nulls.
    """
    keep = rows.columns
    kinds = {**PATTERNS, "tokens": CANDIDATE}
    t, none = F.col(text), F.array().cast("array<string>")
    # One projection after another: what a later one uses inside a lambda has been computed.
    for name, made in {"found": F.regexp_extract_all, "gaps": F.split}.items():
        rest = (F.lit(0),) if name == "found" else (-1,)
        rows = rows.select("*", *(F.when(_hint(k, t), made(t, F.lit(p) if name == "found" else p, *rest)).otherwise(none).alias(f"{name}_{k}") for k, p in kinds.items()))
    rows = rows.select("*", *(F.zip_with(f"found_{k}", F.slice(f"gaps_{k}", 1, F.size(f"found_{k}")), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("n"))).alias(f"lengths_{k}") for k in kinds))
    rows = rows.select("*", *(_blocks(F.col(f"lengths_{k}"), lambda i, b: F.array(_sum(b))).alias(f"sums_{k}") for k in kinds))
    rows = rows.select("*", *(F.aggregate(f"sums_{k}", F.array(F.lit(0)), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s))).alias(f"starts_{k}") for k in kinds))
    rows = rows.select("*", *(F.coalesce(_blocks(F.col(f"lengths_{k}"), lambda i, b, k=k: _running(F.get(f"starts_{k}", i), b)), F.array().cast("array<struct<begin:int,end:int>>")).alias(f"places_{k}") for k in kinds))

    def matched(k: str) -> Column:
        found, gaps = F.col(f"found_{k}"), F.col(f"gaps_{k}")

        def row(p: Column, i: Column) -> Column:
            left, right = F.regexp_extract(F.get(gaps, i), _LEFT, 1), F.regexp_extract(F.get(gaps, i + 1), _RIGHT, 1)
            # Between two matches with nothing but space the other match is the word.
            left = F.when((left == "") & (F.trim(F.get(gaps, i)) == ""), F.get(found, i - 1)).otherwise(left)
            right = F.when((right == "") & (F.trim(F.get(gaps, i + 1)) == ""), F.get(found, i + 1)).otherwise(right)
            return F.struct(p["begin"].alias("begin"), p["end"].alias("end"), F.get(found, i).alias("found"), F.lower(left).alias("left"), F.lower(right).alias("right"))

        return F.transform(f"places_{k}", row)

    rows = rows.select(*(F.col(f"`{c}`") for c in keep), *(matched(k).alias(f"matches_{k}") for k in kinds))

    def named(kind: str, rank: int) -> Column:
        def row(m: Column) -> Column:
            return F.struct(m["begin"].alias("begin"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), F.lower(m["found"]).alias("found"), m["left"].alias("left"), m["right"].alias("right"))

        return F.transform(F.filter(f"matches_{kind}", lambda m: _valid(kind, m["found"])), row)

    edge = "'\"()[]{}<>.,;:!?"

    def bare(m: Column) -> Column:
        inner = F.ltrim(m["found"], F.lit(edge))
        begin = m["begin"] + F.length(m["found"]) - F.length(inner)
        inner = F.rtrim(inner, F.lit(edge))
        return F.struct(begin.alias("begin"), (begin + F.length(inner)).alias("end"), F.lower(inner).alias("found"), m["left"].alias("left"), m["right"].alias("right"))

    rows = rows.select(*(F.col(f"`{c}`") for c in keep), F.sort_array(F.concat(*(named(k, i) for i, k in enumerate(KINDS)))).alias("base"), F.filter(F.transform("matches_tokens", bare), lambda m: m["end"] > m["begin"]).alias("tokens"))
    base = F.col("base")

    def apart(_: Column, block: Column) -> Column:
        first, last = F.get(block, F.lit(0))["begin"], F.element_at(block, -1)["end"]
        near = F.filter(base, lambda b: (b["begin"] < last) & (b["end"] > first))
        # An array of one binds `near`, so that it is computed once for a block.
        return F.flatten(F.transform(F.array(near), lambda n: F.filter(block, lambda t: ~F.exists(n, lambda b: (b["begin"] < t["end"]) & (b["end"] > t["begin"])))))

    others = F.when(F.size("base") == 0, F.col("tokens")).otherwise(F.coalesce(_blocks(F.col("tokens"), apart), F.col("tokens")))
    return rows.select(*(F.col(f"`{c}`") for c in keep), "base", others.alias("others"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def _like(found: str | Column) -> Column:
    """Whether a token can be an identifier."""
    return (F.length(found) >= 6) & (F.contains(F.col(found) if isinstance(found, str) else found, F.lit("@")) | (F.length(F.regexp_replace(found, "[^0-9]", "")) >= 4))


def learned_patterns(spans: DataFrame, rounds: int = 3, score: float = 0.8, seeds: int = 5) -> DataFrame:
    """context, kind, score: the trusted contexts after so many rounds; contexts are l: or r: and the word before or after.

    A context trusted for several kinds has the best scored, ties going to the later name.
    """

    def edges_of(name: str, kind: Column) -> DataFrame:
        rows = spans.select(F.explode(name).alias("m")).select("m.*")
        sides = F.array(F.concat(F.lit("l:"), "left"), F.concat(F.lit("r:"), "right"))
        return rows.select(F.explode(sides).alias("context"), "found", kind.alias("kind")).filter(F.length("context") > 2)

    # Each edge once, however often it occurs; aggregated per task before it is shuffled.
    edges = edges_of("base", F.col("kind")).unionByName(edges_of("others", F.lit(None).cast("string")))
    edges = materialize(edges.groupBy("context", "found").agg(F.max("kind").alias("kind")))
    size = edges.groupBy("context").agg(F.count("*").alias("size"))
    sure = materialize(edges.filter("kind is not null").groupBy("context", "kind").agg(F.count("*").cast("double").alias("sure")))
    open_ = edges.filter("kind is null").filter(_like("found")).select("context", "found")

    def scored(support: DataFrame) -> DataFrame:
        enough = support.filter(F.col("support") >= seeds)
        return materialize(enough.join(size, "context").withColumn("score", F.col("support") / F.col("size")).filter(F.col("score") >= score).select("context", "kind", "score"))

    trusted = scored(sure.withColumnRenamed("sure", "support"))
    for _ in range(rounds - 1):
        doubt = F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-6))))
        known = materialize(open_.join(_small(trusted), "context").groupBy("found", "kind").agg((1 - F.exp(doubt)).alias("belief")))
        gained = open_.join(_small(known), "found").groupBy("context", "kind").agg(F.sum("belief").alias("gained"))
        support = sure.join(gained, ["context", "kind"], "full").select("context", "kind", (F.coalesce("sure", F.lit(0.0)) + F.coalesce("gained", F.lit(0.0))).alias("support"))
        trusted = scored(support)
    return trusted.groupBy("context").agg(F.max(F.struct("score", "kind")).alias("b")).select("context", "b.kind", "b.score")


_SPAN = "array<struct<begin:int,rank:int,end:int,kind:string>>"


def _slim(base: str) -> Column:
    return F.transform(base, lambda b: F.struct(b["begin"].alias("begin"), b["rank"].alias("rank"), b["end"].alias("end"), b["kind"].alias("kind")))


def _with_literals(rows: DataFrame, patterns: list) -> DataFrame:
    """rows (..., base, others) with base and all, by few contexts: sets of literals, hashed."""
    sides = {(side, k): [r.context[2:] for r in patterns if r.kind == k and r.context[0] == side] for side in "lr" for k in KINDS}
    kind = F.lit(None).cast("string")
    for side, k in reversed(list(sides)):  # the word before comes first
        words = sides[side, k]
        if words:
            name = "left" if side == "l" else "right"
            before = kind
            kind = lambda t, words=words, name=name, k=k, before=before: F.when(t[name].isin(words), F.lit(k)).otherwise(before(t) if callable(before) else before)
    keep = [F.col(f"`{c}`") for c in rows.columns if c not in ("base", "others")]
    if not callable(kind):
        return rows.select(*keep, _slim("base").alias("base"), _slim("base").alias("all"))
    rank = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    new = F.transform(F.filter("others", lambda t: _like(t["found"])), lambda t: F.struct(t["begin"].alias("begin"), t["end"].alias("end"), kind(t).alias("kind")))
    new = F.transform(F.filter(new, lambda t: t["kind"].isNotNull()), lambda t: F.struct(t["begin"].alias("begin"), F.element_at(rank, t["kind"]).alias("rank"), t["end"].alias("end"), t["kind"].alias("kind")))
    return rows.select(*keep, _slim("base").alias("base"), F.sort_array(F.concat(_slim("base"), new)).alias("all"))


def _with_join(rows: DataFrame, patterns: DataFrame, keys: list[str]) -> DataFrame:
    """The same by joining contexts, however many; equal keys have equal rows."""
    token = rows.select(*keys, F.explode("others").alias("m")).filter(_like("m.found")).select(*keys, "m.*").distinct()
    sides = token.select(*keys, "begin", "end", F.posexplode(F.array(F.concat(F.lit("l:"), "left"), F.concat(F.lit("r:"), "right"))).alias("side", "context"))
    rank = F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i))), F.col("kind"))
    told = sides.join(_small(patterns.select("context", "kind")), "context").withColumn("rank", rank)
    one = told.groupBy(*keys, "begin", "end").agg(F.min(F.struct("side", "rank", "kind")).alias("b"))
    new = one.groupBy(*keys).agg(F.collect_list(F.struct("begin", F.col("b.rank").alias("rank"), "end", F.col("b.kind").alias("kind"))).alias("new"))
    kept = [f"`{c}`" for c in rows.columns if c not in ("base", "others")]
    joined = rows.join(new, keys, "left")
    return joined.select(*kept, _slim("base").alias("base"), F.sort_array(F.concat(_slim("base"), F.coalesce("new", F.array().cast(_SPAN)))).alias("all"))


def _own(docs: DataFrame, column: str = "text") -> DataFrame:
    own = pick(docs, doc_id="long", **{column: "string"}).select("doc_id", F.coalesce(column, F.lit("")).alias("text"))
    return own.select(F.coalesce("doc_id", F.lit(0)).alias("k1"), F.xxhash64("doc_id", "text").alias("k2"), F.length("text").alias("k3"), "doc_id", "text")


def _learn(docs: DataFrame, column: str, **settings: float) -> tuple[DataFrame, DataFrame, list | None]:
    """Located spans without the text, the trusted contexts, and these as a list if they are few."""
    spans = materialize(located(_own(docs, column), "text").drop("text"))
    patterns = materialize(learned_patterns(spans, **settings))
    few = patterns.limit(LITERALS + 1).collect()
    return spans, patterns, few if len(few) <= LITERALS else None


def find(docs: DataFrame, rounds: int = 3, score: float = 0.8, seeds: int = 5) -> DataFrame:
    """doc_id, base, all: arrays of (begin, rank, end, kind), sorted; one row for each row of docs.

    Positions are code points, the end exclusive.  A null or empty text has no spans.
    Repeated rows have equal spans.  Other columns are ignored; an empty table gives an
    empty result.  A learned span has six characters at least, among them four digits or
    an @, and overlaps no base span; of two contexts the word before it tells its kind.
    """
    spans, patterns, few = _learn(docs, "text", rounds=rounds, score=score, seeds=seeds)
    told = _with_literals(spans, few) if few is not None else _with_join(spans, patterns, ["k1", "k2", "k3"])
    return told.select("doc_id", "base", "all")


def _text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, their digest, and all spans as text."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(_text("base").cast("binary"), 256).alias("base_sha256"), _text("all").alias("spans"))


def _merged(spans: str) -> Column:
    """Overlapping spans as one, of the first one's kind, in order: begin, end, kind.  In blocks, joined at their edges."""
    empty = F.array().cast("array<struct<begin:int,end:int,kind:string>>")

    def step(rows: Column, s: Column) -> Column:
        last = F.get(rows, F.size(rows) - 1)
        joined = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        new = F.struct(s["begin"].alias("begin"), s["end"].alias("end"), s["kind"].alias("kind"))
        return F.when((F.size(rows) > 0) & (s["begin"] < last["end"]), F.concat(F.slice(rows, 1, F.size(rows) - 1), F.array(joined))).otherwise(F.concat(rows, F.array(new)))

    return F.aggregate(spans, empty, step)


def mask(docs: DataFrame, column: str = "text", rounds: int = 3, score: float = 0.8, seeds: int = 5) -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets; overlapping spans are one, of the first one's kind.

    Null texts stay null, empty ones empty, and repeated rows are masked alike.  All columns
    stay, whatever their names; an empty table gives an empty result.  Few contexts mean one
    more scan and no shuffle of text; with many, texts are joined to their spans.
    """
    _, patterns, few = _learn(docs, column, rounds=rounds, score=score, seeds=seeds)
    id_ = F.col("`doc_id`").cast("long") if "doc_id" in docs.columns else F.lit(None).cast("long")
    text = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)), text.alias("text"), F.coalesce(id_, F.lit(0)).alias("k1"), F.xxhash64(id_, text).alias("k2"), F.length(text).alias("k3"))
    rows = located(rows, "text")
    told = _with_literals(rows, few) if few is not None else _with_join(rows, patterns, ["k1", "k2", "k3"])
    told = told.select(*names, "text", F.when(F.size("all") > 64, F.sort_array("all")).otherwise(F.col("all")).alias("all"))
    told = told.withColumn("merged", _merged("all"))
    # Pieces are cut from segments, as a piece of a long text is found from its beginning on.
    segments = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / SEGMENT).cast("int")), lambda k: F.substring(F.col("text"), k * SEGMENT + 1, F.lit(SEGMENT)))
    told = told.withColumn("segments", F.when(F.size("merged") > 0, segments))

    def piece(begin: Column, end: Column) -> Column:
        def part(k: Column) -> Column:
            low = F.greatest(begin - k * SEGMENT, F.lit(0))
            return F.substring(F.get("segments", k), low + 1, F.greatest(F.least(end - k * SEGMENT, F.lit(SEGMENT)) - low, F.lit(0)))

        return F.concat_ws("", F.transform(F.sequence(F.floor(begin / SEGMENT).cast("int"), F.floor(end / SEGMENT).cast("int")), part))

    def masked(s: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get("merged", i - 1)["end"]).otherwise(F.lit(0))
        return F.concat(piece(before, s["begin"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))

    tail = piece(F.element_at("merged", -1)["end"], F.length("text"))
    out = F.concat(F.concat_ws("", F.transform("merged", masked)), tail)
    place = names[docs.columns.index(column)]
    return told.select(*((F.when(F.size("merged") > 0, out).otherwise(F.col(n)) if n == place else F.col(n)).alias(c) for c, n in zip(docs.columns, names, strict=True)))
