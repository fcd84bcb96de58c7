import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tessera.llm import components, neighbours, quality
from tessera.llm.common import in_batches
from tests.llm import data
from tests.llm.test_text_operators import check_packing, got


def test_components(spark):
    rng = random.Random(4)
    names = [rng.getrandbits(60) for _ in range(300)]
    edges = [(names[i], names[i + 1]) for i in range(120)] + [(names[150], names[j]) for j in range(151, 200)] + [(names[200], names[200])]
    found = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({found[n] for n in names[:121]}) == 1 and len({found[n] for n in names[150:200]}) == 1
    assert len(set(found.values())) == 2
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_kneser_ney_sums_to_one(spark):
    texts = spark.createDataFrame([(t,) for _, t, *_ in data.rows() if t], "text string")
    model = quality.train(texts, 20)
    p = np.exp(model.log_probabilities().astype(np.float64)).reshape(-1, model.base).sum(1)
    assert p == pytest.approx(np.ones(len(p)), abs=1e-4)


def by_hand(texts, model, text):
    """Log probability of a text by recursion over counts."""
    table, base = quality.symbol_table(model.alphabet), model.base
    grams = {}
    for t in texts:
        s = [0] * 3 + quality.symbols(quality._points(t), table).tolist()
        for i in range(3, len(s)):
            g = tuple(s[i - 3 : i + 1])
            grams[g] = grams.get(g, 0) + 1
    levels = [grams]
    for _ in range(3):
        lower = {}
        for g in levels[0]:
            lower[g[1:]] = lower.get(g[1:], 0) + 1
        levels.insert(0, lower)

    def cuts(level):
        return quality.discounts(*(sum(c == k for c in level.values()) for k in (1, 2, 3, 4)))

    def p(g):
        if not g:
            return 1 / base
        level = levels[len(g) - 1]
        d = cuts(level)
        same = {x: c for x, c in level.items() if x[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        total, less = sum(same.values()), sum(d[min(c, 3) - 1] for c in same.values())
        c = same.get(g, 0)
        return (c - d[min(c, 3) - 1] if c else 0) / total + less / total * p(g[1:])

    s = [0] * 3 + quality.symbols(quality._points(text), table).tolist()
    return sum(np.log(p(tuple(s[i - 3 : i + 1]))) for i in range(3, len(s)))


def test_kneser_ney_equals_recursion(spark):
    texts = ["the cat sat on the mat.", "The dog sat ON it 12 times", "éa ñ\n x"]
    model = quality.train(spark.createDataFrame([(t,) for t in texts], "text string"), 12)
    logs, table = model.log_probabilities(), quality.symbol_table(model.alphabet)
    for text in ("the mat sat", "Zq! 7 dOG", "x"):
        assert logs[quality.ngram_codes(text, table, model.base)].sum() == pytest.approx(by_hand(texts, model, text), rel=1e-4)


def test_quality_rejects_junk_only(spark):
    rows = [(i, t, g, s, n) for i, (_, t, g, s, n) in enumerate(r for r in data.rows(n=300) if r[1] and r[2])]
    trusted = spark.createDataFrame([(i,) for i in range(0, len(rows), 2)], "doc_id long")
    junk = [(5000 + i, "QX%%% ZZ### " * 30 + str(i), "en", "s", 0) for i in range(5)]
    docs = data.frame(spark, only=rows + junk + [(6000, None, "en", None, None), (6001, "", None, None, None), (6002, "the and ing", "xx", "s", 0)], clashing=True)
    found = {r["doc_id"]: r for r in got(quality.judge(docs, trusted))}
    assert all(found[d]["rejected"] for d, *_ in junk)
    assert sum(found[d]["rejected"] for d, t, *_ in rows) <= 0.02 * len(rows)
    assert not found[6002]["rejected"]  # of a language that nothing is trusted of
    assert not found[6000]["rejected"] and found[6000]["perplexity"] == 1
    kept = quality.keep(docs, trusted)
    assert kept.columns == docs.columns and kept.count() == sum(not r["rejected"] for r in found.values())
    nothing = spark.createDataFrame([], "doc_id long")
    assert quality.keep(docs, nothing).count() == docs.count()
    assert got(quality.judge(data.empty(spark), trusted)) == []


def test_quality_tells_rare_scripts(spark):
    rng = random.Random(8)
    latin, russian = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéèêëàâäîïôöùûüçñßæœøå", k=rng.randint(2, 6))) for _ in range(80)], "это был день когда все люди вышли на улицу чтобы видеть солнце над рекой".split()
    docs = [(i, " ".join(rng.choices(latin, k=200)), "la", "s", 0) for i in range(200)] + [(200 + i, " ".join(rng.choices(russian, k=60)), "ru", "s", 0) for i in range(20)]
    junk = []
    for i in range(10):
        letters = [c for c in docs[200 + i][1] if c != " "]
        rng.shuffle(letters)
        left = iter(letters)
        junk.append((1000 + i, "".join(c if c == " " else next(left) for c in docs[200 + i][1]), "ru", "s", 0))
    shouted = [(2000, " ".join(rng.choices(latin, k=200)).upper(), "la", "s", 0)]
    trusted = spark.createDataFrame([(d[0],) for d in docs], "doc_id long")
    found = {r["doc_id"]: r["rejected"] for r in got(quality.judge(data.frame(spark, only=docs + junk + shouted), trusted))}
    assert all(found[d] for d, *_ in junk + shouted) and sum(found[d] for d, *_ in docs) <= 3


class ByHand:
    """Interpolated modified Kneser-Ney of order 4 over characters, by plain counting."""

    def __init__(self, texts):
        self.known = set("".join(texts))
        levels = [Counter(g for t in texts for g in self.grams(t))]
        for _ in range(3):
            levels.insert(0, Counter(g[1:] for g in levels[0]))
        self.levels = []
        for level in levels:
            n = [sum(c == k for c in level.values()) for k in (1, 2, 3, 4)]
            d = [0.5] * 3
            if n[0] and n[1]:
                y = n[0] / (n[0] + 2 * n[1])
                d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
                d = [min(max(x, 0.05), k - 0.05) for x, k in zip(d, (1, 2, 3))]
            sums = defaultdict(lambda: [0, 0.0])
            for g, c in level.items():
                sums[g[:-1]][0] += c
                sums[g[:-1]][1] += d[min(c, 3) - 1]
            self.levels.append((level, d, dict(sums)))

    def grams(self, text):
        s = ["start"] * 3 + [c if c in self.known else "other" for c in text]
        return [tuple(s[i - 3 : i + 1]) for i in range(3, len(s))]

    def loss(self, text):
        total = 0
        for g in self.grams(text):
            p = 1 / (2 + len(self.known))
            for k, (level, d, sums) in enumerate(self.levels):
                own = g[3 - k :]
                if own[:-1] in sums:
                    n, freed = sums[own[:-1]]
                    c = level.get(own, 0)
                    p = (c - d[min(c, 3) - 1] if c else 0) / n + freed / n * p
            total -= np.log(p)
        return total


def judged_by_hand(rows, trusted, quantile, least):
    good = [(d, t, g) for d, t, g, *_ in rows if d in trusted and t]
    folds = [[r for r in good if zlib.crc32(str(r[0]).encode()) % 2 == k] for k in (0, 1)]
    held = []
    for k in (0, 1):
        model = ByHand([t for _, t, _ in folds[1 - k]])
        held += [(g, len(t), model.loss(t) / len(t)) for _, t, g in folds[k]]

    def spread(of):
        n, mean = np.array([x[1] for x in of], float), np.array([x[2] for x in of])
        center = (n * mean).sum() / n.sum()
        square, share = (mean - center) ** 2, 1 / n
        far, near = square.mean(), 0.0
        if np.ptp(share):
            slope = ((share - share.mean()) * (square - square.mean())).sum() / ((share - share.mean()) ** 2).sum()
            level = square.mean() - slope * share.mean()
            if slope > 0:
                far, near = (level, slope) if level > 0 else (0, square.mean() / share.mean())
        far = max(far, 1e-12)
        z = np.sort((mean - center) / np.sqrt(far + near / n))
        return center, far, near, z[int(np.ceil(quantile * len(z))) - 1]

    limits = {g: spread(of) for g in {h[0] for h in held} if g is not None and len(of := [h for h in held if h[0] == g]) >= least}
    overall, model = spread(held), ByHand([t for _, t, _ in good])
    out = {}
    for d, t, g, *_ in rows:
        center, far, near, z = limits.get(g, overall)
        mean = model.loss(t) / len(t) if t else 0.0
        limit = center + z * np.sqrt(far + near / max(1, len(t or "")))
        out[d] = np.exp(mean), np.exp(limit), mean > limit
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_quality_equals_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(quality, "BROADCAST_LANGS", 0)
        monkeypatch.setattr(quality, "BROADCAST_GRAMS", 0)
    rng = random.Random(9)
    greek, kana = "αβγδεζηθικλμνξοπρστυφχψω", "あいうえおかきくけこさしすせそ"
    rows = [(i, r[1], r[2], "s", 0) for i, r in enumerate(data.rows(n=90))][:110]
    rows += [(200 + i, " ".join("".join(rng.choices(greek if i % 2 else kana, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 30))), "el" if i % 2 else "ja", "s", 0) for i in range(60)]
    rows += [(300, None, "en", "s", 0), (301, "", "el", "s", 0), (302, "ωω ΣΩ 𝔘𝔫 🎉", "xx", "s", 0), (303, "qqqq zzzz qqqq 1111", "en", "s", 0), (304, "αβγ the ing", None, "s", 0)]
    trusted = {r[0] for r in rows if r[0] % 3}
    found = quality.judge(data.frame(spark, only=rows), spark.createDataFrame([(d,) for d in trusted], "doc_id long"), quantile=0.9, least=12).collect()
    expected = judged_by_hand(rows, trusted, 0.9, 12)
    assert len(found) == len(rows) == len(expected)
    for r in found:
        perplexity, threshold, rejected = expected[r.doc_id]
        assert r.perplexity == pytest.approx(perplexity, rel=1e-8) and r.threshold == pytest.approx(threshold, rel=1e-6)
        assert r.rejected == rejected or perplexity == pytest.approx(threshold, rel=1e-6)
    assert 0 < sum(r.rejected for r in found) < len(rows)


def test_quality_joined_equals_broadcast(spark, monkeypatch):
    texts = [(i, r[1]) for i, r in enumerate(data.rows(n=40))] + [(900, "日本 ЖЩ unseen"), (901, None), (902, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = quality.train(docs.filter("doc_id % 2 = 0 and doc_id < 60 and text is not null").select("text"))
    one = sorted(tuple(r) for r in quality.score(docs, model).collect())
    monkeypatch.setattr(quality, "BROADCAST_GRAMS", 0)
    other = sorted(tuple(r) for r in quality.score(docs, model).collect())
    assert [(d, n) for d, _, n in one] == [(d, n) for d, _, n in other]
    assert [x for _, x, _ in one] == pytest.approx([x for _, x, _ in other], rel=1e-9)


def test_quality_memory_is_bounded_by_bytes_not_rows():
    texts = ["".join(random.Random(i).choices("abcdefgh ijklm\n", k=20_000)) for i in range(256)]
    batch = pa.record_batch([pa.array(texts + [None, ""])], names=["text"])
    parts = list(in_batches(iter([batch]), quality.TEXT))
    assert [t for p in parts for t in p.column(0).to_pylist()] == [*texts, None, ""]
    assert max(sum(len(t or "") for t in p.column(0).to_pylist()) for p in parts) < quality.TEXT + 20_000
    assert [p.num_rows for p in in_batches(iter([batch]), 1)][:3] == [1, 1, 1] and list(in_batches(iter([batch.slice(0, 0)]))) == []

    class Shared:
        value = sorted(set("abcdefgh ijklm\n")), quality.FIRST + 15

    found = Counter()
    tracemalloc.start()
    for out in quality._count(Shared)(iter([batch.slice(0, len(texts))])):
        for c, s, n in zip(*(x.to_pylist() for x in out.columns), strict=True):
            found[c, s] += n
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64 << 20 and sum(found.values()) == 256 * 20_000


def brute(ids, vectors, every, k):
    x = np.array(vectors)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = (x * x[i]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)).astype(np.float32).astype(float)
    x[100:400] = x[100]  # one very common vector
    rows = [(int(i), v.tolist(), "clash") for i, v in enumerate(x)]
    bad = [(9000, None, ""), (9020, [0.0] * 16, ""), (9040, [float("nan")] * 16, ""), (9060, [None] * 16, ""), (None, [1.0] * 16, ""), (9080, [1.0], ""), (9100, [float("inf")] * 16, "")]
    df = spark.createDataFrame(rows + bad + rows[:3], "vec_id long, embedding array<float>, score string")
    found = {}
    for r in neighbours.search(df, per_list=60, least=16).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    exact = brute(np.arange(3000), x, 20, 20)
    assert set(found) == set(exact)
    hits = 0
    for q, near in found.items():
        near.sort()
        assert [n for n, _, _ in near] == list(range(1, 21))
        assert all(s == pytest.approx((x[q] * x[v]).sum(), abs=1e-12) for _, v, s in near)
        assert [(-s, v) for _, v, s in near] == sorted((-s, v) for _, v, s in near) and q not in {v for _, v, _ in near}
        hits += len({v for _, v, _ in near} & {v for v, _ in exact[q]})
    assert hits >= 0.9 * 20 * len(exact)
    assert [v for _, v, _ in found[120]] == [v for v in range(100, 121) if v != 120]


def test_recall_with_many_lists(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(16_000, 32))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.search(df, every=160, per_list=8, sample=8_000).collect():  # 2,000 lists
        found.setdefault(r.query_id, set()).add(r.vec_id)
    exact = brute(np.arange(16_000), x, 160, 20)
    hits = sum(len(found[q] & {v for v, _ in near}) for q, near in exact.items())
    assert hits >= 0.9 * 20 * len(exact)


def test_neighbours_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (20, [2.0, 1.0]), (21, [0.0, -0.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.search(df).collect()) == [(0, 1, 20, 4.0), (20, 1, 0, 4.0)]
    assert neighbours.search(df.limit(0)).collect() == []


def test_pipeline_stages(spark, tmp_path):
    rows = data.rows(n=80)
    docs = data.frame(spark, only=rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 80, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        last = i == len(corpus_pipeline.STAGES) - 1
        assert last or out.columns == docs.columns, name
        if last:
            check_packing(got(out), [tuple(r) for r in at.collect()], 4096)
        else:
            out.write.parquet(f"{tmp_path}/{i}")
            at = spark.read.parquet(f"{tmp_path}/{i}")
            assert at.count(), name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


@pytest.mark.parametrize("kind", ["empty", "clashing"])
def test_pipeline_stages_with_odd_tables(spark, tmp_path, kind):
    docs = data.empty(spark) if kind == "empty" else data.frame(spark, n=40, clashing=True)
    spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns, name
            if kind == "clashing":
                assert out.count() and all(v == "clash" for r in out.select("_key", "_all", "c0", "base").distinct().collect() for v in r), name
        assert (out.count() == 0) == (kind == "empty"), name
        at = out
