import bisect
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tessera.llm import langid, media, mixing, ngram_join, packing, pii, repeats, token_counts
from tests.llm import data

WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def got(df):
    return [r.asDict() for r in df.collect()]


def by_row(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_token_counts_equal_the_library(spark):
    docs = data.frame(spark, clashing=True)
    model = token_counts.piece_model(PIECES)
    expected = Counter((d, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 100) for d, t, *_ in data.rows())
    for head in (1 << 17, 3):  # also with nearly all of it in the tail
        assert by_row(token_counts.count_tokens(docs, PIECES, 100, head), "doc_id", "n_bytes", "n_tokens", "over_limit") == expected
    assert got(token_counts.count_tokens(data.empty(spark), PIECES)) == []


def check_packing(rows, texts, capacity):
    tok = packing.tokenizer(WORD_BPE)
    pieces = Counter()
    for d, t, *_ in texts:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            pieces[d, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == pieces
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= capacity
    return len(held)


def test_packing_round_trip(spark):
    rows = data.rows()
    for capacity in (64, 4096):
        found = got(packing.pack(data.frame(spark, clashing=True), WORD_BPE, capacity))
        used = check_packing(found, rows, capacity)
        assert used <= 1.1 * sum(r["length"] for r in found) / capacity + 1
    assert got(packing.pack(data.empty(spark), WORD_BPE)) == []


def best_fit(sizes, capacity):
    """Sequential best fit, largest first: the number of sequences."""
    gaps = []
    for size in sorted(sizes, reverse=True):
        at = bisect.bisect_left(gaps, size)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        if gap > size:
            bisect.insort(gaps, gap - size)
        else:
            best_fit.full += 1
    return len(gaps) + best_fit.full


def test_common_chunks_stay_remembered(monkeypatch):
    monkeypatch.setattr(packing, "CHUNKS", 100)
    split, parts = Counter(), packing.Ids._parts
    monkeypatch.setattr(packing.Ids, "_parts", staticmethod(lambda chunk: split.update([chunk]) or parts(chunk)))
    ids, tok = packing.Ids(WORD_BPE), packing.tokenizer(WORD_BPE)
    for i in range(20):
        text = "\u00fcber, Where. it's \u0436\u0438 a;b " + " ".join(f"w{i}x{j}\u00e9," for j in range(60)) + " \u00fcber, end!" + "z" * 70 + "."
        assert ids.of(text) == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert split["\u00fcber,"] == 1


def test_sweep_equals_sequential_best_fit():
    rng = np.random.default_rng(7)
    for turn in range(120):
        capacity = int(rng.choice([8, 64, 100, 4096]))
        kind = turn % 4
        n = int(rng.integers(1, 600))
        sizes = rng.integers(1, capacity + 1, n) if kind == 0 else rng.integers(1, max(2, capacity // 3), n) if kind == 1 else np.minimum(capacity, 1 + rng.geometric(8 / capacity, n)) if kind == 2 else rng.choice(rng.integers(1, capacity + 1, 4), n)
        counts = Counter(int(x) for x in sizes)
        runs = packing.sweep(dict(counts), capacity)
        used, placed = Counter(), Counter()
        for size, rank, per, first, offset in runs:
            number = min([r[1] for r in runs if r[0] == size and r[1] > rank] + [counts[size]]) - rank
            for k in range(number):
                placed[size] += 1
                used[first + k // per] += size
        best_fit.full = 0
        assert placed == counts and max(used.values()) <= capacity
        assert len(used) == best_fit(sizes.tolist(), capacity)


def test_media_round_trip(spark):
    rows = got(media.digest(media.media_columns(data.frame(spark, clashing=True))))
    expected = Counter()
    for d, t, *_ in data.rows():
        payload = media.padded((t or "").encode())
        assert media.from_wav(media.to_wav(payload)) == payload and len(payload) % 64 == 0 and payload
        expected[d, len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), hashlib.sha256(media.to_wav(payload)).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_sha256"]) for r in rows) == expected
    assert len({r["feature"] for r in rows if r["doc_id"] == 3}) == 1
    assert got(media.media_columns(data.empty(spark))) == []


def test_media_peaks_find_a_tone():
    t = np.arange(8000)
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * t / 8000)).astype(np.uint8).tobytes()
    assert set(media.peaks(tone)[1:-1, 2].tolist()) <= {63, 64, 65}
    times, codes = media.fingerprints(tone)
    assert len(times) and (np.diff(times) >= 0).all() and len(codes) == len(times)


def test_language_held_out_accuracy(spark):
    docs = data.frame(spark, n=200)
    rows = got(langid.identify(docs, per_language=50, landmarks=40))
    lang = {d: g for d, t, g, *_ in data.rows(n=200) if g and langid.has_letter(t)}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in lang]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.9 * len(held) > 0
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
    for d, t, *_ in data.rows(n=200):
        if not langid.has_letter(t):
            assert {r["lang_pred"] for r in rows if r["doc_id"] == d} >= {"und"}
    assert got(langid.identify(data.empty(spark))) == []


def test_mixing_reaches_targets(spark):
    rows = got(mixing.mix(data.frame(spark, n=400, clashing=True)))
    assert len(rows) == len(data.rows(n=400))
    total = sum(r["size"] for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r["source_size"], r["target"]].append(r)
    assert sum(t for _, t in by) == pytest.approx(total)
    for (size, target), rs in by.items():
        assert target <= 3 * size + 1e-6
        taken = sum(r["taken"] for r in rs)
        assert abs(taken - target) <= max(r["size"] for r in rs)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in rs)
    docs = data.frame(spark, n=50)
    again = by_row(mixing.mix(docs), "doc_id", "taken")
    assert again == by_row(mixing.mix(docs), "doc_id", "taken")
    assert mixing.take(docs).count() == sum(r["copies"] for r in got(mixing.mix(docs)))
    assert got(mixing.mix(data.empty(spark))) == []


def components_of(rows):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(table))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[top(i)].append(r[0])
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return Counter((r[0], len(s), least[top(i)] if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("seed", [0, 1])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = data.rows(seed)
    # A chain of texts that are alike only from one to the next, and a group of near copies.
    chain = [f"w{i}" for i in range(140)]
    rows += [(1000 - k, " ".join(chain[4 * k : 4 * k + 100]), "en", "s", 0) for k in range(10)]
    docs = data.frame(spark, only=rows, clashing=True)
    assert by_row(ngram_join.near_duplicates(docs), "doc_id", "n_shingles", "component_id") == components_of(rows)


def test_words_are_hashed_side_by_side(monkeypatch):
    words = ["", "a", "A", "a\0", "\0", "\x0e", "\x85", "\ud800", "\u0130", "ab" * 4, "Ab" * 4 + "c", "d" * 63, "d" * 64, "d" * 65, "d" * 3000]
    spaces = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\r\n "]
    texts = [None, "", " ", *("".join(words[(i * k) % len(words)] + spaces[(i + k) % len(spaces)] for k in range(i % 40)) for i in range(300))]
    found = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    one_by_one, hashed = [], ngram_join.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(ngram_join.xxhash, "xxh3_64_intdigest", lambda w: one_by_one.append(w) or hashed(w))
    h, ends = ngram_join.word_hashes(texts)
    assert set(one_by_one) == {b"d" * 65, b"d" * 3000}
    assert ends.tolist() == np.cumsum([len(f) for f in found]).tolist()
    flat = [w for f in found for w in f]
    assert len(h) == len(flat) and len(set(zip(h.tolist(), flat, strict=True))) == len(set(h.tolist())) == len(set(flat))
    for f, t, s in zip(found, texts, ngram_join.batch_shingles(texts, 5), strict=True):
        assert s.tolist() == ngram_join.shingles(t, 5).tolist()
        assert len(s) == len({tuple(f[i : i + 5]) for i in range(max(1, len(f) - 4))} if f else ())


def test_near_duplicates_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LOADS", 3)
    monkeypatch.setattr(ngram_join, "PARTS", 4)
    loaded, sets = [], ngram_join._sets
    monkeypatch.setattr(ngram_join, "_sets", lambda shared, width, part, parts: loaded.append((part, parts)) or sets(shared, width, part, parts))
    rows = data.rows(3)
    docs = data.frame(spark, only=rows, clashing=True)
    assert by_row(ngram_join.near_duplicates(docs), "doc_id", "n_shingles", "component_id") == components_of(rows)
    assert loaded == [(0, 3), (1, 3), (2, 3)]

    class Shared:
        value = b"\xff" * 64

    batch = pa.record_batch([pa.array([r[1] for r in rows])], names=["text"])
    found = [[i for out in sets(Shared, 5, k, 3)([batch]) for i in out.column(0).to_pylist()] for k in range(3)]
    whole = [i for out in sets(Shared, 5)([batch]) for i in out.column(0).to_pylist()]
    assert all(found) and sorted(sum(found, [])) == sorted(whole)


def test_near_duplicates_keep_one(spark):
    rows = data.rows()
    kept = ngram_join.keep_one(data.frame(spark, clashing=True))
    assert kept.columns == data.frame(spark, clashing=True).columns
    ids = Counter(r.doc_id for r in kept.collect())
    expected = Counter(d for (d, n, c), k in components_of(rows).items() for _ in range(k if not n else 1) if not n or d == c)
    assert ids - Counter([None] * ids[None]) == expected - Counter([None] * expected[None])
    assert got(ngram_join.near_duplicates(data.empty(spark))) == [] == got(ngram_join.keep_one(data.empty(spark)))


def cut_by_hand(rows, length=50):
    first = {}
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    for d, b in texts:
        for i in range(len(b) - length + 1 if d is not None else 0):
            s = b[i : i + length]
            first[s] = min(first.get(s, d), d)
    out = Counter()
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1 if d is not None else 0):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot,strings", [(500_000, 0), (2, 1000_000), (2, 0)])
def test_repeats_equal_brute_force(spark, hot, strings, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "BROADCAST_STRINGS", strings)
    rows = data.rows(2) + [(2000, "ab" * 400, "en", "s", 0), (2001, "z" + "ab" * 60, "en", "s", 0), (2002, "q" * 49, "en", "s", 0), (2003, "q" * 49, "en", "s", 0)]
    docs = data.frame(spark, only=rows, clashing=True)
    assert by_row(repeats.cut_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == cut_by_hand(rows)
    assert got(repeats.cut_repeats(data.empty(spark))) == []


def test_repeats_in_passes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repeats, "FEW", 300)
    monkeypatch.setattr(repeats, "TEXT", 1 << 20)
    planned, plan = [], repeats._plan
    monkeypatch.setattr(repeats, "_plan", lambda *of: planned.append(plan(*of)) or planned[-1])
    rows = data.rows(2) + [(2000, "ab" * 400, "en", "s", 0), (2001, "z" + "ab" * 60, "en", "s", 0)]
    docs = data.frame(spark, only=rows, clashing=True)
    assert by_row(repeats.cut_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == cut_by_hand(rows)
    assert planned[0][1] > 2


def test_repeats_take_one_python_worker_a_task(spark):
    rows = data.rows(2)
    plan = repeats.cut_repeats(data.frame(spark, only=rows))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 3
    above = []  # (depth, whether a function in Python is in its stage, itself included) of the nodes over a line
    for line in plan.splitlines():
        depth = len(re.match(r"[\s:+-]*", line)[0])
        above = [x for x in above if x[0] < depth]
        python, met = bool(re.search("InArrow|EvalPython", line)), bool(above) and above[-1][1]
        assert not (python and met), plan
        above.append((depth, (python or met) and "Exchange" not in line))


def test_repeats_write_few_files(spark, monkeypatch, tmp_path):
    # However many tasks read the documents: a file starts processes that count with the memory of their JVM.
    monkeypatch.setattr(repeats, "HOT", 2)
    files, materialize = [], repeats.materialize

    def counted(df):
        out = materialize(df)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(repeats, "materialize", counted)
    rows = data.rows(2) + [(2000, "ab" * 400, "en", "s", 0), (2001, "z" + "ab" * 60, "en", "s", 0)]
    found = repeats.cut_repeats(data.frame(spark, only=rows).repartition(24))
    found.write.parquet(path := str(tmp_path / "found"))
    assert max(files) <= 4 and len(list((tmp_path / "found").glob("*.parquet"))) <= 4
    assert by_row(spark.read.parquet(path), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == cut_by_hand(rows)


def test_repeats_send_long_texts_in_small_batches(spark):
    docs = data.frame(spark, only=[(i, f"{i} " * 50_000, "en", "s", 0) for i in range(200)]).repartition(1)

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], names=["size"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        for own, least, most in ((None, 1 << 20, 5 << 20), ("1m", 0, 2 << 20)):  # what the caller has set stays
            spark.conf.unset(key)
            if own:
                spark.conf.set(key, own)
            repeats.cut_repeats(data.empty(spark))
            assert least <= max(r["size"] for r in docs.select("doc_id", "text").mapInArrow(sizes, "size long").collect()) <= most
    finally:
        spark.conf.unset(key)


def test_repeats_sum_grams_over_batches():
    text = bytes(np.random.default_rng(2).integers(97, 123, 500).astype(np.uint8)).decode()
    batches = [pa.record_batch([pa.array([d]), pa.array([text])], names=["doc_id", "text"]) for d in (5, 3, 9)]
    grams = len(set(repeats.cover(text.encode(), 50)[1].tolist()))
    for limit, times in ((1 << 20, 1), (1, 3)):
        out = pa.Table.from_batches(repeats._ranked(50, limit, 7)(batches))
        assert out.num_rows == grams * times and sum(out["n"].to_pylist()) == 3 * len(repeats.cover(text.encode(), 50)[0])
        assert {*zip(out["first"].to_pylist(), out["last"].to_pylist(), strict=True)} == ({(3, 9)} if times == 1 else {(5, 5), (3, 3), (9, 9)})
        assert max(len(c) for c in out["gram"].chunks) <= 7


def test_repeats_table_and_passes_grow_with_the_shared_grams():
    # 6 GB of the kind that the check tool has half a gigabyte of: 4.6 M shared grams, 18 M rows and 0.86 GB of text there.
    for times in (1, 12, 60, 1000):
        bits, passes = repeats._plan(4_633_554 * times, 18_025_162 * times, 863_738_755 * times)
        assert bits <= 1 << 29
        assert bits * passes >= 4 * 4_633_554 * times
        assert 18_025_162 / passes <= 863_738_755 / 36


def test_repeats_deal_each_string_once():
    data_ = np.random.default_rng(1).integers(97, 123, 20_000).astype(np.uint8).tobytes() + b"ab" * 100
    batch = pa.record_batch([pa.array([7]), pa.array([3]), pa.array([data_.decode()])], names=["key", "doc_id", "text"])

    class Shared:
        value = (b"\xff" * 64, np.zeros(0, np.uint64))

    at, h, _ = repeats.cover(data_, 50)
    grams, seen = dict(zip(at.tolist(), h.view(np.int64).tolist(), strict=True)), []
    for k in range(2):
        for out in repeats._around(Shared, 50, k, 2)([batch]):
            for gram, start, around in zip(*(out.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
                low, place = start >> 16, start & 0xFFFF
                assert data_[low : low + len(around)] == around
                assert grams[low + place] == gram and place <= 30
                seen += range(low, low + len(around) - 49)
    # Only strings with a tie, those of the tail, may come with several places of the gram.
    assert set(seen) == set(range(len(data_) - 49))
    assert len([s for s in seen if s < 19_950]) == 19_950


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def base_spans(text):
    return sorted((m.start(), list(PLAIN).index(k), m.end(), k) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if valid(k, m.group()))


def test_personal_data_equals_plain_patterns(spark):
    tricky = [
        "a@b.co@d.ef x@y.z_q@r.st", "a@b.com_x@d.ef", "..@-.- @@ a@b a@b.", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 99999999999999999999.1.1.1", "4111-1111 1111-1111 4111  1111",
        "5500005555555559 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "+1 (415) 555-2671 ext +44..20 7946 0958- +1+2345678901", "1" * 5000, "1 " * 5000, "a" * 20000 + "@" + "b" * 100 + ".c", "🎉 +1 415 555 2671 🎉 a@b.cd", "+" * 50 + "1" * 20,
    ]
    rows = data.rows() + [(3000 + i, t, "en", "s", 0) for i, t in enumerate(tricky)]
    expected = Counter()
    for d, t, *_ in rows:
        s = base_spans(t)
        text = ",".join(f"{k}:{a}:{e}" for a, _, e, k in s)
        expected[(d, *(sum(x[3] == k for x in s) for k in PLAIN), hashlib.sha256(text.encode()).hexdigest())] += 1
    found = pii.digest(pii.find(data.frame(spark, only=rows, clashing=True)))
    assert by_row(found, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == expected
    assert got(pii.digest(pii.find(data.empty(spark)))) == []


def graph_by_hand(texts, rounds, score, seeds):
    """The trusted contexts, from all spans and tokens of the texts."""
    edges = {}
    for t in texts:
        for m in re.finditer(r"[^\x20\x09-\x0D]+", t):
            w = m.group()
            if not re.search("[0-9@]", w):
                continue
            kind = {s[3] for s in base_spans(w)}
            before, after = t[: m.start()].split(), t[m.end() :].split()
            for context in ([f"l:{before[-1].lower()}"] if before else []) + ([f"r:{after[0].lower()}"] if after else []):
                edges[context, w] = max([*kind, edges.get((context, w)) or ""]) or None
    size = Counter(c for c, _ in edges)
    trusted = {}
    for _ in range(rounds):
        belief = defaultdict(lambda: 1.0)
        for (c, w), kind in edges.items():
            if kind is None and len(w) >= 6 and ("@" in w or sum(x.isdigit() for x in w) >= 4):
                for k, v in trusted.get(c, {}).items():
                    belief[w, k] *= max(1 - v, 1e-6)
        support = Counter()
        for (c, w), kind in edges.items():
            for k in PLAIN:
                support[c, k] += 1 if kind == k else 1 - belief[w, k] if kind is None and (w, k) in belief else 0
        trusted = {}
        for (c, k), v in support.items():
            if v >= seeds and v / size[c] >= score:
                trusted.setdefault(c, {})[k] = v / size[c]
    return {c: max((v, k) for k, v in ks.items())[1] for c, ks in trusted.items()}


def test_contexts_equal_a_graph_by_hand(spark):
    # Seeds teach "hotline"; what follows it teaches "extension", which has no seed.
    texts = [f"please call hotline +1415555{1000 + i} soon" for i in range(20)]
    texts += [f"please call hotline 0800-{7000 + i} soon" for i in range(4)] + [f"our extension 0800-{7000 + i} rings" for i in range(4)] + [f"an extension 0800-{7000} and extension 0800-{7001 + i} rings" for i in range(3)]
    texts += ["their hotline 0800-7009 here", "an extension 0800-7009 here", "extension 0900-5555 ends", "the year 1984-1985 was long", "a number 123456 stands alone"]
    texts += [f"some word {i}000000 x{i} other" for i in range(9)]
    rng = np.random.default_rng(5)
    for i in range(60):  # words between, so that no match runs from one number into the next
        texts.append(" ".join(f"{w} {n}" for w, n in zip(rng.choice(["hotline", "extension", "word", "at"], 5), rng.choice([f"0800-{7000 + i % 12}", f"+1415555{1000 + i}", "aside", f"{i}@x"], 5), strict=True)))
    docs = data.frame(spark, only=[(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    for rounds in (1, 2, 4):
        for score in (0.5, 0.8):
            spans, patterns, _ = pii._learn(docs, "text", rounds=rounds, score=score, seeds=3)
            assert {r.context: r.kind for r in patterns.collect()} == graph_by_hand(texts, rounds, score, 3)


def test_discovered_instances_induce_contexts(spark, monkeypatch):
    texts = [f"please call hotline +1415555{1000 + i} soon" for i in range(40)] + [f"please call hotline 0800-{7000 + i} soon" for i in range(6)]
    texts += [f"our extension 0800-{7000 + i} rings" for i in range(6)] + ["dear extension 0900-123456, goodbye"]
    docs = data.frame(spark, only=[(i, t, "en", "s", 0) for i, t in enumerate(texts)], clashing=True)
    for literals in (2000, 0):  # contexts as literals, and joined
        monkeypatch.setattr(pii, "LITERALS", literals)
        for rounds, last in ((1, ""), (2, "phone:15:26")):
            spans = {r["doc_id"]: r["spans"] for r in got(pii.digest(pii.find(docs, rounds=rounds)))}
            assert spans[40] == "phone:20:29" and spans[len(texts) - 1] == last
        masked = {r["doc_id"]: r["text"] for r in got(pii.mask(docs))}
        assert masked[len(texts) - 1] == "dear extension [PHONE], goodbye" and masked[0] == "please call hotline [PHONE] soon" and len(masked) == len(texts)


def test_masking_keeps_everything_else(spark):
    rows = data.rows() + [(500, "é+1 (415) 555-2671 1.2.3.4 a@b.cd 5500005555555559 tail", "en", "s", 0), (501, "x" * 5000 + " a@b.cd " + "é" * 5000 + " 1.2.3.4", None, None, None)]
    docs = data.frame(spark, only=rows, clashing=True)
    masked = pii.mask(docs)
    assert masked.columns == docs.columns
    found = by_row(masked, "doc_id", "text", "lang", "key")
    expected = Counter()
    for d, t, g, *_ in rows:
        out, at = "", 0
        for a, _, e, k in base_spans(t):
            if a >= at:
                out += t[at:a] + f"[{k.upper()}]"
            at = max(at, e)
        expected[d, None if t is None else out + t[at:], g, "clash"] += 1
    assert found == expected
    assert got(pii.mask(data.empty(spark))) == []


def test_many_matches_in_one_text(spark):
    import time

    text = " ".join(f"u{i}@mail.example.com" for i in range(40_000))
    docs = data.frame(spark, only=[(1, text, "en", "s", 0)])
    began = time.time()
    (row,) = got(pii.digest(pii.find(docs)))
    assert row["n_email"] == 40_000 and row["base_sha256"] == hashlib.sha256(",".join(f"email:{a}:{e}" for a, _, e, _ in base_spans(text)).encode()).hexdigest()
    assert time.time() - began < 60
