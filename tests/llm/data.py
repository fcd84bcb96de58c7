"""Small documents with everything that can go wrong in a text, and plain checks."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: The same with extra columns whose names the operators use themselves.
CLASHING = T.StructType([*SCHEMA.fields, *(T.StructField(n, T.StringType()) for n in ("row", "key", "n", "size", "set_id", "unit", "begin", "loss", "copies", "token", "_key", "_all", "_scored", "c0", "c5", "k1", "base", "others", "limit", "rank"))])
SYLLABLES = {"en": "the and ing tion er on th sh ly re ble of".split(), "fr": "éle eau oir ment que ré la è euxs pas".split(), "de": "sch ung ein über keit ge ß ver tz lich".split()}


def words(rng, lang, n):
    return ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n)]


def rows(seed=0, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        out.append((i, " ".join(words(rng, lang, rng.randint(1, 120))) + rng.choice(["", ".\nA new line", "  two  spaces ", " mail me: bob.x@mail.example.com or +1 (555) 555-0199"]), lang, f"s{i % 4}" if i % 7 else "s0", 0))
    passage = " ".join(words(rng, "en", 60))
    for i in range(n, n + 12):  # a passage that many share
        out.append((i, " ".join([*words(rng, "en", 20), passage, *words(rng, "en", 20)]), "en", "s1", 0))
    base = words(rng, "de", 100)
    for i in range(n + 12, n + 30):  # near and exact copies
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = "edited"
        out.append((i, " ".join(w), "de", "s0", 0))
    i = n + 30
    odd = [None, "", "   ", "\n\n", "a", "one two", "x" * 3000, "\x00\t\x1c\x85 ok", "日本語 テキスト 🎉🎉", "▁ ▁▁ a▁b", "<s> </s> <|endoftext|> x", "1.2.3.4.5 300.1.1.1 4111 1111 1111 1111 +1-2", "9 " * 400, "IT'S don't 'll É é ﬁ"]
    for t in odd:
        out.append((i, t, None if i % 2 else "en", None if i % 3 else "s2", None))
        i += 1
    out.append((i, " ".join(words(rng, "fr", 9000)), "fr", "s3", 0))  # very long
    out += [out[3], out[3], out[n + 12]]  # repeated rows
    out += [(None, "a row without an id and with some words in it", "en", "s1", None), (None, None, None, None, None)]
    return out


def frame(spark, seed=0, n=60, clashing=False, only=None):
    data = rows(seed, n) if only is None else only
    if clashing:
        return spark.createDataFrame([(*r, *["clash"] * (len(CLASHING) - len(SCHEMA))) for r in data], CLASHING)
    return spark.createDataFrame(data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
