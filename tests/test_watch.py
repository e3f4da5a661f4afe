"""The watchlist's automaton against the patterns and a plain matcher."""

import random
import re

from weftlake.operators import track as T, watch as W

ITEM = "title string, snippet string, url string, ord long"
WATCH = [("Alpha Corp", ["ALP", "a.c"]), ("$Beta", ["beta+"]), ("Émile", ["émile x"]), ("GPT-4", ["gpt"]), ("", []), ("alpha", [""]), ("a b", []), ("b", ["$"])]


def texts(n=400):
    rng = random.Random(4)
    bits = ["alpha", "Corp", " ", " ", "ALP", "a.c", "axc", "$beta", "beta+", "x", "_", "é", "Émile", "émile", "GPT-4", "gpt", "-", ".", "b", "$", "a", "4", "\n", "中"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(n)]


def rows(df):
    return sorted((r["ord"], r["entity"], r["url_key"]) for r in df.collect())


def test_same_rows_as_patterns(spark):
    t = texts()
    items = spark.createDataFrame([(None if i % 7 == 0 else a, None if i % 5 == 0 else b, f"http://h/{i}?q", i) for i, (a, b) in enumerate(zip(t, reversed(t), strict=True))], ITEM)
    want = rows(T.mentions(items, [w for w in WATCH if w[0]]))
    assert len(want) > 100 and want == rows(W.mentions(items, WATCH))
    assert want == rows(W.mentions(items, WATCH, most=5))  # several automata
    assert rows(W.mentions(items, WATCH[:2] + [("Alpha Corp", ["x"])])) == rows(W.mentions(items, [("Alpha Corp", ["ALP", "a.c", "x"]), WATCH[1]]))
    assert W.mentions(items, []).collect() == [] and W.mentions(items.limit(0), WATCH).collect() == []


def test_a_hundred_thousand_names(spark):
    """One pass over the texts, in a plan whose size doesn't follow the list; a sample of names against plain patterns."""
    rng = random.Random(9)
    syllables = ["an", "er", "is", "on", "al", "to", "mi", "ka", "re", "lo"]
    names = list({"".join(rng.choice(syllables) for _ in range(rng.randint(3, 8))) for _ in range(140_000)})[:100_000]
    assert len(names) == 100_000
    docs = [" ".join(rng.choice(names) if rng.random() < 0.3 else "".join(rng.choice(syllables) for _ in range(4)) for _ in range(60)) for _ in range(200)]
    items = spark.createDataFrame([(d, None, f"http://h/{i}", i) for i, d in enumerate(docs)], ITEM)
    found = T.mentions(items, [(n, []) for n in names])  # the tracker's own way, by the length of the list
    plan = found._jdf.queryExecution().toString()
    assert len(plan) < 20_000
    got = {(r["ord"], r["entity"]) for r in found.collect()}
    known = set(names)
    assert got == {(i, w) for i, d in enumerate(docs) for w in d.split() if w in known}
    for n in names[:50]:
        assert {i for i, d in enumerate(docs) if re.search(rf"\b{n}\b", d)} == {i for i, e in got if e == n}
