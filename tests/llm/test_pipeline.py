"""The stages of corpus_pipeline against brute force."""

import random

import corpus_pipeline as c
from weftlake.llm import minhash, simhash

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(texts):
    """The smallest place reachable from each over equal sets or five-word Jaccard similarity of 0.8 or more."""
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [find(i) for i in range(len(texts))]


def near_copies(seed=4, n=12):
    """Texts of 60 to 200 words, each with copies of which 1 to 6 words are changed, and chains of changes."""
    r, out = random.Random(seed), []
    for _ in range(n):
        words = [f"w{r.randrange(500)}" for _ in range(r.randrange(60, 200))]
        out.append(" ".join(words))
        for k in range(6):
            copy = words[:]
            for _ in range(k + 1):
                copy[r.randrange(len(copy))] = f"x{r.randrange(500)}"
            out.append(" ".join(copy))
            words = copy if k % 3 == 2 else words
    return [*out, out[0], out[8].upper(), None, "", " \n", "one two", "One  two", "a b c d e", "a b c d e f"]


def test_near_dedup(spark):
    texts = near_copies()
    want = groups(texts)
    assert len(set(want)) < len({shingle_set(t) for t in texts}) - 20
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOC)
    assert sorted(r["doc_id"] for r in c.near_dedup(spark, d, "").collect()) == sorted(set(want))
    for block in (1, 3):
        got = {r["doc_id"]: r["near_group"] for r in simhash.near_groups(d, block=block).collect()}
        assert len(set(got.values())) == len(set(zip(got.values(), (want[i] for i in got)))) == len(set(want))
    assert c.near_dedup(spark, d.limit(0), "").count() == 0


def test_near_groups_of_chains_and_crowded_keys(spark, monkeypatch):
    """Texts that keys chain together without a link, and templates that crowd keys: groups are brute force's, and what is compared follows the keys, not their chain."""
    r = random.Random(11)
    words = [f"w{r.randrange(10**6)}" for _ in range(5000)]
    chain = [" ".join(words[k * 24 : k * 24 + 200]) for k in range(150)]  # neighbours at 0.78, below the bound: linked to nobody
    tight = [" ".join(words[4000 + k * 12 : 4000 + k * 12 + 200]) for k in range(60)]  # at 0.88: one group, its ends far apart
    head = [f"h{i}" for i in range(110)]
    forms = [" ".join(head + [f"f{r.randrange(10**6)}" for _ in range(60)]) for _ in range(60)]  # one template, no two near
    forms += [f + " more" for f in forms[:20]]
    texts = chain + tight + forms
    want = groups(texts)
    compared = []
    plain = simhash.table

    def counted(df, tag, *rest):
        if tag == "linked-in-keys":
            compared.append(df._jdf.queryExecution())
        return plain(df, tag, *rest)

    monkeypatch.setattr(simhash, "table", counted)
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOC)
    for block in (4, 256):
        got = {x["doc_id"]: x["near_group"] for x in simhash.near_groups(d, block=block).collect()}
        assert len(set(got.values())) == len(set(zip(got.values(), (want[i] for i in got)))) == len(set(want))
    assert len(compared) == 2
    assert len({want[i] for i in range(150)}) == 150 and len({want[i] for i in range(150, 210)}) == 1


def test_near_in_ranges(monkeypatch):
    sets = [minhash.shingles(t) for t in near_copies(n=3) if t and t.strip()]
    want = minhash.near(sets).tolist()
    brute = [[len({*a.tolist()} & {*b.tolist()}) >= 0.8 * len({*a.tolist()} | {*b.tolist()}) for b in sets] for a in sets]
    monkeypatch.setattr(minhash, "RANGE", 100)
    assert minhash.near(sets).tolist() == want == brute


def test_near_dedup_keeps_one_row_a_group(spark):
    """Null ids and repeated ids: rows are kept or not by their own group."""
    texts = near_copies(seed=6, n=4)
    ids = [None if i % 3 == 0 else i // 4 for i in range(len(texts))] + [None, 900, 900]
    texts += ["a clean text that only a row without an id has", "the first text of a repeated id", "the second text, unlike the first, of a repeated id"]
    want = groups(texts)
    least = {}
    for i, g in enumerate(want):
        least[g] = min(least.get(g, (True, 0)), (ids[i] is None, ids[i] or 0))
    d = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in zip(ids, texts)], DOC)
    got = [(r["doc_id"], r["text"]) for r in c.near_dedup(spark, d, "").collect()]
    assert len(got) == len(set(want)) and set(got) <= set(zip(ids, texts))
    group_of = dict(zip(texts, want))
    assert {group_of[t]: (k is None, k or 0) for k, t in got} == least
    assert {(None, texts[-3]), (900, texts[-2]), (900, texts[-1])} <= set(got)


def test_near_groups_of_clashing_names(spark):
    """Columns with the operator's own names, null and empty texts, an empty table."""
    text = " ".join(f"w{k}" for k in range(60))
    d = spark.createDataFrame([(1, text, 5, 6), (2, text + " more", 7, 8), (3, None, 9, 9), (4, "", 9, 9), (5, "alone", 9, 9)], "node long, text string, r long, row long")
    out = {x["node"]: x["near_group"] for x in simhash.near_groups(d).collect()}
    assert out[1] == out[2] != out[5] and out[3] == out[4] and len(set(out.values())) == 3
    assert simhash.near_groups(d).columns == ["node", "text", "r", "row", "near_group"] and simhash.near_groups(d.limit(0)).count() == 0


def test_components_of_edges_that_turn(spark):
    """Edges whose ends change places each time they are worked out: still one component."""
    from weftlake.llm.common import components

    def turned(batches):
        import random

        for b in batches:
            b = b.copy()
            turn = [random.random() < 0.5 for _ in range(len(b))]
            b.loc[turn, ["a", "b"]] = b.loc[turn, ["b", "a"]].to_numpy()
            yield b

    edges = spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long").mapInPandas(turned, "a long, b long")
    assert {r["component"] for r in components(edges).collect()} == {0}
