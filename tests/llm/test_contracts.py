"""The registered queries, called as the driver calls them, against brute force over whole small tables."""

import collections
import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

import corpus_pipeline as c
from weftlake.llm import packing, queries as Q

DATA = os.environ.get("WEFTLAKE_TESTDATA", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(None, None), (None, "a text of a row without an id, long enough to be read by some rule or other"), (7, "x"), (7, ""), (7, "x"), (10**9, "word " * 5000), (10**9 + 1, "é" * 4000 + "\n\n\n"), (10**9 + 2, " \t\n")]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """sf0.001's documents with odd rows and a column of a clashing name, its conversations and pages; (folder, documents' rows)."""
    at = tmp_path_factory.mktemp("tables")
    d = pq.read_table(f"{DATA}/documents.parquet")
    odd = pa.table({"doc_id": pa.array([i for i, _ in ODD], d.schema.field("doc_id").type), "text": pa.array([t for _, t in ODD], d.schema.field("text").type), "lang": pa.array(["en"] * len(ODD), d.schema.field("lang").type), "source": pa.array([None, "s", "s", "s", "s", "t", "t", None], d.schema.field("source").type), "n_chars": pa.array([0] * len(ODD), d.schema.field("n_chars").type)})
    d = pa.concat_tables([d, odd.select(d.column_names)])
    pq.write_table(d.append_column("target", pa.array(range(d.num_rows))), at / "documents.parquet")
    for name in ("conversations", "pages", "embeddings"):
        pq.write_table(pq.read_table(f"{DATA}/{name}.parquet"), at / f"{name}.parquet")
    return f"file://{at}", d.to_pylist()


def got(spark, name, at):
    return Q.queries()[name](spark, at).collect()


def kinds(spark, name, at):
    return dict(Q.queries()[name](spark, at).dtypes)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode("utf-8", "surrogatepass")).hexdigest()


def test_op1(spark, tables):
    at, docs = tables
    first = {}
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in docs]
    for i, b in texts:
        for q in range(len(b) - 49):
            if i is not None:
                s = b[q : q + 50]
                first[s] = min(i, first.get(s, i))
    want = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, int)
        for q in range(len(b) - 49):
            f = first.get(b[q : q + 50])
            if f is not None and (i is None or f < i):
                gone[q] += 1
                gone[q + 50 if q + 50 <= len(b) else len(b)] -= 1
        g = np.cumsum(gone)[: len(b)] > 0
        kept = np.frombuffer(b, "u1")[~g].tobytes()
        want.append((i, len(b), int(g.sum()), int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum()), sha(kept)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r)[:5] for r in got(spark, "op1_suffix_dedup", at)), key=key) == sorted(want, key=key)
    assert list(kinds(spark, "op1_suffix_dedup", at).items())[:5] == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]


def test_op2(spark, tables):
    at, docs = tables
    from tokenizers import Tokenizer

    import public_tokenizers as P

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in got(spark, "op2_best_fit_packing", at):
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    want = collections.defaultdict(collections.Counter)
    total = 0
    for r in docs:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        head = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r["doc_id"]][(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert {i: collections.Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in p) for i, p in pieces.items()} == want
    for b in bins.values():
        end = 0
        for o, n in sorted(b):
            assert o == end
            end += n
        assert end <= 1024
    lengths = sorted((n for b in bins.values() for _, n in b), reverse=True)
    gaps: list[int] = []
    for n in lengths:
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((1024 if fit is None else fit) - n)
    assert -(-total // 1024) <= len(bins) <= len(gaps) + 1


def measures(text):
    w = WORD.findall(text or "")
    win = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    n = collections.Counter(win)
    rep = {j for k, x in enumerate(win) if n[x] > 1 for j in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(rep), len(lines)


def judged(docs):
    """(measures, base_failed, soft_failed) of each, and the bad hosts, by the rules as they are stated."""
    rows = []
    for r in docs:
        m = measures(r["text"])
        base = m[0] < 20 or 100 * m[4] > 30 * m[0]
        rows.append((m, base, base or m[2] > 0.1 * m[0] or m[3] > 0.3 * m[5]))
    n, failed = collections.Counter(), collections.Counter()
    for r, x in zip(docs, rows):
        n[r["source"]] += 1
        failed[r["source"]] += x[2]
    w = {s: n[s] / (n[s] + 20) for s in n}
    rate = {s: failed[s] / n[s] for s in n}
    total = sum(w.values())
    mean = sum(w[s] * rate[s] for s in n) / total
    var = max(sum(w[s] * rate[s] ** 2 for s in n) / total - mean**2 - mean * (1 - mean) * sum(w[s] / n[s] for s in n) / total, 0)
    weight = max(min(mean * (1 - mean) / var - 1, 1e6), 1) if var > 0 else 1e6
    bad = set()
    for s in n:
        x = (failed[s] + mean * weight) / (n[s] + weight)
        low = max(x - 3 * (x * (1 - x) / (n[s] + weight + 1)) ** 0.5, 0)
        if low * (1 - mean) >= 3 * mean * (1 - low):
            bad.add(s)
    return rows, bad


def check_quality(rows, docs):
    want, bad = judged(docs)
    mine = sorted((repr(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in rows)
    assert mine == sorted((repr(d["doc_id"]), *m[:5], base, not base and not (soft and d["source"] in bad)) for d, (m, base, soft) in zip(docs, want))
    return bad


def test_op3(spark, tables):
    at, docs = tables
    check_quality(got(spark, "op3_quality_rules", at), docs)


def test_op3_bad_hosts(spark, tmp_path):
    """A host full of symbols loses its symbol-ridden documents, not its clean ones; the same document elsewhere stays; a host of one is not judged."""
    clean = " ".join(f"word{k}" for k in range(30))
    messy = " ".join(f"w{k} #" for k in range(30))
    docs = [{"doc_id": h * 1000 + k, "text": messy if k < (54 if h == 0 else 3) else f"{clean} {h} {k}", "source": f"h{h}"} for h in range(12) for k in range(60)]
    docs.append({"doc_id": -1, "text": messy, "source": "alone"})
    pq.write_table(pa.Table.from_pylist(docs), tmp_path / "documents.parquet")
    rows = got(spark, "op3_quality_rules", f"file://{tmp_path}")
    assert check_quality(rows, docs) == {"h0"}
    kept = {r["doc_id"]: r["kept"] for r in rows}
    assert not any(kept[k] for k in range(54)) and all(kept[k] for k in range(54, 60)) and all(kept[1000 + k] for k in range(60)) and kept[-1]


def base_spans(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16])


def test_op4(spark, tables):
    at, docs = tables
    want = collections.Counter()
    for d in docs:
        s = base_spans(d["text"])
        n = [sum(k == x for _, k, _ in s) for x in range(3)]
        want[(repr(d["doc_id"]), *n, sha(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in s)))] += 1
    rows = got(spark, "op4_secret_scan", at)
    assert collections.Counter((repr(r["doc_id"]), r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows) == want
    for r in rows:
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        order = [(int(a), ("assign", "access", "hex", "random").index(k)) for k, a, _ in spans]
        assert order == sorted(order) and sha(",".join(":".join(x) for x in spans if x[0] != "random")) == r["base_sha256"]


def test_op4_battery(spark, tmp_path):
    """Planted keys of several encodings, apart from any base pattern, are reported; words, names and dates are not."""
    import random

    r = random.Random(12)
    syllables = [a + b for a in "bdfgklmnprstv" for b in ("a", "e", "i", "o", "ou", "en", "er")]
    word = lambda n: "".join(r.choice(syllables) for _ in range(n))
    alphabets = {32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 62: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
    rows, keys, plain = [], {}, {}
    for i in range(600):
        text = " ".join([word(r.randrange(2, 9)) for _ in range(40)] + ["2024-02-12T10", f"{word(8)}2024", f"{word(4)}-{word(4)}-v2"])
        if i % 6 == 0:
            a = alphabets[(32, 62, 64)[i // 6 % 3]]
            while not re.search("[0-9]", key := "".join(r.choices(a, k=r.choice((24, 32, 40))))) or not re.search("[A-Za-z]", key):
                pass
            text = f"{text} is {key} and {word(3)}"
            keys[i] = (text.index(key), text.index(key) + len(key))
        else:
            plain[i] = text
        rows.append({"doc_id": i, "text": text})
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "documents.parquet")
    found = {x["doc_id"]: re.findall(r"random:(\d+):(\d+)", x["spans"]) for x in got(spark, "op4_secret_scan", f"file://{tmp_path}")}
    right = sum((str(a), str(b)) in found[i] for i, (a, b) in keys.items())
    wrong = sum(len(x) for x in found.values()) - right
    assert right >= 0.9 * len(keys) and wrong <= 0.1 * max(1, right + wrong)


def test_op5(spark, tables):
    at, _ = tables
    turns = collections.defaultdict(list)
    for r in pq.read_table(f"{at[7:]}/conversations.parquet").to_pylist():
        turns[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    said = "</s>[INST] ok [/INST]"
    turns[-7] = [(0, "user", said), (1, "assistant", said)]
    rows = {r["conv_id"]: r for r in got(spark, "op5_chat_format", at)}
    assert set(rows) == set(turns)
    for i, t in turns.items():
        t.sort()
        loss = "".join(x for _, role, x in t if role == "assistant")
        r = rows[i]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(t), sha("".join(f"{role}\n{x}\n" for _, role, x in t)), len(loss), sha(loss))
        assert r["formatted_chars"] >= sum(len(x) for *_, x in t)


def targets(docs):
    size = collections.Counter()
    for d in docs:
        size[d["source"]] += len(WORD.findall(d["text"] or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    out, open_, left = {}, set(names), float(sum(size.values()))
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            return size, out | share
        for s in over:
            out[s] = 3.0 * size[s]
            left -= out[s]
        open_ -= over
    return size, out


def check_mix(rows, docs):
    size, target = targets(docs)
    n = {repr(d["doc_id"]): len(WORD.findall(d["text"] or "")) for d in docs}
    taken = collections.Counter()
    source = {}
    for d in docs:
        source[repr(d["doc_id"]), len(WORD.findall(d["text"] or ""))] = d["source"]
    for r in rows:
        s = source[repr(r["doc_id"]), r["size"]]
        taken[s] += r["taken"]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 3 * r["size"]
    assert len(rows) == len(docs) and n
    for s in size:
        most = max((len(WORD.findall(d["text"] or "")) for d in docs if d["source"] == s), default=0)
        assert abs(taken[s] - target[s]) <= most


def test_op7(spark, tables):
    at, docs = tables
    rows = got(spark, "op7_mix_sources", at)
    check_mix(rows, docs)
    assert sorted(map(repr, rows)) == sorted(map(repr, got(spark, "op7_mix_sources", at)))


def test_op7_null_and_equal_ids(spark, tmp_path):
    """Without ids, and where whole rows repeat, each source still meets its target."""
    docs = [{"doc_id": None, "text": "five words in this row" if k % 2 else f"row {k} has its own text", "source": "ab"[k % 3 == 0]} for k in range(300)]
    pq.write_table(pa.Table.from_pylist(docs, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("source", pa.string())])), tmp_path / "documents.parquet")
    rows = got(spark, "op7_mix_sources", f"file://{tmp_path}")
    size, target = targets(docs)
    for s in size:
        assert abs(sum(r["taken"] for r in rows if r["source_size"] == size[s]) - target[s]) <= 10


def fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = np.array([xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42) for s in sh], "<u8")
    if not len(h):
        return 0
    return int(np.packbits(np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0) * 2 > len(h), bitorder="little").view("<u8")[0])


def test_op8(spark, tables):
    at, docs = tables
    fp = [fingerprint(d["text"]) for d in docs]
    label = list(range(len(docs)))
    x = np.array(fp, "u8")
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 2
    while True:
        new = [min(label[j] for j in np.nonzero(near[i])[0]) for i in range(len(docs))]
        if new == label:
            break
        label = new
    least = {}
    for d, k in zip(docs, label):
        if d["doc_id"] is not None:
            least[k] = min(d["doc_id"], least.get(k, d["doc_id"]))
    want = collections.Counter((d["doc_id"], format(f, "016x"), least.get(k)) for d, f, k in zip(docs, fp, label))
    assert collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got(spark, "op8_simhash", at)) == want


def test_op9(spark, tables):
    at, _ = tables
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    pages = {r["page_id"]: r["url"] for r in pq.read_table(f"{at[7:]}/pages.parquet").to_pylist()}
    for r in got(spark, "op9_url_filter", at):
        tail = (pages[r["page_id"]] or "").partition("://")[2]
        host = re.match("[^/?#]*", tail)[0].lower()
        path = re.match("[^?#]*", tail[len(host) :])[0]
        fit = max(((a + b, v) for a, b, v in rules if (host == a or host.endswith("." + a)) and path.startswith(b)), key=lambda x: len(x[0]), default=(None, "allow"))
        assert tuple(r) == (r["page_id"], host, path, *fit)


def test_op10(spark, tables):
    at, _ = tables
    rows = pq.read_table(f"{at[7:]}/embeddings.parquet").to_pylist()
    x = np.array([r["embedding"] for r in rows], "f8")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([-1 - k if r["label"] is None else r["label"] for k, r in enumerate(rows)])
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    out = {r["vec_id"]: r for r in got(spark, "op10_embedding_dedup", at)}
    assert [out[r["vec_id"]]["n_links"] for r in rows] == near.sum(axis=1).tolist()
    assert all(r["kept"] == (r["component_id"] == r["vec_id"]) for r in out.values())


def test_pipeline_stages(spark, tables):
    """Each stage's rows against brute force on the rows that it was given."""
    from test_llm import without_repeats
    from test_pipeline import groups

    at, docs = tables
    given = spark.read.parquet(f"{at}/documents.parquet")
    rows, bad = judged(docs)
    kept = [d for d, (_, base, soft) in zip(docs, rows) if not base and not (soft and d["source"] in bad)]
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    see = lambda df: sorted((tuple(r) for r in df.select("doc_id", "text", "source").collect()), key=key)
    quality = c.quality_rules(spark, given, at)
    assert quality.columns == list(c.COLUMNS) and see(quality) == sorted(((d["doc_id"], d["text"], d["source"]) for d in kept), key=key)
    # documents of one id with two texts, and those without, are ordered by hashes: the check keeps to the others
    line = c.line_dedup(spark, spark.createDataFrame([(d["doc_id"], d["text"], d["lang"], d["source"], d["n_chars"]) for d in kept if d["doc_id"] is not None], "doc_id long, text string, lang string, source string, n_chars long"), at)
    short = sorted((d["doc_id"], d["text"]) for d in kept if d["doc_id"] is not None)
    mine = sorted((r["doc_id"], r["text"]) for r in line.collect())
    assert [t for _, t in mine] == [x[0] for x in without_repeats(short, 2, 20)]
    assert line.columns == list(c.COLUMNS) and all(r["n_chars"] == len(r["text"]) for r in line.collect() if r["text"] != dict(short).get(r["doc_id"], r["text"]))
    near = c.near_dedup(spark, given.select(*c.COLUMNS), at)
    assert len(near.collect()) == len(set(groups([d["text"] for d in docs])))
    sizes = collections.Counter((d["doc_id"], d["text"], d["source"]) for d in docs)
    mixed = collections.Counter(tuple(r) for r in c.mix_sources(spark, given.select(*c.COLUMNS), at).select("doc_id", "text", "source").collect())
    assert all(n <= 3 * sizes[k] for k, n in mixed.items())
    size, target = targets(docs)
    for s in size:
        words = sum(n * len(WORD.findall(t or "")) for (_, t, x), n in mixed.items() if x == s)
        assert abs(words - target[s]) <= max(len(WORD.findall(d["text"] or "")) for d in docs if d["source"] == s)


def test_pipeline_run(spark, tables):
    at, _ = tables
    out = c.run(spark, at)
    rows = out.collect()
    assert out.columns[:2] == ["doc_id", "piece"] and len(rows) > 50
    bins = collections.defaultdict(int)
    for r in rows:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 1024 and packing.END_ID == 2


def test_op6(spark, tmp_path):
    from test_llm import line_rows, without_repeats

    rows = line_rows(11)
    pq.write_table(pa.table({"doc_id": [i for i, _ in rows], "text": pa.array([t for _, t in rows], pa.string())}), tmp_path / "documents.parquet")
    out = {r["doc_id"]: tuple(r)[1:] for r in got(spark, "op6_line_dedup", f"file://{tmp_path}")}
    assert [out[i] for i, _ in rows] == [(n, gone, runs, longest, sha(left or "")) for left, n, gone, runs, longest in without_repeats(rows, 2, 20)]
