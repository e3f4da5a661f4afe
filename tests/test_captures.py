"""Archived responses: redirects, statuses and what a filter on hosts leaves unread."""

import datetime as dt

from weftlake.sources import captures as C

T = [dt.datetime(2024, 1, k) for k in range(1, 5)]
ROWS = [
    ("https://a.org/x", T[0], 200, {"Content-Type": "text/html"}, "old"), ("https://a.org/x", T[1], 200, {}, "new"), ("https://a.org/x", T[3], 500, {}, "later"),
    ("https://a.org/m", T[0], 301, {"Location": "./x"}, ""), ("https://b.org/", T[0], 302, {"LOCATION": "//a.org/m"}, ""), ("https://b.org/404", T[0], 404, None, "gone"),
    ("https://b.org/c1", T[0], 307, {"location": "/c2"}, ""), ("https://b.org/c2", T[0], 308, {"location": "/c1"}, ""), ("https://b.org/bad", T[0], 302, {"location": "http://[x"}, ""),
    ("https://b.org/none", T[0], 301, {}, "no place"), ("https://b.org/lost", T[0], 301, {"location": "https://c.org/"}, ""), ("https://a.org/304", T[0], 304, {"location": "/x"}, "as it was"),
]


def test_fetch(spark, tmp_path):
    C.write(spark.createDataFrame(ROWS, C.SCHEMA), f"{tmp_path}/a", buckets=8)
    known = C.read(spark, f"{tmp_path}/a", buckets=8)
    asked = [r[0] for r in ROWS[2:]] + ["https://b.org/c1", "https://z.org/", None]
    d = spark.createDataFrame([(u, i) for i, u in enumerate(asked)], "url string, i int")
    got = {r["i"]: r for r in C.fetch(d, known, C.F.lit("2024-01-03").cast("timestamp"), 4).collect()}
    tell = {i: (r["status"], r["html"], r["final_url"], r["hops"], r["error"]) for i, r in got.items()}
    x = "https://a.org/x"
    assert tell == {
        0: (200, "new", x, 0, None), 1: (200, "new", x, 1, None), 2: (200, "new", x, 2, None), 3: (404, "gone", "https://b.org/404", 0, None),
        4: (None, None, "https://b.org/c1", 4, "redirects"), 5: (None, None, "https://b.org/c2", 4, "redirects"), 6: (None, None, "https://b.org/bad", 0, "location"), 7: (301, "no place", "https://b.org/none", 0, None),
        8: (None, None, "https://c.org/", 1, "missing"), 9: (304, "as it was", "https://a.org/304", 0, None), 10: (None, None, "https://b.org/c1", 4, "redirects"), 11: (None, None, "https://z.org/", 0, "missing"), 12: (None, None, None, 0, "missing"),
    }
    latest = C.fetch(d.where("i = 0"), known).first()
    assert (latest["status"], latest["headers"]) == (500, {}) and C.fetch(d.limit(0), known).count() == 0
    first = C.fetch(d.where("i = 0"), known, C.F.lit("2024-01-01").cast("timestamp")).first()
    assert first["headers"] == {"content-type": "text/html"}


def test_a_host_skips_folders(spark, tmp_path):
    rows = [(f"https://h{i}.org/{k}", T[0], 200, {}, f"{i}") for i in range(40) for k in range(3)]
    C.write(spark.createDataFrame(rows, C.SCHEMA), f"{tmp_path}/a", buckets=16)
    some = C.read(spark, f"{tmp_path}/a", ["h3.org", "h4.org"], buckets=16)
    assert sorted(r["url"] for r in some.collect()) == [f"https://h{i}.org/{k}" for i in (3, 4) for k in range(3)]
    files = some.inputFiles()
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters")[1][:120] and "In(host" in plan
    read = some._jdf.queryExecution().executedPlan()
    assert len(files) >= 2 and C.read(spark, f"{tmp_path}/a", [], buckets=16).count() == 0 and read is not None


def test_hops_carry_no_html(spark, tmp_path):
    """Neither the walk nor an answer without html reads the pages; captures alike in time and status are told by their html."""
    rows = [
        ("https://a.org/1", T[0], 302, {"location": "/3"}, "b"), ("https://a.org/1", T[0], 302, {"location": "/2"}, "a"), ("https://a.org/2", T[1], 200, {"k": "2"}, "z" * 50), ("https://a.org/2", T[1], 200, {"k": "1"}, "y" * 50),
        ("https://a.org/3", None, 200, {}, "no time"), ("https://a.org/3", T[0], 404, {}, None), ("https://a.org/3", T[0], 404, {"k": "n"}, "x"), ("https://a.org/4", T[0], 200, {}, "v"),
    ]
    d = spark.createDataFrame([(f"https://a.org/{i}", i) for i in (1, 2, 3, 4)], "url string, i int")
    known = spark.createDataFrame(rows, C.SCHEMA)
    out = C.fetch(d, known)
    got = {r["i"]: (r["status"], r["headers"], r["html"], r["final_url"], r["hops"]) for r in out.collect()}
    assert got == {1: (200, {"k": "1"}, "y" * 50, "https://a.org/2", 1), 2: (200, {"k": "1"}, "y" * 50, "https://a.org/2", 0), 3: (404, {}, None, "https://a.org/3", 0), 4: (200, {}, "v", "https://a.org/4", 0)}

    one = "url <> 'https://a.org/3' and not (status = 302 and html = 'b') and coalesce(headers['k'], '') <> '2'"
    known.where(one).write.parquet(f"{tmp_path}/c")
    single = spark.read.parquet(f"{tmp_path}/c")
    out = C.fetch(d, single).select("i", "status", "final_url")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "html" not in plan and sorted(out.collect()) == [(1, 200, "https://a.org/2"), (2, 200, "https://a.org/2"), (3, None, "https://a.org/3"), (4, 200, "https://a.org/4")]
