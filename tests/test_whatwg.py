"""Urls by the URL standard: a table of cases, and that what is written reads back the same."""

import pytest

from weftlake.functions import whatwg as H
from weftlake.operators import page as P

BASE = "http://user:pw@h.org:8080/a/b/c?q=1#f"
CASES = [
    ("http://EXAMPLE.com", None, "http://example.com/"), ("HTTP://a.org:80/x", None, "http://a.org/x"), ("https://a.org:443", None, "https://a.org/"), ("https://a.org:80/", None, "https://a.org:80/"), ("http://a.org:/x", None, "http://a.org/x"),
    ("http://a.org:99999/", None, None), ("http://a.org:8x/", None, None), ("http:///a.org/x", None, "http://a.org/x"), ("http:\\\\a.org\\x\\..\\y", None, "http://a.org/y"), ("  http://a.org/a b\n?c d#e f ", None, "http://a.org/a%20b?c%20d#e%20f"),
    ("http://a.org/a/./b/../c/%2E%2e/d/.", None, "http://a.org/a/d/"), ("http://a.org/../../x", None, "http://a.org/x"), ("http://a.org/ü?ü='#ü`", None, "http://a.org/%C3%BC?%C3%BC=%27#%C3%BC%60"), ("http://a.org/%zz%41{}", None, "http://a.org/%zz%41%7B%7D"),
    ("http://bücher.example/", None, "http://xn--bcher-kva.example/"), ("http://a%41.org/", None, "http://aa.org/"), ("http://a b.org/", None, None), ("http://a<b/", None, None), ("http://", None, None), ("http://u@/x", None, None),
    ("http://0x7f.1/", None, "http://127.0.0.1/"), ("http://256/", None, "http://0.0.1.0/"), ("http://1.2.3.4.5/", None, None), ("http://1.2.3.256/", None, None), ("http://010.0.0.1/", None, "http://8.0.0.1/"), ("http://a.1b/", None, "http://a.1b/"),
    ("http://[1:0:0::0:1]/", None, "http://[1::1]/"), ("http://[::1", None, None), ("http://[g::]/", None, None), ("http://u:p:q@a.org/", None, "http://u:p%3Aq@a.org/"), ("http://a@b@c/", None, "http://a%40b@c/"),
    ("mailto:x y@z", None, "mailto:x y@z"), ("data:text/plain,#é", None, "data:text/plain,#%C3%A9"), ("foo://A.b/../x", None, "foo://A.b/x"), ("foo:/a/../b", None, "foo:/b"), ("javascript:alert(1)", None, "javascript:alert(1)"), ("file:///a/./b", None, "file:///a/b"), ("file://localhost/x", None, "file:///x"),
    ("", BASE, "http://user:pw@h.org:8080/a/b/c?q=1"), ("#z", BASE, "http://user:pw@h.org:8080/a/b/c?q=1#z"), ("?", BASE, "http://user:pw@h.org:8080/a/b/c?"), ("x", BASE, "http://user:pw@h.org:8080/a/b/x"), ("./../x/", BASE, "http://user:pw@h.org:8080/a/x/"), ("/x?y", BASE, "http://user:pw@h.org:8080/x?y"),
    ("//o.org", BASE, "http://o.org/"), ("\\\\o.org\\p", BASE, "http://o.org/p"), ("http:x", BASE, "http://user:pw@h.org:8080/a/b/x"), ("https:x", BASE, "https://x/"), ("..", BASE, "http://user:pw@h.org:8080/a/"), ("x", "mailto:a", None), ("#x", "mailto:a", "mailto:a#x"), ("x", None, None), ("1:2", BASE, "http://user:pw@h.org:8080/a/b/1:2"),
]


@pytest.mark.parametrize("text,base,want", CASES)
def test_case(text, base, want):
    got = H.parse(text, H.parse(base) if base else None)
    assert (got and got.href()) == want
    if got:
        assert H.parse(got.href()) == got or not text.startswith("http")


def test_in_spark(spark):
    d = spark.createDataFrame([(i, t, b) for i, (t, b, _) in enumerate(CASES)] + [(-1, None, BASE), (-2, "x", None)], "id int, url string, base string").repartition(3)
    got = {r["id"]: r["parsed"] and r["parsed"]["href"] for r in P.resolve(d, "url", "base").collect()}
    assert got == {i: w for i, (*_, w) in enumerate(CASES)} | {-1: None, -2: None}
