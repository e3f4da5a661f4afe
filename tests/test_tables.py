"""Table functions from SQL, on nulls, empties and arguments that follow from the row."""

from weftlake.functions import tables


def test_lateral(spark):
    tables.register(spark)
    spark.createDataFrame([(1, "# A\n\nx y\n\n# B\nz", 9), (2, None, 5), (3, "", 5), (4, "one two", None), (5, "# A\r\n# B\u2028# C", 1)], "id int, md string, n int").createOrReplaceTempView("weftlake_test_md")
    got = {}
    for r in spark.sql("SELECT id, c.* FROM weftlake_test_md, LATERAL page_chunks(md, n, null) c ORDER BY id, index").collect():
        got.setdefault(r["id"], []).append(r["content"])
    assert got == {1: ["# A\n\nx y\n\n", "# B\nz"], 4: ["one two"], 5: ["# A\r\n", "# B\u2028", "# C"]}
    html = "<a href='/x'>X</a><table><tr><th>h</th></tr><tr><td>1</td></tr><tr><td>2</td></tr></table><table><tr><td>3"
    spark.createDataFrame([(1, html, "https://a.org/p"), (2, None, None)], "id int, html string, url string").createOrReplaceTempView("weftlake_test_html")
    rows = spark.sql("SELECT t.* FROM weftlake_test_html, LATERAL page_tables(html) t ORDER BY 1, 2").collect()
    assert [tuple(r) for r in rows] == [(0, 0, ["h"], ["1"]), (0, 1, ["h"], ["2"]), (1, 0, [], ["3"])]
    assert [tuple(r) for r in spark.sql("SELECT l.* FROM weftlake_test_html, LATERAL page_links(html, url) l").collect()] == [("https://a.org/x", "X", None, True)]
    none = spark.sql("SELECT id, l.link FROM weftlake_test_html LEFT JOIN LATERAL page_links(html, url) l ON true ORDER BY id").collect()
    assert [(r["id"], r["link"]) for r in none] == [(1, "https://a.org/x"), (2, None)]
    xml = "<item><title>a</title><link>http://x/1</link></item><item><title></title><link>http://x/2</link></item><entry><title>b</title><link href='http://x/3'/><updated>d</updated></entry>"
    assert [tuple(r) for r in spark.sql(f"SELECT * FROM feed_entries(\"{xml}\", 5)").collect()] == [(0, "a", "http://x/1", None), (1, "b", "http://x/3", "d")]
    assert spark.sql(f"SELECT * FROM feed_entries(\"{xml}\", 1)").count() == 1 and spark.sql("SELECT * FROM feed_entries(null, null)").count() == 0


def test_plain_texts_need_no_patterns(monkeypatch):
    """Tokens of plain texts are counted without patterns; of odd texts as the patterns say. Sections are cut where lines begin with a heading."""
    import random
    import re

    from weftlake.functions import dom
    from weftlake.operators import chunk

    def slow(s):
        if not s:
            return 0
        code = chunk._FENCE.findall(s)
        s = chunk._FENCE.sub(" CODE_BLOCK ", s)
        code += chunk._INLINE.findall(s)
        s = chunk._INLINE.sub(" INLINE_CODE ", s)
        words = len(chunk._WORD.findall(chunk._CJK.sub(" ", s)))
        return max(1, sum(chunk.math.ceil(len(x.encode("utf-16-le")) / 2 / 3.5) for x in code) + chunk.math.ceil(len(chunk._CJK.findall(s)) * 1.5) + chunk.math.ceil(words * 1.33))

    heading = "(?:\\A|(?<=[\n\r  ]))(?=#{1,6}[" + dom.SPACE + "])"
    rng, parts = random.Random(7), ["a", "Zé", " ", "\n", "\r", " ", "#", "##", "######", "\t", "\x1c", "\x85", "﻿", "　", "中", "\U0001f600", "`", "```", "\n# "]
    for _ in range(20_000):
        s = "".join(rng.choices(parts, k=rng.randrange(12)))
        assert chunk.tokens(s) == slow(s)
        assert tables.sections(s) == [x for x in re.split(heading, s) if x.strip(dom.SPACE)]
    for name in ("_FENCE", "_INLINE", "_CJK", "_WORD"):
        monkeypatch.setattr(chunk, name, None)
    assert chunk.tokens("one two\n\nthree ") == 4
