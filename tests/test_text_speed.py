"""Text columns by Java's faster patterns, against plain Python on odd texts; how fast they are is measured, not tested."""

import random
import re

from pyspark.sql import functions as F

from weftlake.functions import constants as C, text as T
from weftlake.operators import chunk

SPACE = re.compile(chunk._python(C.JS_SPACE) + "+")
ALPHABET = [" ", "  ", "\n", "\t", " ", "　", "﻿", "\u0085", "\u001c", "a", "Zz", "é", "中", "あ", "Ａ", "\U0001f600", "`", "```", "~", "!", "20", "May 5, 2024", "3 days ago", "2024-01-02", "ſept", "mAR  1 2031", "[a](b)"]


def squeezed(s):
    return SPACE.sub(" ", s).strip(" ")


def test_odd_texts(spark):
    rng = random.Random(5)
    texts = ["", " ", "\n ", "a", " a", "a ", "x \u0085", "\u0085 x", "中", " 　 ", "a" * 20_000 + "é" * 20_000 + " ", "éa" * 20_000]
    texts += ["".join(rng.choices(ALPHABET, k=rng.randrange(1, 30))) for _ in range(3000)]
    c = F.col("s")
    d = spark.createDataFrame([(t,) for t in texts], "s string").repartition(4)
    rows = d.select("s", T.token_estimate(c).alias("tokens"), T.squeeze(c).alias("squeezed"), T.dated_strings(c).alias("dated"), T.first_date(c).alias("first")).collect()
    assert len(rows) == len(texts)
    dated, first = (re.compile(x, re.ASCII) for x in (C.DATED, C.FIRST_DATE))
    for r in rows:
        assert r["tokens"] == chunk.tokens(r["s"])
        assert r["squeezed"] == squeezed(r["s"])  # "x \u0085" lost its blank before: a pattern's $ stands before a last line end too
        if not re.search("[^\\x00-\\x7f]|\\x1c", r["s"]):
            assert r["dated"] == [m[0] for m in dated.finditer(r["s"])][:5]
            assert r["first"] == (m[0] if (m := first.search(r["s"])) else None)
    assert sum(r["first"] is not None for r in rows) > 500
