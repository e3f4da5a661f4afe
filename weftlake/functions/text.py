"""Text columns: tokens, plain text, prose, dates, snippets, content hash. Native expressions but for the hash."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from . import constants as C


def squeeze(c: Column) -> Column:
    """White-space runs to one space, both ends trimmed."""
    # runs of one blank stay as they are
    return F.trim(F.regexp_replace(c, r"\x20" + C.JS_SPACE_FAST + r"++|[[^\x20]&&" + C.JS_SPACE_FAST + "]" + C.JS_SPACE_FAST + "*+", " "))


def _words(c: Column) -> Column:
    """How many words, by one pass that keeps a letter for each; a word goes before, so that none is led by white space."""
    return F.length(F.regexp_replace(F.concat(F.lit("w "), c), C.JS_WORD_FAST + C.JS_SPACE_FAST + "*+", "w")) - 1


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), with c worked out once however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def len16(c: Column) -> Column:
    """Length in UTF-16 units."""
    return F.length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def left16(c: Column, n: int) -> Column:
    """The first n UTF-16 units; half a surrogate pair at the end is left out."""
    astral = F.regexp_count(F.left(c, F.lit(n)), F.lit(r"[\x{10000}-\x{10FFFF}]"))
    units = F.decode(F.substring(F.encode(c, "UTF-16BE"), 1, 2 * n), "UTF-16BE")
    return F.when(astral == 0, F.left(c, F.lit(n))).otherwise(F.regexp_replace(units, "�$", ""))


def js_round(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


def plain_text(md: Column) -> Column:
    c = F.regexp_replace(md, r"(?s)```.*?```", "")
    return squeeze(F.regexp_replace(c, r"[#*_`\[\]()>|-]", ""))


def prose(md: Column) -> Column:
    return squeeze(F.regexp_replace(md, r"\[[^\]]*\]\([^)]*\)", ""))


def token_estimate(c: Column) -> Column:
    """Code at 3.5 UTF-16 units a token, CJK at 1.5 tokens a character, words at 1.33; at least 1, and 0 for the empty text."""
    fenced, inline = r"(?s)```.*?```", r"`[^`]+`"

    def rest(two: Column) -> Column:
        spaced = F.regexp_replace(two, C.CJK_FAST, " ")
        cjk = F.length(two) - F.length(F.regexp_replace(two, C.CJK_FAST, ""))
        return F.ceil(cjk * F.lit(1.5)) + F.ceil(_words(spaced) * F.lit(1.33))

    def unfenced(one: Column) -> Column:
        code = F.concat(F.regexp_extract_all(c, F.lit(fenced), F.lit(0)), F.regexp_extract_all(one, F.lit(inline), F.lit(0)))
        code_tokens = F.aggregate(code, F.lit(0.0), lambda a, x: a + F.ceil(len16(x) / F.lit(3.5)))
        return code_tokens + _once(F.regexp_replace(one, inline, " INLINE_CODE "), rest)

    whole = F.greatest(F.lit(1), _once(F.regexp_replace(c, fenced, " CODE_BLOCK "), unfenced))
    # without a backtick and such characters, as most texts are, only words count: one pass
    plain = F.greatest(F.lit(1), F.ceil(_words(c) * F.lit(1.33)))
    return F.when(c == "", F.lit(0)).when(~F.contains(c, F.lit("`")) & ~F.rlike(c, F.lit(C.CJK_FAST)), plain).otherwise(whole).cast("long")


def reduction(markdown_tokens: Column, html_tokens: Column) -> Column:
    return F.when(html_tokens > 0, js_round((1 - markdown_tokens / html_tokens) * 100)).otherwise(F.lit(0)).cast("long")


def dated_strings(md: Column) -> Column:
    return F.slice(F.regexp_extract_all(md, F.lit(C.DATED_FAST), F.lit(0)), 1, 5)


def first_date(md: Column) -> Column:
    return F.nullif(F.regexp_extract(md, C.FIRST_DATE_FAST, 0), F.lit(""))


def snippet(md: Column, n: int = 600) -> Column:
    return left16(prose(md), n)


def hash_input(c: Column) -> Column:
    return F.lower(squeeze(F.regexp_replace(c, "<[^>]+>", "")))


@F.pandas_udf(StringType())
def _hash(texts: pd.Series) -> pd.Series:
    """Eight hex digits, a thousand texts at a time, the longest first, so that those of one length stand together."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts.iat[i] or ""))
    out = [""] * len(texts)
    for at in range(0, len(order), 1024):
        some = order[at : at + 1024]
        for i, h in zip(some, _hashes([texts.iat[i] for i in some]), strict=True):
            out[i] = h
    return pd.Series(out, dtype=object).where(texts.notna().reset_index(drop=True), None)


def _hashes(texts: list[str | None]) -> list[str]:
    """The multiplication is in doubles, as results must show. All texts advance together."""
    import numpy as np

    units = [np.frombuffer((t or "").encode("utf-16-le", "surrogatepass"), "<u2") for t in texts]
    order = np.argsort([-len(u) for u in units], kind="stable")
    h = np.full(len(units), 0x811C9DC5, "i8")
    lengths = np.array([len(units[i]) for i in order], "i8")
    for lo in range(0, int(lengths.max(initial=0)), 1024):
        live = int((lengths > lo).sum())
        block = np.zeros((live, 1024), "i8")
        for k in range(live):
            part = units[order[k]][lo : lo + 1024]
            block[k, : len(part)] = part
        for j in range(min(1024, int(lengths[0]) - lo)):
            n = int((lengths[:live] > lo + j).sum()) if lengths[live - 1] <= lo + j else live
            signed = (h[:n] ^ block[:n, j]).astype("u4").view("i4").astype("f8")
            h[:n] = (signed * 16777619.0).astype("i8") & 0xFFFFFFFF
    out = [""] * len(units)
    for k, i in enumerate(order):
        out[i] = format(int(h[k]), "08x")
    return out


def content_hash(c: Column) -> Column:
    return _hash(hash_input(c))


def content_key(c: Column) -> Column:
    """What content_hash hashes, told apart by 256 bits: the identity that de-duplication goes by, as 32 bits meet by chance."""
    return F.sha2(hash_input(c), 256)
