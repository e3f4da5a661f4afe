"""Structure-aware chunks: sections by headings, packed greedily up to a number of tokens, paragraphs where a section is too large."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as C
from ..functions.batches import pieces

CHUNK = "array<struct<index:int,content:string,tokens:int,start_offset:int,end_offset:int>>"
_FENCE, _INLINE = re.compile(r"```.*?```", re.S), re.compile(r"`[^`]+`")
_SPACE = "".join(re.findall(r".", "\t\n\v\f\r                  　﻿", re.S))


def _python(pattern: str) -> str:
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), pattern)


_CJK, _WORD = re.compile(_python(C.CJK)), re.compile("[^" + _python(C.JS_SPACE)[1:-1] + "]+")
#: Where Python's white space and ECMAScript's differ.
_ODD = "\x1c\x1d\x1e\x1f\x85\ufeff"
_units = lambda s: len(s) if s.isascii() else len(s.encode("utf-16-le", "surrogatepass")) // 2


def _words(s: str) -> int:
    return len(_WORD.findall(s)) if any(c in s for c in _ODD) else len(s.split())


def tokens(s: str) -> int:
    """As functions.text.token_estimate; what a text doesn't hold isn't looked for by patterns."""
    if not s:
        return 0
    code, cjk = [], 0
    if "`" in s:
        code = _FENCE.findall(s)
        s = _FENCE.sub(" CODE_BLOCK ", s)
        code += _INLINE.findall(s)
        s = _INLINE.sub(" INLINE_CODE ", s)
    if not s.isascii():
        s, cjk = _CJK.subn(" ", s)
    return max(1, sum(math.ceil(_units(x) / 3.5) for x in code) + math.ceil(cjk * 1.5) + math.ceil(_words(s) * 1.33))


def sections(md: Column) -> Column:
    """The text cut before every line that starts with one to six # and white space; blank sections go."""
    parts = F.split(md, r"(?<=\A|[\n\r\x{2028}\x{2029}])(?=#{1,6}" + C.JS_SPACE + ")", -1)
    return F.filter(parts, lambda x: F.rlike(x, F.lit("[^" + C.JS_SPACE[1:-1] + "]")))


def _tail(s: str, overlap: int) -> str:
    """The last words of a chunk; a trailing blank counts as a word."""
    n = math.ceil(overlap / 1.33)
    words = re.split(f"[{re.escape(_SPACE)}]+", s)
    return " ".join(words[-n:]) if n else ""


def pack_sections(parts: list[str], whole: str, limit: int, overlap: int = 0) -> list[dict]:
    if not whole:
        return []
    if (n := tokens(whole)) <= limit:
        return [{"index": 0, "content": whole, "tokens": n, "start_offset": 0, "end_offset": _units(whole)}]
    out: list[dict] = []
    at = 0

    def emit(content: str, n: int) -> None:
        nonlocal at
        out.append({"index": len(out), "content": content, "tokens": n, "start_offset": at, "end_offset": at + _units(content)})
        at += _units(content)

    held, held_n = "", 0
    for s in parts:
        n = tokens(s)
        if n > limit:
            if held:
                emit(held, held_n)
                held, held_n = "", 0
            para, para_n = "", 0
            for p in re.split(r"\n\n+", s):
                k = tokens(p)
                if para and para_n + k > limit:
                    emit(para, para_n)
                    para, para_n = "", 0
                para, para_n = f"{para}\n\n{p}" if para else p, para_n + k
            if para:
                emit(para, para_n)
        elif held and held_n + n > limit:
            emit(held, held_n)
            head = _tail(held, overlap) if overlap > 0 else ""
            held = f"{head}\n\n{s}" if overlap > 0 else s
            held_n = tokens(head) + n if overlap > 0 else n
        else:
            held, held_n = f"{held}\n\n{s}" if held else s, held_n + n
    if held:
        emit(held, held_n)
    return out


def chunk(df: DataFrame, limit: int, overlap: int = 0, md: str = "markdown") -> DataFrame:
    """df with chunks (CHUNK). Sections are split natively; the packing is a fold, done in Arrow batches."""
    d = df.withColumn("_parts", sections(F.coalesce(F.col(md), F.lit(""))))
    kept = [f for f in df.schema.fields]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("index", pa.int32()), ("content", pa.string()), ("tokens", pa.int32()), ("start_offset", pa.int32()), ("end_offset", pa.int32())]))
        for b in pieces(batches):
            rows = [pack_sections(p.as_py() or [], m.as_py() or "", limit, overlap) for p, m in zip(b.column("_parts"), b.column(md), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(rows, kind)], [*(f.name for f in kept), "chunks"])

    return d.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", chunks {CHUNK}")
