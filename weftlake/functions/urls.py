"""Keys and rewrites of urls as native columns (for absolute http urls; others stay as they are)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import constants as C


def item_key(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)[?#].*$", "")


def mention_key(c: Column) -> Column:
    return F.regexp_replace(item_key(c), "/+$", "")


def frontier_key(c: Column) -> Column:
    """Without the hash and trailing slashes; the query stays."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)#.*$", ""), "/+$", "")


def host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def domain(c: Column) -> Column:
    return F.regexp_replace(host(c), r"^www\.", "")


def search_key(c: Column) -> Column:
    """Lower-case host without www., no tracking parameters, no hash, one trailing slash less. Parameters keep their spelling."""
    bare = F.regexp_replace(c, r"(?s)#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_extract(bare, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?]*)", 1)
    query = F.regexp_extract(bare, r"(?s)\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_extract(p, "^[^=]*", 0).isin(*C.TRACKING))
    port = F.regexp_extract(bare, r"^[^/]*//[^/?#]*?(:[0-9]+)(?:[/?#]|$)", 1)
    whole = F.concat(scheme, F.lit("://"), domain(bare), port, F.when(rest == "", "/").otherwise(rest), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.regexp_replace(F.when(F.rlike(c, F.lit("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]")), whole).otherwise(c), "/$", "")


def unwrap_redirect(c: Column) -> Column:
    """A search engine's redirect (u=a1 and base64url) to the http url inside; anything else stays."""
    code = F.translate(F.regexp_extract(c, r"[?&]u=a1([^&#]*)", 1), "-_", "+/")
    padded = F.rpad(code, (F.ceil(F.length(code) / 4) * 4).cast("int"), F.lit("="))
    plain = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.when(F.contains(c, F.lit("bing.com/ck/a")) & F.startswith(plain, F.lit("http")), plain).otherwise(c)


def unwrap_parameter(c: Column, name: str = "uddg") -> Column:
    """A redirect's decoded parameter, decoded once more where that works; urls without it stay."""
    raw = F.regexp_extract(c, rf"[?&]{name}=([^&#]*)", 1)
    once = F.try_url_decode(raw)
    twice = F.try_url_decode(F.replace(once, F.lit("+"), F.lit("%2B")))
    return F.when(raw != "", F.coalesce(twice, once, c)).otherwise(c)


def raw_capture(c: Column) -> Column:
    """An archive's capture without its frame: id_ after the time stamp, the first one only."""
    return F.regexp_replace(c, r"^(.*?/web/[0-9]+)/", "$1id_/")


def file_name(c: Column) -> Column:
    """A url as the name of a markdown file: no scheme, other characters than letters and digits as _, at most 100, then .md."""
    return F.concat(F.left(F.regexp_replace(F.regexp_replace(c, "^(.*?)https?://", "$1"), "[^a-zA-Z0-9]", "_"), F.lit(100)), F.lit(".md"))


def video_id(c: Column) -> Column:
    """The id of a video url of the four hosts, empty where there is none; null for other urls."""
    path = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/?([^?#]*)", 1)
    param = F.regexp_extract(F.regexp_extract(c, r"\?([^#]*)", 1), r"(?:^|&)v=([^&]*)", 1)
    return F.when(host(c) == "youtu.be", path).when(host(c).isin(*C.VIDEO_HOSTS), F.coalesce(F.try_url_decode(param), param))


def glob_regex(pattern: str) -> str:
    """A glob over a whole url: * stays within a path segment, ** doesn't, ? is one character of a segment, {a,b} alternates."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 1
        elif ch in "*?":
            out += "[^/]*" if ch == "*" else "[^/]"
        elif ch == "{":
            out, depth = out + "(?:", depth + 1
        elif ch == "}" and depth:
            out, depth = out + ")", depth - 1
        elif ch == "," and depth:
            out += "|"
        else:
            out += "\\" + ch if ch in r"\.+^$()[]|{}" else ch
        i += 1
    return f"^(?:{out})$"
