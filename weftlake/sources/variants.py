"""The JSON that pages embed, read as VARIANT: fields by paths and values by their key at any depth, without Python.

A value of another type than its field's is null, and so is everything of a page whose JSON doesn't parse.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import video as V
from .state import scratch

#: Levels of nesting below the root that are searched for keys.
MAX_DEPTH = 64


def embedded(html: Column, name: str) -> Column:
    """The object of `var <name> = {...};` up to the first `};`."""
    return F.try_parse_json(F.nullif(F.regexp_extract(html, rf"(?s)var {name}\s*=\s*(\{{.+?\}});", 1), F.lit("")))


def _path(path: str) -> str:
    return "$" + "".join(f"[{s}]" if s.isdigit() else f".{s}" for s in path.split(".") if s)


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, ...: what a variant holds."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def part(v: Column, path: str) -> Column:
    """The variant at a path of names and places (-1 from the end at its last but one step), else null."""
    before, back, after = re.match(r"(.*?)(?:\.(-\d+)(?:\.(.*))?)?$", path).groups()
    got = F.try_variant_get(v, _path(before), "variant")
    if back:
        got = F.try_element_at(F.try_variant_get(got, "$", "array<variant>"), F.lit(int(back)))
        got = F.try_variant_get(got, _path(after), "variant") if after else got
    return got


def string(v: Column, path: str) -> Column:
    got = part(v, path)
    return F.when(_kind(got) == "STRING", F.try_variant_get(got, "$", "string"))


def boolean(v: Column, path: str) -> Column:
    got = part(v, path)
    return F.when(_kind(got) == "BOOLEAN", F.try_variant_get(got, "$", "boolean"))


def scalar(v: Column, path: str) -> Column:
    """The text of a string, number or truth value."""
    got = part(v, path)
    return F.when(~_kind(got).isin("OBJECT", "ARRAY", "VOID"), F.try_variant_get(got, "$", "string"))


def whole(v: Column, path: str) -> Column:
    """The whole number that a string or number begins with, null past 64 bits."""
    got = part(v, path)
    digits = F.regexp_extract(F.try_variant_get(got, "$", "string"), r"^\s*([+-]?\d{1,19})(?!\d)", 1)
    return F.when(~_kind(got).isin("OBJECT", "ARRAY", "VOID", "BOOLEAN"), F.nullif(digits, F.lit("")).try_cast("long"))


def strings(v: Column, path: str) -> Column:
    """The strings of a list; an empty list where there is none."""
    each = F.filter(F.try_variant_get(v, _path(path), "array<variant>"), lambda x: _kind(x) == "STRING")
    return F.coalesce(F.transform(each, lambda x: F.try_variant_get(x, "$", "string")), F.array().cast("array<string>"))


def first(v: Column, paths: Sequence[str], default: str = "") -> Column:
    """The first of the paths that gives a text that isn't empty; a path may end in *text, the texts of a list's members joined."""
    def one(path: str) -> Column:
        if not path.endswith("*text"):
            return F.nullif(scalar(v, path), F.lit(""))
        each = F.try_variant_get(v, _path(path.removesuffix(".*text")), "array<variant>")
        return F.nullif(F.array_join(F.transform(each, lambda x: F.coalesce(scalar(x, "text"), F.lit(""))), ""), F.lit(""))

    return F.coalesce(*map(one, paths), F.lit(default))


def record(v: Column, table: dict[str, Sequence[str]]) -> Column:
    return F.struct(*[first(v, paths).alias(k) for k, paths in table.items()])


def under(df: DataFrame, key: str, value: str, names: Sequence[str], max_depth: int = MAX_DEPTH) -> DataFrame:
    """(key, name, at array<int>, value): every value that an object of df(key, value variant) has under one of the names, at any depth.

    at is the way to the object, so that rows sorted by it come in the order of lists, what holds before what is held. Level by level the
    containers are exploded and written, until none is left: work follows the JSON's size, plans don't grow with its depth.
    """
    spark = df.sparkSession
    at = scratch(spark, "variants")
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, at array<int>, value variant"
    level = df.select(key, F.array().cast("array<int>").alias("at"), F.col(value).alias("value")).where(F.col("value").isNotNull())
    found = f"`{key}` {kind}, name string, at array<int>, value variant"
    for depth in range(max_depth):
        inner = level.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).toDF("pos", "name", "inner"))
        inner = inner.select(key, "at", "pos", "name", F.col("inner").alias("value"))
        hits = inner.where(F.col("name").isin(*names)).select(key, "name", "at", "value")
        more = inner.where(_kind(F.col("value")).isin("OBJECT", "ARRAY")).select(key, F.concat("at", F.array("pos")).alias("at"), "value")
        hits.write.parquet(f"{at}/found/depth={depth}")
        more.write.parquet(f"{at}/level/depth={depth + 1}")
        level = spark.read.schema(schema).parquet(f"{at}/level/depth={depth + 1}")
        if level.isEmpty():
            break
    return spark.read.schema(found).parquet(f"{at}/found/depth=*")


def video_records(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, type, title, author, channel_id, views, duration, description, keywords, is_live, image, chapters, n_comments, comments, related) of pages with a player's data; others have no row.

    The same values as video_pages gives from Python's parser. key tells pages apart.
    """
    d = pages.select(key, embedded(F.col(html), "ytInitialPlayerResponse").alias("player"), embedded(F.col(html), "ytInitialData").alias("data"))
    v = part(F.col("player"), "videoDetails")
    d = d.withColumn("v", v).where((_kind(F.col("v")) == "OBJECT") & (F.to_json("v") != "{}"))
    v = F.col("v")
    own = d.select(
        key, F.lit("video").alias("type"), string(v, "title").alias("title"), string(v, "author").alias("author"), string(v, "channelId").alias("channel_id"), whole(v, "viewCount").alias("views"), whole(v, "lengthSeconds").alias("duration"),
        string(v, "shortDescription").alias("description"), strings(v, "keywords").alias("keywords"), boolean(v, "isLiveContent").alias("is_live"), string(v, "thumbnail.thumbnails.-1.url").alias("image"),
    )
    comment, chapter, related = "commentThreadRenderer", "chapterRenderer", "compactVideoRenderer"
    x = under(d, key, "data", (comment, chapter, related))
    body = part(F.col("value"), "comment.commentRenderer")
    millis = scalar(F.col("value"), "timeRangeStartMillis")
    time = F.when(_kind(part(F.col("value"), "timeRangeStartMillis")).isin("OBJECT", "ARRAY", "BOOLEAN"), F.lit(None)).otherwise(F.coalesce(F.nullif(millis, F.lit("")), F.lit("0")).try_cast("double") / 1000)
    c = F.struct(*[first(body, V.COMMENT[k], "0" if k == "likes" else "").alias(k) for k in V.COMMENT])
    x = x.select(
        key, "at", F.when((F.col("name") == comment) & (_kind(body) == "OBJECT"), c).alias("c"),
        F.when(F.col("name") == chapter, F.struct(first(F.col("value"), V.CHAPTER_TITLE).alias("title"), F.when(F.abs(time) < float("inf"), time).alias("time"))).alias("h"), F.when(F.col("name") == related, record(F.col("value"), V.RELATED)).alias("r"),
    )
    listed = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("at", name)))), lambda s: s[name])
    lists = x.groupBy(F.col(key).alias("_k")).agg(listed("h").alias("chapters"), listed("c").alias("c"), listed("r").alias("r"))  # of one page
    out = own.join(lists, F.col(key) == F.col("_k"), "left").drop("_k")
    none = lambda name: F.coalesce(F.col(name), F.array().cast(lists.schema[name].dataType))
    return out.select(*own.columns, none("chapters").alias("chapters"), F.size(none("c")).cast("long").alias("n_comments"), F.slice(none("c"), 1, V.MAX_COMMENTS).alias("comments"), F.slice(none("r"), 1, V.MAX_RELATED).alias("related"))
