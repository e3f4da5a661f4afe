"""Pages to columns: one parse a page, in Arrow batches; what follows is native."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dom, text as T
from ..functions.batches import pieces

#: What parse() can add, and its type. Only what is asked for is worked out.
FIELDS = {
    "meta": "struct<title:string,description:string,language:string,author:string,published_at:string,og_image:string,canonical:string,robots:string>",
    "links": "array<struct<url:string,text:string,rel:string,is_internal:boolean>>",
    "agent_links": "array<struct<href:string,text:string>>",
    "clean_html": "string",
    "markdown": "string",
    "json_ld": "array<string>",
    "tables": "array<struct<headers:array<string>,rows:array<array<string>>>>",
    "meta_tags": "map<string,string>",
    "css": "map<string,array<string>>",
    "captcha": "boolean",
    "parse_error": "string",
    "readable": "struct<ok:boolean,title:string,byline:string,excerpt:string,html:string,text:string,markdown:string>",
}
#: Elements that mark a challenge page.
CAPTCHA = 'iframe[src*="recaptcha"], iframe[src*="hcaptcha"], .g-recaptcha, #cf-challenge-stage'


def parse(pages: DataFrame, fields: Sequence[str] = ("meta", "links", "clean_html", "markdown"), css: Mapping[str, str] | None = None, url: str = "url", html: str = "html", keep_nav: bool = False, keep_footer: bool = False) -> DataFrame:
    """pages' columns without html, and the fields asked for. Null html counts as empty, and so does a page that can't be read (parse_error says why). Filter on urls before this call: no predicate passes it."""
    kept = [f for f in pages.schema.fields if f.name != html]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{f} {FIELDS[f]}" for f in fields])
    css = dict(css or {})
    for x in css.values():
        dom.compile_selector(x)  # one that isn't understood fails here, not on a worker

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from ..functions import readable

        def read(page: str, at: str) -> dict:
            row: dict = {}
            root = dom.parse(page)
            if "meta" in fields:
                row["meta"] = dom.metadata(root, at)
            if "links" in fields:
                row["links"] = [dict(zip(("url", "text", "rel", "is_internal"), x, strict=True)) for x in dom.links(root, at)]
            if "agent_links" in fields:
                row["agent_links"] = [dict(zip(("href", "text"), x, strict=True)) for x in dom.agent_links(root, at)]
            if "json_ld" in fields:
                row["json_ld"] = dom.json_ld(root)
            if "tables" in fields:
                row["tables"] = dom.tables(root)
            if "meta_tags" in fields:
                pairs = {(n.attrs.get("name") or n.attrs.get("property")): n.attrs.get("content") for n in root.walk() if n.tag == "meta"}
                row["meta_tags"] = [(k, v) for k, v in pairs.items() if k and v]
            if "css" in fields:
                row["css"] = [(k, [n.text().strip(dom.SPACE) for n in dom.select(root, s)]) for k, s in css.items()]
            if "captcha" in fields:
                row["captcha"] = bool(dom.select(root, CAPTCHA))
            if "readable" in fields:
                a = readable.article(root, page)
                content = a.pop("content")
                row["readable"] = {**a, "html": dom.inner_html(content) if content else None, "markdown": dom.markdown(content) if content else None}
            if "clean_html" in fields or "markdown" in fields:
                main = dom.clean(root, keep_nav, keep_footer)
                if "clean_html" in fields:
                    row["clean_html"] = dom.inner_html(main)
                if "markdown" in fields:
                    row["markdown"] = dom.markdown(main)
            return row

        for batch in pieces(batches):
            out: dict[str, list] = {f: [] for f in fields}
            for page, at in zip(batch.column(html), batch.column(url), strict=True):
                why = None
                try:
                    row = read(page.as_py() or "", at.as_py() or "")
                except MemoryError:
                    raise
                except Exception as e:  # one page, whatever is wrong with it, costs its own fields only
                    row, why = read("", ""), f"{type(e).__name__}: {e}"[:200]
                for f in fields:
                    out[f].append(why if f == "parse_error" else row[f])
            cols = [batch.column(f.name) for f in kept] + [pa.array(out[f], types[f]) for f in fields]
            yield pa.RecordBatch.from_arrays(cols, [*(f.name for f in kept), *fields])

    from pyspark.sql.pandas.types import to_arrow_type

    probe = pages.sparkSession.createDataFrame([], ", ".join(f"{f} {FIELDS[f]}" for f in fields))
    types = {f.name: to_arrow_type(f.dataType) for f in probe.schema.fields}
    return pages.mapInArrow(run, schema)


def closed_references(html: Column) -> Column:
    """html that reads a reference without its semicolon as text, as XML and plain replacements do; by the HTML standard, and without this, `&amp` is an ampersand too."""
    return F.regexp_replace(html, "&(?!#?[A-Za-z0-9]+;)", "&amp;")


def scrape(pages: DataFrame, closed: bool = False) -> DataFrame:
    """The whole page record: metadata, markdown, text, links, token counts, reduction and content hash. closed: see closed_references; tokens are those of the html as given."""
    d = pages.withColumn("html_tokens", T.token_estimate(F.coalesce("html", F.lit(""))))
    if closed:
        d = d.withColumn("html", closed_references(F.col("html")))
    return finish(parse(d, ("meta", "links", "markdown", "parse_error")))


def finish(d: DataFrame) -> DataFrame:
    """The native columns of a page record that has its markdown and html_tokens."""
    d = d.withColumn("text", T.plain_text(F.col("markdown"))).withColumn("markdown_tokens", T.token_estimate(F.col("markdown")))
    return d.withColumn("reduction", T.reduction(F.col("markdown_tokens"), F.col("html_tokens"))).withColumn("content_hash", T.content_hash(F.col("markdown")))


def agent_extract(pages: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """title, markdown, approx_tokens (a quarter of the units), captcha, publish_date, extracted_via.

    The article found by density where it has 200 characters or more, else the cleaned page. The date is the tag's, else
    the first one in the markdown. `more` names further fields of the same parse.
    """
    d = parse(pages, ("meta", "markdown", "captcha", "readable", *more))
    dense = F.col("readable.ok") & (T.len16(F.coalesce("readable.text", F.lit(""))) >= 200)
    d = d.withColumn("extracted_via", F.when(dense, "readability").otherwise("cleaner")).withColumn("markdown", F.when(dense, F.col("readable.markdown")).otherwise(F.col("markdown")))
    date = F.coalesce(F.nullif(F.col("meta.published_at"), F.lit("")), T.first_date(F.col("markdown")))
    title = F.coalesce(F.when(F.col("readable.ok"), F.nullif(F.col("readable.title"), F.lit(""))), F.col("meta.title"))
    d = d.withColumn("title", title).withColumn("approx_tokens", T.js_round(T.len16(F.col("markdown")) / 4).cast("long"))
    return d.withColumn("publish_date", date).drop("meta", "readable")


def extract_many(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """requests(url, ...) with agent_extract's title, markdown, approx_tokens, captcha, publish_date, extracted_via of snapshots(url, html).

    Every request keeps its row: one without a page, or whose url is null, has an empty title and text, no tokens, and
    extracted_via none. Of several snapshots of a url the greatest html is read; it is parsed once however often it is asked for.
    """
    asked = requests.select(F.col("url").alias("_r")).where("url is not null").distinct()
    one = snapshots.groupBy("url").agg(F.max("html").alias("html")).join(asked, F.col("url") == F.col("_r"), "left_semi")
    got = agent_extract(one).select(F.col("url").alias("_u"), "title", "markdown", "approx_tokens", "captcha", "publish_date", "extracted_via")
    d = requests.join(got, F.col("url") == F.col("_u"), "left")
    empty = {"title": F.lit(""), "markdown": F.lit(""), "approx_tokens": F.lit(0).cast("long"), "captcha": F.lit(False), "extracted_via": F.lit("none")}
    return d.select(*requests.columns, *[F.coalesce(F.col(c), empty[c]).alias(c) if c in empty else F.col(c) for c in ("title", "markdown", "approx_tokens", "captcha", "publish_date", "extracted_via")])


#: What resolve() adds.
URL = "struct<href:string,scheme:string,host:string,port:int,path:string,query:string,fragment:string>"


def resolve(df: DataFrame, url: str = "url", base: str | None = None, name: str = "parsed") -> DataFrame:
    """df with the url's parts by the URL standard (URL), resolved against the column base where one is named; null for what is no url. A port is null where it is the scheme's own."""
    kept = [f for f in df.schema.fields if f.name != name]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{name}` {URL}"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from ..functions import whatwg as H

        kind = pa.struct([(c, pa.int32() if c == "port" else pa.string()) for c in ("href", "scheme", "host", "port", "path", "query", "fragment")])
        for batch in pieces(batches):
            out, known = [], {}
            bases = batch.column(base).to_pylist() if base else [None] * batch.num_rows
            for u, b in zip(batch.column(url).to_pylist(), bases, strict=True):
                if b is not None and b not in known:
                    known[b] = H.parse(b)
                x = H.parse(u, known.get(b)) if u is not None else None
                out.append(x and {"href": x.href(), "scheme": x.scheme, "host": x.host, "port": x.port, "path": x.path if isinstance(x.path, str) else "".join("/" + s for s in x.path), "query": x.query, "fragment": x.fragment})
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(out, kind)], [*(f.name for f in kept), name])

    return df.mapInArrow(run, schema)
