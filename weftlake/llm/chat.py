"""Chat formatting: typed content parts are visited in order and flattened into a marked-up string that reads back whole. DataFrame functions only.

A turn is written <s>[INST]role[/INST]body</s>. Inside a role or a text every control string gets one backslash
after its opening bracket (one more, where it has some), so the template's own marks are the only bare ones and
taking one backslash away restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import prefix_sums

#: Fixed: what opens a control string, and what closes it. <s> </s> [INST] [/INST] <<SYS>> <</SYS>> [IMAGE:n] [AUDIO:n] [DOCUMENT:n]
_OPEN = r"(<</|<<|</|<|\[/|\[)"
_CLOSE = r"(s>|SYS>>|INST\]|(?:IMAGE|AUDIO|DOCUMENT):[0-9]+\])"
#: Tokens that a part that isn't text stands for, where the part brings no count of its own.
EXPANDED = {"image": 576, "audio": 750, "document": 1024}
PART = "struct<kind:string,text:string,ref:string,n_tokens:long>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _OPEN + r"(\\*)" + _CLOSE, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, _OPEN + r"\\(\\*)" + _CLOSE, "$1$2$3")


def _body(parts: Column) -> Column:
    """The visitor: one string for a turn's parts; a part that isn't text leaves a numbered placeholder (the number is its place in the turn).

    Texts that follow one another are joined before they are escaped, so that no control string arises where they meet.
    """
    every = F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p, i: F.struct(F.lower(F.coalesce(p["kind"], F.lit("text"))).alias("kind"), p["text"].alias("text"), i.alias("place")))

    def visit(acc, p):
        mark = F.concat(F.lit("["), F.upper(p["kind"]), F.lit(":"), p["place"].cast("string"), F.lit("]"))
        other = p["kind"].isin(*EXPANDED)
        done = F.when(other, F.concat(acc["done"], escape(acc["run"]), mark)).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(other, F.lit("")).otherwise(F.concat(acc["run"], F.coalesce(p["text"], F.lit("")))).alias("run"))

    return F.aggregate(every, F.struct(F.lit("").alias("done"), F.lit("").alias("run")), visit, lambda acc: F.concat(acc["done"], escape(acc["run"])))


def _attached(parts: Column) -> Column:
    """Of the parts that aren't text: place in the turn, kind, reference, expanded tokens."""
    every = F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p, i: F.struct(i.alias("place"), F.lower(F.coalesce(p["kind"], F.lit("text"))).alias("kind"), p["ref"].alias("ref"), p["n_tokens"].alias("n")))
    usual = F.create_map(*[F.lit(x) for kv in EXPANDED.items() for x in kv])
    return F.transform(F.filter(every, lambda p: p["kind"].isin(*EXPANDED)), lambda p: F.struct(p["place"].alias("place"), p["kind"].alias("kind"), p["ref"].alias("ref"), F.coalesce(p["n"], usual[p["kind"]]).cast("long").alias("n_tokens")))


def format_chat(turns: DataFrame, assistant: str = "assistant") -> DataFrame:
    """turns(conv_id, turn, role, parts array<PART>): one row a conversation.

    formatted, loss_spans (start, length: code points of the texts of assistant turns), attachments (turn's place,
    part's place, kind, ref, n_tokens), expanded_tokens. Turns stand by (turn, role, body), so repeated rows stay and
    ties have an order; null turns come first; a null role is written as an empty one; null and empty parts give an
    empty body; an unknown kind counts as text. Nothing is formatted for an empty table; other columns are ignored.
    A conversation is one string, so its turns do meet in one task, as any reader of that string needs; rows without a
    conv_id are one conversation.
    """
    body = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), _body(F.col("parts")).alias("body"), _attached(F.col("parts")).alias("att"))
    c = turns.select("conv_id", body.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit("<s>[INST]"), escape(t["role"]), F.lit("[/INST]"))
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), t["body"].alias("body"), (t["role"] == assistant).alias("loss"), F.concat(head(t), t["body"], F.lit("</s>")).alias("all")))
    c = c.withColumn("pieces", pieces)
    starts = prefix_sums(F.transform("pieces", lambda p: F.length(p["all"]).cast("long")))
    span = lambda p, at: F.when(p["loss"], F.struct((at + F.length(p["head"])).cast("long").alias("start"), F.length(p["body"]).cast("long").alias("length")))
    spans = F.array_compact(F.zip_with("pieces", starts, span))
    attachments = F.flatten(F.transform("turns", lambda t, i: F.transform(t["att"], lambda a: F.struct(i.alias("turn_place"), a["place"].alias("place"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["n_tokens"].alias("n_tokens")))))
    return c.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["all"]), "").alias("formatted"),
        spans.alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["n_tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, body>> read from the formatted string alone; bodies unescaped (placeholders stay)."""
    marked = F.filter(F.split("formatted", r"</s>", -1), lambda x: x != "")
    turn = lambda x: F.struct(unescape(F.regexp_extract(x, r"(?s)^<s>\[INST\](.*?)\[/INST\]", 1)).alias("role"), unescape(F.regexp_extract(x, r"(?s)^<s>\[INST\].*?\[/INST\](.*)$", 1)).alias("body"))
    return formatted.withColumn("turns", F.transform(marked, turn))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and conversation -7, formatted and read back; null texts and roles count as empty, repeated rows stay."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    role = F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") + 1).cast("int"))
    rows = rows.unionByName(spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text")))
    part = F.array(F.struct(F.lit("text").alias("kind"), F.col("text").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("n_tokens")))
    f = read_back(format_chat(rows.select("conv_id", "turn", "role", part.alias("parts"))))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["body"], F.lit("\n"))), "")
    f = f.select("conv_id", F.size("turns").cast("long").alias("n_turns"), whole.alias("whole"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return f.select("conv_id", "n_turns", F.sha2("whole", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
