"""Watchlists of any length: one automaton over all names and aliases reads each text once, whatever their number."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import urls as U

#: Characters of the names that one automaton holds at most (about 40 bytes each); a longer list makes several, each a pass of its own.
MAX_CHARS = 4_000_000
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")


def fold(text: str) -> str:
    """A-Z lowered and nothing else, so that places stay."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def automaton(terms: Sequence[tuple[str, int]]):
    """An Aho-Corasick automaton of (term, number of its entity); what it finds is (length, whether the term begins and ends with a word character, numbers)."""
    import ahocorasick

    of: dict[str, list[int]] = {}
    for term, n in terms:
        own = of.setdefault(fold(term), [])
        if n not in own:
            own.append(n)
    found = ahocorasick.Automaton()
    for term, numbers in of.items():
        found.add_word(term, (len(term), term[0] in _WORD, term[-1] in _WORD, tuple(numbers)))
    found.make_automaton()
    return found


def named(text: str, found) -> list[int]:
    """The numbers of the entities that a text names, rising. A term counts where a word ends and begins at both its ends (ASCII words)."""
    text = fold(text)
    last, out = len(text) - 1, set()
    for end, (n, begins, ends, numbers) in found.iter(text):
        start = end - n + 1
        if (start > 0 and text[start - 1] in _WORD) != begins and (end < last and text[end + 1] in _WORD) != ends:
            out.update(numbers)
    return sorted(out)


def _parts(watchlist: Sequence[tuple[str, Sequence[str]]], most: int) -> list[list[tuple[str, int]]]:
    """The terms of the list with their entities' numbers, in parts of at most so many characters; an entity's terms stay together, so that no part finds what another one found."""
    parts: list[list[tuple[str, int]]] = [[]]
    held = 0
    for n, (name, aliases) in enumerate(watchlist):
        own = [(t, n) for t in (name, *aliases) if t]
        size = sum(len(t) for t, _ in own)
        if held + size > most and parts[-1]:
            parts.append([])
            held = 0
        parts[-1] += own
        held += size
    return [p for p in parts if p]


def mentions(items: DataFrame, watchlist: Sequence[tuple[str, Sequence[str]]], most: int = MAX_CHARS) -> DataFrame:
    """items(title, snippet, url, ...): a row for each entity (name, aliases) that the title or snippet names, with entity and url_key.

    The same rows as by a pattern for each entity; plan and work by text don't grow with the list. Null titles and snippets are empty;
    entities of one name are one; empty names name nothing.
    """
    spark = items.sparkSession
    hay = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("snippet", F.lit("")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    names = list(dict.fromkeys(n for n, _ in watchlist))
    number = {n: i for i, n in enumerate(names)}
    merged: list[tuple[str, list[str]]] = [(n, []) for n in names]
    for n, aliases in watchlist:
        merged[number[n]][1].extend(aliases)
    out = None
    for part in _parts(merged, most):
        sent = spark.sparkContext.broadcast((automaton(part), {n: names[n] for _, n in part}))  # at most MAX_CHARS of names

        def run(batches: Iterator, sent=sent) -> Iterator:
            import pyarrow as pa

            found, name = sent.value
            for batch in batches:
                hits = [[name[n] for n in named(t, found)] for t in batch.column("_hay").to_pylist()]
                some = pa.array([bool(h) for h in hits])
                rest = batch.drop_columns(["_hay"]).append_column("_entities", pa.array(hits, pa.list_(pa.string())))
                yield rest.filter(some)

        one = items.withColumn("_hay", hay).mapInArrow(run, f"{fields}, _entities array<string>")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return items.where(F.lit(False)).withColumn("entity", F.lit("")).withColumn("url_key", U.mention_key(F.col("url")))
    return out.withColumn("entity", F.explode("_entities")).drop("_entities").withColumn("url_key", U.mention_key(F.col("url")))
