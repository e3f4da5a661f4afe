"""Language-model scores: the probability of a text as a sum over all its segmentations into pieces of an existing vocabulary.

The vocabulary is that of a public subword tokenizer. Its own scores (ranks) give a Zipf prior, the counts of its pieces in the
training documents the rest; with the end of a text as one more piece that is a unigram model of texts. No piece reaches from
one word into the next, so a text's lattice is its words' lattices one after the other: the forward recursion runs once for each
distinct word of the corpus, and a text's score is a sum over its words.

Words are counted in the tasks and summed by a shuffle. Most places in the texts are of frequent words, which are shipped (a bounded
number of bounded bytes, cut at a count that a histogram gives); the rest goes through a join by word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import drop, table, trimmed

#: Words that are shipped to the tasks at most, and the bytes of one: 12.8 MB in all.
SHIPPED, SHIPPED_BYTES = 200_000, 64
#: Distinct words that a task holds before it gives its counts away.
HELD_WORDS = 200_000
#: Distinct words that a task runs the recursion over: half a second's work, whatever their bytes.
TASK_WORDS = 20_000
#: Weight of the prior over pieces, in pieces.
PRIOR = 32_000.0
#: What stands before a word in the vocabulary.
SPACE = "▁".encode()


def vocabulary(path: str | None = None) -> bytes:
    """The tokenizer's file; the driver reads it and ships it (half a MB)."""
    import public_tokenizers

    with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def _pieces(model: bytes) -> tuple[list[tuple[bytes, float]], int]:
    """(bytes, prior) of each piece by id, unusable ones as (b'', 0), and the id of the end mark. The prior falls as one over the rank that the vocabulary's score is."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    out: list[tuple[bytes, float]] = []
    for i in range(sp.get_piece_size()):
        name, rank = sp.id_to_piece(i), min(-sp.get_score(i), float(sp.get_piece_size()))
        if sp.is_byte(i):
            out.append((bytes([int(name[3:5], 16)]), 1 / sp.get_piece_size()))
        elif sp.is_control(i) or sp.is_unknown(i):
            out.append((b"", 1 / sp.get_piece_size() if i == sp.eos_id() else 0.0))
        else:
            out.append((name.encode(), 1 / (rank + 2.7)))
    return out, sp.eos_id()


def arcs(model: bytes, counts: dict[int, int], weight: float = PRIOR) -> tuple[dict[bytes, float | None], float]:
    """({bytes of a piece: its log probability, bytes that only begin one: None}, log probability of the end). Pieces of equal bytes are one arc of both probabilities."""
    import math

    pieces, end = _pieces(model)
    prior = sum(p for _, p in pieces)
    total = sum(counts.values()) + weight
    p = [(counts.get(i, 0) + weight * q / prior) / total for i, (_, q) in enumerate(pieces)]
    sums: dict[bytes, float] = {}
    for (name, _), x in zip(pieces, p, strict=True):
        if name:
            sums[name] = sums.get(name, 0.0) + x
    out: dict[bytes, float | None] = {name[:k]: None for name in sums for k in range(1, len(name))}
    return out | {name: math.log(x) for name, x in sums.items()}, math.log(p[end])


def marginal(word: bytes, arcs: dict[bytes, float | None]) -> float:
    """Log of the summed probability of all segmentations of word. Every byte is a piece, so every place is reached."""
    from math import exp, log1p

    n, get = len(word), arcs.get
    a: list = [None] * (n + 1)
    a[0] = 0.0
    for i in range(n):
        x = a[i]
        for j in range(i + 1, n + 1):
            p = get(word[i:j], 1.0)
            if p is None:
                continue
            if p > 0:  # no piece begins so
                break
            y, z = x + p, a[j]
            a[j] = y if z is None else y + log1p(exp(z - y)) if y > z else z + log1p(exp(y - z))
    return a[n]


def _counts(docs: DataFrame) -> DataFrame:
    """docs(held boolean, text binary): word (null: the end of a text), c (in documents that aren't held out), seen (in all)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        train, seen = Counter(), Counter()

        def flush():
            words = list(seen)
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([train[w] for w in words], pa.int64()), pa.array([seen[w] for w in words], pa.int64())], ["word", "c", "seen"])
            train.clear()
            seen.clear()
            return out

        for batch in batches:
            for held, text in zip(batch.column("held").to_pylist(), batch.column("text"), strict=True):
                words: list = (text.as_py() or b"").lower().split()  # bytes: A-Z, and ASCII white space
                words.append(None)
                seen.update(words)
                if not held:
                    train.update(words)
                if len(seen) > HELD_WORDS:
                    yield flush()
        yield flush()

    return docs.mapInArrow(lambda batches: trimmed(run(batches)), "word binary, c long, seen long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))


def _piece_counts(counts: DataFrame, model) -> dict[int, int]:
    """How often each piece stands in the training documents, as the tokenizer cuts them: at most a row for each piece of the vocabulary."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        total = np.zeros(sp.get_piece_size(), "i8")
        for batch in batches:
            words = [w.as_py() for w in batch.column("word")]
            ids = sp.encode([(w or b"").decode("utf-8", "replace") for w in words], num_threads=1)
            ids = [x if w is not None else [sp.eos_id()] for w, x in zip(words, ids, strict=True)]
            weight = np.repeat(batch.column("c").to_numpy(), [len(x) for x in ids])
            np.add.at(total, np.fromiter((i for x in ids for i in x), "i8", len(weight)), weight)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["piece", "n"])

    return {r["piece"]: r["n"] for r in counts.where("c > 0").mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()}


def _lexicon(counts: DataFrame, known) -> DataFrame:
    """counts with score: the natural log of a word's probability, summed over its segmentations."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        probabilities, end = known.value
        for batch in batches:
            score = [end if w is None else marginal(SPACE + w, probabilities) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, "score"])

    return counts.mapInArrow(run, "word binary, c long, seen long, score double")


def _frequent(lexicon: DataFrame, most: int) -> dict[bytes, tuple[int, float]]:
    """The most frequent words of at most SHIPPED_BYTES bytes, at most `most` of them: the count from which they are taken comes from a histogram."""
    fit = lexicon.where(F.col("word").isNotNull() & (F.length("word") <= SHIPPED_BYTES))
    level = F.floor(F.log2("seen") * 16).cast("int")
    least, n = None, 0
    for r in sorted(fit.groupBy(level.alias("level")).count().collect(), reverse=True):  # at most 63 * 16 levels
        n += r["count"]
        if n > most:
            break
        least = r["level"]
    if least is None:
        return {}
    return {bytes(r["word"]): (r["c"], r["score"]) for r in fit.where(level >= least).select("word", "c", "score").collect()}


def lattice_scores(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", model: bytes | None = None, shipped: int = SHIPPED) -> DataFrame:
    """A row a document: key, held_out, n_tokens, n_known, train_tokens (long), base_score, score (log10 probabilities).

    Tokens are the words of the text, A-Z lower-cased, and one end. The model and the counts of base_score learn from the documents
    that aren't held out (a null held_out isn't). base_score: words by their own counts, a half added to each. score: pieces, over all
    segmentations. A null or empty text is its end alone; repeated rows and keys, and null keys, are documents of their own; an
    empty table gives an empty result; without training documents the prior over pieces and equal words remain; other columns
    are ignored. A text is read as its bytes, so any text has a score, of any length.
    """
    spark = docs.sparkSession
    held = F.coalesce(held_out, F.lit(False))
    d = docs.select(F.col(key).alias("key"), held.alias("held"), F.col(text).cast("binary").alias("text"))
    counts = table(_counts(d.select("held", "text")), "words")
    row = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count("*").alias("words")).first()
    n_train, floor = row["n"], row["n"] + 0.5 * (row["v"] + 1)
    file = spark.sparkContext.broadcast(model or vocabulary())
    known = spark.sparkContext.broadcast(arcs(file.value, _piece_counts(counts, file)))
    lexicon = table(_lexicon(counts.repartition(1 + row["words"] // TASK_WORDS), known), "lexicon")
    drop(counts)
    frequent = spark.sparkContext.broadcast(_frequent(lexicon, shipped))
    ends = lexicon.where("word is null").select("c", "score").first()  # one row
    end = (ends["c"], ends["score"]) if ends else (0, 0.0)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        words = {w: i for i, w in enumerate(frequent.value)}
        c = np.array([x for x, _ in frequent.value.values()], "f8")
        score = np.array([x for _, x in frequent.value.values()], "f8")
        base = np.log10(c + 0.5)
        row, get = TaskContext.get().partitionId() << 36, words.get
        for batch in batches:
            rows: list = []
            rest: list = []
            for key, held, text in zip(batch.column("key").to_pylist(), batch.column("held").to_pylist(), batch.column("text"), strict=True):
                tokens = (text.as_py() or b"").lower().split()
                seen = Counter(tokens)
                at = [get(w, -1) for w in seen]
                i, n = np.array(at, "i8"), np.fromiter(seen.values(), "f8", len(seen))
                of = i >= 0
                i, m = i[of], n[of]
                rows.append((row, key, held, None, len(tokens) + 1, int(m[c[i] > 0].sum()) + (end[0] > 0), float(m @ base[i]) + float(np.log10(end[0] + 0.5)), float(m @ score[i]) + end[1]))
                if len(i) < len(seen):
                    rest += [(row, w, k) for (w, k), x in zip(seen.items(), at, strict=True) if x < 0]
                row += 1
            empty = [None] * len(rest)
            cols = list(zip(*rows, strict=True)) or [()] * 8
            more = list(zip(*rest, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([
                pa.array([*cols[0], *more[0]], pa.int64()), pa.array([*cols[1], *empty], batch.schema.field("key").type), pa.array([*cols[2], *empty], pa.bool_()), pa.array([*cols[3], *more[1]], pa.binary()),
                pa.array([*cols[4], *more[2]], pa.int64()), pa.array([*cols[5], *empty], pa.int64()), pa.array([*cols[6], *empty], pa.float64()), pa.array([*cols[7], *empty], pa.float64()),
            ], ["row", "key", "held", "word", "n", "known", "base", "score"])

    parts = table(d.mapInArrow(lambda batches: trimmed(run(batches)), f"row long, key {kind}, held boolean, word binary, n long, known long, base double, score double"), "scored")
    other = lexicon.select(F.col("word").alias("w"), "c", F.col("score").alias("s"))
    rare = parts.where("word is not null").select("row", "word", "n").join(other, F.col("word") == F.col("w"))
    rare = rare.groupBy(F.col("row").alias("r")).agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("b"), F.sum(F.col("n") * F.col("s")).alias("s"))
    out = parts.where("word is null").join(rare, F.col("row") == F.col("r"), "left")
    n, none = F.col("n"), F.lit(0.0)
    return out.select(
        F.col("key").alias(key), F.col("held").alias("held_out"), n.alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", none) - n * F.log10(F.lit(float(floor)))).alias("base_score"), ((F.col("score") + F.coalesce("s", none)) / F.log(F.lit(10.0))).alias("score"),
    )


def op11_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores; held out are those whose crc32 of the id as text leaves 1 by 5 (see lattice_scores for nulls, repeats and empty texts)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return lattice_scores(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)
