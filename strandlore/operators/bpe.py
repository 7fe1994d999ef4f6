"""Byte-pair encoding: word counts, weighted pair counts, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandlore.session import cut

# Characters that end a word and are words themselves.
BOUNDARIES = " \n\r\t()[]{},;:!?\"'`"
_CLASS = r" \n\r\t()\[\]{},;:!?\"'`"
PIECES = rf"[{_CLASS}]|[^{_CLASS}]+"


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, freq): the corpus shrinks to its distinct words before anything iterates."""
    return docs.select(F.explode(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))


def byte_tokens(word: Column, special: int = 0) -> Column:
    """UTF-8 bytes as ids, after the special ones."""
    bytes_as_chars = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")  # one character per byte
    return F.transform(F.split(bytes_as_chars, ""), lambda c: F.ascii(c) + special)


def byte_pair_counts(words: DataFrame) -> DataFrame:
    """``pair_counts`` of the bytes of (word, freq): pairs are counted as strings of two characters, and read as numbers at the end."""
    chars = F.decode(F.encode("word", "UTF-8"), "ISO-8859-1")
    long = words.select("freq", chars.alias("c")).where(F.length("c") > 1)
    at = long.select("freq", "c", F.explode(F.sequence(F.lit(1), F.length("c") - 1)).alias("i"))
    counts = at.select("freq", F.substring("c", F.col("i"), F.lit(2)).alias("p")).groupBy("p").agg(F.sum("freq").alias("n"))
    return counts.select(F.ascii("p").alias("a"), F.ascii(F.substring("p", 2, 1)).alias("b"), "n")


def pair_counts(words: DataFrame) -> DataFrame:
    """(a, b, n) over adjacent ids of (ids, freq), weighted by word frequency."""
    long = words.where(F.size("ids") > 1)
    pairs = F.zip_with(F.slice("ids", F.lit(1), F.size("ids") - 1), F.slice("ids", F.lit(2), F.size("ids") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return long.select("freq", F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.sum("freq").alias("n"))


def best_pair(counts: DataFrame) -> DataFrame:
    """Most frequent pair; the smallest one on ties."""
    return counts.agg(F.min(F.struct((-F.col("n")).alias("m"), "a", "b")).alias("p")).select("p.a", "p.b", (-F.col("p.m")).alias("n"))


def merged(ids: Column, a: int, b: int, new: int) -> Column:
    """Left to right, every (a, b) becomes ``new``."""
    empty = F.array().cast("array<int>")
    hit = lambda acc, x: (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) == a) & (x == b)
    step = lambda acc, x: F.when(hit(acc, x), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.lit(new)))).otherwise(F.concat(acc, F.array(x)))
    return F.when(F.array_contains(ids, a) & F.array_contains(ids, b), F.aggregate(ids, empty, step)).otherwise(ids)


def train(docs: DataFrame, text: str, merges: int, special: int = 0) -> list[tuple[int, int, int, int]]:
    """(a, b, new id, count) per merge; stops where no pair occurs twice.

    The loop runs over distinct words; only the winning pair comes to the driver. Lineage is cut every few merges.
    """
    words = cut(word_counts(docs, text).select("freq", byte_tokens(F.col("word"), special).alias("ids")))
    out = []
    for i in range(merges):
        best = best_pair(pair_counts(words)).first()
        if best is None or best["n"] is None or best["n"] < 2:
            break
        new = 256 + special + i
        out.append((best["a"], best["b"], new, best["n"]))
        words = words.withColumn("ids", merged(F.col("ids"), best["a"], best["b"], new))
        if i % 4 == 3:
            words = cut(words)
    return out
