"""SimHash near-duplicates: fingerprints, links within a few bits, components.

Two 64-bit fingerprints that differ in at most RADIUS = 3 bits share at least 8 - 3 = 5 of their
8 positional bytes. The inverted index is by positional bytes; because a single byte's posting
list holds 1/256 of all fingerprints, a posting here is the conjunction of three positions. Any five
of the eight positions hold three of the first four or three of the last four, so the eight triples
within the halves miss no pair. In a posting the shared positional bytes of each pair are tallied,
pairs that reach the guaranteed five are kept, and those are verified bit by bit.

Work is on distinct fingerprints, so copies cost nothing. A posting of more than FEW members yields
a star for each component among them, at most one row a member, not its pairs; one of more than BLOCK is cut
into blocks, and each pair of blocks is a task of its own.

Defined cases: a text without words (or null) has fingerprint zero and is linked like any other; a
component whose rows have no doc_id has none; equal rows are one another's copies; a very long text is hashed in parts of
CHUNK shingles; only doc_id and the text are read, whatever other columns are called; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from strandlore.llm.common import small_batches
from strandlore.session import cut

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Positional bytes that two linked fingerprints share at least.
SHARED = 8 - RADIUS
TRIPLES = [(a, b, c) for half in (0, 4) for a in range(half, half + 4) for b in range(a + 1, half + 4) for c in range(b + 1, half + 4)]
#: Members of a posting that meet in one call; up to FEW go with those of other postings.
BLOCK, FEW = 1024, 32
#: Shingles that are counted in one numpy call.
CHUNK = 1 << 15


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """Bit is 1 if it is set in over half of the shingle hashes; signed, as Spark has it."""
    words = (text or b"").lower().split()  # bytes: only A-Z change, only the six ASCII blanks separate
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    begin, stop = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(begin), CHUNK):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(begin[at : at + CHUNK], stop[at : at + CHUNK], strict=True)], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(begin)).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp) of every document. No shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t) for t in batch["text"].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs share enough positional bytes, and differ in few enough bits?"""
    x = a[:, None] ^ b[None, :]
    tally = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=2)
    return (tally >= SHARED) & (np.bitwise_count(x) <= RADIUS)


def forest(fps: np.ndarray, groups: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int]]:
    """A star for each component that the near pairs between two blocks (or within one) make: least member, other member."""
    a, b = groups
    parent = {int(x): int(x) for x in fps}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for at in range(0, len(a), 256):  # 256 x BLOCK pairs at a time
        left = a[at : at + 256]
        i, j = np.nonzero(_near(left, b))
        for u, v in zip(left[i].view(np.int64).tolist(), b[j].view(np.int64).tolist(), strict=True):
            p, q = top(u), top(v)
            if p != q:
                parent[max(p, q)] = min(p, q)
    return [(t, x) for x in parent if (t := top(x)) != x]


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (u, v) whose transitive closure is that of all pairs within RADIUS bits."""
    triple = F.array(*[F.lit(sum(255 << (8 * p) for p in t) - (1 << 64 if 7 in t else 0)) for t in TRIPLES])
    postings = distinct.select("fp", F.posexplode(triple).alias("t", "_mask")).select("fp", "t", F.col("fp").bitwiseAND(F.col("_mask")).alias("key"))
    sizes = postings.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(postings.join(sizes, ["t", "key"]))
    few = shared.where(F.col("n") <= FEW).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))  # FEW at most
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("_blocks")).cast("int")
    dealt = (
        shared.where(F.col("n") > FEW)
        .withColumn("_blocks", blocks)
        .withColumn("_mine", mine)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select("fp", "t", "key", F.least("_mine", "_other").alias("a"), F.greatest("_mine", "_other").alias("b"), (F.col("_mine") > F.col("_other")).alias("second"))
    )

    def near(rows: pd.DataFrame) -> pd.DataFrame:
        fps = rows["fp"].to_numpy(np.int64)
        second = rows["second"].to_numpy(bool)
        bits = fps.view(np.uint64)
        sides = (bits[~second], bits[second]) if second.any() else (bits, bits)
        return pd.DataFrame(forest(fps, sides), columns=["u", "v"], dtype="int64")

    many = dealt.groupBy("t", "key", "a", "b").applyInPandas(near, "u long, v long")
    return few.select("fps").mapInArrow(_near_in_lists, "u long, v long").union(many).distinct()


def _near_in_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs within each of many short lists: all lists at once, one distance within the list at a time."""
    for batch in batches:
        lists = batch["fps"]
        fps = lists.flatten().to_numpy(zero_copy_only=False)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(fps))  # members from here to the list's end
        bits = fps.view(np.uint64)
        for apart in range(1, int(sizes.max(initial=1))):
            i = np.flatnonzero(left > apart)
            x = bits[i] ^ bits[i + apart]
            tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            i = i[(tally >= SHARED) & (np.bitwise_count(x) <= RADIUS)]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(fps[i]), pa.array(fps[i + apart])], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label): smallest node of each linked one's component, by hooking and pointer jumping.

    Every round each node takes the least label among its neighbours and itself, then its label's
    label. Rounds grow with the logarithm of a component's diameter; every round is checkpointed.
    """
    both = cut(edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("_l")).select("node", F.least("node", "_l").alias("label")))
    while True:
        offered = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("_offer"))
        hooked = labels.join(offered, labels["node"] == offered["u"], "left").select(
            "node", F.col("label").alias("_old"), F.least("label", F.coalesce("_offer", "label")).alias("label")
        )
        hooked = cut(hooked)
        over = hooked.select(F.col("node").alias("label"), F.col("label").alias("_top"))
        jumped = cut(hooked.join(over, "label", "left").select("node", "_old", F.coalesce("_top", "label").alias("label")))
        if not jumped.where("_old <> label").limit(1).count():
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")


def classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id that can be reached) of every document."""
    rows = cut(fingerprints(docs, text))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    labels = components(links(distinct.select("fp")))
    named = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    # both sides are plain shuffles of checkpointed rows, so adaptive execution can split a fingerprint that holds many copies
    by_fp = cut(named.join(least, "label").select("fp", "component_id"))
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
