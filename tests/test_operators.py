"""Semantics that the oracle queries don't reach: folds, invariants, round trips."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from strandlore.functions import text as X
from strandlore.operators import bpe, chunks, codecs, history, lifecycle, observability, replication, vectors as V


def test_floored_counts_equal_the_fold(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([-1, -1, 1])) for k in range(40) for i in range(rng.randint(1, 60))]
    got = {r.k: r.ref_count for r in lifecycle.floored_counts(spark.createDataFrame(rows, "k int, seq int, d int"), "k", "d", ["seq"]).collect()}
    cut = {r.k: r.ref_count for r in lifecycle.floored_counts(spark.createDataFrame(rows, "k int, seq int, d int"), "k", "d", ["seq"], F.floor(F.col("seq") / 7)).collect()}
    want = {}
    for k, _, d in rows:
        want[k] = max(0, want.get(k, 0) + d)
    assert got == want == cut


def test_order_statistics(spark):
    rng = random.Random(5)
    rows = [("a", rng.choice([1.5, 1.5, 1.5, -3.0, 0.0, 2.25, rng.random() * 100])) for _ in range(501)] + [("b", 7.0)] * 40 + [("c", 1.0)]
    n = F.col("n")
    got = {r.k: (r.lo, r.mid, r.hi) for r in observability.order_statistics(spark.createDataFrame(rows, "k string, v double"), "k", "v", {"lo": F.lit(0), "mid": F.floor(n / 2), "hi": n - 1}).collect()}
    for k in "abc":
        v = sorted(x for j, x in rows if j == k)
        assert got[k] == (v[0], v[len(v) // 2], v[-1])


def test_gc_keeps_pending_pins_and_young(spark):
    origins = spark.createDataFrame([(i, "2024-01-01", ttl) for i, ttl in [(1, None), (2, None), (3, 300), (4, 300), (5, None)]], "origin_id int, created_at string, ttl_seconds long").withColumn("created_at", F.to_timestamp("created_at"))
    counts = spark.createDataFrame([(5, 2)], "origin_id int, ref_count long")
    pins = spark.createDataFrame([(1, "released"), (2, "pending")], "origin_id int, state string")
    plan = lifecycle.gc_plan(origins, counts, pins, F.to_timestamp(F.lit("2024-01-01 00:05:00")))
    assert sorted(r.origin_id for r in plan.collect()) == [1, 3, 4]
    assert sorted(r.origin_id for r in lifecycle.gc_plan(origins, counts, pins, F.to_timestamp(F.lit("2024-01-01 00:04:00"))).collect()) == [1]


def test_repair_then_audit_is_empty(spark):
    replicas = spark.createDataFrame([("b1", "n1", "healthy", "2024-01-01 00:00:00"), ("b1", "n2", "dead", "2024-01-01 00:00:00")], "blob_id string, node_id string, state string, t string").withColumn("last_seen", F.to_timestamp("t"))
    need = spark.createDataFrame([("b1", 2), ("b2", 1)], "blob_id string, required long")
    nodes = spark.createDataFrame([(f"n{i}", "eu" if i % 2 else "us", 100.0 * (i > 0), 10.0 * i) for i in range(5)], "node_id string, region string, capacity_gb double, used_gb double")
    now = F.to_timestamp(F.lit("2024-01-01 00:01:00"))
    plan = replication.audit(need, replicas, now, 60)
    assert {(r.blob_id, r.missing) for r in plan.collect()} == {("b1", 1), ("b2", 1)}
    targets = replication.placements(plan, replicas, nodes, "eu")
    assert {(r.blob_id, r.node_id) for r in targets.collect()} == {("b1", "n3"), ("b2", "n1")}
    fixed = replicas.select("blob_id", "node_id", "state", "last_seen").union(targets.select("blob_id", "node_id", F.lit("healthy"), now))
    assert replication.audit(need, fixed, now, 60).count() == 0


def test_lineage_digest_ignores_order(spark):
    rows = [("o", f"e{i}", "k") for i in range(20)]
    a = history.lineage_digest(spark.createDataFrame(rows, "o string, e string, k string"), "o", "e", F.col("k")).first()
    b = history.lineage_digest(spark.createDataFrame(rows[::-1], "o string, e string, k string").repartition(3), "o", "e", F.col("k")).first()
    want = hashlib.sha256("\n".join(f"{e}|k" for e in sorted(r[1] for r in rows)).encode()).hexdigest()
    assert a == b and a.digest == want


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=6000), st.sampled_from([(16, 64, 256), (3, 32, 50), (100, 128, 5000)]))
def test_content_chunks(data, sizes):
    least, average, most = sizes
    table, mask, at, want = codecs.gear_table().tolist(), (1 << (average.bit_length() - 1)) - 1, 0, []
    while at < len(data):  # one byte at a time, as the definition has it
        h, cut = 0, min(most, len(data) - at)
        for i in range(min(least, len(data) - at), min(most, len(data) - at)):
            h = (h << 1) + table[data[at + i]] & codecs.MASK64
            if h & mask == 0:
                cut = i + 1
                break
        want.append((at, cut))
        at += cut
    assert codecs.content_chunks(data, *sizes) == (want or [(0, 0)])


def test_content_chunks_survive_an_edit():
    data = np.random.default_rng(0).bytes(200_000)
    parts = lambda d: {d[a : a + n] for a, n in codecs.content_chunks(d, 1024, 4096, 16384)}
    edited = data[:100_000] + b"!" + data[100_000:]
    assert len(parts(data) & parts(edited)) > 0.5 * len(parts(data))
    with pytest.raises(ValueError):
        codecs.content_chunks(b"x", 4, 4, 8)


def test_fixed_chunks_and_reassembly(spark):
    df = spark.createDataFrame([(1, "a" * 350), (2, ""), (3, None), (4, "é" * 100)], "k int, t string")
    rows = chunks.fixed_chunks(df, "k", "t", 100)
    assert [(r.k, r.chunk_length) for r in rows.orderBy("k", "ordinal").collect()] == [(1, 100), (1, 100), (1, 100), (1, 50), (2, 0), (4, 100)]
    assert {r.k: r.payload for r in chunks.reassemble(rows, "k").collect()} == {1: "a" * 350, 2: "", 4: "é" * 100}


def test_quality_prefers_code_that_helps(spark):
    df = spark.createDataFrame([("a", "def f(x):\n    return x\n\nclass A:\n    pass", 2.0, 1.0), ("b", "spam spam spam spam", None, None)], "id string, t string, before double, after double")
    got = {r.id: r.q for r in df.select("id", X.quality(F.col("t"), F.col("before"), F.col("after")).alias("q")).collect()}
    assert got["a"].quality_score > got["b"].quality_score and got["a"].improvement == 1.0 and got["b"].diversity == 0.25


def test_color_distance_and_pack(spark):
    color = lambda *v: F.struct(*[F.lit(x).alias(k) for k, x in zip(("hierarchy", "r", "g", "b"), v, strict=True)])
    row = spark.range(1).select(
        X.color_distance(color(1, 20, 20, 20), color(1, 25, 25, 25)).alias("near"), X.color_distance(color(1, 20, 20, 20), color(2, 20, 20, 20)).alias("far"),
        X.unpack_color(X.pack_color(color(255, 1, 2, 254))).alias("again"), X.hue(color(0, 255, 0, 0)).alias("red"), X.hue(color(0, 0, 0, 255)).alias("blue"),
    ).first()
    assert (row.near, row.far, tuple(row.again), row.red, row.blue) == (75, 1024, (255, 1, 2, 254), 0.0, 240.0)


@pytest.mark.parametrize(("text", "mode"), [("  def f", "code"), ("Why so", "qa"), ("is it so?", "qa"), ("x because y", "logic"), ("once", "narrative"), ("", "narrative")])
def test_modes(spark, text, mode):
    assert spark.range(1).select(X.mode(F.lit(text)).alias("m")).first().m == mode


def test_bpe_merges(spark):
    docs = spark.createDataFrame([("aaabdaaabac",)], "t string")
    merges = bpe.train(docs, "t", 10)
    assert merges[0] == (97, 97, 256, 4) and merges[1][:3] == (97, 98, 257) and all(m[3] >= 2 for m in merges)
    words = {r.word: r.freq for r in bpe.word_counts(spark.createDataFrame([("hello world hello",)], "t string"), "t").collect()}
    assert words == {"hello": 2, "world": 1, " ": 2}
    assert bpe.train(spark.createDataFrame([("",)], "t string"), "t", 5) == []


def test_polar_error_is_small():
    x = np.random.default_rng(1).normal(size=(200, 4)) * np.array([0.02, 1, 10, 50])[:, None].repeat(50, 0)
    back = codecs.polar_decode(*codecs.polar_encode(x))
    assert (np.linalg.norm(back - x, axis=1) < 0.15 * np.linalg.norm(x, axis=1)).all()


def test_int8_round_trip(spark):
    df = spark.createDataFrame([([1.0, -2.0, 3.5, 0.25],), ([7.0, 7.0],)], "v array<double>")
    for r in df.select("v", codecs.int8_restore(codecs.int8_residual(F.col("v"))).alias("w")).collect():
        assert np.allclose(r.v, r.w, atol=0.03)


def test_kmeans_finds_clusters(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(5 * (i % 3), 0.1, 4)]) for i in range(90)]
    _, placed = V.lloyd(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 3, 20, seed=7)
    groups = {}
    for r in placed.collect():
        groups.setdefault(r.nearest, set()).add(r.id % 3)
    assert sum(r.distance for r in placed.collect()) >= 0 and set().union(*groups.values()) == {0, 1, 2}


def test_search_filter_modes(spark):
    items = spark.createDataFrame([("python", [1.0, 0.0, 0.0], 1), ("rust", [0.0, 1.0, 0.0], 2), ("python-docs", [0.9, 0.1, 0.0], 1)], "item_id string, v array<double>, tag int")
    ask = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "query_id int, q array<double>")
    names = lambda df: [r.item_id for r in df.orderBy("rank").collect()]
    assert names(V.top_k(items, ask, 2)) == ["python", "python-docs"]
    assert names(V.top_k(items, ask, 2, keep=F.col("tag") == 2)) == []
    assert names(V.top_k(items, ask, 2, keep=F.col("tag") == 2, filter_mode="pre")) == ["rust"]


def test_probabilities_add_up(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    hidden = F.array(*[F.lit(0.1 * (i % 5)) for i in range(64)])
    total = V.hierarchical_softmax(e, "vec_id", "label", "embedding", hidden, 10).agg(F.sum("probability")).first()[0]
    assert abs(total - 1) < 1e-9


def test_blake3_equals_the_jvm(spark):
    from strandlore.functions.blake3 import blake3_id, digest

    assert digest(b"abc") == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    java = spark.sparkContext._jvm.org.apache.commons.codec.digest.Blake3
    for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 5000, 7168, 100_000):
        data = bytes(i % 251 for i in range(n))
        assert digest(data) == bytes(java.hash(data)).hex()
    got = spark.createDataFrame([("abc",), (None,)], "t string").select(blake3_id("t").alias("b")).collect()
    assert got[0].b.startswith("blake3:6437b3ac") and got[1].b is None


def test_lineage_reaches_the_root(spark):
    nodes = [(i, i - 1 if i else None) for i in range(150)] + [(900, 901)]
    got = {(r.node_id, r.ancestor_id, r.depth) for r in history.chain(spark.createDataFrame(nodes, "node_id long, parent_id long")).collect()}
    assert got == {(i, i - d, d) for i in range(150) for d in range(i + 1)} | {(900, 900, 0), (900, 901, 1)}
    with pytest.raises(ValueError, match="cycle"):
        history.chain(spark.createDataFrame([(1, 2), (2, 1)], "node_id long, parent_id long"))


def test_word_grams_of_a_long_text(spark):
    import time

    began = time.monotonic()
    rows = spark.createDataFrame([(1, " ".join(f"w{i % 60_000}" for i in range(100_000)))], "doc_id long, text string")
    from strandlore.operators import provenance

    assert provenance.word_grams(rows, "doc_id", "text", 13).count() == 60_000 and time.monotonic() - began < 60


def test_renumber_over_many_ranges(spark):
    from strandlore.operators import training

    rows = spark.range(0, 5000).selectExpr("id * 3 as c").repartition(7)
    got = {r.c: r.new_cluster for r in training.renumber(rows.union(rows), "c").collect()}
    assert got == {3 * i: i for i in range(5000)}


def test_queries_meet_all_rows_in_blocks(spark, monkeypatch):
    from strandlore.operators import vectors

    monkeypatch.setattr(vectors, "QUERY_BLOCK", 4)
    met = vectors.against(spark.range(0, 50).selectExpr("id", "id as x"), spark.range(0, 21).selectExpr("id as query_id", "id as q"), "query_id", "q")
    assert met.columns == ["id", "x", "query_id", "q"]
    assert {(r.id, r.query_id) for r in met.collect()} == {(i, q) for i in range(50) for q in range(21)} and met.count() == 50 * 21


def test_idle_steps(spark):
    from strandlore.operators import lifecycle

    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 4), ("b", 3), ("b", 3)], "k string, day int")
    assert {(r.k, r.streak, r.prune) for r in lifecycle.idle_steps(rows, "k", "day", 2).collect()} == {("a", 2, True), ("b", 1, False), ("c", 0, False)}
