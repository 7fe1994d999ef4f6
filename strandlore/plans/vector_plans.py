"""Vector, codec and BPE queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlore.operators import bpe, codecs, vectors as V
from strandlore.plans.base import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

_E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_COS = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"


def _items(t):
    return t.embeddings.select(F.col("vec_id").alias("item_id"), V.wide("embedding").alias("v"), "label")


def _queries(t):
    return t.embeddings.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), V.wide("embedding").alias("q"))


def _top_sql(score: str, where: str = "true") -> str:
    return f"""WITH {_E}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, b.label, round({score}, 6) AS score FROM e a, e b WHERE a.vec_id % 100 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id, item_id // 128 ORDER BY score DESC, item_id) AS n FROM s), f AS (SELECT * FROM r WHERE n <= 10 AND {where})
SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INTEGER AS rank FROM f QUALIFY rank <= 10"""


@R.add(_top_sql(_COS))
def vector_topk_cosine(t):
    return V.top_k(_items(t), _queries(t), 10, shard=F.floor(F.col("item_id") / 128))


@R.add(_top_sql("list_dot_product(a.v, b.v)"))
def vector_topk_dot(t):
    return V.top_k(_items(t), _queries(t), 10, "dot", shard=F.floor(F.col("item_id") / 128))


@R.add(_top_sql(_COS, "label = 3"))
def vector_topk_filtered(t):
    return V.top_k(_items(t), _queries(t), 10, keep=F.col("label") == 3, shard=F.floor(F.col("item_id") / 128))


_MEANS = f"""{_E}, x AS (SELECT label, i, avg(v[i]) AS m FROM e, unnest(range(1, 65)) AS u(i) GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY i) AS centroid FROM x GROUP BY 1)"""


@R.add(f"WITH {_MEANS} SELECT label, (i - 1)::INTEGER AS component, round(m, 6) AS mean FROM x")
def centroid_mean(t):
    means = V.centroids(t.embeddings, "label", "embedding")
    return means.select("label", F.posexplode("centroid").alias("component", "mean")).withColumn("mean", F.round("mean", 6))


@R.add("WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT count(*) AS clusters, min(n) AS size_min, max(n) AS size_max, round(avg(n), 4) AS size_mean, round(max(n) / greatest(min(n), 1), 4) AS size_ratio FROM s")
def cluster_stats(t):
    return V.cluster_stats(t.embeddings, "label")


@R.add(f"""WITH {_MEANS}, d AS (SELECT vec_id, c.label AS nearest, list_sum(list_transform(range(1, 65), lambda i: (e.v[i] - c.centroid[i]) * (e.v[i] - c.centroid[i]))) AS d FROM e, c)
SELECT vec_id, arg_min(nearest, d) AS nearest, round(min(d), 6) AS distance FROM d GROUP BY 1""")
def assign_step(t):
    means = V.centroids(t.embeddings, "label", "embedding")
    return V.assign(t.embeddings, means, "vec_id", "embedding", "label").withColumn("distance", F.round("distance", 6))


def _hidden(t):
    return F.array(*[F.lit(((i * 7) % 11 - 5) / 5.0) for i in range(64)])


_H = "[" + ", ".join(f"{((i * 7) % 11 - 5) / 5.0}::DOUBLE" for i in range(64)) + "]"


@R.add(f"""WITH {_MEANS}, l AS (SELECT label, list_dot_product(centroid, {_H}) AS logit FROM c), p AS (SELECT label, logit, exp(logit - max(logit) OVER ()) / sum(exp(logit - (SELECT max(logit) FROM l))) OVER () AS cp, row_number() OVER (ORDER BY logit DESC, label) AS r FROM l),
 m AS (SELECT vec_id, e.label, cp, list_dot_product(v, {_H}) AS ml FROM e JOIN p USING (label) WHERE r <= 3), mx AS (SELECT label, max(ml) AS top FROM m GROUP BY 1),
 t AS (SELECT vec_id, label, cp, exp(ml - top) / sum(exp(ml - top)) OVER (PARTITION BY label) AS tp FROM m JOIN mx USING (label))
SELECT vec_id, label, round(cp, 6) AS cluster_prob, round(tp, 6) AS token_prob, round(cp * tp, 6) AS probability FROM t""")
def hierarchical_softmax(t):
    out = V.hierarchical_softmax(t.embeddings, "vec_id", "label", "embedding", _hidden(t), 3)
    return out.select("vec_id", "label", *[F.round(c, 6).alias(c) for c in ("cluster_prob", "token_prob", "probability")])


@R.add(f"""WITH {_MEANS}, k AS (SELECT label FROM c ORDER BY list_dot_product(centroid, {_H}) DESC, label LIMIT 2), b AS (SELECT vec_id, v, list_dot_product(v, {_H}) AS s FROM e WHERE label IN (SELECT label FROM k) OR label = 0 ORDER BY s DESC, vec_id LIMIT 8),
 w AS (SELECT v, exp(s - (SELECT max(s) FROM b)) / (SELECT sum(exp(s - (SELECT max(s) FROM b))) FROM b) AS w FROM b)
SELECT (i - 1)::INTEGER AS component, round(sum(w * v[i]), 6) AS value FROM w, unnest(range(1, 65)) AS u(i) GROUP BY 1""")
def attention(t):
    return V.attention(t.embeddings, "vec_id", "label", "embedding", _hidden(t), 2, 8, [0]).withColumn("value", F.round("value", 6))


@R.add("""SELECT count(DISTINCT vec_id) FILTER (vec_id % 7 = 0) AS unique_tokens, count(DISTINCT label) FILTER (vec_id % 7 = 0) AS active_clusters, count(*) * 64 AS standard_params,
 (count(DISTINCT vec_id) FILTER (vec_id % 7 = 0) + count(DISTINCT label) FILTER (vec_id % 7 = 0)) * 64 AS sparse_params,
 round(1 - (count(DISTINCT vec_id) FILTER (vec_id % 7 = 0) + count(DISTINCT label) FILTER (vec_id % 7 = 0)) * 64 / (count(*) * 64), 6) AS savings_ratio FROM embeddings""")
def update_savings(t):
    """The batch touches every seventh token, by definition."""
    return V.update_savings(t.embeddings.where("vec_id % 7 = 0"), t.embeddings, "vec_id", "label", 64)


@R.add("SELECT vec_id FROM embeddings WHERE vec_id % 9 = 0 OR vec_id % 50 = 1")
def incremental_diff(t):
    """Snapshot: every ninth vector moved by 1e-3, every fiftieth (from 1) missing; moves of 1e-9 don't count."""
    nudge = F.when(F.col("vec_id") % 9 == 0, 1e-3).otherwise(1e-9)
    old = t.embeddings.where("vec_id % 50 <> 1").select("vec_id", F.transform("embedding", lambda x: x.cast("double") + nudge).alias("embedding"))
    return V.changed(t.embeddings, old, "vec_id", "embedding")


@R.add(f"WITH {_MEANS} SELECT e.label, vec_id, (i - 1)::INTEGER AS component, round(v[i] - m, 6) AS residual FROM e JOIN x USING (label) WHERE abs(v[i] - m) > 1e-6")
def shared_gradient(t):
    return V.shared_gradient(t.embeddings, "label", "vec_id", "embedding").withColumn("residual", F.round("residual", 6))


@R.add(f"""WITH {_E}, m AS (SELECT vec_id, v, list_sum(v) / len(v) AS c FROM e), r AS (SELECT vec_id, c, list_transform(v, lambda x: x - c) AS r FROM m), s AS (SELECT *, list_max(list_transform(r, lambda x: abs(x))) / 127.0::DOUBLE AS scale FROM r)
SELECT vec_id, round(c, 6) AS centroid, round(scale, 8) AS scale, list_sum(list_transform(r, lambda x: round_even(x / scale, 0)))::BIGINT AS code_sum, list_max(list_transform(r, lambda x: abs(round_even(x / scale, 0))))::INTEGER AS code_max FROM s""")
def int8_residual(t):
    rows = t.embeddings.select("vec_id", codecs.int8_residual(V.wide("embedding")).alias("c"))
    total = F.aggregate("c.q", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("vec_id", F.round("c.centroid", 6).alias("centroid"), F.round("c.scale", 8).alias("scale"), total.alias("code_sum"), F.array_max(F.transform("c.q", lambda x: F.abs(x))).alias("code_max"))


@R.add()
def polar_quant(t):
    return codecs.polar_quantise(t.embeddings, "vec_id", "embedding")


@R.add()
def fastcdc_chunks(t):
    return codecs.fastcdc(t.documents, "doc_id", "text", 256, 1024, 4096)


@R.add()
def text_embedding(t):
    return codecs.embed_texts(t.documents, "doc_id", "text")


@R.add("SELECT doc_id, strlen(text) AS raw_bytes, true AS intact FROM documents")
def zstd_round_trip(t):
    return codecs.zstd_sizes(t.documents, "doc_id", "text").select("doc_id", "raw_bytes", "intact")


@R.add()
def kmeans_fit(t):
    return V.lloyd(t.embeddings, "vec_id", "embedding", 10, 5)[1]


_WORDS = r"""w AS (SELECT unnest(regexp_extract_all(text, '[ \n\r\t()\[\]{},;:!?"''`]|[^ \n\r\t()\[\]{},;:!?"''`]+')) AS word FROM documents), f AS (SELECT word, count(*) AS freq FROM w GROUP BY 1)"""
_PAIRS = f"""{_WORDS}, h AS (SELECT freq, regexp_extract_all(hex(encode(word)), '[0-9A-F][0-9A-F]') AS ids FROM f),
 p AS (SELECT ('0x' || ids[i])::INTEGER AS a, ('0x' || ids[i + 1])::INTEGER AS b, sum(freq)::BIGINT AS n FROM h, unnest(range(1, len(ids))) AS u(i) GROUP BY ALL)"""


@R.add(f"WITH {_WORDS} SELECT word, freq FROM f")
def word_freq(t):
    return bpe.word_counts(t.documents, "text")


@R.add(f"WITH {_PAIRS} SELECT a, b, n FROM p")
def pair_counts(t):
    return bpe.byte_pair_counts(bpe.word_counts(t.documents, "text"))


@R.add(f"WITH {_PAIRS} SELECT a, b, n FROM p ORDER BY n DESC, a, b LIMIT 1")
def bpe_first_merge(t):
    return bpe.best_pair(pair_counts(t))


@R.add()
def bpe_train(t):
    """Eight merges over the whole corpus."""
    return t.spark.createDataFrame(bpe.train(t.documents, "text", 8), "a int, b int, new_id int, n long")
