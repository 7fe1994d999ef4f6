"""Quality, tagging, routing and lattice queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from strandlore.functions import text as X
from strandlore.operators.points import nearest
from strandlore.plans.base import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def _hits(expr: str, signals: list[str]) -> str:
    quoted = [s.replace("'", "''") for s in signals]
    return "(" + " + ".join(f"(CASE WHEN contains({expr}, '{s}') THEN 1 ELSE 0 END)" for s in quoted) + ")"


_QUALITY = f"""
  s AS (SELECT doc_id, trim(text, E' \\n\\t\\r') AS t FROM documents),
  p AS (SELECT doc_id, t, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+') AS w FROM s),
  m AS (SELECT doc_id, len(w)::DOUBLE AS n, len(list_distinct(w))::DOUBLE AS u, greatest(length(t), 1) AS size,
          (length(t) - length(replace(t, chr(10), '')))::DOUBLE AS lines,
          (length(t) - length(translate(t, '{{}}[]<>', '')))::DOUBLE AS brackets,
          {_hits('t', X.CODE_KEYWORDS)}::DOUBLE AS code FROM p),
  g AS (SELECT doc_id, round(least(n / 128.0, 1.0), 6) AS length_signal,
          round(CASE WHEN n > 0 THEN u / n ELSE 0 END, 6) AS diversity,
          round(1.0 - least(greatest(1.0 - CASE WHEN n > 0 THEN u / n ELSE 0 END, 0.0), 0.75), 6) AS repetition,
          round(least(least(lines / 8.0, 1.0) + least(code / 4.0, 1.0), 1.0), 6) AS structure,
          round(least(brackets / size, 0.3), 6) AS punctuation, 0.0::DOUBLE AS improvement FROM m),
  q AS (SELECT *, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.28::DOUBLE * length_signal + 0.26::DOUBLE * diversity + 0.18::DOUBLE * repetition + 0.18::DOUBLE * structure
          + 0.16::DOUBLE * improvement - 0.08::DOUBLE * punctuation)), 6) AS quality_score FROM g)
"""


def _scored(t):
    return t.documents.select("doc_id", X.quality(F.col("text")).alias("q")).select("doc_id", "q.*")


@R.add(f"WITH {_QUALITY} SELECT doc_id, length_signal, diversity, repetition, structure, punctuation, improvement, quality_score FROM q")
def quality_score(t):
    return _scored(t)


@R.add(f"""WITH {_QUALITY} SELECT doc_id, quality_score, CAST(row_number() OVER (ORDER BY quality_score DESC, doc_id) AS INTEGER) AS position
FROM q WHERE quality_score >= 0.5 ORDER BY position LIMIT 100""")
def curriculum(t):
    """Top of the curriculum; a top-k report, so the limit is the feature."""
    best = _scored(t).where("quality_score >= 0.5").select("doc_id", "quality_score").orderBy(F.desc("quality_score"), "doc_id").limit(100)
    return best.withColumn("position", F.row_number().over(Window.orderBy(F.desc("quality_score"), "doc_id")))


@R.add(f"""WITH {_QUALITY} SELECT quality, count(*) AS n, round(avg(quality_score), 4) AS mean_score FROM q JOIN labels USING (doc_id) GROUP BY quality""")
def quality_vs_labels(t):
    return _scored(t).join(t.labels, "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg("quality_score"), 4).alias("mean_score"))


def _role(expr: str) -> str:
    return f"""(CASE WHEN {_hits(expr, X.ROLE_CODE_SIGNALS)} >= 3 THEN 2 WHEN {_hits(expr, X.ROLE_MATH_SIGNALS)} >= 2 THEN 3
               WHEN {_hits(expr, X.ROLE_QA_SIGNALS)} >= 2 THEN 5 ELSE 1 END)"""


_COLOR = f"""
  c0 AS (SELECT doc_id, text, lower(substr(text, 1, 2000)) AS low, regexp_extract_all(text, '[a-zA-Z0-9]+') AS w, sha256(substr(text, 1, 512)) AS h FROM documents),
  c1 AS (SELECT doc_id, {_role('low')} AS hierarchy, ('0x' || substr(h, 1, 2))::INTEGER AS r, len(w) AS n,
           len(list_distinct(list_transform(w, lambda x: lower(x)))) AS u, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::DOUBLE AS chars FROM c0),
  c2 AS (SELECT doc_id, hierarchy, r, CASE WHEN n = 0 THEN 0 ELSE trunc((0.5::DOUBLE * least(1.0::DOUBLE, chars / n / 12.0::DOUBLE) + 0.5::DOUBLE * (u / n)) * 255.0::DOUBLE)::INTEGER END AS g,
           trunc(n * 1.3::DOUBLE)::BIGINT AS tokens FROM c1),
  color AS (SELECT doc_id, hierarchy, r, least(255, greatest(0, g)) AS g, CASE WHEN tokens <= 0 THEN 0 ELSE least(255, trunc(log2(tokens) * 16)::INTEGER) END AS b FROM c2),
  packed AS (SELECT *, (hierarchy::BIGINT << 24) | (r::BIGINT << 16) | (g::BIGINT << 8) | b::BIGINT AS packed FROM color)
"""


def _colors(t):
    return t.documents.select("doc_id", X.color_parts(F.col("text")).alias("c")).withColumn("packed", X.pack_color(F.col("c")))


@R.add(f"WITH {_COLOR} SELECT doc_id, hierarchy, r, g, b, packed FROM packed")
def color_tag(t):
    return _colors(t).select("doc_id", "c.*", "packed")


@R.add(f"WITH {_COLOR} SELECT doc_id, packed, CAST(row_number() OVER (ORDER BY packed, doc_id) AS BIGINT) AS position FROM packed")
def color_sort(t):
    """Global positions without a single sorting task: sizes of the colour classes are prefix-summed, rows numbered within."""
    rows = _colors(t).select("doc_id", "packed", F.shiftright("packed", 16).alias("_class"))
    before = Window.orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_class").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_class").orderBy("packed", "doc_id"))
    return rows.withColumn("_nth", within).join(sizes, "_class").select("doc_id", "packed", (F.col("_before") + F.col("_nth")).alias("position"))


@R.add(f"WITH {_COLOR} SELECT doc_id, ((packed >> 24) & 255)::INTEGER AS hierarchy, ((packed >> 16) & 255)::INTEGER AS r, ((packed >> 8) & 255)::INTEGER AS g, (packed & 255)::INTEGER AS b FROM packed")
def color_unpack(t):
    return _colors(t).select("doc_id", X.unpack_color(F.col("packed")).alias("u")).select("doc_id", "u.*")


@R.add(f"""WITH {_COLOR}, d AS (
  SELECT q.doc_id AS query_id, c.doc_id, (CASE WHEN q.hierarchy = c.hierarchy THEN 0 ELSE 1024 END
         + (q.r - c.r) * (q.r - c.r) + (q.g - c.g) * (q.g - c.g) + (q.b - c.b) * (q.b - c.b))::INTEGER AS distance
  FROM packed q, packed c WHERE q.doc_id % 100 = 0)
SELECT query_id, doc_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS INTEGER) AS rank FROM d QUALIFY rank <= 5""")
def color_nearest(t):
    """Five nearest colours of every query of a stated set, by cells of the colour space."""
    colors = _colors(t).select(F.col("doc_id").alias("item_id"), F.col("c").alias("p"))
    found = nearest(colors, F.col("item_id") % 100 == 0, 5, X.color_distance, ["r", "g", "b"], "hierarchy", 0, 8, 2)
    return found.withColumnRenamed("item_id", "doc_id")


@R.add(f"""WITH {_COLOR}, u AS (SELECT doc_id, r / 255.0::DOUBLE AS rf, g / 255.0::DOUBLE AS gf, b / 255.0::DOUBLE AS bf FROM packed),
 x AS (SELECT *, greatest(rf, gf, bf) AS mx, greatest(rf, gf, bf) - least(rf, gf, bf) AS delta FROM u),
 y AS (SELECT doc_id, CASE WHEN delta = 0 THEN 0.0 WHEN mx = rf THEN 60.0::DOUBLE * ((((gf - bf) / delta) % 6.0::DOUBLE + 6.0::DOUBLE) % 6.0::DOUBLE)
   WHEN mx = gf THEN 60.0::DOUBLE * ((bf - rf) / delta + 2.0::DOUBLE) ELSE 60.0::DOUBLE * ((rf - gf) / delta + 4.0::DOUBLE) END AS a FROM x)
 SELECT doc_id, round(CASE WHEN a < 0 THEN a + 360.0 ELSE a END, 6) AS hue FROM y""")
def color_hue(t):
    return _colors(t).select("doc_id", F.round(X.hue(F.col("c")), 6).alias("hue"))


_LATTICE = """
  l0 AS (SELECT doc_id, text, sha256(substr(text, 1, 512)) AS h, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
  l1 AS (SELECT doc_id, ('0x' || substr(h, 1, 4))::INTEGER - 32768 AS topic, greatest(len(w), 1) AS n, len(list_distinct(list_transform(w, lambda x: lower(x)))) AS u,
           coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::DOUBLE AS chars, greatest(length(text), 1) AS size FROM l0),
  lattice AS (SELECT doc_id, greatest(-1000, least(1000, floor(topic / 33.0::DOUBLE)::INTEGER)) AS x,
           greatest(-1000, least(1000, trunc((u / n) * least(1.0::DOUBLE, chars / n / 10.0::DOUBLE) * 2000 - 1000)::INTEGER)) AS y,
           greatest(-1000, least(1000, trunc((trunc(n * 1.3::DOUBLE)::BIGINT / size - 0.3::DOUBLE) * 5000)::INTEGER)) AS z, 0 AS layer FROM l1)
"""


@R.add(f"WITH {_LATTICE} SELECT doc_id, x, y, z, layer FROM lattice")
def lattice_place(t):
    return t.documents.select("doc_id", X.lattice(F.col("text")).alias("p")).select("doc_id", "p.*")


@R.add(f"""WITH {_LATTICE}, d AS (SELECT q.doc_id AS query_id, c.doc_id, (abs(q.x - c.x) + abs(q.y - c.y) + abs(q.z - c.z))::INTEGER AS distance
  FROM lattice q, lattice c WHERE q.doc_id % 100 = 0)
SELECT query_id, doc_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS INTEGER) AS rank FROM d QUALIFY rank <= 5""")
def lattice_nearest(t):
    """Five nearest lattice points of every query of a stated set, by cells of the lattice."""
    points = t.documents.select(F.col("doc_id").alias("item_id"), X.lattice(F.col("text")).alias("p"))
    found = nearest(points, F.col("item_id") % 100 == 0, 5, X.lattice_distance, ["x", "y", "z"], "layer", -1024, 11, 1)
    return found.withColumnRenamed("item_id", "doc_id")


def _route_sql(source: str, key: str, text: str) -> str:
    return f"""
  r0 AS (SELECT {key}, substr({text}, 1, 3000) AS s FROM {source}),
  r1 AS (SELECT {key}, s, len(regexp_extract_all(s, '{X.ROUTE_CODE}')) / greatest(length(s), 1)::DOUBLE * 1000 AS code,
           len(regexp_extract_all(s, '{X.ROUTE_MATH}')) / greatest(length(s), 1)::DOUBLE * 1000 AS reasoning,
           len(regexp_extract_all(s, '{X.ROUTE_QA}')) / greatest(length(s), 1)::DOUBLE * 1000 AS qa FROM r0),
  r2 AS (SELECT {key}, CASE WHEN greatest(code, reasoning, qa) > 0.5 THEN CASE greatest(code, reasoning, qa) WHEN code THEN 'code' WHEN reasoning THEN 'reasoning' ELSE 'qa' END
           WHEN {_hits('lower(s)', X.TEXTBOOK_WORDS)} > 0 THEN 'textbook' ELSE 'generic' END AS pipeline, greatest(code, reasoning, qa) AS best FROM r1),
  routed AS (SELECT {key}, pipeline, CASE pipeline WHEN 'code' THEN 256 WHEN 'qa' THEN 256 WHEN 'reasoning' THEN 384 ELSE 512 END AS stride,
           CASE pipeline WHEN 'code' THEN 'function_boundary' WHEN 'qa' THEN 'turn_boundary' WHEN 'reasoning' THEN 'proof_step' WHEN 'textbook' THEN 'sentence_boundary' ELSE 'fixed_stride' END AS chunk_boundary,
           CASE pipeline WHEN 'textbook' THEN 0.6::DOUBLE WHEN 'generic' THEN 0.3::DOUBLE ELSE round(least(1.0::DOUBLE, best / 5.0::DOUBLE), 6) END AS confidence FROM r2)"""


@R.add(f"WITH {_route_sql('documents', 'doc_id', 'text')} SELECT doc_id, pipeline, stride, chunk_boundary, confidence FROM routed")
def route_pipeline(t):
    return t.documents.select("doc_id", X.route(F.col("text")).alias("r")).select("doc_id", "r.*")


@R.add(f"WITH {_route_sql('pages', 'page_id', 'html')} SELECT page_id, pipeline, stride, chunk_boundary, confidence FROM routed")
def route_pages(t):
    return t.pages.select("page_id", X.route(F.col("html")).alias("r")).select("page_id", "r.*")


@R.add(f"""WITH m AS (SELECT conv_id, turn, lower(trim(text, E' \\n\\t\\r')) AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN {_hits('t', X.MODE_CODE)} > 0 THEN 'code'
  WHEN suffix(t, '?') OR {' OR '.join(f"starts_with(t, '{w}')" for w in X.MODE_ASK)} THEN 'qa'
  WHEN {_hits('t', X.MODE_LOGIC)} > 0 THEN 'logic' ELSE 'narrative' END AS mode FROM m""")
def detect_mode(t):
    return t.conversations.select("conv_id", "turn", X.mode(F.col("text")).alias("mode"))


@R.add(f"SELECT {_role('lower(substr(text, 1, 2000))')} AS role, lang, count(*) AS n FROM documents GROUP BY ALL")
def role_counts(t):
    return t.documents.groupBy(X.role(F.col("text")).alias("role"), "lang").agg(F.count("*").alias("n"))


@R.add(f"""SELECT doc_id, CASE source WHEN 'src1' THEN 2 WHEN 'src2' THEN 5 ELSE {_role('lower(substr(text, 1, 2000))')} END AS role FROM documents""")
def role_with_hint(t):
    hint = F.when(F.col("source") == "src1", " Programming").when(F.col("source") == "src2", "dialogue").otherwise("other")
    return t.documents.select("doc_id", X.role(F.col("text"), hint).alias("role"))


@R.add("""SELECT doc_id, list_slice([lang, source, 'all'], 1, 2)[1] AS first_label, 2 AS n_labels, n_chars > 0 AS allowed FROM documents""")
def simple_route(t):
    """First two labels; allowed if any capability is held."""
    labels = F.slice(F.array("lang", "source", F.lit("all")), 1, 2)
    caps = F.when(F.col("n_chars") > 0, F.array(F.lit("read"))).otherwise(F.array().cast("array<string>"))
    return t.documents.select("doc_id", labels[0].alias("first_label"), F.size(labels).alias("n_labels"), (F.size(caps) > 0).alias("allowed"))


@R.add("""WITH r AS (SELECT doc_id, length(text) AS n FROM documents)
SELECT doc_id, g * 512 AS window_start, least(512, n - g * 512) AS window_length FROM r, unnest(range(0, greatest(CAST(ceil(n / 512.0) AS BIGINT), 1))) AS u(g)""")
def stride_windows(t):
    n = F.length("text").cast("long")
    steps = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(n / 512.0), F.lit(1)) - 1)
    return t.documents.select("doc_id", n.alias("n"), F.explode(steps).alias("g")).select("doc_id", (F.col("g") * 512).alias("window_start"), F.least(F.lit(512).cast("long"), F.col("n") - F.col("g") * 512).alias("window_length"))
