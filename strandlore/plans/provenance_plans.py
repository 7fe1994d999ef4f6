"""Provenance and chunk queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlore.operators import provenance
from strandlore.plans.base import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


#: Documents asked for; all others form the index.
def probe():
    return F.col("doc_id") % 10 == 0

_CHUNKS = """
  probe AS (SELECT doc_id, text FROM documents WHERE doc_id % 10 = 0),
  idx AS (SELECT doc_id, text FROM documents WHERE doc_id % 10 <> 0),
  pc AS (SELECT doc_id AS query_id, substr(text, CAST(g * 256 + 1 AS BIGINT), 256) AS c
         FROM probe, unnest(range(0, greatest(CAST(ceil(length(text) / 256.0) AS BIGINT), 1))) AS u(g)),
  ic AS (SELECT DISTINCT doc_id AS origin_id, substr(text, CAST(g * 256 + 1 AS BIGINT), 256) AS c
         FROM idx, unnest(range(0, greatest(CAST(ceil(length(text) / 256.0) AS BIGINT), 1))) AS u(g)),
  exact AS (SELECT DISTINCT p.doc_id AS query_id, i.doc_id AS origin_id FROM probe p JOIN idx i ON sha256(p.text) = sha256(i.text)),
  totals AS (SELECT query_id, count(*) AS total_chunks FROM pc GROUP BY 1),
  hits AS (SELECT query_id, origin_id, count(*) AS matched_chunks
           FROM (SELECT DISTINCT query_id, c FROM pc) JOIN ic USING (c) GROUP BY 1, 2)
"""


@R.add(f"""WITH {_CHUNKS},
  found AS (
    SELECT query_id, origin_id, 'exact' AS match_kind, CAST(NULL AS BIGINT) AS matched_chunks, CAST(NULL AS BIGINT) AS total_chunks, 1.0::DOUBLE AS confidence FROM exact
    UNION ALL
    SELECT query_id, origin_id, 'chunk_overlap', matched_chunks, total_chunks, least(round(matched_chunks / total_chunks, 6), 0.95)
    FROM hits JOIN totals USING (query_id) ANTI JOIN exact USING (query_id, origin_id))
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, origin_id) AS INTEGER) AS rank FROM found""")
def provenance_resolve(t):
    return provenance.resolve(t.documents.where(probe()), t.documents.where(~probe()))


@R.add(f"WITH {_CHUNKS} SELECT * FROM exact")
def provenance_exact(t):
    return provenance.exact_matches(t.documents.where(probe()), t.documents.where(~probe()), "doc_id", "text")


@R.add(f"WITH {_CHUNKS} SELECT query_id, origin_id, matched_chunks, total_chunks FROM hits JOIN totals USING (query_id)")
def provenance_overlap(t):
    return provenance.overlap_counts(t.documents.where(probe()), t.documents.where(~probe()), "doc_id", "text", 256)
