"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import decontaminate, fingerprint, language, neardup, packing, pages, rollups, sharding, suffix, toxicity

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_packing": packing.op2_packing,
    "op3_fingerprints": fingerprint.op3_fingerprints,
    "op4_html": pages.op4_html,
    "op5_suffix": suffix.op5_suffix,
    "op6_neardup": neardup.op6_neardup,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_token_counts": rollups.op9_token_counts,
    "op10_language": language.op10_language,
}

#: Exact pairs on full shingle sets, then the smallest id reachable.
NEARDUP = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE
    WHEN len(w) = 0 THEN []::VARCHAR[]
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), entries AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS v FROM sets
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS m, any_value(b.n) AS n
  FROM entries a JOIN entries b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs WHERE 100 * c >= 85 * (m + n - c)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON r.other = b.x
), component AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN component USING (doc_id)
"""

#: Every 50-byte window (as hex), the smallest document that holds it, and the runs it covers.
SUFFIX = """
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), segments AS (
  SELECT doc_id, p, substr(h, (2 * p + 1)::BIGINT, 2 * (256 + 49)) AS part FROM (SELECT doc_id, h, unnest(range(0, n, 256)) AS p FROM docs)
), windows AS (
  SELECT doc_id, p + k AS k, substr(part, (2 * k + 1)::BIGINT, 100) AS w
  FROM (SELECT doc_id, p, part, unnest(range(least(256, length(part) // 2 - 49))) AS k FROM segments)
), firsts AS (
  SELECT w, min(doc_id) AS lo FROM windows GROUP BY w HAVING count(*) > 1
), gone AS (
  SELECT doc_id, k FROM windows JOIN firsts USING (w) WHERE lo < doc_id
), marked AS (
  SELECT doc_id, k, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) <= 50 THEN 0 ELSE 1 END AS fresh FROM gone
), numbered AS (
  SELECT doc_id, k, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM marked
), runs AS (
  SELECT doc_id, min(k) AS a, max(k) + 50 AS b FROM numbered GROUP BY doc_id, run
), pieces AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs
), kept AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS tail,
    string_agg(substr(h, (2 * before + 1)::BIGINT, (2 * (a - before))::BIGINT), '' ORDER BY a) AS head
  FROM pieces JOIN docs USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_removed IS NULL THEN h ELSE head || substr(h, (2 * tail + 1)::BIGINT) END)) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

ORACLES: dict[str, str] = {"op5_suffix": SUFFIX, "op6_neardup": NEARDUP}
