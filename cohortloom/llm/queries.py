"""Registered queries of the operators: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import (
    decontaminate,
    language_model,
    lexical_scan,
    line_dedup,
    packing,
    quality_rules,
    simhash,
    suffix_dedup,
    token_counts,
    token_shards,
    va_file,
    warc,
    weak_labels,
)
from cohortloom.llm.common import read


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of 50 words that repeat; spans of words as start-stop, stop excluded."""
    found = suffix_dedup.repeated_spans(read(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["stop"])), " ")
    return found.select("doc_id", text("spans").alias("spans"), text("later").alias("later"))


def op2_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.classify(read(spark, sf_dir, "documents"))


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op4_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(read(spark, sf_dir, "documents"))


def op6_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(warc.mark_revisits(read(spark, sf_dir, "pages")))
    return warc.page_rows(warc.read_archives(archives, with_payload=False))


def op8_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_shards.write_shards(read(spark, sf_dir, "documents"),
                                         public_tokenizers.path("byte_bpe_50k.json"))
    return token_shards.read_shards(manifest)


def op11_lexical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_scan.top_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op13_va_file_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_file.cluster(read(spark, sf_dir, "embeddings"))


def clustering_sql(k: int = 40, rounds: int = 5) -> str:
    """DuckDB statement for op13, its rounds written out."""
    parts = [f"""
kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
x AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM kept),
c0 AS (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, unnest(v) AS x, generate_subscripts(v, 1) AS d
  FROM (SELECT v, sha256('2:' || vec_id) AS h FROM kept ORDER BY h LIMIT {k}))"""]
    for n in range(rounds + 1):
        parts.append(f"""
a{n} AS (
  SELECT vec_id, c AS cluster, CAST(s AS BIGINT) AS distance FROM (
    SELECT vec_id, c, sum((x.x - c{n}.x) * (x.x - c{n}.x)) AS s FROM x JOIN c{n} USING (d) GROUP BY vec_id, c)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s, c) = 1)""")
        if n < rounds:
            parts.append(f"""
m{n} AS (
  SELECT cluster AS c, d, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
  FROM a{n} JOIN x USING (vec_id) GROUP BY cluster, d),
c{n + 1} AS (SELECT c, coalesce(m{n}.x, c{n}.x) AS x, d FROM c{n} LEFT JOIN m{n} USING (c, d))""")
    return f"""WITH {",".join(parts)},
names AS (SELECT c AS cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance,
  CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN names USING (cluster)"""


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("op") and name[2:3].isdigit()}
ORACLES: dict[str, str] = {
    "op1_suffix_array_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents),
passages AS (
  SELECT doc_id, i, array_to_string(ws[i + 1:i + 50], ' ') AS p
  FROM (SELECT doc_id, ws, unnest(range(len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50)),
twice AS (
  SELECT doc_id, i, (doc_id, i) <> min((doc_id, i)) OVER (PARTITION BY p) AS later
  FROM passages QUALIFY count(*) OVER (PARTITION BY p) > 1),
kinds AS (SELECT doc_id, i, 'spans' AS kind FROM twice UNION ALL SELECT doc_id, i, 'later' FROM twice WHERE later),
gaps AS (
  SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id, kind ORDER BY i) <= 50 THEN 0 ELSE 1 END AS opens FROM kinds),
islands AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, kind ORDER BY i) AS n FROM gaps),
spans AS (SELECT doc_id, kind, n, min(i) AS a, max(i) + 50 AS b FROM islands GROUP BY ALL)
SELECT doc_id, coalesce(string_agg(a || '-' || b, ' ' ORDER BY a) FILTER (WHERE kind = 'spans'), '') AS spans,
  coalesce(string_agg(a || '-' || b, ' ' ORDER BY a) FILTER (WHERE kind = 'later'), '') AS later
FROM spans GROUP BY doc_id""",
    "op7_warc_salvage": """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
f AS (SELECT *, strlen(payload) AS n, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest,
  CASE WHEN n >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > first_id THEN first_id END AS refers_to FROM f""",
    "op11_lexical_scan": r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
lengths AS (SELECT doc_id, CAST(len(terms) AS BIGINT) AS n FROM split WHERE len(terms) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
counts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM split) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
  FROM counts, totals GROUP BY term, docs),
wanted AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // totals.terms)))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id), totals GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20""",
    "op12_line_dedup": r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM split)),
common AS (
  SELECT key, max(doc_id) AS largest FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
told AS (SELECT doc_id, i, line, coalesce(doc_id <> largest, false) AS goes FROM lines LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT goes), '')) AS kept_sha256
FROM told GROUP BY doc_id""",
    "op13_va_file_clusters": clustering_sql(),
}
