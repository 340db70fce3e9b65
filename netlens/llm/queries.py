"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netlens.llm.linededup import dedup_lines

    rows = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    place = lambda x: F.concat_ws(":", x["line"], x["doc_id"], x["first_line"])
    classes = F.coalesce(F.array_join(F.transform("_dropped", place), ","), F.lit(""))
    return rows.select(
        "doc_id", F.col("_lines").alias("n_lines"), F.col("_gone").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), classes.alias("dropped")
    )


def op6_spherical_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netlens.llm.capfilter import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netlens.llm.ngram_join import ngram_components

    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, (90, 100)).drop("text_hash")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netlens.llm.pii import pii_spans

    found = pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.sha2("sanitised", 256).alias("sanitised_sha256"),
    )


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netlens.llm.mixing import mix

    rows = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    taken = F.col("_whole") * F.col("_size") + F.col("_part")
    return rows.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken.alias("taken"))


def op3_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netlens.llm.warc import round_trip

    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netlens.llm.secrets import secret_spans

    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op8_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netlens.llm.toxicity import score, train

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netlens.llm.avi import media_columns

    found = media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    clip = lambda c: F.concat_ws("-", c["first"], c["last"])
    return found.withColumn("feature", F.concat(F.lit("shots:"), F.array_join(F.transform("clips", clip), ","))).drop("clips")


def op10_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netlens.llm.packing import pack

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_sanitise": op1_pii_sanitise,
    "op2_mix_sources": op2_mix_sources,
    "op3_warc_zstd": op3_warc_zstd,
    "op4_secret_scan": op4_secret_scan,
    "op5_line_dedup": op5_line_dedup,
    "op6_spherical_cap_filters": op6_spherical_cap_filters,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_ordinal_toxicity": op8_ordinal_toxicity,
    "op9_avi_media": op9_avi_media,
    "op10_hierarchical_packing": op10_hierarchical_packing,
}

_REACH = """
reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
root AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""

ORACLE_SQL: dict[str, str] = {
    "op2_mix_sources": """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
  md5('20240607:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS most FROM s),
f AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(most) OVER up, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER up, 0)) AS level FROM w
  WINDOW up AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN most <= level * weight THEN most ELSE weight * (SELECT arg_min(level, most / weight) FROM f WHERE most > level * weight) END AS target FROM f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
q AS (SELECT *, greatest(0, least(CAST(round(target) AS BIGINT) - whole * source_size, source_size)) AS rest FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(whole * size + greatest(0, least(size,
  rest - coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source""",
    "op3_warc_zstd": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS h, max(page_id) OVER (PARTITION BY payload) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h || '000', 5 * i // 4 + 1, 3) AS INT) >> (7 - 5 * i % 4)) & 31), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM d""",
    "op6_spherical_cap_filters": f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
links AS (SELECT x.id AS a, y.id AS b FROM nodes x JOIN nodes y ON x.id <> y.id AND list_cosine_similarity(x.v, y.v) >= 0.9), {_REACH}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE links.a = root.id) AS n_links, component_id, id = component_id AS kept FROM root""",
    "op7_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS t FROM documents),
nodes AS (SELECT id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')] ELSE list_distinct([t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] FOR i IN range(1, len(t) - 1)]) END AS s FROM w),
g AS (SELECT id, len(s) AS n, unnest(s) AS x FROM nodes),
links AS (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.x = b.x AND a.id <> b.id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))), {_REACH}
SELECT id AS doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM root JOIN nodes USING (id)""",
}
