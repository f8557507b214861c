"""The registered queries of this subpackage, one ``opN_<name>`` for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bisectors, bpe_codec, chat, divergence, langid, packing, pii, quality, secrets, simhash, substring_dedup, token_counts
from .common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"),
    )
    return chat.read_back(chat.format_chats(chats.unionByName(tricky)))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(table(spark, sf_dir, "documents"))


def op11_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op12_bisectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bisectors.cluster(table(spark, sf_dir, "embeddings"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def _bisectors_sql(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    """Distances to all centroids in each round, of which the least counts."""
    steps = [f"""WITH v AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) - 1 AS r, vec_id, q FROM (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})),
c0 AS (SELECT r AS cluster, q AS c FROM v WHERE r < {k})"""]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS (
  SELECT r, min({{'d': d, 'cluster': cluster}}) AS best FROM (
    SELECT r, cluster, CAST(list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{n}) GROUP BY r)""")
        if n < rounds:
            steps.append(f"""m{n} AS (
  SELECT best.cluster AS cluster, i, sum(q[i]) AS s, count(*) AS n FROM a{n} JOIN v USING (r), range(1, {dims + 1}) AS dim(i) GROUP BY ALL),
l{n} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM m{n} GROUP BY cluster),
c{n + 1} AS (SELECT cluster, coalesce(l{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN l{n} USING (cluster))""")
    return ",\n".join(steps) + f"""
SELECT vec_id, CAST(best.cluster AS INT) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} ON c{rounds}.cluster = best.cluster"""


#: Every kept term with every pair of sources; nothing is left out or corrected.
_DIVERGENCE_SQL = r"""WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
lt AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS total FROM kept GROUP BY lang),
gt AS (SELECT lang, source, CAST(sum(c.n) AS BIGINT) AS total FROM c JOIN kept USING (lang, term) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, kept.n AS all_n,
    1 + CAST((1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(gt.total, 0) + lt.v) AS BIGINT) AS p, 1 + CAST((1000000000::HUGEINT * (kept.n + 1)) // (lt.total + lt.v) AS BIGINT) AS q
  FROM g JOIN kept USING (lang) JOIN lt USING (lang) LEFT JOIN gt ON gt.lang = g.lang AND gt.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pairs AS (
  SELECT g.lang, g.source, o.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g JOIN g AS o ON o.lang = g.lang AND o.source <> g.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
    FROM p AS x JOIN p AS y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL) AS s
    ON s.lang = g.lang AND s.source = g.source AND s.item = o.source),
terms AS (
  SELECT lang, source, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM terms
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= 200"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_packing, op2_chat_format, op3_pii, op4_quality_rules, op5_simhash,
        op6_run_index, op7_secrets, op8_token_counts, op9_nn_descent, op10_bpe_codec,
        op11_langid, op12_bisectors, op13_divergence,
    ]
    return {q.__name__: q for q in found}


def oracle_sql() -> dict[str, str]:
    return {"op12_bisectors": _bisectors_sql(), "op13_divergence": _DIVERGENCE_SQL}
