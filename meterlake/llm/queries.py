"""The queries of these operators over the driver's tables, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, imatch, licenses, lm, quality, secrets, simhash, suffix_dedup
from .common import SPACE, read
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives
from .mixing import mix_sources
from .top_products import top_products
from .whitening import whiten

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path() -> str:
    """Where the public vocabulary files lie; they come with the machine."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"), keep="largest")


def token_digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded_text").cast("binary"), 256).alias("decoded_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(bpe.encode(read(spark, sf_dir, "documents"), vocabulary_path(), decoded=True))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source", "source_size", "target", "epochs", "taken")


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    scored = lm.score(read(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(read(spark, sf_dir, "documents"), licenses.known_licenses(spark))
    return found.withColumn("line_licenses", F.array_join("line_licenses", ","))


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_likeness(read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_scan(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in secrets.KINDS], F.sha2(secrets.listed("base"), 256).alias("base_sha256"), secrets.listed("spans").alias("spans"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=shifted)


def op13_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_bpe": op2_bpe,
    "op3_mixing": op3_mixing,
    "op4_lm_scores": op4_lm_scores,
    "op5_license_scan": op5_license_scan,
    "op6_imatch": op6_imatch,
    "op7_simhash": op7_simhash,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_secret_scan": op9_secret_scan,
    "op10_quality": op10_quality,
    "op11_whitening": op11_whitening,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_top_products": op13_top_products,
}


def _license_sql() -> str:
    """The canonical form once more, in the other engine's functions."""

    def form(c: str) -> str:
        out = f"regexp_replace(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{licenses.COPYRIGHT_LINE}', '', 'g')"
        out = f"regexp_replace({out}, '{SPACE}', ' ', 'g')"
        for spelling, one in licenses.EQUIVALENT:
            out = f"regexp_replace({out}, '{spelling}', '{one}', 'g')"
        return f"trim(regexp_replace({out}, '{licenses.OTHER}', ' ', 'g'), ' ')"

    rows = ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in licenses.KNOWN.items())
    digests = ", ".join(f"('{k}', '{v}')" for k, v in licenses.DIGESTS.items())
    return f"""
WITH k AS (SELECT digest, min(id) AS license_id FROM (SELECT id, sha256({form("t")}) AS digest FROM (VALUES {rows}) v(id, t) UNION ALL SELECT * FROM (VALUES {digests}) w(id, digest)) GROUP BY 1),
d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS line_licenses FROM (SELECT n, sha256({form("x")}) AS digest FROM (SELECT n, unnest(string_split(t, chr(10))) AS x FROM d)) JOIN k USING (digest) GROUP BY n)
SELECT doc_id, license_id, digest, coalesce(line_licenses, '') AS line_licenses FROM (SELECT n, doc_id, sha256({form("t")}) AS digest FROM d) LEFT JOIN k USING (digest) LEFT JOIN l USING (n)"""


def _vectors_sql(scale: int, more: str = "", where: str = "true") -> str:
    """Rows whose vector is there and finite, entries as whole numbers."""
    finite = "len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0"
    return f"SELECT vec_id{more}, list_transform(embedding, lambda v: floor({scale} * v::DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL AND {finite} AND {where}"


HARD_NEGATIVES_SQL = f"""
WITH v AS ({_vectors_sql(256, ", CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label", "label IS NOT NULL")}),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.x, r.x)::BIGINT AS score FROM v a JOIN v r ON a.vec_id != r.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""

TOP_PRODUCTS_SQL = f"""
WITH v AS ({_vectors_sql(1024)}),
s AS (SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.x, r.x)::BIGINT AS score FROM v q JOIN v r ON q.vec_id != r.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
QUALIFY rank <= 10"""

ORACLE_SQL = {
    "op1_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
WINDOW g AS (PARTITION BY t)""",
    "op5_license_scan": _license_sql(),
    "op12_hard_negatives": HARD_NEGATIVES_SQL,
    "op13_top_products": TOP_PRODUCTS_SQL,
}
