"""The registered queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:  # vocabulary files of public tokenizers; any other file of the kind will do
    import public_tokenizers
    BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
    PIECES_MODEL = public_tokenizers.path("piece_bpe_32k.model")
except ImportError:
    BYTE_BPE = PIECES_MODEL = ""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~langid.held_out()))
    return langid.identify(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score",
                                               "entropy", "rejected")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score
    return score(_table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import decode, encode
    docs = _table(spark, sf_dir, "documents")
    out = decode(encode(docs, PIECES_MODEL), PIECES_MODEL)
    digest = F.xxhash64("ids")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "n_byte_pieces", "score",
                      digest.alias("ids_xxhash64"), F.sha2("text", 256).alias("decoded_sha256"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup_suffixes
    out = dedup_suffixes(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sketch import as_string, fingerprints
    out = fingerprints(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                      as_string(F.col("sketch")).alias("fingerprint"),
                      as_string(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack
    return pack(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wrapper import extract
    return extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chunk_dedup import dedup_substrings
    out = dedup_substrings(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest
    return nearest(_table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates
    out = near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conv_repair import COUNTS, damage, repair
    rows = _table(spark, sf_dir, "conversations")
    found = repair(damage(rows))
    told = found.conversations().join(found.digests().withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")))
    ids = rows.select(F.col("conv_id").cast("long").alias("id")).distinct()
    every = ids.join(told.drop("c"), F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ["gaps", *COUNTS, "cost"]]
    return every.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine, usable
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(usable(_table(spark, sf_dir, "embeddings"), label), "vec_id % 50 = 0")


#: The rules that op13 applies (fixed values): host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_rules import judge
    rows = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)
    return judge(_table(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM VALUES {rows} AS rules(host, path, verdict)"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_lm_score, op3_sentencepiece, op4_suffix_dedup, op5_fingerprints, op6_packing, op7_html_extract, op8_substring_dedup, op9_nearest, op10_simhash,
                                    op11_structure_repair, op12_hard_negatives, op13_url_filter)}

#: The other operators can't be stated in SQL (models, rolling hashes, tokenizers, components, CRC-32);
#: tests/llm checks each against a brute-force version, an exact round trip or held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op12_hard_negatives": """
        WITH fine AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pairs AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
                   list_inner_product(a.v, b.v)::BIGINT AS score
            FROM fine a JOIN fine b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        positives AS (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank,
               other_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN pairs USING (anchor_id)
        WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY rank <= 3""",
    "op13_url_filter": """
        WITH rest AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
        parsed AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM rest),
        rules(rh, rp, verdict) AS (
            VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        fits AS (
            SELECT DISTINCT host, path, rh || rp AS rule, verdict FROM parsed, rules
            WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
        best AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
                 FROM fits GROUP BY host, path)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM parsed LEFT JOIN best USING (host, path)""",
}
