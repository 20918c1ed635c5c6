"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspark.llm.common import documents, fold_bucket
from wattspark.llm.embedding_dedup import embedding_dedup
from wattspark.llm.exact_dedup import exact_dedup
from wattspark.llm.hmm_lm import score
from wattspark.llm.jaccard_join import jaccard_classes
from wattspark.llm.language_id import fit_dictionaries, identify
from wattspark.llm.mixing import mix
from wattspark.llm.pii import digest, find_pii, train
from wattspark.llm.sentence_pieces import decoded, encode
from wattspark.llm.token_counts import token_counts
from wattspark.llm.url_filter import Rule, judge_urls

URL_RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's piece ids, how many, and whether they decode to its text."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # the text travels with its id through the encoder, so that the check needs no join
    found = encode(docs.select(F.struct("doc_id", "text").alias("row"), "text"), model, id_col="row")
    return found.select("row.doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", (decoded(F.col("ids"), model) == F.col("row.text")).alias("round_trip"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold_bucket(F.col("doc_id"), 5) == 0
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    dictionaries, counts = fit_dictionaries(docs.filter(~held_out))
    found = identify(docs.select("doc_id", "text"), dictionaries, counts)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op5_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold_bucket(F.col("doc_id"), 7) == 2
    found = score(documents(spark, sf_dir), ~held_out)
    return found.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return digest(find_pii(docs, train(docs)))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


_QUERIES = {f.__name__: f for f in (op1_sentence_pieces, op2_exact_dedup, op3_embedding_dedup, op4_language_id, op5_hmm_lm, op6_mixing, op7_pii, op8_ngram_jaccard, op9_token_counts, op10_url_filter)}

_STRIPPED = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

_ORACLES = {
    "op2_exact_dedup": f"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256({_STRIPPED}) AS text_sha256 FROM documents),
             r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
                          count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r""",
    # rules by their own text here: a host that ends with the rule's, a path that starts with the rule's
    "op10_url_filter": r"""
        WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
             r AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                                  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                                  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                                  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {**_QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
