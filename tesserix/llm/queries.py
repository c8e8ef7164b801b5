"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserix.llm import bpe, chat, langid, media, mixing, ngram_join, quality, resampling, tokenfiles, toxicity, trie, urls, whitening
from tesserix.runtime import table, wide_session


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_weights(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_files(spark, table(spark, sf_dir, "documents"), vocabulary())


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_classes(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.exact_groups(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary())


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digests(chat.with_control_case(table(spark, sf_dir, "conversations")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _wide(f):
    """f in a session of its own, set for long texts."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(wide_session(spark), sf_dir)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


_ALL = (
    op1_mix_sources, op2_token_files, op3_url_filter, op4_ngram_join, op5_toxicity, op6_media_columns, op7_exact_dedup, op8_bpe, op9_chat_format, op10_language_id,
    op11_embedding_whitening, op12_quality, op13_resampling,
)
QUERIES = {f.__name__: _wide(f) for f in _ALL}
ORACLE_SQL = {"op1_mix_sources": mixing.mix_sql(), "op7_exact_dedup": trie.EXACT_SQL, "op9_chat_format": chat.CHAT_SQL}
