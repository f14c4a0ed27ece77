"""The queries of this subpackage: each of the operators over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import ann, bpe, langid, licenses, lines, main_text, mixing, pii, simhash, topk
from quire.llm.common import table

#: The key of the surrogates in the registered query; in production pass a secret of your own.
PII_KEY = "quire-demonstration-key"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.remove_copies(table(spark, sf_dir, "documents"), counts=True)
    return found.select("doc_id", "text", "n_lines", "n_deleted")


def line_dedup_any_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without a floor: every later copy of a line with a word in it goes."""
    found = lines.remove_copies(table(spark, sf_dir, "documents"), min_words=1, counts=True)
    return found.select("doc_id", "text", "n_lines", "n_deleted")


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.replace(table(spark, sf_dir, "documents"), PII_KEY, counts=True)
    return found.select("doc_id", "text", "n_entities")


def op3_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op4_simhash_bk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(table(spark, sf_dir, "documents"))


def op6_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def _page_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, lang, url, text): the main text of each page and the lang of its <html>."""
    pages = table(spark, sf_dir, "pages")
    texts = main_text.extract(pages.withColumn("page_id", F.struct("page_id", langid.markup_language(F.col("html")).alias("lang"))))
    return texts.select("page_id.page_id", "page_id.lang", "url", "text")


def op9_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages in one fusion: a row has doc_id or page_id.

    Documents declare their language in lang, and their source stands for a host. Pages have all kinds of evidence: main
    text, lang of <html>, suffix, domain and host.
    """
    docs, none = table(spark, sf_dir, "documents"), F.lit(None).cast("string")
    host, domain, suffix = langid.host_of(F.col("url"))
    ids = lambda doc, page: F.struct(doc.cast("long").alias("doc_id"), page.cast("long").alias("page_id")).alias("id")
    rows = docs.select(ids(F.col("doc_id"), F.lit(None)), "text", "lang", F.col("source").alias("host"), none.alias("domain"), none.alias("suffix"))
    rows = rows.union(_page_evidence(spark, sf_dir).select(ids(F.lit(None), F.col("page_id")), "text", "lang", host, domain, suffix))
    found = langid.identify(rows, langid.fit(docs, "text", "lang"), "id", F.col("text"), F.col("lang"), F.col("host"), F.col("domain"), F.col("suffix"))
    return found.select("id.doc_id", "id.page_id", "n_words", "language", "confidence", "text_language", "declared")


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for pages alone."""
    model = langid.fit(table(spark, sf_dir, "documents"), "text", "lang")
    return langid.identify(_page_evidence(spark, sf_dir), model, "page_id", F.col("text"), F.col("lang"), *langid.host_of(F.col("url"))).drop("digest")


def op10_bpe_forced_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), bpe.public_tokenizer(), with_ids=False, with_decoded=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, line_dedup_any_run, op2_pii_surrogates, op3_tag_path_ratios, op4_simhash_bk_tree, op5_license_scan, op6_norm_buckets, op7_mixing_sources, op8_learned_partitions, op9_language_fusion, page_languages, op10_bpe_forced_boundaries)
}
