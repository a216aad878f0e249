"""Queries of the training-text problems and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import leakage, mixing, mojibake, names, seedtree, sentences
from tributary.operators import packed
from tributary.session import materialise, read, spread

COMMITS, GROUPS = "df_all_commits_with_stats", "contributors_all_projects"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_entity_pairs(names.link_variants(spread(read(spark, d, "name_email_pairs"))))


def list_entries(spark: SparkSession, d: str) -> DataFrame:
    """(record_id, entry): the comparable entries of names and emails of each contributor record."""
    g = read(spark, d, GROUPS)
    mails = packed.explode_packed(g.select("record_id", "emails", "num_emails"), "record_id", "emails", "num_emails")
    persons = packed.explode_packed(g.select("record_id", "names", "num_names"), "record_id", "names", "num_names")
    mail = F.lower(F.trim("item_value"))
    name = F.lower(F.trim(F.regexp_replace("item_value", r"(?U)\s+", " ")))
    m = mails.where(F.contains("item_value", F.lit("@"))).select(F.col("key").alias("record_id"), F.concat(F.lit("e:"), mail).alias("entry"))
    n = persons.where(F.contains(name, F.lit(" "))).select(F.col("key").alias("record_id"), F.concat(F.lit("n:"), name).alias("entry"))
    return m.unionByName(n)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    entries = materialise(list_entries(spark, d), "entries")
    return seedtree.groups_of_shared_values(entries, "entry", "record_id").select(
        F.col("vertex").alias("record_id"), F.col("component").alias("group_record_id")
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restore(spread(read(spark, d, COMMITS).select("row_id", "author_name", "message")), "row_id", ["author_name", "message"])


def _leaks(spark: SparkSession, d: str, share: float | None = None) -> DataFrame:
    docs = spread(read(spark, d, "documents").select("doc_id", "text"))
    return leakage.leaks(docs, read(spark, d, "eval_items").select("item_id", "text"), share=share)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where("run_found").select("doc_id", "item_id")


def p8_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an item in other words: the subsequence check finds them, the answer check decides."""
    near = _leaks(spark, d, leakage.SHARE).where((F.col("lcs_share") >= leakage.SHARE) & (F.col("answer_share") >= leakage.ANSWER)).where("NOT run_found")
    return near.select("doc_id", "item_id", F.round("cosine", 3).alias("cosine"), F.round("lcs_share", 3).alias("lcs_share"), F.round("answer_share", 3).alias("answer_share"))


def _mixture(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "source", "text").where("source IS NOT NULL")
    docs = spread(docs)
    sized = mixing.token_counts(docs, "doc_id", "text", "source")
    return mixing.mixture(sized, read(spark, d, "mix_targets"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.share_report(materialise(_mixture(spark, d), "mixture"), read(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(spread(read(spark, d, "documents").select("doc_id", "text")))


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p6_found, p8_found, p8_paraphrases, p9_mixture, p9_shares, p10_found)}
SQL: dict[str, str] = {}
