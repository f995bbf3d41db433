"""The corpus pipeline: five stages, each one operator of prematch.llm on all documents its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prematch.llm import bm25_packing, language_id, rlz, simhash, string_tiling
from prematch.llm.common import table, written

#: Near duplicates: words of a shingle, the similarity that counts, and a radius that pairs of such similarity (about 10 bits apart, give or take 3) hardly ever leave.
SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 24


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain; the dictionaries come from a bounded sample of those with a language."""
    model = language_id.fit(docs.select("text", "lang"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return language_id.classify(whole, model, ["row"]).where(~F.col("rejected")).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id."""
    return simhash.representatives(docs, SHINGLE, RADIUS, SIMILARITY)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that also start earlier; n_chars follows the text."""
    others = [c for c in docs.columns if c != "text"]
    parsed = rlz.parse_corpus(docs, layout="text", carry=others)
    new = {c: F.col(f"carried.`{c}`") for c in others} | {"text": F.col("kept_text")}
    if "n_chars" in others:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(new["n_chars"])
    return parsed.select(*[new[c].alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return string_tiling.clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of tokens."""
    return bm25_packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontaminate),
    ("packing", packing),
]

#: SQL can't express language ID, fingerprints or tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
