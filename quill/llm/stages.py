"""The pipeline: language ID, toxicity, line dedup, SimHash near-dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.llm import common, langid, lines, packing, simhash, toxicity

#: Documents whose language is less sure than this go: hardly more than a guess among few languages, so that short texts stay.
SURE = 0.3
#: Near-duplicates: sets of five-word shingles at a Jaccard similarity of 0.8, candidates by 512 bits of SimHash.
WORDS, ALIKE, LANES = 5, 0.8, 8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, or whose language stays unsure, go."""
    found = langid.identify(docs, langid.train(docs))
    return found.filter((F.col("lang_pred") != "und") & (F.col("lang_score") >= SURE)).select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic."""
    found = toxicity.rate(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))
    return found.filter(F.col("toxic_score") < toxicity.THRESHOLD).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines; a text that is all such copies becomes empty."""
    return lines.remove_repeats(docs).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest doc_id; rows without a doc_id stay, repeated rows become one."""
    found = simhash.jaccard_classes(docs, WORDS, ALIKE, LANES)
    first = found.filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences."""
    return packing.pack(docs, f"{common.TOKENIZERS}/word_bpe_49k.json", 2)


STAGES = [("language ID", language), ("toxicity", clean), ("line dedup", without_repeated_lines), ("SimHash near-dedup", one_of_each), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; each one's result is a written table in the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = common.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
