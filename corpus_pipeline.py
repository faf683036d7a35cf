"""Corpus pipeline: filter, de-duplicate, decontaminate and encode documents.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept
and, but for the last, returns the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import bpe, common, decontam, quality_mil, simhash, suffix_dedup


def _free(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as make it no column of docs."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def _carried(docs: DataFrame) -> tuple[DataFrame, list[str], Callable[[str], Column]]:
    """All columns but the text, which operators pass on themselves; and a column as text that is null where the text was."""
    null = _free(docs, "__null")
    return docs.withColumn(null, F.col("text").isNull()), [*[c for c in docs.columns if c != "text"], null], lambda c: F.when(~F.col(f"carry.`{null}`"), F.col(c))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.7) go."""
    model = quality_mil.trained(docs, common.reading(spark, sf_dir, "labels"))
    rows, carry, text = _carried(docs)
    kept = quality_mil.scored(rows, model, carry=carry).filter("predicted = 1")
    return kept.select(*[text("text").alias(c) if c == "text" else F.col(f"carry.`{c}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document of smallest id stays, once.

    Rows are told apart by id and text; a row without an id stays only where its group has no id.
    """
    found = common.written(simhash.similar_groups(docs), "groups")
    stays = common.written(found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "copy")).alias("first"), F.count("*").alias("n")).filter("n > 1"), "first")
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("copy") == F.col("first.copy"))
    several = common.written(found.join(stays, "root").select(F.col("doc_id").alias("__id"), F.col("copy").alias("__copy"), first.alias("__first")).distinct(), "dropped")
    same = docs["doc_id"].cast("bigint").eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__copy"))
    left = docs.join(several, same, "left_anti")
    again = docs.join(several.filter("__first"), same, "left_semi").dropDuplicates(["doc_id", "text"])  # repeated rows of one id
    return left.unionByName(again)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes and more that a document of smaller id holds too are cut; a document that is cut whole keeps its row, with an empty text."""
    rows, carry, text = _carried(docs)
    cut = suffix_dedup.repeated_spans(rows, carry=carry, as_text=True)
    length = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("carry.n_chars"))
    new = {"text": text("kept"), "n_chars": length}
    return cut.select(*[new.get(c, F.col(f"carry.`{c}`")).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths of a benchmark item's five-word shingles go; others of the same id, or without one, stay."""
    found = decontam.contained(docs, common.reading(spark, sf_dir, "benchmark"), by_text=True)
    leaks = common.written(found.select(F.col("doc_id").alias("__leak"), F.col("copy").alias("__copy")).distinct(), "leaks")
    return docs.join(leaks, docs["doc_id"].eqNullSafe(F.col("__leak")) & (F.xxhash64(docs["text"]) == F.col("__copy")), "left_anti")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit), and whether decoding gives the text back."""
    digest = lambda c: F.sha2(F.coalesce(F.col(c), F.lit("")).cast("binary"), 256)
    own = _free(docs, "__digest")
    coded = bpe.decode(bpe.encode(docs.withColumn(own, digest("text")), carry=["doc_id", "lang", "source", own]))
    return coded.select("carry.doc_id", "carry.lang", "carry.source", "n_tokens", "ids", (digest("decoded") == F.col(f"carry.`{own}`")).alias("exact"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-duplicates", near_duplicates),
    ("suffix-array de-duplication", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", encoding),
]

#: Stages train models and hash; SQL does not express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's tables go when its result is written, and that goes when the next one's is."""
    docs, first = common.reading(spark, sf_dir, "documents"), len(common._WRITTEN)
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.split()[0].lower())
        common.kept_only(spark, first, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
