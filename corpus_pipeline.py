"""A corpus made ready for training: language identification, near-duplicate removal, repeated passages, mixing, pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm import bagminhash, crf, mixing, pieces, suffixes
from pricetide.llm.queries import PIECES
from pricetide.llm.tables import settled, unused
from pricetide.session import scratch_path


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: those without letters go, and those of which no language has two fifths of the words, unless the words
    themselves are well told apart, as in text of several languages."""
    test = crf.held_out(F.col("doc_id"), 5)
    model = crf.fit(docs.filter(~test).select("doc_id", "text", "lang"))
    lang, score, told = (unused(docs.columns, n) for n in ("lang_pred", "lang_score", "lang_told"))
    found = crf.identify(docs, model, lang=lang, score=score, told=told)
    return found.filter((F.col(lang) != "und") & ((F.col(score) >= 0.4) | (F.col(told) >= 0.8))).select(*docs.columns)


def _digest() -> Column:
    return F.unhex(F.md5("text"))


def _matching(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of docs whose id and text are among wanted's (doc_id, digest, any more), once each, with wanted's further columns.

    Of rows with equal id and text that differ elsewhere, the one whose other columns come first as JSON stays.
    """
    columns, more = docs.columns, [c for c in wanted.columns if c not in ("doc_id", "digest")]
    row, digest, own, of = (unused([*columns, *more], n) for n in ("_row", "_digest", "_id", "_of"))
    there = wanted.withColumnsRenamed({"doc_id": own, "digest": of})
    both = docs.select(F.struct(*columns).alias(row), F.col("doc_id").alias(own + "1"), _digest().alias(digest)).join(
        there, F.col(own + "1").eqNullSafe(F.col(own)) & F.col(digest).eqNullSafe(F.col(of))
    )
    rest = [F.col(row)[c].alias(c) for c in columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*rest)) if rest else F.lit("")
    once = both.groupBy(own, digest, *more).agg(F.min_by(row, order).alias(row))
    return once.select(*[F.col(row)[c].alias(c) for c in columns], *more)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id."""
    found = settled(bagminhash.near_duplicates(docs.select("doc_id", "text")).filter("kept").select("doc_id", "digest").distinct())
    return _matching(docs, found)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of fifty words or more stay where they come first; documents of which nothing is left go."""
    cut = suffixes.without_spans(docs, suffixes.repeated_spans(docs.select("doc_id", "text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.filter(F.col("text").rlike(mixing.WORD))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: a document comes as often as the mixture takes it, to the nearest whole time."""
    size = mixing.size_of(F.col("text"))
    sized = settled(docs.select("doc_id", _digest().alias("digest"), "source", size.alias("size"), mixing.quality_of(F.col("text"), size).alias("quality")))
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    often = unused(docs.columns, "_times")
    mixed = mixing.mix(sized).filter("size > 0").groupBy("doc_id", "digest").agg(F.sum(times).alias(often)).filter(F.col(often) > 0)
    return _matching(docs, mixed).withColumn(often, F.explode(F.sequence(F.lit(1), F.col(often).cast("int")))).drop(often)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its piece ids and the text they decode to."""
    return pieces.encode(docs, PIECES)


STAGES = [("languages", languages), ("near duplicates", near_duplicates), ("repeats", repeats), ("mixture", mixture), ("pieces", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written, and read as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


ORACLE_SQL = None
