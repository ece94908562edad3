"""From raw documents to a mixed training corpus.

Each stage takes all rows its predecessor kept and returns the columns of
``documents``; the last one returns the mix.  Between stages rows are written down
as Parquet in the cluster's shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillmark.llm import decontaminate, language_id, line_dedup, mixing, ngram_join
from tillmark.llm.storage import stored
from tillmark.operators.joins import null_safe_left_join


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is known, however many languages a text mixes.

    Texts that are missing or hold no letter go.  A missing ``lang`` becomes the
    language that leads in the text; one that is given stays.
    """
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    names = ("__lang_pred", "__lang_score", "__lang_spans")
    found = language_id.identify(docs, model, names=names)
    known = found.where(F.col(names[0]) != language_id.UNKNOWN)
    return known.withColumn("lang", F.coalesce("lang", names[0])).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without the lines that an earlier document holds.

    ``n_chars`` follows the text; a text that loses every line is empty.
    """
    bits = line_dedup.line_keep_bits(docs.select("doc_id", "text")).select(
        "doc_id", F.col("text_hash").alias("__text_hash"), F.col("keep_words").alias("__keep_words")
    )
    rows = docs.withColumn("__text_hash", line_dedup.text_hash(F.col("text")))
    marked = null_safe_left_join(rows, bits, ["doc_id", "__text_hash"])
    lost = F.col("__keep_words").isNotNull()
    kept = F.when(lost, line_dedup.kept_text(F.col("text"), F.col("__keep_words"))).otherwise(F.col("text"))
    cut = marked.withColumn("text", kept)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        size = F.when(lost, F.char_length("text").cast(kind)).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", size)
    return cut.select(*docs.columns)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Rows that repeat both id and text count as copies too.  A row without id stays
    only if it is like no row with one; of several such rows, or of different texts
    that share the smallest id, one stays.  Of rows that repeat id and text the one stays
    whose other columns come first.  Texts without words are like no other.
    """
    found = stored(ngram_join.keyed_components(docs.select("doc_id", "text")), "similar")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "ref")).getField("ref")
    grouped = found.where("component is not null").groupBy("component").agg(first.alias("ref")).select("ref")
    keep = grouped.union(found.where("component is null").select("ref")).distinct()
    ref = ngram_join.row_ref(docs["doc_id"], docs["text"])
    kept = docs.join(keep.withColumnRenamed("ref", "__ref"), ref == F.col("__ref"), "left_semi")
    repeats = found.groupBy("ref").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if repeats.isEmpty():
        return kept
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = kept.groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("__first"))
    return first.select(*[F.col(f"__first.{c}").alias(c) if c in rest else F.col(c) for c in docs.columns])


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_contaminated(docs, benchmark)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often and how far each remaining document enters the mix."""
    return mixing.mix_sources(docs.select("doc_id", "text", "source"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_identified),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", keep_one_of_similar),
    ("decontaminate", drop_benchmark_copies),
    ("source_mix", mix),
]

# the language model of the first stage has no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the documents in ``sf_dir``.

    Inside ``tillmark.llm.storage.run_folder`` the tables of all stages go when it closes.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
