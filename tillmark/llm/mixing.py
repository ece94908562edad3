"""Mix sources to target weights, with DataFrame functions only.

Every document gets a hash-random key.  Rows are range-sorted by source and key
range, each range sums its own sizes, and a prefix sum over the range totals
turns these into positions within the source.  A source's budget is then a cut at
one position, after as many whole epochs as fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillmark.llm.storage import stored

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
# key ranges of a source: 16 ** RANGE_DIGITS
RANGE_DIGITS = 3
UNIT = r"[^\x20\x09-\x0D]+"


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(UNIT)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: total size, weight, target and the whole words of its budget.

    Sources in code-point order (missing last) take the weights in turn and share
    the size of everything.  A target stops at ``epochs`` times its source; the
    excess goes to the others by weight.  Sorted by total per weight, the stopped
    sources are a prefix, so running sums settle it without iterating.  The table
    has one row per source and is the only thing that is sorted as a whole.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("rank") % len(weights) + 1)
    ranked = totals.withColumn("rank", F.row_number().over(by_name) - 1).withColumn(
        "weight", turn.cast("long")
    )
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    cap = F.col("source_size") * epochs
    capped = (
        ranked.withColumn("cap", cap)
        .withColumn("all_size", F.sum("source_size").over(whole))
        .withColumn("all_weight", F.sum("weight").over(whole))
        .withColumn("left_size", F.col("all_size") - F.coalesce(F.sum("cap").over(earlier), F.lit(0)))
        .withColumn(
            "left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
        )
        .withColumn(
            "stopped", F.col("cap") * F.col("left_weight") <= F.col("weight") * F.col("left_size")
        )
    )
    rest_size = F.col("all_size") - F.sum(F.when(F.col("stopped"), F.col("cap")).otherwise(0)).over(whole)
    rest_weight = F.col("all_weight") - F.sum(
        F.when(F.col("stopped"), F.col("weight")).otherwise(0)
    ).over(whole)
    shared = F.try_divide(F.col("weight") * F.col("rest_size"), F.col("rest_weight"))
    return (
        capped.withColumn("rest_size", rest_size)
        .withColumn("rest_weight", rest_weight)
        .withColumn("target", F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(shared))
        .withColumn("budget", F.floor("target").cast("long"))
        .withColumn(
            "whole_epochs", F.coalesce(F.expr("try_divide(budget, source_size)"), F.lit(0.0))
        )
        .withColumn("whole_epochs", F.floor("whole_epochs").cast("long"))
        .select("source", "source_size", "target", "budget", "whole_epochs")
        .withColumn("cut", F.col("budget") - F.col("whole_epochs") * F.col("source_size"))
    )


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS, seed: str = "mix"
) -> DataFrame:
    """How many words of every document the mix takes.

    Needs ``doc_id``, ``text``, ``source``; returns one row per input row with
    ``doc_id, source, size, source_size, target, taken, whole_epochs, cut_words``:
    the document appears ``whole_epochs`` times in full and once more with its
    first ``cut_words`` words (0: not again; only one document of a source is cut
    inside).  ``taken`` adds up to the whole words of each source's target.

    A missing text has size 0, a missing source is a source of its own and the
    last one, a missing id takes its turn like any other.  Repeated rows are
    separate documents.  An empty table gives an empty result.
    """
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    sized = stored(
        docs.select(
            "doc_id",
            "source",
            text_size(F.col("text")).alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), ident)).alias("key"),
        ),
        "mix-sizes",
    ).withColumn("span", F.substring("key", 1, RANGE_DIGITS))

    spans = sized.groupBy("source", "span").agg(F.sum("size").alias("span_size"))
    before = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("span_start", F.coalesce(F.sum("span_size").over(before), F.lit(0)))
    plan = spans.join(
        source_targets(sized, weights, epochs).withColumnRenamed("source", "__source"),
        F.col("source").eqNullSafe(F.col("__source")),
    ).drop("__source")

    within = (
        Window.partitionBy("source", "span")
        .orderBy("key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = sized.repartitionByRange("source", "span").withColumn("upto", F.sum("size").over(within))
    planned = placed.join(
        plan.withColumnsRenamed({"source": "__source", "span": "__span"}),
        F.col("source").eqNullSafe(F.col("__source")) & (F.col("span") == F.col("__span")),
    )
    room = F.col("cut") - (F.col("span_start") + F.col("upto") - F.col("size"))
    return planned.withColumn(
        "cut_words", F.greatest(F.lit(0), F.least(F.col("size"), room)).cast("long")
    ).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("whole_epochs") * F.col("size") + F.col("cut_words")).alias("taken"),
        "whole_epochs",
        "cut_words",
    )
