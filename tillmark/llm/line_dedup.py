"""Line dedup with DataFrame functions only.

Line hashes are range-partitioned and sorted by document and position; the first
document of each hash is streamed off, and every document gets back the bits of
the lines it keeps, never the text.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillmark.llm.storage import stored
from tillmark.operators.joins import null_safe_left_join

MIN_CHARS = 10
SPLITS = 64
BLANK = " \t\n\x0b\f\r"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line stripped of blanks at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANK))
    ascii_only = F.char_length(bare) == F.octet_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(
        F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)
    )


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_keep_bits(docs: DataFrame, min_chars: int = MIN_CHARS, splits: int = SPLITS) -> DataFrame:
    """Keep bits of every document that loses lines.

    Returns ``doc_id, text_hash, keep_words, n_dropped``.  ``keep_words`` maps a
    word number to 64 bits, bit i of word w standing for line 64 w + i; a word
    that is not in the map keeps all its lines, so the map is as long as the
    losses, not as the document.

    A line found in a third of all documents is spread over ``splits`` range
    partitions.  Each keeps the first document it sees, and only these firsts, at
    most ``splits`` documents for one line, meet again.
    """
    rows = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), "text").select(
        "doc_id", "text_hash", F.posexplode(text_lines(F.col("text"))).alias("pos", "line")
    )
    keyed = rows.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    hashed = stored(
        keyed.select(
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit("second"), "key").alias("h2"),
            F.pmod(F.xxhash64("doc_id"), F.lit(splits)).cast("int").alias("split"),
            "doc_id",
            "text_hash",
            "pos",
        ),
        "line-hashes",
    )
    order = [F.col("doc_id").asc_nulls_last(), "text_hash", "pos"]
    here = Window.partitionBy(*KEY, "split").orderBy(*order)
    first_here = F.struct(F.first("doc_id").over(here).alias("id"))
    seen = hashed.repartitionByRange(*KEY, "split").withColumn(
        "opens", F.struct(F.col("doc_id").alias("id")).eqNullSafe(first_here)
    )
    anywhere = Window.partitionBy(*KEY).orderBy(F.col("doc_id").asc_nulls_last())
    first_of_all = F.struct(F.first("doc_id").over(anywhere).alias("id"))
    later = (
        seen.where("opens")
        .withColumn("first", F.struct(F.col("doc_id").alias("id")).eqNullSafe(first_of_all))
        .where(~F.col("first"))
    )
    place = ["doc_id", "text_hash", "pos"]
    # rows that repeat a document share its bits: one row per place is enough
    dropped = seen.where(~F.col("opens")).select(*place).union(later.select(*place)).distinct()
    bit = F.expr("shiftleft(1L, pos % 64)")
    words = dropped.groupBy("doc_id", "text_hash", F.expr("pos div 64").cast("int").alias("word")).agg(
        F.bit_or(bit).alias("lost")
    )
    return words.groupBy("doc_id", "text_hash").agg(
        F.map_from_entries(
            F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("lost").alias("keep"))))
        ).alias("keep_words"),
        F.sum(F.bit_count("lost")).cast("long").alias("n_dropped"),
    )


def kept_text(text: Column, keep_words: Column) -> Column:
    """The lines whose bit is set, joined again; ``keep_words`` NULL keeps all."""

    def kept(line: Column, pos: Column) -> Column:
        word = F.try_element_at(keep_words, F.floor(pos / 64).cast("int"))
        bit = F.getbit(F.coalesce(word, F.lit(-1).cast("long")), pos % 64)
        return bit == 1

    chosen = F.array_join(F.filter(text_lines(text), kept), "\n")
    return F.when(keep_words.isNull(), F.coalesce(text, F.lit(""))).otherwise(chosen)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, splits: int = SPLITS) -> DataFrame:
    """Add ``keep_words``, ``n_dropped`` and ``kept_text`` to every row.

    A line's key is the line without blanks at its ends, A-Z lower-cased.  A key
    of at least ``min_chars`` code points found in two or more documents loses
    all its lines except those in the smallest ``doc_id`` that holds it.

    Rows that repeat a ``doc_id`` are one document, also if their texts differ; a
    missing id is one document too and comes last.  A missing or empty text is
    one empty line.  Other columns are kept as they are; the three new names
    replace columns of the same name.
    """
    new = ["keep_words", "n_dropped", "kept_text", "text_hash"]
    rows = docs.drop(*new).withColumn("text_hash", text_hash(F.col("text")))
    marked = null_safe_left_join(
        rows, line_keep_bits(docs, min_chars, splits), ["doc_id", "text_hash"]
    )
    return (
        marked.withColumn("n_dropped", F.coalesce("n_dropped", F.lit(0).cast("long")))
        .withColumn("kept_text", kept_text(F.col("text"), F.col("keep_words")))
        .drop("text_hash")
    )
