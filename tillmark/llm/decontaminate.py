"""Benchmark decontamination by winnowing.

Of every window of ``n`` words the smallest hash of ``k`` consecutive words is its
fingerprint.  Equal windows have equal fingerprints, so a shared span of ``n``
words always shares one.  Training windows whose fingerprint a benchmark item has
are extended to the whole window by its hash and joined with the items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tillmark.llm.kernels import ALNUM, Words, gram_hashes, pieces, signed, sliding_argmin, words
from tillmark.llm.storage import stored
from tillmark.operators.joins import null_safe_left_join

WINDOW = 10
GRAM = 5
# bits of the fixed-size filter of benchmark fingerprints that every task gets (8 MB)
FILTER_BITS = 26
DOCUMENT = ["doc_id", "text_hash"]
WINDOW_SCHEMA = "m int, fp long, wh long"


def _row_ends(found: Words) -> np.ndarray:
    return np.repeat(found.offsets[1:], np.diff(found.offsets))


def fingerprints(found: Words, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every n-word window inside a row, and its fingerprint."""
    grams = gram_hashes(found.hashes, k)
    at = sliding_argmin(grams, n - k + 1)
    starts = np.flatnonzero(np.arange(len(at)) + n <= _row_ends(found)[: len(at)])
    return starts, grams[at[starts]]


def window_hashes(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """``gram_hashes`` at chosen starts only."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    index = starts[:, None] + np.arange(n)
    return gram_hashes(hashes[index].ravel(), n)[::n]


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW, k: int = GRAM) -> DataFrame:
    """Rows ``item_id, m, fp, wh``: every window of every item.

    An item of fewer than ``n`` words, but not none, is one window of ``m`` words
    and its own fingerprint.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in pieces(batch.column(1)):
                found = words(texts, ALNUM)
                counts = np.diff(found.offsets)
                starts, fps = fingerprints(found, n, k)
                row = np.searchsorted(found.offsets, starts, side="right") - 1
                parts = [(row, np.full(len(row), n), fps, window_hashes(found.hashes, starts, n))]
                for m in range(1, n):
                    short = np.flatnonzero(counts == m)
                    wh = window_hashes(found.hashes, found.offsets[short], m)
                    parts.append((short, np.full(len(short), m), wh, wh))
                row, m, fps, whs = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row + texts.first)),
                        pa.array(m.astype(np.int32)),
                        pa.array(signed(fps)),
                        pa.array(signed(whs)),
                    ],
                    ["item_id", "m", "fp", "wh"],
                )

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.select("item_id", "text").mapInArrow(run, f"item_id {kind}, {WINDOW_SCHEMA}")


def fingerprint_filter(windows: DataFrame) -> np.ndarray:
    """Bits of all benchmark fingerprints; its size does not depend on the benchmark."""
    bit = F.shiftrightunsigned("fp", 64 - FILTER_BITS) + 1
    parts = (
        windows.select(F.bitmap_bucket_number(bit).alias("part"), F.bitmap_bit_position(bit).alias("bit"))
        .groupBy("part")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    bits = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    for part in parts.toLocalIterator():
        chunk = np.frombuffer(part["bits"], dtype=np.uint8)
        bits[(part["part"] - 1) * len(chunk) :][: len(chunk)] = chunk
    return bits


def _passes(bits: np.ndarray, fps: np.ndarray) -> np.ndarray:
    at = fps >> np.uint64(64 - FILTER_BITS)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def scan_documents(
    docs: DataFrame, bits: np.ndarray, lengths: list[int], n: int = WINDOW, k: int = GRAM
) -> DataFrame:
    """One pass over the texts: a row per document (``m`` 0, ``n_words``) and one per
    window that may be a benchmark window (``m``, ``fp``, ``wh``, first word ``pos``)."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    short = [m for m in lengths if m < n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = shared.value
        for batch in batches:
            for texts in pieces(batch.column(2)):
                found = words(texts, ALNUM)
                count = len(texts)
                zero = np.zeros(count, dtype=np.int64)
                parts = [(np.arange(count), zero, zero, zero, np.diff(found.offsets))]

                def add(starts, fps, m, parts=parts, found=found):
                    ok = _passes(filled, fps)
                    starts, fps = starts[ok], fps[ok]
                    row = np.searchsorted(found.offsets, starts, side="right") - 1
                    whs = window_hashes(found.hashes, starts, m)
                    pos = starts - found.offsets[row]
                    parts.append((row, np.full(len(row), m), signed(fps), signed(whs), pos))

                if n in lengths:
                    add(*fingerprints(found, n, k), n)
                ends = _row_ends(found)
                for m in short:
                    grams = gram_hashes(found.hashes, m)
                    starts = np.flatnonzero(np.arange(len(grams)) + m <= ends[: len(grams)])
                    add(starts, grams[starts], m)
                row, m, fps, whs, pos = (np.concatenate(x) for x in zip(*parts))
                at = pa.array(row + texts.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at),
                        batch.column(1).take(at),
                        pa.array(m.astype(np.int32)),
                        pa.array(fps),
                        pa.array(whs),
                        pa.array(pos.astype(np.int64)),
                    ],
                    [*DOCUMENT, "m", "fp", "wh", "pos"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    return named.mapInArrow(run, f"doc_id {kind}, text_hash long, {WINDOW_SCHEMA}, pos long")


def contamination(
    docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, k: int = GRAM
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, text_hash, n_words, n_hit, items``.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
    A word is hit if it lies in an occurrence of a window; a window is ``n``
    consecutive words of an item, or a whole shorter item.  ``items`` lists the
    items with occurring windows as sorted strings.

    A missing or empty text has no words.  Rows that repeat a document each give
    a row; a missing id is an id like any other.  Items that repeat an id count
    once; an item without id hits words but is not listed.  With an empty
    benchmark nothing is hit.
    """
    windows = stored(benchmark_windows(benchmark, n, k), "benchmark-windows")
    lengths = [r["m"] for r in windows.select("m").distinct().collect()]
    scanned = stored(
        scan_documents(docs, fingerprint_filter(windows), lengths, n, k), "document-windows"
    )
    rows = scanned.where("m = 0").select(*DOCUMENT, F.col("pos").alias("n_words"))
    key = ["m", "fp", "wh"]
    hits = stored(
        scanned.where("m > 0").distinct().join(windows.select(*key).distinct(), key), "window-hits"
    )

    in_order = Window.partitionBy(*DOCUMENT).orderBy("pos", "m")
    reached = F.max(F.col("pos") + F.col("m")).over(
        in_order.rowsBetween(Window.unboundedPreceding, -1)
    )
    new = F.col("pos") + F.col("m") - F.greatest(F.col("pos"), F.coalesce("reached", F.col("pos")))
    words_hit = (
        hits.withColumn("reached", reached)
        .groupBy(*DOCUMENT)
        .agg(F.sum(F.greatest(F.lit(0), new)).cast("long").alias("n_hit"))
    )
    pairs = (
        hits.select(*DOCUMENT, *key)
        .distinct()
        .join(windows.where("item_id is not null").distinct(), key)
        .select(*DOCUMENT, F.col("item_id").cast("string").alias("item"))
        .distinct()
    )
    items = pairs.groupBy(*DOCUMENT).agg(F.sort_array(F.collect_list("item")).alias("items"))
    found = null_safe_left_join(words_hit, items, DOCUMENT)
    return null_safe_left_join(rows, found, DOCUMENT).select(
        *DOCUMENT,
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, k: int = GRAM) -> DataFrame:
    """The rows of ``docs`` without any hit word, all columns kept."""
    hit = contamination(docs, benchmark, n, k).where("n_hit > 0").select(*DOCUMENT).distinct()
    hit = hit.withColumnsRenamed({c: f"__hit_{c}" for c in DOCUMENT})
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    same = docs["doc_id"].eqNullSafe(F.col("__hit_doc_id")) & (text_hash == F.col("__hit_text_hash"))
    return docs.join(hit, same, "left_anti")
