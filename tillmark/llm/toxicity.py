"""Toxicity by class-conditional Kneser-Ney models over characters.

At each order from ``LOWEST + 1`` to ``ORDER`` a toxic and an ordinary model give each
byte of a text a probability from the bytes before it.  Both back off to one Kneser-Ney
estimate of the order below, whose continuation counts come from every document of the
corpus, so that a rare expression is smoothed alike in both and one that only unlabelled
texts hold is equally likely in both.  The log-ratios of the orders add up.  A document is
scored by the sum per byte, over the whole text and over its most telling passage of
``PASSAGE`` words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tillmark.llm.kernels import ALNUM, Lookup, Texts, mix, pieces, words
from tillmark.llm.labelled import LabelSample, fit_logistic, label_sample, logistic
from tillmark.llm.storage import stored

ORDER = 6
# orders up to this one are not counted by class
LOWEST = 2
CLASSES = ("toxic", "ordinary")
DISCOUNT = 0.75
FOLDS, HELD = 5, 0
# labelled documents the two class models and their calibration are fitted on, at most
MAX_ROWS = 100_000
# one in so many of them calibrates and is not counted
CALIBRATION = 4
PASSAGE = 12
# bytes without evidence that every passage counts besides its own
PRIOR_BYTES = 32
THRESHOLD = 0.5
# different n-grams after which a task hands its counts on, and new ones it lets wait
ROUND = 1 << 22
WAITING = 1 << 19
PIECE = 1 << 20
_SHIFT = np.uint64(8)


@dataclass
class Stream:
    """Texts as words with one space after each, five before each row.

    ``grams[i]`` packs the six bytes that end with predicted byte i; the
    predictions of word j are ``at[j]:at[j + 1]``.  ``again[j]``: the word repeats
    the one before it.
    """

    grams: np.ndarray
    at: np.ndarray
    rows: np.ndarray
    offsets: np.ndarray
    again: np.ndarray


def stream(texts: Texts) -> Stream:
    found = words(texts, ALNUM)
    count = len(texts)
    rows = np.repeat(np.arange(count), np.diff(found.offsets))
    size = found.ends - found.starts
    lead = ORDER - 1
    at = np.concatenate([[0], np.cumsum(size + 1)])
    place = at[:-1] + lead * (rows + 1)
    line = np.full(int(at[-1]) + lead * count, 32, dtype=np.uint64)
    marks = np.zeros(len(texts.data) + 1, dtype=np.int8)
    marks[found.starts] += 1
    marks[found.ends] -= 1
    source = np.flatnonzero(np.cumsum(marks[:-1], dtype=np.int8))
    line[source + np.repeat(place - found.starts, size)] = texts.data[source]
    ends = np.arange(at[-1]) + np.repeat(lead * (rows + 1), size + 1)
    grams = np.zeros(len(ends), dtype=np.uint64)
    for back in range(lead, -1, -1):
        grams = (grams << _SHIFT) | line[ends - back]
    again = np.zeros(len(rows), dtype=bool)
    again[1:] = (found.hashes[1:] == found.hashes[:-1]) & (rows[1:] == rows[:-1])
    return Stream(grams, at, rows, found.offsets, again)


def _streams(column: pa.Array) -> Iterator[tuple[Texts, Stream]]:
    for texts in pieces(pc.utf8_lower(column), PIECE):
        yield texts, stream(texts)


class GramCounter:
    """Different n-grams of a task and how often each class has them.

    Known ones are counted through a table; new ones wait until there are
    ``WAITING`` and then enter it.
    """

    def __init__(self):
        self.keys = np.zeros(0, dtype=np.int64)
        self.counts = np.zeros((2, 0), dtype=np.int64)
        self.table = Lookup(self.keys, self.keys)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, grams: np.ndarray, labels: np.ndarray) -> None:
        at, known = self.table(grams)
        for label in (0, 1):
            own = at[known & (labels == label)]
            if len(own):
                self.counts[label] += np.bincount(own, minlength=len(self.keys))
        new = ~known
        self.waiting.append((grams[new], labels[new]))
        self.size += int(new.sum())
        if self.size >= WAITING:
            self.settle()

    def settle(self) -> None:
        grams = np.concatenate([g for g, _ in self.waiting] or [self.keys[:0]])
        labels = np.concatenate([x for _, x in self.waiting] or [self.keys[:0]])
        fresh, at = np.unique(grams, return_inverse=True)
        counts = [np.bincount(at[labels == label], minlength=len(fresh)) for label in (0, 1)]
        self.keys = np.concatenate([self.keys, fresh])
        self.counts = np.concatenate([self.counts, np.array(counts).reshape(2, -1)], axis=1)
        self.table = Lookup(self.keys, np.arange(len(self.keys)))
        self.waiting, self.size = [], 0


def gram_counts(docs: DataFrame, sample: LabelSample) -> DataFrame:
    """``gram, toxic, ordinary`` of every six-byte string of the corpus.

    All documents count as having it; only sampled ones that do not calibrate count
    for their class.  Of the larger class as many count, chosen by hash, as the
    smaller one has, else the less trained model would look worse on any text.
    """
    share = class_shares(sample)
    shared = docs.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = GramCounter()

        def counted() -> pa.RecordBatch:
            counter.settle()
            return pa.RecordBatch.from_arrays(
                [pa.array(counter.keys), pa.array(counter.counts[1]), pa.array(counter.counts[0])],
                ["gram", "toxic", "ordinary"],
            )

        for batch in batches:
            label = shared.value(batch.column(0))
            point = hashed(batch.column(0))
            keep = ~calibrates(batch.column(0)) & (point < share[label])
            label = np.where(keep, label, -1).astype(np.int8)
            for texts, s in _streams(batch.column(1)):
                of_word = label[texts.first + s.rows]
                counter.add(s.grams.astype(np.int64), np.repeat(of_word, np.diff(s.at)))
            if len(counter.keys) >= ROUND:
                yield counted()
                counter = GramCounter()
        yield counted()

    schema = "gram long, toxic long, ordinary long"
    counted = docs.select("doc_id", "text").mapInArrow(run, schema)
    return counted.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def hashed(doc_ids: pa.Array, seed: int = 3) -> np.ndarray:
    """A number in [0, 1) for every id."""
    if isinstance(doc_ids, pa.ChunkedArray):
        doc_ids = doc_ids.combine_chunks()
    ids = doc_ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    return mix(ids.astype(np.uint64), seed).astype(np.float64) / 2.0**64


def calibrates(doc_ids: pa.Array) -> np.ndarray:
    return hashed(doc_ids, 4) < 1 / CALIBRATION


def class_shares(sample: LabelSample) -> np.ndarray:
    """Share of each class (ordinary, toxic) that is counted; the last entry is for no label."""
    sizes = np.bincount(np.clip(sample.labels, 0, 1), minlength=2)
    return np.append(np.minimum(1.0, sizes.min() / np.maximum(sizes, 1)), 0.0)


def _low(column: str, size: int):
    """The last ``size`` bytes of a packed string."""
    return F.col(column).bitwiseAND(F.lit((1 << (8 * size)) - 1))


def continuation_levels(counts: DataFrame) -> dict[int, DataFrame]:
    """``s, toxic, ordinary, whole`` for every string of 1 to ``ORDER`` bytes.

    At ``ORDER`` the class columns count occurrences.  Below, each column counts
    how many different bytes precede the string: in texts of the class, or in all
    documents (``whole``).
    """
    levels = {ORDER: counts.select(F.col("gram").alias("s"), "toxic", "ordinary", F.lit(1).alias("whole"))}
    for n in range(ORDER - 1, 0, -1):
        found = levels[n + 1].groupBy(_low("s", n).alias("s"))
        kinds = [F.count_if(F.col(c) > 0).alias(c) for c in (*CLASSES, "whole")]
        levels[n] = stored(found.agg(*kinds), f"continuations-{n}")
    return levels


def _smoothed(table: DataFrame, column: str, below: str):
    """Kneser-Ney estimate from a count, its context's sums and the order below."""
    own = F.greatest(F.col(column) - F.lit(DISCOUNT), F.lit(0.0)) / F.greatest(F.col(f"{column}_all"), F.lit(1))
    return own + F.col(f"{column}_rest") * F.col(below)


def _with_context(table: DataFrame, columns: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The table joined with its contexts, and those: sum and weight of the order below."""
    table = table.withColumn("context", F.shiftright("s", 8))
    sums = [F.sum(c).alias(f"{c}_all") for c in columns]
    kinds = [F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in columns]
    contexts = table.groupBy("context").agg(*sums, *kinds)
    for c in columns:
        rest = F.lit(DISCOUNT) * F.col(f"{c}_kinds") / F.col(f"{c}_all")
        contexts = contexts.withColumn(f"{c}_rest", F.when(F.col(f"{c}_all") > 0, rest).otherwise(F.lit(1.0)))
    return table.join(contexts, "context"), contexts


def shared_estimates(levels: dict[int, DataFrame]) -> dict[int, DataFrame]:
    """``s, p`` of orders 1 to ``ORDER - 1``: Kneser-Ney from ``whole``, every string of the corpus."""
    total = levels[1].agg(F.sum("whole")).first()[0] or 1
    out = {1: levels[1].select("s", (F.col("whole") / F.lit(float(total))).alias("p"))}
    for n in range(2, ORDER):
        table, _ = _with_context(levels[n].select("s", "whole"), ("whole",))
        below = out[n - 1].select(F.col("s").alias("tail"), F.col("p").alias("below"))
        joined = table.withColumn("tail", _low("s", n - 1)).join(below, "tail")
        out[n] = stored(joined.select("s", _smoothed(joined, "whole", "below").alias("p")), f"shared-{n}")
    return out


def log_ratios(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``key, value``: log P(toxic) - log P(ordinary) of every string a class has, and
    of the weights its contexts give to the order below for any other byte.

    The value of a string adds up the orders above ``LOWEST``, those of its tails included.
    """
    levels = continuation_levels(counts)
    return class_ratios(levels, shared_estimates(levels))


def class_ratios(levels: dict[int, DataFrame], shared: dict[int, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The tables of ``log_ratios``.

    At each order both classes back off to the shared estimate one order below.  It
    cancels in the ratio of a string that neither class has, whatever the string, so
    that no corpus string is left out by joining it to those of the classes only.
    """
    strings, others, lower = None, None, None
    for n in range(LOWEST + 1, ORDER + 1):
        table, contexts = _with_context(levels[n].where("toxic + ordinary > 0"), CLASSES)
        below = shared[n - 1].select(F.col("s").alias("tail"), F.col("p").alias("below"))
        joined = table.withColumn("tail", _low("s", n - 1)).join(below, "tail")
        toxic, ordinary = (F.ln(_smoothed(joined, c, "below")) for c in CLASSES)
        own = joined.select("s", "tail", (toxic - ordinary).alias("value"))
        if lower is not None:
            tails = lower.select(F.col("s").alias("tail"), F.col("value").alias("tail_value"))
            own = own.join(tails, "tail").select("s", (F.col("value") + F.col("tail_value")).alias("value"))
        lower = stored(own.select("s", "value"), f"ratios-{n}")
        at = lower.select(_tagged("s", n), "value")
        rest = contexts.select(
            _tagged("context", n), (F.ln("toxic_rest") - F.ln("ordinary_rest")).alias("value")
        )
        strings = at if strings is None else strings.union(at)
        others = rest if others is None else others.union(rest)
    return strings, others


def _tagged(column: str, order: int):
    return F.col(column).bitwiseOR(F.lit(order << 56)).alias("key")


@dataclass
class ToxicityModel:
    grams: Lookup
    contexts: Lookup
    weights: np.ndarray

    def features(self, s: Stream, count: int) -> np.ndarray:
        """Per row: log-likelihood ratio per byte of its best passage and of the whole text."""
        out = np.zeros((count, 2))
        if not len(s.rows):
            return out
        value = np.zeros(len(s.grams), dtype=np.float32)
        left, keys = np.arange(len(s.grams)), s.grams.astype(np.int64)
        for order in range(ORDER, LOWEST, -1):
            keys &= (1 << (8 * order)) - 1
            found, known = self.grams(keys | (order << 56))
            value[left] += found
            left, keys = left[~known], keys[~known]
            value[left] += self.contexts(keys >> 8 | (order << 56))[0]
        # a word said again at once is no further evidence
        value[np.repeat(s.again, np.diff(s.at))] = 0
        total = np.concatenate([[0], np.cumsum(value, dtype=np.float64)])
        upto = total[s.at]
        ends = s.offsets[1:][s.rows]
        start = np.arange(len(s.rows))
        stop = np.minimum(start + PASSAGE, ends)
        # a passage that the end of a longer text cuts short gives way to the last full one
        begin = np.maximum(np.minimum(start, ends - PASSAGE), s.offsets[:-1][s.rows])
        rate = (upto[stop] - upto[begin]) / (s.at[stop] - s.at[begin] + PRIOR_BYTES)
        full = np.flatnonzero(np.diff(s.offsets))
        first, last = s.offsets[:-1][full], s.offsets[1:][full]
        out[full, 0] = np.maximum.reduceat(rate, first)
        out[full, 1] = (upto[last] - upto[first]) / (s.at[last] - s.at[first] + PRIOR_BYTES)
        return out


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> ToxicityModel:
    """Learn from ``labels.toxic`` of rows that are not held out.

    At most about ``max_rows`` labelled documents, chosen by hash, fit the class
    models and the calibration; what tasks receive grows with that bound only.  The
    shared backoff counts come from all documents.
    """
    docs = docs.select("doc_id", "text")
    sample = label_sample(labels, "toxic", FOLDS, HELD, max_rows)
    counts = stored(gram_counts(docs, sample), "gram-counts")
    tables = []
    for table in log_ratios(counts):
        table = table.toArrow()
        tables.append(Lookup(table.column("key").to_numpy(), table.column("value").to_numpy()))
    model = ToxicityModel(*tables, np.zeros(3))
    shared = docs.sparkSession.sparkContext.broadcast((model, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sample = shared.value
        for batch in batches:
            label = np.where(calibrates(batch.column(0)), sample(batch.column(0)), -1)
            chosen = batch.filter(pa.array(label >= 0))
            label = label[label >= 0]
            for texts, s in _streams(chosen.column(1)):
                x = model.features(s, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(label[texts.first :][: len(texts)])],
                    ["passage", "whole", "label"],
                )

    known = docs.mapInArrow(run, "passage double, whole double, label long").toArrow()
    x = np.column_stack([known.column(c).to_numpy() for c in ("passage", "whole")])
    model.weights = fit_logistic(x, known.column("label").to_numpy())
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score`` of every row, 0 to 1, from ``text`` alone.

    A missing or empty text, or one without words, gets the score of a text whose
    likelihoods are equal.  Repeated rows each give a row; ids may be missing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, s in _streams(batch.column(1)):
                x = shared.value.features(s, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(texts.first, len(texts)), pa.array(logistic(x, shared.value.weights))],
                    ["doc_id", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
