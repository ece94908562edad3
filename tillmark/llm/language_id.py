"""Language identification of mixed-language text.

The script of a word narrows its candidate languages.  Each candidate scores the
word by its character trigrams, and a Viterbi pass over the words of a document,
with a penalty for every change of language, labels spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tillmark.llm.kernels import Texts, mix, pieces
from tillmark.llm.labelled import fold_of

UNKNOWN = "und"
FOLDS, HELD = 4, 2
BUCKETS = 1 << 16
MAX_LANGUAGES = 128
SWITCH = 12.0
# share of a language's letters from which on a script counts as its own
SCRIPT_SHARE = 0.01
EXCLUDED = -1e4

# Unicode block ranges of scripts, in code-point order.
SCRIPTS = (
    ("latin", ((0x0041, 0x024F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF))),
    ("greek", ((0x0370, 0x03FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x0400, 0x052F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("armenian", ((0x0530, 0x058F),)),
    ("hebrew", ((0x0590, 0x05FF),)),
    ("arabic", ((0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x0900, 0x097F),)),
    ("bengali", ((0x0980, 0x09FF),)),
    ("tamil", ((0x0B80, 0x0BFF),)),
    ("thai", ((0x0E00, 0x0E7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF))),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))),
)


@lru_cache(maxsize=1)
def script_table() -> np.ndarray:
    """0 for what is no letter, else 1 + script, the last number for any other script."""
    table = np.zeros(0x110000, dtype=np.uint8)
    letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    table[letters] = len(SCRIPTS) + 1
    for number, (_, ranges) in enumerate(SCRIPTS, 1):
        for low, high in ranges:
            table[low : high + 1][letters[low : high + 1]] = number
    return table


@dataclass
class LetterWords:
    """Runs of letters of many texts, in code points of their own text."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    offsets: np.ndarray
    scripts: np.ndarray
    buckets: np.ndarray
    bucket_words: np.ndarray


def letter_words(texts: Texts) -> LetterWords:
    """Words, their scripts, and the hashed trigrams of each word with its edges."""
    points = np.frombuffer(texts.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    lead = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    row_at = lead[texts.offsets]
    kind = script_table()[points]
    letter = kind > 0
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    rows_from = row_at[:-1][row_at[:-1] < len(points)]
    first[rows_from] |= letter[rows_from]
    last = letter.copy()
    last[:-1] &= ~letter[1:]
    rows_to = row_at[1:][row_at[1:] > 0] - 1
    last[rows_to] |= letter[rows_to]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.searchsorted(starts, row_at)
    rows = np.repeat(np.arange(len(texts)), np.diff(offsets))

    # " word " of every word, end to end
    size = ends - starts
    place = np.cumsum(size + 2) - size - 1
    line = np.full(int((size + 2).sum()), 32, dtype=np.uint64)
    source = np.flatnonzero(letter)
    line[source + np.repeat(place - starts, size)] = points[source]
    centre = np.zeros(len(line), dtype=bool)
    centre[1:-1] = True
    centre[place - 1] = False
    centre[place + size] = False
    at = np.flatnonzero(centre)
    gram = (line[at - 1] << np.uint64(42)) ^ (line[at] << np.uint64(21)) ^ line[at + 1]
    buckets = (mix(gram, 5) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return LetterWords(
        starts - row_at[rows], ends - row_at[rows], rows, offsets, kind[starts], buckets,
        np.repeat(np.arange(len(starts)), size),
    )


@dataclass
class LanguageModel:
    """``scores[bucket, language]``: log probability of a trigram; ``own[script, language]``."""

    languages: list[str]
    scores: np.ndarray
    own: np.ndarray


def _pieces(column: pa.Array) -> Iterator[Texts]:
    return pieces(pc.utf8_lower(column))


def fit(docs: DataFrame, max_languages: int = MAX_LANGUAGES) -> LanguageModel:
    """Learn from ``text`` and ``lang`` of all rows that are not held out and have both.

    Every task counts hashed trigrams and script letters of each language; what
    reaches the driver is at most ``BUCKETS`` cells for each of at most
    ``max_languages`` languages (more are an error).
    """
    train = docs.where(
        (fold_of(F.col("doc_id"), FOLDS) != HELD) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    ).select("lang", "text")
    found = train.select("lang").distinct().limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = sorted(r["lang"] for r in found)
    width = BUCKETS + len(SCRIPTS) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * len(languages), dtype=np.int64)
        for batch in batches:
            lang = pc.index_in(batch.column(0), pa.array(languages, batch.column(0).type)).to_numpy()
            for texts in _pieces(batch.column(1)):
                found = letter_words(texts)
                base = lang[texts.first + found.rows].astype(np.int64) * width
                cells = base[found.bucket_words] + found.buckets
                total += np.bincount(cells, minlength=len(total))
                letters = found.ends - found.starts
                at = base + BUCKETS + found.scripts
                total += np.bincount(at, weights=letters, minlength=len(total)).astype(np.int64)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    counted = train.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(width * len(languages))
    table[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    table = table.reshape(len(languages), width).T
    grams, letters = table[:BUCKETS], table[BUCKETS:]
    shared = (grams.sum(axis=1, keepdims=True) + 0.5) / (grams.sum() + 0.5 * BUCKETS)
    weight = 50.0
    scores = np.log((grams + weight * shared) / (grams.sum(axis=0) + weight))
    own = letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=0), 1)
    return LanguageModel(languages, scores.astype(np.float32), own)


def viterbi(scores: np.ndarray, offsets: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of every word; documents advance side by side, one word at a time."""
    counts = np.diff(offsets)
    order = np.argsort(-counts, kind="stable")
    begins, counts = offsets[:-1][order], counts[order]
    steps = int(counts[0]) if len(counts) else 0
    alive = np.searchsorted(-counts, -np.arange(steps), side="left")
    back = np.empty(scores.shape, dtype=np.uint8)
    own = np.arange(scores.shape[1], dtype=np.uint8)
    value = np.zeros((len(counts), scores.shape[1]), dtype=np.float64)
    for t in range(steps):
        n = alive[t]
        at = begins[:n] + t
        if t == 0:
            value[:n] = scores[at]
            continue
        before = value[:n]
        top = before.argmax(axis=1)
        change = before[np.arange(n), top][:, None] - switch
        stay = before >= change
        back[at] = np.where(stay, own, top[:, None])
        value[:n] = np.where(stay, before, change) + scores[at]
    labels = np.empty(len(scores), dtype=np.uint8)
    now = value.argmax(axis=1).astype(np.uint8)
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        at = begins[:n] + t
        labels[at] = now[:n]
        if t:
            now[:n] = back[at, now[:n]]
    return labels


def word_scores(found: LetterWords, model: LanguageModel) -> np.ndarray:
    count = len(found.starts)
    scores = np.zeros((count, len(model.languages)))
    if count:
        firsts = np.searchsorted(found.bucket_words, np.arange(count))
        scores = np.add.reduceat(model.scores[found.buckets], firsts, axis=0).astype(np.float64)
    allowed = model.own[found.scripts]
    scores[~allowed & allowed.any(axis=1, keepdims=True)] += EXCLUDED
    return scores


def identify(
    docs: DataFrame,
    model: LanguageModel,
    switch: float = SWITCH,
    names: tuple[str, str, str] = ("lang_pred", "score", "spans"),
) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``spans`` to every row; only ``text`` is looked at.

    ``spans`` (start, end, lang) are maximal runs of words of one label, in code
    points.  ``lang_pred`` labels most letters (equal shares: the first by name)
    and ``score`` is its share of them.  A text that is missing or has no letter,
    or any text if nothing was learned, is ``und`` with score 0 and no spans.
    ``names`` renames the three; columns of these names are replaced, others kept.
    """
    new = list(names)
    docs = docs.drop(*new)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        labelled = pa.array([*model.languages, UNKNOWN], pa.string())
        k = len(model.languages)
        span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])
        for batch in batches:
            for texts in _pieces(batch.column(at_text)):
                part = batch.slice(texts.first, len(texts))
                found = letter_words(texts)
                if k and len(found.starts):
                    labels = viterbi(word_scores(found, model), found.offsets, switch).astype(np.int64)
                    size = found.ends - found.starts
                    share = np.bincount(found.rows * k + labels, weights=size, minlength=len(texts) * k)
                    share = share.reshape(-1, k)
                    whole = share.sum(axis=1)
                    best = np.where(whole > 0, share.argmax(axis=1), k)
                    score = share.max(axis=1) / np.maximum(whole, 1)
                    opens = np.ones(len(labels), dtype=bool)
                    opens[1:] = (labels[1:] != labels[:-1]) | (found.rows[1:] != found.rows[:-1])
                    head = np.flatnonzero(opens)
                    tail = np.append(head[1:], len(labels)) - 1
                    values = pa.StructArray.from_arrays(
                        [pa.array(found.starts[head]), pa.array(found.ends[tail]), labelled.take(pa.array(labels[head]))],
                        fields=list(span),
                    )
                    cuts = np.searchsorted(found.rows[head], np.arange(len(texts) + 1))
                    spans = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), values)
                else:
                    best, score = np.full(len(texts), k), np.zeros(len(texts))
                    spans = pa.array([[]] * len(texts), pa.list_(span))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, labelled.take(pa.array(best)), pa.array(score), spans],
                    [*part.schema.names, *new],
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    kinds = ("string", "double", "array<struct<start:long,end:long,lang:string>>")
    added = ", ".join(f"`{n}` {k}" for n, k in zip(new, kinds))
    return docs.mapInArrow(run, f"{fields}, {added}")
