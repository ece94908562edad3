"""Spelling variants: words one edit apart, and the frequent form each of them leads to.

A word is a point: how often it holds each letter.  Replacing a letter moves the point
by an L1 distance of two, inserting or deleting one by one.  So words of one length are
searched for others of that length within distance two, and for words that are one
letter shorter within distance one:

1. per length a k-d tree cuts the space into cells of about ``CELL`` words.  Its
   cuts come from a bounded sample; they place the work and exclude no pair;
2. a word goes to its own cell, and asks every later cell of its length and every
   cell of the next shorter length whose box is near enough;
3. a cell holds its words in a k-d tree with tight boxes, prunes the range searches of
   those who ask by these boxes, and checks the letter order of what is left.

Counts are written in unary, a bit for "at least t of this letter", so that an L1
distance is the number of bits that differ.  The box of a node is then the AND and the
OR of its points, and the distance to it is the number of bits outside the two.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillmark.llm.storage import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "[A-Za-zÀ-ÿ]+"
MIN_LETTERS = 5
MIN_COUNT = 3
# a form is at least so many times as frequent as its variant
FORM_RATIO = 2
# letters that share a slot, and counts above the cap, only make distances look smaller
SLOTS = 96
CAP = 15
# words of a cell, and of the sample that places the cuts
CELL = 1 << 14
SAMPLE = 100_000
# a cut needs so many sampled words on both sides together
LEAST_SAMPLED = 16
LEAF = 32
CHUNK = 1 << 14
PAIRS = 1 << 21


def letter_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, word`` of every maximal run of letters, A-Z lower-cased; nulls have none."""
    folded = F.translate("text", UPPER, LOWER)
    return docs.select("doc_id", F.explode(F.regexp_extract_all(folded, F.lit(LETTERS), F.lit(0))).alias("word"))


def frequent_words(runs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n, size`` of words with enough letters and occurrences; counted map-side first."""
    long = runs.where(F.char_length("word") >= min_letters)
    counted = long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    return counted.withColumn("size", F.char_length("word"))


def letters_of(words: pa.Array, size: int) -> np.ndarray:
    """Code points of words that all have ``size`` of them."""
    text = "".join(words.to_pylist()).encode("utf-32-le")
    return np.frombuffer(text, dtype=np.uint32).reshape(len(words), size)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    n = len(letters)
    slot = letters % SLOTS + np.arange(n)[:, None] * SLOTS
    return np.minimum(np.bincount(slot.ravel(), minlength=n * SLOTS).reshape(n, SLOTS), CAP).astype(np.uint8)


def _best_cut(bits: np.ndarray) -> int:
    """The bit that splits the rows most evenly, or -1 if none does."""
    held = bits.sum(axis=0, dtype=np.int64)
    uneven = np.abs(2 * held - len(bits))
    uneven[(held == 0) | (held == len(bits))] = 2 * len(bits)
    best = int(np.argmin(uneven)) if len(uneven) else 0
    return best if len(uneven) and uneven[best] < len(bits) else -1


def unary(counts: np.ndarray, most: np.ndarray) -> np.ndarray:
    """A boolean column per slot and threshold from 1 to ``most``."""
    slot = np.repeat(np.arange(SLOTS), most)
    step = np.arange(len(slot)) - np.repeat(np.cumsum(most) - most, most) + 1
    return counts[:, slot] >= step


@dataclass
class Cells:
    """Cuts of the words of one length.  ``cuts`` has (slot, threshold, below, not below)
    of every node, a leaf (first cell, number of cells) in which words are dealt by hash."""

    cuts: list[tuple[int, ...]] = field(default_factory=lambda: [(0, 1)])

    @classmethod
    def fit(cls, counts: np.ndarray, rate: float, cell: int) -> Cells:
        """From the letter counts of a sample that took ``rate`` of all words."""
        most = counts.max(axis=0).astype(np.int64)
        bits = unary(counts, most)
        slot = np.repeat(np.arange(SLOTS), most)
        step = np.arange(len(slot)) - np.repeat(np.cumsum(most) - most, most) + 1
        cuts: list[tuple[int, ...]] = []
        cells = 0

        def add(rows: np.ndarray) -> int:
            nonlocal cells
            at = len(cuts)
            cuts.append(())
            expected = len(rows) / rate
            cut = _best_cut(bits[rows]) if expected > cell and len(rows) >= LEAST_SAMPLED else -1
            if cut < 0:
                parts = max(1, -int(-expected // cell))
                cuts[at] = (cells, parts)
                cells += parts
            else:
                high = bits[rows, cut]
                cuts[at] = (int(slot[cut]), int(step[cut]), add(rows[~high]), add(rows[high]))
            return at

        add(np.arange(len(counts)))
        return cls(cuts)

    def home(self, counts: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        out = np.zeros(len(counts), dtype=np.int64)
        for (first, parts), rows in self._reached(counts, 0):
            out[rows] = first + hashed[rows] % parts
        return out

    def near(self, counts: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """Every cell with the rows whose distance to its box may be within ``radius``."""
        for (first, parts), rows in self._reached(counts, radius):
            for part in range(parts):
                yield first + part, rows

    def _reached(self, counts: np.ndarray, radius: int) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
        stack = [(0, np.arange(len(counts)), np.zeros(len(counts), dtype=np.int64))]
        while stack:
            node, rows, spent = stack.pop()
            if not len(rows):
                continue
            cut = self.cuts[node]
            if len(cut) == 2:
                yield cut, rows
                continue
            slot, step, low, high = cut
            # every bit on the wrong side of its cut is one step away from the box
            above = counts[rows, slot] >= step
            for child, wrong in ((low, above), (high, ~above)):
                cost = spent + wrong
                fits = cost <= radius
                stack.append((child, rows[fits], cost[fits]))


class PointTree:
    """k-d tree over the letter counts of the words of one cell."""

    def __init__(self, counts: np.ndarray, leaf: int = LEAF):
        self.most = counts.max(axis=0).astype(np.int64)
        bits = unary(counts, self.most)
        order, self.nodes = np.arange(len(counts)), []
        codes = self._packed(bits)

        def add(a: int, b: int) -> int:
            at = len(self.nodes)
            rows = order[a:b]
            low = np.bitwise_and.reduce(codes[rows], axis=0)
            high = np.bitwise_or.reduce(codes[rows], axis=0)
            cut = _best_cut(bits[rows]) if b - a > leaf else -1
            self.nodes.append((low, high, a, b, -1, -1))
            if cut >= 0:
                wants = bits[rows, cut]
                order[a:b] = np.concatenate([rows[~wants], rows[wants]])
                middle = b - int(wants.sum())
                self.nodes[at] = (low, high, a, b, add(a, middle), add(middle, b))
            return at

        add(0, len(counts))
        self.order, self.codes = order, codes[order]

    @staticmethod
    def _packed(bits: np.ndarray) -> np.ndarray:
        width = max(1, -(-bits.shape[1] // 64))
        full = np.zeros((len(bits), 64 * width), dtype=bool)
        full[:, : bits.shape[1]] = bits
        return np.packbits(full, axis=1).view(np.uint64)

    def search(self, counts: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (row of ``counts``, point) within ``radius``, in parts."""
        # what a word has beyond every point is distance to all of them
        beyond = np.maximum(counts.astype(np.int64) - self.most, 0).sum(axis=1)
        codes = self._packed(unary(counts, self.most))
        stack = [(0, np.flatnonzero(beyond <= radius))]
        while stack:
            at, rows = stack.pop()
            low, high, a, b, left, right = self.nodes[at]
            asked = codes[rows]
            outside = np.bitwise_count((asked & ~high) | (low & ~asked)).sum(axis=1, dtype=np.int64)
            rows = rows[outside + beyond[rows] <= radius]
            if not len(rows):
                continue
            if left >= 0:
                stack += [(left, rows), (right, rows)]
                continue
            step = max(1, PAIRS // (b - a))
            for part in (rows[i : i + step] for i in range(0, len(rows), step)):
                differ = np.zeros((len(part), b - a), dtype=np.int64)
                for word in range(codes.shape[1]):
                    differ += np.bitwise_count(codes[part, word][:, None] ^ self.codes[a:b, word])
                i, j = np.nonzero(differ + beyond[part][:, None] <= radius)
                yield part[i], self.order[a + j]


def one_replaced(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Do rows of equal length differ in exactly one letter?"""
    return (x != y).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Is ``long`` the row of ``short`` with one letter more?"""
    same = np.ones((len(short), short.shape[1] + 1), dtype=bool)
    same[:, :-1] = short == long[:, :-1]
    before = np.where(same.all(axis=1), short.shape[1], np.argmin(same, axis=1))
    same[:, :-1] = (short == long[:, 1:])[:, ::-1]
    after = np.where(same.all(axis=1), short.shape[1], np.argmin(same, axis=1))
    return before + after >= short.shape[1]


class _Cell:
    """The words of a cell, and what those who ask find among them."""

    def __init__(self, size: int):
        self.size, self.parts, self.tree = size, [], None

    def add(self, words: pa.Array, n: pa.Array) -> None:
        self.parts.append((words, n))

    def sealed(self) -> Iterator[pa.RecordBatch]:
        """Builds the tree; the pairs inside the cell."""
        self.words = pa.concat_arrays([w for w, _ in self.parts])
        self.n = np.concatenate([n.to_numpy() for _, n in self.parts])
        self.letters = letters_of(self.words, self.size)
        counts = letter_counts(self.letters)
        self.tree = PointTree(counts)
        for at in range(0, len(counts), CHUNK):
            i, j = self._found(self.letters[at : at + CHUNK], counts[at : at + CHUNK], 2, at)
            yield from self._reported(self.words, self.n, i + at, j)

    def asked(self, longer: bool, words: pa.Array, n: pa.Array) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(words), CHUNK):
            part, own = words.slice(at, CHUNK), n.slice(at, CHUNK).to_numpy()
            letters = letters_of(part, self.size + longer)
            i, j = self._found(letters, letter_counts(letters), 1 if longer else 2, None)
            yield from self._reported(part, own, i, j)

    def _found(self, letters, counts, radius, own_from) -> tuple[np.ndarray, np.ndarray]:
        out = [(np.zeros(0, dtype=np.int64),) * 2]
        for i, j in self.tree.search(counts, radius):
            if own_from is not None:
                once = i + own_from < j
                i, j = i[once], j[once]
            step = max(1, PAIRS // (self.size + 1))
            for a in range(0, len(i), step):
                x, y = i[a : a + step], j[a : a + step]
                if radius == 1:
                    good = one_inserted(self.letters[y], letters[x])
                else:
                    good = one_replaced(self.letters[y], letters[x])
                out.append((x[good], y[good]))
        i, j = zip(*out)
        return np.concatenate(i), np.concatenate(j)

    def _reported(self, words, n, i, j) -> Iterator[pa.RecordBatch]:
        """Per word on either side: how many it is near to here, and the best of these."""
        for one, of_one, other, of_other, counts in ((words, i, self.words, j, self.n), (self.words, j, words, i, n)):
            if len(of_one):
                used, rank = np.unique(of_other, return_inverse=True)
                text = other.take(pa.array(used))
                by_text = np.empty(len(used), dtype=np.int64)
                by_text[np.array(sorted(range(len(used)), key=text.to_pylist().__getitem__))] = np.arange(len(used))
                order = np.lexsort((by_text[rank], -counts[of_other], of_one))
                first = np.flatnonzero(np.diff(of_one[order], prepend=-1))
                best = of_other[order[first]]
                yield pa.RecordBatch.from_arrays(
                    [
                        one.take(pa.array(of_one[order[first]])),
                        pa.array(np.diff(first, append=len(order))),
                        pa.array(-counts[best]),
                        other.take(pa.array(best)),
                    ],
                    ["word", "n_near", "less", "best"],
                )


def _routed(words: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """``size, cell, side, word, n``: side 0 lives in the cell, 1 and 2 ask from the same and the next length."""
    shared = words.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                counts, hashed = letter_counts(letters_of(part.column(0), size)), part.column(3).to_numpy()
                own = shared.value.get(size, Cells())
                home = own.home(counts, hashed)
                placed = [(size, home, 0, np.arange(len(home)))]
                for cell, rows in own.near(counts, 2):
                    placed.append((size, cell, 1, rows[home[rows] < cell]))
                for cell, rows in shared.value.get(size - 1, Cells()).near(counts, 1):
                    placed.append((size - 1, cell, 2, rows))
                rows = np.concatenate([r for *_, r in placed])

                def column(k: int, kind: pa.DataType) -> pa.Array:
                    return pa.array(np.concatenate([np.broadcast_to(p[k], len(p[3])) for p in placed]), kind)

                yield pa.RecordBatch.from_arrays(
                    [
                        column(0, pa.int32()),
                        column(1, pa.int64()),
                        column(2, pa.int32()),
                        part.column(0).take(pa.array(rows)),
                        part.column(1).take(pa.array(rows)),
                    ],
                    ["size", "cell", "side", "word", "n"],
                )

    hashed = words.select("word", "n", "size", F.pmod(F.xxhash64("word"), F.lit(1 << 30)).alias("hashed"))
    return hashed.mapInArrow(run, "size int, cell long, side int, word string, n long")


def _met(routed: DataFrame) -> DataFrame:
    """``word, n_near, less, best`` of each cell; a word has a row for every cell that finds it near words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell = None, None
        for batch in batches:
            marks = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
            starts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *starts.tolist()], [*starts.tolist(), len(marks)]):
                if a == b:
                    continue
                size, number, side = marks[a].tolist()
                words, n = (batch.column(k).slice(a, b - a) for k in (3, 4))
                if key != (size, number):
                    if cell is not None and cell.tree is None:
                        yield from cell.sealed()
                    # those who ask an empty cell find nothing
                    key, cell = (size, number), _Cell(size) if side == 0 else None
                if side == 0:
                    cell.add(words, n)
                elif cell is not None:
                    if cell.tree is None:
                        yield from cell.sealed()
                    yield from cell.asked(side == 2, words, n)
        if cell is not None and cell.tree is None:
            yield from cell.sealed()

    dealt = routed.repartition("size", "cell").sortWithinPartitions("size", "cell", "side")
    return dealt.mapInArrow(run, "word string, n_near long, less long, best string")


def fit_cells(words: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> dict[int, Cells]:
    """Cuts of every length, from at most about ``sample`` words chosen by hash."""
    total = words.count()
    rate = min(1.0, sample / max(1, total))
    steps = 1 << 30
    chosen = words.where(F.pmod(F.xxhash64("word", F.lit(1)), F.lit(steps)) < int(rate * steps))
    table = chosen.select("word", "size").toArrow()
    sizes = table.column("size").to_numpy()
    found = {}
    for size in np.unique(sizes).tolist():
        some = table.column("word").filter(pa.array(sizes == size)).combine_chunks()
        if len(some) / rate > cell:
            found[size] = Cells.fit(letter_counts(letters_of(some, size)), rate, cell)
    return found


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last form reached from each word that has one.

    Forms at least double the count, so chains are short; every round doubles the step.
    """
    links = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "forms")
    while not links.where("moved").isEmpty():
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = stored(
            links.join(onward, "root", "left").select(
                "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
            ),
            "forms",
        )
    return links.select("word", "root")


def spelling_variants(words: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every row of ``words`` (``word, n``, words distinct).

    Two words are near if exactly one inserted, deleted or replaced code point leads
    from one to the other.  ``form`` is the near word of largest ``n`` (of equals the
    smallest in code-point order) if it is at least ``FORM_RATIO`` times as frequent,
    else null; ``form_n`` is its count.  ``root`` follows forms to the last, and is the
    word itself if it has none.

    Null and empty words are left out; an empty table gives an empty one.  Other
    columns are not read.  No cap on near words: cells report sums and best words.
    """
    usable = words.where("word <> '' and n is not null")
    own = stored(usable.select("word", F.col("n").cast("long").alias("n"), F.char_length("word").alias("size")), "words")
    met = _met(_routed(own, fit_cells(own, sample, cell)))
    absent = own.select(
        "word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("less"),
        F.lit(None).cast("string").alias("best"),
    )
    best = F.min(F.when(F.col("best").isNotNull(), F.struct("less", "best")))
    grouped = (
        absent.unionByName(met.withColumn("n", F.lit(None).cast("long")))
        .groupBy("word")
        .agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    )
    frequent = -F.col("best.less") >= FORM_RATIO * F.col("n")
    named = stored(
        grouped.select(
            "word", "n", "n_near",
            F.when(frequent, F.col("best.best")).alias("form"),
            F.when(frequent, -F.col("best.less")).alias("form_n"),
        ),
        "near-words",
    )
    roots = _roots(named.where("form is not null"))
    return named.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
