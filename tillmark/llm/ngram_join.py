"""N-gram Jaccard join with prefix filters under several global orders.

Two sets that reach the threshold share a token among the first ``n - need + 1``
tokens of each, whatever global order the tokens are put in.  Order A yields
candidate pairs; a pair survives only if its prefixes also meet under orders B and
C.  All orders put tokens that are frequent in the corpus last.

Documents with equal sets are one class.  Linked classes form components, and a
pair inside a component that is already connected needs no check of its own, so
large groups of near copies cost one check for each member rather than for each
pair:

1. tokens of order-A prefixes meet by token.  A class goes with one other, the one
   that it meets first under most of its tokens, if these are a good part of its
   prefix.  The two texts are fetched, and the other filters and the verification
   are applied to them at once;
2. up to ``GROUP`` classes of a token then give all pairs across components.  Parity
   bits of the sets rule out most of them before texts are fetched;
3. larger groups in several components are compared exhaustively in blocks, first
   within blocks and then, across what is still apart, between them.  By parity bits a
   block finds the classes that any pair is left of.  With their texts it judges a pair
   at the first token that both prefixes hold, and returns only links that join two
   components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tillmark.llm.components import connected_components
from tillmark.llm.kernels import NOT_SPACE, Lookup, Texts, gram_hashes, mix, pieces, signed, words
from tillmark.llm.storage import stored

SHINGLE = 5
# need intersection / union >= 4 / 5, so intersection >= 4 / 9 of both sizes
ORDER_B, ORDER_C = 101, 202
ORDER_A = 303
# shingles of one counting round in a task, and how often one must occur there to count
ROUND = 1 << 21
LOCAL = 4
# frequent shingles every task knows (12 bytes each)
FREQUENT = 1 << 19
GROUP = 32
BLOCK = 1 << 11
# a class is paired at once if it meets the other at a ``SURE``-th of its prefix
SURE = 4


def needed(a: int | np.ndarray, b: int | np.ndarray):
    """Smallest intersection of sets of these sizes that links them."""
    return -(-4 * (a + b) // 9)


@dataclass
class Sets:
    """Distinct shingles by row, each row's in ascending order."""

    tokens: np.ndarray
    rows: np.ndarray
    sizes: np.ndarray

    def signatures(self) -> np.ndarray:
        total = np.zeros(len(self.sizes), dtype=np.uint64)
        np.add.at(total, self.rows, mix(self.tokens, 41))
        return mix(total + self.sizes.astype(np.uint64), 43)


def shingle_sets(texts: Texts, width: int = SHINGLE) -> Sets:
    found = words(texts, NOT_SPACE)
    counts = np.diff(found.offsets)
    grams = gram_hashes(found.hashes, width)
    ends = np.repeat(found.offsets[1:], counts)
    starts = np.flatnonzero(np.arange(len(grams)) + width <= ends[: len(grams)])
    tokens = [grams[starts]]
    rows = [np.searchsorted(found.offsets, starts, side="right") - 1]
    for m in range(1, width):
        short = np.flatnonzero(counts == m)
        if len(short):
            index = found.offsets[short][:, None] + np.arange(m)
            tokens.append(gram_hashes(found.hashes[index].ravel(), m)[::m])
            rows.append(short)
    token, row = np.concatenate(tokens), np.concatenate(rows)
    if len(tokens) > 1:
        order = np.argsort(row, kind="stable")
        token, row = token[order], row[order]
    cuts = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
    for start, stop in zip(cuts, cuts[1:]):
        token[start:stop].sort()
    new = np.ones(len(token), dtype=bool)
    new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
    token, row = token[new], row[new]
    return Sets(token, row, np.bincount(row, minlength=len(texts)))


class Frequent:
    """How frequent a shingle is in the corpus, in half powers of two; 0 for most."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        steps = np.minimum(63, 2 * np.log2(counts.astype(float) + 1))
        self.table = Lookup(signed(tokens), steps.astype(np.float32))

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        return self.table(signed(tokens))[0].astype(np.uint64)


def order_key(tokens: np.ndarray, weight: np.ndarray, seed: int) -> np.ndarray:
    """Place of tokens in one global order, frequent ones last."""
    return (weight << np.uint64(58)) | (mix(tokens, seed) >> np.uint64(6))


def prefixes(sets: Sets, weight: np.ndarray, seed: int, ordered: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index into ``sets`` of every row's prefix under one order; if ``ordered``, in
    that order and with the position there."""
    key = order_key(sets.tokens, weight, seed)
    ends = np.cumsum(sets.sizes)
    index, pos = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for row in np.flatnonzero(sets.sizes).tolist():
        n, end = int(sets.sizes[row]), int(ends[row])
        count, part = n // 5 + 1, key[end - n : end]
        if ordered:
            chosen = np.argsort(part, kind="stable")[:count]
            pos.append(np.arange(count))
        else:
            chosen = np.argpartition(part, count - 1)[:count]
        index.append(chosen + (end - n))
    return np.concatenate(index), np.concatenate(pos)


def parity_bits(tokens: np.ndarray) -> np.ndarray:
    """Parity of the tokens in each of at least twice as many slots, packed."""
    slots = 1 << max(6, int(2 * len(tokens) - 1).bit_length())
    at = (tokens & np.uint64(slots - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=slots) & 1).astype(np.uint8), bitorder="little")


def _fold_to(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def may_link(na: int, a: np.ndarray, nb: int, b: np.ndarray) -> bool:
    """False only if the parity bits prove that too many shingles differ."""
    size = min(len(a), len(b))
    differ = int(np.bitwise_count(_fold_to(a, size) ^ _fold_to(b, size)).sum())
    return (na + nb - differ) // 2 >= needed(na, nb)


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def row_ref(doc_id: Column, text: Column) -> Column:
    """Names a row by id and text; only rows that repeat both share it."""
    return F.concat_ws(" ", doc_id.cast("string"), F.xxhash64(F.coalesce(text, F.lit(""))).cast("string"))


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, ref, text``."""
    return docs.select("doc_id", row_ref(F.col("doc_id"), F.col("text")).alias("ref"), "text")


def set_headers(docs: DataFrame) -> DataFrame:
    """``doc_id, ref, n, sig, bits`` of every row: size, signature and parity bits of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in pieces(batch.column(2)):
                sets = shingle_sets(texts)
                part = batch.slice(texts.first, len(texts))
                ends = np.cumsum(sets.sizes).tolist()
                bits = [parity_bits(sets.tokens[e - n : e]).tobytes() if n else None for e, n in zip(ends, sets.sizes.tolist())]
                yield _batch(
                    ["doc_id", "ref", "n", "sig", "bits"], part.column(0), part.column(1), sets.sizes,
                    signed(sets.signatures()), pa.array(bits, pa.binary()),
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _keyed(docs).mapInArrow(run, f"doc_id {kind}, ref string, n long, sig long, bits binary")


def frequent_shingles(docs: DataFrame) -> Frequent:
    """Shingles that many documents share, with their counts.

    Each task counts ``ROUND`` shingles at a time over all its texts and reports
    those it met ``LOCAL`` times.  Of the sums, the most frequent ``FREQUENT`` (or
    fewer, where counts tie) go to all tasks.  They only shape the order, so what
    is left out costs time and no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= LOCAL
            return _batch(["token", "n"], signed(tokens[often]), counts[often])

        for batch in batches:
            for texts in pieces(batch.column(0)):
                held.append(shingle_sets(texts).tokens)
                if sum(map(len, held)) >= ROUND:
                    yield counted()
                    held = []
        if held:
            yield counted()

    counts = stored(
        docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")),
        "shingle-counts",
    )
    total = counts.count()
    if total > FREQUENT:
        cut = counts.agg(F.percentile_approx("n", 1 - FREQUENT / total, 100_000)).first()[0]
        counts = counts.where(F.col("n") > cut)
    table = counts.toArrow()
    return Frequent(
        table.column("token").to_numpy().view(np.uint64), table.column("n").to_numpy()
    )


def _scan(docs: DataFrame, frequent, make, schema: str) -> DataFrame:
    """``make(sets, signatures, rows)`` over texts; a partition shows each set once."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh, seen = shared.value, set()
        for batch in batches:
            for texts in pieces(batch.column(0)):
                sets = shingle_sets(texts)
                sigs = sets.signatures()
                fresh = []
                for row in np.flatnonzero(sets.sizes).tolist():
                    sig = int(sigs[row])
                    if sig not in seen:
                        seen.add(sig)
                        fresh.append(row)
                chosen = np.zeros(len(texts), dtype=bool)
                chosen[fresh] = True
                keep = chosen[sets.rows]
                part = Sets(sets.tokens[keep], sets.rows[keep], np.where(chosen, sets.sizes, 0))
                yield make(part, sigs, weigh(part.tokens))

    return docs.select("text").mapInArrow(run, schema)


def prefix_tokens(docs: DataFrame, frequent: Frequent) -> DataFrame:
    """``token, sig, n, pos`` of every order-A prefix token of every class."""

    def make(sets: Sets, sigs: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
        index, pos = prefixes(sets, weight, ORDER_A, True)
        rows = sets.rows[index]
        place = (sets.sizes[rows] << 32) | pos
        return _batch(["token", "sig", "place"], signed(sets.tokens[index]), signed(sigs[rows]), place)

    return _scan(docs, frequent, make, "token long, sig long, place long")


def fits(x: int, y: int) -> bool:
    """May sets with a common prefix token at these places (size, position) link?"""
    nx, ny = x >> 32, y >> 32
    if 5 * min(nx, ny) < 4 * max(nx, ny):
        return False
    need = needed(nx, ny)
    return (x & 0xFFFFFFFF) <= nx - need and (y & 0xFFFFFFFF) <= ny - need


def shared_tokens(tokens: DataFrame, group: int = GROUP) -> DataFrame:
    """``token, sig, place, first`` of tokens that several classes hold in their prefix.

    ``first`` is the first of the token's first ``group`` classes, by signature, that
    ``sig`` may link with, null if there is none before it.  Streams a token's classes
    and holds at most ``group`` of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list, list] = ([], [], [], [])

        def flushed():
            made = _batch(["token", "sig", "place", "first"], *(pa.array(c, pa.int64()) for c in out))
            for column in out:
                column.clear()
            return made

        for token, rows in groupby(_stream(batches), key=lambda r: r[0]):
            held: list[tuple[int, int]] = []
            last = None
            for _, sig, place in rows:
                if sig == last:
                    continue
                last = sig
                first = next((other for other, at in held if fits(at, place)), None)
                for column, value in zip(out, (token, sig, place, first)):
                    column.append(value)
                if len(held) < group:
                    held.append((sig, place))
            # a token of one class, in several rows, is not shared
            if len(held) == 1:
                for column in out:
                    column.pop()
            if len(out[0]) >= 1 << 16:
                yield flushed()
        yield flushed()

    met = tokens.repartition("token").sortWithinPartitions("token", "sig")
    return met.mapInArrow(run, "token long, sig long, place long, first long")


def first_pairs(members: DataFrame) -> DataFrame:
    """``a, b``: every class ``b`` with the one that is ``first`` at most of its tokens.

    Only if these are a ``SURE``-th of its prefix; other pairs come later.
    """
    prefix = F.floor(F.shiftright("place", 32) / 5) + 1
    met = members.where("first is not null").groupBy("sig", "first", prefix.alias("prefix"))
    counted = met.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * SURE >= F.col("prefix"))
    most = F.max_by("first", F.struct("n", -F.col("first")))
    return counted.groupBy("sig").agg(most.alias("a")).select("a", F.col("sig").alias("b"))


def _labelled(members: DataFrame, components: DataFrame) -> DataFrame:
    """``token, sig, place, component`` of members; alone, a class is a component."""
    named = components.select(F.col("node").alias("sig"), "component")
    rows = members.select("token", "sig", "place").join(named, "sig", "left")
    return rows.withColumn("component", F.coalesce("component", "sig")).select("token", "sig", "place", "component")


def met_across(members: DataFrame, components: DataFrame) -> DataFrame:
    """Pairs across components at tokens of few classes, and the members of larger groups.

    A row with ``token`` null is a pair ``sig, place``; others are members.  Streams a
    token's classes and holds at most ``GROUP`` of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "sig", "place", "component"]
        out: tuple[list, ...] = ([], [], [], [])

        def put(*row):
            for column, value in zip(out, row):
                column.append(value)

        def flushed():
            made = _batch(names, *(pa.array(c, pa.int64()) for c in out))
            for column in out:
                column.clear()
            return made

        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for token, group in groupby(rows, key=lambda r: r[0]):
            held = list(islice(group, GROUP + 1))
            if len(held) > GROUP:
                for row in chain(held, group):
                    put(*row)
                    if len(out[0]) >= 1 << 16:
                        yield flushed()
                continue
            for k, (_, sig, place, component) in enumerate(held):
                for _, other, at, label in held[:k]:
                    if label != component and fits(at, place):
                        put(None, other, sig, None)
            if len(out[0]) >= 1 << 16:
                yield flushed()
        yield flushed()

    met = _labelled(members, components).repartition("token").sortWithinPartitions("token", "sig")
    return met.mapInArrow(run, "token long, sig long, place long, component long")


def still_open(members: DataFrame) -> DataFrame:
    """``members`` with ``n``, the number of classes, of tokens whose classes are in several components."""
    groups = (
        members.groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low <> high")
        .select("token", "n")
    )
    return members.join(groups, "token").select("token", "sig", "place", "component", "n")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int]]:
    """Rows whose token also occurs in a neighbouring row; single tokens are skipped."""
    carried = None
    for batch in batches:
        if carried is not None:
            batch = pa.concat_batches([carried, batch])
        carried = batch.slice(batch.num_rows - 1)
        token = batch.column(0).to_numpy()
        same = token[1:] == token[:-1]
        keep = np.zeros(len(token), dtype=bool)
        keep[1:] |= same
        keep[:-1] |= same
        # the last row waits for the next batch
        yield from zip(*(c.to_numpy()[:-1][keep[:-1]].tolist() for c in batch.columns))
    if carried is not None:
        yield from zip(*(c.to_pylist() for c in carried.columns))


def filtered(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose sizes and parity bits allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(k).to_pylist() for k in (2, 4))
            bits = [[np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(k)] for k in (3, 5)]
            keep = [
                5 * min(a, b) >= 4 * max(a, b) and may_link(a, x, b, y) for a, x, b, y in zip(na, bits[0], nb, bits[1])
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def side(name: str) -> DataFrame:
        return classes.select(F.col("sig").alias(name), F.col("n").alias(f"n{name}"), F.col("bits").alias(f"bits{name}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "bitsa", "nb", "bitsb")
    return both.mapInArrow(run, "a long, b long")


def meet_by_order(left: Sets, right: Sets, weigh: Frequent) -> np.ndarray:
    """Rows whose prefixes share a token under order B and under order C."""
    good = np.ones(len(left.sizes), dtype=bool)
    for seed in (ORDER_B, ORDER_C):
        found = []
        for sets in (left, right):
            index = np.sort(prefixes(sets, weigh(sets.tokens), seed, False)[0])
            found.append((sets.tokens[index], sets.rows[index]))
        token, row = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((token, row))
        token, row = token[order], row[order]
        both = (token[1:] == token[:-1]) & (row[1:] == row[:-1])
        good &= np.bincount(row[1:][both], minlength=len(good)) > 0
    return good


def class_texts(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``sig, text`` of the wanted classes: the text of the row that a class's ref names."""
    refs = wanted.select("sig").distinct().join(classes.select("sig", "ref"), "sig")
    found = _keyed(docs).select("ref", "text").join(refs, "ref").select("sig", "text")
    return stored(found.dropDuplicates(["sig"]), "texts")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, frequent: Frequent) -> DataFrame:
    """Pairs of classes that pass the filters of orders B and C and whose whole texts reach the threshold."""
    weigh = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for at in range(0, batch.num_rows, 256):
                good.append(linked(batch.slice(at, 256)))
            yield batch.select(["a", "b"]).filter(pa.array(np.concatenate(good)))

    def linked(part: pa.RecordBatch) -> np.ndarray:
        sides = []
        for name, text in (("a", "text_a"), ("b", "text_b")):
            tokens, rows, sizes, sigs = [], [], [], []
            for texts in pieces(part.column(text)):
                sets = shingle_sets(texts)
                tokens.append(sets.tokens)
                rows.append(sets.rows + texts.first)
                sizes.append(sets.sizes)
                sigs.append(sets.signatures())
            own = signed(np.concatenate(sigs)) == part.column(name).to_numpy()
            sides.append((np.concatenate(tokens), np.concatenate(rows), np.concatenate(sizes), own))
        (t1, r1, n1, own1), (t2, r2, n2, own2) = sides
        own1 &= meet_by_order(Sets(t1, r1, n1), Sets(t2, r2, n2), weigh.value)
        token, row = np.concatenate([t1, t2]), np.concatenate([r1, r2])
        order = np.lexsort((token, row))
        token, row = token[order], row[order]
        both = (token[1:] == token[:-1]) & (row[1:] == row[:-1])
        shared = np.bincount(row[1:][both], minlength=part.num_rows)
        return own1 & own2 & (100 * shared >= 80 * (n1 + n2 - shared))

    wanted = pairs.select(F.col("a").alias("sig")).union(pairs.select("b"))
    texts = class_texts(wanted, classes, docs)
    left = texts.select(F.col("sig").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("sig").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(
        run, "a long, b long"
    ).distinct()


class _Side:
    """Classes of one block, with the parity bits of their sets."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows
        sigs, places, self.components, bits = zip(*(r[:4] for r in rows))
        self.sigs, place = np.array(sigs), np.array(places)
        self.size, self.pos = place >> 32, place & 0xFFFFFFFF
        self.bits = [np.frombuffer(b, np.uint8) for b in bits]
        self.width = np.array([len(b) for b in self.bits])
        self._folded: dict[int, np.ndarray] = {}

    def folded(self, width: int) -> np.ndarray:
        """Parity bits of all that have at least ``width`` bytes, folded to it."""
        if width not in self._folded:
            none = np.zeros(width, np.uint8)
            rows = [_fold_to(b, width) if len(b) >= width else none for b in self.bits]
            self._folded[width] = np.stack(rows)
        return self._folded[width]

    def left_of(self, other: _Side, i: int, apart: np.ndarray) -> np.ndarray:
        """Classes of ``other`` that class ``i`` may link with; only where ``apart``."""
        n, own = int(self.size[i]), self.bits[i]
        need = needed(n, other.size)
        near = apart & (5 * np.minimum(n, other.size) >= 4 * np.maximum(n, other.size))
        near &= (self.pos[i] <= n - need) & (other.pos <= other.size - need)
        rest, found = np.flatnonzero(near), [np.zeros(0, dtype=np.int64)]
        for width in np.unique(np.minimum(other.width[rest], len(own))).tolist():
            some = rest[np.minimum(other.width[rest], len(own)) == width]
            differ = np.bitwise_count(other.folded(width)[some] ^ _fold_to(own, width)).sum(axis=1, dtype=np.int64)
            found.append(some[(n + other.size[some] - differ) // 2 >= need[some]])
        return np.concatenate(found)

    def read(self, weigh: Frequent) -> None:
        """Sets and prefixes of the rows' texts."""
        self.sets, self.first, self.others = [], [], []
        for part in pieces(pa.array([r[4] for r in self.rows], pa.string())):
            sets = shingle_sets(part)
            weight = weigh(sets.tokens)
            chosen = [prefixes(sets, weight, seed, False)[0] for seed in (ORDER_A, ORDER_B, ORDER_C)]
            ends, cuts = np.cumsum(sets.sizes), np.cumsum(np.where(sets.sizes > 0, sets.sizes // 5 + 1, 0))
            for row, end in enumerate(ends.tolist()):
                cut = slice(int(cuts[row - 1]) if row else 0, int(cuts[row]))
                a, b, c = (np.sort(sets.tokens[index[cut]]) for index in chosen)
                self.sets.append(sets.tokens[end - int(sets.sizes[row]) : end])
                self.first.append((a, order_key(a, weigh(a), ORDER_A)))
                self.others.append((b, c))


def _left_over(left: _Side, right: _Side) -> tuple[list[int], list[int]]:
    """Classes of two blocks that any pair across components is left of, by place in the blocks."""
    label = np.array(right.components)
    ours, theirs = set(), set()
    for i in range(len(left.rows)):
        found = left.left_of(right, i, label != left.components[i])
        if len(found):
            ours.add(i)
            theirs.update(found.tolist())
    return sorted(ours), sorted(theirs)


class _Holders:
    """Rows of a block by the tokens that they hold."""

    def __init__(self, held: list[np.ndarray]):
        token, row = np.concatenate(held), np.repeat(np.arange(len(held)), [len(h) for h in held])
        order = np.argsort(token, kind="stable")
        self.size, self.rows = len(held), row[order]
        self.tokens, starts = np.unique(token[order], return_index=True)
        self.cuts = np.append(starts, len(token)).tolist()

    def any_of(self, tokens: np.ndarray) -> np.ndarray:
        """Which rows hold any of the tokens?"""
        found = np.zeros(self.size, dtype=bool)
        for k in np.flatnonzero(np.isin(self.tokens, tokens, assume_unique=True)).tolist():
            found[self.rows[self.cuts[k] : self.cuts[k + 1]]] = True
        return found


def _block_links(token: int, left: _Side, right: _Side, weigh: Frequent) -> list[tuple[int, int]]:
    """Links of two blocks of a token's classes that join components; others are not needed.

    A pair is judged here only if ``token`` is the first that both prefixes hold.  What
    excludes a pair by its prefixes is looked up for a class and all of the other block.
    """
    names = {c: k for k, c in enumerate(dict.fromkeys((*left.components, *right.components)))}
    top = list(range(len(names)))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    own = np.array([token & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64)
    place = order_key(own, weigh(own), ORDER_A)[0]
    earlier = _Holders([a[keys < place] for a, keys in right.first])
    meets = [_Holders([others[k] for others in right.others]) for k in range(2)]
    ours, theirs = ([names[c] for c in side.components] for side in (left, right))
    roots = np.array(theirs)
    found = []
    for i in range(len(left.rows)):
        near = left.left_of(right, i, roots != find(ours[i]))
        a, keys = left.first[i]
        if len(near):
            near = near[~earlier.any_of(a[keys < place])[near]]
        for holders, tokens in zip(meets, left.others[i]):
            if len(near):
                near = near[holders.any_of(tokens)[near]]
        for k in near.tolist():
            if find(ours[i]) != find(theirs[k]) and _linked(left.sets[i], right.sets[k]):
                x, y = find(ours[i]), find(theirs[k])
                top[max(x, y)] = min(x, y)
                found.append(tuple(sorted((int(left.sigs[i]), int(right.sigs[k])))))
                roots = np.array([find(c) for c in theirs])
    return found


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= 80 * (len(x) + len(y) - shared)


BLOCKED = "token long, x int, y int, side int, sig long, place long, component long, bits binary"


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list, list]]:
    """(token, x, y), rows of side 0 and rows of side 1, without these columns."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    for key, group in groupby(rows, key=lambda r: r[:3]):
        sides: tuple[list, list] = ([], [])
        for row in group:
            sides[row[3]].append(row[4:])
        yield key, *sides


def blocks_of(members: DataFrame, classes: DataFrame, diagonal: bool, block: int = BLOCK) -> DataFrame:
    """Open members in blocks (``BLOCKED``), without those that parity bits leave no pair of.

    Blocks of hashed members meet in tasks of their own: each with itself, or each with
    every other one.
    """
    rows = members.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    if diagonal:
        rows = rows.withColumn("other", F.col("mine"))
    else:
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> mine")
    met = rows.join(classes.select("sig", "bits"), "sig").select(
        "token",
        F.least("mine", "other").alias("x"),
        F.greatest("mine", "other").alias("y"),
        F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"),
        "sig",
        "place",
        "component",
        "bits",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in BLOCKED.split(", ")]
        for (token, x, y), ours, theirs in _by_block(batches):
            if not ours or (x != y and not theirs):
                continue
            left = _Side(ours)
            right = left if x == y else _Side(theirs)
            some, others = _left_over(left, right)
            if x == y:
                some, others = sorted({*some, *others}), []
            kept = [(token, x, y, 0, *ours[i]) for i in some] + [(token, x, y, 1, *theirs[k]) for k in others]
            if kept:
                kinds = [pa.int64(), *[pa.int32()] * 3, *[pa.int64()] * 3, pa.binary()]
                yield _batch(names, *(pa.array(c, k) for c, k in zip(zip(*kept), kinds)))

    dealt = met.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y")
    return dealt.mapInArrow(run, BLOCKED)


def block_links(blocks: DataFrame, classes: DataFrame, docs: DataFrame, frequent: Frequent) -> DataFrame:
    """``a, b``: links that join components of open tokens, from their whole texts."""
    weigh = docs.sparkSession.sparkContext.broadcast(frequent)
    texts = class_texts(blocks, classes, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (token, x, y), ours, theirs in _by_block(batches):
            if not ours or (x != y and not theirs):
                continue
            left = _Side(ours)
            right = left if x == y else _Side(theirs)
            for side in {id(s): s for s in (left, right)}.values():
                side.read(weigh.value)
            found = _block_links(token, left, right, weigh.value)
            yield _batch(["a", "b"], *(pa.array([p[i] for p in found], pa.int64()) for i in range(2)))

    dealt = blocks.join(texts, "sig").select(*[c.split(" ")[0] for c in BLOCKED.split(", ")], "text")
    dealt = dealt.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def similar_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, ref`` of every row of ``docs``.

    A row's set holds the distinct shingles of ``SHINGLE`` words, A-Z lower-cased;
    fewer words are one shingle together.  Sets link if intersection / union is at
    least 0.8; ``component_id`` is the smallest ``doc_id`` reachable by links.

    A missing or empty text, or one without words, has an empty set that links
    with nothing.  Repeated rows have equal sets and one component.  A row without
    id links like any other but is never the smallest; alone it has no component.
    Sets are told apart by 64-bit hashes.
    """
    return keyed_components(docs).drop("component")


def keyed_components(docs: DataFrame) -> DataFrame:
    """``similar_components`` with ``component``: the group's smallest signature, null for an empty set."""
    headers = stored(set_headers(docs), "set-headers")
    classes = stored(
        headers.where("n > 0")
        .groupBy("sig")
        .agg(F.min("doc_id").alias("first_id"), F.min("ref").alias("ref"), F.first("n").alias("n"), F.first("bits").alias("bits")),
        "set-classes",
    )
    frequent = frequent_shingles(docs)
    members = stored(shared_tokens(prefix_tokens(docs, frequent)), "shared-tokens")
    links = stored(verified(first_pairs(members), classes, docs, frequent), "links")
    joined = stored(connected_components(links, "edges"), "components")
    met = stored(met_across(members, joined), "met-across")
    pairs = met.where("token is null").select(F.col("sig").alias("a"), F.col("place").alias("b")).distinct()
    passed = stored(filtered(pairs, classes), "filtered-pairs")
    if not passed.isEmpty():
        links = links.union(stored(verified(passed, classes, docs, frequent), "links"))
    crowded = met.where("token is not null")
    left = stored(still_open(crowded), "open-tokens")
    if not left.isEmpty():
        within = stored(blocks_of(left, classes, True), "blocks")
        links = links.union(stored(block_links(within, classes, docs, frequent), "links"))
        joined = stored(connected_components(links, "edges"), "components")
        apart = still_open(_labelled(crowded, joined)).where(F.col("n") > BLOCK)
        between = stored(blocks_of(apart, classes, False), "blocks")
        if not between.isEmpty():
            links = links.union(stored(block_links(between, classes, docs, frequent), "links"))
    joined = stored(connected_components(links, "edges"), "components")

    labelled = classes.drop("bits", "n").join(joined.withColumnRenamed("node", "sig"), "sig", "left").withColumn(
        "component", F.coalesce("component", "sig")
    )
    lowest = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_class = labelled.join(lowest, "component").select("sig", "component", "component_id")
    return headers.drop("bits").join(by_class, "sig", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "ref",
        F.when(F.col("n") > 0, F.col("component")).alias("component"),
    )
