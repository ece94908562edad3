"""Stretches of a text that repeat one phrase again and again, and texts without the repeats.

Words are the letters of the search.  A run is a stretch with smallest period q that
no neighbouring word extends.  Every run holds a Lyndon root: for one of the two
orders of the words (ascending, descending), the longest Lyndon word at some position
of the run is one period long.  So:

1. Ukkonen suffix trees of a stretch and of its reversal;
2. an Euler tour of each, with a sparse table of minima over string depths: the
   lowest common ancestor of two leaves, and so the longest common extension of two
   positions, in constant time and for many pairs at once;
3. the longest Lyndon word at every position, from the next smaller suffix in the
   order of the tree's leaves, for both orders of the words;
4. each of these roots is extended to the left and to the right.

The trees are built on the parts of a text that can hold a run at all.  A run that is
long enough repeats each of its ``gram`` consecutive words one period further on, at
a distance of at most its length / exponent, so all its words lie in such repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tillmark.llm.kernels import NOT_SPACE, Texts, Words, gram_hashes, mix, pieces, words

MIN_LENGTH = 24
MIN_EXPONENT = 3

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class SuffixTree:
    """Ukkonen's tree of ``text``, whose last symbol 0 occurs nowhere else.

    Symbols are below ``size``; node 0 is the root, and children are in ascending
    order of their first symbol.
    """

    def __init__(self, text: list[int], size: int):
        n = len(text)
        start, stop, link = [0], [0], [0]
        edges: dict[int, int] = {}
        node = edge = length = waiting = 0
        for i, symbol in enumerate(text):
            unlinked = 0
            waiting += 1
            while waiting:
                if not length:
                    edge = i
                key = node * size + text[edge]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    if unlinked:
                        link[unlinked] = node
                    unlinked = node
                else:
                    first = start[child]
                    span = stop[child] - first
                    if length >= span:
                        node, edge, length = child, edge + span, length - span
                        continue
                    middle = first + length
                    if text[middle] == symbol:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    inner = len(start)
                    edges[key] = inner
                    start += (first, i)
                    stop += (middle, n)
                    link += (0, 0)
                    edges[inner * size + symbol] = inner + 1
                    start[child] = middle
                    edges[inner * size + text[middle]] = child
                    if unlinked:
                        link[unlinked] = inner
                    unlinked = inner
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self.n, self.size = n, size
        self.span = (np.array(stop) - np.array(start)).tolist()
        self.keys = np.fromiter(edges.keys(), np.int64, len(edges))
        self.kids = np.fromiter(edges.values(), np.int64, len(edges))

    def children(self, descending: bool = False) -> list[list[int]]:
        """Children of every node by first symbol; 0 comes first in either order."""
        parent, symbol = np.divmod(self.keys, self.size)
        if descending:
            symbol = (self.size - symbol) % self.size
        order = np.lexsort((symbol, parent))
        kids = self.kids[order].tolist()
        cuts = np.searchsorted(parent[order], np.arange(len(self.span) + 1)).tolist()
        return [kids[a:b] for a, b in zip(cuts, cuts[1:])]

    def suffix_ranks(self, descending: bool = False) -> np.ndarray:
        """Rank of every suffix in the order of the leaves."""
        children, span = self.children(descending), self.span
        order, stack, depths = [], [0], [0]
        while stack:
            node, depth = stack.pop(), depths.pop()
            below = children[node]
            if below:
                stack += reversed(below)
                depths += [depth + span[child] for child in reversed(below)]
            else:
                order.append(self.n - depth)
        ranks = np.empty(self.n, dtype=np.int64)
        ranks[order] = np.arange(self.n)
        return ranks


class Extensions:
    """Longest common prefixes of suffixes, by minima over the Euler tour of their tree."""

    def __init__(self, tree: SuffixTree):
        children, span, n = tree.children(), tree.span, tree.n
        tour: list[int] = []
        place = np.zeros(n, dtype=np.int64)
        leaves, places = [], []
        # a negative entry returns to a node at the string depth it holds
        stack, depths = [0], [0]
        while stack:
            node, depth = stack.pop(), depths.pop()
            if node < 0:
                tour.append(depth)
                continue
            below = children[node]
            if not below:
                leaves.append(n - depth)
                places.append(len(tour))
            tour.append(depth)
            for child in reversed(below):
                stack += (-1, child)
                depths += (depth, depth + span[child])
        place[leaves] = places
        self.place = place
        self.levels = [np.array(tour, dtype=np.int32)]
        for k in count():
            last, step = self.levels[-1], 1 << k
            if len(last) <= step:
                break
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``i`` and ``j``, which differ."""
        a, b = self.place[i], self.place[j]
        low, width = np.minimum(a, b), np.abs(a - b) + 1
        level = np.frexp(width.astype(np.float64))[1] - 1
        out = np.zeros(len(low), dtype=np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            table = self.levels[k]
            out[at] = np.minimum(table[low[at]], table[low[at] + width[at] - (1 << k)])
        return out


def _next_smaller(ranks: np.ndarray) -> np.ndarray:
    """Per suffix but the last, the next one to its right with a smaller rank."""
    rank = ranks.tolist()
    after = [0] * len(rank)
    for i in range(len(rank) - 2, -1, -1):
        j, own = i + 1, rank[i]
        while rank[j] > own:
            j = after[j]
        after[i] = j
    return np.array(after[:-1], dtype=np.int64)


def runs_of(
    symbols: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> np.ndarray:
    """``start, length, period`` of all runs of ``symbols`` (numbers from 1), by start and period.

    A run has at least ``min_length`` symbols and ``min_exponent`` (2 or more) periods.
    Takes about a kilobyte a symbol.
    """
    n = len(symbols)
    none = np.zeros((0, 3), dtype=np.int64)
    if n < max(min_length, min_exponent):
        return none
    size = int(symbols.max()) + 1
    forward = SuffixTree([*symbols.tolist(), 0], size)
    at, period = [], []
    for descending in (False, True):
        root = _next_smaller(forward.suffix_ranks(descending)) - np.arange(n)
        fits = np.flatnonzero(root * min_exponent <= n)
        at.append(fits)
        period.append(root[fits])
    i, q = np.concatenate(at), np.concatenate(period)
    after = Extensions(forward)(i, i + q)
    del forward
    # the symbol before position i is symbol n - i of the reversal
    before = Extensions(SuffixTree([*symbols[::-1].tolist(), 0], size))(n - i, n - i - q)
    start, length = i - before, before + q + after
    keep = length >= np.maximum(min_length, min_exponent * q)
    found = np.column_stack([start, length, q])[keep]
    return np.unique(found[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]] if len(found) else none


def repeated_stretches(
    found: Words, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> list[tuple[int, int]]:
    """Ranges of words that hold all runs, each range within one text.

    With period q, a run repeats at least ``min_length - q`` and at least ``(min_exponent
    - 1) * q`` words one period further on, hence every ``gram`` consecutive ones of
    them, at most a ``min_exponent``-th of its length away.  Words outside such
    repeats go; what is left bounds the distance again, until nothing goes.
    """
    gram = max(1, min_length * (min_exponent - 1) // min_exponent)
    total = len(found.hashes)
    grams = gram_hashes(found.hashes, gram)
    if not len(grams):
        return []
    bounds = found.offsets
    stretches = np.column_stack([bounds[:-1], bounds[1:]])
    while True:
        stretches = stretches[stretches[:, 1] - stretches[:, 0] >= max(min_length, min_exponent)]
        size = stretches[:, 1] - stretches[:, 0]
        if not len(stretches):
            return []
        inside = np.maximum(size - gram + 1, 0)
        owner = np.repeat(np.arange(len(size)), inside)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(inside) - inside, inside) + stretches[owner, 0]
        key = mix(grams[place] ^ mix(owner.astype(np.uint64), 3), 5)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        first, second = place[order[:-1][same]], place[order[1:][same]]
        near = (second - first) * min_exponent <= size[owner[order[:-1][same]]]
        steps = np.zeros(total + 1, dtype=np.int64)
        for side in (first[near], second[near]):
            np.add.at(steps, side, 1)
            np.add.at(steps, side + gram, -1)
        covered = np.cumsum(steps[:-1]) > 0
        # a stretch does not go on into the next text
        edges = np.zeros(total + 1, dtype=bool)
        edges[stretches.ravel()] = True
        begins = covered.copy()
        begins[1:] &= ~covered[:-1] | edges[1:total]
        ends = covered.copy()
        ends[:-1] &= ~covered[1:] | edges[1:total]
        left = np.column_stack([np.flatnonzero(begins), np.flatnonzero(ends) + 1])
        if len(left) == len(stretches) and (left == stretches).all():
            return [(a, b) for a, b in left.tolist()]
        stretches = left


def _symbols(data: memoryview, found: Words, start: int, stop: int) -> np.ndarray:
    """Words by number, from 1; equal bytes have equal numbers."""
    numbers: dict[bytes, int] = {}
    at = zip(found.starts[start:stop].tolist(), found.ends[start:stop].tolist())
    return np.array([numbers.setdefault(bytes(data[a:b]), len(numbers) + 1) for a, b in at], dtype=np.int64)


def _runs_by_row(texts: Texts, found: Words, min_length: int, min_exponent: int) -> np.ndarray:
    """``row, start, length, period`` of all runs; start counts the row's words."""
    out = [np.zeros((0, 4), dtype=np.int64)]
    data = memoryview(texts.data)
    for a, b in repeated_stretches(found, min_length, min_exponent):
        runs = runs_of(_symbols(data, found, a, b), min_length, min_exponent)
        if len(runs):
            row = int(np.searchsorted(found.offsets, a, side="right")) - 1
            runs[:, 0] += a - found.offsets[row]
            out.append(np.column_stack([np.full(len(runs), row), runs]))
    found_runs = np.concatenate(out)
    return found_runs[np.lexsort((found_runs[:, 3], found_runs[:, 1], found_runs[:, 0]))]


def _joined(texts: Texts, found: Words, keep: np.ndarray) -> pa.Array:
    """Kept words of every row, joined by one space."""
    size = (found.ends - found.starts)[keep]
    row = np.repeat(np.arange(len(texts)), np.diff(found.offsets))[keep]
    # every word brings a space with it; that of a row's last word goes
    into = np.cumsum(size + 1) - (size + 1)
    source = np.repeat(found.starts[keep] - into, size + 1) + np.arange(int((size + 1).sum()))
    body = texts.data[np.minimum(source, max(0, len(texts.data) - 1))] if len(source) else np.zeros(0, np.uint8)
    gap = into + size
    body[gap] = 0x20
    last = np.ones(len(row), dtype=bool)
    last[:-1] = row[1:] != row[:-1]
    body = np.delete(body, gap[last])
    width = np.bincount(row, weights=size + 1, minlength=len(texts)).astype(np.int64)
    width -= width > 0
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(width, out=offsets[1:])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))]
    return pa.Array.from_buffers(pa.large_utf8(), len(texts), buffers).cast(pa.string())


def collapse_runs(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.  ``runs`` lists ``start, length,
    period`` of every run with at least ``min_length`` words and ``min_exponent``
    periods, by start and period.  ``collapsed`` joins the words by one space, without
    those that any run contains after its first period.

    A missing or empty text, or one of spaces only, has no words and no runs and
    collapses to the empty text.  Rows are judged one by one, so repeated rows, ties
    and missing ids need no rule; only ``doc_id`` and ``text`` are read.  Periods are
    found exactly at every length; a repeating stretch takes about a kilobyte a word.
    """
    if min_exponent < 2 or min_length < 1:
        raise ValueError("min_exponent must be 2 or more and min_length 1 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in pieces(batch.column(1)):
                found = words(texts, NOT_SPACE, fold=False)
                runs = _runs_by_row(texts, found, min_length, min_exponent)
                steps = np.zeros(len(found.starts) + 1, dtype=np.int64)
                at = found.offsets[runs[:, 0]] + runs[:, 1]
                np.add.at(steps, at + runs[:, 3], 1)
                np.add.at(steps, at + runs[:, 2], -1)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(runs[:, 0], np.arange(len(texts) + 1)), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], fields=list(RUN)),
                )
                collapsed = _joined(texts, found, np.cumsum(steps[:-1]) == 0)
                ids = batch.column(0).slice(texts.first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.diff(found.offsets)), lists, collapsed], ["doc_id", "n_words", "runs", "collapsed"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
