"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors whose cosine reaches the threshold have a squared distance of at most
``2 - 2 * threshold``.  Cut into blocks of coordinates, two such vectors cannot exceed
their share of it in every block.  So:

1. equal vectors become one class with a count; classes are scaled to length one and
   rotated to principal axes, and each block gets a share of the squared distance in
   proportion to the variance it holds;
2. every block is range-joined under its own share: a k-d tree cuts the block into cells
   of about ``CELL`` classes, a class lives in one of them and visits each later one
   whose box lies within its share;
3. in a cell, pairs within the share are verified exactly, in double precision, on the
   vectors as given.  A pair that several blocks find belongs to the first of them.

Axes, shares and cuts come from a bounded sample; they place the work and exclude no
pair.  A cell returns a count per class and a forest of links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillmark.llm.components import connected_components
from tillmark.llm.storage import stored

THRESHOLD = 0.9
BLOCKS = 8
CELL = 1 << 15
SAMPLE = 1 << 16
LEAST_SAMPLED = 16
CHUNK = 1 << 11
# rows of a tile of a cell, rows compared with it at once, and pairs verified at once
TILE = 1 << 10
STRIP = 1 << 9
PAIRS = 1 << 14
# rounding of scaled and rotated coordinates, relative to a squared distance
SLACK = 1e-9
# rounding of single precision, in which far pairs are told apart first
SINGLE = 1e-5


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as doubles, filled up with zeros to ``width``, and their own lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = np.asarray(column.offsets)
    size = np.diff(ends)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)[ends[0] : ends[-1]]
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], size)] = flat
    return out, size


def _summed(x: np.ndarray) -> np.ndarray:
    """Row sums, added column by column: the same for a row in whatever batch it comes."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += x[:, k]
    return total


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near one."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt(_summed(x * x))[:, None]


@dataclass
class Layout:
    """Rotation, blocks of rotated coordinates, their shares, and the cells of each block."""

    rotation: np.ndarray
    bounds: list[tuple[int, int]]
    shares: np.ndarray
    cuts: list[list[tuple]]

    @property
    def width(self) -> int:
        return len(self.rotation)

    def rotated(self, units: np.ndarray) -> np.ndarray:
        """A row's result does not depend on the batch, so every task sees the same one."""
        out = np.zeros_like(units)
        for k in range(units.shape[1]):
            out += units[:, k : k + 1] * self.rotation[k]
        return out

    def reached(self, block: int, x: np.ndarray, share: float) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
        """Leaves (first cell, number of cells) with the rows of ``x`` within ``share`` of their boxes."""
        cuts = self.cuts[block]
        stack = [(0, np.arange(len(x)), np.zeros_like(x), np.zeros(len(x)))]
        while stack:
            node, rows, gaps, spent = stack.pop()
            if not len(rows):
                continue
            cut = cuts[node]
            if len(cut) == 2:
                yield cut, rows
                continue
            axis, at, low, high = cut
            beyond = x[rows, axis] - at
            for child, away in ((low, np.maximum(beyond, 0)), (high, np.maximum(-beyond, 0))):
                # a point on the cut lives below it
                own = beyond <= 0 if child == low else beyond > 0
                gap = np.maximum(gaps[:, axis], away)
                cost = spent - gaps[:, axis] ** 2 + gap**2
                fits = own if share < 0 else own | (cost <= share)
                inside = gaps[fits].copy()
                inside[:, axis] = np.where(own, gaps[:, axis], gap)[fits]
                stack.append((child, rows[fits], inside, np.where(own, spent, cost)[fits]))

    def cells(self, block: int, x: np.ndarray, hashed: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(cell, side, rows): side 0 lives there, side 1 visits."""
        home = np.zeros(len(x), dtype=np.int64)
        for (first, parts), rows in self.reached(block, x, -1.0):
            home[rows] = first + hashed[rows] % parts
        for cell in np.unique(home).tolist():
            yield cell, 0, np.flatnonzero(home == cell)
        for (first, parts), rows in self.reached(block, x, self.shares[block] * (1 + SLACK)):
            for cell in range(first, first + parts):
                visits = rows[home[rows] < cell]
                if len(visits):
                    yield cell, 1, visits


def _cuts(x: np.ndarray, rate: float, cell: int) -> list[tuple]:
    """Medians of the widest axis, until a cell holds about ``cell`` classes.

    Where no axis parts the sampled rows, a leaf has several cells and hashes choose.
    """
    cuts: list[tuple] = []
    cells = 0

    def add(rows: np.ndarray) -> int:
        nonlocal cells
        node = len(cuts)
        cuts.append(())
        expected = len(rows) / rate
        if expected > cell and len(rows) >= LEAST_SAMPLED:
            for axis in np.argsort(-x[rows].std(axis=0)).tolist():
                at = float(np.median(x[rows, axis]))
                low = x[rows, axis] <= at
                if low.any() and not low.all():
                    cuts[node] = (axis, at, add(rows[low]), add(rows[~low]))
                    return node
        parts = max(1, int(np.ceil(expected / cell)))
        cuts[node] = (cells, parts)
        cells += parts
        return node

    add(np.arange(len(x)))
    return cuts


def fit_layout(
    classes: DataFrame, threshold: float = THRESHOLD, blocks: int = BLOCKS, sample: int = SAMPLE, cell: int = CELL
) -> Layout:
    """From at most about ``sample`` classes, chosen by hash."""
    total, width = classes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    rate, steps = min(1.0, sample / max(1, total)), 1 << 30
    some = classes.where(F.pmod(F.col("h2"), F.lit(steps)) < int(rate * steps)).select("vector").toArrow()
    units = unit(_matrix(some.column("vector"), width)[0]) if some.num_rows else np.zeros((0, width))
    spread = units - units.mean(axis=0) if len(units) else units
    _, rotation = np.linalg.eigh(spread.T @ spread + 1e-12 * np.eye(width))
    rotation = np.ascontiguousarray(rotation[:, ::-1])
    edges = np.linspace(0, width, min(blocks, width) + 1).astype(int).tolist()
    bounds = list(zip(edges[:-1], edges[1:]))
    rotated = units @ rotation
    variance = rotated.var(axis=0) if len(units) else np.zeros(width)
    held = np.array([variance[a:b].sum() for a, b in bounds])
    # no block without a share, whatever the sample says
    held = held + held.mean() / 100 + 1e-300
    shares = (2 - 2 * threshold) * held / held.sum() * (1 + SLACK) + SLACK * 1e-3
    return Layout(rotation, bounds, shares, [_cuts(rotated[:, a:b], rate, cell) for a, b in bounds])


def _visits(classes: DataFrame, layout: Layout) -> DataFrame:
    """``block, cell, side, id, rows, vector`` for every cell that a class lives in or visits."""
    shared = classes.sparkSession.sparkContext.broadcast(layout)
    kind = classes.schema["vector"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                rotated = layout.rotated(unit(_matrix(part.column(2), layout.width)[0]))
                hashed = part.column(3).to_numpy()
                for block, (a, b) in enumerate(layout.bounds):
                    for cell, side, rows in layout.cells(block, rotated[:, a:b], hashed):
                        own = part.select(["id", "rows", "vector"]).take(pa.array(rows))
                        marks = [pa.array(np.full(len(rows), v), pa.int32()) for v in (block, cell, side)]
                        yield pa.RecordBatch.from_arrays([*marks, *own.columns], ["block", "cell", "side", "id", "rows", "vector"])

    given = classes.select("id", "rows", "vector", F.pmod("h1", F.lit(1 << 30)).alias("hashed"))
    return given.mapInArrow(run, f"block int, cell int, side int, id long, rows long, vector {kind}")


class _Rows:
    """Classes of a cell with all that a comparison needs."""

    def __init__(self, ids, rows, vectors, layout: Layout):
        given, self.size = _matrix(vectors, layout.width)
        self.ids, self.rows = ids, rows
        self.given = scaled(given)
        self.length = np.sqrt(_summed(self.given * self.given))
        units = self.given / self.length[:, None]
        self.units = units.astype(np.float32)
        self.rotated = layout.rotated(units)

    def __len__(self) -> int:
        return len(self.ids)

    def ordered(self, order: np.ndarray) -> None:
        for name in ("ids", "rows", "given", "length", "units", "rotated", "size"):
            setattr(self, name, getattr(self, name)[order])


def _tiles(x: np.ndarray) -> list[np.ndarray]:
    """Rows of ``x`` in tiles, cut at medians of the widest axis."""
    found, stack = [], [np.arange(len(x))]
    while stack:
        rows = stack.pop()
        if len(rows) <= TILE:
            found.append(rows)
            continue
        axis = int(np.argmax(np.ptp(x[rows], axis=0)))
        order = rows[np.argsort(x[rows, axis], kind="stable")]
        # whole tiles on one side
        half = (len(order) // TILE + 1) // 2 * TILE
        stack += [order[half:], order[:half]]
    return found


class _Forest:
    """Disjoint sets of the numbers below ``n``; a set goes by its smallest member."""

    def __init__(self, n: int):
        self.top = np.arange(n)

    def join(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Joins the sets of every x and y; which of these pairs it took."""
        taken = [np.zeros(0, dtype=np.int64)]
        while True:
            a, b = self.top[x], self.top[y]
            apart = np.flatnonzero(a != b)
            if not len(apart):
                return np.concatenate(taken)
            high, low = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
            # each larger top hangs below one smaller top, so no circle can close
            tops, first = np.unique(high, return_index=True)
            self.top[tops] = low[first]
            taken.append(apart[first])
            while (further := self.top[self.top]).tobytes() != self.top.tobytes():
                self.top = further


class _Cell:
    """The classes that live in a cell of a block; counts links of these and of visitors."""

    def __init__(self, block: int, layout: Layout, threshold: float):
        self.block, self.layout, self.threshold = block, layout, threshold
        self.parts: list[tuple] = []
        self.own: _Rows | None = None

    def add(self, ids, rows, vectors) -> None:
        self.parts.append((ids, rows, vectors))

    def _seal(self) -> Iterator[pa.RecordBatch]:
        """Takes no further classes; the links inside."""
        if self.own is not None:
            return
        ids, rows, vectors = zip(*self.parts)
        self.own = _Rows(np.concatenate(ids), np.concatenate(rows), pa.concat_arrays(vectors), self.layout)
        a, b = self.layout.bounds[self.block]
        tiles = _tiles(self.own.rotated[:, a:b])
        self.own.ordered(np.concatenate(tiles))
        self.tiles, at = [], 0
        for tile in tiles:
            y = self.own.rotated[at : at + len(tile), a:b]
            # one product of matrices yields squared distances; filled up to whole words with far points
            side = np.full((y.shape[1] + 2, len(tile) + -len(tile) % 8), 9, dtype=np.float32)
            side[:, : len(tile)] = np.column_stack([y, np.ones(len(y)), (y * y).sum(axis=1)]).T
            side[:-1, len(tile) :] = 0
            self.tiles.append((at, y.min(axis=0), y.max(axis=0), side))
            at += len(tile)
        self.counts = np.zeros(len(self.own), dtype=np.int64)
        self.forest = _Forest(len(self.own))
        own = self.own
        for at in range(0, len(own), CHUNK):
            for i, j in self._linked_pairs(own, slice(at, at + CHUNK), True):
                np.add.at(self.counts, i, own.rows[j])
                np.add.at(self.counts, j, own.rows[i])
                new = self.forest.join(i, j)
                if len(new):
                    yield _found(own.ids[i[new]], own.ids[j[new]], None)

    def visited(self, ids, rows, vectors) -> Iterator[pa.RecordBatch]:
        yield from self._seal()
        own = self.own
        for at in range(0, len(ids), CHUNK):
            part = slice(at, at + CHUNK)
            asking = _Rows(ids[part], rows[part], vectors.slice(at, CHUNK), self.layout)
            counts = np.zeros(len(asking), dtype=np.int64)
            # a visitor's first link; what else it links with joins that class's set
            first = np.full(len(asking), -1)
            for i, j in self._linked_pairs(asking, slice(None), False):
                np.add.at(counts, i, own.rows[j])
                np.add.at(self.counts, j, asking.rows[i])
                who, place = np.unique(i, return_index=True)
                fresh = place[first[who] < 0]
                first[i[fresh]] = j[fresh]
                new = np.union1d(fresh, self.forest.join(first[i], j))
                if len(new):
                    yield _found(asking.ids[i[new]], own.ids[j[new]], None)
            yield _found(asking.ids, None, counts)

    def left(self) -> Iterator[pa.RecordBatch]:
        yield from self._seal()
        yield _found(self.own.ids, None, self.counts)

    def _linked_pairs(self, asking: _Rows, some: slice, inside: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, j in self._close(asking, some, inside):
            good = self._linked(asking, i, j)
            if good.any():
                yield i[good], j[good]

    def _close(self, asking: _Rows, some: slice, inside: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs whose squared distance in the block may be within its share, in parts."""
        a, b = self.layout.bounds[self.block]
        x, first = asking.rotated[some, a:b], some.start or 0
        limit = self.layout.shares[self.block] + SINGLE
        side = np.column_stack([-2 * x, (x * x).sum(axis=1), np.ones(len(x))]).astype(np.float32)
        held, count = [], 0
        for start, low, high, tile in self.tiles:
            width = tile.shape[1]
            if inside and start + width <= first:
                continue
            gap = np.maximum(low - x, 0) + np.maximum(x - high, 0)
            rows = np.flatnonzero((gap * gap).sum(axis=1) <= limit)
            for at in range(0, len(rows), STRIP):
                strip = rows[at : at + STRIP]
                near = (side[strip] @ tile <= np.float32(limit)).ravel()
                words = np.flatnonzero(near.view(np.uint64))
                word, place = np.nonzero(near.reshape(-1, 8)[words])
                i, j = np.divmod(8 * words[word] + place, width)
                i, j = strip[i] + first, j + start
                if inside:
                    i, j = i[i < j], j[i < j]
                held.append((i, j))
                count += len(i)
                if count >= PAIRS:
                    yield tuple(np.concatenate(side) for side in zip(*held))
                    held, count = [], 0
        if count:
            yield tuple(np.concatenate(side) for side in zip(*held))

    def _linked(self, asking: _Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Pairs that reach the threshold and that no earlier block finds."""
        own = self.own
        close = np.einsum("ij,ij->i", asking.units[i], own.units[j]) >= self.threshold - 1e-4
        maybe = np.flatnonzero(close & (asking.size[i] == own.size[j]))
        product = np.einsum("ij,ij->i", asking.given[i[maybe]], own.given[j[maybe]])
        cosine = product / (asking.length[i[maybe]] * own.length[j[maybe]])
        good = maybe[cosine >= self.threshold]
        gap = asking.rotated[i[good]] - own.rotated[j[good]]
        gap *= gap
        here = np.ones(len(good), dtype=bool)
        for block, (a, b) in enumerate(self.layout.bounds[: self.block + 1]):
            within = _summed(gap[:, a:b]) <= self.layout.shares[block]
            here &= within if block == self.block else ~within
        out = np.zeros(len(i), dtype=bool)
        out[good[here]] = True
        return out


def _found(a: np.ndarray, b: np.ndarray | None, links: np.ndarray | None) -> pa.RecordBatch:
    """Links as ``a, b``, or the counts of those ``a`` that have any."""
    if links is not None:
        a, links = a[links > 0], links[links > 0]
    none = pa.nulls(len(a), pa.int64())
    columns = [pa.array(a), none if b is None else pa.array(b), none if links is None else pa.array(links)]
    return pa.RecordBatch.from_arrays(columns, ["a", "b", "links"])


def _links(visits: DataFrame, layout: Layout, threshold: float) -> DataFrame:
    """``a, b`` of links that join sets inside a cell, and ``a, links`` counts."""
    shared = visits.sparkSession.sparkContext.broadcast(layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell = None, None
        for batch in batches:
            marks = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
            starts = (np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist()
            for a, b in zip([0, *starts], [*starts, len(marks)]):
                if a == b:
                    continue
                block, number, side = marks[a].tolist()
                ids, rows = (batch.column(k).slice(a, b - a).to_numpy() for k in (3, 4))
                vectors = batch.column(5).slice(a, b - a)
                if key != (block, number):
                    if cell is not None:
                        yield from cell.left()
                    # visitors of an empty cell find nothing
                    key = (block, number)
                    cell = _Cell(block, shared.value, threshold) if side == 0 else None
                if side == 0:
                    cell.add(ids, rows, vectors)
                elif cell is not None:
                    yield from cell.visited(ids, rows, vectors)
        if cell is not None:
            yield from cell.left()

    dealt = visits.repartition("block", "cell").sortWithinPartitions("block", "cell", "side")
    return dealt.mapInArrow(run, "a long, b long, links long")


def near_vectors(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    blocks: int = BLOCKS,
    sample: int = SAMPLE,
    cell: int = CELL,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors`` (``vec_id, embedding``).

    Rows link if the cosine of their embeddings, in double precision, is at least
    ``threshold`` (above 0); no other column counts.  ``n_links`` is the number of rows
    a row links with directly, ``component_id`` the smallest ``vec_id`` reachable by
    links, and ``kept`` marks rows whose own id that is.

    Null vectors, those with null or non-finite components, and zero vectors link with
    nothing, and neither do vectors of different lengths.  Equal vectors are one
    class with a count, however many rows hold them; each links with the others.  Rows
    that repeat an id are rows of their own.  A row without id links like any other but
    is never the smallest; its component may be null, and then it is not kept.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    given = F.col("embedding")
    finite = ~F.exists(given, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = given.isNotNull() & finite & F.exists(given, lambda x: x != 0)
    # zero has two signs; one of them is kept
    cleaned = F.transform(given, lambda x: F.when(x == 0, F.abs(x)).otherwise(x))
    rows = vectors.select("vec_id", F.when(F.coalesce(usable, F.lit(False)), cleaned).alias("vector"))
    rows = rows.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(7), "vector")})
    rows = stored(rows, "vectors")
    classes = (
        rows.where("vector is not null")
        .groupBy("h1", "h2")
        .agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("rows"), F.min("vec_id").alias("first_id"))
    )
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    if classes.isEmpty():
        alone = F.lit(0).cast("long").alias("n_links")
        return rows.select("vec_id", alone, F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    layout = fit_layout(classes, threshold, blocks, sample, cell)
    met = stored(_links(_visits(classes, layout), layout, threshold), "vector-links")
    counts = met.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    components = stored(connected_components(met.where("b is not null").select("a", "b"), "vector-edges"), "vector-components")
    labelled = (
        classes.select("h1", "h2", "id", "rows", "first_id")
        .join(counts, "id", "left")
        .join(components.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
    )
    lowest = labelled.groupBy("component").agg(F.min("first_id").alias("lowest"))
    named = labelled.join(lowest, "component").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("links"), "lowest"
    )
    used = rows.where("vector is not null").join(named, ["h1", "h2"], "left")
    found = used.select("vec_id", "links", F.col("lowest").alias("component_id"))
    alone = rows.where("vector is null").select(
        "vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component_id")
    )
    return found.union(alone).select(
        "vec_id",
        F.col("links").cast("long").alias("n_links"),
        "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
