"""Exact top-k search by inner product.

Vectors are cut into blocks of descending length.  The block of the longest gives
every query a first k-th best score; a later block is only sent the queries whose
length times the block's longest vector can still reach theirs.  Inside a block,
coordinates are rotated to the principal axes of all vectors, and a partial sum
over the leading axes plus the Cauchy-Schwarz bound of the rest rules out most
candidates before their exact product is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tillmark.llm.storage import stored

TILE = 1024
# blocks by length; what they hold beyond their size is split by hash
MAX_BLOCKS = 4096
# share of the squared length that the leading axes hold
LEADING = 0.75
LARGEST = 1 << 53
# scores of this size and more do not fit a long that can change its sign
SCORE_LIMIT = (1 << 63) - 1
# squares of larger components leave the range of doubles
COMPONENT_LIMIT = 2.0**500


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of every component, whole numbers as doubles.

    A double times a power of two and its floor are exact at every size.  Vectors that
    are missing or hold a missing or non-finite component take no part, nor do rows
    without id; repeated rows count once.  A scaled component from 2^500 on fails the query.
    """
    x = F.col("embedding")

    def scaled(c: Column) -> Column:
        return c.cast("double") * scale

    def whole(c: Column) -> Column:
        x = scaled(c)
        # from 2^53 on every double is whole; zero has one sign
        floor = F.when(F.abs(x) < F.lit(float(LARGEST)), F.floor(x).cast("double")).otherwise(x)
        failed = F.raise_error(F.lit("embedding component is too large for exact products")).cast("double")
        return F.when(F.abs(x) < F.lit(COMPONENT_LIMIT), floor).otherwise(failed)

    usable = F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    )
    return (
        vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(usable, F.lit(False)))
        .select("vec_id", F.transform(x, whole).alias("v"))
        .distinct()
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column; shorter vectors are padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(np.asarray(column.offsets))
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim), dtype=values.dtype if len(values) else np.int64)
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


class Vectors:
    """Whole numbers, as longs where these hold them and as doubles."""

    def __init__(self, given: np.ndarray):
        self.given = given
        self.floats = given.astype(float)
        self.length = np.sqrt((self.floats**2).sum(axis=1))
        fits = np.abs(self.floats) < 2.0**62
        self.longs = np.where(fits, given, 0).astype(np.int64)

    def __len__(self) -> int:
        return len(self.given)

    def __getitem__(self, rows) -> Vectors:
        part = object.__new__(Vectors)
        for name, value in self.__dict__.items():
            setattr(part, name, value[rows])
        return part


def _exact(x: np.ndarray, y: np.ndarray) -> int:
    return sum(int(a) * int(b) for a, b in zip(x.tolist(), y.tolist()))


def _settle(score: np.ndarray, q: Vectors, c: Vectors, hit_q: np.ndarray, hit_c: np.ndarray) -> None:
    """Puts right the scores of pairs so long that sums of longs may have run over.

    A score above the limit is an error; one below it becomes its negative, which is an
    error only if it is among the best.
    """
    for k in np.flatnonzero(q.length[hit_q] * c.length[hit_c] >= 2.0**62).tolist():
        value = _exact(q.given[hit_q[k]], c.given[hit_c[k]])
        if value >= SCORE_LIMIT:
            raise OverflowError("an inner product does not fit a long")
        score[k] = max(value, -SCORE_LIMIT)


def principal_axes(vectors: DataFrame, dim: int) -> tuple[np.ndarray, int]:
    """Right singular vectors of all rows, strongest first, and how many lead.

    Every task adds up its products; dim x dim sums reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column(0), dim).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(dim * dim)), pa.array(total.ravel())], ["cell", "value"]
        )

    cells = vectors.select("v").mapInArrow(run, "cell long, value double").groupBy("cell").agg(
        F.sum("value").alias("value")
    )
    gram = np.zeros(dim * dim)
    for row in cells.collect():
        gram[row["cell"]] = row["value"]
    power, axes = np.linalg.eigh(gram.reshape(dim, dim))
    power, axes = np.maximum(power[::-1], 0), axes[:, ::-1]
    held = np.cumsum(power) / max(power.sum(), 1e-300)
    return np.ascontiguousarray(axes), int(min(dim, np.searchsorted(held, LEADING) + 1))


class Best:
    """k best scores of each query so far; equal scores favour the smaller id."""

    def __init__(self, count: int, k: int):
        self.k = k
        self.query = np.zeros(0, dtype=np.int64)
        self.score = np.zeros(0, dtype=np.int64)
        self.ident = np.zeros(0, dtype=np.int64)
        self.floor = np.full(count, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        query = np.concatenate([self.query, query])
        score = np.concatenate([self.score, score])
        ident = np.concatenate([self.ident, ident])
        order = np.lexsort((ident, -score, query))
        query, score, ident = query[order], score[order], ident[order]
        first = np.searchsorted(query, query)
        rank = np.arange(len(query)) - first
        keep = rank < self.k
        self.query, self.score, self.ident = query[keep], score[keep], ident[keep]
        last = rank == self.k - 1
        self.floor[query[last]] = np.maximum(self.floor[query[last]], _at_most(score[last]))


def _products(q: Vectors, c: Vectors) -> np.ndarray:
    """Inner products of all rows of q with all rows of c, right modulo 2^64."""
    largest = float(np.abs(q.floats).max(initial=0)) * float(np.abs(c.floats).max(initial=0)) * q.floats.shape[1]
    if largest < LARGEST:
        return (q.floats @ c.floats.T).astype(np.int64)
    return q.longs @ c.longs.T


def _at_most(score: np.ndarray) -> np.ndarray:
    """Doubles that do not exceed these longs."""
    near = score.astype(float)
    return np.where(np.abs(near) < LARGEST, near, np.nextafter(near, -np.inf))


def search_block(
    queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, block: np.ndarray, ids: np.ndarray,
    axes: np.ndarray, lead: int, k: int,
) -> Best:
    """Candidates of one block that reach the queries' floors, at most k per query."""
    best = Best(len(queries), k)
    best.floor = floors.astype(float).copy()
    asked, held = Vectors(queries), Vectors(block)
    order = np.argsort(-held.length, kind="stable")
    held, ids = held[order], ids[order]
    turned_q, turned_c = asked.floats @ axes, held.floats @ axes
    q_rest = np.sqrt((turned_q[:, lead:] ** 2).sum(axis=1))
    c_rest = np.sqrt((turned_c[:, lead:] ** 2).sum(axis=1))
    at, tile = 0, 64
    while at < len(held):
        part = slice(at, at + tile)
        some = held[part]
        at, tile = at + tile, min(TILE, tile * 4)
        # rounding errors of the bounds stay far below this slack
        reach = asked.length * some.length[0]
        slack = 1e-9 * reach + 1e-6
        live = np.flatnonzero(reach + slack >= best.floor)
        if not len(live):
            break
        bound = turned_q[live, :lead] @ turned_c[part, :lead].T
        bound += q_rest[live, None] * c_rest[None, part]
        near = bound + slack[live, None] >= best.floor[live, None]
        # rows with a query's own id are no candidates
        near &= query_ids[live, None] != ids[None, part]
        hit_q, hit_c = np.nonzero(near)
        if len(hit_q) * 4 > bound.size:
            score = _products(asked[live], some)[hit_q, hit_c]
        else:
            score = np.empty(len(hit_q), dtype=np.int64)
            for s in range(0, len(hit_q), 1 << 16):
                cut = slice(s, s + (1 << 16))
                score[cut] = np.einsum("ij,ij->i", asked.longs[live[hit_q[cut]]], some.longs[hit_c[cut]])
        query, ident = live[hit_q], ids[part][hit_c]
        _settle(score, asked, some, query, hit_c)
        ok = score >= best.floor[query]
        best.add(query[ok], score[ok], ident[ok])
    return best


def top_products(
    vectors: DataFrame, is_query: Column, k: int = 5, block_rows: int = 8192, query_rows: int = 8192
) -> DataFrame:
    """The ``k`` largest inner products of every query row with all other rows.

    ``vectors`` holds ``vec_id`` (long) and ``v``, whole numbers as ``quantised`` returns
    them or as longs.  Scores are exact at every size; one among the best that does not
    fit a long fails the query.  Gives ``query_id, rank, vec_id, score``, all candidates if there
    are fewer than ``k``; equal scores favour the smaller ``vec_id``.  Rows that
    share the query's id are its own and no candidates.  If ids repeat with other
    vectors, each is a query.  Shorter vectors count as padded with zeros.
    """
    squared = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    rows = stored(vectors.select("vec_id", "v", F.sqrt(squared).alias("length")), "vectors")
    spark = rows.sparkSession
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.count_if(is_query).alias("nq")
    ).first()
    dim = max(1, facts["dim"] or 0)
    blocks = min(MAX_BLOCKS, max(1, -(-facts["n"] // block_rows)))
    query_blocks = max(1, -(-facts["nq"] // query_rows))
    axes, lead = principal_axes(rows, dim)

    # ascending lengths that separate the blocks; block 0 holds the longest
    shares = [i / blocks for i in range(1, blocks)]
    cuts = rows.agg(F.percentile_approx("length", shares, 10_000)).first()[0] if shares else []
    cuts = np.array(sorted(set(cuts or [])), dtype=float)
    shared = spark.sparkContext.broadcast((axes, lead, cuts))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(2).to_numpy()
            block = len(shared.value[2]) - np.searchsorted(shared.value[2], length, side="right")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(block.astype(np.int32))], ["vec_id", "v", "length", "block"]
            )

    kind = rows.schema["v"].dataType.simpleString()
    placed = rows.mapInArrow(place, f"vec_id long, v {kind}, length double, block int")
    # equal lengths all fall into one block; hashed ids split it into slots
    sizes = placed.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest"))
    layout = sizes.select("block", F.ceil(F.col("n") / block_rows).cast("int").alias("slots"), "longest").toArrow()
    if not layout.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    layout = layout.sort_by("block")
    block_ids, block_slots, longest = (layout.column(c).to_numpy() for c in ("block", "slots", "longest"))
    first = int(block_ids[0])
    spread = spark.sparkContext.broadcast((block_ids, block_slots, np.minimum.accumulate(longest)))

    def slotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block_ids, slots, _ = spread.value
        for batch in batches:
            own = slots[np.searchsorted(block_ids, batch.column(3).to_numpy())]
            slot = pa.array((batch.column(4).to_numpy() % own).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], slot], ["vec_id", "v", "length", "block", "slot"])

    hashed = placed.withColumn("hashed", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)))
    placed = hashed.mapInArrow(slotted, f"vec_id long, v {kind}, length double, block int, slot int")
    queries = rows.where(is_query).select(
        "vec_id", "v", "length", F.xxhash64("v").alias("query_hash"),
        F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("query_block"),
    )
    groups = ["block", "slot", "query_block"]
    each = placed.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        axes, lead, _ = shared.value
        ids = right.column("vec_id").combine_chunks()
        found = search_block(
            _matrix(right.column("v"), dim), ids.to_numpy(), right.column("floor").to_numpy(),
            _matrix(left.column("v"), dim), left.column("vec_id").to_numpy(), axes, lead, k,
        )
        at = pa.array(found.query)
        return pa.table(
            {
                "query_id": ids.take(at),
                "query_hash": right.column("query_hash").combine_chunks().take(at),
                "vec_id": pa.array(found.ident),
                "score": pa.array(found.score),
            }
        )

    def searched(candidates: DataFrame, asked: DataFrame) -> DataFrame:
        return candidates.select(*groups, "vec_id", "v").groupBy(*groups).cogroup(
            asked.select(*groups, "vec_id", "v", "query_hash", "floor").groupBy(*groups)
        ).applyInArrow(search, "query_id long, query_hash long, vec_id long, score long")

    def aimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every query with each slot whose longest vector can still reach its floor, but the very first."""
        block_ids, slots, longest = spread.value
        upto = np.concatenate([[0], np.cumsum(slots)])
        for batch in batches:
            floor, length = (batch.column(c).to_numpy() for c in ("floor", "length"))
            with np.errstate(divide="ignore", invalid="ignore"):
                least = (floor - 1e-6) / (length * (1 + 1e-9)) * (1 - 1e-12)
            # blocks are in descending order of length; a zero vector scores zero everywhere
            least = np.where(length > 0, least, np.where(floor <= 1e-6, -np.inf, np.inf))
            count = upto[np.searchsorted(-longest, -least, side="right")]
            at = 0
            while at < len(count):
                stop = max(at + 1, int(np.searchsorted(np.cumsum(count[at:]), 1 << 13, side="right")) + at)
                many = np.maximum(count[at:stop] - 1, 0)
                row = np.repeat(np.arange(at, stop), many)
                place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + 1
                block = np.searchsorted(upto, place, side="right") - 1
                columns = batch.take(pa.array(row)).columns
                marks = [pa.array(x.astype(np.int32)) for x in (block_ids[block], place - upto[block])]
                yield pa.RecordBatch.from_arrays([*columns, *marks], [*batch.schema.names, "block", "slot"])
                at = stop

    at_head = queries.withColumns({"floor": F.lit(float("-inf")), "block": F.lit(first), "slot": F.lit(0)})
    opening = stored(searched(each.where((F.col("block") == first) & (F.col("slot") == 0)), at_head), "top-head")
    found = opening
    if block_slots.sum() > 1:
        floors = opening.groupBy("query_id", "query_hash").agg(
            F.when(F.count("score") >= k, F.min("score")).cast("double").alias("floor")
        )
        # no more than the score itself
        floors = floors.withColumn("floor", F.col("floor") - F.abs("floor") * 4e-16)
        asked = queries.join(
            floors.withColumnRenamed("query_id", "vec_id"), ["vec_id", "query_hash"], "left"
        ).fillna(float("-inf"), "floor")
        asked = asked.mapInArrow(aimed, ", ".join(f"{n} {t}" for n, t in [*asked.dtypes, ("block", "int"), ("slot", "int")]))
        tail = each.where((F.col("block") != first) | (F.col("slot") != 0))
        found = opening.union(searched(tail, asked))
    best = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    failed = F.raise_error(F.lit("an inner product does not fit a long")).cast("long")
    score = F.when(F.col("score") == F.lit(-SCORE_LIMIT), failed).otherwise(F.col("score"))
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))
