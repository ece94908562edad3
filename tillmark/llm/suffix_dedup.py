"""Removal of repeated byte strings with suffix arrays built by linear grouping.

Equal strings of ``length`` bytes are brought together by an anchor: of every
window of that length, the smallest hash of ``gram`` consecutive bytes.  A window
belongs to exactly one anchor, and equal windows have equal anchors at equal
offsets.  The windows of one anchor in one place form a run.

* Runs with equal bytes are all repeated; one stands for them from then on, inside
  each task already.
* Different runs of one anchor are joined to one string, in which all that follows
  the last start of a window is one symbol.  Its suffix array puts equal windows next
  to each other.

The suffix array is built without renaming or recursion: groups of suffixes that
share a Lyndon prefix are refined in descending order with previous-smaller
pointers, and one ascending pass then emits the order inside each group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tillmark.llm.kernels import Texts, mix, pieces, signed, sliding_argmin, span_hashes
from tillmark.llm.storage import stored

LENGTH = 200
GRAM = 100
# different runs of one anchor up to which their suffixes are sorted in one task
MAX_RUNS = 2000
# runs a task combines before it passes them on
ROUND = 1 << 20
PIECE = 1 << 20


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of positive integers by linear grouping."""
    n = len(text) + 1
    text = [*text, 0]
    # groups are segments of ``order``: start of each suffix's group, size by start
    order = sorted(range(n), key=text.__getitem__)
    where = [0] * n
    start = [0] * n
    size = [0] * (n + 1)
    at, last = 0, None
    for k, s in enumerate(order):
        if text[s] != last:
            at, last = k, text[s]
        where[s], start[s] = k, at
        size[at] += 1

    previous = [-1] * n
    # positions whose group is already processed point to a candidate before them
    before: list[int | None] = [None] * n

    def lower(p: int) -> int:
        """Nearest position at or before p whose group is still to come."""
        root = p
        while root >= 0 and before[root] is not None:
            root = before[root]
        while p >= 0 and p != root and before[p] is not None:
            before[p], p = root, before[p]
        return root

    end = n - 1
    while end > 0:
        begin = start[order[end]]
        if begin == end:
            # one suffix: at most one other moves, to the top of its group
            s = order[end]
            end -= 1
            before[s] = s - 1
            p = previous[s] = lower(s - 1)
            if p >= 0 and size[start[p]] > 1:
                g = start[p]
                to, here = g + size[g] - 1, where[p]
                other = order[to]
                order[here], where[other] = other, here
                order[to], where[p] = p, to
                size[g] -= 1
                size[to], start[p] = 1, to
            continue
        members = order[begin : end + 1]
        end = begin - 1
        for s in members:
            before[s] = s - 1
        times: dict[int, int] = {}
        for s in members:
            p = previous[s] = lower(s - 1)
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if not times:
            continue
        # the more often the group follows a prefix, the higher that prefix's new group
        by_times: dict[int, list[int]] = {}
        for p, t in times.items():
            by_times.setdefault(t, []).append(p)
        for t in sorted(by_times, reverse=True):
            moved: dict[int, int] = {}
            for p in by_times[t]:
                g = start[p]
                m = moved.get(g, 0) + 1
                moved[g] = m
                to, here = g + size[g] - m, where[p]
                other = order[to]
                order[here], where[other] = other, here
                order[to], where[p] = p, to
            for g, m in moved.items():
                if m < size[g]:
                    new = g + size[g] - m
                    size[g] -= m
                    size[new] = m
                    for k in range(new, new + m):
                        start[order[k]] = new

    result = [-1] * n
    placed = [False] * n
    free = list(range(n))
    result[0] = n - 1
    placed[n - 1] = True
    for k in range(n):
        j = result[k] - 1
        while j >= 0 and not placed[j]:
            slot = free[start[j]]
            free[start[j]] = slot + 1
            result[slot] = j
            placed[j] = True
            j = previous[j]
    return result[1:]


def anchored_runs(texts: Texts, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Row, first window, window count, anchor offset, anchor hash and content hash of all runs."""
    data = texts.data
    if len(data) < length:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4)) + (np.zeros(0, dtype=np.uint64),) * 2
    starts = np.arange(len(data) - gram + 1)
    grams = span_hashes(data, starts, starts + gram)
    at = sliding_argmin(grams, length - gram + 1)
    ends = np.repeat(texts.offsets[1:], np.diff(texts.offsets))
    windows = np.flatnonzero(np.arange(len(at)) + length <= ends[: len(at)])
    if not len(windows):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4)) + (np.zeros(0, dtype=np.uint64),) * 2
    anchor = at[windows]
    new = np.ones(len(windows), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(windows)) - 1
    first, last, anchor = windows[head], windows[tail], anchor[head]
    offset = anchor - first
    content = mix(span_hashes(data, first, last + length) + offset.astype(np.uint64), 3)
    row = np.searchsorted(texts.offsets, first, side="right") - 1
    return row, first - texts.offsets[row], last - first + 1, offset, grams[anchor], content


def _long_rows(texts: Texts, length: int) -> Iterator[tuple[Texts, int]]:
    """A row longer than a piece in overlapping parts, with the place of each."""
    if len(texts) > 1 or len(texts.data) <= 4 * PIECE:
        yield texts, 0
        return
    for at in range(0, len(texts.data) - length + 1, PIECE):
        part = texts.data[at : at + PIECE + length - 1]
        yield Texts(part, np.array([0, len(part)]), texts.first), at


def _keyed(docs: DataFrame) -> DataFrame:
    """``key`` names a row by id and text."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")


def _place(first: np.ndarray, offset: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (first << 16) | (offset << 8) | count


RUN_SCHEMA = "anchor long, content long, key long, place long, kind int"
# a run; a run that stands for others of its task; a run known to be repeated
ONE, MANY, DONE = 0, 1, 2


def document_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Runs of all texts; what repeats inside a round of a task is settled there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def combined() -> pa.RecordBatch:
            anchor, content, key, place = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((content, anchor))
            anchor, content, key, place = anchor[order], content[order], key[order], place[order]
            same = (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])
            later, has_next = np.append(False, same), np.append(same, False)
            kind = np.where(later, DONE, np.where(has_next, MANY, ONE))
            # the stand-in of a group goes on and is itself repeated
            extra = np.flatnonzero(kind == MANY)
            anchor = np.where(kind == DONE, mix(key.view(np.uint64) + place.astype(np.uint64)), anchor)
            columns = [
                np.concatenate([anchor, mix(key[extra].view(np.uint64))]),
                np.concatenate([content, content[extra]]),
                np.concatenate([key, key[extra]]),
                np.concatenate([place, place[extra]]),
                np.concatenate([kind, np.full(len(extra), DONE)]).astype(np.int32),
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array(signed(columns[0])), pa.array(signed(columns[1])), *map(pa.array, columns[2:])],
                ["anchor", "content", "key", "place", "kind"],
            )

        for batch in batches:
            keys = batch.column(0).to_numpy()
            for whole in pieces(batch.column(1), PIECE):
                for texts, shift in _long_rows(whole, length):
                    row, first, count, offset, anchor, content = anchored_runs(texts, length, gram)
                    held.append((anchor, content, keys[texts.first + row], _place(first + shift, offset, count)))
            if sum(len(h[0]) for h in held) >= ROUND:
                yield combined()
                held = []
        if held:
            yield combined()

    return _keyed(docs).select("key", "text").mapInArrow(run, RUN_SCHEMA)


def _relevant(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows that share their anchor with a neighbour or are more than one run."""
    carried = None
    for batch in batches:
        if carried is not None:
            batch = pa.concat_batches([carried, batch])
        carried = batch.slice(batch.num_rows - 1)
        anchor = batch.column(0).to_numpy()
        same = anchor[1:] == anchor[:-1]
        keep = batch.column(4).to_numpy() != ONE
        keep[1:] |= same
        keep[:-1] |= same
        yield from zip(*(c.to_numpy()[:-1][keep[:-1]].tolist() for c in batch.columns))
    if carried is not None:
        yield from zip(*(c.to_pylist() for c in carried.columns))


def meet_runs(runs: DataFrame) -> DataFrame:
    """Runs by anchor: ``kind`` DONE are repeated; others are the different runs of an
    anchor that has several (MANY: standing for repeated ones).

    Streams the sorted rows and holds two of them.
    """

    def settled(rows: Iterable[tuple]) -> Iterator[tuple]:
        for anchor, group in groupby(rows, key=lambda r: r[0]):
            first, several = None, False
            for _, equal in groupby(group, key=lambda r: r[1]):
                head = next(equal)
                if head[4] == DONE:
                    yield head
                    yield from equal
                    continue
                kind = head[4]
                for other in equal:
                    if other[4] == DONE:
                        yield other
                        continue
                    if kind == ONE:
                        yield (*head[:4], DONE)
                    kind = MANY
                    yield (*other[:4], DONE)
                found = (*head[:4], kind)
                if first is None:
                    first = found
                    continue
                if not several:
                    several = True
                    yield first
                yield found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row in settled(_relevant(batches)):
            out.append(row)
            if len(out) == 1 << 16:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    names = ["anchor", "content", "key", "place", "kind"]
    types = [pa.int64()] * 4 + [pa.int32()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    met = runs.repartition("anchor").sortWithinPartitions("anchor", "content", "kind")
    return met.mapInArrow(run, RUN_SCHEMA)


def packed_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, key, packed``: texts deflated for the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            packed = [zlib.compress(t.as_py() or b"", 3) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["doc_id", "key", "packed"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _keyed(docs).mapInArrow(run, f"doc_id {kind}, key long, packed binary")


def run_contents(open_runs: DataFrame, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``anchor, key, place, kind, large, bytes`` of runs that must be compared."""
    wanted = open_runs.groupBy("key").agg(F.collect_list(F.struct("anchor", "place", "kind", "large")).alias("runs"))
    joined = packed_texts(docs).join(wanted, "key").select("key", "packed", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "key", "place", "kind", "large", "bytes"]
        types = [pa.int64()] * 3 + [pa.int32(), pa.bool_(), pa.binary()]
        for batch in batches:
            for key, packed, runs in zip(*(c.to_pylist() for c in batch.columns)):
                text, rows = zlib.decompress(packed), []
                for r in runs:
                    first, count = r["place"] >> 16, r["place"] & 0xFF
                    content = text[first : first + count + length - 1]
                    rows.append((r["anchor"], key, r["place"], r["kind"], r["large"], content))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return joined.mapInArrow(run, "anchor long, key long, place long, kind int, large boolean, bytes binary")


def repeated_windows(contents: list[bytes], offsets: list[int], length: int = LENGTH, gram: int = GRAM) -> list[np.ndarray]:
    """Per run of one anchor, which of its windows also occur in another run.

    All runs hold the same ``gram`` bytes at their anchor, and equal windows start
    equally far before it.  So a window needs no comparison if it starts nearer or
    farther than any window of the other runs, and what follows the nearest start
    enters the string as one symbol, in the order of byte strings.  Windows with the
    same bytes are then neighbours in the suffix array, whatever comes after.
    """
    sizes = np.array([len(c) for c in contents])
    counts = sizes - length + 1
    hits = [np.zeros(n, dtype=bool) for n in counts.tolist()]
    if len(contents) < 2:
        return hits
    # distances from the anchor at which windows of two runs may start
    far = np.array(offsets)
    near = far - counts + 1
    low, high = int(np.sort(near)[1]), int(np.sort(far)[-2])
    first, last = far - np.minimum(far, high), far - np.maximum(near, low)
    used = np.flatnonzero(first <= last).tolist()
    if len(used) < 2:
        return hits

    tails = [contents[k][offsets[k] - low :] for k in used]
    # above all symbols of single bytes
    symbol = {tail: rank for rank, tail in enumerate(sorted(set(tails)), 257)}
    text: list[int] = []
    begins = []
    for k, tail in zip(used, tails):
        begins.append(len(text))
        text += [b + 1 for b in contents[k][first[k] : offsets[k] - low]]
        text.append(symbol[tail])
    starts, stops = first[used], last[used] + 1
    n = stops - starts
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = within + np.repeat(np.cumsum(sizes[used]) - sizes[used] + starts, n)
    data = np.frombuffer(b"".join([contents[k] for k in used]), dtype=np.uint8)
    value = np.zeros(len(text), dtype=np.uint64)
    value[within + np.repeat(begins, n)] = span_hashes(data, at, at + length) | np.uint64(1)
    order = np.array(suffix_array(text))
    ordered = value[order]
    same = (ordered[1:] == ordered[:-1]) & (ordered[1:] != 0)
    hit = np.zeros(len(value), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    for k, b, i, j in zip(used, begins, starts.tolist(), stops.tolist()):
        hits[k][i:j] = hit[b : b + j - i]
    return hits


def _spans(hit: np.ndarray, first: int, length: int) -> Iterator[tuple[int, int]]:
    """Byte spans covered by repeated windows that follow each other."""
    edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
        yield first + a, first + b - 1 + length


def compared_spans(contents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``key, start, stop``: repeated spans found by the suffix arrays of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out: list[tuple[int, int, int]] = []
        for _, group in groupby(rows, key=lambda r: r[0]):
            group = list(group)
            places = [r[2] for r in group]
            hits = repeated_windows([r[4] for r in group], [(p >> 8) & 0xFF for p in places], length, gram)
            for (_, key, place, kind, _), hit in zip(group, hits):
                if kind == ONE:
                    out += [(key, a, b) for a, b in _spans(hit, place >> 16, length)]
            if len(out) >= 1 << 14:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    def batch_of(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "start", "stop"])

    met = contents.where("not large").select("anchor", "key", "place", "kind", "bytes")
    return met.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        run, "key long, start long, stop long"
    )


def counted_spans(contents: DataFrame, length: int = LENGTH) -> DataFrame:
    """The same for anchors with more runs than one task should sort: their windows
    are counted by hash, which combines map-side and meets in no single task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, place, kind, content in zip(*(c.to_pylist() for c in batch.columns)):
                starts = np.arange(len(content) - length + 1)
                data = np.frombuffer(content, dtype=np.uint8)
                h = span_hashes(data, starts, starts + length)
                tail = span_hashes(data, starts, starts + length // 2)
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(h)),
                        pa.array(signed(tail)),
                        pa.array(np.full(n, key)),
                        pa.array((place >> 16) + starts),
                        pa.array(np.full(n, kind, dtype=np.int32)),
                    ],
                    ["h1", "h2", "key", "start", "kind"],
                )

    windows = contents.where("large").select("key", "place", "kind", "bytes").mapInArrow(
        run, "h1 long, h2 long, key long, start long, kind int"
    )
    repeated = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    return windows.where(F.col("kind") == ONE).join(repeated, ["h1", "h2"]).select(
        "key", "start", (F.col("start") + length).alias("stop")
    )


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, max_runs: int = MAX_RUNS) -> DataFrame:
    """``key, spans``: maximal byte spans covered by strings of ``length`` bytes that
    also start elsewhere, in order, for every row that has some."""
    if not 0 < length - gram < 255:
        raise ValueError("length must exceed gram by 1 to 254")
    met = stored(meet_runs(document_runs(docs, length, gram)), "runs")
    place = F.col("place")
    first, count = F.shiftright(place, 16), place.bitwiseAND(F.lit(0xFF))
    done = met.where(F.col("kind") == DONE).select(
        "key", first.alias("start"), (first + count - 1 + length).alias("stop")
    )
    open_runs = met.where(F.col("kind") != DONE)
    large = (
        open_runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > max_runs).select("anchor", F.lit(True).alias("large"))
    )
    marked = open_runs.join(large, "anchor", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    contents = stored(run_contents(marked, docs, length), "run-contents")
    spans = done.union(compared_spans(contents, length, gram)).union(counted_spans(contents, length)).distinct()

    in_order = Window.partitionBy("key").orderBy("start", "stop")
    reach = F.max("stop").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opens = spans.withColumn("opens", (F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("int"))
    numbered = opens.withColumn("run", F.sum("opens").over(in_order))
    merged = numbered.groupBy("key", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return merged.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, max_runs: int = MAX_RUNS) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` of every row.

    A byte goes if it lies in a string of ``length`` bytes that starts at another
    place too, in the same row or another one; strings are judged on the input.
    ``spans`` are the maximal removed runs (start, stop) of bytes and ``kept`` the
    remaining bytes.

    A missing text is empty; texts shorter than ``length`` stay whole.  Rows that
    repeat id and text are copies of each other, so both lose what they share; a
    missing id is an id.  Places are told apart by a 64-bit hash of id and text.
    """
    spans = stored(repeated_spans(docs, length, gram, max_runs), "repeated-spans")
    joined = packed_texts(docs).join(spans, "key", "left").select("doc_id", "packed", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, kept = [], []
            for packed, spans in zip(batch.column(1), batch.column(2)):
                text = zlib.decompress(packed.as_py())
                parts, at = [], 0
                for span in spans.as_py() or []:
                    parts.append(text[at : span["start"]])
                    at = span["stop"]
                parts.append(text[at:])
                sizes.append(len(text))
                kept.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), batch.column(2), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(
        run, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"
    )
