"""Packing documents into sequences by length patterns and non-negative least squares.

The pieces' lengths form a histogram. Patterns of a few lengths that fill a sequence are enumerated over coarse classes of
length, and the repeat count of each pattern is fitted to the histogram by non-negative least squares. Counts are rounded
down and filled with real lengths; the lengths left over go best-fit into what is open, longest first. All of that works on
counts of lengths; then each piece looks up its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordEncoder, bounded_batches, stored, whole

CAPACITY, END_ID = 4096, 1
#: Classes of length in the fit, and lengths in a pattern at most.
CLASSES, PARTS = 64, 4
SHARES = (1.0, 0.97, 0.9, 0.75, 0.5, 0.25)
SALTS = 256


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids with END_ID, cut only where longer than capacity."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = WordEncoder.of(tokenizer)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            ids, ends = encoder.encode(batch.column(1), END_ID)
            data = memoryview(ids.astype("<u4").tobytes())
            out = []
            for doc_id, low, high in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                for k, at in enumerate(range(low, high, capacity)):
                    end = min(high, at + capacity)
                    out.append((doc_id, k, at - low, end - at, zlib.crc32(data[4 * at : 4 * end])))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(classes: int = CLASSES, parts: int = PARTS) -> list[tuple[int, ...]]:
    """All ways to fill `classes` with 1 to `parts` classes of length, the larger first; class k stands for at most k units."""
    out: list[tuple[int, ...]] = []

    def extend(so_far: tuple[int, ...], left: int) -> None:
        if left == 0:
            out.append(so_far)
        elif len(so_far) < parts:
            top = min(left, so_far[-1] if so_far else classes)
            for k in range(top, -(-left // (parts - len(so_far))) - 1, -1):
                extend((*so_far, k), left - k)

    extend((), classes)
    return out


def fitted(matrix: np.ndarray, wanted: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |matrix @ x - wanted|, by an active set of columns."""
    n = matrix.shape[1]
    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    for _ in range(rounds):
        gain = matrix.T @ (wanted - matrix @ x)
        gain[free] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 1e-9 * max(1.0, float(np.abs(wanted).max(initial=0))):
            break
        free[best] = True
        while True:
            at = np.flatnonzero(free)
            goal = np.linalg.lstsq(matrix[:, at], wanted, rcond=None)[0]
            if goal.min(initial=1.0) > 0:
                x[:] = 0
                x[at] = goal
                break
            down = goal <= 0
            now = x[at]
            step = float(np.min(now[down] / np.maximum(now[down] - goal[down], 1e-300)))
            x[at] = now + step * (goal - now)
            x[at[down & (x[at] <= 1e-12)]] = 0
            shut = at[x[at] <= 1e-12]
            if not len(shut):
                shut = at[[int(np.argmin(goal))]]
            x[shut] = 0
            free[shut] = False
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of the sequences to make: together they use each length exactly as often as the histogram has it.

    The fit is tried with several shares of its counts, the rest being packed as residuals; the fewest sequences win.
    """
    unit = max(1, -(-capacity // CLASSES))
    shapes = patterns(-(-capacity // unit))
    matrix = np.zeros((-(-capacity // unit) + 1, len(shapes)))
    for k, shape in enumerate(shapes):
        for c in shape:
            matrix[c, k] += 1
    wanted = np.zeros(len(matrix))
    for length, n in histogram.items():
        if length < capacity:
            wanted[-(-length // unit)] += n
    fit = fitted(matrix, wanted)
    plans = (_filled(histogram, capacity, unit, shapes, np.floor(fit * share + 1e-6).astype(np.int64)) for share in SHARES)
    return min(plans, key=lambda p: sum(n for n, _ in p))


def _filled(histogram: dict[int, int], capacity: int, unit: int, shapes: list[tuple[int, ...]], repeats: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """The sequences of patterns repeated so often, filled with real lengths, and of what is left over."""
    left = {length: n for length, n in histogram.items() if n > 0}
    done: list[tuple[int, tuple[int, ...]]] = [(left.pop(capacity), (capacity,))] if capacity in left else []
    # Sequences still open, by room: counts of equal ones.
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    rooms: list[int] = []

    def put(parts: tuple[int, ...], room: int, n: int) -> None:
        if room == 0:
            done.append((n, parts))
            return
        if room not in open_:
            open_[room] = {}
            insort(rooms, room)
        open_[room][parts] = open_[room].get(parts, 0) + n

    class_of = lambda length: -(-length // unit)
    queues: dict[int, list[int]] = {}
    for length in sorted(left):
        queues.setdefault(class_of(length), []).append(length)
    lengths = sorted(left)
    # Real lengths, the longest of a class first; equal choices are made for runs of sequences at once.
    for k in sorted(np.flatnonzero(repeats).tolist(), key=lambda k: shapes[k], reverse=True):
        todo = int(repeats[k])
        while todo:
            used: dict[int, int] = {}
            room = capacity
            for c in shapes[k][:-1]:
                got = next((x for x in reversed(queues.get(c, ())) if left[x] > used.get(x, 0)), None)
                if got is None:
                    break
                used[got] = used.get(got, 0) + 1
                room -= got
            else:
                # The last part is the longest that fits the real room, which may be of a higher class.
                at = bisect_right(lengths, room) - 1
                while at >= 0 and left[lengths[at]] <= used.get(lengths[at], 0):
                    at -= 1
                got = lengths[at] if at >= 0 and class_of(lengths[at]) >= shapes[k][-1] else None
                if got is not None:
                    used[got] = used.get(got, 0) + 1
                    room -= got
            if got is None:
                break
            n = min(todo, *(left[length] // times for length, times in used.items()))
            for length, times in used.items():
                left[length] -= n * times
                if not left[length]:
                    del left[length]
                    queues[class_of(length)].remove(length)
                    lengths.pop(bisect_left(lengths, length))
            put(tuple(x for x, times in used.items() for _ in range(times)), room, n)
            todo -= n
    # Best fit, longest first, for what is left.
    heap = [-length for length in left]
    heapq.heapify(heap)
    while heap:
        length = -heapq.heappop(heap)
        n = left.pop(length)
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = min(n, capacity // length)
                put((length,) * each, capacity - length * each, n // each)
                n -= n // each * each
                continue
            room = rooms[at]
            parts, have = open_[room].popitem()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            take = min(n, have)
            if have > take:
                put(parts, room, have - take)
            put((*parts, length), room - length, take)
            n -= take
    for at in rooms:
        done += [(n, parts) for parts, n in open_[at].items()]
    return done


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece with its place.

    Sequences are gapless and hold at most capacity ids; only documents longer than capacity are cut, into pieces of capacity
    ids and a rest. Null and empty texts have the one id END_ID. Null ids and repeated rows are packed like any others.
    An empty table gives no piece. Other columns are ignored.

    Pieces are stored once as numbers. The driver gets the histogram, at most capacity rows, and makes the plan from it;
    the plan's size depends on the lengths, not on how many documents have them. Ranks are counted by length and
    salt, so that pieces of one length never meet in one task.
    """
    spark = docs.sparkSession
    found = stored(pieces(docs, tokenizer, capacity), "pieces")
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "ranks")
    histogram = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, sequence = [], 0
    for n, lengths in plan(histogram, capacity):
        offset = 0
        for length in lengths:
            runs.append((length, n, sequence, offset))
            offset += length
        sequence += n
    runs.sort(key=lambda r: r[0])
    length, n, first, offset = (np.array(c, dtype=np.int64) for c in (zip(*runs, strict=True) if runs else ((), (), (), ())))
    # Ranks of a length are dealt out run after run.
    ends = np.cumsum(n)
    starts = ends - n
    of_length = starts[np.searchsorted(length, length)] if len(length) else starts
    table = spark.sparkContext.broadcast((length << 44 | (starts - of_length), starts - of_length, first, offset))
    # Window and join share their keys: ranked pieces aren't shuffled again to meet the bases.
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("rank", rank).join(bases.select("length", "salt", "base").hint("merge"), ["length", "salt"])

    def placed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keys, starts, first, offset = table.value
        for batch in batches:
            sizes, ranks = (np.asarray(batch.column(i), dtype=np.int64) for i in (3, 5))
            at = np.searchsorted(keys, sizes << 44 | ranks, side="right") - 1
            extra = [pa.array(first[at] + ranks - starts[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *extra], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    rows = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    return rows.mapInArrow(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
