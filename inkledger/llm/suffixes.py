"""Removal of repeated byte strings by enhanced suffix arrays.

Anchors make the search local: in every window of LENGTH bytes the least hash of a GRAM-byte string is the window's anchor,
so equal windows have equal anchors, and only the text around anchors that occur more than once can repeat. Stretches of
consecutive windows with one anchor are compared as wholes; where such a stretch is not equal to another as a whole,
the stretches of its anchor form blocks. Of each block a suffix array with longest common prefixes is built; a stack scan
over it yields the tree of common-prefix intervals, and intervals with more than one left extension are the maximal
repeats, each with all its occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, bounded_batches, dropped, hot_join, made_so_far, mix, partitions, prefix_sums, spans, stored, sweep, whole

LENGTH, GRAM = 200, 40
#: Bytes of stretches in a block.
BLOCK = 1 << 20
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>"


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a sequence of integers in order, and the common prefix of each with the one before, up to depth.

    Prefix doubling; the ranks of each round are kept, and common prefixes are read off them from the longest down.
    Every position from which fewer than depth elements follow must be told apart by separators in data.
    """
    n = len(data)
    ranks = [np.unique(data, return_inverse=True)[1].astype(np.int64)]
    width, widths = 1, [1]
    while width < depth and ranks[-1].max(initial=0) < n - 1:
        # Pairs of ranks, or runs of four while the alphabet is small.
        top = int(ranks[-1].max(initial=0)) + 2
        fold = 4 if top < 1 << 15 else 2
        key = ranks[-1]
        for k in range(1, fold):
            ahead = np.zeros(n, dtype=np.int64)
            if k * width < n:
                ahead[: n - k * width] = ranks[-1][k * width :] + 1
            key = key * top + ahead
        ranks.append(np.unique(key, return_inverse=True)[1].astype(np.int64))
        widths.append(width := width * fold)
    order = np.argsort(ranks[-1], kind="stable")
    common = np.zeros(n, dtype=np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    got = np.zeros(len(a), dtype=np.int64)
    above = [*widths[1:], 2 * widths[-1]]
    for rank, width, wider in zip(reversed(ranks), reversed(widths), reversed(above), strict=True):
        rank = np.append(rank, -1)
        for _ in range(wider // width - 1):
            # Past the end every suffix is different.
            same = (rank[np.minimum(a, n)] == rank[np.minimum(b, n)]) & (a < n) & (b < n)
            step = same * width
            got, a, b = got + step, a + step, b + step
    common[1:] = got
    return order, common


def intervals(common: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """The common-prefix interval tree from least up, bottom up: (length, first, last) of suffix ranks, by a stack scan."""
    stack: list[tuple[int, int]] = []
    for k, length in enumerate([*common, 0]):
        first = k - 1
        while stack and stack[-1][0] > length:
            got, first = stack.pop()
            yield got, first, k - 1
        if length >= least and (not stack or stack[-1][0] < length):
            stack.append((length, first))


def maximal_repeats(data: np.ndarray, least: int, depth: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, all starts) of every maximal repeat of at least `least` elements; lengths beyond depth count as depth.

    A repeat is maximal to the right as an interval of the suffix array, and to the left if its occurrences are preceded by
    more than one element; the start of data and separators (negative) count as different from everything.
    """
    order, common = suffix_array(data, depth)
    before = np.where(order > 0, data[order - 1], -1)
    lone = before < 0
    before = np.where(lone, -1 - np.arange(len(order)), before)
    # Where an interval's left elements change: none inside means no left diversity.
    changes = np.concatenate(([0], np.cumsum(before[1:] != before[:-1])))
    deep = common >= least
    if not deep.any():
        return
    # Runs of deep neighbours are scanned one by one.
    edge = np.flatnonzero(np.diff(np.concatenate(([False], deep, [False])).astype(np.int8)))
    for low, high in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        # Ranks low - 1 .. high - 1 are neighbours.
        for length, first, last in intervals([0, *common[low:high].tolist()], least):
            first, last = first + low - 1, last + low - 1
            if changes[last] > changes[first]:
                yield min(length, depth), order[first : last + 1]


def least_ahead(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` consecutive values."""
    out, have = values, 1
    while 2 * have <= width:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    return np.minimum(out[: len(values) - width + 1], out[width - have :][: len(values) - width + 1]) if have < width else out


def stretches(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows, anchor hash and whole hash of each run of windows with one anchor."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < LENGTH:
        return none, none, none, none
    sums = prefix_sums(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = spans(sums, at, at + GRAM)
    # Positions break ties among equal grams of a window, the first first; 2**24 of them, more by parts of the text.
    windows = len(data) - LENGTH + 1
    anchors = []
    for low in range(0, windows, 1 << 23):
        part = grams[low : low + (1 << 23) + LENGTH - GRAM]
        key = (part & ~U(0xFFFFFF)) | np.arange(len(part), dtype=U)
        anchors.append((least_ahead(key, LENGTH - GRAM + 1) & U(0xFFFFFF)).astype(np.int64)[: 1 << 23] + low)
    anchors = np.concatenate(anchors)
    start = np.flatnonzero(np.diff(anchors, prepend=-1))
    count = np.diff(np.append(start, windows))
    return start, count, grams[anchors[start]].view(np.int64), spans(sums, start, start + count - 1 + LENGTH).view(np.int64)


def _packed(batches: Iterator) -> Iterator:
    """Texts as zstd frames: they are read and shuffled several times. `first` tells the first of equal texts of a task."""
    import pyarrow as pa

    codec = pa.Codec("zstd", compression_level=1)
    seen: set[int] = set()
    for batch in batches:
        texts, first = batch.column(3).to_pylist(), []
        for key in batch.column(1).to_pylist():
            first.append(key not in seen)
            seen.add(key)
        columns = [pa.array([len(t) for t in texts], pa.int64()), pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary()), pa.array(first, pa.bool_())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["doc_id", "key", "check", "size", "packed", "first"])


def _anchored(batches: Iterator) -> Iterator:
    """The stretches of each text."""
    import pyarrow as pa

    codec = pa.Codec("zstd")
    for batch in batches:
        keys, sizes, packed = (c.to_pylist() for c in batch.columns)
        found = [stretches(np.frombuffer(codec.decompress(p, n, asbytes=True), dtype=np.uint8)) for n, p in zip(sizes, packed, strict=True)]
        if not found:
            continue
        start, windows, anchor, body = (np.concatenate(c) for c in zip(*found, strict=True))
        key = np.repeat(np.array(keys, dtype=np.int64), [len(f[0]) for f in found])
        arrays = [pa.array(key), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(anchor), pa.array(body)]
        yield pa.RecordBatch.from_arrays(arrays, names=["key", "start", "windows", "anchor", "body"])


def _cut(batches: Iterator) -> Iterator:
    """The bytes of the stretches asked for of each text."""
    import pyarrow as pa

    codec = pa.Codec("zstd")
    names = ["key", "start", "anchor", "parts", "part", "body"]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    for batch in batches:
        out = []
        for key, size, packed, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = codec.decompress(packed, size, asbytes=True)
            for x in asked:
                s = x["start"]
                out.append((key, s, x["anchor"], x["parts"], x["part"], data[s : s + x["windows"] - 1 + LENGTH]))
        columns = zip(*out, strict=True) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _kept(batches: Iterator) -> Iterator:
    """What is left of each text without its spans; of a text that occurs more than once, nothing if it is long enough."""
    import pyarrow as pa

    codec = pa.Codec("zstd")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(span))
    for batch in batches:
        out = []
        for doc_id, size, packed, copies, got in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
            data, merged = codec.decompress(packed, size, asbytes=True), []
            if copies > 1 and size >= LENGTH:
                merged = [(0, size)]
            elif got.is_valid and len(got):
                a, b = (np.asarray(got.values.field(i), dtype=np.int64) for i in range(2))
                order = np.argsort(a, kind="stable")
                a, reach = a[order], np.maximum.accumulate(b[order])
                first = np.flatnonzero(np.concatenate(([True], a[1:] > reach[:-1])))
                merged = list(zip(a[first].tolist(), reach[np.append(first[1:], len(a)) - 1].tolist(), strict=True))
            rest, at = hashlib.sha256(), 0
            for s, e in merged:
                rest.update(data[at:s])
                at = e
            rest.update(data[at:])
            out.append((doc_id, size, sum(e - s for s, e in merged), len(merged), rest.hexdigest(), [{"start": s, "end": e} for s, e in merged]))
        columns = zip(*out, strict=True) if out else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans.

    A byte is removed if a LENGTH-byte string that covers it starts anywhere else too, in any document or the same one,
    overlaps included; judged on the input. Matches don't cross documents. Null texts are empty, texts shorter than LENGTH
    lose nothing. Rows of equal text, repeated rows and null ids included, are documents of their own and each the
    repeat of the other. An empty table gives an empty table. Other columns are ignored.

    Texts are stored once, compressed, and known by 64 bits; should two different ones share them, which a second hash of each tells, all
    is done again under another seed. Equal texts are searched once. Stretches are stored as five numbers; only those that
    are not equal to another as wholes are cut out and shuffled with their bytes, of one copy of each text. An anchor with
    more of those than a block holds is dealt out to several blocks, whose windows are then counted together by hash.
    Wherever rows meet by anchor, stretch, window or text, the hot ones among these are looked up in place (hot_join), so none
    of them meets in one task.
    """
    data = F.encode(whole(text_col), "utf-8")
    return _searched(docs.select(F.col(id_col).cast("long").alias("doc_id"), data.alias("data")))


def _searched(rows: DataFrame, seed: int = 0) -> DataFrame:
    spark = rows.sparkSession
    bounded_batches(spark)
    since, n = made_so_far(), partitions(spark)
    hashed = rows.select("doc_id", F.xxhash64(F.lit(2 * seed), "data").alias("key"), F.xxhash64(F.lit(2 * seed + 1), "data").alias("check"), "data")
    texts = stored(hashed.mapInArrow(_packed, "doc_id long, key long, check long, size long, packed binary, first boolean"), "texts")
    copies = stored(texts.groupBy("key").agg(F.count("*").alias("copies"), (F.min("check") != F.max("check")).alias("clash")), "copies")
    if not copies.where("clash").isEmpty():
        sweep(spark, since)
        return _searched(rows, seed + 1)
    distinct = texts.where("first").select("key", "size", "packed")
    runs = stored(distinct.mapInArrow(_anchored, "key long, start int, windows int, anchor long, body long"), "runs")
    place = F.xxhash64("key", "start")
    anchors = runs.groupBy("anchor").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.min("body").alias("one"), F.max("body").alias("other"), F.count("*").alias("n"))
    repeated = stored(anchors.where("low <> high").select("anchor", (F.col("one") != F.col("other")).alias("mixed"), "n"), "anchors")
    hits = hot_join(runs, repeated, "anchor", "n", runs.count())
    hits = stored(hits.select("key", "start", "windows", F.when(F.col("mixed"), F.col("anchor")).alias("anchor"), F.when(F.col("mixed"), F.col("body")).alias("body")), "hits")
    dropped(repeated)
    dropped(runs)
    span = lambda df: df.select("key", F.col("start").cast("long").alias("a"), (F.col("start") + F.col("windows") - 1 + LENGTH).cast("long").alias("b"))
    # Anchors with one kind of stretch: all of its windows repeat. Else kinds with several places: theirs do.
    mixed = hits.where("anchor IS NOT NULL")
    at = F.struct("key", "start")
    bodies = stored(mixed.groupBy("anchor", "body").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.first("windows").alias("windows"), F.count("*").alias("n")), "bodies")
    several = bodies.where("first <> last").select("anchor", "body", "n")
    whole_runs = span(hits.where("anchor IS NULL")).unionByName(span(hot_join(mixed, several, ["anchor", "body"], "n", mixed.count())))
    # The rest is compared by its bytes, with one stretch of each kind of its anchor.
    size = F.col("windows") + LENGTH
    per_anchor = bodies.groupBy("anchor").agg(F.count_if(F.col("first") == F.col("last")).alias("single"), F.ceil(F.sum(size) / BLOCK).cast("int").alias("parts"), F.count("*").alias("kinds"))
    asked = hot_join(bodies, stored(per_anchor.where("single > 0"), "singles"), "anchor", "kinds", bodies.count()).select(
        F.col("first.key").alias("key"), F.struct(F.col("first.start").alias("start"), "windows", "anchor", "parts", F.pmod(F.xxhash64("body"), "parts").cast("int").alias("part")).alias("x")
    )
    per_text = asked.groupBy("key").agg(F.collect_list("x").alias("asked"))
    one_copy = distinct.groupBy("key").agg(F.first("size").alias("size"), F.first("packed").alias("packed"))
    bytes_ = one_copy.join(per_text, "key").mapInArrow(_cut, "key long, start int, anchor long, parts int, part int, body binary")
    dealt = bytes_.repartition(4 * n, "anchor", "part").sortWithinPartitions("anchor", "part", "key", "start")
    scanned = stored(dealt.mapInArrow(_scanned, "key long, a long, b long, window long, check long"), "repeats")
    # Anchors in several blocks: windows met in two blocks.
    shared = scanned.where("window IS NOT NULL")
    met = shared.groupBy("window", "check").agg(F.min(F.struct("key", "a")).alias("low"), F.max(F.struct("key", "a")).alias("high"), F.count("*").alias("n")).where("low <> high")
    across = hot_join(shared, stored(met.select("window", "check", "n"), "met"), ["window", "check"], "n", shared.count()).select("key", "a", "b")
    found = whole_runs.unionByName(scanned.where("window IS NULL").select("key", "a", "b")).unionByName(across)
    per_key = found.groupBy("key").agg(F.collect_set(F.struct(F.col("a").alias("start"), F.col("b").alias("end"))).alias("spans"))
    # A text that occurs more than once goes as a whole, or is too short for a span.
    known = copies.where("copies = 1").join(per_key, "key", "left").select("key", "copies", "spans")
    known = stored(known.unionByName(copies.where("copies > 1").select("key", "copies", F.lit(None).cast("array<struct<start:long,end:long>>").alias("spans"))), "spans")
    sweep(spark, since, texts, known)
    return hot_join(texts.drop("check", "first"), known, "key", "copies", texts.count()).select("doc_id", "size", "packed", "copies", "spans").mapInArrow(_kept, OUT)


def _scanned(batches: Iterator) -> Iterator:
    """Repeats within each block: (key, a, b) of every occurrence, or the hash of a window another block may hold.

    Rows come sorted by anchor, part and place; whole groups are gathered up to about BLOCK bytes. A place that comes again,
    of another copy of its text, counts once.
    """
    import pyarrow as pa

    names = ["key", "a", "b", "window", "check"]

    def flush(held: list[tuple]):
        bodies = [np.frombuffer(h["body"], dtype=np.uint8) for h in held]
        sizes = np.array([len(b) + 2 for b in bodies])
        offset = np.cumsum(sizes) - sizes
        data = np.zeros(sizes.sum(), dtype=np.int64)
        own = np.repeat(np.arange(len(held)), sizes)
        for k, (h, body) in enumerate(zip(held, bodies, strict=True)):
            # Separators are unique: what starts a stretch counts as preceded by something of its own.
            data[offset[k]] = -2 * k - 1
            data[offset[k] + 1 : offset[k] + 1 + len(body)] = body
            data[offset[k] + 1 + len(body)] = -2 * k - 2
        longest = int(sizes.max())
        covered = np.zeros(len(data) + 1, dtype=np.int64)
        for length, starts in maximal_repeats(data, LENGTH, 1 << (longest - 1).bit_length()):
            np.add.at(covered, starts, 1)
            np.add.at(covered, starts + length, -1)
        inside = np.cumsum(covered)[:-1] > 0
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        low, high = edge[::2], edge[1::2]
        k = own[low]
        rows = np.array([h["key"] for h in held], dtype=np.int64)
        starts = np.array([h["start"] for h in held], dtype=np.int64)
        a = starts[k] + low - offset[k] - 1
        out = [(rows[k], a, a + high - low, None, None)]
        split = [i for i, h in enumerate(held) if h["parts"] > 1]
        if split:
            # One occurrence of each distinct window of the block, for the count across blocks.
            where, row, begin = [], [], []
            sums = prefix_sums(np.where(data < 0, 0, data).astype(np.uint8))
            for i in split:
                at = offset[i] + 1 + np.arange(len(bodies[i]) - LENGTH + 1)
                where.append(at)
                row.append(np.full(len(at), rows[i]))
                begin.append(starts[i] + np.arange(len(at)))
            where, row, begin = (np.concatenate(x) for x in (where, row, begin))
            window = spans(sums, where, where + LENGTH)
            middle = LENGTH // 2
            check = mix(spans(sums, where, where + middle) * U(3) + spans(sums, where + middle, where + LENGTH))
            out.append((row, begin, begin + LENGTH, window.view(np.int64), check.view(np.int64)))
        for row, begin, end, window, check in out:
            empty = pa.nulls(len(row), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(begin), pa.array(end), empty if window is None else pa.array(window), empty if check is None else pa.array(check)], names=names)

    held, size, group = [], 0, None
    for batch in batches:
        for h in batch.to_pylist():
            now = (h["anchor"], h["part"])
            if now == group and held and (held[-1]["key"], held[-1]["start"]) == (h["key"], h["start"]):
                continue
            if now != group and size >= BLOCK:
                yield from flush(held)
                held, size = [], 0
            group = now
            held.append(h)
            size += len(h["body"])
    if held:
        yield from flush(held)
