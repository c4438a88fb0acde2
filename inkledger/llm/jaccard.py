"""N-gram Jaccard join by prefix trees.

A document's set holds its distinct word shingles. All sets are ordered by one global order, rare shingles first, so that
two sets of Jaccard index at least the threshold have a common shingle among their first few (the prefix).
Sets that share a prefix shingle, directly or by others, form a candidate cluster. Each cluster's sets
are stored in a trie that shares common beginnings; every set is matched by walking the trie, which carries
the overlap found so far and leaves subtrees out that can't reach the threshold any more.

Equal sets are one class and are matched once. Shingles that occur in only one class can't be common to two: they count
in sizes, but aren't stored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, bounded_batches, hot_join, made_so_far, mix, partitions, portions, stored, sweep, whole
from .components import components

WORDS = 5
#: The threshold in per cent: |x & y| * 100 >= THRESHOLD * |x | y|.
THRESHOLD = 80
#: Sampled documents, and how many of them must hold a shingle for it to be frequent. Bounds only what is sent to the
#: workers (at most the sample's shingles / SAMPLE_LEAST); any choice gives the same links.
SAMPLE_DOCS, SAMPLE_LEAST = 8000, 16
#: Shingles per bucket when they are counted, per message of a task, and per block of a cluster.
BUCKET, MESSAGE, BLOCK = 250_000, 1_000_000, 1_000_000
#: Bits of a shingle that identify it within its bucket.
BITS = 48
_STEPS = [U(pow(0xA24BAED4963EE407, k + 1, 1 << 64)) for k in range(WORDS)]


class _Blank:
    """Bytes that separate words, and the lower case of each byte."""

    table = np.zeros(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32


def word_hashes(letters: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, distinct words of a batch being hashed once. Not a polynomial modulo 2**64: under those
    some unequal words of a thousand letters are equal whatever the base."""
    import pyarrow as pa
    import xxhash

    array = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(letters)])
    coded = array.dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), dtype=U, count=len(coded.dictionary))
    return mix(hashes)[np.asarray(coded.indices)]


def shingle_sets(texts) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text in a row, and the bounds of each text in them.

    texts: an Arrow string array without nulls.
    """
    import pyarrow as pa

    array = texts.cast(pa.large_binary())
    n = len(array)
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * array.offset) if n else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(array.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if n and offsets[-1] > offsets[0] else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        return np.zeros(0, dtype=U), np.zeros(n + 1, dtype=np.int64)
    part = ~_Blank.table[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    starts = np.flatnonzero(part & (np.concatenate(([True], ~part[:-1])) | cut[:-1]))
    ends = np.flatnonzero(part & (np.concatenate((~part[1:], [True])) | cut[1:])) + 1
    if not len(starts):
        return np.zeros(0, dtype=U), np.zeros(n + 1, dtype=np.int64)
    sizes = ends - starts
    at = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    words = word_hashes(_Blank.lower[data[at]], np.concatenate(([0], np.cumsum(sizes))))
    own = np.searchsorted(offsets, starts, side="right") - 1
    counts = np.bincount(own, minlength=n)
    full = np.zeros(0, dtype=U)
    doc_of = np.zeros(0, dtype=np.int64)
    if len(words) >= WORDS:
        last = len(words) - WORDS + 1
        full = sum((words[k : last + k] * _STEPS[k] for k in range(1, WORDS)), words[:last] * _STEPS[0])
        inside = own[:last] == own[WORDS - 1 :]
        full, doc_of = full[inside], own[:last][inside]
    few = (counts > 0) & (counts < WORDS)
    if few.any():
        first = np.cumsum(counts) - counts
        short = np.zeros(n, dtype=U)
        for k in range(WORDS - 1):
            has = few & (counts > k)
            short[has] += words[first[has] + k] * _STEPS[k]
        full = np.concatenate((full, short[few] + counts[few].astype(U)))
        doc_of = np.concatenate((doc_of, np.flatnonzero(few)))
    full = mix(full)
    order = np.lexsort((full, doc_of))
    full, doc_of = full[order], doc_of[order]
    keep = np.ones(len(full), dtype=bool)
    keep[1:] = (full[1:] != full[:-1]) | (doc_of[1:] != doc_of[:-1])
    full, doc_of = full[keep], doc_of[keep]
    bounds = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(np.bincount(doc_of, minlength=n), out=bounds[1:])
    return full, bounds


def set_keys(values: np.ndarray, bounds: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set, the same for equal sets; 0 for the empty set."""
    values = mix(values + U(seed)) if seed else values
    sums = np.zeros((2, len(values) + 1), dtype=U)
    np.cumsum(mix(values), out=sums[0, 1:])
    np.cumsum(mix(values ^ U(0x5851F42D4C957F2D)), out=sums[1, 1:])
    one, two = sums[0, bounds[1:]] - sums[0, bounds[:-1]], sums[1, bounds[1:]] - sums[1, bounds[:-1]]
    keys, checks = mix(one ^ (two << U(17) | two >> U(47))), mix(one + two * U(0xD6E8FEB86659FD93))
    empty = bounds[1:] == bounds[:-1]
    keys[empty] = checks[empty] = 0
    return keys.view(np.int64), checks.view(np.int64)


def _frequent(rows: DataFrame, total: int) -> np.ndarray:
    """Shingles that many documents of a bounded sample hold, most frequent last."""
    share = min(1.0, SAMPLE_DOCS / max(total, 1))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) <= int(share * (1 << 30)))

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, size = [], 0

        def sums():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often])], names=["s", "n"])

        for batch in portions(batches, 1000, 2):
            held.append(shingle_sets(batch.column(0))[0])
            size += len(held[-1])
            if size > MESSAGE:
                yield sums()
                held, size = [], 0
        if held:
            yield sums()

    counts = drawn.select("text").coalesce(max(1, partitions(rows.sparkSession) // 4)).mapInArrow(counted, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    found = sorted((r["n"], r["s"]) for r in counts.where(F.col("n") >= SAMPLE_LEAST).collect())
    return np.array([s for _, s in found], dtype=np.int64).view(U)


def _need(n):
    """Least overlap with any linked set, from the size of one."""
    return (THRESHOLD * n + 99) // 100


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_linked_classes: every document with the smallest id reachable by links.

    Links are exact up to collisions of the shingles' hashes (54 bits and more, all 64 on large tables). Sets are known by 64 bits;
    should two different ones share them, which a second hash of each tells, the sets are described again under another seed.
    Null texts, and texts without words, have an empty set and are linked with nothing. Texts of fewer than WORDS words
    have one shingle, of all their words. Rows of equal id keep rows of their own. Null ids take part and are named by
    others' ids. An empty table gives an empty table. Other columns are ignored.

    Shuffled: 6 bytes per shingle for the counts, then only shingles that occur in several classes, then only the sets
    whose prefix holds such shingles. Hot shingles (of a bounded sample) are not counted but kept with their
    documents. Clusters beyond BLOCK shingles are cut into blocks by size and hash; blocks are matched
    with themselves, then by representatives, then pairwise where they are still unconnected.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    return _classed(rows).select("doc_id", "n_shingles", "component_id", "n_linked_classes")


def _classed(rows: DataFrame, seed: int = 0) -> DataFrame:
    """linked() of rows of doc_id and text, with label, one for each component, and with the other columns of rows."""
    spark = rows.sparkSession
    bounded_batches(spark)
    since = made_so_far()
    carried = [c for c in rows.columns if c not in ("doc_id", "text")]
    kinds = dict(rows.dtypes)
    rows = rows.select("doc_id", "text", *carried)
    n_rows = rows.count()
    frequent = _frequent(rows, n_rows)
    by_value = np.argsort(frequent)
    hot = spark.sparkContext.broadcast((frequent[by_value], by_value.astype(np.int64)))

    def described(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known, rank = hot.value
        for batch in portions(batches, 1000, 2):
            values, bounds = shingle_sets(batch.column(1))
            is_hot, where = _member(values, known)
            hot_bounds = np.concatenate(([0], np.cumsum(is_hot)))[bounds]
            ranks = rank[where[is_hot]].astype("<u4")
            blobs = [ranks[hot_bounds[k] : hot_bounds[k + 1]].tobytes() for k in range(len(bounds) - 1)]
            keys, checks = set_keys(values, bounds, seed)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], pa.array(np.diff(bounds)), pa.array(keys), pa.array(checks), pa.array(blobs, pa.binary())],
                names=["doc_id", *carried, "n_shingles", "key", "check", "hot"],
            )

    schema = ", ".join(["doc_id long", *(f"{c} {kinds[c]}" for c in carried), "n_shingles long, key long, check long, hot binary"])
    described_docs = stored(rows.mapInArrow(described, schema), "sets")
    classes = described_docs.where("n_shingles > 0").groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("hot").alias("hot"), F.count("*").alias("copies"), (F.min("check") != F.max("check")).alias("clash")
    )
    classes = stored(classes, "classes")
    if not classes.where("clash").isEmpty():
        sweep(spark, since)
        return _classed(rows, seed + 1)
    total = described_docs.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).first()["n"]
    # Buckets, groups and the tasks they are dealt to grow with the shingles, so what one holds doesn't.
    bucket_bits = max(6, math.ceil(math.log2(max(1, total / BUCKET))))
    groups = 1 << max(6, bucket_bits - 1)
    tasks = max(partitions(spark), (1 << bucket_bits) // 4)
    low_bits = min(BITS, 64 - bucket_bits)
    shift, low_bytes = U(64 - bucket_bits - low_bits), -(-low_bits // 8)

    def dealt(batches: Iterator) -> Iterator:
        """Packed shingles by bucket: keys of documents, shingles of each, the shingles' lower bits."""
        import pyarrow as pa

        known, _ = hot.value
        held, size = [], 0
        names = ["bucket", "keys", "counts", "shingles"]

        def message():
            tokens, keys = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((tokens, keys, tokens >> U(low_bits)))
            tokens, keys = tokens[order], keys[order]
            buckets = (tokens >> U(low_bits)).astype(np.int64)
            new = np.ones(len(tokens), dtype=bool)
            new[1:] = (keys[1:] != keys[:-1]) | (buckets[1:] != buckets[:-1])
            run = np.flatnonzero(new)
            counts = np.diff(np.append(run, len(tokens)))
            low = np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[:, :low_bytes])
            some, edges = np.unique(buckets[run], return_index=True)
            spans = _between(edges, len(run))
            at = np.append(run, len(tokens))
            columns = [
                pa.array(some, pa.int64()),
                pa.array([keys[run[a:b]].tobytes() for a, b in spans], pa.binary()),
                pa.array([counts[a:b].astype("<u4").tobytes() for a, b in spans], pa.binary()),
                pa.array([low[at[a] : at[b]].tobytes() for a, b in spans], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in portions(batches, 1000, 2):
            values, bounds = shingle_sets(batch.column(0))
            keys = np.repeat(set_keys(values, bounds, seed)[0], np.diff(bounds))
            rare = ~_member(values, known)[0]
            held.append((values[rare] >> shift, keys[rare]))
            size += len(held[-1][0])
            if size > MESSAGE:
                yield message()
                held, size = [], 0
        if size:
            yield message()

    def repeated(table):
        """Shingles of a bucket that several classes hold, packed by group of classes."""
        import pyarrow as pa

        bucket = U(table.column("bucket")[0].as_py())
        read = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind)
        keys = np.repeat(read("keys", np.int64), read("counts", "<u4").astype(np.int64))
        tokens = np.zeros((len(keys), 8), dtype=np.uint8)
        tokens[:, :low_bytes] = read("shingles", np.uint8).reshape(-1, low_bytes)
        tokens = tokens.view(U).ravel() & U((1 << low_bits) - 1)
        order = np.lexsort((keys, tokens))
        tokens, keys = tokens[order], keys[order]
        new = np.ones(len(tokens), dtype=bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])
        tokens, keys = tokens[new], keys[new]
        first = np.ones(len(tokens), dtype=bool)
        first[1:] = tokens[1:] != tokens[:-1]
        held_by = np.diff(np.append(np.flatnonzero(first), len(tokens)))
        df = np.repeat(held_by, held_by)
        many = df > 1
        tokens, keys, df = tokens[many] | bucket << U(low_bits), keys[many], df[many]
        group = keys % groups
        order = np.argsort(group, kind="stable")
        tokens, keys, df, group = tokens[order], keys[order], df[order], group[order]
        some, edges = np.unique(group, return_index=True)
        spans = _between(edges, len(group))
        columns = [pa.array(some, pa.int64())] + [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (keys, tokens, df.astype("<u4"))]
        return pa.table(columns, names=["group", "keys", "tokens", "df"])

    messages = rows.select("text").mapInArrow(dealt, "bucket long, keys binary, counts binary, shingles binary")
    common = messages.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(repeated, "group long, keys binary, tokens binary, df binary")

    def ordered(classes, common):
        """Sets whose prefix holds shingles of several classes: their common shingles in global order."""
        import pyarrow as pa

        read = lambda name, kind: np.frombuffer(b"".join(common.column(name).to_pylist()), dtype=kind)
        keys, tokens, df = read("keys", np.int64), read("tokens", U), read("df", "<u4").astype(U)
        own = np.asarray(classes.column("key"), dtype=np.int64)
        n = np.asarray(classes.column("n"), dtype=np.int64)
        blobs = classes.column("hot").to_pylist()
        ranks = np.frombuffer(b"".join(blobs), dtype="<u4").astype(U)
        # Frequent shingles come after all counted ones; their ids don't meet those of counted ones.
        tokens = np.concatenate((tokens, ranks | U(1 << 63)))
        weight = np.concatenate((df, ranks | U(1 << 40)))
        keys = np.concatenate((keys, np.repeat(own, [len(b) // 4 for b in blobs])))
        order = np.lexsort((tokens, weight, keys))
        tokens, keys = tokens[order], keys[order]
        by_key = np.argsort(own)
        out = []
        lows, highs = np.searchsorted(keys, own[by_key], side="left"), np.searchsorted(keys, own[by_key], side="right")
        for k, low, high in zip(by_key.tolist(), lows.tolist(), highs.tolist(), strict=True):
            size = int(n[k])
            prefix = size - _need(size) + 1 - (size - (high - low))
            if prefix > 0 and high > low:
                out.append((int(own[k]), size, tokens[low:high].tobytes(), tokens[low : low + prefix].view(np.int64)))
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "n", "tokens", "prefix"])

    by_group = F.pmod(F.col("key"), F.lit(groups)).cast("long")
    sides = classes.withColumn("group", by_group).repartition(tasks, "group").groupBy("group").cogroup(common.repartition(tasks, "group").groupBy("group"))
    candidates = stored(sides.applyInArrow(ordered, "key long, n long, tokens binary, prefix array<long>"), "candidates")

    shared = candidates.select("key", F.explode("prefix").alias("token"))
    pivots = shared.groupBy("token").agg(F.min("key").alias("u"), F.max("key").alias("top")).where("u <> top").drop("top")
    clusters = stored(components(shared.join(pivots, "token").select("u", F.col("key").alias("v")).where("u <> v"), "clusters"), "clusters")
    members = candidates.drop("prefix").join(clusters.select(F.col("v").alias("key"), F.col("label").alias("cluster")), "key")
    links = _links(spark, stored(members, "members"))
    found = stored(components(links, "links"), "labels")
    # Each class with the smallest id of its component; most classes are linked with nothing.
    linked = stored(found.select(F.col("v").alias("key"), "label").join(classes.select("key", "rep", "copies"), "key"), "linked")
    least = linked.groupBy("label").agg(F.min("rep").alias("component"), F.count("*").alias("size"))
    linked = hot_join(linked.drop("rep"), stored(least, "least"), "label", "size", linked.count())
    alone = classes.join(found.select(F.col("v").alias("key")), "key", "left_anti").select(F.col("key").alias("label"), "key", "copies", F.col("rep").alias("component"), F.lit(1).cast("long").alias("size"))
    named = stored(linked.unionByName(alone), "named")
    sweep(spark, since, described_docs, named)
    own = described_docs.select("doc_id", *carried, "n_shingles", "key")
    with_words = hot_join(own.where("n_shingles > 0"), named, "key", "copies", n_rows).drop("copies")
    without = own.where("n_shingles = 0").select("*", F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("component"), F.lit(0).cast("long").alias("size"))
    return with_words.unionByName(without).withColumnsRenamed({"component": "component_id", "size": "n_linked_classes"})


def _between(starts: np.ndarray, end: int) -> list[tuple[int, int]]:
    """(from, to) of runs by their starts and the end of the last."""
    return list(zip(starts.tolist(), np.append(starts[1:], end).tolist(), strict=False))


def _member(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are in a sorted array, and where."""
    if not len(known):
        return np.zeros(len(values), dtype=bool), np.zeros(len(values), dtype=np.int64)
    where = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[where] == values, where


def _links(spark, members: DataFrame) -> DataFrame:
    """Edges (u, v) that connect exactly what the links of all members connect."""
    weight = F.octet_length("tokens") / 8
    # Sets of one band or of neighbouring bands only can be linked: sizes differ by a quarter at most.
    sized = members.withColumn("band", F.floor(F.log("n") / math.log(100 / THRESHOLD)).cast("int"))
    totals = sized.groupBy("cluster").agg(F.sum(weight).alias("cluster_weight"))
    large = totals.where(F.col("cluster_weight") > BLOCK).select(F.col("cluster").alias("large_cluster"))
    bands = sized.groupBy("cluster", "band").agg(F.ceil(F.sum(weight) / BLOCK).cast("int").alias("parts"))
    bands = bands.join(large, F.col("cluster") == F.col("large_cluster"), "left").select(
        F.col("cluster").alias("c"), F.when(F.col("large_cluster").isNull(), F.lit(-1)).otherwise(F.col("band")).alias("block_band"), F.col("band").alias("b"), F.when(F.col("large_cluster").isNull(), F.lit(1)).otherwise(F.col("parts")).alias("parts")
    )
    placed = sized.join(bands, (F.col("cluster") == F.col("c")) & (F.col("band") == F.col("b")))
    placed = stored(
        placed.select("key", "n", "tokens", "cluster", F.col("block_band").alias("band"), F.pmod(F.xxhash64(F.lit(3), "key"), F.col("parts")).cast("int").alias("part")), "blocks"
    )
    flat = placed.withColumn("label", F.col("key")).withColumn("side", F.lit(0))
    inside = stored(flat.groupBy("cluster", "band", "part").applyInArrow(_matched, "u long, v long"), "links")
    cut = placed.where("band >= 0")
    if cut.isEmpty():
        return inside
    # Large clusters: one representative per block and component, matched together.
    labels = stored(components(inside, "inside"), "inside")
    labelled = stored(cut.join(labels.select(F.col("v").alias("key"), "label"), "key", "left").withColumn("label", F.coalesce("label", "key")), "labelled")
    heads = labelled.groupBy("cluster", "band", "part", "label").agg(F.min_by(F.struct("key", "n", "tokens"), "key").alias("head"))
    heads = heads.select("cluster", "head.*", "label", F.floor(F.pmod(F.xxhash64("label"), F.lit(1 << 20)) / 256).cast("int").alias("x"), F.lit(0).alias("side"))
    reps = heads.groupBy("cluster").agg(F.sum(F.octet_length("tokens") / 8).alias("w"))
    heads = heads.join(reps, "cluster").withColumn("part", F.pmod(F.xxhash64("key"), F.ceil(F.col("w") / BLOCK)).cast("int"))
    across = stored(heads.groupBy("cluster", "part").applyInArrow(_matched, "u long, v long"), "links")
    labels = stored(components(inside.unionByName(across), "across"), "across")
    labelled = stored(cut.join(labels.select(F.col("v").alias("key"), "label"), "key", "left").withColumn("label", F.coalesce("label", "key")), "labelled")
    # Pairs of blocks that are not yet one component, with all their sets.
    blocks = labelled.groupBy("cluster", "band", "part").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    one, two = blocks.alias("one"), blocks.alias("two")
    later = (F.col("two.band") > F.col("one.band")) | (F.col("two.part") > F.col("one.part"))
    pairs = one.join(two, (F.col("one.cluster") == F.col("two.cluster")) & (F.col("two.band") - F.col("one.band")).isin(0, 1) & later)
    pairs = pairs.where(F.least("one.low", "two.low") != F.greatest("one.high", "two.high"))
    pairs = stored(
        pairs.select(
            F.col("one.cluster").alias("cluster"),
            F.struct(F.col("one.band").alias("a"), F.col("one.part").alias("b"), F.col("two.band").alias("c"), F.col("two.part").alias("d")).alias("pair"),
            F.explode(
                F.array(
                    F.struct(F.col("one.band").alias("band"), F.col("one.part").alias("part"), F.lit(1).alias("side")),
                    F.struct(F.col("two.band").alias("band"), F.col("two.part").alias("part"), F.lit(2).alias("side")),
                )
            ).alias("x"),
        ).select("cluster", "pair", "x.*"),
        "pairs",
    )
    if pairs.isEmpty():
        return inside.unionByName(across)
    between = labelled.join(pairs, ["cluster", "band", "part"]).groupBy("cluster", "pair").applyInArrow(_matched, "u long, v long")
    return inside.unionByName(across).unionByName(stored(between, "links"))


def _matched(table):
    """Edges found in a block of sets (key, n, tokens, label, side): of side 0 all with all, of sides 1 and 2 with the other side."""
    import pyarrow as pa

    keys = table.column("key").to_pylist()
    tokens = [np.frombuffer(b, dtype=">u8") for b in table.column("tokens").to_pylist()]
    labels = np.asarray(table.column("label"), dtype=np.int64)
    sides = np.asarray(table.column("side"), dtype=np.int64)
    found = trie_links(tokens, np.asarray(table.column("n"), dtype=np.int64), labels, sides)
    return pa.table([pa.array([keys[a] for a, _ in found], pa.int64()), pa.array([keys[b] for _, b in found], pa.int64())], names=["u", "v"])


class Trie:
    """A path-compressed trie of token sequences, its nodes in breadth-first order as arrays."""

    def __init__(self, sequences: list[np.ndarray], sizes: np.ndarray):
        self.order = sorted(range(len(sequences)), key=lambda k: sequences[k].tobytes())
        count = len(self.order)
        rows = [sequences[k] for k in self.order]
        commons = [0] * (count + 1)
        for k in range(1, count):
            a, b = rows[k - 1], rows[k]
            m = min(len(a), len(b))
            unequal = np.flatnonzero(a[:m] != b[:m])
            commons[k] = int(unequal[0]) if len(unequal) else m
        # Nodes: depth above, depth below, first leaf, last leaf + 1, children.
        root = [0, 0, 0, count, []]
        stack = [root]
        for k in range(count):
            shared, last = commons[k], None
            while stack[-1][1] > shared:
                last = stack.pop()
                last[3] = k
            top = stack[-1]
            if last is not None:
                if top[1] < shared:
                    middle = [top[1], shared, last[2], count, [last]]
                    last[0] = shared
                    top[4][-1] = middle
                    stack.append(middle)
            elif not top[4] and top is not root:
                # The row before ends here, and this one goes on or is its equal: its end is a child of its own.
                top[4].append([top[1], top[1], k - 1, k, []])
            leaf = [stack[-1][1], len(rows[k]), k, k + 1, []]
            stack[-1][4].append(leaf)
            if leaf[1] > leaf[0]:
                stack.append(leaf)
        for node in stack:
            node[3] = count
        nodes, first_child, children = [root], [], []
        for node in nodes:
            first_child.append(len(nodes))
            children.append(len(node[4]))
            nodes.extend(node[4])
        for node in reversed(nodes):
            if node[4]:
                node[2], node[3] = node[4][0][2], node[4][-1][3]
        self.child, self.children = np.array(first_child), np.array(children)
        above, below, low, high = (np.array([n[i] for n in nodes]) for i in range(4))
        self.low, self.high = low, high
        self.sizes = sizes[self.order]
        lengths = np.array([len(r) for r in rows])
        # What is left below a node at most, and the sizes of the sets below it.
        starts = np.minimum(low, count - 1)
        spans = [slice(a, max(b, a + 1)) for a, b in zip(starts.tolist(), high.tolist(), strict=True)]
        self.left = np.array([lengths[s].max() for s in spans]) - below
        self.least = np.array([self.sizes[s].min() for s in spans])
        self.most = np.array([self.sizes[s].max() for s in spans])
        self.leaf = self.children == 0
        known, flat = np.unique(np.concatenate(rows), return_inverse=True) if count else (np.zeros(0), np.zeros(0, dtype=np.int64))
        offsets = np.cumsum(lengths) - lengths
        self.tokens = [flat[o : o + n] for o, n in zip(offsets.tolist(), lengths.tolist(), strict=True)]
        self.flat, self.begin, self.end = flat, offsets[starts] + above, offsets[starts] + below
        self.marks = np.zeros(len(known) + 1, dtype=np.int64)

    def matches(self, k: int, after: int) -> np.ndarray:
        """Leaves from `after` on whose sets are linked with the k-th leaf's set."""
        n = int(self.sizes[k])
        marks = self.marks
        marks[self.tokens[k]] = 1
        nodes, overlap, found = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), []
        while len(nodes):
            begin, size = self.begin[nodes], self.end[nodes] - self.begin[nodes]
            total = np.zeros(size.sum() + 1, dtype=np.int64)
            ends = np.cumsum(size)
            np.cumsum(marks[self.flat[np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)]], out=total[1:])
            overlap = overlap + total[ends] - total[ends - size]
            leaf = self.leaf[nodes]
            ny = self.least[nodes]
            linked = leaf & (100 * overlap >= THRESHOLD * (n + ny - overlap)) & (self.low[nodes] >= after)
            found.append(self.low[nodes[linked]])
            best = overlap + self.left[nodes]
            on = ~leaf & ((100 + THRESHOLD) * best >= THRESHOLD * (n + ny)) & (THRESHOLD * ny <= 100 * n) & (100 * self.most[nodes] >= THRESHOLD * n) & (self.high[nodes] > after)
            nodes, overlap = nodes[on], overlap[on]
            count = self.children[nodes]
            overlap = np.repeat(overlap, count)
            ends = np.cumsum(count)
            nodes = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.child[nodes] - (ends - count), count)
        marks[self.tokens[k]] = 0
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def trie_links(tokens: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray | None = None, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of rows that connect exactly the rows that links connect, given that rows of equal label are connected.

    tokens: of each row, its shingles that others hold, in the global order; sizes: all its shingles. Rows of sides 1 and 2
    are matched with the other side only.
    """
    if len(tokens) < 2:
        return []
    trie = Trie(tokens, sizes)
    order = np.array(trie.order)
    label = np.unique(np.arange(len(tokens)) if labels is None else labels, return_inverse=True)[1][order]
    side = np.zeros(len(tokens), dtype=np.int64) if sides is None else sides[order]
    out = []
    for k in range(len(order) - 1):
        open_ = (label[k + 1 :] != label[k]) & ((side[k + 1 :] != side[k]) | (side[k] == 0))
        if not open_.any():
            continue
        for j in trie.matches(k, k + 1 + int(np.argmax(open_))).tolist():
            if label[j] != label[k] and (side[j] != side[k] or side[k] == 0):
                label[label == label[j]] = label[k]
                out.append((int(order[k]), int(order[j])))
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of linked documents: that of the smallest id. Columns and their order stay.

    Documents without words are linked with nothing and all stay. A row of null id stays only where no linked one has an id. Of
    rows of one id and different texts the one of the smallest hash stays if they are linked; rows that repeat both are
    copies of one document. Rows are told by id and 128 bits of their text's hash; copies of a row are taken together
    before the shuffle.
    """
    since = made_so_far()
    names = ("doc_id", "text_1", "text_2")
    identity = [F.col("doc_id").cast("long").alias(names[0]), F.xxhash64("text").alias(names[1]), F.xxhash64(F.lit(17), "text").alias(names[2])]
    rows = docs.select(*identity, whole("text").alias("text"))
    order = F.struct(F.col("doc_id").isNull().alias("missing"), *names)
    found = _classed(rows).where("n_shingles > 0").groupBy("label").agg(F.min(order).alias("first"))
    kept = stored(found.select("first.*").drop("missing"), "kept")
    sweep(docs.sparkSession, since, kept)
    word = F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    own = docs.where(word).select(F.struct("*").alias("row"), *identity).groupBy(*names).agg(F.first("row").alias("row")).alias("own")
    same = [F.col(f"own.{n}").eqNullSafe(F.col(f"kept.{n}")) for n in names]
    # The same plan at every size: kept rows grow with the documents, so they are never broadcast.
    chosen = own.join(kept.alias("kept").hint("merge"), same, "left_semi").select("row.*")
    return chosen.unionByName(docs.where(~word))
