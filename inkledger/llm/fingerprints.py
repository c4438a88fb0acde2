"""Document fingerprints from prefix polynomial hashes.

Every text gets modular prefix arrays under two primes. They give the hash of any span in constant time,
so that two spans are compared without reading them, the longest common extension of two positions is
found by binary search, and the hashes of all windows of an edited text follow from those of its parts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, bounded_batches, mix, partitions, whole

#: Two primes below 2**31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1_000_003, 911_382_323)
WINDOW, SKETCH = 16, 128
SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, common_prefix_edited long, common_prefix_next long"
)

_tables: list[np.ndarray] = [np.ones(1, dtype=np.int64), np.ones(1, dtype=np.int64)]


def _powers(which: int, n: int) -> np.ndarray:
    """Powers of a base modulo its prime, doubled as needed."""
    table = _tables[which]
    while len(table) < n:
        step = int(table[-1]) * BASES[which] % PRIMES[which]
        table = np.concatenate((table, table * step % PRIMES[which]))
    _tables[which] = table
    return table[:n]


class Prefixes:
    """Modular prefix arrays of a text's code points."""

    def __init__(self, text: str):
        self.text = text
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        self.n = len(self.codes)
        self.sums = []
        for which, prime in enumerate(PRIMES):
            sums = np.zeros(self.n + 1, dtype=np.int64)
            np.cumsum((self.codes + 1) * _powers(which, self.n) % prime, out=sums[1:])
            self.sums.append(sums % prime)
        self._windows: np.ndarray | None = None

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Hash of the code points [start, end): equal spans have equal pairs, wherever they stand."""
        return tuple(
            (int(sums[end]) - int(sums[start])) * pow(base, -start, prime) % prime for sums, base, prime in zip(self.sums, BASES, PRIMES, strict=True)
        )

    def same(self, start: int, other: "Prefixes", at: int, length: int) -> bool:
        return self.span(start, start + length) == other.span(at, at + length)

    def common_extension(self, start: int, other: "Prefixes", at: int) -> int:
        """Code points that agree from start here and from at there: binary search over span equality."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(start, other, at, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def windows(self) -> np.ndarray:
        """A 64-bit hash of every window of WINDOW code points, or of the whole of a shorter text; of nothing, none."""
        if self._windows is None:
            self._windows = window_hashes(self.sums, self.n)
        return self._windows


def window_hashes(sums: list[np.ndarray], n: int) -> np.ndarray:
    if n == 0:
        return np.zeros(0, dtype=U)
    width = min(WINDOW, n)
    both = []
    for which, prime in enumerate(PRIMES):
        # Shifted to the last window's place, equal windows get equal values.
        power = _powers(which, n - width + 1)[::-1]
        both.append(((sums[which][width:] - sums[which][:-width]) % prime * power % prime).astype(U))
        shift = pow(BASES[which], -(n - width), prime)
        both[-1] = both[-1] * U(shift) % U(prime)
    return mix(both[0] << U(31) | both[1])


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The SKETCH smallest distinct 40-bit values."""
    values = hashes >> U(24)
    if len(values) > 8 * SKETCH:
        least = np.unique(np.partition(values, 4 * SKETCH)[: 4 * SKETCH])
        if len(least) >= SKETCH:
            return least[:SKETCH]
    return np.unique(values)[:SKETCH]


def written(n: int, pair: tuple[int, int], least: np.ndarray) -> str:
    return f"{n:x}.{pair[0]:08x}{pair[1]:08x}." + "".join([f"{x:010x}" for x in least.tolist()])


def likeness_of(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    union = np.union1d(a, b)
    full = len(a) >= SKETCH or len(b) >= SKETCH
    union = union[:SKETCH] if full else union
    both = np.intersect1d(a, b, assume_unique=True)
    return float((both <= union[-1]).sum()) / len(union)


def likeness(one: str, other: str) -> float:
    """Likeness of two fingerprints, 0 to 1: the Jaccard index of the window sets, estimated from their smallest members."""
    if one == other:
        return 1.0
    read = lambda s: np.array([int(s[i : i + 10], 16) for i in range(0, len(s), 10)], dtype=U)
    return likeness_of(read(one.rsplit(".", 1)[1]), read(other.rsplit(".", 1)[1]))


def edited(doc: Prefixes, after: Prefixes) -> tuple[str, np.ndarray, tuple[int, int]]:
    """The edited text, its window hashes and its whole hash, composed from both texts' prefix arrays."""
    cut = doc.n // 3
    head, tail = doc.n - cut, min(cut, after.n)
    text = doc.text[:head] + after.text[:tail]
    one, two = doc.span(0, head), after.span(0, tail)
    pair = tuple((a + b * pow(base, head, prime)) % prime for a, b, base, prime in zip(one, two, BASES, PRIMES, strict=True))
    if head < WINDOW or tail < WINDOW:
        return text, Prefixes(text).windows(), pair
    join = Prefixes(doc.text[head - WINDOW + 1 : head] + after.text[: WINDOW - 1])
    parts = (doc.windows()[: head - WINDOW + 1], join.windows(), after.windows()[: tail - WINDOW + 1])
    return text, np.concatenate(parts), pair


def _row(doc_id, doc: Prefixes, least: np.ndarray, after: Prefixes, least_after: np.ndarray) -> tuple:
    text, hashes, pair = edited(doc, after)
    least_edited = sketch(hashes)
    own = written(doc.n, doc.span(0, doc.n), least)
    new = written(len(text), pair, least_edited)
    near = 1.0 if own == new else likeness_of(least, least_edited)
    following = 1.0 if doc.text == after.text else likeness_of(least, least_after)
    cut = doc.n // 3
    head = doc.n - cut
    common = head + (doc.common_extension(head, after, 0) if cut else 0)
    return (
        doc_id,
        doc.n,
        hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),
        own,
        new,
        near,
        following,
        min(common, len(text), doc.n),
        doc.common_extension(0, after, 0),
    )


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text (see _row), each beside the next text in descending id order.

    Rows: one per document. Null and empty texts have no windows: they are like each other (1) and
    like nothing else (0). Null ids come last in the order; rows of equal id are ordered by text. A
    single row is its own next one. Other columns are ignored. An empty table gives an empty table.

    The order is cut into ranges at quantiles of a bounded sample of pairs of id and text hash, so that neither repeated nor null
    ids meet in one task; only rows that repeat both do. Whole texts are shuffled once, by range; the first row of
    each range also goes to the range before it, so that no row is missing its neighbour. The driver
    holds the sample's distinct pairs, about 40 a range, and one pair per range.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    count = partitions(spark)
    ranges = ranges or 4 * count
    total = docs.count()
    if not total:
        return spark.createDataFrame([], SCHEMA)
    share = min(1.0, 40 * ranges / total)
    picked = docs.select("doc_id", "tie").where(F.pmod(F.xxhash64("doc_id", "tie"), F.lit(1_000_003)) < share * 1_000_003 + 1)
    # A pair is drawn or not whatever its rows, so it comes once with their number. Null ids are the least, so they come last in descending order.
    pairs = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["tie"], r["n"]) for r in picked.groupBy("doc_id", "tie").agg(F.count("*").alias("n")).collect())
    drawn, before, bounds = sum(p[3] for p in pairs), 0, []
    for *pair, n in pairs:
        # Pairs in which a quantile of the drawn rows lies.
        if before * ranges // drawn < (before + n) * ranges // drawn and before:
            bounds.append(tuple(pair))
        before += n
    # Range 0 has the largest ids.
    place = F.lit(len(bounds)) - _bucket(F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("tie").alias("tie")), bounds)
    ranged = docs.withColumn("place", place.cast("int"))
    firsts = ranged.groupBy("place").agg(F.max(F.struct("doc_id", "tie")).alias("top")).collect()
    tops = {r["place"]: (r["top"]["doc_id"], r["top"]["tie"]) for r in firsts}
    order = sorted(tops)
    # The range before each range; the first range follows the last.
    goes = [(tops[p][0], tops[p][1], order[i - 1]) for i, p in enumerate(order)]
    heads = spark.createDataFrame(goes, "top_id long, top_tie long, before int")
    ghosts = (
        ranged.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("top_id")) & (F.col("tie") == F.col("top_tie")))
        .groupBy("before", "top_id", "top_tie")
        .agg(F.first("text").alias("text"))
        .select(F.col("top_id").alias("doc_id"), "text", F.lit(None).cast("long").alias("tie"), F.col("before").alias("place"), F.lit(1).alias("ghost"))
    )
    both = ranged.withColumn("ghost", F.lit(0)).unionByName(ghosts)
    ordered = both.repartition(count, "place").sortWithinPartitions("place", "ghost", F.col("doc_id").desc_nulls_last(), F.col("tie").desc(), "text")
    return ordered.select("place", "ghost", "doc_id", "text").mapInArrow(_neighbours, SCHEMA)


def _bucket(value, bounds: list[tuple[bool, int, int]]):
    """How many of the sorted bounds are at most the value: a binary search in the plan, without Python."""
    if not bounds:
        return F.lit(0)
    listed = F.from_json(F.lit(json.dumps([{"known": k, "id": i, "tie": t} for k, i, t in bounds])), "array<struct<known:boolean,id:bigint,tie:bigint>>")
    steps = F.lit([1 << k for k in reversed(range(len(bounds).bit_length()))])
    further = lambda at, step: (at + step <= len(bounds)) & (F.get(listed, at + step - 1) <= value)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(further(at, step), at + step).otherwise(at))


def _neighbours(batches: Iterator) -> Iterator:
    import pyarrow as pa

    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string())]
        + [("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_prefix_edited", pa.int64()), ("common_prefix_next", pa.int64())]
    )
    held = None
    for batch in batches:
        rows = []
        for place, ghost, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            doc = Prefixes(text)
            now = (place, doc_id, doc, sketch(doc.windows()))
            if held is not None and held[0] == place:
                rows.append(_row(held[1], held[2], held[3], now[2], now[3]))
            held = None if ghost else now
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
