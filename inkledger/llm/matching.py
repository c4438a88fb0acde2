"""Removal of word passages that an earlier document has, by FM-indexes over wavelet matrices.

Passages reach their index by content. In every window of WINDOW words the least hash of GRAM words is the window's anchor, so equal
windows have equal anchors; consecutive windows with one anchor form a stretch, and stretches of anchors that occur once have no equal
windows. A shard holds the distinct stretches of some anchors: its FM-index (a Burrows-Wheeler transform as a wavelet matrix of packed
bits) is searched backward with all windows of the shard at once. The interval of a window's last words shrinks from step to
step; a window whose interval holds no smaller document leaves the search, and those that are left after WINDOW steps are
reported. Stretches that equal another as wholes are told by hashes and searched once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE_INVERSE, HOT_KEYS, U, bounded_batches, hot_join, made_so_far, mix, partitions, powers, stored, sweep, whole
from .suffixes import least_ahead, suffix_array

WINDOW, GRAM = 13, 4
#: Words of stretches in a shard; an anchor with more is searched window by window, by hashes.
BLOCK = 1 << 17
#: One in so many documents is looked at to find anchors that are frequent. That only says how rows are dealt out; any choice gives the same results.
SAMPLED = 32
#: Words remembered with their hashes in each of two generations.
WORDS = 200_000
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:long,end:long>>"
_young: dict[bytes, int] = {}
_old: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    global _young, _old
    import xxhash

    young, old, digest = _young, _old, xxhash.xxh64_intdigest
    out = [young.get(w) for w in words]
    if None in out:
        for k, h in enumerate(out):
            if h is None:
                w = words[k]
                h = young.get(w)
                if h is None:
                    h = old.get(w)
                    h = digest(w) if h is None else h
                    if len(w) <= 64:
                        young[w] = h
                out[k] = h
        if len(young) > WORDS:
            _young, _old = {}, young
    return np.array(out, dtype=U)


class Spans:
    """Hashes of the spans of a word sequence, from prefix sums over its words' hashes."""

    def __init__(self, hashes: np.ndarray, salt: int = 0):
        hashes = mix(hashes ^ U(salt)) if salt else hashes
        self.sums = np.zeros(len(hashes) + 1, dtype=U)
        np.cumsum(hashes * powers(len(hashes)), dtype=U, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = powers(len(self.sums), BASE_INVERSE)
        return mix((self.sums[end] - self.sums[start]) * inverse[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def stretches(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows, anchor and hash of each run of windows with one anchor, from the words' hashes."""
    windows = len(hashes) - WINDOW + 1
    if windows < 1:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    spans = Spans(hashes)
    at = np.arange(len(hashes) - GRAM + 1)
    grams = spans.of(at, at + GRAM)
    # Positions break ties among equal grams of a window, the first first; parts of the text keep them within 24 bits.
    anchors = []
    for low in range(0, windows, 1 << 23):
        part = grams[low : low + (1 << 23) + WINDOW - GRAM]
        key = (part & ~U(0xFFFFFF)) | np.arange(len(part), dtype=U)
        anchors.append((least_ahead(key, WINDOW - GRAM + 1) & U(0xFFFFFF)).astype(np.int64)[: 1 << 23] + low)
    anchors = np.concatenate(anchors)
    start = np.flatnonzero(np.diff(anchors, prepend=-1))
    count = np.diff(np.append(start, windows))
    return start, count, grams[anchors[start]].view(np.int64), spans.of(start, start + count - 1 + WINDOW).view(np.int64)


class FMIndex:
    """Backward search in a sequence of symbols from 1 on, with 0 as separators: a wavelet matrix of its Burrows-Wheeler transform.

    Level by level from the highest bit, the transform's bits are packed into words of 64 with a running count a word;
    zeros are moved before ones for the next level.
    """

    def __init__(self, symbols: np.ndarray):
        apart = symbols.astype(np.int64)
        zero = np.flatnonzero(symbols == 0)
        apart[zero] = -1 - np.arange(len(zero))
        longest = int(np.diff(np.concatenate(([-1], zero, [len(symbols)]))).max(initial=1)) + 1
        self.order = suffix_array(apart, 1 << longest.bit_length())[0]
        now = symbols[self.order - 1].astype(np.int64)
        top = int(symbols.max(initial=0)) + 1
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=top))))
        self.levels = []
        start = np.zeros(top, dtype=np.int64)
        codes = np.arange(top)
        for shift in reversed(range(max(1, top.bit_length()))):
            bits = (now >> shift & 1).astype(bool)
            padded = np.zeros(len(bits) // 64 * 64 + 64, dtype=bool)
            padded[: len(bits)] = bits
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
            zeros = len(bits) - int(bits.sum())
            self.levels.append((shift, packed, counts, zeros))
            start = self._down(len(self.levels) - 1, start, codes >> shift & 1 == 1)
            now = np.concatenate((now[~bits], now[bits]))
        self.start = start

    def _down(self, level: int, at: np.ndarray, one: np.ndarray) -> np.ndarray:
        _, packed, counts, zeros = self.levels[level]
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        ones = counts[word] + np.bitwise_count(packed[word] & ((U(1) << bit) - U(1)))
        return np.where(one, zeros + ones, at - ones)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first `at` of the transform."""
        for level, (shift, *_) in enumerate(self.levels):
            at = self._down(level, at, (symbol >> shift & 1).astype(bool))
        return at - self.start[symbol]

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix intervals of symbol + pattern, from those of the patterns."""
        both = self.first[symbol] + self.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high))).reshape(2, -1)
        return both[0], both[1]


class Minima:
    """Least value of any range of an array, from minima of ranges of powers of two."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            half = 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(self.rows[-1][:-half], self.rows[-1][half:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.full(len(low), np.iinfo(np.int64).max, dtype=np.int64)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level[high > low]).tolist():
            at = np.flatnonzero((level == k) & (high > low))
            out[at] = np.minimum(self.rows[k][low[at]], self.rows[k][high[at] - (1 << k)])
        return out


def earlier(symbols: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of the windows that end at `ends` also occur with a smaller owner. symbols: from 1 on, 0 between stretches."""
    index = FMIndex(symbols)
    least = Minima(owner[index.order])
    which = np.arange(len(ends))
    symbol = symbols[ends]
    low, high = index.first[symbol], index.first[symbol + 1]
    for k in range(1, WINDOW):
        if k % 3 == 1 or k == WINDOW - 1:
            stay = least.of(low, high) < owner[ends[which]]
            which, low, high = which[stay], low[stay], high[stay]
        if not len(which):
            break
        low, high = index.step(symbols[ends[which] - k], low, high)
    found = np.zeros(len(ends), dtype=bool)
    found[which[least.of(low, high) < owner[ends[which]]]] = True
    return found


def _anchored(batches: Iterator) -> Iterator:
    """The stretches of each text, but of texts that a document with no larger id in the same task has too."""
    import pyarrow as pa

    names, seen = ["row", "doc", "at", "anchor", "body"], {}
    for batch in batches:
        keys, docs, found = [], [], []
        for row, doc, text, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if seen.get(text, doc + 1) > doc:
                seen[text] = doc
                keys.append(row)
                docs.append(doc)
                found.append(stretches(word_hashes(data.split())))
        if not found:
            continue
        count = [len(f[0]) for f in found]
        start, windows, anchor, body = (np.concatenate(c) for c in zip(*found, strict=True))
        arrays = [np.repeat(np.array(keys, dtype=np.int64), count), np.repeat(np.array(docs, dtype=np.int64), count), start << 8 | windows, anchor, body]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names)


def _packed(batches: Iterator) -> Iterator:
    """Texts as zstd frames, since they are shuffled."""
    import pyarrow as pa

    codec = pa.Codec("zstd", compression_level=1)
    for batch in batches:
        texts = batch.column(2).to_pylist()
        columns = [pa.array([len(t) for t in texts], pa.int64()), pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["row", "doc_id", "size", "packed"])


def _cut(batches: Iterator) -> Iterator:
    """The words of the stretches asked for of each text; of those of large anchors the hashes of their windows."""
    import pyarrow as pa

    codec = pa.Codec("zstd")
    names = ["anchor", "body", "doc", "at", "words", "window", "check"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
    for batch in batches:
        out = []
        for size, packed, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = codec.decompress(packed, size, asbytes=True).split()
            if any(x["large"] for x in asked):
                hashes = word_hashes(words)
                one, two = Spans(hashes), Spans(hashes, 0x5851F42D4C957F2D)
            for x in asked:
                start, windows = x["at"] >> 8, x["at"] & 255
                head = x["anchor"], x["body"], x["doc"]
                if x["large"]:
                    at = start + np.arange(windows)
                    both = zip(one.of(at, at + WINDOW).view(np.int64).tolist(), two.of(at, at + WINDOW).view(np.int64).tolist(), strict=True)
                    out += [(*head, k, None, *pair) for k, pair in enumerate(both)]
                else:
                    out.append((*head, x["at"], b" ".join(words[start : start + windows - 1 + WINDOW]), None, None))
        columns = zip(*out, strict=True) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _searched(batches: Iterator) -> Iterator:
    """(anchor, body, a): first words of windows that an earlier document has. Rows come sorted by anchor; whole anchors make a shard."""
    import pyarrow as pa

    def flush(held: list[tuple]):
        texts = [w.split() for *_, w in held]
        sizes = np.array([len(t) + 1 for t in texts])
        offset = np.cumsum(sizes) - sizes
        number: dict[bytes, int] = {}
        symbols = np.zeros(int(sizes.sum()) + 1, dtype=np.int64)
        owner = np.zeros(len(symbols), dtype=np.int64)
        for (_, _, doc, _), text, at in zip(held, texts, offset.tolist(), strict=True):
            symbols[at + 1 : at + 1 + len(text)] = [number.setdefault(w, len(number) + 1) for w in text]
            owner[at + 1 : at + 1 + len(text)] = doc
        ends = np.concatenate([at + WINDOW + np.arange(n - WINDOW) for at, n in zip(offset, sizes, strict=True)])
        of = np.repeat(np.arange(len(held)), sizes - WINDOW)
        found = np.flatnonzero(earlier(symbols, owner, ends))
        of, begin = of[found], ends[found] - WINDOW - offset[of[found]]
        heads = np.array([h[:2] for h in held], dtype=np.int64)[of].reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(heads[:, 0]), pa.array(heads[:, 1]), pa.array(begin)], names=["anchor", "body", "a"])

    held, size, now, bodies = [], 0, None, set()
    for batch in batches:
        for anchor, body, doc, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if anchor != now:
                if size >= BLOCK:
                    yield from flush(held)
                    held, size = [], 0
                now, bodies = anchor, set()
            # A row that is repeated has its stretches cut out once more.
            if body not in bodies:
                bodies.add(body)
                held.append((anchor, body, doc, words))
                size += words.count(b" ") + 2
    if held:
        yield from flush(held)


def _kept(batches: Iterator) -> Iterator:
    """What is left of each text without its spans, or of one that an earlier document has as a whole."""
    import pyarrow as pa

    codec = pa.Codec("zstd")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(span))
    for batch in batches:
        out = []
        for doc_id, size, packed, again, got in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
            words, merged = codec.decompress(packed, size, asbytes=True).split(), []
            if again and len(words) >= WINDOW:
                merged = [(0, len(words))]
            elif got.is_valid and len(got):
                a, b = (np.asarray(got.values.field(i), dtype=np.int64) for i in range(2))
                order = np.argsort(a, kind="stable")
                a, reach = a[order], np.maximum.accumulate(b[order])
                first = np.flatnonzero(np.concatenate(([True], a[1:] > reach[:-1])))
                merged = list(zip(a[first].tolist(), reach[np.append(first[1:], len(a)) - 1].tolist(), strict=True))
            rest, at = [], 0
            for s, e in merged:
                rest += words[at:s]
                at = e
            rest += words[at:]
            out.append((doc_id, len(words), len(words) - len(rest), hashlib.sha256(b" ".join(rest)).hexdigest(), [{"start": s, "end": e} for s, e in merged]))
        columns = zip(*out, strict=True) if out else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])


#: Null ids come after all others.
_LAST = (1 << 63) - 1


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and the removed spans of words.

    Words are what stands between blanks and control blanks, compared byte by byte. A word is removed if WINDOW words in a row that
    cover it also occur in a document with a smaller id; judged on the input. Rows of one id are not earlier than each other, and
    rows without an id come after all others and count as one id (with 2**63 - 1). Null and empty texts, and texts of
    fewer than WINDOW words, lose nothing. An empty table gives an empty table. Other columns are ignored.

    Stretches are shuffled once, as five numbers, by anchor; those of frequent anchors (see SAMPLED) are dealt out by row too. Only
    the distinct stretches of anchors that have several kinds travel with their words, and texts travel compressed: once to
    have these cut out, once to meet their spans. Wherever rows meet by stretch, window or row, the hot ones among these are
    looked up in place (hot_join). Texts are known by 64 bits with a second hash beside them; should two different
    ones share the first, all is done again under another seed. Words, stretches and windows are told by 64-bit hashes, windows of
    large anchors by two of them.
    """
    data = F.encode(whole(text_col), "utf-8")
    return _all(docs.select(F.col(id_col).cast("long").alias("doc_id"), data.alias("data")))


def _all(rows: DataFrame, seed: int = 0) -> DataFrame:
    spark = rows.sparkSession
    bounded_batches(spark)
    since, n = made_so_far(), partitions(spark)
    doc = F.coalesce("doc_id", F.lit(_LAST)).alias("doc")
    key = lambda *c: F.xxhash64(F.lit(seed), *c)
    keyed = rows.select("doc_id", doc, key("data").alias("text"), key("data", "doc_id", F.col("doc_id").isNull()).alias("row"), "data")
    known = keyed.select("row", "doc", "text", F.xxhash64(F.lit(seed + 1), "data", F.col("text")).alias("check"))
    texts = stored(known.groupBy("row").agg(F.first("doc").alias("doc"), F.first("text").alias("text"), F.min("check").alias("check"), F.max("check").alias("other"), F.count("*").alias("n")), "rows")
    copies = stored(texts.groupBy("text").agg(F.min("doc").alias("least"), (F.min("check") != F.max("other")).alias("clash"), F.count("*").alias("n_rows")), "copies")
    if not copies.where("clash").isEmpty():
        sweep(spark, since)
        return _all(rows, seed + 2)
    columns = "row long, doc long, at long, anchor long, body long"
    stretch = lambda df: df.select("row", "doc", "text", "data").mapInArrow(_anchored, columns)
    sample = stretch(keyed.where(F.pmod("row", F.lit(SAMPLED)) == 0)).groupBy("anchor").agg(F.count("*").alias("n"))
    sample = stored(sample.where("n > 1"), "sample")
    total = sample.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = sample.where((F.col("n") * HOT_KEYS > total) & (F.col("n") >= 8)).select("anchor", F.lit(True).alias("hot"))
    dealt = stretch(keyed).join(F.broadcast(hot), "anchor", "left").withColumn("salt", F.when(F.col("hot"), F.pmod("row", F.lit(n))).otherwise(F.lit(0)))
    several = F.count("*").over(Window.partitionBy("anchor", "salt"))
    hits = stored(dealt.withColumn("several", several).where("hot OR several > 1").select("row", "doc", "at", "anchor", "body"), "hits")
    # Kinds of stretches, each with its first document; anchors of one kind have no other windows.
    place = F.struct("doc", "row", "at")
    bodies = stored(hits.groupBy("anchor", "body").agg(F.min(place).alias("first"), F.max("doc").alias("last"), F.count("*").alias("n")), "bodies")
    windows = F.col("first.at").bitwiseAND(F.lit(255))
    per_anchor = bodies.groupBy("anchor").agg(F.count("*").alias("kinds"), (F.sum(windows + WINDOW - 1) > BLOCK).alias("large"), F.min("first.doc").alias("low"), F.max("last").alias("high"))
    mixed = stored(per_anchor.where("kinds > 1 AND low < high").select("anchor", "kinds", "large"), "mixed")
    asked = hot_join(bodies, mixed, "anchor", "kinds", bodies.count()).select(F.col("first.row").alias("row"), F.struct("anchor", "body", F.col("first.doc").alias("doc"), F.col("first.at").alias("at"), "large").alias("x"))
    per_row = asked.groupBy("row").agg(F.collect_list("x").alias("asked"))
    packed = keyed.select("row", "doc_id", "data").mapInArrow(_packed, "row long, doc_id long, size long, packed binary")
    one = hot_join(packed, stored(texts.select("row", "n").join(per_row, "row"), "asked"), "row", "n", max(1, texts.agg(F.sum("n")).first()[0] or 0))
    cut = stored(one.select("size", "packed", "asked").mapInArrow(_cut, "anchor long, body long, doc long, at long, words binary, window long, check long"), "cut")
    small = cut.where("window IS NULL").select("anchor", "body", "doc", "words").repartition(4 * n, "anchor").sortWithinPartitions("anchor", "doc")
    found = small.mapInArrow(_searched, "anchor long, body long, a long")
    # Windows of large anchors meet by their hashes.
    each = cut.where("window IS NOT NULL").select("anchor", "body", "doc", F.col("at").alias("a"), "window", "check")
    met = each.groupBy("window", "check").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("n")).where("low < high")
    across = hot_join(each, stored(met.select("window", "check", "low", "n"), "met"), ["window", "check"], "n", each.count()).where("doc > low").select("anchor", "body", "a")
    spans = found.unionByName(across).groupBy("anchor", "body").agg(F.collect_set("a").alias("starts"))
    judged = bodies.select("anchor", "body", F.col("first.doc").alias("earliest"), "last", "n").join(spans, ["anchor", "body"], "left").where("earliest < last OR starts IS NOT NULL")
    placed = hot_join(hits, stored(judged, "judged"), ["anchor", "body"], "n", hits.count())
    start, count = F.shiftright("at", 8), F.col("at").bitwiseAND(F.lit(255))
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    own = F.when(F.col("doc") > F.col("earliest"), F.array(span(start, start + count + WINDOW - 1))).otherwise(F.transform(F.coalesce("starts", F.array().cast("array<long>")), lambda a: span(start + a, start + a + WINDOW)))
    per_row = placed.select("row", F.explode(own).alias("span")).groupBy("row").agg(F.collect_set("span").alias("spans"))
    again = hot_join(texts.select("row", "doc", "text", "n"), copies.select("text", "least", "n_rows"), "text", "n_rows", max(1, texts.count()))
    info = stored(again.select("row", "n", (F.col("doc") > F.col("least")).alias("again")).join(per_row, "row", "left"), "spans")
    sweep(spark, since, info)
    return hot_join(packed, info, "row", "n", max(1, info.agg(F.sum("n")).first()[0] or 0)).select("doc_id", "size", "packed", "again", "spans").mapInArrow(_kept, OUT)
