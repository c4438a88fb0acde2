"""Shared plumbing: the shared folder, cut lineage, bounded Arrow batches, tokenizers and hashing kernels."""

from __future__ import annotations

import itertools
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


#: Rows and megabytes of an Arrow batch at most, the same for all operators: the setting is read when a frame is run, not when it is made.
BATCH_ROWS, BATCH_MB = 1000, 4
_SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_MB << 20}
_before: dict[str, str] = {}


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded size in this session, so that long texts don't fill a worker. Smaller settings stay; cleanup() sets larger ones back."""
    for name, most in _SETTINGS.items():
        now = spark.conf.get(name)
        size = int(re.sub(r"\D", "", now)) << {"k": 10, "m": 20, "g": 30}.get(now.rstrip("bB").lower()[-1:], 0)
        if now.startswith("-") or not 0 < size <= most:
            _before.setdefault(name, now)
            spark.conf.set(name, str(most))


def give_back() -> None:
    """Memory that a task has freed goes back to the system, so that it doesn't add to the peak of what the worker does next."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def portions(batches: Iterator, rows: int, mb: int) -> Iterator:
    """The batches in parts of at most so many rows and, down to single rows, megabytes; what they took is given back behind the last."""
    for batch in batches:
        left = [batch]
        while left:
            part = left.pop()
            if part.num_rows > 1 and (part.num_rows > rows or part.nbytes > mb << 20):
                middle = part.num_rows // 2
                left += [part.slice(middle), part.slice(0, middle)]
            else:
                yield part
    give_back()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or an own one where that is unset (local tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="inkledger-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Paths made, in order, each with its number and the thread that made it.
_made: dict[str, tuple[int, int]] = {}
_count = itertools.count()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; cleanup() deletes what was put there."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = next(_count), threading.get_ident()
    return path


def cleanup(spark: SparkSession) -> None:
    """Deletes all tables and shards of this process in the shared folder and sets its Arrow settings back. Results that read them must be
    written before."""
    while _made:
        _delete(spark, _made.popitem()[0])
    while _before:
        spark.conf.set(*_before.popitem())


def made_so_far() -> int:
    """A mark in the order in which tables are put into the shared folder; see sweep()."""
    return next(_count)


def sweep(spark: SparkSession, since: int, *kept: DataFrame) -> None:
    """Deletes the tables that this thread made since the mark, but for those kept, which results not yet written still read."""
    stay = {table._stored_at for table in kept}
    for path, (number, thread) in list(_made.items()):
        if number > since and thread == threading.get_ident() and path not in stay:
            del _made[path]
            _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and lost executors lose nothing of it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def dropped(df: DataFrame) -> None:
    """Deletes a table made by stored(), once nothing reads it any more."""
    _delete(df.sparkSession, df._stored_at)
    _made.pop(df._stored_at, None)


#: Keys that are broadcast to where their rows are, at most.
HOT_KEYS = 2000


def hot_join(rows: DataFrame, table: DataFrame, key: str | list[str], count: str, total: int, most: int = HOT_KEYS) -> DataFrame:
    """rows with the columns of table by key, rows without one left out. table has a row per key, and in `count` at least how many
    of `total` rows have it.

    Of keys with more than total / most rows there are fewer than `most`, whatever the data: those are broadcast
    and their rows stay where they are. All others meet by a shuffle, in which no key is large.
    """
    keys = [key] if isinstance(key, str) else key
    often = F.col(count) * most > total
    hot, rest = table.where(often), table.where(~often)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest.hint("merge"), keys)
    return cold.unionByName(rows.join(F.broadcast(hot), keys))


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def whole(text: str = "text"):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=U)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=U)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all bits."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(29))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(32))


def prefix_sums(units: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes modulo 2**64 of a byte or code point array, with the empty prefix."""
    out = np.zeros(len(units) + 1, dtype=U)
    np.cumsum((units.astype(U) + U(1)) * powers(len(units)), dtype=U, out=out[1:])
    return out


def spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hashes of the spans [start, end) under the prefix hashes, mixed with their lengths."""
    inverse = powers(len(prefix), BASE_INVERSE)
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


_tokenizers: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Encodes texts by a tokenizer file; a blank-separated word is encoded once while it is remembered.

    Exact for tokenizers whose pre-tokenizer drops white space: no token then crosses a blank or a line feed. Words of at
    most 64 characters are remembered in two generations of at most max_words: when the young one is full it becomes the old
    one, and old words that are met again are young again, so frequent words stay. A word also ends between a letter a-z and
    a mark that the pre-tokenizer takes from it, so that a word before a comma is the word that it is elsewhere.
    """

    #: Marks that may end a word.
    ENDS = ",.!?;:&%"

    #: Stands between words that are encoded in one go; words that hold it are encoded alone.
    MARK = "\x01"

    def __init__(self, path: str, max_words: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.max_words = max_words
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        # No added token is cut, as none holds such a mark.
        added = "".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        ends = "".join(c for c in self.ENDS if c not in added and self._apart(c))
        self.cut = f"([A-Za-z])([{re.escape(ends)}])" if ends else None

    def _apart(self, mark: str) -> bool:
        """Whether the pre-tokenizer takes a mark from the letters before it, in a run of marks too."""
        cuts = self.tokenizer.pre_tokenizer
        pieces = lambda text: [at for _, at in cuts.pre_tokenize_str(text)]
        return cuts is not None and all(any(at[0] == 2 for at in pieces(f"ab{rest}")) for rest in (mark, mark + "c", mark + mark, mark + "'", mark + "1"))

    @staticmethod
    def of(path: str) -> "WordEncoder":
        if path not in _tokenizers:
            _tokenizers[path] = WordEncoder(path)
        return _tokenizers[path]

    def _encoded(self, words: list[str]) -> dict[str, bytes]:
        plain = [w for w in words if self.MARK not in w] if self.mark is not None else []
        out = {}
        for at in range(0, len(plain), 20_000):
            groups = [plain[k : k + 200] for k in range(at, min(at + 20_000, len(plain)), 200)]
            for group, e in zip(groups, self.tokenizer.encode_batch_fast([f" {self.MARK} ".join(g) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, dtype=self.kind)
                ends = np.append(np.flatnonzero(ids == self.mark), len(ids)).tolist()
                if len(ends) != len(group):
                    continue
                low = 0
                for w, high in zip(group, ends, strict=True):
                    out[w] = ids[low:high].tobytes()
                    low = high + 1
        for w in words:
            if w not in out:
                out[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype=self.kind).tobytes()
        return out

    def encode(self, texts, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in a row, and the bounds of each text in them (one more than texts)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pa.array(texts, pa.large_string()) if not isinstance(texts, pa.Array) else texts.cast(pa.large_string())
        if self.cut:
            texts = pc.replace_substring_regex(texts, self.cut, r"\1 \2")
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        bounds = np.asarray(words.offsets, dtype=np.int64) if len(texts) else np.zeros(1, dtype=np.int64)
        coded = words.values[bounds[0] : bounds[-1]].dictionary_encode() if len(texts) else pa.array([], pa.large_string()).dictionary_encode()
        bounds = bounds - bounds[0]
        vocabulary = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        young, old = self.young, self.old
        ids = [young.get(w) for w in vocabulary]
        absent = [k for k, e in enumerate(ids) if e is None]
        new = []
        for k in absent:
            w = vocabulary[k]
            e = old.get(w)
            if e is None:
                new.append(k)
            else:
                ids[k] = young[w] = e
        own = self._encoded([vocabulary[k] for k in new])
        for k in new:
            w = vocabulary[k]
            ids[k] = own[w]
            if len(w) <= 64:
                young[w] = own[w]
        if len(young) > self.max_words:
            self.old, self.young = young, {}
        width = np.dtype(self.kind).itemsize
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // width
        flat = np.frombuffer(b"".join(ids), dtype=self.kind)
        starts = np.cumsum(sizes) - sizes
        index = np.asarray(coded.indices, dtype=np.int64)
        per_word = sizes[index]
        at = np.zeros(len(index) + 1, dtype=np.int64)
        np.cumsum(per_word, out=at[1:])
        out = flat[np.repeat(starts[index] - at[:-1], per_word) + np.arange(at[-1])].astype(np.uint32)
        ends = at[bounds]
        if end_id is None:
            return out, ends
        return np.insert(out, ends[1:], end_id).astype(np.uint32), ends + np.arange(len(ends))
