"""Alignment of two tokenizers over the same bytes, by higher-order functions over their token ends.

Tokenising is the only Python: it returns token ids and the byte offsets where they end, of the distinct units of text in a batch. Ends of both tokenizers, tagged and
numbered, are sorted into one array; a token's place in it less its own number is how many tokens of the other tokenizer end before. So
every end names the two tokens over the bytes before it, which is a link, and ends that both have cut the tokens into groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, hot_join, made_so_far, portions, stored, sweep, whole

#: Pairs of ids that are broadcast with their counts; with more, the most frequent are, fewer than FREQUENT, and the rest is joined by pair.
MOST_PAIRS, FREQUENT = 500_000, 100_000
#: Units remembered by a worker in each of two generations, and those of them that are encoded in one go.
UNITS, GROUP = 80_000, 256
#: Documents and megabytes of text, down to single documents, whose units are listed together.
PORTION = 2000, 6
_NUMBERS = T.ArrayType(T.IntegerType(), False)
_UNIT = T.StructType([T.StructField(c, _NUMBERS, False) for c in ("a_ids", "a_ends", "b_ids", "b_ends")])
_DOC = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType(), False) for c in ("n_a", "n_b")), T.StructField("units", _NUMBERS, False)])
TOKENS = T.StructType([T.StructField("units", T.ArrayType(_UNIT, False), False), T.StructField("docs", T.ArrayType(_DOC, False), False)])
#: Bytes before and after a space at which a unit may begin.
_BEFORE, _AFTER = np.zeros((2, 256), dtype=bool)
_BEFORE[[b for b in range(0x21, 256) if b not in (0x7F, 0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF) and not 0x80 <= b <= 0x8A]] = True
_AFTER[[b for b in range(0x21, 256) if b not in (0x7F, 0xC2, 0xE1, 0xE2, 0xE3)]] = True
#: Letters, and marks that may follow one in a unit of their own.
MARKS = b",.!?;:&%"
_LETTER, _MARK, _PLAIN = np.zeros((3, 256), dtype=bool)
_LETTER[[b for b in range(128) if chr(b).isalpha()]] = True
_MARK[list(MARKS)] = True
_PLAIN[0x21:0x7F] = True


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies; printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoders:
    """Both tokenizers over units of text.

    A unit begins at the text's start or at a lone space between two characters that are no blanks. The byte-level tokenizer cuts there
    before it merges, and no piece of the other one has its blank sign after another character, so a unit is encoded alike
    wherever it stands: once, while it is remembered. Where no piece of the other one has these, a unit also begins at a mark behind a letter, at a line feed
    behind a visible character, and at a letter behind such a line feed.
    """

    def __init__(self, a_path: str, b_path: str):
        import os

        import pyarrow as pa
        import sentencepiece

        # Tasks are the threads here.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        vocabulary = {i: t for t, i in self.a.get_vocab().items()}
        self.size_a, self.size_b = max(vocabulary) + 1, self.b.get_piece_size()
        a_bytes = [bytes(letters[c] for c in vocabulary.get(i, "") if c in letters) for i in range(self.size_a)]
        names = [self.b.id_to_piece(i) for i in range(self.size_b)]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.apart = not any("▁" in p.lstrip("▁") for p in names)
        marks = MARKS.decode()
        whole = [p for i, p in enumerate(names) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.finer = self.apart and not any("\n" in p or any(x.isascii() and x.isalpha() and y in marks for x, y in zip(p, p[1:], strict=False)) for p in whole)
        self.pieces = [pa.array(x, pa.binary()) for x in (a_bytes, b_bytes)]
        self.sizes = [np.array([len(x) for x in y], dtype=np.int64) for y in (a_bytes, b_bytes)]
        self.young: dict[bytes, tuple[bytes, bytes | None]] = {}
        self.old: dict[bytes, tuple[bytes, bytes | None]] = {}

    def _ids(self, which: int, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that begin with a space; the second tokenizer adds it by itself."""
        if which:
            return [np.array(x, dtype=np.int32) for x in self.b.encode([t[1:] for t in texts], num_threads=1)]
        return [np.array(e.ids, dtype=np.int32) for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, which: int, ids: np.ndarray) -> bytes:
        got = self.pieces[which].take(ids)
        if not len(got):
            return b""
        ends = np.frombuffer(got.buffers()[1], dtype=np.int32, count=len(got) + 1, offset=4 * got.offset)
        return got.buffers()[2].to_pybytes()[ends[0] : ends[-1]]

    @staticmethod
    def _lead(unit: bytes) -> bytes:
        """What a unit without a space at its start is encoded behind."""
        return b"" if unit[:1] == b" " else b" a\n" if unit[:1].isalpha() else b" a"

    def encoded(self, units: list[bytes]) -> list[tuple[bytes, bytes | None]]:
        """Ids of units by both tokenizers, as bytes; none by the second where its pieces don't give the unit back."""
        size = GROUP if self.apart else 1
        groups = [units[k : k + size] for k in range(0, len(units), size)]
        leads = [list(map(self._lead, g)) for g in groups]
        joined = [b"".join(x for pair in zip(lead, g, strict=True) for x in pair) for lead, g in zip(leads, groups, strict=True)]
        texts = [x.decode() for x in joined]
        # Where each unit begins and ends.
        cuts = []
        for lead, g in zip(leads, groups, strict=True):
            sizes = np.array([[len(x), len(u)] for x, u in zip(lead, g, strict=True)], dtype=np.int64)
            ends = np.cumsum(sizes).reshape(-1, 2)
            cuts.append((ends[:, 0], ends[:, 1]))
        found: list[list[bytes | None]] = [[], []]
        for which, out in enumerate(found):
            for group, lead, data, cut, ids in zip(groups, leads, joined, cuts, self._ids(which, texts), strict=True):
                got = self._between(which, ids, data, *cut)
                if got is None:
                    got = []
                    behind = [x + u for x, u in zip(lead, group, strict=True)]
                    for x, whole, each in zip(lead, behind, self._ids(which, [w.decode() for w in behind]), strict=True):
                        got += self._between(which, each, whole, np.array([len(x)]), np.array([len(whole)])) or [None]
                out += got
        return list(zip(*found, strict=True))

    def _between(self, which: int, ids: np.ndarray, data: bytes, starts: np.ndarray, stops: np.ndarray) -> list[bytes] | None:
        """The ids of each stretch of data; none if they don't give data back or a stretch is not one of whole tokens."""
        ends = np.concatenate(([0], np.cumsum(self.sizes[which][ids])))
        low, high = np.searchsorted(ends, starts), np.searchsorted(ends, stops)
        if ends[-1] != len(data) or (ends[low] != starts).any() or (ends[high] != stops).any() or self._joined(which, ids) != data:
            return None
        blob = ids.tobytes()
        return [blob[x:y] for x, y in zip((4 * low).tolist(), (4 * high).tolist(), strict=True)]

    def units(self, texts: list[bytes]) -> tuple[list[tuple[bytes, bytes | None]], np.ndarray, np.ndarray]:
        """Ids of the distinct units of all texts, the numbers of each text's units in a row, and the bounds of each text in them; none
        of a text that is empty or not given back."""
        import pyarrow as pa

        data = np.frombuffer(b"".join(b" " + t for t in texts), dtype=np.uint8)
        first = np.cumsum([0] + [len(t) + 1 for t in texts])
        cut = np.zeros(len(data) + 1, dtype=bool)
        if self.apart and len(data) > 2:
            # Letters of two bytes and more may be blanks by their first and last bytes here; the units are longer then.
            cut[1:-2] = (data[1:-1] == 0x20) & _BEFORE[data[:-2]] & _AFTER[data[2:]]
        if self.finer and len(data) > 2:
            feed = (data[1:] == 0x0A) & _PLAIN[data[:-1]]
            cut[1:-1] |= feed | (_LETTER[data[:-1]] & _MARK[data[1:]])
            cut[2:-1] |= feed[:-1] & _LETTER[data[2:]]
        cut[first] = True
        bounds = np.flatnonzero(cut)
        array = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
        coded = array.dictionary_encode()
        units, index = coded.dictionary.to_pylist(), np.asarray(coded.indices, dtype=np.int64)
        young, old = self.young, self.old
        known = [young.get(u) or old.get(u) for u in units]
        new = [u for u, got in zip(units, known, strict=True) if got is None]
        fresh = dict(zip(new, self.encoded(new), strict=True))
        for k, u in enumerate(units):
            if known[k] is None:
                known[k] = fresh[u]
            if len(u) <= 64:
                young[u] = known[k]
        if len(young) > UNITS:
            self.old, self.young = young, {}
        in_text = np.searchsorted(bounds, first)
        bad = np.array([a is None or b is None for a, b in known], dtype=np.int64)[index]
        sums = np.concatenate(([0], np.cumsum(bad)))
        sound = (sums[in_text[1:]] == sums[in_text[:-1]]) & (np.diff(first) > 1)
        count = np.where(sound, np.diff(in_text), 0)
        return known, index[np.repeat(sound, np.diff(in_text))], np.concatenate(([0], np.cumsum(count)))


_encoders: dict[tuple[str, str], Encoders] = {}


def encoders(a_path: str, b_path: str) -> Encoders:
    if (a_path, b_path) not in _encoders:
        _encoders[a_path, b_path] = Encoders(a_path, b_path)
    return _encoders[a_path, b_path]


def tokenised(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(units, docs): a row for each batch of documents, with the tokens of its distinct units, and of each document how many tokens it has and the numbers of its units.

    Tokens are those of a space and the text; their ends are byte offsets within the unit.
    """
    bounded_batches(docs.sparkSession)

    def found(batches: Iterator) -> Iterator:
        import pyarrow as pa

        both = encoders(a_path, b_path)
        kind = lambda field: pa.list_(pa.field("element", pa.int32(), False)) if isinstance(field.dataType, T.ArrayType) else pa.int64()
        fields = [[pa.field(f.name, kind(f), f.nullable) for f in column.dataType.elementType] for column in TOKENS]
        for batch in portions(batches, *PORTION):
            known, index, bounds = both.units(batch.column(1).to_pylist())
            lists, counts = [], []
            for which in (0, 1):
                blobs = [x[which] or b"" for x in known]
                ids = np.frombuffer(b"".join(blobs), dtype=np.int32)
                at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs)) // 4)))
                ends = np.cumsum(both.sizes[which][ids])
                before = np.concatenate(([0], ends))[at[:-1]]
                lists += [(at, ids), (at, ends - np.repeat(before, np.diff(at)))]
                sums = np.concatenate(([0], np.cumsum(np.diff(at)[index])))
                counts.append(pa.array(sums[bounds[1:]] - sums[bounds[:-1]], pa.int64()))
            listed = lambda at, values: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.astype(np.int32)), type=kind(TOKENS["units"].dataType.elementType["a_ids"]))
            structs = [pa.StructArray.from_arrays([listed(*x) for x in lists], fields=fields[0]), pa.StructArray.from_arrays([batch.column(0), *counts, listed(bounds, index)], fields=fields[1])]
            columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x, type=pa.list_(pa.field("element", x.type, False))) for x in structs]
            yield pa.RecordBatch.from_arrays(columns, names=TOKENS.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(whole(text_col), "utf-8").alias("data")).mapInArrow(found, TOKENS)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, whatever the lambdas in it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_B = 1 << 31


def _end(x: Column) -> Column:
    return F.shiftright(x, 32)


def _number(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_B - 1)).cast("int")


def _second(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_B)) != 0


def _merged(unit: Column) -> Column:
    """All ends of both tokenizers in order, the first's before an equal one of the second: end, tag and number in one long."""
    first = F.transform(unit["a_ends"], lambda e, i: F.shiftleft(e.cast("long"), 32).bitwiseOR(i.cast("long")))
    second = F.transform(unit["b_ends"], lambda e, i: F.shiftleft(e.cast("long"), 32).bitwiseOR(i.cast("long") + F.lit(_B)))
    return F.sort_array(F.concat(first, second))


def _alone(ends: Column, m: Column) -> Column:
    """Whether the end at m, which is the second tokenizer's, is none of the first's, which would be the one before it."""
    return F.coalesce(_end(F.get(ends, m)) != _end(F.get(ends, m - 1)), F.lit(True))


def _links(unit: Column, ends: Column, size_b: int, kind: str) -> Column:
    """The pair of ids over the bytes before each distinct end, as a_id * size_b + b_id."""
    id_of = lambda a, b: F.get(unit["a_ids"], a).cast(kind) * F.lit(size_b).cast(kind) + F.get(unit["b_ids"], b).cast(kind)

    def pair(x: Column, m: Column) -> Column:
        other = m - _number(x)
        return F.when(~_second(x), id_of(_number(x), other)).when(_alone(ends, m), id_of(other, _number(x)))

    return F.array_compact(F.transform(ends, pair))


def _groups(unit: Column, ends: Column, shared: Column) -> Column:
    """The groups as a string: ids of the first tokenizer, a bar, those of the second. shared: where in ends those are that both have."""

    def parts(name: str, highs: Column) -> Column:
        """The ids of each group; highs: behind its last token."""
        ids = unit[name].cast("array<string>")

        def part(high: Column, k: Column, ids: Column, highs: Column) -> Column:
            size = high - F.coalesce(F.get(highs, k - 1), F.lit(0))
            return F.when(size == 1, F.get(ids, high - 1)).otherwise(F.array_join(F.slice(ids, high - size + 1, size), ","))

        return _let(ids, lambda i: _let(highs, lambda h: F.transform(h, lambda high, k: part(high, k, i, h))))

    a = parts("a_ids", F.transform(shared, lambda m: m - _number(F.get(ends, m))))
    b = parts("b_ids", F.transform(shared, lambda m: _number(F.get(ends, m)) + 1))
    return F.array_join(F.zip_with(a, b, lambda x, y: F.concat(x, F.lit("|"), y)), ";")


def aligned(tokens: DataFrame, size_b: int, kind: str = "long") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256 and links, from tokens as tokenised() returns them. JVM functions only.

    Both tokenizers end at a unit's end, so groups and links are built once for each distinct unit of a batch and put together for its documents.
    Each step is a column of its own: what a lambda holds is made of objects and copied whole by every function around it, a column's values are plain memory.
    """
    # Units of texts that aren't given back may lack tokens; no document has them. In most others every token of one tokenizer is one of the other.
    alike = lambda unit: (F.size(unit["a_ids"]) == 0) | (F.size(unit["b_ids"]) == 0) | (unit["a_ends"] == unit["b_ends"])
    ends = tokens.select("docs", "units", F.transform("units", lambda unit: F.when(~alike(unit), _merged(unit))).alias("ends"))

    def groups(unit: Column, k: Column) -> Column:
        each = F.array_join(F.zip_with(unit["a_ids"], unit["b_ids"], lambda a, b: F.concat(a.cast("string"), F.lit("|"), b.cast("string"))), ";")
        places = lambda e: F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda m: _second(F.get(e, m)) & ~_alone(e, m))
        return F.when(F.get("ends", k).isNull(), each).otherwise(_let(F.get("ends", k), lambda e: _let(places(e), lambda shared: _groups(unit, e, shared))))

    def links(unit: Column, k: Column) -> Column:
        each = F.zip_with(unit["a_ids"], unit["b_ids"], lambda a, b: a.cast(kind) * F.lit(size_b).cast(kind) + b.cast(kind))
        return F.when(F.get("ends", k).isNull(), each).otherwise(_let(F.get("ends", k), lambda e: _links(unit, e, size_b, kind)))

    of = lambda doc, c: F.transform(doc["units"], lambda i: F.get(c, i)).alias(c)
    document = lambda doc: F.struct(*(doc[c].alias(c) for c in ("doc_id", "n_a", "n_b")), of(doc, "groups"), of(doc, "links"))
    each = ends.select("docs", F.transform("units", groups).alias("groups"), F.transform("units", links).alias("links"))
    rows = each.select(F.inline(F.transform("docs", document))).withColumn("links", F.flatten("links"))
    # Every end that either has ends a link, and those that both have a group too.
    n_groups = (F.col("n_a") + F.col("n_b") - F.size("links")).alias("n_groups")
    digest = F.when(F.size("groups") > 0, F.sha2(F.array_join("groups", ";"), 256)).otherwise(F.lit("")).alias("groups_sha256")
    return rows.select("doc_id", "n_a", "n_b", n_groups, digest, "links")


def cross_aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link is a pair of tokens, one of each tokenizer, whose byte ranges overlap; the count of a pair of ids is how many links
    of all documents have it. n_best: links whose count is the highest of their second id; count_sum: counts summed over links.
    Special tokens' strings are plain text. Null and empty texts, and texts that the tokens don't give back byte by byte, have no
    tokens: zeros, and '' for the digest. Null ids and repeated rows are documents of their own. An empty table
    gives an empty table. Other columns are ignored.

    Links are stored once; their counts are summed before they are shuffled. The counts are broadcast up to MOST_PAIRS; beyond, those of
    pairs with more than a FREQUENT-th of all links are, and rarer ones meet by a shuffle in which no pair is large.
    """
    spark = docs.sparkSession
    since = made_so_far()
    both = encoders(a_path, b_path)
    size_b = both.size_b
    kind = "int" if both.size_a * size_b < 1 << 31 else "long"
    rows = stored(aligned(tokenised(docs, a_path, b_path, id_col, text_col), size_b, kind).withColumn("row", F.monotonically_increasing_id()), "aligned")
    links = rows.select("row", F.explode("links").alias("pair"))
    counts = stored(links.groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    n_pairs, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # One row an id of the second vocabulary.
    best = counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n").alias("most"))
    known = stored(counts.join(F.broadcast(best), F.col("pair") % size_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("top")), "counts")
    if n_pairs <= MOST_PAIRS:
        met = links.join(F.broadcast(known), "pair")
    else:
        each = links.groupBy("row", "pair").agg(F.count("*").alias("times"))
        met = hot_join(each.select("row", "pair", "times"), known, "pair", "n", total, FREQUENT)
    times = F.col("times") if n_pairs > MOST_PAIRS else F.lit(1)
    sums = stored(met.groupBy("row").agg(F.sum(F.col("top") * times).alias("n_best"), F.sum(F.col("n") * times).alias("count_sum")), "sums")
    sweep(spark, since, rows, sums)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    n_links = (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links")
    return rows.drop("links").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", n_links, zero("n_best"), zero("count_sum"), "groups_sha256")
