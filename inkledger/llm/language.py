"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds every substring of a bounded sample of its labelled text. A text
is parsed greedily against each automaton: a phrase runs as long as the automaton can follow, so phrases
are longest matches. The language whose automaton needs the fewest phrases, normalised by the size of
its sample, wins: a phrase counts the bits that name its place in the sample and the symbol after it, and a text starts
with the bits by which the language's sample is short of the largest one, so that a language of a few labelled words
wins no text by being cheap.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, whole

UNDETERMINED = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, n_letters long, phrases long"
#: Bounds of the labelled sample: rows per language that are drawn on average, characters per language.
MAX_DOCS, MAX_CHARS = 120, 20_000
#: Bound of the tables of all automata together, in states: beyond MAX_STATES / (2 * MAX_CHARS) languages, each one's sample is smaller.
MAX_STATES = 1_000_000
#: Labels beyond this many are refused by name, not left out: a column of that many values holds no languages.
MAX_LANGS = 4096
#: A sample shorter than this counts as one of this size: what a short one lacks tells nothing.
LEAST_SAMPLE = 1024
SEGMENT = 256
#: Columns of an automaton's table: the blank, its language's most frequent letters, and one for letters the language hasn't; moves
#: by its other letters are kept as pairs.
SYMBOLS = 64
SPACE = 0


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text modulo 4 is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """At most MAX_CHARS characters of text per language, of every language, from rows with a label that are not held out.

    Rows are drawn by a hash of id and text, so the sample is the same on every run, and taken whole as long as they fit
    the budget; where no drawn row of a language fits it, its shortest one is cut to it. Texts are read only of the rows
    taken, so the driver holds no more than the budget of each language.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    counts = known.groupBy(F.col(lang_col).cast("string").alias("lang")).count().limit(MAX_LANGS + 1).collect()
    if not counts:
        return {}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"too_many_labels: more than {MAX_LANGS}")
    budget = min(MAX_CHARS, MAX_STATES // (2 * len(counts)))
    scale = 1 << 30
    # On average MAX_DOCS rows of each language; all of a language that has no more than 4 * MAX_DOCS.
    limits = {r["lang"]: math.ceil(scale * MAX_DOCS / r["count"]) for r in counts if r["count"] > 4 * MAX_DOCS}
    drawn = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(scale))
    lang = F.col(lang_col).cast("string")
    if limits:
        limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[lang]
        known = known.where(drawn < F.coalesce(limit, F.lit(scale)))
    rows = known.select(lang.alias("lang"), drawn.alias("drawn"), F.length(text_col).alias("size"), F.col(text_col).alias("text"))
    of_lang = Window.partitionBy("lang").orderBy(F.greatest("size", F.lit(budget)), "drawn", "text")
    so_far = F.sum(F.col("size") + 1).over(of_lang.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    taken = rows.withColumn("end", so_far).withColumn("at", F.row_number().over(of_lang)).where(f"at = 1 OR end <= {budget + 1}")
    sample: dict[str, list[str]] = {}
    for r in taken.select("lang", "at", F.substring("text", 1, budget).alias("text")).orderBy("lang", "at").collect():
        sample.setdefault(r["lang"], []).append(r["text"])
    return {lang: "\n".join(texts) for lang, texts in sorted(sample.items())}


class Automaton:
    """Suffix automaton of a symbol sequence.

    Symbols are given columns of its own, the most frequent letters first. moves[state * width + column] is twice the
    next state's row, plus 1 where the phrase had to end before the symbol: the next phrase then begins with it. A letter
    that the sample hasn't is a phrase of its own.
    Letters beyond the table's columns have columns from width on, and their moves are looked up by state and column.
    """

    def __init__(self, symbols: list[int], n_symbols: int):
        goes, link, length, last = [{}], [-1], [0], 0
        for c in symbols:
            now = len(goes)
            goes.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in goes[p]:
                goes[p][c] = now
                p = link[p]
            if p >= 0:
                q = goes[p][c]
                if length[q] == length[p] + 1:
                    link[now] = q
                else:
                    twin = len(goes)
                    goes.append(dict(goes[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and goes[p].get(c) == q:
                        goes[p][c] = twin
                        p = link[p]
                    link[q] = link[now] = twin
            last = now
        self.size = max(2, len(symbols))
        ranked = [SPACE, *(c for c, _ in sorted(Counter(s for s in symbols if s != SPACE).items(), key=lambda x: (-x[1], x[0])))]
        dense = min(len(ranked), SYMBOLS - 1)
        self.width = width = dense + 1
        self.column = np.full(n_symbols, dense, dtype=np.min_scalar_type(n_symbols + width))
        column = {}
        for k, c in enumerate(ranked):
            column[c] = self.column[c] = k if k < dense else k + 1
        # One more state: behind a letter that the sample hasn't, where every symbol begins a phrase.
        behind = len(goes)
        table = np.zeros((behind + 1, width), dtype=np.int64)
        root = np.zeros(len(ranked) + 1, dtype=np.int64)
        for c, to in goes[0].items():
            root[column[c]] = to * width * 2 + 1
        root[root == 0] = 1
        root[dense] = behind * width * 2 + 1
        table[:] = root[:width]
        table[0, dense] -= 1
        keys, values = [], []
        self.span = len(ranked) + 1
        for state, out in enumerate(goes):
            for c, to in out.items():
                if column[c] < width:
                    table[state, column[c]] = to * width * 2
                else:
                    keys.append(state * self.span + column[c])
                    values.append(to * width * 2)
        self.moves = table.astype(np.int32).ravel()
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys, self.values, self.root = np.array(keys, dtype=np.int64)[order], np.array(values, dtype=np.int32)[order], root.astype(np.int32)

    def _rare(self, state: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Moves by columns beyond the table."""
        key = state // self.width * self.span + columns
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], self.root[columns])

    def phrases(self, symbols: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Phrases of each segment; symbols[t] holds the t-th symbol of all segments, longest first, active[t] of which go on."""
        state = np.zeros(symbols.shape[1], dtype=np.int64)
        ended = np.zeros(symbols.shape[1], dtype=np.int64)
        for t in range(symbols.shape[0]):
            n = active[t]
            column = self.column[symbols[t, :n]]
            if len(self.keys):
                got = self.moves[state[:n] + np.minimum(column, self.width - 1)]
                rare = np.flatnonzero(column >= self.width)
                got[rare] = self._rare(state[rare], column[rare].astype(np.int64))
            else:
                got = self.moves[state[:n] + column]
            ended[:n] += got & 1
            state[:n] = got >> 1
        return ended + 1


class Model:
    """The automata of all languages and the symbols they share: every letter of the sample has one."""

    def __init__(self, sample: dict[str, str]):
        letters = Counter(c for text in sample.values() for c in text.lower() if c.isalpha())
        self.n_symbols = len(letters) + 2
        strange = self.n_symbols - 1
        self.table = np.full(0x110000, SPACE, dtype=np.min_scalar_type(self.n_symbols))
        self.table[[i for i in range(0x110000) if chr(i).isalpha()]] = strange
        for k, (c, _) in enumerate(sorted(letters.items(), key=lambda x: (-x[1], x[0]))):
            self.table[ord(c)] = k + 1
        self.langs = list(sample)
        self.automata = []
        self.literal = math.log2(max(2, self.n_symbols))
        for text in sample.values():
            symbols, _, _ = self.symbols([text])
            self.automata.append(Automaton(symbols.tolist(), self.n_symbols))

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts in a row (a run of other characters is one SPACE), symbols and letters per text."""
        lowered = [t.lower() for t in texts]
        sizes = np.fromiter((len(t) for t in lowered), dtype=np.int64, count=len(lowered))
        codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        got = self.table[codes]
        own = np.repeat(np.arange(len(texts)), sizes)
        letters = np.bincount(own[got != SPACE], minlength=len(texts))
        keep = np.ones(len(got), dtype=bool)
        keep[1:] = (got[1:] != SPACE) | (got[:-1] != SPACE) | (own[1:] != own[:-1])
        return got[keep], np.bincount(own[keep], minlength=len(texts)), letters

    def predict(self, texts: list[str]) -> list[tuple[str, float, int, int]]:
        """(language, score, letters, phrases) of each text."""
        symbols, sizes, letters = self.symbols(texts)
        starts = np.cumsum(sizes) - sizes
        parts = -(-sizes // SEGMENT)
        own = np.repeat(np.arange(len(texts)), parts)
        within = np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = starts[own] + within * SEGMENT
        length = np.minimum(SEGMENT, sizes[own] - within * SEGMENT)
        order = np.argsort(-length, kind="stable")
        begin, length, own = begin[order], length[order], own[order]
        totals = np.zeros((len(self.langs), len(texts)))
        if len(own):
            steps = int(length[0])
            at = np.minimum(begin[None, :] + np.arange(steps)[:, None], len(symbols) - 1)
            columns = symbols[at]
            active = np.searchsorted(-length, -np.arange(steps), side="left")
            for k, automaton in enumerate(self.automata):
                totals[k] = np.bincount(own, weights=automaton.phrases(columns, active), minlength=len(texts))
        out = []
        largest = max((a.size for a in self.automata), default=2)
        weights = np.array([math.log2(max(a.size, LEAST_SAMPLE)) + self.literal for a in self.automata])
        start = np.array([math.log2(largest / a.size) for a in self.automata])
        for i in range(len(texts)):
            if not letters[i] or not self.langs:
                out.append((UNDETERMINED, 0.0, int(letters[i]), 0))
                continue
            cost = totals[:, i] * weights + start
            first = int(np.argmin(cost))
            second = float(np.min(np.delete(cost, first))) if len(cost) > 1 else max(cost[first], sizes[i] * (weights[0] + start[0]))
            out.append((self.langs[first], max(0.0, min(1.0, 1.0 - float(cost[first]) / second)), int(letters[i]), int(totals[first, i])))
        return out


_models: dict[str, Model] = {}


def model_of(sample: dict[str, str]) -> Model:
    """The model of a sample, built once per worker."""
    key = hashlib.sha256(repr(sorted(sample.items())).encode()).hexdigest()
    if key not in _models:
        _models.clear()
        _models[key] = Model(sample)
    return _models[key]


def identified(docs: DataFrame, sample: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The language of every whole text.

    score is 1 - (best cost / second best cost): 0 is a tie. Texts are parsed in segments of SEGMENT symbols,
    so long texts cost no more per character than short ones. Null texts, empty texts and texts without a
    letter are `und` with score 0, and so is everything where nothing can be learned. Null ids are predicted
    and count as not held out, but are not learned from. Repeated rows are predicted alike; other columns
    are ignored. Nothing is shuffled; what is sent to the workers is the sample.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sample = labelled_sample(docs, id_col, text_col, lang_col) if sample is None else sample
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), whole(text_col).alias("text"))

    def predicted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            got = model_of(sample).predict(batch.column(2).to_pylist())
            columns = list(zip(*got, strict=True)) or [[], [], [], []]
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "held_out", "lang_pred", "score", "n_letters", "phrases"],
            )

    return rows.mapInArrow(predicted, SCHEMA)


def with_language(docs: DataFrame) -> DataFrame:
    """docs without those whose text has no language, each with its predicted language in lang.

    Columns and their order stay. Rejected are null texts and texts without a letter; where nothing can be
    learned, no row can be judged and all stay as they are.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sample = labelled_sample(docs)
    if not sample:
        return docs
    names = docs.columns
    text_at, lang_at = names.index("text"), names.index("lang")

    def kept(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            got = model_of(sample).predict([t or "" for t in batch.column(text_at).to_pylist()])
            langs = pa.array([x[0] for x in got], pa.string())
            columns = [langs if i == lang_at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array([x[0] != UNDETERMINED for x in got], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
