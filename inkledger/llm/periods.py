"""Periodic runs of words, by suffix automata whose end-position sets are merged small to large.

Two end positions of one state at a distance of at most the state's length make a square: the state's longest word ends at
both and the two occurrences touch or overlap. Neighbours at such a distance are seeds, each of which is extended to the run
around it. Sets grow only by merging into their suffix link's set, the smaller into the larger, so every position is
moved a logarithmic number of times, and only the neighbours of moved positions are new.

An automaton is built only where a run can lie. A run of LEAST words, three periods at least, holds two thirds of its length as an
occurrence that comes again a period later; so each of its words is covered by windows of WINDOW words that occur elsewhere in it.
Words not so covered are left out, again within each stretch that remains, until nothing changes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, bounded_batches, mix, whole

#: Words of a run at least, and periods in it.
LEAST, TIMES = 24, 3
#: A run longer than LEAST comes again in itself by this many words.
WINDOW = LEAST - LEAST // TIMES
#: Positions that one list of an end-position set spans.
SPAN = 9
OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>"


class Ends:
    """An ordered set of positions: short sorted lists by position range, and the sorted list of ranges in use."""

    __slots__ = ("lists", "ranges", "size")

    def __init__(self, first: int):
        self.lists = {first >> SPAN: [first]}
        self.ranges = [first >> SPAN]
        self.size = 1

    def __iter__(self) -> Iterator[int]:
        for r in self.ranges:
            yield from self.lists[r]

    def before(self, x: int) -> int:
        """The largest position under x, or -1."""
        here = self.lists.get(x >> SPAN)
        if here and here[0] < x:
            return here[bisect_left(here, x) - 1]
        at = bisect_left(self.ranges, x >> SPAN)
        return self.lists[self.ranges[at - 1]][-1] if at else -1

    def after(self, x: int) -> int:
        """The least position over x, or -1."""
        here = self.lists.get(x >> SPAN)
        if here and here[-1] > x:
            return here[bisect_right(here, x)]
        at = bisect_right(self.ranges, x >> SPAN)
        return self.lists[self.ranges[at]][0] if at < len(self.ranges) else -1

    def add(self, x: int) -> None:
        here = self.lists.get(x >> SPAN)
        if here is None:
            self.lists[x >> SPAN] = [x]
            insort(self.ranges, x >> SPAN)
        else:
            insort(here, x)
        self.size += 1


def automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix automaton of a sequence: length, suffix link and own end position (-1 for copied states) of each state."""
    length, link, end = [0], [-1], [-1]
    moves: list[dict[int, int]] = [{}]
    last = 0
    for at, c in enumerate(word):
        new = len(length)
        length.append(at + 1)
        link.append(0)
        end.append(at)
        moves.append({})
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                moves.append(moves[q].copy())
                link[q] = link[new] = copy
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
        last = new
    return length, link, end


def squares(word: list[int]) -> Iterator[tuple[int, int, int]]:
    """(end, distance, length) of neighbouring end positions of a state at a distance of at most its length, each pair where
    it first meets: at the state of its longest common suffix."""
    length, link, end = automaton(word)
    sets: list[Ends | None] = [None] * len(length)
    seeds: dict[int, list[tuple[int, int]]] = {}
    for state in np.argsort(-np.array(length), kind="stable").tolist():
        if not state:
            break
        here = sets[state]
        if end[state] >= 0:
            # Children of a state with an own position are longer, so they have come before.
            here = _merged(here, Ends(end[state]), length[state], seeds.setdefault(state, [])) if here else Ends(end[state])
        # Neighbours when they met, but another set may have come between since.
        for e, d in seeds.pop(state, ()):
            if here.before(e) == e - d:
                yield e, d, length[state]
        sets[state] = None
        up = link[state]
        if up:
            sets[up] = _merged(sets[up], here, length[up], seeds.setdefault(up, [])) if sets[up] else here


def _merged(a: Ends, b: Ends, most: int, seeds: list[tuple[int, int]]) -> Ends:
    if a.size < b.size:
        a, b = b, a
    moved = -1
    for e in b:
        low, high = a.before(e), a.after(e)
        a.add(e)
        # Two that come from one set have met before.
        if low >= 0 and low != moved and e - low <= most:
            seeds.append((e, e - low))
        if high >= 0 and high - e <= most:
            seeds.append((high, high - e))
        moved = e
    return a


def _same_ahead(word: np.ndarray, a: int, b: int) -> int:
    """For how many words the sequence goes on equally from a and, later, b."""
    n, got, step = len(word), 0, 32
    while b + got < n:
        step = min(step, n - b - got)
        unlike = np.flatnonzero(word[a + got : a + got + step] != word[b + got : b + got + step])
        if len(unlike):
            return got + int(unlike[0])
        got, step = got + step, 2 * step
    return got


def _runs_of(word: np.ndarray) -> list[tuple[int, int, int]]:
    known: dict[int, list[tuple[int, int]]] = {}
    for e, d, length in squares(word.tolist()):
        # The common suffix of the two prefixes is the state's length: no period goes on to the left of it.
        start = e - d - length + 1
        spans = known.setdefault(d, [])
        at = bisect_right(spans, (start, len(word)))
        if at and spans[at - 1][0] == start:
            continue
        insort(spans, (start, e + 1 + _same_ahead(word, e + 1 - d, e + 1)))
    return [(s, t - s, d) for d, spans in known.items() for s, t in spans if t - s >= max(LEAST, TIMES * d)]


def _stretches(word: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The parts of a sequence covered by windows that occur more than once in their part, with their starts."""
    todo = [(0, word)]
    while todo:
        low, part = todo.pop()
        n = len(part) - WINDOW + 1
        if len(part) < LEAST or n < 2:
            continue
        # Windows told by 64 bits; two alike by chance only leave more for the automaton.
        h, width = mix(part.astype(U)), 1
        while width < WINDOW:
            step = min(width, WINDOW - width)
            h = mix(h[:-step] * U(0x9E3779B97F4A7C15) + h[step:]) if step == width else mix(h[:-step] ^ h[step:] * U(0xD6E8FEB86659FD93))
            width += step
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        again = np.zeros(n, dtype=bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        if not again.any():
            continue
        cover = np.zeros(len(part) + 1, dtype=np.int64)
        cover[:n] += again
        cover[WINDOW : WINDOW + n] -= again
        inside = np.cumsum(cover)[:-1] > 0
        if inside.all():
            yield low, part
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        todo += [(low + a, part[a:b]) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def runs(word: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of integers, by start, then period."""
    return sorted((low + s, n, p) for low, part in _stretches(word) for s, n, p in _runs_of(part))


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal words as equal ones."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))


def report(words: list[bytes]) -> tuple:
    """The runs of a text's words and what is left of it when each run is cut to its first period."""
    found = runs(numbered(words)) if len(words) >= LEAST else []
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else None
    if best:
        # Quotients of far larger numbers may be told apart by whole numbers only.
        for r in found:
            more = r[1] * best[2] - best[1] * r[2]
            if more > 0 or more == 0 and (r[0], r[2]) < (best[0], best[2]):
                best = r
    kept = words
    if found:
        drop = np.zeros(len(words) + 1, dtype=np.int64)
        for s, n, p in found:
            drop[s + p] += 1
            drop[s + n] -= 1
        kept = [words[k] for k in np.flatnonzero(np.cumsum(drop)[:-1] == 0).tolist()]
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(found), *head, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(), [dict(zip(("start", "length", "period"), r, strict=True)) for r in found]


def periodic(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edited: bool = False) -> DataFrame:
    """Per document: doc_id, n_runs, its run of greatest exponent, digests of all runs and of the text without repetitions, and the runs.

    Words are what stands between blanks and control blanks, compared byte by byte. If edited, documents are first edited as
    looped() says. Null and empty texts, and texts of fewer than LEAST words, have no run; ids may be null or repeat, each row
    stands for itself. An empty table gives an empty table. Other columns are ignored.

    Rows stay where they are: nothing is shuffled. What a task holds is linear in its longest repetitive stretch, beside a batch.
    """
    bounded_batches(docs.sparkSession)

    def reported(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))
        names = [field.split()[0] for field in OUT.split(", ")]
        for batch in batches:
            out = []
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = data.split()
                out.append((doc_id, *report(looped(doc_id, words) if edited else words)))
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(whole(text_col), "utf-8").alias("data")).mapInArrow(reported, OUT)


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, of every tenth by the CRC-32 of its id with all words from one on repeating with a period; a null id
    leaves them as they are."""
    import zlib

    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]
