"""A marked copy paired with its cover, character by character, for any cover.

A carrier puts controls in and other characters in the place of visible ones, in order. So the k-th visible character of the copy stands for the
k-th of the cover, and between two of them the cover's own controls must come again, in their order, among the copy's: each is taken
by the first one that equals it, and all others of the copy are insertions. What can't be paired so is refused with a name and a place.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import charsets as cs
from ..functions.batches import mapped
from . import codec, reflow

# What a pairing is refused for, in the order in which a reading from the start meets it.
CONTROL_MISSING, CONTENT_ADDED, CONTENT_MISSING = "cover_control_missing", "visible_content_added", "cover_content_missing"
# Marks that turn what is beside them from right to left, all direction marks, scopes by their closing, and white space.
RTL_MARKS, DIRECTION_MARKS = "‏؜", "‎‏؜"
SCOPES = {"‬": "‪‫‭‮", "⁩": "⁦⁧⁨"}
WHITE_RANGES = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))


class Pairing(NamedTuple):
    """Marks in the order of the copy: their places in it and in the cover, and which are put in; and the cover's place of each character of the copy."""

    failure: str | None
    failure_at: int
    at: np.ndarray
    place: np.ndarray
    put_in: np.ndarray
    in_cover: np.ndarray


_NONE = np.zeros(0, dtype=np.int64)


def _refused(failure: str, at: int) -> Pairing:
    return Pairing(failure, at, _NONE, _NONE, _NONE.astype(bool), _NONE)


@cache
def _controls() -> np.ndarray:
    table = np.zeros(0x110000, dtype=bool)
    table[[ord(c) for c in cs.CONTROL]] = True
    return table


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are part of a word, and which are neutral to the direction of a text: white space, punctuation and symbols."""
    import regex

    word, plain = np.zeros(0x110000, dtype=bool), np.zeros(0x110000, dtype=bool)
    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    word[[ord(c) for c in regex.findall(r"[\p{Alphabetic}\p{N}]", everything)]] = True
    plain[[ord(c) for c in regex.findall(r"\p{Cc}", everything)]] = True
    neutral = ~word & ~plain
    for low, high in WHITE_RANGES:
        neutral[low : high + 1] = True
    neutral[_controls()] = False
    word[ord("_")] = True
    return word, neutral


#: Controls of a cover in one gap up to which all gaps are taken at once, a control of each a step; larger gaps one by one.
_TOGETHER = 8


def _taken(own: np.ndarray, own_gap: np.ndarray, codes: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Which control of the copy each of the cover's is taken by: the first equal one in its gap behind that of the one before; -1 where there is none."""
    firsts = np.flatnonzero(np.diff(own_gap, prepend=-1))
    sizes = np.diff(firsts, append=len(own))
    low, high = np.searchsorted(gap, own_gap[firsts]), np.searchsorted(gap, own_gap[firsts], side="right")
    taken = np.arange(len(own)) + np.repeat(low - firsts, sizes)
    fits = np.zeros(len(own), dtype=bool)
    there = np.flatnonzero(np.repeat(high - low == sizes, sizes))
    fits[there] = codes[taken[there]] == own[there]
    whole = np.logical_and.reduceat(fits, firsts)
    taken[~np.repeat(whole, sizes)] = -1
    todo = np.flatnonzero(~whole)
    for k in todo[sizes[todo] > _TOGETHER].tolist():
        at, end = int(low[k]), int(high[k])
        some = codes[at:end].tolist()
        now = 0
        for i, c in enumerate(own[firsts[k] : firsts[k] + sizes[k]].tolist(), int(firsts[k])):
            try:
                now = some.index(c, now) + 1
            except ValueError:
                break
            taken[i] = at + now - 1
    todo = todo[sizes[todo] <= _TOGETHER]
    if len(todo):
        # All places of each code in order, as one sorted list: the first place of a code from a place on is found by bisection.
        wide = len(codes) + 1
        keys = np.sort(codes.astype(np.int64) * wide + np.arange(len(codes)))
        now, step = low[todo], 0
        while len(todo):
            c = own[firsts[todo] + step].astype(np.int64)
            k = np.searchsorted(keys, c * wide + now)
            found = keys[np.minimum(k, len(keys) - 1)] - c * wide if len(keys) else np.full(len(todo), -1)
            good = (k < len(keys)) & (found >= now) & (found < high[todo])
            todo, now = todo[good], found[good] + 1
            taken[firsts[todo] + step] = now - 1
            step += 1
            more = sizes[todo] > step
            todo, now = todo[more], now[more]
    return taken


def paired_codes(cover: np.ndarray, marked: np.ndarray) -> Pairing:
    """The pairing of two texts given as code points."""
    controls = _controls()
    own, copied = controls[cover], controls[marked]
    seen, met = np.flatnonzero(~own), np.flatnonzero(~copied)
    put = np.flatnonzero(copied)
    gap = put - np.arange(len(put))
    # Without a control of the cover before it, an insertion stands before the next visible character.
    after = np.append(seen, len(cover))
    inserted, place = np.ones(len(put), dtype=bool), after[np.minimum(gap, len(seen))]
    kept = np.flatnonzero(own)
    own_gap = kept - np.arange(len(kept))
    # Gaps behind the end of the copy aren't met.
    kept, own_gap = kept[own_gap <= len(met)], own_gap[own_gap <= len(met)]
    if len(kept):
        taken = _taken(cover[kept], own_gap, marked[put], gap)
        lost = np.flatnonzero(taken < 0)
        if len(lost):
            return _refused(CONTROL_MISSING if own_gap[lost[0]] < len(met) else CONTENT_MISSING, int(kept[lost[0]]))
        inserted[taken] = False
        # A control of the copy stands where the next of the cover's in its gap does, if one is left.
        left = np.cumsum(~inserted) - ~inserted
        beside = np.flatnonzero((left < len(kept)) & (own_gap[np.minimum(left, len(kept) - 1)] == gap))
        place[beside] = kept[left[beside]]
    if len(met) > len(seen):
        return _refused(CONTENT_ADDED, int(met[len(seen)]))
    if len(met) < len(seen):
        return _refused(CONTENT_MISSING, int(seen[len(met)]))
    changed = np.flatnonzero(cover[seen] != marked[met])
    at = np.concatenate((put[inserted], met[changed]))
    order = np.argsort(at)
    in_cover = np.empty(len(marked) + 1, dtype=np.int64)
    in_cover[met], in_cover[put], in_cover[-1] = seen, place, len(cover)
    put_in = np.arange(len(at)) < int(inserted.sum())
    return Pairing(None, -1, at[order], np.concatenate((place[inserted], seen[changed]))[order], put_in[order], in_cover)


@cache
def _directions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which code points open or close a direction scope, are direction marks, and turn from right to left."""
    tables = np.zeros((3, 0x110000), dtype=bool)
    for table, characters in zip(tables, ("".join(end + openers for end, openers in SCOPES.items()), DIRECTION_MARKS, RTL_MARKS), strict=True):
        table[[ord(c) for c in characters]] = True
    return tables[0], tables[1], tables[2]


def open_scopes(codes: np.ndarray) -> tuple[int, int]:
    """Direction scopes left open, and closings without one; a closing ends the last scope of its kind and those inside."""
    kind = {ord(c): end for end, openers in SCOPES.items() for c in openers}
    ends = {ord(end): end for end in SCOPES}
    stack: list[str] = []
    lone = 0
    for c in codes[_directions()[0][codes]].tolist():
        if c in kind:
            stack.append(kind[c])
        elif ends[c] in stack:
            del stack[len(stack) - 1 - stack[::-1].index(ends[c]) :]
        else:
            lone += 1
    return len(stack), lone


def _distinct(rising: np.ndarray) -> int:
    return int((np.diff(rising) > 0).sum()) + 1 if len(rising) else 0


def _words(cover: np.ndarray, marked: np.ndarray, found: Pairing) -> tuple[int, int, int]:
    """Words of the cover, how many have a mark put in between two of their letters, and how many have a letter in another's place."""
    word = _letters()[0]
    inside = np.concatenate(([False], word[cover], [False]))
    number = np.cumsum(np.diff(inside.astype(np.int8)) == 1)
    place = found.place[found.put_in]
    broken = place[inside[place] & inside[place + 1]] if len(place) else place
    at, place = found.at[~found.put_in], found.place[~found.put_in]
    mixed = place[word[cover[place]] & word[marked[at]]]
    return int(number[-1]) if len(cover) else 0, _distinct(number[broken]), _distinct(number[mixed])


def _beside_neutrals(marked: np.ndarray, found: Pairing) -> tuple[int, int]:
    """Direction marks put in, and those from right to left beside a neutral character."""
    neutral = _letters()[1]
    at = found.at[found.put_in]
    _, marks, turning = _directions()
    added = int(marks[marked[at]].sum())
    at = at[turning[marked[at]]]
    before = (at > 0) & neutral[marked[np.maximum(at - 1, 0)]]
    behind = (at + 1 < len(marked)) & neutral[marked[np.minimum(at + 1, len(marked) - 1)]]
    return added, int((before | behind).sum())


def _in_code(cover: str, found: Pairing) -> int:
    """Marks whose place is inside a fence or a code span of the cover."""
    if not len(found.place) or "`" not in cover and "~" not in cover:
        return 0
    spans = [(low, high) for low, high, kind in codec.protected(cover) if kind != "maths"]
    return sum(int(((found.place >= low) & (found.place < high)).sum()) for low, high in spans)


def _window(place: np.ndarray, n: int) -> tuple[int, int, int]:
    """A tenth of the cover, 32 at least; the most marks in a window of that width; and where it starts."""
    width = min(max(n // 10, 32), n)
    within = np.searchsorted(place, place + width) - np.searchsorted(place, place)
    best = int(within.argmax()) if len(within) else 0
    return width, int(within.max(initial=0)), int(place[best]) if len(place) else 0


_LONG, _LONGS = "long", "array<long>"
#: What measured() can tell of a pair, and the type of each. Without a pairing all but n and failure are null.
COUNTS = {"n": _LONG, "failure": "string", "failure_at": _LONG, "insertions": _LONG, "substitutions": _LONG}
PLACES = {"k": _LONG, "places": _LONGS, "characters": "array<string>", "width": _LONG, "window": _LONG, "window_at": _LONG}
CHECKS = {name: _LONG for name in ("words", "broken", "mixed", "direction_marks", "rtl_beside_neutrals", "unclosed", "orphans")}
LAYOUT = {name: _LONG for name in ("cover_breaks", "moved", "gained", "lost", "marks_in_code")} | {"spread": "double"}


def _row(cover: str, marked: str, groups: tuple[str, ...]) -> dict:
    one, two = reflow.codes_of(cover), reflow.codes_of(marked)
    found, n = paired_codes(one, two), len(one)
    out: dict = {"n": n, "failure": found.failure, "failure_at": found.failure_at if found.failure else None}
    if found.failure:
        return out
    k = len(found.at)
    out |= {"insertions": int(found.put_in.sum()), "substitutions": int((~found.put_in).sum())}
    if "places" in groups:
        characters = [chr(c) for c in two[found.at].tolist()]
        out |= {"k": k, "places": found.place.tolist(), "characters": characters} | dict(zip(("width", "window", "window_at"), _window(found.place, n), strict=True))
    if "checks" in groups:
        before, after = open_scopes(one), open_scopes(two)
        values = (*_words(one, two, found), *_beside_neutrals(two, found), *(max(0, b - a) for a, b in zip(before, after, strict=True)))
        out |= dict(zip(CHECKS, values, strict=True))
    if "layout" in groups:
        out |= dict(zip(LAYOUT, (*reflow.compared(one, two, found.in_cover), _in_code(cover, found), reflow.unevenness(found.place, n)), strict=True))
    return out


def measured(pairs: DataFrame, *groups: str, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns of pairs (cover, marked), counts of the pairing, and groups of measures: places, checks, layout.

    One Arrow pass over both texts, row by row: nothing is shuffled, and rows of one id stay apart. Null texts are empty.
    Texts come back only if they are carried.
    """
    wanted = COUNTS | (PLACES if "places" in groups else {}) | (CHECKS if "checks" in groups else {}) | (LAYOUT if "layout" in groups else {})
    taken = [c for c in carried if c not in wanted]
    rows = pairs.select(*taken, F.coalesce("cover", F.lit("")).alias("_cover"), F.coalesce("marked", F.lit("")).alias("_marked"))
    schema = rows.select(*taken, *[F.lit(None).cast(kind).alias(name) for name, kind in wanted.items()]).schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = {_LONG: pa.int64(), _LONGS: pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "string": pa.string(), "double": pa.float64()}
        for batch in batches:
            found = [_row(c, m, groups) for c, m in zip(*(x.to_pylist() for x in batch.columns[-2:]), strict=True)]
            columns = [pa.array([r.get(name) for r in found], kinds[kind]) for name, kind in wanted.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *columns], names=schema.names)

    return mapped(rows, run, schema)
