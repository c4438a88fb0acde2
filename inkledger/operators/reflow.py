"""Where lines may break and where they do, in a cover and in its copy."""

from __future__ import annotations

from bisect import bisect_right
from functools import cache

import numpy as np

from ..functions import charsets as cs

WIDTH = 80
# Break classes; characters of each, the first list that has one counts; and ranges of characters that break on both sides and are two columns wide.
MANDATORY, SPACE, ZERO_SPACE, GLUE, HYPHEN, WIDE, IGNORED, ORDINARY = range(8)
CLASSES = {
    MANDATORY: "\n\x0b\x0c\x85  ",
    IGNORED: "\r",
    SPACE: " \t             　",
    ZERO_SPACE: "​",
    GLUE: "⁠﻿",
    HYPHEN: "\xad-‐–",
}
WIDE_RANGES = ((0x2E80, 0x303E), (0x3041, 0x33FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF01, 0xFF60), (0x20000, 0x2FA1F))

_INK = np.isin(np.arange(8), (SPACE, MANDATORY, IGNORED), invert=True)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class and columns of each code point, whether a line may break between two classes, and which code points are controls."""
    kinds = np.full(0x110000, ORDINARY, dtype=np.uint8)
    controls = np.zeros(0x110000, dtype=bool)
    controls[[ord(c) for c in cs.CONTROL]] = True
    for low, high in WIDE_RANGES:
        kinds[low : high + 1] = WIDE
    widths = np.where(kinds == WIDE, 2, 1).astype(np.uint8)
    kinds[controls] = IGNORED
    for kind, characters in CLASSES.items():
        kinds[[ord(c) for c in characters]] = kind
    widths[controls] = 0
    widths[[ord(c) for c in CLASSES[MANDATORY] + "\r"]] = 0
    may = np.zeros((8, 8), dtype=bool)
    # From the weakest rule to the strongest: around wide characters; behind hyphens, spaces and zero-width spaces; never beside glue;
    # always behind a hard break, never before one.
    may[WIDE, :] = may[:, WIDE] = may[HYPHEN, :] = True
    may[:, SPACE] = False
    may[SPACE, :] = True
    may[:, ZERO_SPACE] = False
    may[ZERO_SPACE, :] = True
    may[GLUE, :] = may[:, GLUE] = False
    may[MANDATORY, :] = True
    may[:, MANDATORY] = False
    return kinds, widths, may, controls


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def opportunities(codes: np.ndarray) -> np.ndarray:
    """Places before which a line may break; characters that a line breaker doesn't see are passed over."""
    kinds, _, may, _ = _tables()
    kind = kinds.take(codes)
    seen = np.flatnonzero(kind != IGNORED)
    kind = kind.take(seen)
    return seen[1:][may.ravel().take(kind[:-1] * np.uint8(8) + kind[1:])]


def _last(which: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The place behind the last of some rising places before each end, or 0."""
    return np.concatenate(([0], which + 1))[np.searchsorted(which, end)]


def wraps(codes: np.ndarray, breaks: np.ndarray, width: int = WIDTH) -> list[int]:
    """Places at which a greedy first fit wraps; hard breaks aren't among them."""
    if not len(codes):
        return []
    kinds, widths, _, _ = _tables()
    kind = kinds.take(codes)
    start = np.concatenate(([0], breaks))
    end = np.append(breaks, len(codes))
    columns = np.zeros(len(codes) + 1, dtype=np.int64)
    np.cumsum(widths.take(codes), out=columns[1:])
    # Columns up to the last ink of each stretch between breaks: they rise, so a line's end is found by bisection.
    upto = columns[np.maximum(_last(np.flatnonzero(_INK.take(kind)), end), start)].tolist()
    last = np.maximum(_last(np.flatnonzero(kind != IGNORED), end), start)
    hard = np.flatnonzero((last > start) & (kind[np.maximum(last - 1, 0)] == MANDATORY)).tolist()
    begins = columns[start].tolist()
    out, line, n, ends = [], 0, len(begins), iter([*hard, len(begins) - 1])
    closes = next(ends)
    while line < n:
        # The first stretch of a line stands in it, however wide; a hard break closes the line.
        over = bisect_right(upto, begins[line] + width, line + 1, closes + 1)
        if over <= closes:
            out.append(over)
            line = over
        else:
            line, closes = closes + 1, next(ends, n - 1)
    return start[out].tolist() if out else []


def compared(one: np.ndarray, two: np.ndarray, in_cover: np.ndarray, width: int = WIDTH) -> tuple[int, int, int, int]:
    """Breaks of the cover at a width, how many are elsewhere in the copy, and opportunities gained and lost; places in terms of the cover.

    in_cover: the cover's place of each character of the copy, and of its end.
    """
    before, after = opportunities(one), opportunities(two)
    was, now = np.zeros((2, len(one) + 1), dtype=bool)
    was[before], now[in_cover[after]] = True, True
    lines, moved = wraps(one, before, width), in_cover[wraps(two, after, width)].tolist() if len(two) else []
    apart = sum(a != b for a, b in zip(lines, moved, strict=False)) + abs(len(lines) - len(moved))
    return len(lines), apart, int((now & ~was).sum()), int((was & ~now).sum())


def unevenness(places: np.ndarray, n: int) -> float:
    """The largest distance between the marks' places and an even spread over n places."""
    if not len(places) or not n:
        return 0.0
    i, x = np.arange(len(places)), (places + 1) / n
    return max(0.0, float(((i + 1) / len(places) - x).max()), float((x - i / len(places)).max()))
