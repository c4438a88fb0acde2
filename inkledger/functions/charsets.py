"""Code point sets. The four invisible sets differ on purpose: each measure has its own."""

from __future__ import annotations

# Code point ranges, both ends included.
FORENSIC_RANGES = ((0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x2069), (0xFEFF, 0xFEFF), (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x180E, 0x180E))
METRICS_RANGES = ((0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0xFEFF, 0xFEFF), (0x00AD, 0x00AD))
CONTROL_RANGES = ((0x00AD, 0x00AD), (0x061C, 0x061C), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x2069), (0xFEFF, 0xFEFF))
PIPELINE_RANGES = ((0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x206A, 0x206F), (0xFEFF, 0xFEFF))
BIDI_RANGES = ((0x200E, 0x200F), (0x202A, 0x202E), (0x2066, 0x2069))
JOINER_RANGES = ((0x2060, 0x2064), (0xFEFF, 0xFEFF))

# Latin letters and the Cyrillic letters of the same look, in the same order.
LATIN_LOOKALIKES = "aceopxysijABCEHKMOPTXSIJ"
CYRILLIC_LOOKALIKES = "асеорхуѕіјАВСЕНКМОРТХЅІЈ"


def members(ranges: tuple[tuple[int, int], ...]) -> str:
    """All characters of a set."""
    return "".join(chr(c) for low, high in ranges for c in range(low, high + 1))


FORENSIC, METRICS, CONTROL = members(FORENSIC_RANGES), members(METRICS_RANGES), members(CONTROL_RANGES)
PIPELINE, BIDI, JOINERS = members(PIPELINE_RANGES), members(BIDI_RANGES), members(JOINER_RANGES)

#: Letters that tell a script. Multiplication and division signs are no letters.
LATIN_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ"
_CYRILLIC_ALL = [c for c in range(0x400, 0x530) if not 0x482 <= c <= 0x489]
CYRILLIC_LETTERS = "".join(map(chr, _CYRILLIC_ALL))
#: Without those that a Latin letter looks like.
CYRILLIC_EVIDENCE = "".join(c for c in CYRILLIC_LETTERS if c not in CYRILLIC_LOOKALIKES)

# Carriers in their canonical order, with the characters of a 0, a 1 and, if any, the end of a byte, and what stripping removes.
CARRIERS = {
    "zero_width": ("​", "‌", "", "​‌"),
    "whitespace_var": ("⁠", "﻿", "⁣", "⁠﻿⁣⁡⁢⁤"),
    "bidi": ("‎", "‏", "‬", "‎‏‬‪‫‭‮⁦⁧⁨⁩"),
}
#: How confidence grows with the share of a carrier's characters.
GAIN = {"zero_width": 5, "whitespace_var": 50, "bidi": 50}
# The share of positions a mission may fill, strictest first.
MISSIONS = (("conceal", 0.25), ("sign", 0.50), ("mark", 0.85))
