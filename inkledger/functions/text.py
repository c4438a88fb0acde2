"""Column expressions over a text column. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import charsets as cs

ALPHABETIC = "\\p{IsAlphabetic}"


def count_of(text: Column, characters: str) -> Column:
    """How many characters of a set a text holds."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def only(text: Column, characters: str) -> Column:
    return F.regexp_replace(text, f"[^{characters}]", "")


def matches(text: Column, letters: str) -> Column:
    return text.rlike(f"[{letters}]")


def has_any(text: Column, characters: str) -> Column:
    """Whether a text holds any character of a set; a table look-up per character, whatever the set's size."""
    return F.translate(text, characters, "") != text


def document_script(text: Column) -> Column:
    """latin, cyrillic or undetermined, by letters that only one script has."""
    latin, cyrillic = matches(text, cs.LATIN_LETTERS), has_any(text, cs.CYRILLIC_EVIDENCE)
    return F.when(latin & ~cyrillic, "latin").when(cyrillic & ~latin, "cyrillic").otherwise("undetermined")


def _substituted(run: Column) -> Column:
    """Whether a run of letters of a document that isn't Latin as a whole is Latin, so that look-alikes in it were put there."""
    return ~has_any(run, cs.CYRILLIC_EVIDENCE) & matches(run, cs.LATIN_LETTERS)


def _attributed(text: Column, of_latin: Column, of_other: Column, none: Column) -> Column:
    """A Latin document has no letter that only Cyrillic has, so all its look-alikes were put there; others are looked at by runs of letters."""
    return F.when(has_any(text, cs.CYRILLIC_LOOKALIKES), F.when(document_script(text) == "latin", of_latin).otherwise(of_other)).otherwise(none)


def substitutions(text: Column) -> Column:
    """Look-alikes that stand in Latin words."""
    runs = F.regexp_extract_all(text, F.lit(f"{ALPHABETIC}+"), F.lit(0))
    found = count_of(F.array_join(F.filter(runs, _substituted), ""), cs.CYRILLIC_LOOKALIKES)
    return _attributed(text, count_of(text, cs.CYRILLIC_LOOKALIKES), found, F.lit(0).cast("long"))


def restored(text: Column) -> Column:
    """The text with attributed look-alikes turned back."""
    runs = F.regexp_extract_all(text, F.lit(f"{ALPHABETIC}+|[^{ALPHABETIC}]+"), F.lit(0))
    plain = lambda t: F.translate(t, cs.CYRILLIC_LOOKALIKES, cs.LATIN_LOOKALIKES)
    back = F.transform(runs, lambda r: F.when(has_any(r, cs.CYRILLIC_LOOKALIKES) & _substituted(r), plain(r)).otherwise(r))
    return _attributed(text, plain(text), F.array_join(back, ""), text)


def positions(text: Column) -> Column:
    """Letters that carry a bit for the look-alike carrier, either side of the map."""
    return count_of(text, cs.LATIN_LOOKALIKES + cs.CYRILLIC_LOOKALIKES)


def bits(text: Column, carrier: str) -> Column:
    """The 0/1 string a carrier's characters spell, in order."""
    if carrier == "homoglyph":
        kept = only(text, cs.LATIN_LOOKALIKES + cs.CYRILLIC_LOOKALIKES)
        return F.translate(kept, cs.LATIN_LOOKALIKES + cs.CYRILLIC_LOOKALIKES, "0" * 24 + "1" * 24)
    zero, one, *_ = cs.CARRIERS[carrier]
    return F.translate(only(text, zero + one), zero + one, "01")


def stripped_all(text: Column) -> Column:
    """The text without any carrier's marks: bidi, look-alikes, white space, zero width."""
    text = restored(without(text, cs.CARRIERS["bidi"][3]))
    return without(without(text, cs.CARRIERS["whitespace_var"][3]), cs.CARRIERS["zero_width"][3])


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def rounded(value: Column) -> Column:
    return F.round(value, 6)
