"""Payloads attached to a text by an inline marker, and renderings of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the most bytes of an attachment.
LARGEST = 100 * 1024
_MARKER = "\\[FILE:([^|\\]]*)\\|([A-Za-z0-9+/=]*)\\[/FILE\\]"


def attached(text: Column, name: Column, payload: Column) -> Column:
    """The text with a payload at its end; null where the payload is too large."""
    data = F.regexp_replace(F.base64(payload), "[\\r\\n]", "")
    return F.when(F.octet_length(payload) <= LARGEST, F.concat(text, F.lit("[FILE:"), name, F.lit("|"), data, F.lit("[/FILE]")))


def names(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_MARKER), F.lit(1))


def payloads(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(_MARKER), F.lit(2)), F.unbase64)


def detached(text: Column) -> Column:
    return F.regexp_replace(text, _MARKER, "")


def rendered(text: Column) -> dict[str, Column]:
    """A text as HTML, base64 and data URI."""
    escaped = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    encoded = F.regexp_replace(F.base64(F.encode(text, "utf-8")), "[\\r\\n]", "")
    return {"html": F.concat(F.lit("<pre>"), escaped, F.lit("</pre>")), "base64": encoded, "data_uri": F.concat(F.lit("data:text/plain;charset=utf-8;base64,"), encoded)}
