"""Word-choice statistics: tokens, keyed partitions, scores, the synonym channel and acrostics."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import mapped

# Public configurations as name, seed, share of the green list, tokens of context.
CONFIGS = (
    ("kgw-hash:transformers-default-h1", 15_485_863, 0.25, 1),
    ("kgw-hash:transformers-default-g05", 15_485_863, 0.5, 1),
    ("kgw-hash:transformers-default-h2", 15_485_863, 0.25, 2),
    ("kgw-hash:public-standard-h3", 20_260_827, 0.25, 3),
    ("kgw-hash:vendor-demo-h4", 0x00C0_FFEE, 0.25, 4),
)
THRESHOLDS = {0.25: "4000000000000000", 0.5: "8000000000000000"}
TAU = 5.0
# Pairs of synonyms, the canonical word first.
PAIRS = (
    ("big", "large"),
    ("small", "little"),
    ("fast", "quick"),
    ("begin", "start"),
    ("end", "finish"),
    ("buy", "purchase"),
    ("help", "assist"),
    ("show", "display"),
    ("near", "close"),
    ("whole", "entire"),
    ("often", "frequently"),
    ("also", "too"),
    ("use", "utilize"),
    ("make", "create"),
    ("keep", "retain"),
    ("need", "require"),
    ("get", "obtain"),
    ("want", "wish"),
    ("many", "numerous"),
    ("so", "thus"),
)
WORDS = [w for p in PAIRS for w in p]


def config_key(seed: int, name: str) -> str:
    return hashlib.sha256(seed.to_bytes(8, "little") + name.encode()).hexdigest()


def tokens(text: Column) -> Column:
    """The first 8 hex digits of the SHA-256 of every run of letters and digits, in lower case."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit("[\\p{IsAlphabetic}\\p{N}]+"), F.lit(0)), lambda w: F.substring(F.sha2(w, 256), 1, 8))


def _counted(name: str, seed: int, gamma: float, h: int) -> Column:
    """config, n, green and gamma of the token array t under one configuration."""
    head = F.lit(config_key(seed, name) + "01" + f"{h:08x}")
    n = F.greatest(F.size("t") - h, F.lit(0))
    at = F.when(n > 0, F.sequence(F.lit(h + 1), F.size("t"))).otherwise(F.array().cast("array<int>"))
    drawn = lambda i: F.substring(F.sha2(F.unhex(F.concat(head, F.array_join(F.slice("t", i - h, h + 1), ""))), 256), 1, 16)
    green = F.size(F.filter(at, lambda i: drawn(i) < THRESHOLDS[gamma]))
    return F.struct(F.lit(name).alias("config"), n.cast("long").alias("n"), green.cast("long").alias("green"), F.lit(gamma).alias("gamma"))


def scores(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, config, n, green, z: every document under every configuration. A projection: context is a slice of the document's own tokens."""
    rows = docs.select("doc_id", tokens(F.col(column)).alias("t"))
    rows = rows.select("doc_id", F.inline(F.array(*[_counted(*config) for config in CONFIGS])))
    z = F.when(F.col("n") > 0, (F.col("green") - F.col("gamma") * F.col("n")) / F.sqrt(F.col("n") * F.col("gamma") * (1 - F.col("gamma")))).otherwise(0.0)
    return rows.select("doc_id", "config", "n", "green", z.alias("z"))


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w, g, v) for g, p in enumerate(PAIRS) for v, w in enumerate(p)], "word string, synonym_group int, variant int")


def letter_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("\\p{IsAlphabetic}+"), F.lit(0))


def channel(text: Column) -> Column:
    """The variants of all synonyms of a text, in order."""
    first = F.array(*[F.lit(a) for a, _ in PAIRS])
    return F.transform(F.filter(letter_runs(F.lower(text)), lambda w: w.isin(*WORDS)), lambda w: F.when(F.array_contains(first, w), 0).otherwise(1))


def positions(docs: DataFrame, spark: SparkSession, column: str = "text") -> DataFrame:
    """doc_id, word_index, synonym_group, variant: one row per synonym. The lexicon is fixed and broadcast."""
    words = docs.select("doc_id", F.posexplode(letter_runs(F.lower(F.col(column)))).alias("word_index", "w"))
    return words.join(F.broadcast(lexicon(spark)), F.col("w") == F.col("word")).select("doc_id", "word_index", "synonym_group", "variant")


def word_acrostic(text: Column) -> Column:
    return F.lower(F.array_join(F.transform(letter_runs(text), lambda w: F.substring(w, 1, 1)), ""))


def line_acrostic(text: Column) -> Column:
    return F.lower(F.array_join(F.transform(F.split(text, "\\n"), lambda s: F.regexp_extract(s, "\\p{IsAlphabetic}", 0)), ""))


def _with_variants(text: str, choose) -> str:
    """The text with each synonym replaced by the variant choose(k, variant) gives, in the word's case."""
    import regex

    count = -1

    def other(found) -> str:
        nonlocal count
        word = found[0]
        at = _PLACE.get(word.lower())
        if at is None:
            return word
        count += 1
        new = PAIRS[at[0]][choose(count, at[1])]
        return new.upper() if word.isupper() and len(word) > 1 else new.capitalize() if word[:1].isupper() else new

    return regex.sub(r"\p{Alphabetic}+", other, text)


_PLACE = {w: (g, v) for g, p in enumerate(PAIRS) for v, w in enumerate(p)}


def canonical(text: str) -> str:
    return _with_variants(text, lambda k, v: 0)


def scrubbed(text: str, stride: int) -> str:
    """Every stride-th synonym turned to its other variant. A perturbation; it proves nothing removed."""
    return _with_variants(text, lambda k, v: 1 - v if k % stride == 0 else v)


#: Synonyms that a mark needs, and how many it takes where there are more: another key finds it by chance in one text of 2 to the power of their number.
LEAST, MOST = 16, 64
_MAGIC = [0xA5C3 >> (15 - k) & 1 for k in range(LEAST)] + [0] * (MOST - LEAST)


def _marking(key: bytes, text: str, n: int) -> list[int]:
    """The variants of the first n synonyms of a marked text."""
    own = hashlib.sha256(b"\x03" + key + hashlib.sha256(canonical(text).encode()).digest()).digest()
    return [m ^ hashlib.sha256(own + b"\x02" + k.to_bytes(4, "big")).digest()[0] & 1 for k, m in enumerate(_MAGIC[:n])]


def signed(text: str, key: bytes) -> str | None:
    """The text with a keyed signature in its synonyms, the first MOST of them, or None where it has fewer than LEAST."""
    places = [w for w in _letters(text) if w in _PLACE]
    if len(places) < LEAST:
        return None
    bits = _marking(key, text, len(places))
    return _with_variants(text, lambda k, v: bits[k] if k < MOST else v)


def has_signature(text: str, key: bytes) -> bool:
    found = [_PLACE[w][1] for w in _letters(text) if w in _PLACE][:MOST]
    return len(found) >= LEAST and found == _marking(key, text, len(found))


def _letters(text: str) -> list[str]:
    import regex

    return regex.findall(r"\p{Alphabetic}+", text.lower())


def scrub_report(docs: DataFrame, column: str, key: bytes) -> DataFrame:
    """doc_id, total, changed_light, changed_medium, changed_heavy, canonical_kept, signed, found, found_by_other_key."""

    def report(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["doc_id", "total", "changed_light", "changed_medium", "changed_heavy", "canonical_kept", "signed", "found", "found_by_other_key"]
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 4
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = [w for w in _letters(text) if w in _PLACE]
                done = {s: [w for w in _letters(scrubbed(text, s)) if w in _PLACE] for s in (3, 2, 1)}
                changed = [sum(a != b for a, b in zip(words, done[s], strict=True)) for s in (3, 2, 1)]
                mark = signed(text, key)
                out.append((doc_id, len(words), *changed, canonical(scrubbed(text, 1)) == canonical(text), mark is not None, mark is not None and has_signature(mark, key), mark is not None and has_signature(mark, b"other" + key)))
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = "doc_id long, total long, changed_light long, changed_medium long, changed_heavy long, canonical_kept boolean, signed boolean, found boolean, found_by_other_key boolean"
    return mapped(docs.select("doc_id", column), report, schema)


# Phrases that tell a refusal to rewrite.
REFUSALS = (
    "i can't", "i cannot", "i can not", "i'm sorry", "i am sorry", "i apologize", "as an ai", "as a language model", "i'm unable", "i am unable", "i won't", "i will not",
    "i must decline", "i must refuse", "cannot assist", "can't assist",
)


def rewrite_refusal(given: Column, output: Column) -> Column:
    """Why a rewrite is not to be used: empty, refusal, bloat, collapse; null if it is sound."""
    o = F.trim(output)
    n, m = F.length(o), F.length(given)
    refused = F.lit(False)
    for phrase in REFUSALS:
        refused = refused | F.contains(F.lower(o), F.lit(phrase))
    return F.when(o == "", "empty").when(refused, "refusal").when(n > m * 1.5 + 40, "bloat").when((m > 0) & (n < m * 0.3), "collapse")
