"""Queries of whole commands: concealing and revealing, frames' shapes, file commands, licenses and bindings."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from ..functions import charsets as cs
from ..functions.batches import mapped
from ..operators import conceal as co
from ..operators import file_commands as fc
from ..operators import licenses as li
from ..sources import files as fl
from ..sources import markup
from .query import query
from .wordmark_queries import PLAIN_SQL, plain

PASSWORD, SALT = "a long password", b"salt of the table"[:16]
#: A text whose marks are gone: what commands are given.
_MARKS = "".join(sorted(set(cs.FORENSIC + cs.CARRIERS["whitespace_var"][3] + cs.CYRILLIC_LOOKALIKES)))
BARE_SQL = f"{PLAIN_SQL}, bare AS (SELECT doc_id, translate(text, '{_MARKS}', '') AS text FROM docs)"


def bare(spark, sf_dir):
    return plain(spark, sf_dir).withColumn("text", F.translate("text", _MARKS, ""))


def secret():
    return F.concat(F.lit("secret of "), F.col("doc_id").cast("string"))


def _pairs(spark, sf_dir):
    return bare(spark, sf_dir).select("doc_id", F.col("text").alias("cover"), secret().alias("secret"))


# Ciphers by doc_id: none, one that seals, one that doesn't check itself.
_CIPHERS = (None, co.SEALED, co.MIXED)


def concealed_by_cipher(spark, sf_dir, carriers, mission=None):
    """doc_id, cover, marked, refusal, cipher_asked: each document's secret under the cipher its id gives."""
    parts = []
    for k, cipher in enumerate(_CIPHERS):
        rows = _pairs(spark, sf_dir).where(F.pmod("doc_id", F.lit(len(_CIPHERS))) == k).withColumn("cipher_asked", F.lit(cipher).cast("string"))
        parts.append(co.conceal(rows, carriers, cipher, PASSWORD, SALT, mission))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_ASKED = f"CASE ((doc_id % 3) + 3) % 3 WHEN 1 THEN '{co.SEALED}' WHEN 2 THEN '{co.MIXED}' END"


@query(f"WITH {BARE_SQL} SELECT doc_id, 'secret of ' || doc_id AS secret, {_ASKED} AS cipher, 'zero_width' AS carriers, CASE WHEN {_ASKED} = '{co.SEALED}' THEN 'identify,zero_width,envelope,{co.SEALED}' WHEN {_ASKED} = '{co.MIXED}' THEN 'identify,zero_width,envelope,crc32,{co.MIXED}' ELSE 'identify,zero_width,envelope,crc32' END AS waves, TRUE AS text_kept FROM bare")
def conceal_reveal(spark, sf_dir):
    """Each document's secret into its text, sealed or not, and out again by the waves of reading; the visible text stays."""
    rows = co.reveal(concealed_by_cipher(spark, sf_dir, ("zero_width",)), PASSWORD)
    kept = F.translate("marked", "".join(cs.CARRIERS["zero_width"][3]), "") == F.col("cover")
    return rows.select("doc_id", "found.secret", "found.cipher", F.array_join("found.carriers", ",").alias("carriers"), F.array_join(F.transform("found.waves", lambda w: w["wave"]), ",").alias("waves"), kept.alias("text_kept"))


_AES = f"CASE ((doc_id % 2) + 2) % 2 WHEN 0 THEN '{co.AUTHENTICATED[1]}' ELSE '{co.AUTHENTICATED[2]}' END"


@query(f"WITH {BARE_SQL} SELECT doc_id, 'secret of ' || doc_id AS secret, {_AES} AS cipher, 'identify,zero_width,envelope,' || {_AES} AS waves, CAST(length('secret of ' || doc_id) + 29 AS BIGINT) AS payload_bytes FROM bare")
def conceal_reveal_aes(spark, sf_dir):
    """Each document's secret into its text under AES-GCM with keys of two lengths, and out again."""
    rows = _pairs(spark, sf_dir)
    parts = [co.conceal(rows.where(F.pmod("doc_id", F.lit(2)) == k), ("zero_width",), cipher, PASSWORD, SALT) for k, cipher in enumerate(co.AUTHENTICATED[1:])]
    found = co.reveal(parts[0].unionByName(parts[1]), PASSWORD)
    taken = F.element_at("found.waves", -1)["taken"]
    return found.select("doc_id", "found.secret", "found.cipher", F.array_join(F.transform("found.waves", lambda w: w["wave"]), ",").alias("waves"), taken.alias("payload_bytes"))


_SWEPT = f"CASE ((doc_id % 4) + 4) % 4 WHEN 0 THEN '{co.AUTHENTICATED[0]}' WHEN 1 THEN '{co.AUTHENTICATED[1]}' WHEN 2 THEN '{co.AUTHENTICATED[2]}' END"


@query(f"WITH {PLAIN_SQL} SELECT doc_id, {_SWEPT} AS cipher, CASE WHEN {_SWEPT} IS NOT NULL THEN md5(text) END AS secret_md5, CASE WHEN {_SWEPT} IS NULL THEN 'no_candidate_fits:{','.join(co.AUTHENTICATED)}' END AS refusal FROM docs")
def recovery_sweep(spark, sf_dir):
    """Each whole text sealed by one of three ciphers, or by another password, and found by a sweep over all of them under one derivation."""
    which = F.pmod("doc_id", F.lit(4))
    names = F.when(which == 0, co.AUTHENTICATED[0]).when(which == 1, co.AUTHENTICATED[1]).otherwise(co.AUTHENTICATED[2])
    docs = plain(spark, sf_dir).select("doc_id", F.col("text").alias("secret_text"), names.alias("by"))
    boxes = co.sealed(docs.where("doc_id % 4 <> 3"), "by", PASSWORD, SALT, "secret_text").unionByName(co.sealed(docs.where("doc_id % 4 = 3"), "by", PASSWORD + ".", SALT, "secret_text"))
    found = co.sweep(boxes.select("doc_id", "box"), PASSWORD, SALT)
    return found.select("doc_id", "cipher", F.md5("secret").alias("secret_md5"), "refusal")


@query(f"WITH {BARE_SQL} SELECT doc_id, CASE WHEN {_ASKED} IS NULL THEN 'secret of ' || doc_id END AS secret, CASE WHEN {_ASKED} IS NOT NULL THEN 'password_needed' END AS refusal FROM bare")
def reveal_without_password(spark, sf_dir):
    """The same texts read without the password: only what isn't sealed comes out."""
    rows = co.reveal(concealed_by_cipher(spark, sf_dir, ("zero_width",)))
    return rows.select("doc_id", "found.secret", "found.refusal")


@query(f"WITH {BARE_SQL}, n AS (SELECT doc_id, length('secret of ' || doc_id) AS s FROM bare) SELECT doc_id, 'zero_width' AS carrier, CAST(CASE WHEN {_ASKED} = '{co.SEALED}' THEN 4 ELSE 3 END AS INTEGER) AS version, 'mark' AS mission, 'head' AS read_from, {_ASKED} AS cipher, CAST(CASE WHEN {_ASKED} = '{co.SEALED}' THEN s + 28 ELSE s + 4 END AS BIGINT) AS payload_bytes FROM n")
def frame_shapes(spark, sf_dir):
    """What the frame of each marked text says of itself, without a password."""
    return co.shapes(concealed_by_cipher(spark, sf_dir, ("zero_width",), "mark")).select("doc_id", "carrier", "version", "mission", "read_from", "cipher", "payload_bytes")


@query(f"WITH {BARE_SQL} SELECT doc_id, 'secret of ' || doc_id AS secret, TRUE AS recovery, 'identify,recovery' AS waves FROM bare")
def recover_packages(spark, sf_dir):
    """Packages from before frames, found by asking each carrier."""
    rows = _packaged(_pairs(spark, sf_dir))
    return co.reveal(rows).select("doc_id", "found.secret", "found.recovery", F.array_join(F.transform("found.waves", lambda w: w["wave"]), ",").alias("waves"))


def _packaged(pairs):
    from ..operators import codec

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            both = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            made = [codec.write_bits(text, codec.to_bits(co.package(secret.encode())), "zero_width") for text, secret in both]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["doc_id", "marked"])

    return mapped(pairs, run, "doc_id long, marked string")


@query(f"WITH {BARE_SQL} SELECT doc_id, 'nothing_found' AS refusal, TRUE AS recovery FROM bare")
def reveal_bare(spark, sf_dir):
    """Texts that hold nothing: undetermined, never an error."""
    return co.reveal(bare(spark, sf_dir), column="text").select("doc_id", "found.refusal", "found.recovery")


# ---- files -------------------------------------------------------------------------------------------------------

_EXT = ("txt", "md", "docx", "odt", "html", "rtf", "py", "png")
_EXT_SQL = "['" + "', '".join(_EXT) + "']"


def _rtf(text):
    """A text as RTF, a paragraph a line, as an editor saves it."""
    return ("{\\rtf1\\ansi\n" + "\\par\n".join(markup._rtf(line) for line in re.split("\r\n|\r|\n", text)) + "\n}").encode()


def _file_table(spark, sf_dir, kinds=_EXT):
    """path, content: each text with a zero-width space behind every blank, as a file of the kind its id gives. Files of other kinds than those
    asked for aren't made."""
    from .file_queries import _made

    asked = F.pmod("doc_id", F.lit(len(_EXT))).isin([k for k, kind in enumerate(_EXT) if kind in kinds])
    rows = plain(spark, sf_dir).where(asked).select("doc_id", F.replace("text", F.lit(" "), F.lit(" ​")).alias("text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            paths, data = [], []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind = _EXT[doc_id % len(_EXT)]
                paths.append(f"/in/{doc_id}.{kind}")
                data.append(fl.embed(fl._png([(b"IHDR", bytes(13)), (b"IDAT", b""), (b"IEND", b"")]), "png", b"x") if kind == "png" else _rtf(text) if kind == "rtf" else _made(kind, text))
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(data, pa.binary())], names=["path", "content"])

    return mapped(rows, run, "path string, content binary")


_FILES_SQL = f"{PLAIN_SQL}, f AS (SELECT doc_id, text, {_EXT_SQL}[doc_id % {len(_EXT)} + 1] AS e, replace(text, ' ', ' ​') AS t FROM docs), g AS (SELECT *, '/in/' || doc_id || '.' || e AS path, contains(t, '​') AS has, regexp_matches(t, '^\\s*$') AS blank FROM f)"


@query(f"""WITH {_FILES_SQL} SELECT path, CASE WHEN e IN ('txt', 'md', 'docx', 'odt') THEN has END AS altered, CASE e WHEN 'html' THEN 'markup_not_lossless' WHEN 'rtf' THEN 'lowered_format' WHEN 'py' THEN 'lowered_format' WHEN 'png' THEN 'image_has_no_text' END AS refusal, CASE WHEN e IN ('txt', 'md') THEN md5(text) END AS content_md5 FROM g""")
def file_clean(spark, sf_dir):
    """Zero-width marks out of text and office files, other formats refused by name."""
    rows = fc.clean(_file_table(spark, sf_dir), ("zero_width",))
    return rows.select("path", "altered", "refusal", F.when(F.col("format").isin("txt", "md"), F.md5("content")).alias("content_md5"))


@query(f"""WITH {_FILES_SQL} SELECT path, CASE WHEN e IN ('docx', 'odt') THEN TRUE WHEN e = 'png' THEN TRUE END AS stripped, CASE WHEN e NOT IN ('docx', 'odt', 'png') THEN 'no_metadata_container' END AS refusal FROM g""")
def file_strip(spark, sf_dir):
    """Metadata out of office files and images."""
    return fc.strip(_file_table(spark, sf_dir)).select("path", F.col("altered").alias("stripped"), "refusal")


@query(f"""WITH {_FILES_SQL} SELECT path, CASE WHEN e IN ('txt', 'md') THEN md5(translate(text, '{cs.FORENSIC}', '')) END AS content_md5, CASE e WHEN 'html' THEN 'markup_not_lossless' WHEN 'rtf' THEN 'lowered_format' WHEN 'py' THEN 'lowered_format' WHEN 'png' THEN 'image_has_no_text' WHEN 'docx' THEN 'container_not_pristine' WHEN 'odt' THEN 'container_not_pristine' END AS refusal FROM g WHERE NOT regexp_matches(text, '[{cs.CYRILLIC_LOOKALIKES}]')""")
def file_pristine(spark, sf_dir):
    """Every invisible character out of text files."""
    files = _file_table(spark, sf_dir)
    rows = fc.pristine(files).join(plain(spark, sf_dir).where(~F.col("text").rlike(f"[{cs.CYRILLIC_LOOKALIKES}]")).select("doc_id"), F.regexp_extract("path", "/(\\d+)\\.", 1).cast("long") == F.col("doc_id"), "left_semi")
    return rows.select("path", F.when(F.col("format").isin("txt", "md"), F.md5("content")).alias("content_md5"), "refusal")


@query(f"""WITH {_FILES_SQL} SELECT path, CASE WHEN e = 'png' THEN 'image_has_no_text' WHEN blank AND e IN ('txt', 'md', 'html', 'rtf') THEN 'empty_text' END AS refusal, CASE WHEN e IN ('txt', 'md') AND NOT blank THEN CAST(length(t) - length(translate(t, '​', '')) AS BIGINT) ELSE -1 END AS zero_width FROM g WHERE e IN ('txt', 'md', 'png')""")
def file_inspect(spark, sf_dir):
    """Marks of each class in the text of files, read only."""
    rows = fc.inspect(_file_table(spark, sf_dir, ("txt", "md", "png")))
    return rows.select("path", "refusal", F.coalesce("zero_width", F.lit(-1)).alias("zero_width"))


@query(f"""WITH {_FILES_SQL} SELECT path, CASE e WHEN 'html' THEN 'markup_not_lossless' WHEN 'rtf' THEN 'lowered_format' WHEN 'py' THEN 'lowered_format' WHEN 'png' THEN 'image_has_no_text' WHEN 'docx' THEN 'container_not_concealed' WHEN 'odt' THEN 'container_not_concealed' END AS refusal, CASE WHEN e IN ('txt', 'md') THEN 'for your eyes' END AS secret FROM g""")
def file_conceal(spark, sf_dir):
    """A sealed secret into text files by another carrier, and out again."""
    files = _file_table(spark, sf_dir)
    clean = fc.clean(files, ("zero_width",)).select("path", F.coalesce("content", F.lit(b"")).alias("content"))
    rows = fc.conceal(clean, "for your eyes", ("zero_width",), co.SEALED, PASSWORD)
    found = co.reveal(rows.select("path", "refusal", F.decode(F.coalesce("content", F.lit(b"")), "utf-8").alias("marked")), PASSWORD)
    return found.select("path", "refusal", F.when(F.col("refusal").isNull(), F.col("found.secret")).alias("secret"))


# Lines as office files and RTF have them: no blanks before a line feed, at most one empty line in a row, none at the ends.
_ENDS_SQL = "replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_COLLAPSED_SQL = "trim(regexp_replace(regexp_replace({} || " + _ENDS_SQL + ", '[ \\t]+\\n', chr(10), 'g'), '\\n[ \\t]*(?:\\n[ \\t]*)+\\n', chr(10) || chr(10), 'g'), chr(10))"
_OFFICE_SQL, _RTF_SQL = _COLLAPSED_SQL.format("'# Head' || chr(10) || chr(10)"), _COLLAPSED_SQL.format("''")
_CODE_SQL = "'```python' || chr(10) || regexp_replace(t, '[\\t-\\r\\x1c-\\x20\\x{85}\\p{Z}]+$', '') || chr(10) || '```' || chr(10)"
# Characters that no XML can hold.
_NO_XML = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{FFFE}\\x{FFFF}]"
_SAID_SQL = "CASE WHEN e IN ('docx', 'odt') THEN 'Head ' WHEN e = 'py' THEN 'python ' ELSE '' END || t"


@query(f"""WITH {_FILES_SQL}, c AS (SELECT *, CASE WHEN e = 'png' THEN 'image_has_no_text' WHEN blank AND e IN ('txt', 'md', 'html', 'rtf') THEN 'empty_text' WHEN e IN ('docx', 'odt') AND regexp_matches(t, '{_NO_XML}') THEN 'broken_xml' END AS why FROM g) SELECT path, why AS refusal, CASE WHEN why IS NOT NULL THEN NULL WHEN e IN ('txt', 'md') THEN md5(t) WHEN e IN ('docx', 'odt') THEN md5({_OFFICE_SQL}) WHEN e = 'rtf' THEN md5({_RTF_SQL}) WHEN e = 'py' THEN md5({_CODE_SQL}) END AS txt_md5, CASE WHEN why IS NULL THEN md5(array_to_string(regexp_extract_all({_SAID_SQL}, '[\\p{{L}}\\p{{N}}]+'), ' ')) END AS words_md5, 'no_writer' AS docx_refusal FROM c""")
def file_convert(spark, sf_dir):
    """Files of every kind to plain text by way of Markdown, all words of each in order, and to a container that has no writer. What HTML is read to is told by
    its words alone."""
    files = _file_table(spark, sf_dir)
    to_text = _with_words(fc.convert(files, "txt"))
    refused = F.when(F.col("refusal") == "image_has_no_text", "no_writer").otherwise(F.col("refusal"))
    return to_text.join(fc.convert(files, "docx").select("path", refused.alias("docx_refusal")), "path")


def _with_words(converted):
    """path, refusal, txt_md5, words_md5 of converted files."""
    from .file_queries import WORD

    md5 = lambda data: hashlib.md5(data).hexdigest()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            whole, words = [], []
            for kind, content in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                whole.append(None if content is None or kind == "html" else md5(content))
                words.append(None if content is None else md5(" ".join(WORD.findall(content.decode())).encode()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(whole, pa.string()), pa.array(words, pa.string())], names=["path", "refusal", "txt_md5", "words_md5"])

    return mapped(converted.select("path", "refusal", "format", "content"), run, "path string, refusal string, txt_md5 string, words_md5 string")


# ---- licenses and claims -----------------------------------------------------------------------------------------

SEED = bytes(range(32))


@query(f"WITH {BARE_SQL} SELECT doc_id, 'h' || doc_id AS holder, sha256(text) AS doc_hash, 'document_altered' AS altered, 'signature_invalid' AS other_key, 'no_license' AS bare FROM bare")
def licenses(spark, sf_dir):
    """A signed license into each text and out again; altered texts, other keys and bare texts are refused by name."""
    return li.licensed(bare(spark, sf_dir), SEED)


@query(f"WITH {BARE_SQL} SELECT doc_id, unnest(['detached', 'in_band', 'metadata']) AS binding, 'none' AS findings, 'document_altered' AS altered_findings, TRUE AS absent_without FROM bare")
def bindings(spark, sf_dir):
    """A claim beside each text, in it, and in a file's metadata, read back and checked."""
    rows = li.bound(bare(spark, sf_dir), SEED)
    said = lambda c: F.when(F.size(c) == 0, "none").otherwise(F.array_join(c, ","))
    return rows.select("doc_id", "binding", said("findings").alias("findings"), said("altered_findings").alias("altered_findings"), "absent_without")
