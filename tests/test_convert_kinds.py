"""file_convert converts the files of all eight kinds and says what came out."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from inkledger.plans import registry

TEXTS = ["", "\n", "a b  \n\n\n c_d. ", "\r\nx\ry \t\n\n1. one\n5. two", "# h\n\n- *a* <b> & $c$ | \\d {e}", "²½ ࡰ \U0001df25", "x\x85 ", "a\x01 b", "c\x0bd\x00", "e\ufffe"]


def test_files_of_all_kinds_are_converted(spark, tmp_path):
    texts = [t for t in TEXTS for _ in range(8)]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = duck.execute(registry.oracle_sql()["file_convert"])
    columns = [c[0] for c in want.description]
    rows = [tuple(r) for r in registry.queries()["file_convert"](spark, str(tmp_path)).select(*columns).collect()]
    assert len(rows) == len(texts)
    assert sorted(map(repr, rows)) == sorted(map(repr, want.fetchall()))
    said = {r[0].rsplit(".", 1)[1] for r in rows if dict(zip(columns, r, strict=True))["words_md5"]}
    assert said == {"txt", "md", "docx", "odt", "html", "rtf", "py"}
