"""Words are told by one version of Unicode, and blanks in a row come back from formats in which they would be one."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from inkledger.plans import registry
from inkledger.sources import markup

# Without words; letters of Unicode 14 and 15, which Java 17 doesn't know, and of 15.1, which the SQL doesn't; marks and numbers.
TEXTS = [None, "", " \n", "...", "a", "1 2", "²½ Ⅷ", "aࡰb c", "\U0001df25 \U00031350x", "a\U0002ebf0b", "a_b́c", "x\x85y  z"]


@pytest.mark.parametrize("name", ("file_structures", "image_metadata", "file_import", "file_export"))
def test_odd_texts_give_the_rows_of_the_sql(spark, tmp_path, name):
    pq.write_table(pa.table({"doc_id": pa.array(range(len(TEXTS)), pa.int64()), "text": pa.array(TEXTS, pa.string())}), tmp_path / "documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    got = registry.queries()[name](spark, str(tmp_path))
    want = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("to", ("html", "tex"))
def test_blanks_in_a_row_come_back(to):
    back = {"html": "html", "tex": "latex"}[to]
    for text in ("a  b", "a   b *c  d*  `e  f`  $g  h$", "- a  b\n- c", "| a  b | c |\n| --- | --- |\n| d   e | f |"):
        assert markup.IMPORTERS[back](markup.exported(text, to)) == text
