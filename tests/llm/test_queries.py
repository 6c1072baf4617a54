"""Every registered query on the smallest tables: against its SQL where it has some, and for its columns and rows otherwise."""

import os

import duckdb
import pytest

from bitweave.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents embeddings pages benchmark conversations".split()
COLUMNS = {
    "op1_decontamination": ("documents", {"doc_id", "contaminated", "n_items", "item_ids"}), "op5_language_id": ("documents", {"doc_id", "held_out", "lang_pred", "score"}),
    "op7_packing": (None, {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}), "op10_html_extraction": ("pages", {"page_id", "url", "text", "n_chars"}),
    "op13_personal_data": ("documents", {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}),
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    if name == "op7_packing":
        pytest.importorskip("public_tokenizers")
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        table, columns = COLUMNS[name]
        assert set(df.columns) == columns and (table is None or len(rows) == spark.read.parquet(f"{SF}/{table}.parquet").count())
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    order = sorted(df.columns)
    assert sorted(want.columns) == order
    assert sorted(str([r[c] for c in order]) for r in rows) == sorted(str([dict(zip(want.columns, r, strict=True))[c] for c in order]) for r in want.fetchall())
