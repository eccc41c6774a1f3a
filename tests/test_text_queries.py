"""Text queries held against their SQL on small odd tables."""

import duckdb

import __spark_entry__ as entry

# Texts whose last line is or becomes empty, lines of white space only, digits of other scripts.
ODD = ("", "7", "a\n", "a\nb\n28.", "12\n34", "\t", "a\r\n\r\nb", "a\n \nb", "a\n\xa0\nb", "\n\n", "F٣ a\nb", "FR-٣\nFR-٤", "a\n٣.٤ b")


def test_numbering_dialects(spark, tmp_path):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    rows = [(4 * i + kind, text) for i, text in enumerate(ODD) for kind in range(4)]
    again = [(400 + kind, text) for kind in range(4) for text in ("a\nb", "c\n")]
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows + again)
    db.execute(f"COPY documents TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    want = db.sql(entry.oracle_sql()["numbering_dialects"])
    got = entry.queries()["numbering_dialects"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == sorted(want.fetchall(), key=lambda r: r[0])
