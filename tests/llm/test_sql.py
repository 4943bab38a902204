"""The registered queries against their SQL."""

import glob
import os

import duckdb
import pytest

from loomseek.llm import queries

SF = "/root/testdata/sf0.001"


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def same(got, con, sql):
    columns = sorted(got.columns)
    rows = con.execute(sql)
    at = [[d[0] for d in rows.description].index(c) for c in columns]
    return sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in rows.fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    assert same(queries.QUERIES[name](spark, SF), con, queries.ORACLE[name])


def test_odd_conversations_equal_sql(spark, tmp_path):
    import itertools

    roles = ("system", "user", "assistant", None, "Human", "odd")
    rows = [(k, i, r, f"t{i}" if i % 2 else None) for k, own in enumerate(itertools.product(roles, repeat=4)) for i, r in enumerate(own)]
    rows += [(None, 0, "user", "n"), (None, None, None, "<|im_end|>"), (5000, 1, "user", "x"), (5000, 1, "user", "x"), (5000, 1, "assistant", "x"), (5000, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert same(queries.QUERIES["op3_chat_format"](spark, str(tmp_path)), con, queries.ORACLE["op3_chat_format"])


def test_odd_documents_equal_sql(spark, tmp_path):
    rows = [(1, "a b c d\n\nrepeated\nx"), (2, "a b c d\nrepeated\n\nx"), (3, None), (3, None), (None, "a b c d\nrepeated"), (4, ""), (5, ""), (6, "..."), (6, "..."), (7, "one two"), (7, "One, two!"), (8, "\n"), (9, "é z\nrepeated\nrepeated")]
    spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("op6_ngram_jaccard", "op8_exact_dedup", "op10_line_dedup"):
        assert same(queries.QUERIES[name](spark, str(tmp_path)), con, queries.ORACLE[name]), name
