"""The registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from lectern.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        path = f"{DATA}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    found = queries.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    wanted = con.sql(queries.ORACLE_SQL[name])
    assert sorted(wanted.columns) == columns
    assert ordered(found.select(columns).collect()) == ordered(wanted.select(*map(duckdb.ColumnExpression, columns)).fetchall())


def test_all_operators_are_registered():
    assert [int(name[2:].split("_")[0]) for name in queries.QUERIES if name.startswith("op")] == list(range(1, 14))


#: Columns that a query's contract asks for; more may follow.
CONTRACTS = {
    "op1": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op2": "doc_id n_bytes n_tokens over_limit",
    "op3": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op4": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op5": "doc_id",
    "op6": "doc_id n_shingles component_id",
    "op7": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op8": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op9": "doc_id held_out lang_pred score",
    "op10": "page_id url text n_chars",
    "op11": "doc_id held_out score predicted",
    "op12": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op13": "word form root n n_near form_n",
}
DOUBLES = {"base_score", "score"}


@pytest.mark.parametrize("name", [x for x in queries.QUERIES if x.startswith("op")])
def test_query_gives_every_row_and_column(spark, name):
    """Every query over its whole table: a row for each document or page, of the types that its contract names."""
    found = queries.QUERIES[name](spark, DATA)
    kinds = dict(found.dtypes)
    asked = CONTRACTS[name.split("_")[0]].split()
    assert set(asked) <= set(kinds)
    for column in asked:
        text = column.endswith("sha256") or column in ("lang_pred", "text", "url", "word", "form", "root")
        flag = column in ("contaminated", "over_limit", "held_out", "base_failed", "kept")
        assert kinds[column] == ("string" if text else "boolean" if flag else "double" if column in DOUBLES else "int" if column == "predicted" else "bigint")
    if "doc_id" in asked or "page_id" in asked:
        table, key = ("documents", "doc_id") if "doc_id" in asked else ("pages", "page_id")
        wanted = [r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect()]
        assert sorted(r[0] for r in found.select(key).collect()) == sorted(wanted)
    else:
        assert found.count() > 0
