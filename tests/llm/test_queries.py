"""The opN queries against their SQL, and their columns where SQL can't express them."""

import pytest

from cellgrid.llm import queries

from ..duck import compare, tables

SF = "/root/testdata/sf0.01"
COLUMNS = {
    "op1_language_id": {"doc_id", "held_out", "lang_pred", "score"}, "op4_minhash_dedup": {"doc_id", "n_shingles", "component_id", "kept"},
    "op7_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}, "op10_html_extract": {"page_id", "url", "text", "n_chars"},
}


@pytest.fixture(scope="module")
def con():
    return tables(SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    compare(queries.queries()[name](spark, SF), con, queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_returns_a_row_for_each_row(spark, con, name):
    assert name not in queries.oracle_sql()
    got = queries.queries()[name](spark, SF)
    key, whole = ("page_id", "pages") if "page_id" in COLUMNS[name] else ("doc_id", "documents")
    assert set(got.columns) == COLUMNS[name]
    assert sorted(r[0] for r in got.select(key).collect()) == sorted(r[0] for r in con.execute(f"SELECT {key} FROM {whole}").fetchall())


def test_names():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{n}" for n in range(1, 11)]
