"""The registered queries: names, contract columns and one row for each row asked for."""

import pytest

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: ["query_id", "rank", "vec_id", "score"],
    2: ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    3: ["doc_id", "n_words", "n_removed", "kept_sha256"],
    4: ["doc_id", "item_id", "n_tiles", "tiled", "item_tokens", "coverage"],
    5: ["page_id", "url", "text", "n_chars"],
    6: ["doc_id", "held_out", "lang_pred", "score"],
    7: ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    8: ["doc_id", "held_out", "score", "predicted"],
    9: ["doc_id", "n_shingles", "component_id"],
    10: ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    11: ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    12: ["page_id", "host", "path", "rule", "verdict"],
    13: ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
}


@pytest.fixture(scope="module")
def registered():
    import __spark_entry__

    return __spark_entry__.queries()


def test_every_operator_has_one_query(registered):
    assert "pipeline" in registered
    for n in COLUMNS:
        assert len([q for q in registered if q.startswith(f"op{n}_")]) == 1


@pytest.mark.parametrize("n", sorted(COLUMNS))
def test_contract_columns_and_rows(spark, registered, n):
    name = next(q for q in registered if q.startswith(f"op{n}_"))
    got = registered[name](spark, SF)
    assert set(COLUMNS[n]) <= set(got.columns)
    rows = got.collect()
    if n in (2, 3, 6, 7, 8, 9, 11):
        assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    if n in (5, 12):
        assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    if n == 1:
        ids = [r["vec_id"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()]
        assert len(rows) == 20 * sum(1 for i in ids if i % 20 == 0)
