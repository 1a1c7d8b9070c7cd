import pytest

from graphloom.queries import ORACLE, QUERIES
from graphloom.sources import views

SF = "/root/testdata/sf0.001"


def test_all_orders(spark):
    assert views.edges(spark, SF, "all").count() == spark.read.parquet(f"{SF}/orders.parquet").count()
    assert QUERIES["edge_groups_all"](spark, SF).agg({"edge_count": "sum"}).first()[0] == views.edges(spark, SF, "all").count()


@pytest.mark.parametrize("name", ["reachable_all", "visibility_all", "subgraph_edges_all", "effective_orphans_all", "dead_code_by_file_blocks", "layers_blocks", "call_paths_blocks", "dot_lines_blocks"])
def test_queries_over_all_orders(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    want = con.execute(ORACLE[name])
    got = QUERIES[name](spark, SF).select(*[c[0] for c in want.description])
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, want.fetchall()))
