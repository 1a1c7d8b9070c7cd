"""Graph views over the supplied tables: customers are nodes, orders are edges.

nodes: id, node_seq, name, kind, file_path. edges: edge_seq, src, dst, kind. The same SQL text serves both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NODES = """select c_custkey id, c_custkey node_seq, c_name name,
       case c_mktsegment when 'BUILDING' then 'function' when 'AUTOMOBILE' then 'class' when 'FURNITURE' then 'interface'
                         when 'MACHINERY' then 'typeAlias' else 'module' end kind,
       concat(case c_nationkey when 4 then 'tests/' when 9 then 'lib/fixtures/' when 14 then 'mocks/' when 19 then 'src/__mocks__/' when 24 then 'src/__tests__/' else 'src/' end,
              'n', cast(c_nationkey as varchar(9)), case c_nationkey when 5 then '.fixture' when 6 then '.mock' when 7 then '.spec' else '' end, '.ts') file_path
from {customer}"""

_EDGES = """select o_orderkey edge_seq, o_custkey src, cast({dst} % (select count(*) from {{customer}}) as bigint) dst,
       case o_orderpriority when '1-URGENT' then 'call' when '2-HIGH' then 'import' when '3-MEDIUM' then 'references' else 'inherits' end kind
from {{orders}} where {where}"""

EDGES = {
    "sparse": _EDGES.format(dst="(o_custkey * 7 + o_orderkey % 2)", where="o_orderstatus = 'P'"),
    "dense": _EDGES.format(dst="(o_custkey * 7 + o_orderkey)", where="o_orderstatus in ('P', 'O')"),
    "all": _EDGES.format(dst="(o_custkey * 7 + o_orderkey)", where="true"),
    # over all orders too, but mostly forwards inside blocks of ten customers: many components, orphans, dead code, layers, and cycles in some blocks
    "blocks": _EDGES.format(dst="(case when o_orderkey % 97 = 0 then o_custkey - o_custkey % 10 else least(o_custkey - o_custkey % 10 + 9, o_custkey + 1 + o_orderkey % 3) end)", where="true"),
    "thin": _EDGES.format(dst="(o_custkey * 7 + o_orderkey % 2)", where="o_orderstatus = 'P' and o_orderpriority = '1-URGENT' and o_totalprice < 120000"),
}
ENTRY_FILE = "src/n0.ts"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(NODES, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


def edges(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    return spark.sql(EDGES[view], customer=spark.read.parquet(f"{sf_dir}/customer.parquet"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def duck(view: str | None, body: str) -> str:
    """body, a list of common table expressions and a SELECT, over tables n (nodes) and e (edges of the view)."""
    names = {"customer": "customer", "orders": "orders"}
    tables = f"n as ({NODES.format(**names)})" + (f", e as ({EDGES[view].format(**names)})" if view else "")
    return f"with recursive {tables}{body}"
