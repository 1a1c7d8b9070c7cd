"""One query for each operator over the supplied tables, with the SQL that must give the same rows in DuckDB."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.functions import types as Y
from graphloom.operators import degree, duplicates, extract, filters, recursion
from graphloom.plans import report
from graphloom.plans.fixpoint import shared_folder
from graphloom.sources import graph_json, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def graph(spark: SparkSession, sf_dir: str, view: str) -> tuple[DataFrame, DataFrame]:
    return views.nodes(spark, sf_dir), views.edges(spark, sf_dir, view)


def entry_ids(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("file_path") == views.ENTRY_FILE).select("id")


def _matches(pattern: str) -> str:
    return f"regexp_matches(file_path, '{pattern.removeprefix('(?i)')}', 'i')"


_TEST = _matches(S.TEST_PATH)
_FAN = ", fi as (select dst id, count(*) c from e group by 1), fo as (select src id, count(*) c from e group by 1), f as (select n.id, coalesce(fi.c, 0) fan_in, coalesce(fo.c, 0) fan_out from n left join fi using (id) left join fo using (id))"
_REACH = f", r as (select id from n where file_path = '{views.ENTRY_FILE}' union select e.dst from r join e on e.src = r.id)"
_COMPONENTS = """, u as (select src a, dst b from e where src in (select id from n) and dst in (select id from n) union select dst, src from e where src in (select id from n) and dst in (select id from n)),
 w as (select a, b from u union select w.a, u.b from w join u on w.b = u.a),
 t as (select src id from e union select dst from e),
 comp as (select n.id, case when exists (select 1 from t where t.id = n.id) then least(n.id, coalesce((select min(b) from w where w.a = n.id), n.id)) end root from n)"""
_CLUSTERS = _COMPONENTS + f""",
 about as (select root, count(*) size, min(node_seq) first_seq, bool_or(file_path = '{views.ENTRY_FILE}') ep from comp join n using (id) where root is not null group by root),
 named as (select root, ep, row_number() over (partition by ep order by size desc, first_seq) k from about),
 cl as (select comp.id, case when comp.root is null then 'orphans' when ep then 'ep_' || (k - 1) else 'cmp_' || (k - 1) end cluster_id,
   case when comp.root is null then 'Orphaned' when ep and k = 1 then 'Entrypoint' when ep then 'Entrypoint ' || k else 'Component ' || k end as label,
   coalesce(ep, false) has_entrypoint, comp.root is null is_orphan from comp left join named using (root))"""


@query("fan_metrics", views.duck("sparse", _FAN + " select id, cast(fan_in as bigint) fan_in, cast(fan_out as bigint) fan_out from f"))
def fan_metrics(spark, sf):
    return degree.fan_metrics(*graph(spark, sf, "sparse"))


@query("overview_metrics", views.duck("sparse", _REACH + """ select count(*) total_nodes, count(*) filter (kind = 'function') function_count, count(*) filter (kind = 'class') class_count,
  count(*) filter (kind in ('typeAlias', 'interface')) type_count, count(*) filter (kind = 'module') module_count, (select count(*) from e) total_edges, (select count(*) from e where kind = 'call') call_edges,
  (select count(*) from e where kind = 'import') import_edges, (select count(*) from r) reachable_count, cast(1 as bigint) entrypoint_count, floor((select count(*) from r) / count(*) * 100 + 0.5) / 100 reachable_ratio from n"""))
def overview_metrics(spark, sf):
    n, e = graph(spark, sf, "sparse")
    return degree.overview(n, e, 1, recursion.reachable(e, entry_ids(n)))


@query("page_stats", views.duck("sparse", " select count(*) node_count, count(*) filter (kind = 'function') function_count, count(*) filter (kind = 'class') class_count, count(*) filter (kind = 'interface') interface_count, (select count(*) from e) edge_count from n"))
def page_stats(spark, sf):
    return degree.page_stats(*graph(spark, sf, "sparse"))


_GROUPS = ", g as (select src, dst, kind, count(*) c, min(edge_seq) s from e group by all), p as (select src, dst, cast(sum(c) over w as bigint) edge_count, first_value(kind) over (partition by src, dst order by c desc, s) dominant_kind, min(s) over w first_seq from g window w as (partition by src, dst)) select distinct src, dst, edge_count, dominant_kind, first_seq from p"


@query("edge_groups", views.duck("sparse", _GROUPS))
def edge_groups(spark, sf):
    return degree.edge_groups(views.edges(spark, sf, "sparse"))


@query("edge_groups_lineitem", "with recursive e as (select l_orderkey * 8 + l_linenumber edge_seq, l_partkey src, l_suppkey dst, l_returnflag kind from lineitem)" + _GROUPS)
def edge_groups_lineitem(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    return degree.edge_groups(rows.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("edge_seq"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("kind")))


def _side(me: str, other: str, names: str) -> str:
    return f"(select {me} module_id, count(*) c, array_to_string(list(name order by seq)[:8], ',') {names} from pairs join n on n.id = {other} group by 1)"


@query("module_coupling", views.duck("sparse", f""", m as (select file_path, arg_min(id, node_seq) mid from n where kind = 'module' group by 1), at_ as (select n.id, mid from n join m using (file_path)),
 pairs as (select x.mid a, y.mid b, min(edge_seq) seq from e join at_ x on x.id = src join at_ y on y.id = dst where kind = 'import' and x.mid <> y.mid group by 1, 2),
 ab as (select file_path, (count(*) filter (kind in ('interface', 'typeAlias'))) / count(*) ratio from n group by 1),
 j as (select coalesce(x.module_id, y.module_id) module_id, coalesce(x.c, 0) ca, coalesce(y.c, 0) ce, coalesce(dependents, '') dependents, coalesce(dependencies, '') dependencies from {_side('b', 'a', 'dependents')} x full join {_side('a', 'b', 'dependencies')} y using (module_id)),
 k as (select j.*, floor(ce / (ca + ce) * 100 + 0.5) / 100 instability, name, n.file_path, node_seq, ratio from j join n on n.id = module_id join ab using (file_path))
 select module_id, name, file_path, node_seq, cast(ca as bigint) ca, cast(ce as bigint) ce, instability, dependents, dependencies, case when instability <= 0.2 then (case when ratio >= 0.6 then 'stable-abstract' else 'stable-concrete' end) when instability >= 0.75 then 'unstable' else 'balanced' end verdict from k"""))
def module_coupling(spark, sf):
    return degree.module_coupling(*graph(spark, sf, "sparse"))


def _names(me: str, other: str, kinds: str) -> str:
    return f"coalesce((select array_to_string(list(coalesce(m.name, cast(e.{other} as varchar)) order by edge_seq)[:10], ',') from e left join n m on m.id = e.{other} where e.{me} = n.id and e.kind in ({kinds})), '')"


@query("god_nodes", views.duck("dense", _FAN + f""" select n.id, name, n.kind, file_path, node_seq, cast(fan_in as bigint) fan_in, cast(fan_out as bigint) fan_out, case when fan_out >= 15 or fan_in >= 18 then 'high' else 'medium' end severity,
 {_names('dst', 'src', "'call', 'import'")} callers, {_names('src', 'dst', "'call', 'import'")} callees from n join f using (id) where (fan_out >= 10 or fan_in >= 12) and kind <> 'module' and not {_TEST}"""))
def god_nodes(spark, sf):
    return degree.god_nodes(*graph(spark, sf, "dense"))


@query("hub_nodes", views.duck("dense", _FAN + f""", im as (select dst id, count(*) imports from e where kind = 'import' group by 1 having count(*) >= 4)
 select n.id, name, n.kind, file_path, node_seq, cast(fan_in as bigint) fan_in, cast(fan_out as bigint) fan_out, imports, {_names('dst', 'src', "'import'")} importers from n join f using (id) join im using (id) where fan_in >= 4 and kind <> 'module' order by fan_in desc, node_seq limit 15"""))
def hub_nodes(spark, sf):
    return degree.hub_nodes(*graph(spark, sf, "dense"))


# parts stand for functions: names by their first word and size, files by brand, signatures by type and size, bodies by the rounded price
_PARTS = "with f as (select p_partkey id, p_partkey node_seq, concat(split_part(p_name, ' ', 1), '_', cast(p_partkey % 97 as varchar)) as name, concat('src/', p_brand, '.ts') file_path, concat(p_type, ', ', cast(p_size as varchar)) as signature, cast(cast(floor(p_retailprice / 2) as bigint) as varchar) body from part)"
_A8 = ", a8 as (select 'identical-name' match_type, name signature, count(*) members, count(distinct file_path) files, min(node_seq) first_seq from f where name not in ('get', 'set') group by name having count(*) >= 2 and count(distinct file_path) >= 2)"
_A9 = ", a9 as (select 'identical-parameters' match_type, signature, count(*) members, count(distinct file_path) files, min(node_seq) first_seq from f group by signature having count(*) >= 2 and count(distinct file_path) >= 2 and count(distinct name) > 1)"
_A10 = ", cov as (select file_path, name from f where name in (select signature from a8) union select file_path, name from f where signature in (select signature from a9)), a10 as (select 'identical-body' match_type, body signature, count(*) members, count(distinct file_path) files, min(node_seq) first_seq from f left join (select *, 1 old from cov) using (file_path, name) group by body having count(*) >= 2 and count(distinct file_path) >= 2 and count(*) filter (old is null) >= 2)"


def _parts(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_partkey").alias("node_seq"), F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("_"), (F.col("p_partkey") % 97).cast("string")).alias("name"),
        F.concat(F.lit("src/"), "p_brand", F.lit(".ts")).alias("file_path"), F.concat("p_type", F.lit(", "), F.col("p_size").cast("string")).alias("signature"), F.floor(F.col("p_retailprice") / 2).cast("string").alias("body"),
    )


@query("dup_names", _PARTS + _A8 + " from a8 select *")
def dup_names(spark, sf):
    return duplicates.same_name(_parts(spark, sf))


@query("dup_signatures", _PARTS + _A9 + " from a9 select *")
def dup_signatures(spark, sf):
    return duplicates.same_signature(_parts(spark, sf))


@query("dup_bodies", _PARTS + _A8 + _A9 + ", cov as (select file_path, name from f where id % 3 = 0), a10 as (select 'identical-body' match_type, body signature, count(*) members, count(distinct file_path) files, min(node_seq) first_seq from f left join (select distinct *, 1 old from cov) using (file_path, name) group by body having count(*) >= 2 and count(distinct file_path) >= 2 and count(*) filter (old is null) >= 2) from a10 select *")
def dup_bodies(spark, sf):
    f = _parts(spark, sf)
    return duplicates.same_body(f, f.where("id % 3 = 0"))


@query("dup_merged", _PARTS + _A8 + _A9 + _A10 + ", al as (select *, 1 pass from a8 union all select *, 2 from a9 union all select *, 3 from a10) select * from al order by members desc, pass, first_seq limit 30")
def dup_merged(spark, sf):
    return duplicates.duplicates(_parts(spark, sf))


@query("dup_texts", "select 'identical-body' match_type, md5(text) signature, count(*) members, count(distinct source) files, min(doc_id) first_seq from documents group by md5(text) having count(*) >= 2 and count(distinct source) >= 2")
def dup_texts(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("node_seq"), F.col("doc_id").cast("string").alias("name"), F.col("source").alias("file_path"), F.md5("text").alias("body"))
    return duplicates.same_body(d, d.limit(0))


_SUB = ", s as (select id from n where id % 3 <> 0)"


@query("subgraph_nodes", views.duck("thin", _SUB + " select n.* from n semi join s using (id)"))
def subgraph_nodes(spark, sf):
    n, e = graph(spark, sf, "thin")
    return filters.subgraph(n, e, n.where("id % 3 <> 0"))[0]


@query("subgraph_edges", views.duck("thin", _SUB + " select * from e where src in (from s) and dst in (from s)"))
def subgraph_edges(spark, sf):
    n, e = graph(spark, sf, "thin")
    return filters.subgraph(n, e, n.where("id % 3 <> 0"))[1]


_CATEGORY = "case " + " ".join(f"when {_matches(p)} then '{name}'" for name, p in S.CATEGORIES) + " end"
_VISIBLE = f", hid as (select id from n where {_CATEGORY} is not null or kind = 'interface')"


#: Paths with what they are, by hand: path, category, whether a test's path.
PATHS = (
    ("src/latest.ts", None, False), ("src/a.test.ts", "tests", True), ("src/a.spec.tsx", "tests", True), ("test/a.ts", "tests", True), ("src/__tests__/a.ts", "tests", True), ("spec/a.js", "tests", True), ("src/contests/a.ts", None, False),
    ("lib/fixtures/a.ts", "fixtures", True), ("fixture/a.ts", "fixtures", True), ("src/a.fixture.ts", "fixtures", False), ("src/afixture.ts", None, False), ("mocks/a.ts", "mocks", False), ("src/mock/a.ts", "mocks", False),
    ("src/__mocks__/a.ts", "mocks", True), ("src/__mock__/a.ts", None, True), ("src/a.mock.jsx", "mocks", False), ("src/hammocks/a.ts", None, False), ("TESTS/A.TS", "tests", True), ("tests/fixtures/a.ts", "tests", True),
    ("fixtures/a.mock.ts", "fixtures", True), ("src\\tests\\a.ts", "tests", True), ("src/test.ts", None, False), ("src/a.test.py", None, False), ("mocks", None, False), ("", None, False),
)


def _sql(value) -> str:
    return "null" if value is None else str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _values(rows, names: str) -> str:
    """Rows as literals, numbered from 0, joined with the nations of these numbers."""
    return "select n_nationkey, x.* exclude (k) from (values " + ", ".join("(" + ", ".join(map(_sql, (k, *r))) + ")" for k, r in enumerate(rows)) + f") x(k, {names}) join nation on n_nationkey = k"


def _nations(spark, sf, rows, schema: str) -> DataFrame:
    given = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + schema)
    return spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey").join(F.broadcast(given), F.col("n_nationkey") == F.col("k")).drop("k")


@query("file_category", _values(PATHS, "file_path, category, is_test"))
def file_category(spark, sf):
    return _nations(spark, sf, [r[:1] for r in PATHS], "file_path string").select("n_nationkey", "file_path", S.file_category(F.col("file_path")).alias("category"), S.is_test_path(F.col("file_path")).alias("is_test"))


@query("file_category_nodes", views.duck(None, f" select id, file_path, {_CATEGORY} category, {_TEST} is_test from n"))
def file_category_nodes(spark, sf):
    return views.nodes(spark, sf).select("id", "file_path", S.file_category(F.col("file_path")).alias("category"), S.is_test_path(F.col("file_path")).alias("is_test"))


@query("visibility", views.duck("thin", _VISIBLE + " select * from e where src not in (from hid) and dst not in (from hid)"))
def visibility(spark, sf):
    return filters.visible(*graph(spark, sf, "thin"), hidden_kinds=("interface",))[1]


@query("visible_nodes", views.duck("thin", _VISIBLE + " select * from n where id not in (from hid)"))
def visible_nodes(spark, sf):
    return filters.visible(*graph(spark, sf, "thin"), hidden_kinds=("interface",))[0]


@query("effective_orphans", views.duck("thin", _VISIBLE + """, v as (select id from n where id not in (from hid)), en as (select src id, dst other from e union all select dst, src from e)
 select n.* from n where id in (from v) and id in (select id from en) and id not in (select id from en where other in (from v))"""))
def effective_orphans(spark, sf):
    n, e = graph(spark, sf, "thin")
    shown, _ = filters.visible(n, e, hidden_kinds=("interface",))
    return filters.effective_orphans(n, degree.edge_groups(e), shown)


@query("node_summaries", views.duck(None, " select id, kind, name, file_path from n"))
def node_summaries(spark, sf):
    return filters.summaries(views.nodes(spark, sf))


@query("node_edges", views.duck("sparse", " select *, 'out' direction from e where src = 7 union all select *, 'in' from e where dst = 7"))
def node_edges(spark, sf):
    return filters.node_edges(views.edges(spark, sf, "sparse"), 7)


@query("edges_between", views.duck("sparse", " select * from e where src = 7 and dst = (select min(dst) from e where src = 7)"))
def edges_between(spark, sf):
    e = views.edges(spark, sf, "sparse")
    return filters.edges_between(e, 7, e.where("src = 7").agg(F.min("dst")).first()[0])


_WANTED = ", wanted as (select cast(doc_id as varchar) file_path, 2 target from documents), lines as (select cast(doc_id as varchar) file_path, unnest(string_split(text, chr(10))) content, unnest(range(1, len(string_split(text, chr(10))) + 1)) line from documents), win as (select file_path, target, line, content from lines join wanted using (file_path) where abs(line - target) <= 1)"


def _window(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("file_path"), "text")
    return filters.source_window(d, d.select("file_path", F.lit(2).alias("line")), 1)


@query("source_window", "with x as (select 1)" + _WANTED + " select file_path, target, cast(line as int) line, content from win")
def source_window(spark, sf):
    return _window(spark, sf)


@query("source_text", "with x as (select 1)" + _WANTED + " select file_path, target, string_agg(case when line = target then '→' else ' ' end || ' ' || case when length(cast(line as varchar)) < 4 then lpad(cast(line as varchar), 4, ' ') else cast(line as varchar) end || ' | ' || content, chr(10) order by line) listing from win group by 1, 2")
def source_text(spark, sf):
    return filters.source_text(_window(spark, sf))


@query("entrypoint_nodes", views.duck(None, " select * from n where file_path in ('src/n0.ts', 'src/n3.ts', 'src/n10.ts')"))
def entrypoint_nodes(spark, sf):
    entries = spark.createDataFrame([("./src/n0.ts",), ("/p/src/x/../n3.ts",), ("src//n10.ts",), ("src/none.ts",)], "path string")
    return filters.entrypoint_nodes(views.nodes(spark, sf), entries, "/p")


@query("reachable", views.duck("sparse", _REACH + " from r select id"))
def reachable(spark, sf):
    n, e = graph(spark, sf, "sparse")
    return recursion.reachable(e, entry_ids(n))


@query("dead_code", views.duck("thin", _FAN + _REACH + f" select n.id, kind, name, file_path, case when fan_in = 0 then 'unreferenced' else 'referenced by dead code only' end reason from n join f using (id) where kind <> 'module' and not {_TEST} and n.id not in (select id from r)"))
def dead_code(spark, sf):
    n, e = graph(spark, sf, "thin")
    return recursion.dead_code(n, e, entry_ids(n))


@query("dead_code_by_file", views.duck("thin", _FAN + _REACH + f", d as (select file_path, name from n where kind <> 'module' and not {_TEST} and id not in (select id from r) order by file_path, name limit 40) select file_path, count(*) entries, string_agg(name, ',' order by name) as names from d group by 1"))
def dead_code_by_file(spark, sf):
    n, e = graph(spark, sf, "thin")
    return degree.by_file(recursion.dead_code(n, e, entry_ids(n)), [F.col("file_path"), F.col("name")])


for _view in ("sparse", "thin"):

    @query(f"components_{_view}", views.duck(_view, _COMPONENTS + " from comp select id, coalesce(root, -1) root"))
    def components(spark, sf, view=_view):
        return recursion.components(*graph(spark, sf, view)).fillna(-1, "root")

    @query(f"clusters_{_view}", views.duck(_view, _CLUSTERS + " from cl select *"))
    def clusters(spark, sf, view=_view):
        n, e = graph(spark, sf, view)
        return recursion.clusters(n, e, entry_ids(n))


def _clusters(spark, sf, view="thin"):
    n, e = graph(spark, sf, view)
    return recursion.clusters(n, e, entry_ids(n))


@query("cluster_summary", views.duck("thin", _CLUSTERS + " select cluster_id, label, has_entrypoint, is_orphan, count(*) node_count from cl group by all"))
def cluster_summary(spark, sf):
    return degree.cluster_summary(_clusters(spark, sf))


@query("initial_scope", views.duck("thin", _CLUSTERS + " select * from cl where has_entrypoint or not exists (select 1 from cl where has_entrypoint)"))
def initial_scope(spark, sf):
    return filters.initial_scope(_clusters(spark, sf))


@query("cluster_select", views.duck("thin", _CLUSTERS + " select * from cl where cluster_id in ('ep_0', 'cmp_1')"))
def cluster_select(spark, sf):
    return filters.selected_clusters(_clusters(spark, sf), " ep_0, cmp_1,,nothing")


def _strong(kind: str) -> str:
    return f""", c as (select distinct src a, dst b from e where kind = '{kind}' and src <> dst), cl as (select a, b from c union select cl.a, c.b from cl join c on cl.b = c.a),
 sc as (select x.a node, least(x.a, min(x.b)) root from cl x join cl y on x.a = y.b and x.b = y.a where x.a <> x.b group by x.a),
 k as (select sc.*, n.name, file_path, node_seq, row_number() over (partition by root order by node_seq, node) k, count(*) over (partition by root) length from sc left join n on n.id = node)
 select root, length, string_agg(cast(node as varchar), ',' order by k) ids, string_agg(coalesce(name, cast(node as varchar)), ',' order by k) as names,
 (select string_agg(f2, ',' order by m) from (select z.file_path f2, min(z.k) m from k z where z.root = k.root and z.k <= 10 and z.file_path is not null group by 1)) files from k where k <= 10 group by root, length"""


for _name, _view, _kind in (("import_cycles", "sparse", "import"), ("call_cycles", "sparse", "call"), ("call_cycles_dense", "dense", "call")):

    @query(_name, views.duck(_view, _strong(_kind)))
    def cycles(spark, sf, view=_view, kind=_kind):
        return recursion.cycles(*graph(spark, sf, view), kind)


_LAYERED = _CLUSTERS + """, ie as (select distinct src, dst from e join cl x on x.id = src join cl y on y.id = dst where src <> dst and x.cluster_id = y.cluster_id),
 lp as (select id, 0 layer from cl where not is_orphan and id not in (select dst from ie) union select ie.dst, layer + 1 from lp join ie on ie.src = lp.id where layer < 60),
 lay as (select id, cluster_id, cast(max(layer) as bigint) layer from lp join cl using (id) group by all)"""
_LAYERS = _LAYERED + " from lay select *"


@query("layers", views.duck("thin", _LAYERS))
def layers(spark, sf):
    n, e = graph(spark, sf, "thin")
    return recursion.layers(n, e, _clusters(spark, sf))


_CYCLIC = _CLUSTERS + """, ie as (select distinct src, dst from e join cl x on x.id = src join cl y on y.id = dst where src <> dst and x.cluster_id = y.cluster_id),
 tc as (select src a, dst b from ie union select tc.a, ie.dst from tc join ie on tc.b = ie.src), cyc as (select a from tc where a = b), bound as (select a id from cyc union select b from tc where a in (from cyc)),
 lp as (select id, 0 layer from cl where not is_orphan and id not in (from bound) and id not in (select dst from ie) union select ie.dst, layer + 1 from lp join ie on ie.src = lp.id where ie.dst not in (from bound)),
 fr as (select id, max(layer) layer from lp group by id), known as (from fr union all select dst, max(layer) + 1 from ie join fr on src = fr.id where dst in (from bound) group by dst),
 last as (select cluster_id, max(layer) l from known join cl using (id) group by 1)
 select id, cluster_id, cast(coalesce(layer, coalesce(l, 0) + 1) as bigint) layer from cl left join known using (id) left join last using (cluster_id) where not is_orphan"""


@query("layers_cyclic", views.duck("sparse", _CYCLIC))
def layers_cyclic(spark, sf):
    n, e = graph(spark, sf, "sparse")
    return recursion.layers(n, e, _clusters(spark, sf, "sparse"))


def _paths(target: int) -> str:
    return f""", c as (select * from e where kind = 'call'), p as (select [cast({target} as bigint)] path, cast([] as bigint[]) ord union all select list_prepend(src, path), list_append(ord, edge_seq) from p join c on c.dst = path[1] where not list_contains(path, src) and len(path) < 11),
 leaf as (select path, ord from p where len(path) <= 10 and not exists (select 1 from c where c.dst = path[1] and not list_contains(path, src)))
 select row_number() over (order by ord) place, array_to_string(path, '>') as path, (select count(*) from leaf) > 25 or exists (select 1 from p where len(path) = 11) truncated from leaf order by ord limit 25"""


for _name, _view, _target in (("call_paths", "sparse", 7), ("call_paths_many", "dense", 397)):

    @query(_name, views.duck(_view, _paths(_target)))
    def call_paths(spark, sf, view=_view, target=_target):
        return recursion.call_paths(views.edges(spark, sf, view), target)


@query("k_hop", views.duck("sparse", """, o as (select 7 id, 0 depth union select dst, depth + 1 from o join e on src = id where depth < 3), i as (select 7 id, 0 depth union select src, depth + 1 from i join e on dst = id where depth < 3)
 select cast(id as bigint) id, 'out' direction, cast(min(depth) as int) as depth from o where id <> 7 group by id union all select cast(id as bigint), 'in', cast(min(depth) as int) from i where id <> 7 group by id"""))
def k_hop(spark, sf):
    return recursion.k_hop(views.edges(spark, sf, "sparse"), 7, 3)


@query("k_hop_far", views.duck("sparse", ORACLE["k_hop"].split(", o as ")[1].replace("depth < 3", "depth < 10").join([", o as ", ""])))
def k_hop_far(spark, sf):
    return recursion.k_hop(views.edges(spark, sf, "sparse"), 7, 10)


# the loops that large graphs take, whatever the size here


@query("reachable_loop", ORACLE["reachable"])
def reachable_loop(spark, sf):
    n, e = graph(spark, sf, "sparse")
    return recursion.reachable(e, entry_ids(n), small=False)


@query("components_loop", ORACLE["components_sparse"])
def components_loop(spark, sf):
    return recursion.components(*graph(spark, sf, "sparse"), small=False).fillna(-1, "root")


@query("clusters_loop", ORACLE["clusters_thin"])
def clusters_loop(spark, sf):
    n, e = graph(spark, sf, "thin")
    return recursion.clusters(n, e, entry_ids(n), small=False)


@query("cycles_loop", ORACLE["call_cycles"])
def cycles_loop(spark, sf):
    return recursion.cycles(*graph(spark, sf, "sparse"), "call", small=False)


@query("layers_loop", ORACLE["layers"])
def layers_loop(spark, sf):
    n, e = graph(spark, sf, "thin")
    return recursion.layers(n, e, _clusters(spark, sf), small=False)


@query("layers_cyclic_loop", ORACLE["layers_cyclic"])
def layers_cyclic_loop(spark, sf):
    n, e = graph(spark, sf, "sparse")
    return recursion.layers(n, e, _clusters(spark, sf, "sparse"), small=False)


@query("edge_ids", views.duck("sparse", r", g as (select distinct src, dst from e) select src, dst, replace(replace(rtrim(to_base64(cast(src as varchar)::blob || '\x00'::blob || cast(dst as varchar)::blob), '='), '+', '-'), '/', '_') edge_id from g"))
def edge_ids(spark, sf):
    e = views.edges(spark, sf, "sparse").select("src", "dst").distinct()
    return e.withColumn("edge_id", S.edge_id(F.col("src"), F.col("dst")))


@query("round2", "select p_partkey, floor(p_size / 7 * 100 + 0.5) / 100 r, case when length(p_name) > 10 then left(p_name, 7) || '…' else p_name end short_name from part")
def round2(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select("p_partkey", S.round2(F.col("p_size") / 7).alias("r"), S.ellipsis(F.col("p_name"), 10).alias("short_name"))


@query("djb2_hash", "select c_custkey, printf('%08x', list_reduce(list_prepend(cast(5381 as bigint), list_transform(string_split(c_name, ''), lambda x: cast(ascii(x) as bigint))), lambda h, c: xor((h * 33) & 4294967295, c))) h from customer")
def djb2_hash(spark, sf):
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", S.djb2(F.col("c_name")).alias("h"))


_UNION = "{\"kind\":\"union\",\"members\":[{\"kind\":\"primitive\",\"name\":\"string\"},{\"kind\":\"literal\",\"value\":\"%s\"},{\"kind\":\"array\",\"elementType\":{\"kind\":\"primitive\",\"name\":\"number\"}}]}"


def _type_rows(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select("p_partkey", F.format_string(_UNION, "p_brand").alias("t"))


@query("canonical_types", "select p_partkey, '\"' || p_brand || '\" | number[] | string' canonical, 'string | \"' || p_brand || '\" | number[]' readable from part")
def canonical_types(spark, sf):
    return _type_rows(spark, sf).select("p_partkey", Y.canonical_type(F.col("t")).alias("canonical"), Y.readable_type(F.col("t")).alias("readable"))


@query("form_fields", "select p_partkey, '{\"kind\": \"text\", \"name\": \"value\", \"label\": \"value (one of: ' || p_brand || ', string)\", \"required\": true}' field from part")
def form_fields(spark, sf):
    return _type_rows(spark, sf).select("p_partkey", Y.form_field(F.col("t")).alias("field"))


_STRING, _NUMBER = ({"kind": "primitive", "name": x} for x in ("string", "number"))


def _property(name: str, t: dict, optional: bool = False) -> dict:
    return {"name": name, "typeInfo": t, "isOptional": optional, "isReadonly": False}


#: Every kind of type expression with its canonical and readable text and its form field, by hand.
TYPES = (
    (_NUMBER, "number", "number", '{"kind": "number", "name": "value", "label": "value", "required": true}'),
    ({"kind": "literal", "value": "a"}, '"a"', '"a"', '{"kind": "select", "name": "value", "label": "value", "required": true, "options": ["a"]}'),
    ({"kind": "array", "elementType": _STRING}, "string[]", "string[]", '{"kind": "textarea", "name": "value", "label": "value (JSON array)", "required": true}'),
    ({"kind": "tuple", "elements": [_STRING, _NUMBER]}, "[string, number]", "[string, number]", '{"kind": "textarea", "name": "value", "label": "value (JSON tuple array)", "required": true}'),
    ({"kind": "union", "members": [{"kind": "literal", "value": x} for x in ("b", "a")]}, '"a" | "b"', '"b" | "a"', '{"kind": "select", "name": "value", "label": "value", "required": true, "options": ["b", "a"]}'),
    ({"kind": "union", "members": [_STRING, _NUMBER]}, "number | string", "string | number", '{"kind": "text", "name": "value", "label": "value (string | number)", "required": true}'),
    ({"kind": "union", "members": [_STRING, {"kind": "array", "elementType": _NUMBER}]}, "number[] | string", "string | number[]", '{"kind": "textarea", "name": "value", "label": "value (union — enter JSON)", "required": true}'),
    (
        {"kind": "intersection", "members": [{"kind": "object", "properties": [_property("a", _STRING)]}, {"kind": "reference", "name": "Named", "typeArguments": []}]}, "Named & { a: string }", "{ a: string } & Named",
        '{"kind": "fieldset", "name": "value", "label": "value", "required": true, "fields": [{"kind": "text", "name": "value.a", "label": "a", "required": true}, {"kind": "text", "name": "value._part1", "label": "value (part 2) (Named — enter JSON)", "required": true}]}',
    ),
    (
        {"kind": "object", "properties": [_property("b", _NUMBER, True), _property("a", _STRING)]}, "{ a: string; b?: number }", "{ b?: number, a: string }",
        '{"kind": "fieldset", "name": "value", "label": "value", "required": true, "fields": [{"kind": "number", "name": "value.b", "label": "b", "required": false}, {"kind": "text", "name": "value.a", "label": "a", "required": true}]}',
    ),
    ({"kind": "reference", "name": "Map", "typeArguments": [_STRING, _NUMBER]}, "Map<string, number>", "Map<string, number>", '{"kind": "text", "name": "value", "label": "value (Map — enter JSON)", "required": true}'),
    ({"kind": "function", "parameters": [{"name": "x", "typeInfo": _STRING, "isOptional": False, "isRest": False}], "returnType": {"kind": "primitive", "name": "void"}}, "(x: string) => void", "(x: string) => void", '{"kind": "textarea", "name": "value", "label": "value (function — enter JSON or arrow expression)", "required": true}'),
    ({"kind": "unknown", "raw": "T[K]"}, "T[K]", "T[K]", '{"kind": "textarea", "name": "value", "label": "value (T[K] — enter JSON)", "required": true}'),
)


@query("type_kinds", _values([r[1:] for r in TYPES], "canonical, readable, field"))
def type_kinds(spark, sf):
    t = F.col("t")
    return _nations(spark, sf, [(json.dumps(r[0]),) for r in TYPES], "t string").select("n_nationkey", Y.canonical_type(t).alias("canonical"), Y.readable_type(t).alias("readable"), Y.form_field(t).alias("field"))


_PARAMETERS = '[{"name":"a","typeInfo":{"kind":"array","elementType":{"kind":"primitive","name":"%s"}},"isOptional":false,"isRest":false},{"name":"b","typeInfo":{"kind":"literal","value":"%s"},"isOptional":true,"isRest":false}]'


@query("signatures", """select p_partkey, case p_size % 2 when 0 then 'string' else 'number' end || '[], "' || p_brand || '"' signature,
 '{"functionId": "f", "functionName": "f", "fields": [{"kind": "textarea", "name": "a", "label": "a (JSON array)", "required": true}, {"kind": "select", "name": "b", "label": "b", "required": false, "options": ["' || p_brand || '"]}]}' form from part""")
def signatures(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").withColumn("p", F.format_string(_PARAMETERS, F.when(F.col("p_size") % 2 == 0, "string").otherwise("number"), "p_brand"))
    return p.select("p_partkey", Y.parameter_signature(F.col("p")).alias("signature"), Y.function_form(F.lit("f"), F.lit("f"), F.col("p")).alias("form"))


@query("body_classes", "select p_partkey id, min(p_partkey) over (partition by p_brand) first_alike from part")
def body_classes(spark, sf):
    """Functions that differ in names and literals, and in the brand that they call: equal structural hashes, equal brands."""
    k, brand = F.col("p_partkey").cast("string"), F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_")
    text = F.concat(F.lit("function f"), k, F.lit("(a"), k, F.lit(", b) {\n  const c"), k, F.lit(" = a"), k, F.lit(" + "), k, F.lit("; // "), k, F.lit("\n  return "), brand, F.lit("(c"), k, F.lit(", '"), k, F.lit("', b);\n}\n"))
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.concat(F.lit("p"), k, F.lit(".ts")).alias("file_path"), text.alias("text"))
    alike = extract.bodies(p).select(F.regexp_extract("id", r"^p(\d+)\.ts#", 1).cast("long").alias("id"), "body")
    first = alike.groupBy("body").agg(F.min("id").alias("first_alike"))
    return alike.join(first, "body").select("id", "first_alike")


def _sources(spark, sf) -> DataFrame:
    """One made file a customer, each importing and calling the next customer's."""
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey")
    k = F.col("c_custkey").cast("string")
    n = ((F.col("c_custkey") + 1) % F.lit(c.count())).cast("string")
    text = F.concat(F.lit("import { f"), n, F.lit(" } from './c"), n, F.lit(".js';\nexport interface I"), k, F.lit(" { a: string }\nclass K"), k, F.lit(" implements I"), k, F.lit(" { a = ''; }\nexport function f"), k, F.lit("(x: I"), k, F.lit("): number {\n  return f"), n, F.lit("(x);\n}\n"))
    return c.select(F.concat(F.lit("src/c"), k, F.lit(".ts")).alias("file_path"), text.alias("text"))


_SOURCES = "with m as (select count(*) m from customer), c as (select c_custkey k, (c_custkey + 1) % m n, 'src/c' || c_custkey || '.ts#' p, 'src/c' || ((c_custkey + 1) % m) || '.ts#' q from customer, m) "


@query("extract_nodes", _SOURCES + "select p || 'module:c' || k id, 'module' kind, 'c' || k as name, 0 line, true is_exported from c union all select p || 'interface:I' || k, 'interface', 'I' || k, 2, true from c union all select p || 'class:K' || k, 'class', 'K' || k, 3, false from c union all select p || 'function:f' || k, 'function', 'f' || k, 4, true from c")
def extract_nodes(spark, sf):
    return extract.declarations(_sources(spark, sf)).select("id", "kind", "name", "line", "is_exported")


@query("extract_edges", _SOURCES + "select 'import' kind, p || 'module:c' || k src, q || 'module:c' || n dst, cast(null as int) line, 'f' || n as names from c union all select 'inherits', p || 'class:K' || k, p || 'interface:I' || k, null, null from c union all select 'references', p || 'function:f' || k, p || 'interface:I' || k, null, null from c union all select 'call', p || 'function:f' || k, q || 'function:f' || n, 5, null from c")
def extract_edges(spark, sf):
    return extract.edges(_sources(spark, sf)).select("kind", "src", "dst", "line", F.array_join("imported_names", ",").alias("names"))


#: Four files a customer @k, whose next is @n: a class and a function behind two re-exports under other names, and uses of them that a name alone doesn't tell.
_WORKSHOP = {
    "lib/g@k.ts": "import { Gear@n } from './g@n';\nexport type Size = 'small' | 'large' | @k;\nexport class Gear@k {\n  teeth = @k;\n  constructor(private next: Gear@n) {}\n  turn(by: number) { return by > 2 ? 'small' : 'large'; }\n  other() { return this.next; }\n}\nexport function weigh(x: number, size?: Size) { return x * @k; }\n",
    "hub/h@k.ts": "export { weigh as measure, Gear@k as Cog } from '../lib/g@k';\n",
    "hub/i@k.ts": "export * from './h@k';\n",
    "app/a@k.ts": "import { measure as size, Cog } from '../hub/i@k.js';\nexport function shadow(size: (n: number) => string) { return size(@k); }\nexport function far() { return size(@k); }\nexport function typed(g: Cog, list: Cog[]) {\n  list[0].other();\n  return g.other().turn(1);\n}\nexport const later = async () => typed;\nexport async function made() { const c = new Cog(null); { const size = c; size.turn(2); } return c; }\n",
}


def _workshop(spark, sf) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey")
    k, n = F.col("c_custkey").cast("string"), ((F.col("c_custkey") + 1) % F.lit(c.count())).cast("string")
    filled = lambda x: F.replace(F.replace(x, F.lit("@k"), k), F.lit("@n"), n)
    files = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(t).alias("t")) for p, t in _WORKSHOP.items()]))
    return c.withColumn("f", files).select(filled(F.col("f.p")).alias("file_path"), filled(F.col("f.t")).alias("text"))


#: Caller, called, line.
_WORKSHOP_CALLS = [
    ("app/a@k.ts#function:far", "lib/g@k.ts#function:weigh", 3), ("app/a@k.ts#function:typed", "lib/g@k.ts#function:Gear@k.other", 5), ("app/a@k.ts#function:typed", "lib/g@k.ts#function:Gear@k.other", 6),
    ("app/a@k.ts#function:typed", "lib/g@n.ts#function:Gear@n.turn", 6), ("app/a@k.ts#function:made", "lib/g@k.ts#function:Gear@k.turn", 9),
]
_SIZES = '{"kind": "literal", "value": "small"}, {"kind": "literal", "value": "large"}'
_NUMBER = '{"kind": "primitive", "name": "number"}'
_GEAR = '{"kind": "reference", "name": "Gear%s", "typeArguments": []}'
_GIVEN = '"isOptional": false, "isRest": false}'
_TYPED = f'{{"name": "g", "typeInfo": {_GEAR % "@k"}, {_GIVEN}, {{"name": "list", "typeInfo": {{"kind": "array", "elementType": {_GEAR % "@k"}}}, {_GIVEN}'
#: Name, file, line, column, whether it is async, parameters, what it returns.
_WORKSHOP_DOCS = [
    ("weigh", "lib/g@k.ts", 9, 1, "false", f'{{"name": "x", "typeInfo": {_NUMBER}, {_GIVEN}, {{"name": "size", "typeInfo": {{"kind": "union", "members": [{_SIZES}, {{"kind": "literal", "value": @k}}]}}, "isOptional": true, "isRest": false}}', _NUMBER),
    ("Gear@k.constructor", "lib/g@k.ts", 5, 3, "false", f'{{"name": "next", "typeInfo": {_GEAR % "@n"}, {_GIVEN}', '{"kind": "primitive", "name": "void"}'),
    ("Gear@k.turn", "lib/g@k.ts", 6, 3, "false", f'{{"name": "by", "typeInfo": {_NUMBER}, {_GIVEN}', f'{{"kind": "union", "members": [{_SIZES}]}}'),
    ("Gear@k.other", "lib/g@k.ts", 7, 3, "false", "", _GEAR % "@n"),
    ("shadow", "app/a@k.ts", 2, 1, "false", f'{{"name": "size", "typeInfo": {{"kind": "function", "parameters": [{{"name": "n", "typeInfo": {_NUMBER}, {_GIVEN}], "returnType": {{"kind": "primitive", "name": "string"}}}}, {_GIVEN}', '{"kind": "primitive", "name": "string"}'),
    ("far", "app/a@k.ts", 3, 1, "false", "", _NUMBER),
    ("typed", "app/a@k.ts", 4, 1, "false", _TYPED, f'{{"kind": "union", "members": [{_SIZES}]}}'),
    ("later", "app/a@k.ts", 8, 14, "true", "", f'{{"kind": "reference", "name": "Promise", "typeArguments": [{{"kind": "function", "parameters": [{_TYPED}], "returnType": {{"kind": "union", "members": [{_SIZES}]}}}}]}}'),
    ("made", "app/a@k.ts", 9, 1, "true", "", f'{{"kind": "reference", "name": "Promise", "typeArguments": [{_GEAR % "@k"}]}}'),
]
_FILLED = "replace(replace({}, '@k', k::varchar), '@n', n::varchar)"


@query("extract_calls", _SOURCES + f"select {_FILLED.format('src')} src, {_FILLED.format('dst')} dst, line from c, (values {', '.join(map(str, _WORKSHOP_CALLS))}) v(src, dst, line)")
def extract_calls(spark, sf):
    """Calls through shadowed names, re-exports, receivers and inferred types."""
    return extract.edges(_workshop(spark, sf)).where("kind = 'call'").select("src", "dst", "line")


@query("extract_docs", _SOURCES + f"""select {_FILLED.format("f || '#function:' || nm")} id, {_FILLED.format("'{{\"kind\": \"function\", \"id\": \"' || f || '#function:' || nm || '\", \"name\": \"' || nm || '\", \"filePath\": \"' || f || '\", \"line\": ' || l || ', \"column\": ' || col || ', \"isExported\": true, \"isAsync\": ' || a || ', \"parameters\": [' || ps || '], \"returnType\": ' || r || '}}'").replace('{{', '{').replace('}}', '}')} doc
 from c, (values {", ".join(map(str, _WORKSHOP_DOCS))}) v(nm, f, l, col, a, ps, r)""")
def extract_docs(spark, sf):
    """Whole documents of functions, with inferred types and aliases written out."""
    return extract.graph(_workshop(spark, sf))[0].where("kind = 'function'").select("id", "doc")


@query("escapes", r"""select doc_id, replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(13), '\r'), chr(10), '\n') dot, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') html from documents""")
def escapes(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", S.escape_dot(F.col("text")).alias("dot"), S.escape_html(F.col("text")).alias("html"))


@query("path_parts", views.duck(None, r" select id, split_part(file_path, '/n', 1) folder, 'n' || split_part(file_path, '/n', 2) file, '.ts' extension, file_path || '#' || kind || ':' || name node, kind || ':' || split_part(name, '#', 2) label, '/p/' || file_path full_path from n").replace("kind || ':' || split_part(name, '#', 2) label", "split_part(name, '#', 2) label"))
def path_parts(spark, sf):
    p, node = F.col("file_path"), S.node_id(F.col("file_path"), F.col("kind"), F.col("name"))
    return views.nodes(spark, sf).select("id", S.dirname(p).alias("folder"), S.basename(p).alias("file"), S.extname(p).alias("extension"), node.alias("node"), S.node_label(node).alias("label"), S.absolute(F.concat(F.lit("./x/../"), p), "/p").alias("full_path"))


@query("graph_roundtrip", views.duck("thin", " select id, file_path || '#module:' || name node_key, (select count(*) from e where src = id) calls from n where kind = 'module'"))
def graph_roundtrip(spark, sf, view="thin"):
    """The view's modules and their outgoing edges, through a JSON document and back."""
    n, e = graph(spark, sf, view)
    key = F.concat("file_path", F.lit("#module:"), "name")
    modules = n.where("kind = 'module'").withColumn("node_key", key)
    doc = F.to_json(F.struct("kind", F.col("node_key").alias("id"), "name", F.col("file_path").alias("filePath"), F.array().cast("array<string>").alias("exports")))
    out = e.join(modules.select(F.col("id").alias("src"), F.col("node_key").alias("a")), "src")
    call = F.to_json(F.struct(F.lit("call").alias("kind"), F.col("a").alias("from"), F.col("dst").cast("string").alias("to"), F.lit(1).alias("line")))
    g = graph_json.Graph(
        spark.createDataFrame([("1.0", "", "/p")], "version string, generated_at string, project_root string"), spark.createDataFrame([], "seq int, path string"),
        modules.select("node_key", "node_seq", doc.alias("doc")), out.select("edge_seq", call.alias("doc")), spark.createDataFrame([], "problem string"),
    )
    folder = f"{shared_folder(spark)}/document-{uuid.uuid4().hex}"
    graph_json.write_parts(g, folder)
    back = graph_json.read_parts(spark, folder)
    counts = back.edges.groupBy(F.col("src").alias("node_key")).agg(F.count(F.lit(1)).alias("calls"))
    return back.nodes.join(counts, "node_key", "left").join(modules.select("id", "node_key").withColumnRenamed("id", "number"), "node_key").select(F.col("number").alias("id"), "node_key", F.coalesce("calls", F.lit(0)).alias("calls"))


_DOT = _GROUPS.replace("select distinct src, dst, edge_count, dominant_kind, first_seq from p", r""", q as (select distinct src, dst, edge_count, dominant_kind, first_seq from p)
 select 4 section, first_seq a, cast(0 as bigint) b, '  "' || src || '" -> "' || dst || '" [id="' || replace(replace(rtrim(to_base64(cast(src as varchar)::blob || '\x00'::blob || cast(dst as varchar)::blob), '='), '+', '-'), '/', '_') || '", weight=' ||
 case dominant_kind when 'call' then '4, style=solid' when 'inherits' then '3, style=bold' when 'import' then '2, style=dashed' else '1, style=dotted' end || case when edge_count > 1 then ', label="×' || edge_count || '"' else '' end || '];' line from q""")
_DOT_LINES = _LAYERED + """, rk as (select distinct cluster_id, label, has_entrypoint, is_orphan, case when has_entrypoint then 0 when is_orphan then 2000000000 else 1000000000 end + coalesce(try_cast(regexp_extract(cluster_id, '[0-9]+$') as bigint), 0) a from cl),
 pl as (select n.*, cl.is_orphan, a, lay.layer from cl join rk using (cluster_id) join n using (id) left join lay using (id))
 select 1 section, a, cast(-2 as bigint) b, '  subgraph cluster_' || cluster_id || ' { label="' || label || '"' || case when is_orphan then '; style=dashed' else '' end || ';' line from rk
 union all select 1, a, cast(1152921504606846976 as bigint), '  }' from rk
 union all select 1, a, cast(coalesce(layer, 0) * 4000000000 + node_seq + 1 as bigint), '    "' || id || '" [label="' || name || '", class="' || kind || '"' || case when file_path = '""" + views.ENTRY_FILE + """' then ', penwidth=3' else '' end || '];' from pl
 union all select 1, a, cast(layer * 4000000000 as bigint), '    { rank=same; ' || string_agg('"' || id || '"', '; ' order by node_seq) || '; }' from pl where not is_orphan group by a, layer having count(*) > 1
 union all from (with""" + _DOT.removeprefix(",") + ")"


@query("dot_edges", views.duck("sparse", _DOT))
def dot_edges(spark, sf):
    return report.dot_edges(views.edges(spark, sf, "sparse"))


@query("dot_lines", views.duck("thin", _DOT_LINES))
def dot_lines(spark, sf):
    n, e = graph(spark, sf, "thin")
    return report.dot_lines(n, e, entry_ids(n))


def _visible(n, e):
    return filters.visible(n, e, hidden_kinds=("interface",))


#: The operators over the edges of all orders, by the query whose view has a part of them.
_WHOLE: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "fan_metrics": degree.fan_metrics,
    "overview_metrics": lambda n, e: degree.overview(n, e, 1, recursion.reachable(e, entry_ids(n))),
    "page_stats": degree.page_stats,
    "edge_groups": lambda n, e: degree.edge_groups(e),
    "module_coupling": degree.module_coupling,
    "god_nodes": degree.god_nodes,
    "hub_nodes": degree.hub_nodes,
    "subgraph_nodes": lambda n, e: filters.subgraph(n, e, n.where("id % 3 <> 0"))[0],
    "subgraph_edges": lambda n, e: filters.subgraph(n, e, n.where("id % 3 <> 0"))[1],
    "visibility": lambda n, e: _visible(n, e)[1],
    "visible_nodes": lambda n, e: _visible(n, e)[0],
    "effective_orphans": lambda n, e: filters.effective_orphans(n, degree.edge_groups(e), _visible(n, e)[0]),
    "node_edges": lambda n, e: filters.node_edges(e, 7),
    "edges_between": lambda n, e: filters.edges_between(e, 7, e.where("src = 7").agg(F.min("dst")).first()[0]),
    "reachable": lambda n, e: recursion.reachable(e, entry_ids(n)),
    "dead_code": lambda n, e: recursion.dead_code(n, e, entry_ids(n)),
    "dead_code_by_file": lambda n, e: degree.by_file(recursion.dead_code(n, e, entry_ids(n)), [F.col("file_path"), F.col("name")]),
    "k_hop": lambda n, e: recursion.k_hop(e, 7, 3),
    "edge_ids": lambda n, e: e.select("src", "dst").distinct().withColumn("edge_id", S.edge_id(F.col("src"), F.col("dst"))),
    "dot_edges": lambda n, e: report.dot_edges(e),
    "graph_roundtrip": None,
    "components": lambda n, e: recursion.components(n, e).fillna(-1, "root"),
    "clusters": lambda n, e: recursion.clusters(n, e, entry_ids(n)),
    "cluster_summary": lambda n, e: degree.cluster_summary(recursion.clusters(n, e, entry_ids(n))),
    "initial_scope": lambda n, e: filters.initial_scope(recursion.clusters(n, e, entry_ids(n))),
    "cluster_select": lambda n, e: filters.selected_clusters(recursion.clusters(n, e, entry_ids(n)), " ep_0, cmp_1,,nothing"),
    "import_cycles": lambda n, e: recursion.cycles(n, e, "import"),
    "call_cycles": lambda n, e: recursion.cycles(n, e, "call"),
    "layers": lambda n, e: recursion.layers(n, e, recursion.clusters(n, e, entry_ids(n))),
    "call_paths": lambda n, e: recursion.call_paths(e, 7),
    "dot_lines": lambda n, e: report.dot_lines(n, e, entry_ids(n)),
}
#: SQL of another name's query, which holds over these views too.
_SQL_OF = {"components": "components_thin", "clusters": "clusters_thin", "layers": "layers_cyclic"}


def _whole_oracle(name: str, view: str) -> str:
    """The query's SQL with the view's edges, those of all orders, in place of its own."""
    sql, names = ORACLE[_SQL_OF.get(name, name)], {"customer": "customer", "orders": "orders"}
    if name == "dot_lines":  # layers in and behind cycles as well
        sql = sql.replace(_LAYERED.removeprefix(_CLUSTERS), _CYCLIC.removeprefix(_CLUSTERS).replace("select id, cluster_id, cast", ", lay as (select id, cluster_id, cast") + ")")
    for part in ("thin", "dense", "sparse"):  # sparse is the beginning of thin
        sql = sql.replace(views.EDGES[part].format(**names), views.EDGES[view].format(**names))
    return sql


for _name, _f in _WHOLE.items():

    @query(f"{_name}_all", _whole_oracle(_name, "all"))
    def whole(spark, sf, f=_f):
        return f(*graph(spark, sf, "all")) if f else graph_roundtrip(spark, sf, "all")


_BLOCKS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    n: _WHOLE[n] for n in ("effective_orphans", "reachable", "dead_code", "dead_code_by_file", "components", "clusters", "cluster_summary", "initial_scope", "cluster_select", "import_cycles", "call_cycles", "layers", "dot_lines")
} | {
    "call_paths": lambda n, e: recursion.call_paths(e, 27),
    "reachable_loop": lambda n, e: recursion.reachable(e, entry_ids(n), small=False),
    "components_loop": lambda n, e: recursion.components(n, e, small=False).fillna(-1, "root"),
    "clusters_loop": lambda n, e: recursion.clusters(n, e, entry_ids(n), small=False),
    "cycles_loop": lambda n, e: recursion.cycles(n, e, "import", small=False),
    "layers_loop": lambda n, e: recursion.layers(n, e, recursion.clusters(n, e, entry_ids(n)), small=False),
}
_SQL_OF |= {"components_loop": "components_thin", "clusters_loop": "clusters_thin", "cycles_loop": "import_cycles", "layers_loop": "layers_cyclic"}
for _name, _f in _BLOCKS.items():

    @query(f"{_name}_blocks", views.duck("blocks", _paths(27)) if _name == "call_paths" else _whole_oracle(_name, "blocks"))
    def blocks(spark, sf, f=_f):
        return f(*graph(spark, sf, "blocks"))
