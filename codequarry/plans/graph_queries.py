"""Registered queries: call and import graphs drawn from orders and their line items.

A call site is one (order, line number); consecutive line numbers of an order call each other. Both
the part (as symbol) and the supplier (as module) of a site are aggregates, so a key with very many
line items still yields one site.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.operators import edges, graph
from codequarry.options import DEFAULTS
from codequarry.plans.registry import query
from codequarry.sources.tables import load


def sites(spark, sf):
    return load(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp")
    )


SQL_SITES = """sites AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, min(l_suppkey) AS supp FROM lineitem GROUP BY ALL),
steps AS (SELECT a.l_orderkey * 8 + a.l_linenumber AS call_id, a.l_linenumber AS n, a.part AS src_part, b.part AS dst_part,
   a.supp AS src_supp, b.supp AS dst_supp FROM sites a JOIN sites b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
pcalls AS (SELECT call_id, src_part AS caller_symbol_id, dst_part AS target_symbol_id, 'resolved' AS resolution_status,
   CASE n % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.9::DOUBLE ELSE 0.45::DOUBLE END AS confidence FROM steps),
psymbols AS (SELECT p_partkey AS symbol_id, replace(p_name, ' ', '_') AS name, 'parts/' || p_brand || '/' || p_type || '.py' AS path,
   p_partkey % 1000 AS start_line FROM part)"""


def steps(spark, sf):
    here = sites(spark, sf)
    after = here.select(
        "l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"),
        F.col("part").alias("dst_part"), F.col("supp").alias("dst_supp"),
    )
    return here.join(after, ["l_orderkey", "l_linenumber"]).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("call_id"), F.col("l_linenumber").alias("n"),
        F.col("part").alias("src_part"), "dst_part", F.col("supp").alias("src_supp"), "dst_supp",
    )


def part_calls(spark, sf):
    n = F.col("n") % 3
    return steps(spark, sf).select(
        "call_id", F.col("src_part").alias("caller_symbol_id"), F.col("dst_part").alias("target_symbol_id"),
        F.lit("resolved").alias("resolution_status"),
        F.when(n == 0, 1.0).when(n == 1, 0.9).otherwise(0.45).alias("confidence"),
    )


def part_symbols(spark, sf):
    return load(spark, sf, "part").select(
        F.col("p_partkey").alias("symbol_id"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"),
        F.concat(F.lit("parts/"), "p_brand", F.lit("/"), "p_type", F.lit(".py")).alias("path"),
        (F.col("p_partkey") % 1000).alias("start_line"),
    )


def _seeds(spark, sf):
    return load(spark, sf, "supplier").select(F.col("s_suppkey").alias("request_id"), F.col("s_suppkey").alias("node"))


def _sql_trace(direction: str) -> str:
    anchor, other = ("target", "caller") if direction == "callers" else ("caller", "target")
    return f"""SELECT '{direction}' AS direction, request_id, rank, symbol_id, confidence FROM (
  SELECT r.s_suppkey AS request_id, s.symbol_id, e.confidence, row_number() OVER (PARTITION BY r.s_suppkey
     ORDER BY e.confidence DESC, s.path, s.start_line, s.symbol_id) AS rank
  FROM supplier r JOIN (SELECT DISTINCT caller_symbol_id, target_symbol_id, resolution_status, confidence FROM pcalls) e
    ON e.{anchor}_symbol_id = r.s_suppkey JOIN psymbols s ON s.symbol_id = e.{other}_symbol_id) WHERE rank <= 30"""


@query("one_hop_trace", f"WITH {SQL_SITES} {_sql_trace('callers')} UNION ALL {_sql_trace('callees')}")
def one_hop_trace(spark, sf):
    asked = _seeds(spark, sf).withColumnRenamed("node", "symbol_id")
    calls, symbols = part_calls(spark, sf), part_symbols(spark, sf)
    sides = [
        edges.trace(asked, calls, symbols, direction, 30).withColumn("direction", F.lit(direction))
        for direction in ("callers", "callees")
    ]
    return sides[0].unionByName(sides[1]).select("direction", "request_id", "rank", "symbol_id", "confidence")


def module_edges(spark, sf):
    suppliers = load(spark, sf, "supplier")
    imports = steps(spark, sf).select(
        F.concat(F.lit("sup/s_"), "src_supp", F.lit(".py")).alias("src"), F.concat(F.lit("sup.s_"), "dst_supp").alias("module")
    )
    modules = suppliers.select(
        F.concat(F.lit("sup.s_"), "s_suppkey").alias("module"), F.concat(F.lit("sup/s_"), "s_suppkey", F.lit(".py")).alias("dst")
    )
    return edges.dependency_edges(imports, modules)


SQL_DEPS = f"""{SQL_SITES},
deps AS (SELECT DISTINCT 'sup/s_' || src_supp || '.py' AS src, 'sup/s_' || s_suppkey || '.py' AS dst
  FROM steps JOIN supplier ON s_suppkey = dst_supp WHERE src_supp <> dst_supp)"""


@query("file_dependencies", f"WITH {SQL_DEPS} SELECT src, dst FROM deps")
def file_dependencies(spark, sf):
    return module_edges(spark, sf)


@query("reverse_dependents", f"""WITH {SQL_DEPS} SELECT dst AS path, count(*) AS dependents, min(src) AS first_dependent FROM deps GROUP BY 1""")
def reverse_dependents(spark, sf):
    return module_edges(spark, sf).groupBy(F.col("dst").alias("path")).agg(
        F.count("*").alias("dependents"), F.min("src").alias("first_dependent")
    )


@query("central_modules", f"""WITH {SQL_DEPS},
files AS (SELECT s_nationkey AS project_id, 'sup/s_' || s_suppkey || '.py' AS path, coalesce(n, 0) AS symbols FROM supplier
  LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey),
rated AS (SELECT *, coalesce((SELECT count(*) FROM deps WHERE dst = path), 0) AS inbound,
   coalesce((SELECT count(*) FROM deps WHERE src = path), 0) AS dependencies FROM files)
SELECT * FROM (SELECT project_id, path, symbols, inbound, dependencies, row_number() OVER (PARTITION BY project_id
   ORDER BY inbound DESC, symbols DESC, dependencies DESC, path) AS rank FROM rated) WHERE rank <= 8""")
def central_modules(spark, sf):
    counts = load(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct().groupBy(
        F.col("l_suppkey").alias("s_suppkey")
    ).agg(F.count("*").alias("symbols"))
    files = load(spark, sf, "supplier").join(counts, "s_suppkey", "left").select(
        F.col("s_nationkey").alias("project_id"), F.concat(F.lit("sup/s_"), "s_suppkey", F.lit(".py")).alias("path"),
        F.coalesce("symbols", F.lit(0)).alias("symbols"),
    )
    return edges.central_modules(files, module_edges(spark, sf)).select(
        "project_id", "path", "symbols", "inbound", "dependencies", "rank"
    )


@query("call_graph_reach", f"""WITH {SQL_SITES},
e AS (SELECT DISTINCT src_part AS src, dst_part AS dst FROM steps),
d1 AS (SELECT DISTINCT s_suppkey AS request_id, dst AS node FROM supplier JOIN e ON src = s_suppkey WHERE dst <> s_suppkey),
d2 AS (SELECT DISTINCT request_id, dst AS node FROM d1 JOIN e ON src = node
   WHERE dst <> request_id AND NOT EXISTS (SELECT 1 FROM d1 x WHERE x.request_id = d1.request_id AND x.node = dst))
SELECT request_id, node, 1 AS depth FROM d1 UNION ALL SELECT request_id, node, 2 FROM d2""")
def call_graph_reach(spark, sf):
    pairs = steps(spark, sf).select(F.col("src_part").alias("src"), F.col("dst_part").alias("dst")).distinct()
    return graph.reach(pairs, _seeds(spark, sf), DEFAULTS.dependency_depth)


@query("transitive_file_dependencies", f"""WITH {SQL_DEPS},
asked AS (SELECT 'sup/s_' || n_nationkey || '.py' AS src FROM nation),
d1 AS (SELECT src AS start, dst AS node FROM deps JOIN asked USING (src)),
d2 AS (SELECT DISTINCT d1.start, e.dst AS node FROM d1 JOIN deps e ON e.src = d1.node
   WHERE e.dst <> d1.start AND NOT EXISTS (SELECT 1 FROM d1 x WHERE x.start = d1.start AND x.node = e.dst))
SELECT start AS request_id, node, 1 AS depth FROM d1 UNION ALL SELECT start, node, 2 FROM d2""")
def transitive_file_dependencies(spark, sf):
    # Requests name their start files. Files walk by number and get their paths back at the end.
    known = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("dst"))
    pairs = steps(spark, sf).select(F.col("src_supp").alias("src"), F.col("dst_supp").alias("dst")).filter(
        "src <> dst"
    ).distinct().join(known, "dst")
    number = F.col("n_nationkey").cast("bigint")
    starts = load(spark, sf, "nation").select(number.alias("request_id"), number.alias("node"))

    def path(number):
        return F.concat(F.lit("sup/s_"), number, F.lit(".py")).alias(number)

    return graph.reach(pairs, starts, DEFAULTS.dependency_depth).select(path("request_id"), path("node"), "depth")


@query("nearest_symbols", f"""WITH {SQL_SITES},
e AS (SELECT src_part AS src, dst_part AS dst, min(call_id) AS ord FROM steps GROUP BY ALL),
l0 AS (SELECT s_suppkey AS request_id, s_suppkey AS node, 0 AS depth, 1 AS place FROM supplier),
c1 AS (SELECT l0.request_id, e.dst AS node, e.ord FROM l0 JOIN e ON e.src = l0.node WHERE e.dst <> l0.node),
l1 AS (SELECT * FROM (SELECT request_id, node, 1 AS depth, 1 + row_number() OVER (PARTITION BY request_id ORDER BY ord, node) AS place FROM c1) WHERE place <= 8),
c2 AS (SELECT l1.request_id, e.dst AS node, min((l1.place, e.ord, e.dst)) AS k FROM l1 JOIN e ON e.src = l1.node
   WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1) v WHERE v.request_id = l1.request_id AND v.node = e.dst) GROUP BY ALL),
l2 AS (SELECT * FROM (SELECT request_id, node, 2 AS depth, row_number() OVER (PARTITION BY request_id ORDER BY k)
   + (SELECT count(*) FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1) v WHERE v.request_id = c2.request_id) AS place FROM c2) WHERE place <= 8)
SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2""")
def nearest_symbols(spark, sf):
    ordered = steps(spark, sf).groupBy(F.col("src_part").alias("src"), F.col("dst_part").alias("dst")).agg(
        F.min("call_id").alias("ord")
    )
    seeds = _seeds(spark, sf).withColumn("ord", F.lit(0))
    return graph.nearest(ordered, seeds, DEFAULTS.dependency_depth, 8)


@query("call_chains", f"""WITH {SQL_SITES},
e AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY c DESC, dst) AS rn FROM (
   SELECT caller_symbol_id AS src, target_symbol_id AS dst, max(confidence) AS c FROM pcalls WHERE caller_symbol_id <> target_symbol_id GROUP BY ALL)) WHERE rn <= 3),
p1 AS (SELECT s_suppkey AS request_id, [src, dst] AS p FROM supplier JOIN e ON src = s_suppkey),
p2 AS (SELECT request_id, list_append(p, dst) AS p FROM p1 JOIN e ON src = p[-1] WHERE NOT list_contains(p, dst)),
p3 AS (SELECT request_id, list_append(p, dst) AS p FROM p2 JOIN e ON src = p[-1] WHERE NOT list_contains(p, dst))
SELECT request_id, len(p) - 1 AS hops, array_to_string(p, ' > ') AS chain FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)""")
def call_chains(spark, sf):
    pairs = part_calls(spark, sf).filter("caller_symbol_id <> target_symbol_id").groupBy(
        F.col("caller_symbol_id").alias("src"), F.col("target_symbol_id").alias("dst")
    ).agg(F.max("confidence").alias("confidence"))
    order = [F.col("confidence").desc(), F.col("dst")]
    walks = graph.chains(pairs, _seeds(spark, sf), DEFAULTS.research_steps, order, DEFAULTS.parallel_reads)
    return walks.select(
        "request_id", (F.size("path") - 1).alias("hops"),
        F.array_join(F.transform("path", lambda v: v.cast("string")), " > ").alias("chain"),
    )
