"""A Python corpus generated from part, orders and lineitem, and its facts in closed form.

Every block of 50 parts is a module with one class and one factory per part; every such block has a
re-exporting module; every block of 32 orders is a module with one function per order whose calls
take one of five shapes by line number. Module sizes are bounded by those block sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators import facts as fa
from codequarry.operators import resolve
from codequarry.operators.evidence import joined
from codequarry.plans.graph_queries import sites
from codequarry.session import cut
from codequarry.sources.tables import load

PROJECT = "shop"
PART_BLOCK, ORDER_BLOCK = 50, 32
PART_LINES = 18


def _part_code():
    p = F.col("p").cast("string")
    b = F.col("b").cast("string")
    lines = [
        ("class Part", p, "(Base", b, "):"), ("    def price(self):",), ("        return self.audit()",),
        ("    def total(self):",), ("        return super().audit()",), ("    @property",), ("    def size(self):",),
        ("        return 0",), ("    @size.setter",), ("    def size(self, v: int):",), ('        """Set ', p, '."""'),
        ("        self.v = v",), ("def make_", p, "():"), ("    def inner():",), ("        return Part", p, "()"),
        ("    item = Part", p, "()"), ("    item.price()",), ("    return inner()",),
    ]
    return F.concat_ws("\n", *[F.concat(*[F.lit(x) if isinstance(x, str) else x for x in line]) for line in lines])


def _call_code():
    n, p = F.col("n").cast("string"), F.col("p").cast("string")
    b = F.floor(F.col("p") / PART_BLOCK).cast("string")
    shape = F.col("n") % 5
    return (
        F.when(shape == 1, F.concat(F.lit("    from shop.parts.p_"), b, F.lit(" import make_"), p, F.lit(" as go_"), n, F.lit("\n    go_"), n, F.lit("()")))
        .when(shape == 2, F.concat(F.lit("    import shop.parts.p_"), b, F.lit(" as m_"), n, F.lit("\n    m_"), n, F.lit(".make_"), p, F.lit("()")))
        .when(shape == 3, F.concat(F.lit("    item.make_"), p, F.lit("()")))
        .when(shape == 4, F.lit("    item.price()"))
        .otherwise(F.concat(F.lit("    from shop.api_"), b, F.lit(" import make_"), p, F.lit(" as re_"), n, F.lit("\n    re_"), n, F.lit("()")))
    )


def modules(spark: SparkSession, sf: str) -> DataFrame:
    parts = load(spark, sf, "part").select(
        F.col("p_partkey").alias("p"), F.floor(F.col("p_partkey") / PART_BLOCK).alias("b")
    )
    b = F.col("b").cast("string")
    part_files = parts.withColumn("code", _part_code()).groupBy("b").agg(joined(F.col("code"), F.col("p"), "\n").alias("body")).select(
        (F.col("b") * 3).alias("file_id"), F.concat(F.lit("shop/parts/p_"), b, F.lit(".py")).alias("path"),
        F.concat(F.lit('"""Parts block '), b, F.lit('."""\nclass Base'), b, F.lit(":\n    def audit(self):\n        return 1\n"), "body", F.lit("\n")).alias("content"),
    )
    line = F.concat(F.lit("from .parts.p_"), b, F.lit(" import make_"), F.col("p").cast("string"))
    api_files = parts.withColumn("code", line).groupBy("b").agg(joined(F.col("code"), F.col("p"), "\n").alias("body")).select(
        (F.col("b") * 3 + 1).alias("file_id"), F.concat(F.lit("shop/api_"), b, F.lit(".py")).alias("path"),
        F.concat("body", F.lit("\n")).alias("content"),
    )
    tree = part_files.unionByName(api_files).repartition(_width(spark, sf), "file_id").unionByName(_order_files(spark, sf))
    return tree.select(F.lit(PROJECT).alias("project_id"), "file_id", "path", _module().alias("module"), "content")


def _module():
    return F.replace(F.regexp_replace("path", r"\.py$", ""), F.lit("/"), F.lit("."))


def _width(spark: SparkSession, sf: str) -> int:
    """Partitions to parse in, which costs far more than its bytes suggest: by the input, not left to coalescing."""
    read = load(spark, sf, "lineitem").rdd.getNumPartitions()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, 8 * read)


def _order_files(spark: SparkSession, sf: str) -> DataFrame:
    """One module per block of orders. Orders and sites meet by block, as numbers; texts are made there and stay."""
    nothing = F.lit(None).cast("bigint")
    calls = sites(spark, sf).filter("l_orderkey IS NOT NULL").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("part").alias("p"), F.lit(0).alias("copies")
    )
    orders = load(spark, sf, "orders").select(F.col("o_orderkey").alias("o"), nothing.alias("n"), nothing.alias("p"), F.lit(1).alias("copies"))
    both = calls.unionByName(orders).withColumn("ob", F.floor(F.col("o") / ORDER_BLOCK)).repartition(_width(spark, sf), "ob")
    site = F.col("copies") == 0
    functions = both.withColumn("code", F.when(site, _call_code())).groupBy("ob", "o").agg(
        joined(F.col("code"), F.col("n"), "\n", site).alias("code"), F.count(F.when(site, 1)).alias("calls"), F.sum("copies").cast("int").alias("copies")
    ).filter("copies > 0").select(
        "ob", "o", F.explode(F.array_repeat(F.concat_ws(
            "\n", F.concat(F.lit("def order_"), "o", F.lit("(item):")), F.when(F.col("calls") > 0, F.col("code")),
            F.concat(F.lit("    return missing_"), "o", F.lit("()")),
        ), F.col("copies"))).alias("code"),
    )
    ob = F.col("ob").cast("string")
    return functions.groupBy("ob").agg(joined(F.col("code"), F.col("o"), "\n").alias("body")).select(
        (F.col("ob") * 3 + 2).alias("file_id"), F.concat(F.lit("shop/orders/o_"), ob, F.lit(".py")).alias("path"),
        F.concat(
            F.lit('"""Orders block '), ob, F.lit('."""\n'), "body", F.when(F.col("ob") % 7 == 3, "\ndef broken(:\n").otherwise("\n")
        ).alias("content"),
    )


def paths(spark: SparkSession, sf: str) -> DataFrame:
    """Path and module of every file, without its text."""
    parts = load(spark, sf, "part").select(F.floor(F.col("p_partkey") / PART_BLOCK).cast("string").alias("b")).distinct()
    orders = load(spark, sf, "orders").select(F.floor(F.col("o_orderkey") / ORDER_BLOCK).cast("string").alias("b")).distinct()
    named = [(parts, "shop/parts/p_"), (parts, "shop/api_"), (orders, "shop/orders/o_")]
    every = [blocks.select(F.concat(F.lit(start), "b", F.lit(".py")).alias("path")) for blocks, start in named]
    return every[0].unionByName(every[1]).unionByName(every[2]).withColumn("module", _module())


def facts(spark: SparkSession, sf: str, only: str | None = None) -> DataFrame:
    return fa.extract_facts(modules(spark, sf), only)


def stored_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed once and written per kind of fact, for jobs that read several kinds."""
    return cut(facts(spark, sf), ["fact"])


def resolved_calls(spark: SparkSession, sf: str) -> DataFrame:
    stored = stored_facts(spark, sf)
    symbols = fa.symbols(stored)
    # A scope is always a symbol of its file; calls at module level have none.
    calls = fa.calls(stored).withColumn("caller_qualified", F.when(F.col("caller_qualified") != "", F.col("caller_qualified")))
    return resolve.resolve_calls(calls, symbols, fa.imports(stored), ("symbol_key",))


# Closed forms. gsym: every symbol with its key and span; gcall: every call and what it resolves to.
SQL_MODULES = f"""gparts AS (SELECT p_partkey AS p, p_partkey // {PART_BLOCK} AS b,
   4 + {PART_LINES} * (row_number() OVER (PARTITION BY p_partkey // {PART_BLOCK} ORDER BY p_partkey) - 1) AS o4 FROM part),
gsites AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS p, min(l_partkey) // {PART_BLOCK} AS b FROM lineitem GROUP BY ALL),
gorders AS (SELECT o_orderkey AS o, o_orderkey // {ORDER_BLOCK} AS ob, coalesce(k, 0) AS body FROM orders
   LEFT JOIN (SELECT o, sum(CASE WHEN n % 5 IN (3, 4) THEN 1 ELSE 2 END)::BIGINT AS k FROM gsites GROUP BY 1) s ON s.o = o_orderkey),
gspans AS (SELECT *, 2 + coalesce(sum(body + 2) OVER (PARTITION BY ob ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM gorders),
gfine AS (SELECT * FROM gspans WHERE ob % 7 <> 3),
gsym AS (
  SELECT 'shop/parts/p_' || b || '.py' AS path, 'shop.parts.p_' || b AS module, 'Base' || b AS name, 'Base' || b AS qualified_name, 'class' AS kind, 2 AS start_line, 4 AS end_line,
         'class Base' || b || ':' AS signature, '' AS doc, '' AS parent, '' AS bases FROM (SELECT DISTINCT b FROM gparts)
  UNION ALL SELECT 'shop/parts/p_' || b || '.py', 'shop.parts.p_' || b, 'audit', 'Base' || b || '.audit', 'method', 3, 4, 'def audit(self):', '', 'Base' || b, '' FROM (SELECT DISTINCT b FROM gparts)
  UNION ALL SELECT 'shop/parts/p_' || b || '.py', 'shop.parts.p_' || b, v.name, v.q, v.kind, o4 + v.s, o4 + v.e, v.sig, v.doc, v.parent, v.bases FROM gparts, LATERAL (VALUES
    ('Part' || p, 'Part' || p, 'class', 1, 12, 'class Part' || p || '(Base' || b || '):', '', '', 'Base' || b),
    ('price', 'Part' || p || '.price', 'method', 2, 3, 'def price(self):', '', 'Part' || p, ''),
    ('total', 'Part' || p || '.total', 'method', 4, 5, 'def total(self):', '', 'Part' || p, ''),
    ('size', 'Part' || p || '.size', 'method', 9, 12, 'def size(self, v: int):', 'Set ' || p || '.', 'Part' || p, ''),
    ('make_' || p, 'make_' || p, 'function', 13, 18, 'def make_' || p || '():', '', '', ''),
    ('inner', 'make_' || p || '.inner', 'function', 14, 15, 'def inner():', '', 'make_' || p, '')) v(name, q, kind, s, e, sig, doc, parent, bases)
  UNION ALL SELECT 'shop/orders/o_' || ob || '.py', 'shop.orders.o_' || ob, 'order_' || o, 'order_' || o, 'function', s, s + body + 1, 'def order_' || o || '(item):', '', '', '' FROM gfine),
gcall AS (
  SELECT 'shop/parts/p_' || b || '.py' AS path, o4 + v.line AS line, v.scope AS caller, v.callee, v.expr, 'shop.parts.p_' || b AS target_module, v.tq AS target_qualified,
         v.target AS target, v.st AS status, v.conf AS confidence FROM gparts, LATERAL (VALUES
    (3, 'Part' || p || '.price', 'audit', 'self.audit', 'Part' || p || '.audit', 'shop.parts.p_' || b || ':Base' || b || '.audit', 'resolved', 0.9::DOUBLE),
    (5, 'Part' || p || '.total', 'audit', 'super.audit', 'super:Part' || p || '.audit', 'shop.parts.p_' || b || ':Base' || b || '.audit', 'resolved', 0.95::DOUBLE),
    (5, 'Part' || p || '.total', 'super', 'super', '', NULL, 'unresolved', 0.0::DOUBLE),
    (15, 'make_' || p || '.inner', 'Part' || p, 'Part' || p, '', 'shop.parts.p_' || b || ':Part' || p, 'resolved', 0.9::DOUBLE),
    (16, 'make_' || p, 'Part' || p, 'Part' || p, '', 'shop.parts.p_' || b || ':Part' || p, 'resolved', 0.9::DOUBLE),
    (17, 'make_' || p, 'price', 'item.price', 'Part' || p || '.price', 'shop.parts.p_' || b || ':Part' || p || '.price', 'resolved', 1.0::DOUBLE),
    (18, 'make_' || p, 'inner', 'inner', '', 'shop.parts.p_' || b || ':make_' || p || '.inner', 'resolved', 0.9::DOUBLE)) v(line, scope, callee, expr, tq, target, st, conf)
  UNION ALL
  SELECT 'shop/orders/o_' || ob || '.py', s + body + 1, 'order_' || o, 'missing_' || o, 'missing_' || o, 'shop.orders.o_' || ob, '', NULL, 'unresolved', 0.0::DOUBLE FROM gfine
  UNION ALL
  SELECT 'shop/orders/o_' || f.ob || '.py', f.s + (sum(CASE WHEN n % 5 IN (3, 4) THEN 1 ELSE 2 END) OVER (PARTITION BY g.o ORDER BY n))::BIGINT, 'order_' || g.o,
    CASE n % 5 WHEN 4 THEN 'price' ELSE 'make_' || p END,
    CASE n % 5 WHEN 1 THEN 'go_' || n WHEN 2 THEN 'm_' || n || '.make_' || p WHEN 3 THEN 'item.make_' || p WHEN 4 THEN 'item.price' ELSE 're_' || n END,
    CASE n % 5 WHEN 1 THEN 'shop.parts.p_' || b WHEN 2 THEN 'shop.parts.p_' || b WHEN 0 THEN 'shop.api_' || b ELSE '' END, '',
    CASE WHEN n % 5 = 4 THEN CASE WHEN (SELECT count(*) FROM gparts) = 1 THEN 'shop.parts.p_' || b || ':Part' || p || '.price' END ELSE 'shop.parts.p_' || b || ':make_' || p END,
    CASE WHEN n % 5 = 4 AND (SELECT count(*) FROM gparts) > 1 THEN 'ambiguous' ELSE 'resolved' END,
    CASE n % 5 WHEN 3 THEN 0.45::DOUBLE WHEN 4 THEN CASE WHEN (SELECT count(*) FROM gparts) > 1 THEN 0.0::DOUBLE ELSE 0.45::DOUBLE END ELSE 1.0::DOUBLE END
  FROM gsites g JOIN gfine f USING (o))"""
