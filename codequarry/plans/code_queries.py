"""Registered queries over the generated Python corpus: extraction, resolution, lookups by position."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from codequarry.functions import text as tx
from codequarry.operators import chunks as ck
from codequarry.operators import facts as fa
from codequarry.operators import intervals, project_map, resolve, segments
from codequarry.plans import modules_corpus as mc
from codequarry.plans.registry import query
from codequarry.session import cut, shared_dir
from codequarry.sources.tables import load


@query("python_symbols", f"""WITH {mc.SQL_MODULES}
SELECT path, qualified_name, module || ':' || qualified_name AS symbol_key, name, kind, start_line, end_line, signature, doc, parent, bases FROM gsym""")
def python_symbols(spark, sf):
    return fa.symbols(mc.facts(spark, sf, "symbol")).select(
        "path", "qualified_name", "symbol_key", "name", "kind", "start_line", "end_line", "signature", "doc", "parent",
        F.array_join("bases", ",").alias("bases"),
    )


@query("python_imports", f"""WITH {mc.SQL_MODULES}
SELECT 'shop/api_' || b || '.py' AS path, '' AS binding_scope, 'shop.parts.p_' || b AS module, 'make_' || p AS imported_name, 'make_' || p AS local_name, 1 AS level,
   row_number() OVER (PARTITION BY b ORDER BY p) AS start_line FROM gparts
UNION ALL SELECT 'shop/orders/o_' || f.ob || '.py', 'order_' || g.o, CASE n % 5 WHEN 0 THEN 'shop.api_' ELSE 'shop.parts.p_' END || b, CASE n % 5 WHEN 2 THEN '' ELSE 'make_' || p END,
   CASE n % 5 WHEN 1 THEN 'go_' WHEN 2 THEN 'm_' ELSE 're_' END || n, 0,
   f.s + (SELECT coalesce(sum(CASE WHEN x.n % 5 IN (3, 4) THEN 1 ELSE 2 END), 0) FROM gsites x WHERE x.o = g.o AND x.n < g.n)::BIGINT + 1
 FROM gsites g JOIN gfine f USING (o) WHERE n % 5 IN (0, 1, 2)""")
def python_imports(spark, sf):
    return fa.imports(mc.facts(spark, sf, "import")).select(
        "path", "binding_scope", F.col("target_module").alias("module"), "imported_name", "local_name", "level", "start_line"
    )


@query("python_calls", f"""WITH {mc.SQL_MODULES}
SELECT path, line, caller, callee, expr, target_module, target_qualified FROM gcall""")
def python_calls(spark, sf):
    return fa.calls(mc.facts(spark, sf, "call")).select(
        "path", F.col("start_line").alias("line"), F.col("caller_qualified").alias("caller"), F.col("callee_name").alias("callee"),
        F.col("callee_expr").alias("expr"), "target_module", "target_qualified",
    )


@query("parse_error_listing", f"""WITH {mc.SQL_MODULES}
SELECT DISTINCT 'shop/orders/o_' || ob || '.py' AS path, 'SyntaxError' AS error FROM gspans WHERE ob % 7 = 3""")
def parse_error_listing(spark, sf):
    return fa.parse_errors(mc.facts(spark, sf, "error")).select("path", F.split("parse_error", ":")[0].alias("error"))


@query("call_resolution", f"""WITH {mc.SQL_MODULES} SELECT path, line, caller, expr, target, status, confidence FROM gcall""")
def call_resolution(spark, sf):
    return mc.resolved_calls(spark, sf).select(
        "path", F.col("start_line").alias("line"), F.col("caller_qualified").alias("caller"), F.col("callee_expr").alias("expr"),
        F.col("target_symbol_key").alias("target"), F.col("resolution_status").alias("status"), "confidence",
    )


@query("resolution_by_confidence", f"""WITH {mc.SQL_MODULES} SELECT status, confidence, count(*) AS calls, count(DISTINCT target) AS targets FROM gcall GROUP BY ALL""")
def resolution_by_confidence(spark, sf):
    return mc.resolved_calls(spark, sf).groupBy(F.col("resolution_status").alias("status"), "confidence").agg(
        F.count("*").alias("calls"), F.countDistinct("target_symbol_id").alias("targets")
    )


@query("reexport_closure", f"""WITH {mc.SQL_MODULES}
SELECT 'shop.api_' || b AS module, 'make_' || p AS name, 'shop.parts.p_' || b || ':make_' || p AS symbol_key FROM gparts""")
def reexport_closure(spark, sf):
    stored = mc.stored_facts(spark, sf)
    imports, symbols = fa.imports(stored), fa.symbols(stored)
    keys = imports.filter("binding_scope = ''").select("project_id", "module", F.col("local_name").alias("name"))
    found = resolve.exported(keys, symbols, imports)
    return found.join(symbols.select("symbol_id", "symbol_key"), "symbol_id").select(
        F.col("root_m").alias("module"), F.col("root_n").alias("name"), "symbol_key"
    )


@query("lexical_scope_lookup", f"""WITH {mc.SQL_MODULES}
SELECT v.* FROM gparts, LATERAL (VALUES
  ('make_' || p, 'inner', 'shop.parts.p_' || b || ':make_' || p || '.inner'), ('make_' || p, 'Part' || p, 'shop.parts.p_' || b || ':Part' || p),
  ('make_' || p || '.inner', 'Part' || p, 'shop.parts.p_' || b || ':Part' || p)) v(caller, expr, symbol_key)""")
def lexical_scope_lookup(spark, sf):
    stored = mc.stored_facts(spark, sf)
    symbols = fa.symbols(stored)
    shapes = fa.calls(stored).withColumn("shape_id", F.col("call_id"))
    found = resolve.lexical_targets(shapes, symbols).join(symbols.select("symbol_id", "symbol_key"), "symbol_id")
    asked = shapes.select("shape_id", F.col("caller_qualified").alias("caller"), F.col("callee_expr").alias("expr"))
    return found.join(asked, "shape_id").select("caller", "expr", "symbol_key")


@query("inherited_method_lookup", f"""WITH {mc.SQL_MODULES}
SELECT 'Part' || p AS class_q, 'shop.parts.p_' || b || ':Base' || b || '.audit' AS symbol_key FROM gparts""")
def inherited_method_lookup(spark, sf):
    stored = mc.stored_facts(spark, sf)
    symbols = fa.symbols(stored)
    classes = symbols.filter("kind = 'class' AND size(bases) > 0").select(
        F.col("symbol_id").alias("shape_id"), "project_id", "module", F.col("qualified_name").alias("class_q"), F.lit("audit").alias("method")
    )
    found = resolve.inherited_methods(classes, symbols, fa.imports(stored))
    return found.join(symbols.select("symbol_id", "symbol_key"), "symbol_id").join(
        classes.select("shape_id", "class_q"), "shape_id"
    ).select("class_q", "symbol_key")


@query("enclosing_symbol", f"""WITH {mc.SQL_MODULES} SELECT path, line, expr, caller AS enclosing FROM gcall""")
def enclosing_symbol(spark, sf):
    stored = mc.stored_facts(spark, sf)
    points = fa.calls(stored).select("call_id", "path", F.col("start_line").alias("line"), F.col("callee_expr").alias("expr"))
    spans = fa.symbols(stored).select("path", "symbol_id", "qualified_name", "start_line", "end_line")
    return intervals.enclosing(points, spans, ["path"], 1, "call_id").select(
        "path", "line", "expr", F.col("qualified_name").alias("enclosing")
    )


@query("resolve_expression", f"""WITH {mc.SQL_MODULES},
asked AS (SELECT path, line, expr, split_part(expr, '.', 1) AS first, string_split(expr, '.')[-1] AS name FROM gcall),
bound AS (SELECT 'shop/orders/o_' || f.ob || '.py' AS path, CASE n % 5 WHEN 1 THEN 'go_' ELSE 'm_' END || n AS local, arg_min(g.p, f.s) AS first_p, arg_min(g.b, f.s) AS first_b
   FROM gsites g JOIN gfine f USING (o) WHERE n % 5 IN (1, 2) GROUP BY ALL),
heads AS (SELECT *, module || ':' || qualified_name AS symbol_key, row_number() OVER (PARTITION BY name ORDER BY blk, start_line) AS k, row_number() OVER (PARTITION BY name, path ORDER BY start_line) AS own
   FROM (SELECT *, regexp_extract(path, '_(\\d+)[.]py$', 1)::BIGINT AS blk FROM gsym) QUALIFY k <= 8 OR own <= 8),
imported AS (SELECT a.*, symbol_key FROM asked a JOIN bound b ON b.path = a.path AND b.local = a.first
   JOIN heads s ON s.module = 'shop.parts.p_' || first_b AND s.name = CASE WHEN a.first LIKE 'go%' THEN 'make_' || first_p ELSE a.name END),
anywhere AS (SELECT a.*, symbol_key, row_number() OVER (PARTITION BY a.path, line, expr ORDER BY s.path <> a.path, blk, start_line) AS rank
   FROM asked a ANTI JOIN imported i USING (path, line, expr) JOIN heads s ON s.name = a.name AND (k <= 8 OR s.path = a.path) QUALIFY rank <= 8),
spans AS (SELECT a.path, line, expr, module || ':' || qualified_name AS symbol_key, row_number() OVER (PARTITION BY a.path, line, expr ORDER BY end_line - start_line, start_line) AS rank
   FROM asked a JOIN gsym s ON s.path = a.path AND line BETWEEN start_line AND end_line QUALIFY rank <= 8)
SELECT path, line, expr, 'name' AS asked_by, 1 AS source, 1 AS rank, symbol_key FROM imported
UNION ALL SELECT path, line, expr, 'name', 2, rank, symbol_key FROM anywhere
UNION ALL SELECT path, line, expr, 'place', 0, rank, symbol_key FROM spans""")
def resolve_expression(spark, sf):
    """Every call asked twice, by its expression alone and by its place, with all answers."""
    stored = mc.stored_facts(spark, sf)
    symbols = fa.symbols(stored)
    calls = fa.calls(stored).select("call_id", "project_id", "path", F.col("start_line").alias("line"), F.col("callee_expr").alias("expression"))
    # A request's number is its call's, even by name and odd by place.
    by_place = F.explode(F.array(F.lit(0), F.lit(1))).alias("by_place")
    asked = calls.select("*", by_place).select(
        (F.col("call_id") * 2 + F.col("by_place")).alias("request_id"), "project_id", "path", "expression",
        F.when(F.col("by_place") == 1, F.col("line")).alias("line"),
    )
    answers = resolve.resolve_expressions(asked, symbols, fa.imports(stored), 8)
    found = answers.join(symbols.select("symbol_id", "symbol_key"), "symbol_id").select(
        F.shiftright("request_id", 1).alias("call_id"), F.when(F.col("request_id") % 2 == 1, "place").otherwise("name").alias("asked_by"),
        "source", "rank", "symbol_key",
    ).join(calls.select("call_id", "path", "line", F.col("expression").alias("expr")), "call_id")
    return found.select("path", "line", "expr", "asked_by", "source", "rank", "symbol_key")


@query("module_dependencies", f"""WITH {mc.SQL_MODULES}
SELECT DISTINCT 'shop/api_' || b || '.py' AS src, 'shop/parts/p_' || b || '.py' AS dst FROM gparts
UNION SELECT DISTINCT 'shop/orders/o_' || f.ob || '.py', CASE n % 5 WHEN 0 THEN 'shop/api_' ELSE 'shop/parts/p_' END || b || '.py' FROM gsites g JOIN gfine f USING (o) WHERE n % 5 IN (0, 1, 2)""")
def module_dependencies(spark, sf):
    from codequarry.operators import edges

    modules = mc.paths(spark, sf).select("module", F.col("path").alias("dst"))
    imports = fa.imports(mc.facts(spark, sf, "import")).select(F.col("path").alias("src"), F.col("target_module").alias("module"))
    return edges.dependency_edges(imports, modules)


# --- structure --------------------------------------------------------------------------------


@query("python_segments", f"""WITH {mc.SQL_MODULES},
raw AS (
  SELECT 'shop/parts/p_' || b || '.py' AS path, 'docstring' AS kind, '模块说明' AS title, 1 AS s, 1 AS e FROM (SELECT DISTINCT b FROM gparts)
  UNION ALL SELECT 'shop/parts/p_' || b || '.py', 'class', '类 Base' || b, 2, 4 FROM (SELECT DISTINCT b FROM gparts)
  UNION ALL SELECT 'shop/parts/p_' || b || '.py', 'class', '类 Part' || p, o4 + 1, o4 + 12 FROM gparts
  UNION ALL SELECT 'shop/parts/p_' || b || '.py', 'function', '函数 make_' || p || '()', o4 + 13, o4 + 18 FROM gparts
  UNION ALL SELECT 'shop/api_' || b || '.py', 'imports', '导入依赖', 1, count(*) FROM gparts GROUP BY b
  UNION ALL SELECT DISTINCT 'shop/orders/o_' || ob || '.py', CASE WHEN ob % 7 = 3 THEN 'code' ELSE 'docstring' END, CASE WHEN ob % 7 = 3 THEN '文件头部' ELSE '模块说明' END, 1, 1 FROM gspans
  UNION ALL SELECT 'shop/orders/o_' || ob || '.py', 'function', '函数 order_' || o || '()', s, s + body + 1 FROM gspans
  UNION ALL SELECT 'shop/orders/o_' || ob || '.py', 'function', '函数 broken()', max(s + body + 2), max(s + body + 2) FROM gspans WHERE ob % 7 = 3 GROUP BY ob)
SELECT path, row_number() OVER (PARTITION BY path ORDER BY s) - 1 AS segment_no, kind, title, s AS start_line, e AS end_line FROM raw""")
def python_segments(spark, sf):
    files = mc.modules(spark, sf)
    return segments.file_segments(files, F.col("path").endswith(".py")).select(
        "path", "segment_no", "kind", "title", "start_line", "end_line"
    )


@query("python_outline", f"""WITH {mc.SQL_MODULES}
SELECT path, CASE WHEN kind = 'class' THEN name ELSE name || '()' END AS title, CASE WHEN kind = 'function' AND parent <> '' THEN 'method' ELSE kind END AS kind, start_line, end_line,
   len(string_split(qualified_name, '.')) - 1 AS depth FROM gsym WHERE name <> 'size' AND path NOT LIKE 'shop/orders/%'
UNION ALL SELECT 'shop/parts/p_' || b || '.py', 'size()', 'method', o4 + 6, o4 + 8, 1 FROM gparts
UNION ALL SELECT 'shop/parts/p_' || b || '.py', 'size()', 'method', o4 + 9, o4 + 12, 1 FROM gparts
UNION ALL SELECT 'shop/orders/o_' || ob || '.py', 'order_' || o || '()', 'function', s, s + body + 1, 0 FROM gspans
UNION ALL SELECT 'shop/orders/o_' || ob || '.py', 'broken()', 'function', max(s + body + 2), max(s + body + 2), 0 FROM gspans WHERE ob % 7 = 3 GROUP BY ob""")
def python_outline(spark, sf):
    rows = segments.extract_structure(mc.modules(spark, sf)).filter("fact = 'outline'")
    return rows.select("path", "title", "kind", "start_line", "end_line", "depth")


@query("skeleton_text", f"""WITH {mc.SQL_MODULES},
gcode AS (SELECT f.ob, f.o, string_agg(c, chr(10) ORDER BY n) AS body FROM gspans f LEFT JOIN (SELECT o, n, CASE n % 5
   WHEN 1 THEN '    from shop.parts.p_' || b || ' import make_' || p || ' as go_' || n WHEN 2 THEN '    import shop.parts.p_' || b || ' as m_' || n
   WHEN 3 THEN '    item.make_' || p || '()' WHEN 4 THEN '    item.price()' ELSE '    from shop.api_' || b || ' import make_' || p || ' as re_' || n END AS c FROM gsites) s USING (o) GROUP BY ALL),
heads AS (SELECT 'shop/orders/o_' || f.ob || '.py' AS path, '函数 order_' || f.o || '()' AS title, 'def order_' || f.o || '(item):' || chr(10) ||
     coalesce(split_part(g.body, chr(10), 1), '    return missing_' || f.o || '()') AS code, f.body + 2 AS n FROM gspans f JOIN gcode g USING (o)
  UNION ALL SELECT DISTINCT 'shop/orders/o_' || ob || '.py', '函数 broken()', 'def broken(:', 1 FROM gspans WHERE ob % 7 = 3
  UNION ALL SELECT DISTINCT 'shop/orders/o_' || ob || '.py', '文件头部', '\"\"\"Orders block ' || ob || '.\"\"\"', 1 FROM gspans WHERE ob % 7 = 3
  UNION ALL SELECT DISTINCT 'shop/parts/p_' || b || '.py', '类 Base' || b, 'class Base' || b || ':' || chr(10) || '    def audit(self):', 3 FROM gparts
  UNION ALL SELECT 'shop/parts/p_' || b || '.py', v.* FROM gparts, LATERAL (VALUES
    ('类 Part' || p, 'class Part' || p || '(Base' || b || '):' || chr(10) || '    def price(self):', 12),
    ('函数 make_' || p || '()', 'def make_' || p || '():' || chr(10) || '    def inner():', 6)) v(title, code, n))
SELECT path, title, code || chr(10) || '    # …（共 ' || n || ' 行，实现省略）' AS skeleton FROM heads
UNION ALL SELECT DISTINCT 'shop/orders/o_' || ob || '.py', '模块说明', '\"\"\"Orders block ' || ob || '.\"\"\"' FROM gspans WHERE ob % 7 <> 3
UNION ALL SELECT DISTINCT 'shop/parts/p_' || b || '.py', '模块说明', '\"\"\"Parts block ' || b || '.\"\"\"' FROM gparts
UNION ALL SELECT 'shop/api_' || b || '.py', '导入依赖', string_agg('from .parts.p_' || b || ' import make_' || p, chr(10) ORDER BY p) FILTER (WHERE k <= 40) || CASE WHEN count(*) > 40 THEN chr(10) || '# …' ELSE '' END
  FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY p) AS k FROM gparts) GROUP BY b""")
def skeleton_text(spark, sf):
    files = mc.modules(spark, sf)
    pieces = segments.with_code(segments.file_segments(files, F.lit(True)), files)
    return pieces.select("path", "title", ck.skeleton_part(F.col("kind"), tx.lines_of(F.col("code"))).alias("skeleton"))


# --- whole-project view -----------------------------------------------------------------------

SQL_ENTRIES = f"""{mc.SQL_MODULES},
blocks AS (SELECT count(DISTINCT b) AS k FROM gparts),
uses AS (SELECT 'shop/parts/p_' || b || '.py' AS path, v.* FROM gparts, blocks, LATERAL (VALUES
    ('Part' || p, 'audit'), ('Part' || p || '.total', 'audit'), ('make_' || p, 'Part' || p), ('make_' || p, 'Part' || p || '.price'),
    (CASE WHEN k = 1 THEN 'Part' || p || '.price' END, 'audit')) v(caller, target) WHERE v.caller IS NOT NULL)"""


@query("entry_references", f"""WITH {SQL_ENTRIES}
SELECT path, caller, CASE WHEN target = 'audit' THEN 'Base' || regexp_extract(path, 'p_(\\d+)', 1) || '.audit' ELSE target END AS target FROM uses""")
def entry_references(spark, sf):
    rows = cut(project_map.extract_entries(mc.modules(spark, sf)), ["fact"])
    found = project_map.entries(rows)
    name = F.concat_ws(".", F.when(F.col("parent") != "", F.col("parent")), "name")
    callers = found.select(F.col("entry_id").alias("caller_id"), "path", name.alias("caller"))
    targets = found.select(F.col("entry_id").alias("target_id"), name.alias("target"))
    return project_map.resolve_references(rows).join(callers, "caller_id").join(targets, "target_id").select("path", "caller", "target")


@query("distinct_references", f"""WITH {SQL_ENTRIES},
refs AS (SELECT 'shop/parts/p_' || b || '.py' AS path, v.* FROM gparts, LATERAL (VALUES
   ('Part' || p, 'self', 'audit'), ('Part' || p, '', 'audit'), ('Part' || p, '', 'super'), ('price', 'self', 'audit'), ('total', '', 'audit'), ('total', '', 'super'),
   ('make_' || p, '', 'Part' || p), ('make_' || p, 'item', 'price'), ('make_' || p, '', 'inner')) v(owner, receiver, name)
  UNION ALL SELECT DISTINCT 'shop/orders/o_' || f.ob || '.py', 'order_' || g.o, CASE n % 5 WHEN 2 THEN 'm_' || n WHEN 3 THEN 'item' WHEN 4 THEN 'item' ELSE '' END,
   CASE n % 5 WHEN 1 THEN 'go_' || n WHEN 4 THEN 'price' WHEN 0 THEN 're_' || n ELSE 'make_' || p END FROM gsites g JOIN gfine f USING (o)
  UNION ALL SELECT 'shop/orders/o_' || ob || '.py', 'order_' || o, '', 'missing_' || o FROM gfine)
SELECT path, owner, receiver, name, count(*) AS owners FROM refs GROUP BY ALL""")
def distinct_references(spark, sf):
    rows = cut(project_map.extract_entries(mc.modules(spark, sf)), ["fact"])
    owners = project_map.entries(rows).select("path", "owner", F.col("name").alias("owner_name"))
    refs = rows.filter("fact = 'reference'").select("path", "owner", "receiver", "name")
    return refs.join(owners, ["path", "owner"]).groupBy("path", F.col("owner_name").alias("owner"), "receiver", "name").agg(
        F.count("*").alias("owners")
    )


@query("project_overview", f"""WITH {SQL_ENTRIES},
paths AS (SELECT DISTINCT 'shop/parts/p_' || b || '.py' AS path FROM gparts UNION SELECT 'shop/api_' || b || '.py' FROM gparts UNION SELECT 'shop/orders/o_' || ob || '.py' FROM gfine),
ents AS (SELECT 'shop/parts/p_' || b || '.py' AS path, 2 + 6 * count(*) AS n FROM gparts GROUP BY b UNION ALL SELECT 'shop/orders/o_' || ob || '.py', count(*) FROM gfine GROUP BY ob),
rated AS (SELECT path, coalesce(n, 0) AS n, CASE WHEN path LIKE 'shop/parts/%' THEN 1 ELSE 0 END AS inbound, CASE WHEN path LIKE 'shop/api%' THEN 1 ELSE 0 END AS deps FROM paths LEFT JOIN ents USING (path)),
central AS (SELECT *, row_number() OVER (ORDER BY inbound DESC, n DESC, deps DESC, path) AS rk FROM rated QUALIFY rk <= 8),
api AS (SELECT name, path, rk, ord FROM central JOIN (SELECT path, qualified_name AS name, start_line AS ord FROM gsym WHERE parent = '') USING (path)),
api12 AS (SELECT *, row_number() OVER (ORDER BY rk, ord) AS k FROM api QUALIFY k <= 12)
SELECT 1 AS line_no, '- 项目包含 ' || count(*) || ' 个可解析 Python 文件、' || sum(n)::BIGINT || ' 个类/函数/方法符号。' AS line FROM rated
UNION ALL SELECT 2, '- 入口点：未识别到常见入口文件'
UNION ALL SELECT 3, '- 中心模块：' || string_agg(path || '（' || inbound || ' 个上游模块）', '、' ORDER BY rk) FROM central
UNION ALL SELECT 4, '- 公共 API：' || string_agg(name || '（' || path || '）', '、' ORDER BY k) FROM api12
UNION ALL SELECT 5, '- 测试组织：未发现 Python 测试文件'""")
def project_overview(spark, sf):
    rows = cut(project_map.extract_entries(mc.modules(spark, sf)), ["fact"])
    return project_map.overview(rows).select("line_no", "line")


@query("entry_points_and_tests", """WITH names AS (SELECT s_suppkey, 'pkg' || s_nationkey || '/' || CASE s_suppkey % 7 WHEN 0 THEN 'main.py' WHEN 1 THEN 'CLI.py' WHEN 2 THEN 'test_' || s_suppkey || '.py'
   WHEN 3 THEN 'Tests/x' || s_suppkey || '.py' WHEN 4 THEN '__main__.py' ELSE 'm' || s_suppkey || '.py' END AS path FROM supplier)
SELECT s_suppkey, path, s_suppkey % 7 IN (0, 1, 4) OR s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_linenumber = 1) AS is_entry, s_suppkey % 7 IN (2, 3) AS is_test FROM names""")
def entry_points_and_tests(spark, sf):
    key = F.col("s_suppkey")
    name = (
        F.when(key % 7 == 0, "main.py").when(key % 7 == 1, "CLI.py").when(key % 7 == 2, F.concat(F.lit("test_"), key, F.lit(".py")))
        .when(key % 7 == 3, F.concat(F.lit("Tests/x"), key, F.lit(".py"))).when(key % 7 == 4, "__main__.py")
        .otherwise(F.concat(F.lit("m"), key, F.lit(".py")))
    )
    # The number keeps paths apart that share a directory and a name.
    files = load(spark, sf, "supplier").select(key, F.concat(F.lit("pkg"), "s_nationkey", F.lit("/"), name).alias("real"), F.concat(key.cast("string"), F.lit("/"), name).alias("path"))
    big = load(spark, sf, "lineitem").filter("l_quantity >= 50 AND l_linenumber = 1").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    mains = files.join(big, "s_suppkey").select("path", F.lit("main").alias("name"))
    return project_map.classify_files(files, mains).select("s_suppkey", F.col("real").alias("path"), "is_entry", "is_test")


@query("segment_table_function", f"""WITH {mc.SQL_MODULES}
SELECT 'shop/parts/p_' || b || '.py' AS path, 2 + 2 * count(*) AS segments, 4 + {mc.PART_LINES} * count(*) AS last_line FROM gparts GROUP BY b
UNION ALL SELECT 'shop/api_' || b || '.py', 1, count(*) FROM gparts GROUP BY b
UNION ALL SELECT 'shop/orders/o_' || ob || '.py', count(*) + 1, max(s + body + 1) FROM gfine GROUP BY ob""")
def segment_table_function(spark, sf):
    """Segments of every module that parses; the table function has no rows for the others."""
    from codequarry.functions import sql

    sql.register(spark)
    mc.modules(spark, sf).createOrReplaceTempView("code_modules")
    return spark.sql(
        "SELECT path, count(*) AS segments, max(end_line) AS last_line FROM code_modules, LATERAL code_segments(content, 'py') GROUP BY path"
    )


@query("code_tree_scan", f"""WITH {mc.SQL_MODULES}
SELECT DISTINCT 'shop/parts/p_' || b || '.py' AS path, 'python' AS language, (4 + {mc.PART_LINES} * count(*))::BIGINT AS line_count FROM gparts GROUP BY b
UNION ALL SELECT 'shop/api_' || b || '.py', 'python', count(*) FROM gparts GROUP BY b
UNION ALL SELECT 'shop/orders/o_' || ob || '.py', 'python', max(s + body + 1) + CASE WHEN ob % 7 = 3 THEN 1 ELSE 0 END FROM gspans GROUP BY ob
UNION ALL SELECT 'shop/__init__.py', 'python', 1 FROM region WHERE r_regionkey = 0""")
def code_tree_scan(spark, sf):
    """Writes the generated corpus as a real source tree from the executors and scans it back."""
    from codequarry.sources import code_tree

    root = f"{shared_dir(spark).rstrip('/').removeprefix('file:')}/codequarry-tree-{uuid.uuid4().hex}"

    if "://" in root:
        raise ValueError("a source tree needs a shared folder that executors can open as files")

    def write(batches):
        for batch in batches:
            for record in batch.to_pylist():
                target = os.path.join(root, record["path"])
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "w", encoding="utf-8") as handle:
                    handle.write(record["content"])
            yield batch.select(["path"])

    package = spark.range(1).select(F.lit("shop/__init__.py").alias("path"), F.lit("x = 1\n").alias("content"))
    every = mc.modules(spark, sf).select("path", "content").unionByName(package)
    cut(every.mapInArrow(write, "path string"))
    roots = spark.range(1).select(F.lit("shop").alias("project_id"), F.lit(root).alias("root"))
    return code_tree.scan_tree(spark, roots).select("path", "language", F.size(tx.lines_of(F.col("content"))).alias("line_count"))
