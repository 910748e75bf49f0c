"""Fact extraction, resolution and structure on small source trees."""

import ast
import random
import re

from pyspark.sql import functions as F

from codequarry.functions import paths as px
from codequarry.operators import chunks as ck
from codequarry.operators import facts as fa
from codequarry.operators import project_map, resolve, segments

TREE = {
    "alpha.py": "def run():\n    return 1\n\nclass Store:\n    def save(self):\n        return 1\n",
    "beta.py": "def run():\n    return 2\n\nclass Store:\n    def save(self):\n        return 2\n",
    "client.py": (
        "from beta import run as go, Store\nimport beta as bb\n\ndef main(thing):\n    go()\n    bb.run()\n    s = Store()\n    s.save()\n    thing.save()\n"
    ),
    "base.py": "class Animal:\n    def speak(self):\n        return ''\n",
    "dog.py": (
        "from base import Animal\n\nclass Dog(Animal):\n    def bark(self):\n        super().speak()\n        self.speak()\n\n"
        "class Kennel:\n    def __init__(self):\n        self.pet = Dog()\n\n    def all(self, other: 'Dog | None'):\n        self.pet.bark()\n        other.speak()\n"
    ),
    "nest.py": "def outer():\n    def inner():\n        return 0\n    return inner()\n\ndef inner():\n    return 1\n",
    "pkg/__init__.py": "from .core import work\n",
    "pkg/core.py": "def work():\n    return 1\n",
    "pkg/use.py": "from . import work\n\ndef call():\n    return work()\n",
    "ring_a.py": "from ring_b import ghost\n\ndef ask():\n    return ghost()\n",
    "ring_b.py": "from ring_a import ghost\n",
    "twice.py": "class T:\n    @property\n    def v(self):\n        return 1\n\n    @v.setter\n    def v(self, x):\n        self.x = x\n\n    def w(self):\n        pass\n",
    "broken.py": "def half(:\n    pass\n",
}


def corpus(spark, tree):
    rows = [("p", i, path, source) for i, (path, source) in enumerate(sorted(tree.items()))]
    files = spark.createDataFrame(rows, "project_id string, file_id long, path string, content string")
    return files.withColumn("module", px.module_name(F.col("path")))


def test_cross_file_resolution(spark):
    facts = fa.extract_facts(corpus(spark, TREE)).cache()
    symbols, imports = fa.symbols(facts), fa.imports(facts)
    calls = resolve.with_caller_ids(fa.calls(facts), symbols)
    done = resolve.resolve_calls(calls, symbols, imports).join(
        symbols.select(F.col("symbol_id").alias("target_symbol_id"), "symbol_key"), "target_symbol_id", "left"
    )
    found = {(r.path, r.start_line, r.callee_expr): (r.symbol_key, r.resolution_status, r.confidence) for r in done.collect()}
    expected = {
        ("client.py", 5, "go"): ("beta:run", "resolved", 1.0),
        ("client.py", 6, "bb.run"): ("beta:run", "resolved", 1.0),
        ("client.py", 7, "Store"): ("beta:Store", "resolved", 1.0),
        ("client.py", 8, "s.save"): ("beta:Store.save", "resolved", 1.0),
        ("client.py", 9, "thing.save"): (None, "ambiguous", 0.0),
        ("dog.py", 5, "super.speak"): ("base:Animal.speak", "resolved", 0.95),
        ("dog.py", 5, "super"): (None, "unresolved", 0.0),
        ("dog.py", 6, "self.speak"): ("base:Animal.speak", "resolved", 0.9),
        ("dog.py", 10, "Dog"): ("dog:Dog", "resolved", 0.9),
        ("dog.py", 13, "self.pet.bark"): ("dog:Dog.bark", "resolved", 1.0),
        ("dog.py", 14, "other.speak"): ("base:Animal.speak", "resolved", 0.9),
        ("nest.py", 4, "inner"): ("nest:inner", "resolved", 0.9),
        ("pkg/use.py", 4, "work"): ("pkg.core:work", "resolved", 1.0),
        ("ring_a.py", 4, "ghost"): (None, "unresolved", 0.0),
    }
    assert {k: v for k, v in found.items() if k in expected} == expected
    # A name that is also defined at module level resolves there first; the nested one needs its scope.
    only_nested = {"n.py": "def outer():\n    def inner():\n        return 0\n    return inner()\n"}
    facts = fa.extract_facts(corpus(spark, only_nested)).cache()
    symbols = fa.symbols(facts)
    row = resolve.resolve_calls(fa.calls(facts), symbols, fa.imports(facts)).first()
    assert (row.resolution_status, row.confidence) == ("resolved", 0.9)


def test_extraction_details(spark):
    facts = fa.extract_facts(corpus(spark, TREE)).cache()
    rows = {r.symbol_key: r for r in fa.symbols(facts).collect()}
    setter = rows["twice:T.v"]
    assert (setter.start_line, setter.end_line, setter.signature, setter.parent) == (6, 8, "def v(self, x):", "T")
    assert setter.ord < rows["twice:T.w"].ord
    assert rows["dog:Dog"].bases == ["Animal"]
    assert {r.path for r in fa.parse_errors(facts).collect()} == {"broken.py"}
    bound = {(r.path, r.local_name): (r.target_module, r.imported_name, r.level) for r in fa.imports(facts).collect()}
    assert bound[("pkg/use.py", "work")] == ("pkg", "work", 1)
    assert bound[("pkg/__init__.py", "work")] == ("pkg.core", "work", 1)


def test_relative_modules_as_columns(spark):
    cases = [("a.b.c", False, "x", 1), ("a.b.c", False, None, 2), ("a.b", True, "x.y", 1), ("a", False, "x", 3), ("", False, "m", 1), ("a.b", False, "os", 0)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, m string, p boolean, n string, l int")
    found = {r.i: r.v for r in rows.select("i", px.absolute_module(F.col("m"), F.col("p"), F.col("n"), F.col("l")).alias("v")).collect()}
    assert found == {0: "a.b.x", 1: "a", 2: "a.b.x.y", 3: "x", 4: "m", 5: "os"}
    for i, (module, package, name, level) in enumerate(cases):
        assert fa.FileFacts("", module, package)._absolute(name or "", level) == found[i]


def test_segments_cover_every_line_once(spark):
    rng = random.Random(3)
    big_class = "class Big:\n    limit = 3\n" + "".join(f"    def m{i}(self):\n" + "        x = 1\n" * 8 + "\n" for i in range(9)) + "    tail = 1\n"
    long_function = "def long():\n" + "".join(f"    v{i} = {i}\n" for i in range(400))
    tree = {
        "a.py": '"""Doc."""\n\nimport os\nimport sys\n\n# note\nX = 1\nY = 2\n\nprint(X)\n\n@dec\ndef f():\n    pass\n\nif __name__ == "__main__":\n    f()\n',
        "big.py": big_class, "long.py": long_function, "bad.py": "import os\n\n@x\ndef f(:\n    pass\n\nclass C:\n    pass\nif __name__:\n    f()\n",
        "notes.txt": "\n".join(rng.choice(["", "word", "more words"]) for _ in range(333)), "mess.py": "def (\n  zzz\n", "one.py": "x = 1",
    }
    files = corpus(spark, tree)
    rows = segments.with_code(segments.file_segments(files, F.col("path").endswith(".py")), files).orderBy("path", "segment_no").collect()
    for path, source in tree.items():
        own = [r for r in rows if r.path == path]
        covered = [n for r in own for n in range(r.start_line, r.end_line + 1)]
        assert covered == list(range(1, len(source.splitlines()) + 1)), path
        assert "\n".join(r.code for r in own) == "\n".join(source.splitlines())
    kinds = [(r.kind, r.title) for r in rows if r.path == "a.py"]
    assert [k for k, _ in kinds] == ["docstring", "imports", "globals", "code", "function", "main"]
    assert [r.kind for r in rows if r.path == "big.py"] == ["class_header"] + ["method"] * 9 + ["class_header"]
    assert [r.title for r in rows if r.path == "long.py"] == [f"函数 long() · 第{n}部分" for n in (1, 2, 3)]
    assert [r.kind for r in rows if r.path == "bad.py"] == ["imports", "function", "class", "main"]
    assert {r.strategy for r in rows if r.path == "mess.py"} == {"generic"}
    assert ast.parse(tree["a.py"])


def test_chunk_boundaries(spark):
    for n in (1, 10, 11, 79, 80, 81, 90, 91, 150, 151, 160, 161, 500):
        start, expected = 0, []
        while True:
            end = min(n, start + 80)
            expected.append((start + 1, end))
            if end >= n:
                break
            start = end - 10
        files = spark.createDataFrame([(1, ["x"] * n, n)], "file_id int, lines array<string>, line_count int")
        found = [(r.start_line, r.end_line) for r in ck.text_chunks(files).orderBy("start_line").collect()]
        assert found == expected, n


LAYERED = {
    "cli.py": "from services import api as svc\nfrom services.api import Service\n\ndef main():\n    s = Service()\n    s.handle()\n    svc.ping()\n",
    "services/__init__.py": "", "services/api.py": (
        '"""Service layer."""\nfrom models.user import User\n\ndef ping():\n    return clean("x")\n\n\nclass Service:\n    def handle(self):\n        u = User()\n        return self.finish(u)\n\n'
        "    def finish(self, u):\n        return u.label()\n"
    ),
    "models/user.py": "from utils.text import clean\n\nclass User:\n    def label(self):\n        return clean('n')\n",
    "utils/text.py": "def clean(v):\n    return v\n", "decoy.py": "def clean(v):\n    return None\n\ndef ping():\n    return None\n", "tests/test_cli.py": "import cli\n",
}


def test_preference_resolution_and_overview(spark):
    rows = project_map.extract_entries(corpus(spark, LAYERED)).cache()
    names = {r.entry_id: f"{r.path}:{r.parent + '.' if r.parent else ''}{r.name}" for r in project_map.entries(rows).collect()}
    edges = {(names[r.caller_id], names[r.target_id]) for r in project_map.resolve_references(rows).collect()}
    assert ("cli.py:main", "services/api.py:Service") in edges
    assert ("cli.py:main", "services/api.py:Service.handle") in edges
    assert ("cli.py:main", "services/api.py:ping") in edges
    assert ("services/api.py:Service.handle", "services/api.py:Service.finish") in edges
    assert ("models/user.py:User.label", "utils/text.py:clean") in edges
    assert not any(target == "decoy.py:ping" for _, target in edges)
    text = "\n".join(r.line for r in project_map.overview(rows).orderBy("line_no").collect())
    assert "入口点：cli.py" in text and "测试组织：tests/test_cli.py" in text and "utils/text.py（1 个上游模块）" in text


def test_related_sources_reach_two_hops(spark):
    files = corpus(spark, LAYERED)
    rows = project_map.extract_entries(files).cache()
    asked = spark.createDataFrame([(1, "cli.py", "s = Service()\ns.handle()\n")], "request_id long, path string, code string")
    full = project_map.related_sources(asked, rows, files, max_symbols=8).first().sources
    assert "class Service" in full and "第 1 层依赖" in full and "class User" in full and "上游调用方" in full
    short = project_map.related_sources(asked, rows, files, max_symbols=8, max_chars=150).first().sources
    assert len(short) <= 160 and "—— 定义于" in short


TURNS = {
    **LAYERED, "turns.py": (
        "from utils.text import clean as tidy\nimport utils.text as ut\nfrom services.api import Service as S\nimport services.api as api\n\n"
        "def renamed():\n    return tidy(1)\n\ndef by_module():\n    return ut.clean(2)\n\ndef static():\n    return S.handle(None)\n\n"
        "def only(v):\n    return v.finish(1)\n\ndef qualified():\n    s = api.Service()\n    return s.handle()\n\n"
        "def aliased():\n    s = S()\n    s.finish(static())\n\nclass Twice:\n    def clean(self):\n        return self.again()\n\n"
        "    def again(self):\n        return self.clean()\n\n    def ping(self):\n        return qualified(ping())\n"
    ),
    "pad.py": "\n".join(f"def pad_{i}(v):\n    return pad_{i + 1}(v.pad())\n" for i in range(300)),
}


def test_related_sources_resolve_only_what_is_asked(spark, monkeypatch):
    """The same links as by resolving every reference, from the few entries and references that can make them."""
    files = corpus(spark, TURNS)
    rows = project_map.extract_entries(files).cache()
    found = {r.entry_id: r for r in project_map.entries(rows).collect()}
    told = {k: f"{'类' if r.kind == 'class' else f'类 {r.parent} 的方法' if r.kind == 'method' else '函数'} {r.name}" for k, r in found.items()}
    links = project_map.resolve_references(rows).collect()
    firsts = {}
    for key, r in sorted(found.items(), key=lambda item: item[1].owner):
        if r.path != "pad.py":
            firsts.setdefault((r.path, r.name), key)
    requests = [(i, path, f"{name}()\n") for i, (path, name) in enumerate(firsts)]
    assert len(requests) == 20

    sizes, whole = [], project_map.resolve_uses

    def counted(*args):
        entries = next(a for a in args if a is not None and "place" in a.columns)
        sizes.append((args[0].count(), entries.count()))
        return whole(*args)

    monkeypatch.setattr(project_map, "resolve_uses", counted)
    asked = spark.createDataFrame(requests, "request_id long, path string, code string")
    got = {r.request_id: r.sources for r in project_map.related_sources(asked, rows, files, max_symbols=50, max_chars=100_000).collect()}
    assert sizes and all(refs < 100 and entries < 100 for refs, entries in sizes)
    for (number, _, _), start in zip(requests, firsts.values(), strict=True):
        depth, queue = {start: 0}, [start]
        for node in queue:
            for link in sorted((x for x in links if x.caller_id == node and depth[node] < 2), key=lambda x: x.ord):
                if link.target_id not in depth:
                    depth[link.target_id] = depth[node] + 1
                    queue.append(link.target_id)
        expected = [("直接相关" if not depth[k] else f"第 {depth[k]} 层依赖", told[k], found[k].path) for k in queue]
        assert re.findall(r"<!-- (.*?) -->\n### (.*?) —— 定义于 (\S+)", got[number]) == expected, requests[number]
        callers = sorted(x.caller_id for x in links if x.target_id == start)[:12]
        assert re.findall(r"- 调用方 (.*?)：(\S+) 第", got[number]) == [(told[k], found[k].path) for k in callers], requests[number]
    assert sum("上游调用方" in text for text in got.values()) > 8


def test_first_callers_of_a_much_called_entry(spark):
    """Cutting each entry to its first callers leaves the first callers of a request as they are."""
    links = spark.createDataFrame([(f"c{i:03}", dst, 0) for i in range(60) for k, dst in enumerate("abc") if i % (k + 2) == 0], "src string, dst string, ord int")
    asked = [(1, "a", 0), (1, "b", 1), (2, "c", 0), (2, "a", 2), (3, "b", 0), (4, "z", 0)]
    seeds = spark.createDataFrame(asked, "request_id long, node string, ord int")
    pairs = [(r.src, r.dst) for r in links.collect()]
    expected = {}
    for request in (1, 2, 3):
        best = {}
        for _, node, place in (row for row in asked if row[0] == request):
            for src in [src for src, dst in pairs if dst == node]:
                best[src] = min(place, best.get(src, place))
        expected[request] = sorted(best, key=lambda src: (best[src], src))[:12]
    got = {}
    for r in project_map.first_callers(seeds, links).orderBy("request_id", "n").collect():
        got.setdefault(r.request_id, []).append(r.node)
    assert got == expected


def test_reexports_through_a_ladder_of_diamonds(spark):
    """Each rung has two ways on, so there are 2^20 paths; every (module, name) is visited once."""
    rungs = 20
    bindings = []
    for i in range(rungs):
        for side in "ab":
            bindings += [("p", f"m{i}", "", f"n{side}", f"{side}{i}", f"n{side}", False), ("p", f"m{i}", "", "n", f"{side}{i}", "n", False)]
            bindings.append(("p", f"{side}{i}", "", "n", f"m{i + 1}", "n", False))
    # A circle on the way, and a name that leads nowhere.
    bindings += [("p", "a3", "", "n", "m2", "n", False), ("p", "m0", "", "lost", "m0", "lost", False)]
    imports = spark.createDataFrame(
        bindings, "project_id string, module string, binding_scope string, local_name string, target_module string, imported_name string, is_star boolean"
    )
    symbols = spark.createDataFrame([("p", f"m{rungs}", "n", "n", 7), ("q", "m5", "n", "n", 8)], "project_id string, module string, qualified_name string, name string, symbol_id long")
    keys = spark.createDataFrame([("p", "m0", "n"), ("p", "M3", "N"), ("p", "m0", "lost"), ("q", "m0", "n")], "project_id string, module string, name string")
    found = {(r.project_id, r.root_m, r.root_n, r.symbol_id) for r in resolve.exported(keys, symbols, imports).collect()}
    assert found == {("p", "m0", "n", 7), ("p", "m3", "n", 7)}


PLACED = {
    "core/base.py": '"""Shared ground."""\n\ndef root():\n    pass\n\nclass Base:\n    def run(self):\n        return root()\n',
    "core/mid.py": '"""Between."""\nfrom core.base import Base, root\n\nclass Mid(Base):\n    def go(self):\n        return root()\n\ndef build():\n    return Mid()\n',
    "top.py": "from core.mid import build\nimport core.base\n\ndef start():\n    build()\n    return core.base.root()\n",
    "other.py": "from core.mid import build, Mid\n\ndef again():\n    build()\n    build()\n\nclass User:\n    def use(self):\n        return build()\n",
    "alone.py": "x = 1\n",
}


def placed(spark, opened):
    files = [(project, i, path, path[:-3].replace("/", "."), text) for project in ("p", "q") for i, (path, text) in enumerate(PLACED.items())]
    rows = project_map.extract_entries(spark.createDataFrame(files, "project_id string, file_id long, path string, module string, content string")).cache()
    asked = spark.createDataFrame(opened, "project_id string, path string")
    found = {}
    for row in project_map.position(rows, asked).orderBy("project_id", "line_no", "part").collect():
        found.setdefault(row.project_id, []).append(row.line)
    return rows, asked, found


def test_place_of_the_open_file(spark):
    """Two projects hold the same files; each is told of its own open one."""
    rows, asked, found = placed(spark, [("p", "core/mid.py"), ("q", "top.py")])
    assert found["p"] == [
        "## 当前文件在项目中的位置", "- 当前文件：core/mid.py（模块 core.mid）", "- 模块职责：Between.", "- 对外定义：Mid、build", "- 项目内依赖链：",
        "  - 第 1 层依赖 core/base.py（Shared ground.）", "- 被以下文件引用：other.py、top.py", "- 已识别的上游调用：",
        "  - core/mid.py 中的 函数 build 调用当前文件的 类 Mid", "  - other.py 中的 函数 again 调用当前文件的 函数 build",
        # A class calls what its methods call.
        "  - other.py 中的 类 User 调用当前文件的 函数 build", "  - other.py 中的 类 User 的方法 use 调用当前文件的 函数 build",
        "  - top.py 中的 函数 start 调用当前文件的 函数 build",
    ]
    assert found["q"] == [
        "## 当前文件在项目中的位置", "- 当前文件：top.py（模块 top）", "- 对外定义：start", "- 项目内依赖链：",
        # `import core.base` binds `core`, which is no file here.
        "  - 第 1 层依赖 core/mid.py（Between.）", "  - 第 2 层依赖 core/base.py（Shared ground.）",
    ]
    texts = {r.project_id: r.text for r in project_map.overview_text(rows, asked, 4500).collect()}
    assert texts["p"].endswith("\n".join(found["p"])) and texts["p"].startswith("- 项目包含 5 个")
    short = {r.project_id: r.text for r in project_map.overview_text(rows, asked, 120).collect()}
    assert all(len(t) == 120 and texts[p].startswith(t[:60]) and t.endswith("已省略较低优先级文件）") for p, t in short.items())


def test_place_of_a_file_that_is_not_there(spark):
    assert placed(spark, [("p", "missing.py"), ("q", "alone.py")])[2] == {"q": ["## 当前文件在项目中的位置", "- 当前文件：alone.py（模块 alone）"]}


def test_resolved_calls_bring_their_target_and_take_the_innermost_scope(spark):
    """No join on the target afterwards, and no key wider than the call's number."""
    tree = {"n.py": "def f():\n    return 0\ndef outer():\n    def f():\n        return 1\n    def mid():\n        def g():\n            return 2\n        def low():\n            return g()\n        return low()\n    return mid()\n"}
    facts = fa.extract_facts(corpus(spark, tree))
    symbols = fa.symbols(facts)
    done = resolve.resolve_calls(fa.calls(facts), symbols, fa.imports(facts), ("symbol_key",))
    assert "sha2" not in done._jdf.queryExecution().toString()
    found = {r.start_line: (r.target_symbol_key, r.resolution_status, r.confidence) for r in done.collect()}
    assert found == {10: ("n:outer.mid.g", "resolved", 0.9), 11: ("n:outer.mid.low", "resolved", 0.9), 12: ("n:outer.mid", "resolved", 0.9)}


def test_later_sources_are_asked_only_what_is_open(spark, monkeypatch):
    from codequarry.operators import lookup

    tree = {"a.py": "def f():\n    return 0\n", "b.py": "from a import f\ndef g():\n    return f()\n"}
    facts = fa.extract_facts(corpus(spark, tree))
    asked = spark.createDataFrame(
        [(1, "p", "b.py", 3, "f"), (2, "p", "b.py", None, "f"), (3, "p", "b.py", None, "g")], "request_id long, project_id string, path string, line int, expression string"
    )
    reached, plain = [], lookup.definitions
    monkeypatch.setattr(lookup, "definitions", lambda requests, *rest: (reached.extend(r.request_id for r in requests.collect()), plain(requests, *rest))[1])
    found = resolve.resolve_expressions(asked, fa.symbols(facts), fa.imports(facts), 8)
    names = {r.symbol_id: r.symbol_key for r in fa.symbols(facts).collect()}
    assert {(r.request_id, r.source, names[r.symbol_id]) for r in found.collect()} == {(1, 0, "b:g"), (2, 1, "a:f"), (3, 2, "b:g")}
    assert reached == [3]
