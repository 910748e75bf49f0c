"""Rows by shape equal rows of the whole file, and most pieces of a shape are never parsed."""

import pytest

from codequarry.operators import facts, project_map
from codequarry.operators import shapes as sh
from tests_texts import ODD

PLAIN = '"""Head."""\nimport os\n' + "".join(
    f'''def f_{n}(item: "T{n}", *a, k: Y{n} = g{n}()):
    """Say 100% of f_{n} %s."""
    from p.q_{n} import make_{n} as go_{n}
    x = go_{n}(); x.run_{n}().again(); item.price_{n}()
class C{n}(Base{n}, other.B{n}["s{n}"]):
    def m_{n}(self): return super().m_{n}(self.at_{n}(f"{{h{n}(1)!r:>9}}"))
    def __init__(self): pass
''' for n in range(40)
)


class Eager(sh.Shapes):
    """Reads a shape when it first comes."""

    def find(self, piece):
        self.known.setdefault(sh.shape_of(piece)[0], True)
        return super().find(piece)


def both(text, kind=sh.Shapes):
    for only in (None, "symbol", "import", "call"):
        shapes = kind(lambda shape, only=only: facts.FileFacts.of_shape(shape, only))
        assert facts.file_facts(text, "a.b", False, only, shapes) == facts.file_facts(text, "a.b", False, only)
    assert project_map.module_entries(text, "a.b", kind(project_map._of_shape)) == project_map.module_entries(text, "a.b")


@pytest.mark.parametrize("kind", [sh.Shapes, Eager])
@pytest.mark.parametrize("text", [PLAIN, *ODD])
def test_rows_by_shape_equal_whole_files(text, kind):
    both(text, kind)
    both(text + PLAIN, kind)
    both(PLAIN + text + PLAIN, kind)


def test_equal_shapes_are_parsed_twice_at_most(monkeypatch):
    parsed = []
    plain = facts.parse
    monkeypatch.setattr(facts, "parse", lambda text, *a, **k: parsed.append(text) or plain(text, *a, **k))
    facts.file_facts(PLAIN, "a.b", False, "call", facts.fact_shapes("call"))
    # The head, and per shape the first piece and the shape itself.
    assert len(parsed) == 5, len(parsed)


def test_long_names_are_cut_as_in_whole_files():
    text = "".join(f"def f{n}({'a' * 60}{n}, {'b' * n * 40}x):\n    '''{'w' * n * 50}z {'v' * 100}.'''\n    return {'b' * n * 40}x()\n" for n in range(1, 12))
    both(text, Eager)
    both(text)


def test_numbers_in_docstrings_do_not_make_shapes():
    text = "".join(f"class Part{n}(Base):\n    def size(self, v: int):\n        \"\"\"Set {n}.\"\"\"\n        self.v{n}({n})\n" for n in (1, 20, 300))
    shapes = [sh.shape_of(piece)[0] for piece in sh.pieces(text.replace("({n})", "()"))]
    assert len({sh.shape_of(piece.replace(f"({n})", "()"))[0] for n, piece in zip((1, 20, 300), sh.pieces(text))}) == 1 < len(set(shapes))
    both(text.replace("self.v", "self.w") + PLAIN, Eager)
    # Between strings a number is code.
    for odd in ('x = """\n(a):\n"""if 007 else"""\n"""\n', 'def f(a: (\n    """1"""), b=1): a.b()\n', "def f(a):\n    \"\"\"1 'x\"\"\"\n    a.b('\"\"\"')\n"):
        both("def g(): pass\n" + odd + odd + PLAIN, Eager)


def test_shapes_that_come_once_make_room_for_others(monkeypatch):
    monkeypatch.setattr(sh, "SHAPES", 8)
    shapes = sh.Shapes(lambda shape: sh.Template([{"fact": "call", "name": sh.MODULE}], {}))
    shapes.find("def ab(): pass\n")
    assert shapes.find("def cd(): pass\n")[0] is not None
    for n in range(50):
        shapes.find(f"def ab(): return {n}\n")
    assert len(shapes.known) <= 9 and shapes.known[sh.shape_of("def ab(): pass\n")[0]] is not True


def test_a_name_that_holds_the_mark_between_texts():
    rows = [{"fact": "call", "name": f"{sh.MODULE}.100%", "callee": "a%b"}, {"fact": "call", "name": "x", "callee": sh.MODULE}]
    found = sh.rows_of([*sh.Template(rows, {}).blocks(["m\0n"], 0)])
    assert found == [{"fact": "call", "name": "m\0n.100%", "callee": "a%b"}, {"fact": "call", "name": "x", "callee": "m\0n"}]


def test_pieces_that_define_one_name_are_read_together():
    text = "".join(f"def f{n % 3}(a{n}):\n    a{n}.go()\n" for n in range(9))
    both(text, Eager)
    assert [r["name"] for r in facts.file_facts(text, "m", False, "symbol", facts.fact_shapes("symbol"))] == ["f0", "f1", "f2"]
