"""Pieces of modules that differ only in their names are read once.

A piece is a run of top-level statements that begins at a `def` or `class`. Its shape is its text with
every name replaced by its number, in order of first occurrence. Equal shapes have equal syntax trees up to
names, so the rows one of them gives, with names for numbers, are the rows of all.

Pieces that parse one by one parse together, as a piece that ends inside a string, a bracket or a
statement doesn't parse. If one doesn't, the file is read as a whole.
"""

from __future__ import annotations

import keyword
import re
from collections.abc import Callable
from operator import itemgetter

# Words that mean something to the parser or to a reader of trees, and prefixes of strings, stand for themselves.
FIXED = frozenset((
    *keyword.kwlist, *keyword.softkwlist, "self", "cls", "super", "ignore",
    *(p for q in ("r", "b", "u", "f", "t", "rb", "br", "fr", "rf", "tr", "rt") for p in {q, q.upper(), q.title(), q[:-1] + q[-1].upper()}),
))
# Texts of these characters only have one notion of a line and of a word.
_SIMPLE = re.compile(r"[\n -~]*+")
_BEGIN = re.compile(r"^(?!@).*\n(?=def |class |async def )", re.MULTILINE)
# Words that open with an underscore or a digit stand for themselves, too.
_WORD = re.compile(r"(?<!\w)([A-Za-z]\w*+)", re.ASCII)
_DOC_WORD = re.compile(r"(?<!\w)([A-Za-z]\w*+|[0-9]++(?!\w))", re.ASCII)
# A line that is a docstring: it comes right after the head of a definition.
_DOC = re.compile(r'(?:\):|^ *class \w+:)\n *"""([^"\n]*)"""$', re.MULTILINE | re.ASCII)
# No text of simple characters holds this letter, and it may be part of a name.
_MARK = "ʘ"
_MARKED = re.compile(f"{_MARK}([0-9]+){_MARK}")
# Stands between texts that are filled at once; no text of simple characters holds it.
_END = "\0"
# The number of the module's own name.
MODULE = f"{_MARK}0{_MARK}"
_FIXED_WORDS = {word: word for word in FIXED}
# What bounds a helper's memory: shapes held, and characters of one.
SHAPES, SHAPE_CHARS = 2048, 8000


def pieces(text: str) -> list[str] | None:
    """The pieces of a text, which add up to it; None if it has to be read as a whole."""
    if not _SIMPLE.fullmatch(text):
        return None
    cuts = [m.end() for m in _BEGIN.finditer(text)]
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)] if cuts else None


def _words(piece: str) -> list[str]:
    """A piece come apart at its words, which are every second part; numbers in docstrings are words, too.

    If triple quotes only stand around such docstrings, what is between them is text for certain.
    """
    docs = [m.span(1) for m in _DOC.finditer(piece)] if '"""' in piece and "'''" not in piece else []
    if not docs or 2 * len(docs) != piece.count('"""'):
        return _WORD.split(piece)
    parts, at = [""], 0
    for start, end in (*docs, (len(piece), len(piece))):
        for own in (_WORD.split(piece[at:start]), _DOC_WORD.split(piece[start:end])):
            parts[-1] += own[0]
            parts += own[1:]
        at = end
    return parts


class _Marks(dict):
    """What stands for a word: itself if it is fixed, else the next number."""

    def __missing__(self, word: str) -> str:
        mark = self[word] = f"{_MARK}{len(self) - len(_FIXED_WORDS) + 1}{_MARK}"
        return mark


def shape_of(piece: str) -> tuple[str, list[str]]:
    """A piece with numbers for names, and the names from number 1 on."""
    parts, known = _words(piece), _Marks(_FIXED_WORDS)
    parts[1::2] = map(known.__getitem__, parts[1::2])
    return "".join(parts), list(known)[len(_FIXED_WORDS):]


def _filled(value):
    """A value as (format, numbers) if names stand in it, else None."""
    if type(value) is list:
        items = [_filled(item) for item in value]
        return (list, [(item, None) if made is None else made for item, made in zip(value, items, strict=True)]) if any(items) else None
    if type(value) is not str or _MARK not in value:
        return None
    parts = _MARKED.split(value)
    numbers = tuple(int(n) for n in parts[1::2])
    return (None, numbers[0]) if value == f"{_MARK}{numbers[0]}{_MARK}" else ("%s".join(p.replace("%", "%%") for p in parts[::2]), numbers)


def _fill(made, names: list[str]):
    form, numbers = made
    if form is None:
        return names[numbers]
    if form is list:
        return [item[0] if item[1] is None else _fill(item, names) for item in numbers]
    return form % tuple([names[n] for n in numbers])


class Part:
    """Rows of a shape that have the same fields, by column: (the column's name, its values)."""

    def __init__(self, ranks: list[int], rows: list[dict], limits: dict[str, int]):
        self.ranks, self.size, self.fact = ranks, len(rows), rows[0]["fact"]
        self.limits = [(name, limits[name]) for name in rows[0] if name in limits]
        self.same, self.mixed, self.named, self.lines, self.owners = {}, {}, [], [], None
        forms, numbers = [], []
        for name in rows[0]:
            values = [row[name] for row in rows]
            made = [_filled(value) for value in values]
            if name in ("start_line", "end_line"):
                self.lines.append((name, values))
            elif name == "owner":
                self.owners = values
            elif not any(made):
                self.same[name] = values
            elif all(type(value) is str for value in values):
                self.named.append(name)
                for value, found in zip(values, made, strict=True):
                    forms.append("%s" if found and found[0] is None else found[0] if found else value.replace("%", "%%"))
                    numbers += () if not found else found[1] if found[0] else found[1:]
            else:
                self.mixed[name] = list(zip(values, made, strict=True))
        self.form, self.numbers = _END.join(forms), numbers
        self.pick = itemgetter(*numbers) if len(numbers) > 1 else lambda names: tuple(names[n] for n in numbers)

    def columns(self, names: list[str], lines: int, owners: int) -> dict[str, list]:
        done = dict(self.same)
        if self.named:
            # All texts at once; a name that holds the mark between them would come apart.
            cells = (self.form % self.pick(names)).split(_END)
            if len(cells) != self.size * len(self.named):
                left = iter(self.pick(names))
                cells = [re.sub("%[%s]", lambda m: "%" if m[0] == "%%" else next(left), form) for form in self.form.split(_END)]
            for at, name in enumerate(self.named):
                done[name] = cells[at * self.size:(at + 1) * self.size]
        for name, values in self.mixed.items():
            done[name] = [value if made is None else _fill(made, names) for value, made in values]
        for name, limit in self.limits:
            done[name] = [value[:limit] for value in done[name]]
        for name, values in self.lines:
            done[name] = [value + lines for value in values]
        if self.owners is not None:
            done["owner"] = [value + owners for value in self.owners]
        return done


class Block:
    """Rows by column: parts with their columns."""

    def __init__(self, parts: list[Part], names: list[str], lines: int, owners: int = 0):
        self.size = sum(part.size for part in parts)
        self.parts = [(part, part.columns(names, lines, owners)) for part in parts]

    def rows(self) -> list[dict]:
        done: list = [None] * self.size
        for part, columns in self.parts:
            for at, values in zip(part.ranks, zip(*columns.values()), strict=True):
                done[at] = dict(zip(columns, values))
        return done


def rows_of(items: list) -> list[dict]:
    """Rows, some of them given in blocks, one by one."""
    return [row for item in items for row in (item.rows() if type(item) is Block else (item,))]


class Template:
    """Rows of a shape; lines and owners count from the piece's beginning, `limits` cut texts once names are in.

    Rows of the kind `apart` make a block of their own.
    """

    def __init__(self, rows: list[dict], limits: dict[str, int], apart: str | None = None):
        self.groups = []
        for own in ([row for row in rows if row["fact"] == apart], [row for row in rows if row["fact"] != apart]):
            parts: dict[tuple, tuple[list, list]] = {}
            for rank, row in enumerate(own):
                ranks, held = parts.setdefault((row["fact"], *row), ([], []))
                ranks.append(rank)
                held.append(row)
            self.groups.append([Part(ranks, held, limits) for ranks, held in parts.values()])

    def blocks(self, names: list[str], lines: int, owners: int = 0) -> tuple[Block, Block]:
        """The rows of the kind `apart`, and the others."""
        return Block(self.groups[0], names, lines, owners), Block(self.groups[1], names, lines, owners)


class Shapes:
    """Templates by shape. A shape is read with numbers for names once it comes a second time."""

    def __init__(self, read: Callable[[str], Template | None]):
        self.read = read
        self.known: dict[str, Template | None | bool] = {}

    def find(self, piece: str) -> tuple[Template | None, list[str]]:
        """The template of a piece, if there is one, and its names."""
        if len(piece) > SHAPE_CHARS or "\\" in piece:
            return None, []
        shape, names = shape_of(piece)
        found = self.known.get(shape)
        if found is None:
            if len(self.known) >= SHAPES:
                # Shapes that came once go first.
                self.known = {shape: made for shape, made in self.known.items() if made is not True}
                if len(self.known) >= SHAPES // 2:
                    self.known.clear()
            self.known[shape] = True
            return None, names
        if found is True:
            found = self.known[shape] = self.read(shape) or False
        return found or None, names
