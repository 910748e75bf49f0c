"""Column expressions over text: lines, spans, tokens and query terms. All stay in the JVM."""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry.options import DEFAULTS

# The line breaks of Python's str.splitlines().
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
# Patterns that decide which words count as terms.
IDENTIFIER = r"[A-Za-z_][\p{L}\p{N}_]*"
DOTTED_NAME = r"[A-Za-z_][\p{L}\p{N}_]*(?:\.[A-Za-z_][\p{L}\p{N}_]*)?"
FTS_TERM = r"[\p{L}\p{N}]+(?:_[\p{L}\p{N}]+)*"
TOKEN_GAP = r"[^\p{L}\p{N}]+"
WORD_RUN = r"[\p{L}\p{N}_]+"
CJK_RUN = "[\u3400-\u9fff]{2,}"
# Words of a question that never name a symbol.
STOP_IDENTIFIERS = [
    "a", "an", "and", "are", "code", "does", "file", "for", "from", "function", "how", "in", "inside", "is", "it", "of", "or", "please",
    "the", "this", "to", "what", "where", "which", "why",
]


def _accent_pairs() -> tuple[str, str]:
    """Lower-case letters that are one ASCII letter plus one combining mark, and that letter."""
    marked, plain = [], []
    for point in range(0xC0, 0x1F00):
        char = chr(point)
        parts = unicodedata.normalize("NFD", char)
        if len(parts) == 2 and parts[0] in string.ascii_lowercase and unicodedata.combining(parts[1]):
            marked.append(char)
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


ACCENTED, UNACCENTED = _accent_pairs()


def lines_of(text: Column) -> Column:
    """splitlines(): every Unicode line break splits, a trailing empty piece is dropped."""
    pieces = F.split(text, LINE_BREAK)
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def span_of(lines: Column, start: Column, end: Column) -> Column:
    """Text of lines start..end (1-based, inclusive); null when the span is out of bounds."""
    inside = (start >= 1) & (end >= start) & (end <= F.size(lines))
    length = F.when(inside, end - start + 1).otherwise(F.lit(0))
    return F.when(inside, join_lines(F.slice(lines, F.greatest(start, F.lit(1)), length)))


def ascii_lower(text: Column) -> Column:
    """Fold A-Z only, as the NOCASE collation does."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def index_tokens(text: Column) -> Column:
    """Index tokens: letters and digits, case and single accents folded, `_` is a separator."""
    folded = F.translate(F.lower(text), ACCENTED, UNACCENTED)
    return F.array_remove(F.split(folded, TOKEN_GAP), "")


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IDENTIFIER), 0)


def fts_terms(query: Column, limit: int = DEFAULTS.fts_terms) -> Column:
    """Search phrases in query order, repeats kept: a repeated phrase scores again."""
    return F.slice(F.regexp_extract_all(query, F.lit(FTS_TERM), 0), 1, limit)


def literal_terms(query: Column, limit: int = DEFAULTS.literal_terms) -> Column:
    found = F.concat(identifiers(query), F.regexp_extract_all(query, F.lit(CJK_RUN), 0))
    return F.slice(F.array_distinct(found), 1, limit)


def symbol_candidates(query: Column, limit: int | None = DEFAULTS.symbol_candidates) -> Column:
    """Names a query may mean, all of them without a limit; a bare dotted name puts its last part first."""
    whole = F.trim(query)
    lead = F.when(whole.rlike(f"^(?:{DOTTED_NAME})$"), F.array(F.element_at(F.split(whole, r"\."), -1)))
    found = F.array_distinct(F.concat(F.coalesce(lead, F.array().cast("array<string>")), identifiers(query)))
    return found if limit is None else F.slice(found, 1, limit)


def question_identifiers(question: Column, limit: int = DEFAULTS.question_identifiers) -> Column:
    stop = F.array(*[F.lit(word) for word in STOP_IDENTIFIERS])
    kept = F.filter(identifiers(question), lambda word: ~F.array_contains(stop, F.lower(word)))
    return F.slice(F.array_distinct(kept), 1, limit)


def code_identifiers(code: Column, common: list[str]) -> Column:
    """Distinct ASCII names of a snippet, in order, without builtins, keywords and one-letter names."""
    names = F.array_distinct(F.regexp_extract_all(code, F.lit("[A-Za-z_][A-Za-z0-9_]*"), 0))
    skip = F.array(*[F.lit(word) for word in common])
    return F.filter(names, lambda name: (F.length(name) >= 2) & ~F.array_contains(skip, name))


def identifier_at(line: Column, column: Column) -> Column:
    """The ASCII word around a 1-based column; null if none or if it starts with a digit."""
    at = F.least(F.greatest(column - 1, F.lit(0)), F.length(line))
    left = F.regexp_extract(F.substring(line, F.lit(1), at), "[A-Za-z0-9_]*$", 0)
    right = F.regexp_extract(F.substring(line, at + 1, F.length(line)), "^[A-Za-z0-9_]*", 0)
    word = F.concat(left, right)
    return F.when((word != "") & ~word.rlike("^[0-9]"), word)


def estimate_tokens(text: Column) -> Column:
    """Length-based estimate used wherever no real tokenizer is plugged in."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 3).cast("int"))


def numbered(lines: Column, start: Column) -> Column:
    """Prefix each line with its real line number."""
    return join_lines(
        F.transform(lines, lambda line, i: F.concat((start + i).cast("string"), F.lit("| "), line))
    )


def listed(items: Column, separator: str) -> Column:
    return F.array_join(items, separator)


def is_blank(line: Column) -> Column:
    """Nothing but whitespace, in the sense of str.strip()."""
    return line.rlike(r"^(?U)[\s\x1c-\x1f]*$")
