"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a classifier decides.

Candidates are spans of six kinds found by patterns in the whole text. Labelers vote on each: its
shape, its validity (checksum, ranges, lengths), a gazetteer (issuer prefixes, country codes, public
mail endings) and the words around it. Votes are +1, 0 (abstains) or -1. Expectation-maximisation
over the counts of vote patterns estimates how reliable every labeler is without labelled data; the
pattern table has at most 3^4 rows per kind whatever the corpus holds, so it is the only thing that
comes to the driver. With the posteriors as soft labels, a naive Bayes classifier is trained on the
span's own features and its log odds decide. Spans of the four base kinds that pass their rule stay
in any case; the classifier adds spans of other kinds.

Texts are scanned inside the JVM with possessive patterns, so one long token costs linear time and
no stack. Offsets count code points. Nothing is shuffled but the small count tables.

Defined results: a null text is an empty one; a document without candidates has an empty span list;
repeated rows each keep their own result; an empty table gives an empty result and no model.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import let, pick, running_sum
from codequarry.session import cut

# The base kinds and their order are given; the others follow by name.
BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("local_phone", "secret")
KINDS = BASE_KINDS + EXTRA_KINDS

# A run may only start where the character before can't belong to it, or where the last match ended:
# that leaves the matches as they are and keeps a failing long run from being tried at every place.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9A-Za-z+(.-])(?<!\+[0-9] )\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{32,}+|[A-Z]{4}[0-9A-Z]{16,}+|[A-Za-z0-9_-]{20,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)(?![0-9A-Za-z])",
}
#: A cheap test without which a text can't hold the kind.
HINTS = {
    "email": lambda text: text.contains("@"),
    "ip": lambda text: text.rlike(r"[0-9]\.[0-9]"),
    "card": lambda text: text.rlike(r"[0-9][0-9\x20-]{14}"),
    "phone": lambda text: text.rlike(r"\+[0-9]"),
    "local_phone": lambda text: text.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
    "secret": lambda text: text.rlike(r"[0-9A-Za-z_-]{20}"),
}
# Words that announce a kind, and words that announce something else.
CONTEXT = {
    "email": r"(?iu)(e-?mail|mail|contact|kontakt|correo|courriel|write|address)",
    "ip": r"(?iu)(\bip\b|host|server|from|address|adresse|login)",
    "card": r"(?iu)(card|karte|carte|tarjeta|visa|master|credit|pay)",
    "phone": r"(?iu)(tel|phone|call|mobile|fax|anruf|llama|appel)",
    "local_phone": r"(?iu)(tel|phone|call|mobile|fax|anruf|llama|appel)",
    "secret": r"(?iu)(token|secret|key|passw|pwd|bearer|auth|credential)",
}
AGAINST = r"(?iu)(version|\bv\b|release|isbn|order|invoice|sha-?[0-9]*|md5|commit|checksum|digest)[^\p{L}]*$"
# Issuer prefixes of payment cards, public mail endings.
GAZETTEER = {
    "email": r"(?i)\.(com|org|net|edu|gov|info|io|de|fr|es|uk|it|eu)$",
    "ip": r"^(?!0|127|255|22[4-9]|23|24|25)",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "local_phone": r"^\(?[2-9][0-9]{2}\)?[\x20.-][2-9]",
    "secret": r"^(AKIA|ASIA|[0-9a-f]{32}$|[0-9a-f]{40}$|[0-9a-f]{64}$|ey)",
}
LABELERS = ("shape", "valid", "gazetteer", "context")
REACH = 40


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    reversed_digits = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(
            F.filter(reversed_digits, lambda d: d != ""),
            lambda d, i: let(d.cast("int") * (1 + i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x)),
        ),
        F.lit(0), lambda a, x: a + x,
    )
    return total % 10 == 0


def _octets(span: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        number = F.when(bare == "", F.lit(0)).otherwise(F.substring(bare, 1, 3).cast("int"))
        return (F.length(bare) <= 3) & (number <= 255)

    return F.forall(F.split(span, r"\."), small)


def rule(kind: str, span: Column) -> Column:
    """The kind's own test of a match; the base kinds' are fixed."""
    n = F.length(_digits(span))
    return {
        "email": F.lit(True),
        "ip": _octets(span),
        "card": n.between(16, 19) & luhn(_digits(span)),
        "phone": n.between(8, 15),
        "local_phone": n == 10,
        "secret": span.rlike("[0-9]") & (F.size(F.array_distinct(F.split(span, ""))) >= 8),
    }[kind]


def spans(text: Column, kind: str) -> Column:
    """array<struct<kind, start, stop, votes..., features>> of the kind's matches, leftmost and non-overlapping.

    The text between the matches and the matches themselves add up to the offsets.
    """
    pattern = PATTERNS[kind]

    def between(pieces: Column) -> Column:
        return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: placed(pieces, found))

    def placed(pieces: Column, found: Column) -> Column:
        steps = F.transform(found, lambda m, i: (F.length(F.get(pieces, i)) + F.length(m)).cast("bigint"))
        return let(
            running_sum(steps),
            lambda ends: F.transform(
                found,
                lambda m, i: described(kind, m, F.get(ends, i), F.get(pieces, i), F.get(pieces, i + 1)),
            ),
        )

    def described(kind: str, span: Column, stop: Column, before: Column, after: Column) -> Column:
        left = F.right(before, F.lit(REACH))
        valid = rule(kind, span)
        near = left.rlike(CONTEXT[kind]) | F.left(after, F.lit(REACH)).rlike(CONTEXT[kind])
        against = left.rlike(AGAINST)
        glued = F.right(before, F.lit(1)).rlike(r"[\p{L}0-9]") | F.left(after, F.lit(1)).rlike(r"[\p{L}0-9]")
        vote = lambda yes, no: F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0)).cast("int")
        return F.struct(
            F.lit(kind).alias("kind"), (stop - F.length(span)).alias("start"), stop.alias("stop"), valid.alias("valid"),
            vote(~glued, glued).alias("shape"), vote(valid, ~valid).alias("rule"),
            vote(span.rlike(GAZETTEER[kind]), F.lit(False)).alias("gazetteer"), vote(near & ~against, against).alias("context"),
            F.least(F.length(span), F.lit(64)).alias("size"), F.size(F.array_distinct(F.split(span, ""))).alias("variety"),
        )

    nothing = F.array().cast(
        "array<struct<kind:string,start:bigint,stop:bigint,valid:boolean,shape:int,rule:int,gazetteer:int,context:int,size:int,variety:int>>"
    )
    found = F.when(HINTS[kind](text), let(F.split(text, pattern, -1), between))
    # Matches that fail a base kind's rule are dropped for good; other kinds keep theirs for the vote.
    if kind in BASE_KINDS:
        found = F.filter(found, lambda s: s["valid"])
    return F.coalesce(found, nothing)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and the array of candidate spans of every row."""
    plain = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return plain.select("doc_id", F.concat(*[spans(F.col("text"), kind) for kind in KINDS]).alias("spans"))


@dataclass
class Model:
    """Labelers' reliabilities per kind, and the classifier's log odds by feature value."""

    prior: dict[str, float] = field(default_factory=dict)
    right: dict[tuple[str, str, int, bool], float] = field(default_factory=dict)
    posterior: dict[tuple[str, tuple[int, ...]], float] = field(default_factory=dict)
    bias: dict[str, float] = field(default_factory=dict)
    weight: dict[tuple[str, str, int], float] = field(default_factory=dict)


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 30) -> Model:
    """Expectation-maximisation over (kind, votes, count); at most 81 vote patterns per kind.

    Each labeler has a distribution of votes for true and for false spans. It starts from the belief
    that votes are right, which fixes which of the two classes is which, and the same belief stays in
    as pseudo-counts, so that a labeler that never varies can't turn over.
    """
    model = Model()
    for kind in sorted({k for k, _, _ in patterns}):
        rows = [(votes, n) for k, votes, n in patterns if k == kind]
        believed = {(j, v, real): (4.0 if v == (1 if real else -1) else 2.0 if v == 0 else 1.0) for j in range(len(LABELERS)) for v in (-1, 0, 1) for real in (True, False)}
        prior = 0.5
        chance = {key: value / 7.0 for key, value in believed.items()}
        after: dict[tuple[int, ...], float] = {}
        for _ in range(rounds):
            for votes, _n in rows:
                odds = log(prior / (1 - prior)) + sum(log(chance[j, v, True] / chance[j, v, False]) for j, v in enumerate(votes))
                after[votes] = 1 / (1 + exp(-max(-500.0, min(500.0, odds))))
            sums = dict(believed)
            real_n = 1.0 + sum(n * after[v] for v, n in rows)
            false_n = 1.0 + sum(n * (1 - after[v]) for v, n in rows)
            for votes, n in rows:
                for j, v in enumerate(votes):
                    sums[j, v, True] += n * after[votes]
                    sums[j, v, False] += n * (1 - after[votes])
            prior = real_n / (real_n + false_n)
            chance = {(j, v, real): x / sum(sums[j, u, real] for u in (-1, 0, 1)) for (j, v, real), x in sums.items()}
        model.prior[kind] = prior
        model.right |= {(kind, LABELERS[j], v, real): x for (j, v, real), x in chance.items()}
        model.posterior |= {(kind, votes): p for votes, p in after.items()}
    return model


def _features() -> dict[str, Column]:
    """Features of a span, each with few values: its votes, its length and how many characters differ."""
    return {
        "shape": F.col("s.shape"), "valid": F.col("s.rule"), "gazetteer": F.col("s.gazetteer"), "context": F.col("s.context"),
        "size": F.floor(F.col("s.size") / 8).cast("int"), "variety": F.floor(F.col("s.variety") / 4).cast("int"),
    }


def train(found: DataFrame) -> Model:
    """Reliabilities from the vote patterns of all candidates, then the classifier from their posteriors."""
    single = found.select(F.explode("spans").alias("s"))
    votes = [F.col(f"s.{c}").alias(n) for c, n in (("shape", "v0"), ("rule", "v1"), ("gazetteer", "v2"), ("context", "v3"))]
    counted = single.select(F.col("s.kind").alias("kind"), *votes).groupBy("kind", "v0", "v1", "v2", "v3").count().collect()
    patterns = sorted((r["kind"], (r["v0"], r["v1"], r["v2"], r["v3"]), r["count"]) for r in counted)
    model = reliabilities(patterns)
    if not patterns:
        return model
    soft = F.lit(None).cast("double")
    for (kind, v), p in model.posterior.items():
        is_it = (F.col("s.kind") == kind) & (F.col("s.shape") == v[0]) & (F.col("s.rule") == v[1]) & (F.col("s.gazetteer") == v[2]) & (F.col("s.context") == v[3])
        soft = F.when(is_it, F.lit(p)).otherwise(soft)
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("value")) for n, c in _features().items()])).alias("f")
    sums = (
        single.select(F.col("s.kind").alias("kind"), soft.alias("p"), named)
        .groupBy("kind", "f.name", "f.value")
        .agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
        .collect()
    )
    for kind in model.prior:
        of_kind = [r for r in sums if r["kind"] == kind]
        model.bias[kind] = log(model.prior[kind] / (1 - model.prior[kind]))
        for name in _features():
            values = [r for r in of_kind if r["name"] == name]
            yes, no = sum(r["yes"] for r in values) + len(values), sum(r["no"] for r in values) + len(values)
            for r in values:
                model.weight[kind, name, r["value"]] = round(log((r["yes"] + 1) / yes) - log((r["no"] + 1) / no), 9)
    return model


def score(span: Column, model: Model) -> Column:
    """Log odds that a span is personal data, as one expression of the model's weights."""
    values = {
        "shape": span["shape"], "valid": span["rule"], "gazetteer": span["gazetteer"], "context": span["context"],
        "size": F.floor(span["size"] / 8).cast("int"), "variety": F.floor(span["variety"] / 4).cast("int"),
    }
    total = F.lit(-1.0)
    for kind, bias in model.bias.items():
        odds = F.lit(bias)
        for name, value in values.items():
            weight = F.lit(0.0)
            for (k, n, v), w in model.weight.items():
                if k == kind and n == name:
                    weight = F.when(value == v, F.lit(w)).otherwise(weight)
            odds = odds + weight
        total = F.when(span["kind"] == kind, odds).otherwise(total)
    return total


def accepted(found: Column, model: Model) -> Column:
    """The spans of a candidate array that stay: base ones by their rule, others by their log odds."""

    def judged(span: Column) -> Column:
        return F.struct(
            span["kind"].alias("kind"), span["start"].alias("start"), span["stop"].alias("stop"),
            span["kind"].isin(*BASE_KINDS).alias("base"), score(span, model).alias("odds"),
        )

    return F.filter(F.transform(found, judged), lambda s: s["base"] | (s["odds"] > 0))


def find(docs: DataFrame) -> DataFrame:
    """doc_id and `spans`: every accepted span with kind, start, stop, base (kept by its rule) and log odds."""
    found = cut(candidates(docs))
    return found.select("doc_id", accepted(F.col("spans"), train(found)).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and the text with every accepted span replaced by its kind in brackets; overlapping spans become one."""
    model = train(cut(candidates(docs)))
    plain = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = F.concat(*[spans(F.col("text"), kind) for kind in KINDS])
    located = plain.select("doc_id", "text", accepted(found, model).alias("spans"))
    ordered = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"], s["stop"], s["kind"])))

    def blank(state: Column, span: Column) -> Column:
        gap = F.substring(F.col("text"), (state["upto"] + 1).cast("int"), (span["start"] - state["upto"]).cast("int"))
        put = F.concat(state["parts"], F.array(gap, F.concat(F.lit("["), span["kind"], F.lit("]"))))
        return F.struct(
            F.greatest(state["upto"], span["stop"]).alias("upto"), F.when(span["start"] >= state["upto"], put).otherwise(state["parts"]).alias("parts")
        )

    start = F.struct(F.lit(0).cast("bigint").alias("upto"), F.array().cast("array<string>").alias("parts"))
    rest = lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(F.col("text"), (s["upto"] + 1).cast("int"), F.length("text")))
    return located.select("doc_id", F.aggregate(ordered, start, blank, rest).alias("text"))


def joined(spans_column: Column) -> Column:
    """kind:start:stop of every span, comma-joined in the array's order."""
    text = F.transform(spans_column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
    return F.array_join(text, ",")
