"""Every operator against a plain version: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import random
import time
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute
from pyspark.sql import functions as F

from codequarry.llm import decontaminate, elias_fano, html_text, language_id, line_dedup, lm_score, mixing, pii, quality_rules, simhash, token_counts
from codequarry.llm.components import components

# Names of the operators' own columns, a name that differs by case only, and plain extras.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, TEXT string, words int, rid bigint, fp string, size int"


def passage(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice("abcdefgh") + str(rng.randrange(vocabulary)) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def frame(spark, rows):
    """Rows of (doc_id, text[, lang[, source]]) with extra columns."""
    full = []
    for row in rows:
        doc_id, text, lang, source = (*row, None, None)[:4] if len(row) < 4 else row
        full.append((doc_id, text, lang, source, len(text or ""), "UPPER", 7, 1, "x", 3))
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def odd():
    """Ids null and repeated, texts null, blank, equal, very long, and near copies."""
    shared = passage(1, 60)
    near = passage(2, 300)
    rows = [
        (1, None), (2, ""), (3, " \n\t \n"), (4, "one"), (5, "one two"), (6, passage(3, 120)), (7, passage(3, 120)), (8, shared + "\n" + passage(4, 80)),
        (9, passage(5, 70) + " " + shared + " " + passage(6, 40)), (10, near), (11, near + " end"), (12, near.replace("a1", "b1", 1)), (None, passage(7, 90)),
        (None, passage(7, 90)), (13, passage(8, 60)), (13, passage(8, 60)), (13, passage(9, 60)), (14, passage(10, 20_000, 50_000)), (15, "é" * 50_000), (16, "the " * 5000),
        (17, "x\n" * 3000), (18, "Ünïcode wörter 😀 " * 40), (19, shared),
    ]
    return rows


def test_quality_measures(spark, odd):
    got = quality_rules.assess(frame(spark, odd)).collect()
    want = [brute.quality_base(t) for _, t in odd]
    assert [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got] == want
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_quality_keeps_columns_and_clean_rows(spark):
    rng = random.Random(3)
    clean = " ".join(rng.choice(["the", "of", "and", f"word{rng.randrange(500)}", f"line{rng.randrange(500)}"]) for _ in range(120))
    junk = " ".join(f"w{i}###" for i in range(200))
    docs = frame(spark, [(1, clean), (2, junk), (3, None), (4, clean.upper())])
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert [r[0] for r in kept.collect()] == [1]
    assert quality_rules.keep_good(docs.limit(0)).count() == 0


def test_line_dedup_against_brute_force(spark):
    shared, other = passage(1, 60), passage(2, 45)
    rows = [(i, text) for i, text in enumerate([
        shared + "\n" + passage(4, 80), passage(5, 70) + " " + shared + " " + passage(6, 40), shared, other + "\n" + shared, passage(7, 30) + "\n" + other,
        "short\n" * 50, "short\n" * 50, "", None, passage(9, 25) + "\n" + passage(9, 25), shared + "\n\n" + shared, passage(11, 3000),
        passage(12, 40) + passage(11, 3000)[200:900] + passage(13, 40), "ab " * 300, passage(14, 31).replace(".", "").replace(",", ""),
    ])]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r for r in line_dedup.report(docs).collect()}
    want = brute.repeated_runs([t for _, t in rows], line_dedup.pieces, line_dedup.RUN_WORDS)
    assert [got[i]["text"] if got[i]["text"] is not None else "" for i, _ in rows] == want
    assert got[8]["text"] is None
    # A passage inside a line is cut out but for the ends of the pieces around it.
    assert got[1]["gone_words"] > 40
    done = line_dedup.dedup(docs)
    assert done.columns == docs.columns
    assert {r[0]: r[1] for r in done.collect()} == {i: got[i]["text"] for i, _ in rows}


def test_line_dedup_odd_rows(spark, odd):
    docs = frame(spark, odd)
    got = line_dedup.dedup(docs).collect()
    assert len(got) == len(odd)
    # Rows equal in id and text are one document.
    assert len({r[1] for r in got if r[0] is None}) == 1
    assert line_dedup.dedup(docs.limit(0)).count() == 0
    runs = line_dedup.matches(docs).collect()
    assert any(r["doc_id"] == 7 and r["source_doc_id"] == 6 for r in runs)
    assert all(r["stop"] > r["start"] for r in runs)


def test_line_dedup_counts_words_not_spaces(spark):
    padded = "total" + " " * 40 + "12\n"
    words = [f"{c}{i}" for i in range(30) for c in "uv"]
    tabs, mixed = "\t".join(words) + "\n", "\v".join(words[::-1]) + "\r\f" + "\f".join(w + "z" for w in words) + "\n"
    rows = [(1, passage(21, 40) + "\n" + padded), (2, padded + passage(22, 40)), (3, tabs + passage(23, 20)), (4, passage(24, 20) + "\n" + tabs), (5, mixed), (6, mixed)]
    got = {r["doc_id"]: r for r in line_dedup.report(frame(spark, rows)).collect()}
    # Two words are no run, however wide the gap between them; sixty are one, whatever parts them.
    assert [got[i]["text"] for i in (1, 2, 3, 5)] == [rows[k][1] for k in (0, 1, 2, 4)]
    assert got[4]["text"].startswith(passage(24, 20) + "\n")
    assert got[4]["gone_words"] > 50 and got[6]["gone_words"] > 110


def test_line_dedup_finds_every_passage_inside_lines(spark):
    """Passages of 51 to 80 words planted mid-line go whole, but for nothing else than their later copy."""
    rng = random.Random(77)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    # Clauses of up to 120 characters, so a passage begins and ends far from any mark.
    prose = lambda n: " ".join(word(5) + ("," if rng.random() < 0.06 else "") for _ in range(n))
    rows, want = [], {}
    for k in range(300):
        shared, before, after = prose(51 + k % 30), prose(25), prose(25)
        rows += [(2 * k, f"{prose(25)} {shared} {prose(25)}"), (2 * k + 1, f"{before} {shared} {after}")]
        want |= {2 * k: rows[-2][1], 2 * k + 1: f"{before} {after}"}
    got = {r["doc_id"]: r["text"] for r in line_dedup.report(frame(spark, rows)).collect()}
    assert got == want


def test_line_dedup_shards_grow_with_the_texts(spark, monkeypatch):
    rows = [(k, passage(500 + k % 40, 120)) for k in range(80)]
    docs = frame(spark, rows)
    asked = []
    blocks = line_dedup._blocks
    monkeypatch.setattr(line_dedup, "_blocks", lambda plain, run_words, shards: asked.append(shards) or blocks(plain, run_words, shards))
    monkeypatch.setattr(line_dedup, "SHARD_BYTES", 200)
    got = {r["doc_id"]: r["text"] for r in line_dedup.report(docs).collect()}
    assert asked == [-(-sum(len(t) for _, t in rows) // 200)]
    assert got == {k: t if k < 40 else "" for k, t in rows}


def test_pieces_add_up():
    for text in ("", "\n", "a, b. c\n\nd", "x" * 500, passage(3, 400), "a  b ,c\r\nd\n e", "。、x"):
        assert "".join(line_dedup.pieces(text)) == text


def test_decontamination_against_brute_force(spark, odd):
    bench = [(1, passage(1, 25)), (2, passage(3, 12)), (3, "one"), (None, "one two"), (5, None), (6, ""), (7, passage(99, 30)), (1, passage(2, 14)), (8, passage(10, 20_000, 50_000)[500:700]), (9, "the the the")]
    items = spark.createDataFrame(bench, "item_id bigint, text string")
    want = brute.decontaminate([t for _, t in odd], [(str(i) if i is not None else "", t) for i, t in bench])
    docs = frame(spark, odd)
    for sizes in ({}, {"block_words": 20, "shard_words": 500}):
        got = decontaminate.report(docs, items, **sizes).select("n_words", "n_hit", "items").collect()
        assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns
    assert kept.count() == sum(n == 0 for _, n, _ in want)
    assert decontaminate.clean(docs, items.limit(0)).count() == len(odd)
    assert decontaminate.clean(docs.limit(0), items).count() == 0


def test_longest_matches(spark):
    text = passage(20, 50)
    docs = frame(spark, [(1, "before " + text + " after"), (2, " ".join(text.split()[5:30]))])
    found = decontaminate.overlaps(docs, spark.createDataFrame([(4, text)], "item_id bigint, text string")).collect()
    by = {r["doc_id"]: [(m["item"], m["start"], m["item_start"], m["words"]) for m in r["found"]] for r in found}
    assert by == {1: [("4", 1, 0, 50)], 2: [("4", 0, 5, 25)]}


def _shard(texts, suffixes):
    rows = [suffixes.number(decontaminate.words(t)) for t in texts]
    begins = np.cumsum([0, *[len(r) + 1 for r in rows]])
    text = np.zeros(begins[-1] + suffixes.window, dtype=np.int64)
    for row, begin in zip(rows, begins, strict=False):
        text[begin : begin + len(row)] = row
    return text, np.repeat(np.arange(len(rows)), np.diff(begins)), begins


def _shared(text, items, window):
    """Most words every place of a text shares with any item, where they are a window at least."""
    own = [t.split() for t in items]
    out = {}
    for x in range(len(text)):
        longest = 0
        for words in own:
            for y in range(len(words)):
                n = 0
                while x + n < len(text) and y + n < len(words) and text[x + n] == words[y + n]:
                    n += 1
                longest = max(longest, n)
        if longest >= window:
            out[x] = longest
    return out


@pytest.mark.parametrize("seed", range(60))
def test_longest_matches_against_brute_force(seed):
    rng = random.Random(seed)
    window, letters = rng.choice([3, 4, 10]), "abcdefghijklmnopqrstuvwxyz"[: rng.choice([1, 2, 3, 8, 26])]

    def some(n):
        return " ".join(rng.choice(letters) for _ in range(n))

    items = [some(rng.randrange(25)) for _ in range(rng.randrange(1, 6))]
    texts = [some(rng.randrange(40)) for _ in range(4)] + [f"{some(5)} {rng.choice(items)} {some(4)} {rng.choice(items)}" for _ in range(2)]
    suffixes = decontaminate.Suffixes([(str(i), t) for i, t in enumerate(items)], window)
    text, doc_of, begins = _shard(texts, suffixes)
    doc, item, place, at, words, hit, met = decontaminate.matches(text, doc_of, suffixes)
    for d, (_, n_hit, names) in enumerate(brute.decontaminate(texts, [(str(i), t) for i, t in enumerate(items)], window)):
        assert hit[begins[d] : begins[d + 1]].sum() == n_hit
        assert sorted({suffixes.names[i] for k, s in met.tolist() if k == d for i in suffixes.sets[s]}) == names
        shared = _shared(texts[d].split(), items, window)
        want = {(x, n) for x, n in shared.items() if shared.get(x - 1) != n + 1}
        assert {(p, n) for p, n in zip((place - begins[doc])[doc == d].tolist(), words[doc == d].tolist(), strict=True) if n >= window} == want
    for d, i, p, q, n in zip(doc.tolist(), item.tolist(), (place - begins[doc]).tolist(), at.tolist(), words.tolist(), strict=True):
        assert texts[d].split()[p : p + n] == items[i].split()[q : q + n]


def test_repeated_words_are_not_expanded_into_pairs():
    suffixes = decontaminate.Suffixes([("x", "w " * 1000), ("y", "w " * 1000), ("z", "w " * 30)])
    text, doc_of, _ = _shard(["w " * 100_000], suffixes)
    begin = time.process_time()
    doc, item, place, at, words, hit, met = decontaminate.matches(text, doc_of, suffixes)
    assert time.process_time() - begin < 10
    assert len(suffixes.start) == 1 and len(place) == 99_001 and words.max() == 1000 and hit.sum() == 100_000 and len(met) == 1


def test_frequent_preface_of_many_items(spark):
    preface = "these ten words stand before every item of the benchmark"
    items = spark.createDataFrame([(i, f"{preface} {i} " + passage(i, 20)) for i in range(3000)], "item_id bigint, text string")
    docs = frame(spark, [(i, f"so {preface} and so on {i}") for i in range(40)] + [(99, "nothing of it")])
    got = decontaminate.report(docs, items).collect()
    assert [(r["n_hit"], len(r["items"]), r["longest"]) for r in sorted(got, key=lambda r: r["doc_id"])] == [(10, 3000, 10)] * 40 + [(0, 0, 0)]


def test_mixing_targets_and_words(spark):
    rng = random.Random(5)
    rows = [(i, passage(i, rng.randrange(1, 60)), None, rng.choice(["a", "a", "a", "b", "c", "ä", None])) for i in range(600)]
    rows += [(601, None, None, "z"), (602, "", None, "z"), (603, rows[0][1], None, "a"), (603, rows[0][1], None, "a")]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    source = {}
    for i, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
        source[i] = s
    for r in got:
        s = source[r["doc_id"]]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        assert r["source_size"] == sizes[s]
    for s, want in brute.water_fill(sizes).items():
        assert target[s] == pytest.approx(want)
        assert abs(taken[s] - want) <= 60
    again = mixing.mix(frame(spark, rows).repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixing_corpus(spark, odd):
    rows = [(i, t, None, "s" if k % 3 else None) for k, (i, t) in enumerate(odd)]
    docs = frame(spark, rows)
    mixed = mixing.materialise(docs)
    assert mixed.columns == docs.columns
    taken = mixing.mix(docs)
    assert mixed.count() == taken.agg(F.sum("copies")).first()[0]
    assert mixing.mix(docs.limit(0)).count() == 0


PERSONAL = [
    (1, "write to a.b+c@mail-1.example.com. or x@y.z..w@q.r"), (2, "ip 10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.004"), (3, "card 4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 5"),
    (4, "+1 (017) 555-7713 and +49 30 1234567 +1 +12"), (5, None), (6, ""), (7, "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" x"), (8, "é😀 a@b.co 😀 +1 (017) 555-7713"),
    (9, "a" * 100_000), (10, "1 " * 60_000), (11, "a@b" + ".c" * 20_000 + " x@" + "y.z" * 10), (12, "1.2.3." * 300 + "4 " + "x@y.zz " * 400), (13, "_a@b.c_d@e.f@g.h"), (1, "write to a.b+c@mail-1.example.com. or x@y.z..w@q.r"),
    (14, "9807915762804490 " * 200 + "(202) 555-0147 call"), (15, "-" * 5000 + "1" * 40 + " +" + "(" * 3000 + "1"),
]


def test_personal_data_base(spark):
    docs = frame(spark, PERSONAL)
    got = pii.find(docs).withColumn("base", pii.joined(F.filter("spans", lambda s: s["base"]))).select("doc_id", "base").collect()
    assert sorted((r["doc_id"], r["base"]) for r in got) == sorted((i, ",".join(brute.pii_base(text))) for i, text in PERSONAL)
    assert pii.find(docs.limit(0)).count() == 0


def test_personal_data_added_and_redacted(spark):
    secret = "24be64439e3e49cf46b2d7c90f3602a3d0b907f"
    docs = frame(spark, [(i, f"the token = \"{secret}{i % 10}\" of user{i}@example.com") for i in range(30)] + [(40, "plain words only")])
    kinds = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.find(docs).collect()}
    assert all(kinds[i] == ["email", "secret"] for i in range(30)) and kinds[40] == []
    assert {r["text"] for r in pii.redact(docs).collect()} == {'the token = "[secret]" of [email]', "plain words only"}


def test_reliabilities_find_the_good_labeler():
    rng = random.Random(1)
    seen: dict[tuple, int] = {}
    for _ in range(4000):
        real = rng.random() < 0.4
        votes = tuple((1 if real == (rng.random() < p) else -1) for p in (0.95, 0.9, 0.6, 0.55))
        seen["k", votes] = seen.get(("k", votes), 0) + 1
    model = pii.reliabilities([(k, v, n) for (k, v), n in seen.items()])
    right = [model.right["k", name, 1, True] for name in pii.LABELERS]
    assert right[0] > right[2] > 0.5 and right[1] > right[3]
    assert model.prior["k"] == pytest.approx(0.4, abs=0.08)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header class=top>Site name</header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; line</h1><p>First <b>para&shy;graph</b>
 of   words &lt;3<p>Of.<br><p>Caf&eacute; &#8364; &#x41;</p><aside>Side</aside><!-- <p>gone</p> --></article>
<div class="comments"><p>Reader says so much that it is long and looks like text of the article but is not at all</p></div><form><p>Name</p></form><footer>&copy; x</footer></body></html>"""


def test_html_main_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain text"), (1, "u", PAGE), (5, "u", "<p>" + "word " * 100_000), (6, "u", "<" * 2000), (7, "u", "<p>a < b and 1<2</p>")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    by = {r["page_id"]: r for r in got}
    assert by[1]["text"] == "Head & line\nFirst para­graph of words <3\nOf.\nCafé € A"
    assert by[2]["text"] == by[3]["text"] == "" and by[2]["url"] is None
    assert by[5]["n_chars"] == 5 * 100_000 - 1
    assert by[7]["text"] == "a < b and 1<2"
    assert len(got) == len(rows)


def test_html_tree_without_article_element():
    page = "<body><div><a>Home</a> <a>News</a> <a>More</a></div>" + "".join(f"<div>{passage(i, 40)}</div>" for i in range(4)) + "<div><a>Next page</a></div></body>"
    text = html_text.main_text(page, html_text.train())
    assert text.split("\n") == [passage(i, 40) for i in range(4)]


def test_html_heads_inside_and_outside_articles():
    page = (
        "<div class='site-header'>Brand</div><article><div class='entry-header'><h1>Title</h1></div><p>Some words of the text.</p>"
        "<div class='ad-slot'>Buy</div><section id='comments'>Nice</section></article><div class='cookie-banner'>We use cookies</div>"
    )
    assert html_text.main_text(page, html_text.train()) == "Title\nSome words of the text."


def test_html_deep_elements_end_where_they_end():
    page = "<article><p>First.</p><div class=ad><p>" + "<b><i>" * 200 + "Buy now</p></div><p>Second <a>one <a>two</a> three.</p></article>"
    assert html_text.main_text(page, html_text.train()) == "First.\nSecond one two three."
    # An inline element that ends below an open block leaves the block and what encloses it as they are.
    flat = html_text.blocks("<a><div>in link</a> after</div> outside <b><p>x</b>y</p>")
    assert [(b.text, b.linked) for b in flat] == [("in link after", 2), ("outside", 0), ("xy", 0)]
    assert [(b.text, b.furniture) for b in html_text.blocks("<span class=ad><div>a</span>b</div>c")] == [("ab", True), ("c", False)]


def test_html_tags_without_an_end_are_text():
    assert html_text.main_text('<p>a <b c="d e</p>', html_text.train()) == 'a <b c="d e'
    assert html_text.main_text("<p>a <b x='\">'>bold</b> <i y", html_text.train()) == "a bold <i y"
    assert html_text.main_text("<p>&#65; &#" + "0" * 9000 + "66; &#" + "9" * 9000 + ";c</p>", html_text.train()) == "A B \ufffdc"


@pytest.mark.parametrize(
    "page",
    ["<a " * 100_000, '<a" <b\' ' * 60_000, "<a<" * 100_000, "<b></x>" * 60_000, "<span>" * 40_000 + "</b>" * 40_000, "<b>" * 40_000 + "<div>" * 40_000 + "</b>" * 40_000,
     "<div>" * 40_000 + "<p>x" * 40_000, '<p class="' * 50_000, "<!-- " * 60_000, "&#" * 100_000],
)
def test_html_time_grows_in_proportion(page):
    tree = html_text.train()

    def seconds(html):
        begin = time.process_time()
        html_text.main_text(html, tree)
        return time.process_time() - begin

    # Quadratic work would take 64 times as long; the absolute bound is far above what a linear scan needs.
    eighth = page[: len(page) // 8]
    assert seconds(page) < max(24 * seconds(eighth), 4.0)


def test_html_words_and_links_decide_without_article():
    page = "<body><p><a>one two three four five six seven</a> eight</p><p>a plain line of eleven words that stands all on its own</p></body>"
    assert html_text.main_text(page, html_text.train()) == "a plain line of eleven words that stands all on its own"


def test_decision_tree_learns_its_table():
    table = np.array(html_text.LABELLED, dtype=float)
    assert (html_text.classify(html_text.train(), table[:, :-1]) == table[:, -1].astype(bool)).all()


def test_language_model_against_brute_force(spark, odd, monkeypatch):
    rows = [(k, t) for k, (_, t) in enumerate(odd)]
    docs = frame(spark, rows)
    want, n = brute.language_model([(i, t, brute.held_out(i, 7)) for i, t in rows], lm_score.PRIOR)
    got = lm_score.score_corpus(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        tokens, known, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["held_out"], r["train_tokens"]) == (tokens, known, brute.held_out(r["doc_id"], 7), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-6)
        assert r["score"] == pytest.approx(score, rel=1e-3)
    assert lm_score.score_corpus(docs.limit(0)).count() == 0


def test_language_model_saved_and_used(spark, odd):
    docs = frame(spark, [(k, t) for k, (_, t) in enumerate(odd)])
    stats, tries = lm_score.train(docs)
    again = {r["doc_id"]: r["score"] for r in lm_score.score(docs, stats, tries).collect()}
    at_once = {r["doc_id"]: r["score"] for r in lm_score.score_corpus(docs, F.lit(False)).collect()}
    assert all(again[i] == pytest.approx(at_once[i], rel=1e-3) for i in at_once)


def test_probabilities_sum_to_one(spark):
    """p(w | a) over all known words, the end and one unknown word, from scores that differ in that word only."""
    learned = [(0, "a b a c a b"), (1, "b a c c")]
    stats, tries = lm_score.train(frame(spark, learned), prior=5.0)
    asked = frame(spark, [(k, text) for k, text in enumerate(["a", "a a", "a b", "a c", "a never"])])
    scores = {r["doc_id"]: r["score"] for r in lm_score.score(asked, stats, tries).collect()}
    plain, _ = brute.language_model([*[(i, t, False) for i, t in learned], *[(10 + k, t, True) for k, t in enumerate(["a", "a a", "a b", "a c", "a never"])]], 5.0)
    assert all(scores[k] == pytest.approx(plain[10 + k][3], rel=1e-3) for k in scores)
    n, v, prior = stats.tokens, stats.distinct, stats.prior
    assert (n, v) == (12, 4)
    # c(a) = 4: followed by b twice, c twice. Numerators over all words and the unknown add up to the denominator.
    counts = {"a": 4, "b": 3, "c": 3, "end": 2, "never": 0}
    after = {"b": 2, "c": 2}
    assert sum(after.get(w, 0) + prior * (c + 1) / (n + v + 1) for w, c in counts.items()) == pytest.approx(counts["a"] + prior)


def test_elias_fano_round_trip():
    rng = np.random.default_rng(3)
    for top in (10, 1 << 20, 1 << 40, (1 << 63) - 1):
        for n in (0, 1, 2, 1000):
            values = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
            read = elias_fano.EliasFano(np.frombuffer(elias_fano.EliasFano.encode(values), dtype=np.uint8))
            assert (read.get(np.arange(n)) == values).all()
            if n:
                asked = rng.integers(0, top, 50, dtype=np.uint64, endpoint=True)
                at = read.successor(asked, np.zeros(50, dtype=np.int64), np.full(50, n, dtype=np.int64))
                assert (at == np.searchsorted(values, asked)).all()


def test_trie_with_many_words():
    """More words than sixteen bits number, so contexts keep fewer bits beside a word's rank."""
    rng = np.random.default_rng(4)
    words = np.unique(rng.integers(0, 1 << 63, 90_000, dtype=np.uint64))
    rank = np.sort(rng.integers(0, len(words), 200_000))
    contexts = rng.integers(0, 1 << 48, len(rank), dtype=np.uint64)
    contexts = contexts[np.lexsort((contexts, rank))]
    weights = rng.normal(-3, 1, len(rank))
    trie = elias_fano.Trie(elias_fano.build(words, np.arange(1, len(words) + 1), rank, contexts, weights))
    at = rng.integers(0, len(rank), 5000)
    found, value = trie.numerators(trie.ranks(words[rank[at]]), contexts[at])
    assert found.all() and np.abs(value - weights[at]).max() < 1e-3
    assert (trie.counts(np.arange(len(words))) == np.arange(1, len(words) + 1)).all()
    assert (trie.ranks(words[:100] + np.uint64(1)) == -1).all()
    assert not trie.numerators(trie.ranks(words[rank[at]]), rng.integers(0, 1 << 48, 5000, dtype=np.uint64))[0].any()


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_edited_counts_equal_full_recounts():
    path, pattern = vocabulary()
    encoder = token_counts.Encoder(Path(path).read_bytes(), pattern)
    rng = random.Random(4)
    for trial in range(150):
        text = "".join(rng.choice(["word", " the", "  ", "\n", "12", "é", "'s", "!!", " ", "\t\n ", "x"]) for _ in range(rng.choice([0, 3, 40, 400, 1500])))
        tree = token_counts.TokenTree(text, encoder)
        for _ in range(8):
            a = rng.randrange(len(text) + 1)
            b = min(len(text), a + rng.choice([0, 1, 5, 60]))
            new = rng.choice(["", " ", "a", "  \n", "long new text, with words 123", "'", "e" * 30])
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text() == text, trial
            assert tree.n_chars == len(text)
            assert tree.n_tokens == len(encoder.encoding.encode_ordinary(text)), trial


def test_token_counts_of_documents(spark, odd):
    path, pattern = vocabulary()
    encoder = token_counts.Encoder(Path(path).read_bytes(), pattern)
    got = token_counts.count(frame(spark, odd), token_counts.derived_edits(F.col("text")), path, pattern).collect()
    for r, (doc_id, text) in zip(got, odd, strict=True):
        text = text or ""
        edited = text
        if text:
            n = len(text)
            for a, size, new in ((n // 4, 5, ""), (n // 2, 0, text[:20]), (3 * n // 4, 3, " edited")):
                edited = edited[:a] + new + edited[a + size :]
        assert (r["doc_id"], r["n_tokens"]) == (doc_id, len(encoder.encoding.encode_ordinary(text)))
        if text:
            assert r["n_tokens_after"] == len(encoder.encoding.encode_ordinary(edited))
            assert r["n_chars_after"] == len(edited)


def test_language_by_trees(spark):
    words = {"en": "the of and to in is that it for on was with".split(), "de": "der die und in den von zu das mit sich des auf".split(), "ja": "これ は の を に が".split()}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for i, lang in enumerate(["en", "de", "ja"] * 40)]
    rows += [(900, None, "en"), (901, "123 !!", "de"), (902, "", None), (None, "der die das", "de"), (903, "x" * 300_000, None)]
    docs = frame(spark, rows)
    trees = language_id.train(docs, lambda i: ~F.coalesce(F.crc32(i.cast("string")) % 4 == 2, F.lit(False)))
    got = language_id.predict(docs, trees).collect()
    for r, row in zip(got, rows, strict=True):
        if row[0] is not None and row[0] < 900:
            assert r["lang_pred"] == row[2]
        assert 0 <= r["score"] <= 1
    assert [r["lang_pred"] for r in got if r["doc_id"] in (900, 901, 902)] == ["und"] * 3
    nothing = language_id.train(docs.limit(0), lambda i: F.lit(True))
    assert {r["lang_pred"] for r in language_id.predict(docs, nothing).collect()} == {"und"}


def test_code_lengths_are_exact():
    """The table's lengths equal a direct walk from the longest context down."""
    texts = {"a": "abracadabra abra", "b": "bananas and bandanas"}
    counts: dict = {}
    for lang, text in texts.items():
        data = bytes(language_id.fold(text))
        counts[lang] = {k: {} for k in range(3)}
        for k in range(3):
            padded = b" " * k + data
            for i, byte in enumerate(data):
                code = int.from_bytes(padded[i : i + k], "big") if k else 0
                counts[lang][k].setdefault(code, np.zeros(256, dtype=np.int64))[byte] += 1
    trees = language_id.ContextTrees(counts, 2)

    def bits(lang, text):
        data, total = bytes(language_id.fold(text)), 0.0
        for i, byte in enumerate(data):
            for k in (2, 1, 0):
                context = (b" " * k + data)[i : i + k]
                seen = counts[lang][k].get(int.from_bytes(context, "big") if k else 0)
                if seen is None:
                    continue
                n, d = seen.sum(), np.count_nonzero(seen)
                if seen[byte]:
                    total -= np.log2(seen[byte] / (n + d))
                    break
                total -= np.log2(d / (n + d))
            else:
                total += 8.0
        return total

    for text in ("abra banana", "zebra", "and", "Abra  Abra"):
        assert trees.lengths(text) == pytest.approx([bits("a", text), bits("b", text)], rel=1e-5)


def test_simhash_against_brute_force(spark, odd):
    rows = [(k, t) for k, (_, t) in enumerate(odd)]
    prints = [brute.simhash(t) for _, t in rows]
    want = brute.classes(prints)
    got = {r["doc_id"]: r for r in simhash.classes(frame(spark, rows)).collect()}
    assert [got[i]["fp"] % (1 << 64) for i, _ in rows] == prints
    assert [got[i]["component_id"] for i, _ in rows] == want
    # The same text with one word more, and with one word changed.
    assert want[10] == 9 and bin(prints[11] ^ prints[9]).count("1") < 10
    docs = frame(spark, rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.collect()) == sorted(set(want))
    assert simhash.classes(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_simhash_keeps_one_of_repeated_rows(spark, odd):
    kept = [tuple(r[:2]) for r in simhash.keep_one(frame(spark, odd)).collect()]
    assert len(kept) == len(set(kept))
    assert [k for k in kept if k[0] is None] == [(None, passage(7, 90))]


def test_large_group_that_is_linked_early():
    fps = np.arange(4096, dtype=np.uint64)
    a, b = simhash.link_group(fps)
    assert len(b) == 4095 and set(a.tolist()) == {0}
    apart = np.array([0, 0xFF, 0xFFFF0000], dtype=np.uint64)
    assert len(simhash.link_group(apart)[0]) == 0


@pytest.mark.parametrize("spread", [2, 6, 12, 40])
def test_group_links_against_brute_force(spread):
    rng = np.random.default_rng(spread)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    flips = [int(sum(1 << int(b) for b in rng.choice(spread, rng.integers(0, min(spread, 5)), replace=False))) for _ in range(300)]
    fps = np.unique(np.array([int(centres[i % 6]) ^ f for i, f in enumerate(flips)], dtype=np.uint64))
    a, b = simhash.link_group(fps)
    parent = {int(x): int(x) for x in fps} | {int(y): int(x) for x, y in zip(a, b, strict=True)}
    order = [int(x) for x in fps]
    want = brute.classes(order)
    assert [parent[x] for x in order] == [order[w] for w in want]


def test_crowded_keys_are_dealt_again(spark):
    rng = random.Random(8)
    base = rng.getrandbits(64)
    fps = sorted({base ^ rng.getrandbits(14) for _ in range(400)} | {rng.getrandbits(64) for _ in range(200)})
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    found = components(simhash.links(rows, crowd=20)).collect()
    want = brute.classes(fps)
    groups: dict[int, set] = {}
    for r in found:
        groups.setdefault(r["root"], set()).add(r["node"] % (1 << 64))
    truth: dict[int, set] = {}
    for f, w in zip(fps, want, strict=True):
        truth.setdefault(w, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in truth.values() if len(g) > 1)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(300, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
