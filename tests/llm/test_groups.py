"""Spelling variants, b-bit MinHash and centroid clustering against plain versions of their rules."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.parquet
import pytest
from twins import compare

from codequarry.llm import centroid_clustering, minhash, queries, spelling

DOCS = "doc_id bigint, text string, TEXT string, word string, n bigint, digest string"
EMPTY = [(None, None), (None, ""), (7001, None), (7002, ""), (7003, " \t\n\v\f\r "), (7004, "\u00a0"), (7005, "ok")]


def frame(spark, rows):
    """Documents beside columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, text, "x", "y", 5, "z") for i, text in rows], DOCS)


def found(df, *names):
    return sorted((tuple(row[n] for n in names) for row in df.collect()), key=repr)


# Spelling variants


def plain_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{i}:{word}".encode()) if i is not None else 1
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 6:
                counts[word] += 1
    return {word: n for word, n in counts.items() if n >= 5}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    rows = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(rows, key=repr)


VARIANT = ("word", "form", "root", "n", "n_near", "form_n")


def misspelt(seed, stems, texts):
    rng = random.Random(seed)
    letters = "abcé×À"
    rows = []
    for i in range(texts):
        words = []
        for _ in range(60):
            word = rng.choice(stems)
            for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
                at = rng.randrange(len(word))
                word = rng.choice((word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1 :]))
            words.append(rng.choice((word, word.title())))
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("crowd", [2, 1024])
def test_spelling_variants_equal_all_pairs(spark, crowd):
    rows = misspelt(3, ["letters", "lettering", "aaaaaaaa", "aaaaaab", "bcbcbcbc", "ééééééé", "stationary"], 120) + EMPTY
    rows += rows[:5]
    words = spelling.vocabulary(frame(spark, rows))
    assert found(words, "word", "n") == sorted(plain_words(rows).items(), key=repr)
    assert found(spelling.group(words, crowd=crowd), *VARIANT) == plain_variants(plain_words(rows))


def test_spelling_chain_ties_and_long_words(spark):
    long = "ab" * 4000
    words = {"abcdef": 5, "abcdeg": 25, "abcdeh": 25, "abcdehi": 125, "abcdehij": 625, long: 5, long[:-1]: 25, "alone6": 9}
    table = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert found(spelling.group(table), *VARIANT) == plain_variants(words)
    got = {row["word"]: row["root"] for row in spelling.group(table).collect()}
    # Equal counts: the first in code-point order; the chain leads on to the last word.
    assert got["abcdeg"] == "abcdeg" and got["abcdef"] in ("abcdeg", "abcdehij") and got["abcdeh"] == "abcdehij" and got[long] == long[:-1]


def test_one_key_holds_every_word(spark):
    """Words that all begin alike are dealt again until few share a key; tiles and diagonals agree."""
    rng = random.Random(8)
    words = {"prefixprefix" + "".join(rng.choice("abc") for _ in range(rng.randint(5, 6))): rng.randint(5, 400) for _ in range(500)}
    table = spark.createDataFrame(list(words.items()), "word string, n bigint")
    expected = plain_variants(words)
    for crowd in (5, 100, 5000):
        assert found(spelling.group(table, crowd=crowd), *VARIANT) == expected


def test_no_words(spark):
    assert spelling.variants(frame(spark, [])).count() == 0
    assert spelling.variants(frame(spark, EMPTY)).count() == 0


def test_op11_on_a_table(spark, tmp_path):
    rows = misspelt(4, ["wonder", "wander", "wonderful"], 60)
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert found(queries.op11_spelling_variants(spark, str(tmp_path)), *VARIANT) == plain_variants(plain_words(rows))


# MinHash


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def plain_classes(rows):
    sets = [plain_set(text) for _, text in rows]
    label = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and label[a] != label[b]:
            old, new = label[b], label[a]
            label = [new if x == old else x for x in label]
    result = []
    for at, (i, _) in enumerate(rows):
        ids = [j for k, (j, _) in enumerate(rows) if label[k] == label[at] and j is not None]
        root = i if not sets[at] else min(ids, default=None)
        result.append((i, len(sets[at]), root, i == root))
    return sorted(result, key=repr)


def copies(seed, bases, each, changes):
    """Groups of texts of which some are within the limit of each other and some just beyond."""
    rng = random.Random(seed)
    rows = []
    for base in range(bases):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 200))]
        for _ in range(each):
            copy = list(words)
            for _ in range(rng.randint(0, changes)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows) + 10, rng.choice((" ", "\n")).join(copy)))
    rng.shuffle(rows)
    return rows


CLASS = ("doc_id", "n_shingles", "component_id", "kept")


@pytest.mark.parametrize("tile", [3, 2048])
def test_minhash_classes_equal_all_pairs(spark, tile):
    rows = copies(5, 6, 25, 8) + EMPTY + [(1, "A b"), (2, "a B"), (3, "a b c"), (4, "ok ok ok ok ok ok ok"), (5, "ok ok ok ok ok")]
    rows += [rows[0], (None, rows[0][1]), (None, "only without an id " * 3), (9000, rows[3][1])]
    assert found(minhash.classes(frame(spark, rows), tile, 400 if tile == 3 else minhash.TILE_SHINGLES), *CLASS) == plain_classes(rows)


def test_minhash_of_nothing(spark):
    assert minhash.classes(frame(spark, [])).count() == 0
    assert found(minhash.classes(frame(spark, EMPTY)), *CLASS) == plain_classes(EMPTY)


def test_minhash_of_a_very_long_text(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    changed = [w if rng.random() > 0.01 else "x" for w in words]
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(words[: len(words) // 2])), (4, "lorem " * 50_000)]
    assert found(minhash.classes(frame(spark, rows)), *CLASS) == plain_classes(rows)


def test_estimates_are_corrected_for_collisions():
    rng = np.random.default_rng(1)
    for similarity in (0.0, 0.3, 0.6, 0.85):
        values = []
        for _ in range(60):
            shared = rng.integers(0, 1 << 63, int(2000 * similarity), dtype=np.uint64)
            own = rng.integers(0, 1 << 63, (2, (2000 - len(shared)) // 2), dtype=np.uint64)
            left, right = (minhash.packed(minhash.minima(np.concatenate([shared, one]))) for one in own)
            values.append(float(minhash.estimates(left[None], right[None])[0]))
        assert abs(np.mean(values) - similarity) < 0.02
        # The limit for candidates leaves six standard errors at the limit for links.
        assert similarity < 0.85 or min(values) > minhash.LEAST


def test_short_sequences_are_no_prefixes_of_shingles():
    hashes = minhash._WordHashes()
    four, five = minhash.shingles("a b c d", hashes), minhash.shingles("a b c d e", hashes)
    assert len(four) == len(five) == 1 and four[0] != five[0]
    assert minhash.shingles("A  b\tc\nd", hashes)[0] == four[0]


# Centroid clustering


def plain_clustering(rows, k, rounds, dims):
    kept = []
    for i, vector in rows:
        if vector is not None and len(vector) == dims and all(x is not None and np.isfinite(x) for x in vector):
            kept.append((i, [max(min(int(np.floor(256 * x)), 1 << 27), -(1 << 27)) for x in vector]))
    digest = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "")
    centroids = [list(v) for i, v in sorted(kept, key=lambda row: (digest(row[0]), row[1]))[:k]]
    distance = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    assign = lambda: [min((distance(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        of = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, of, strict=True) if c == j]
            if own:
                centroids[j] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    of = assign()
    total = sum(d for d, _ in of)
    sha = lambda j: hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()
    return sorted(((i, j, d, sum(e for e, c in of if c == j), total, sha(j)) for (i, _), (d, j) in zip(kept, of, strict=True)), key=repr)


CLUSTERED = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 3, 4) for i, v in rows], f"vec_id bigint, embedding array<{kind}>, cluster int, EMBEDDING int")


def clouds(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, spread, (12, dims))
    return [(i, (centres[i % 12] + rng.normal(0, 1, dims)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread", [0.1, 3.0])
def test_clustering_equals_plain_rounds(spark, spread):
    nan, inf = float("nan"), float("inf")
    rows = clouds(6, 400, 8, spread) + [(900, None), (901, []), (902, [1.0] * 7), (903, [1.0] * 7 + [None]), (904, [nan] * 8), (905, [0.0] * 7 + [inf])]
    # Equal vectors, equal ids, no id, ties between centroids, components beyond the bound.
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (None, [0.0] * 8)] + [(1000 + i, [0.5] * 8) for i in range(60)] + [(2000, [1e30] * 8)]
    got = centroid_clustering.cluster(vectors(spark, rows), k=15, rounds=4, dims=8)
    assert found(centroid_clustering.with_inertia(got), *CLUSTERED) == plain_clustering(rows, 15, 4, 8)


def test_few_or_no_vectors(spark):
    for rows in ([], [(1, None)], [(1, [0.25, -0.25]), (2, [3.0, 1.0])]):
        got = centroid_clustering.with_inertia(centroid_clustering.cluster(vectors(spark, rows, "double"), dims=2))
        assert found(got, *CLUSTERED) == plain_clustering(rows, 40, 5, 2)


def test_bounds_spare_distances_and_lose_none():
    """The norm of the total displacement of a centroid that comes back is nothing; its drifts aren't."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (20, 16))
    points = np.concatenate([c + rng.integers(-200, 200, (50, 16)) for c in centres])
    history = [centres]
    d2 = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
    seen, own, spared = np.zeros(d2.shape, np.int8), d2.argmin(axis=1), 0
    for turn in range(1, 7):
        history.append(centres + rng.integers(-60, 60, centres.shape) if turn % 2 else centres)
        own, evaluated = centroid_clustering.nearest_from_bounds(points, d2, seen, own, np.array(history))
        exact = ((points[:, None] - history[-1][None]) ** 2).sum(axis=2)
        assert (own == exact.argmin(axis=1)).all()
        if turn % 2 == 0:
            spared += d2.size - evaluated
            assert evaluated <= len(points)
    assert spared >= 2.8 * d2.size


def test_sql_of_the_clustering(spark, tmp_path):
    pa.parquet.write_table(pa.table({"vec_id": list(range(300)), "embedding": [v for _, v in clouds(9, 300, 64, 0.5)]}), tmp_path / "embeddings.parquet")
    sql = queries.oracle_sql()["op13_centroid_clustering"]
    for name in "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split():
        pa.parquet.write_table(pa.table({"x": [1]}), tmp_path / f"{name}.parquet")
    assert compare(spark, queries.op13_centroid_clustering, sql, str(tmp_path)) == []


def test_line_dedup_goes_by_ascii_white_space_alone(spark):
    """U+00A0, U+0085 and U+2003 belong to words: 10 and 10 with one of them differ, and alone they are words."""
    from codequarry.llm import line_dedup

    plain = [f"w{i}" for i in range(40)]
    odd = [w + "\u00a0" if i % 9 == 4 else w for i, w in enumerate(plain)]
    spaced = [x for w in plain[:20] for x in (w, "\u00a0")]
    rows = [(1, " ".join(plain)), (2, " ".join(odd)), (3, "\t\v".join(plain)), (4, " ".join(spaced)), (5, "\u0085 ".join(plain)), (6, "  ".join(spaced) + "\n")]
    got = {row["doc_id"]: row["text"] for row in line_dedup.report(frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: "", 4: rows[3][1], 5: rows[4][1], 6: ""}
