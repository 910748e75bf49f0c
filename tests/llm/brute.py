"""Plain Python versions of the operators' rules, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from html import unescape

import xxhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def quality_base(text):
    text = text or ""
    w = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    n = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if n[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def decontaminate(texts, items, window=10):
    """Per text: words, hit words, names of items with an occurring window, longest run of matching words."""
    out = []
    split = [(name, ALNUM.findall(fold(t))) for name, t in items]
    for text in texts:
        w = ALNUM.findall(fold(text))
        hit, names = set(), set()
        for name, own in split:
            size = min(window, len(own))
            for p in range(len(own) - size + 1) if size else []:
                for i in range(len(w) - size + 1):
                    if w[i : i + size] == own[p : p + size]:
                        hit |= set(range(i, i + size))
                        names.add(name)
        out.append((len(w), len(hit), sorted(names)))
    return out


def article_text(html):
    """The text of the article element of a page as the driver writes them: nothing but paragraphs, headings and inline tags inside."""
    inside = re.search(r"<article>(.*)</article>", html or "", re.S)
    parts = re.split(r"</?(?:p|div|h[1-6]|ul|ol|li|blockquote|section)\b[^>]*>", re.sub(r"<!--.*?-->", "", inside[1], flags=re.S)) if inside else []
    inline = (re.sub(r"</?(?:a|b|i|em|strong|span)\b[^>]*>", "", re.sub(r"<br\b[^>]*>", " ", part)) for part in parts)
    return "\n".join(t for t in (" ".join(unescape(part).split()) for part in inline) if t)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def pii_base(text):
    spans = []
    for kind, pattern in PII:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            spans.append(f"{kind}:{m.start()}:{m.end()}")
    return spans


def sha(parts):
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def language_model(rows, prior):
    """{id: (tokens, known, base, score)} of a Dirichlet-smoothed bigram model; rows are (id, text, held out)."""
    token = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    one, two, docs = Counter(), Counter(), 0
    for _, text, held in rows:
        if not held:
            own = token(text)
            one.update(own)
            two.update(zip([b" ", *own], own))
            docs += 1
    n, v = sum(one.values()), len(one)
    p1 = lambda w: (one[w] + 1) / (n + v + 1)
    seen = lambda u: docs if u == b" " else one[u]
    out = {}
    for i, text, _ in rows:
        own = token(text)
        base = sum(math.log10(p1(w)) for w in own)
        score = sum(math.log10((two[u, w] + prior * p1(w)) / (seen(u) + prior)) for u, w in zip([b" ", *own], own))
        out[i] = len(own), sum(one[w] > 0 for w in own), base, score
    return out, n


def simhash(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w)] if 0 < len(w) < 3 else [b" ".join(x) for x in zip(w, w[1:], w[2:])]
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def classes(prints, distance=3):
    """Smallest index reachable for every fingerprint of a list."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= distance:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [root(x) for x in range(len(prints))]


def repeated_runs(documents, pieces, run_words):
    """Remaining text per document: pieces in a run of that many words that stands earlier are cut out."""
    cut = [pieces(t or "") for t in documents]
    seen, out = set(), []
    for parts in cut:
        bare = [p.strip() for p in parts]
        n = [b.count(" ") + 1 if b else 0 for b in bare]
        gone = set()
        for i in range(len(parts)):
            total, j = 0, i
            while j < len(parts) and total < run_words:
                total += n[j]
                j += 1
            if total >= run_words and n[i]:
                run = tuple(b for b in bare[i:j] if b)
                if run in seen:
                    gone |= set(range(i, j))
                seen.add(run)
        kept = [p for k, p in enumerate(parts) if k not in gone]
        out.append("".join(kept) if any(p.strip() for p in kept) else "")
    return out


def water_fill(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing the excess until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / w for s in names}
        over = {s for s in names if s not in capped and target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def held_out(doc_id, mod):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % mod == 2
