"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from itertools import combinations

from fieldloom.llm import spelling

DOCS = "doc_id bigint, text string, word string, n bigint, Number int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, 2) for i, t in rows], DOCS)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute_words(rows, every=199):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                out[run] += 1
    return out


def are_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, occurrences=5):
    n = {w: c for w, c in counts.items() if c >= occurrences}
    near = {w: [v for v in n if are_near(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def told(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def test_variants_against_brute_force(spark):
    rng = random.Random(7)
    words = ["Straße", "straßen", "übermut", "keyboard", "keyboards", "aaaaaa", "aaaaaaa", "aaaaaaab", "letters", "settler", "x" * 3000, "x" * 2999 + "y", "×÷×÷×÷"]
    words += ["".join(rng.choice("abcé") for _ in range(rng.choice((6, 7, 8)))) for _ in range(120)]
    rows = [(None, None), (1, ""), (2, "short a b"), (3, "ÀÉÎabc ÀÉÎabc àéîabc")]
    for i in range(400):
        text = []
        for _ in range(40):
            w = words[min(int(rng.expovariate(0.06)), len(words) - 1)]
            at = rng.randrange(len(w))
            kind = rng.random()
            w = w[:at] + w[at + 1 :] if kind < 0.08 else w[:at] + "q" + w[at:] if kind < 0.12 else w[:at] + "z" + w[at + 1 :] if kind < 0.18 else w
            text.append(w if rng.random() < 0.8 else w.upper() if w.isascii() else w)
        rows.append((i if i % 50 else None, rng.choice((" ", "-", "1", ". ")).join(text)))
    rows.append(rows[5])
    counts = brute_words(rows)
    want = brute_variants(counts)
    got = spelling.variants(spelling.damaged(spelling.runs(docs_of(spark, rows))))
    assert told(got) == want
    assert sum(bool(w[1]) for w in want) > 10


def test_chains_are_followed_to_the_last(spark):
    """Counts rise fivefold along a chain of five words."""
    counts = {"abcdef": 5**5, "abcdeg": 5**4, "abcdhg": 5**3, "abcihg": 5**2, "abjihg": 5}
    rows = [(0, " ".join([w] * n)) for w, n in counts.items()]
    got = spelling.variants(spelling.runs(docs_of(spark, rows)).select("word"))
    assert told(got) == brute_variants(Counter(counts))
    assert {r[2] for r in told(got)} == {"abcdef"}


def test_signatures_are_shared_by_all_near_words():
    rng = random.Random(3)
    signer = spelling.Signer()
    half = 2 * len(spelling._KEPT)
    for _ in range(3000):
        w = "".join(rng.choice("abcdeé") for _ in range(rng.randrange(6, 14)))
        at, c = rng.randrange(len(w)), rng.choice("abcdxyzé")
        v = rng.choice((w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]))
        if v == w:
            continue
        a, b = (signer([x])[0].tolist() for x in (w, v))
        # equal lengths meet as shorter words; else the shorter one with the longer one
        short, long_ = (a, b) if len(w) <= len(v) else (b, a)
        assert set(short[:half]) & set(long_[:half] if len(w) == len(v) else long_[half:])


def test_levenshtein_counts_code_points(spark):
    words = ["éàüöñç", "éàüöñ", "éàüöñçx", "éàüöñd", "éàxöñd"]
    rows = [(0, " ".join(words * 6))]
    assert told(spelling.variants(spelling.runs(docs_of(spark, rows)).select("word"))) == brute_variants(Counter({w: 6 for w in words if len(w) >= 6}))
    assert all(are_near(a, b) == are_near(b, a) for a, b in combinations(words, 2))


def test_no_words(spark):
    assert spelling.variants(spelling.damaged(spelling.runs(docs_of(spark, [])))).count() == 0
    assert spelling.variants(spelling.damaged(spelling.runs(docs_of(spark, [(1, "rare words only here")])))).count() == 0
