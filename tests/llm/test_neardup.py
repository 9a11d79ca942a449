"""The pipeline's near-dedup stage against all pairs of altered copies."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from fieldloom.llm import neardup
from tests.llm.test_operators import WORDS, brute_components, docs_of, odd_rows


def brute_set(text: str | None) -> set[tuple[str, ...]]:
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stage_finds_altered_copies(spark, sf):
    rng = random.Random(4)
    rows = [(i, t) for i, t in odd_rows() if i is not None]
    for k in range(25):
        base = [f"{rng.choice(WORDS)}{rng.randrange(90)}" for _ in range(rng.choice((60, 150, 400)))]
        for n in range(12):
            words = list(base)
            for at in rng.sample(range(len(words)), rng.randrange(1 + len(words) // 20)):
                words[at] = f"odd{rng.randrange(10**6)}"
            rows.append((1000 + 100 * k + n, " ".join(words)))
    sets = {i: brute_set(t) for i, t in rows}
    near = [(a, b) for a in sets for b in sets if b <= a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = set(brute_components(near).values())
    assert len(rows) - len(want) > 60
    got = corpus_pipeline.STAGES[2][1](spark, docs_of(spark, rows), sf)
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)


@pytest.mark.parametrize(("similarity", "least", "most"), [(0.8, 0.998, 1), (0.85, 1, 1), (0.9, 1, 1), (0.5, 0, 0.1)])
def test_bands_are_shared(similarity, least, most):
    """Of pairs of sets of a similarity, the share that meets in a band: near pairs do, far ones seldom."""
    rng = np.random.default_rng(9)
    of, pairs, met, passed = neardup.Signature(), 1000, 0, 0
    sketch = neardup.Signature(64 * neardup.SKETCH, 1, 43)
    for n in rng.choice((40, 90, 180), pairs):
        # n shingles in all, of which the share `similarity` is in both
        whole = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        common = int(np.ceil(similarity * n))
        a, b = (np.sort(whole[np.r_[:common, common + side : n : 2]]) for side in (0, 1))
        met += bool((of(a) == of(b)).any())
        passed += int(((sketch.least(a) ^ sketch.least(b)) & 1).sum()) <= neardup.most_apart(0.8)
    assert least * pairs <= met <= most * pairs
    assert passed == pairs if similarity >= 0.8 else passed < 0.01 * pairs


def test_comparisons_stay_few_in_a_group_of_middling_similarity(spark, monkeypatch):
    """Four hundred texts that are half alike, among them near copies: comparisons do not grow with the square of the group."""
    rng = random.Random(6)
    base, rows = [f"{rng.choice(WORDS)}{rng.randrange(900)}" for _ in range(200)], []
    for n in range(400):
        words = list(base)
        for at in rng.sample(range(200), 12):
            words[at] = f"odd{n}x{at}"
        rows.append((n, " ".join(words)))
        if n % 10 == 0:
            rows.append((1000 + n, " ".join([*words[:-1], "end"])))
    compared, real = [], neardup._measured
    monkeypatch.setattr(neardup, "_measured", lambda pairs, sets, steps: (compared.append(pairs.count()), real(pairs, sets, steps))[1])
    got = {r.doc_id for r in neardup.dedup(docs_of(spark, rows)).collect()}
    sets = {i: brute_set(t) for i, t in rows}
    near = [(a, b) for a in sets for b in sets if b <= a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert got == set(brute_components(near).values()) and len(got) < len(rows)
    assert sum(compared) < 0.15 * len(rows) ** 2 / 2


def test_near_fingerprints_are_candidates_whatever_the_bands(spark):
    """Bands that no two texts share: pairs within two bits of their fingerprints are still found, and confirmed on whole sets."""
    from pyspark.sql import functions as F

    rng, rows = random.Random(12), []
    for k in range(40):
        words = [f"{rng.choice(WORDS)}{rng.randrange(90)}" for _ in range(300)]
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join([*words, "end"])), (3 * k + 2, " ".join(["odd", *words[:20], "odd", *words[21:]]))]
    docs = docs_of(spark, rows)
    classes = neardup.signatures(docs).select("id", "fp", "sim", F.array(F.xxhash64("id")).alias("bands")).cache()
    at = {r.id: r for r in classes.collect()}
    sets = {i: brute_set(t) for i, t in rows}
    alike = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    near = [(at[a].fp, at[b].fp) for a, b in alike if ((at[a].sim ^ at[b].sim) & (2**64 - 1)).bit_count() <= 2]
    assert 10 < len(near) < len(alike)
    texts = docs.withColumnRenamed("doc_id", "id").join(classes.select("id", "fp"), "id").select("fp", "text")
    found = [(r.a, r.b) for r in neardup.links(classes.drop("id"), lambda met: texts.join(met, "fp", "left_semi")).collect()]
    assert {tuple(sorted(p)) for p in found} <= {tuple(sorted((at[a].fp, at[b].fp))) for a, b in alike}
    root, want = brute_components(found), brute_components(near)
    assert all(root.get(a) == root.get(b) is not None for a, b in near) and set(want) <= set(root)


def test_stages_bound_the_batches_of_workers(spark, sf):
    """A session's batches of ten thousand documents are made smaller by each stage; smaller ones stay."""
    before = spark.conf.get(corpus_pipeline.BATCH)
    docs = docs_of(spark, [(1, "a b"), (2, None)])
    try:
        for given, want in (("10000", "1000"), ("0", "1000"), ("200", "200")):
            for _, stage in corpus_pipeline.STAGES[1:2] + corpus_pipeline.STAGES[3:4]:
                spark.conf.set(corpus_pipeline.BATCH, given)
                stage(spark, docs, sf)
                assert spark.conf.get(corpus_pipeline.BATCH) == want
    finally:
        spark.conf.set(corpus_pipeline.BATCH, before)
