"""The pipeline's stages, one after the other, against what each is to do with its own input."""

from __future__ import annotations

import os
from collections import Counter, defaultdict

import public_tokenizers

import corpus_pipeline
from fieldloom.llm.common import read_by, shared_root
from tests.llm.test_neardup import brute_set
from tests.llm.test_operators import brute_components, brute_hits


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "simhash", "decontamination", "packing"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(stage(spark, steps[-1], sf).cache())
        assert steps[-1].columns == docs.columns
    rows = [{r.doc_id: r.text for r in s.collect()} for s in steps]
    good = [d for d, q in labels.items() if q == 1 and d in rows[0]]
    assert sum(d in rows[1] for d in good) >= 0.98 * len(good)
    best = {t: max(d for d, x in rows[1].items() if x == t) for t in rows[1].values()}
    assert set(rows[2]) == set(best.values())
    sets = {d: brute_set(t) for d, t in rows[2].items()}
    holders = defaultdict(set)
    for d, own in sets.items():
        for x in own:
            holders[x].add(d)
    near = [(d, d) for d in sets]
    for a, own in sets.items():
        shared = Counter(b for x in own for b in holders[x] if b < a)
        near += [(a, b) for b, n in shared.items() if n >= 0.8 * (len(own) + len(sets[b]) - n)]
    assert set(rows[3]) == set(brute_components(near).values())
    assert set(rows[4]) == {d for d, t in rows[3].items() if not brute_hits(t, bench)[1]}
    last = corpus_pipeline.STAGES[-1][1](spark, steps[-1], sf).collect()
    tokens = Counter()
    for r in last:
        tokens[r.doc_id] += r.length
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert tokens == {d: len(t.encode(x, add_special_tokens=False).ids) + 1 for d, x in rows[4].items()}
    steps_at = os.path.join(shared_root(spark).removeprefix("file://"), "fieldloom")
    before = set(os.listdir(steps_at))
    result, again = corpus_pipeline.run(spark, sf), Counter()
    for r in result.collect():
        again[r.doc_id] += r.length
    assert again == tokens
    # of all that was written only what the result reads is left
    assert set(os.listdir(steps_at)) - before == read_by(result) and len(read_by(result)) == 1
