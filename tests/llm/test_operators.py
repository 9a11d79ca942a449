"""Each operator against brute force or an exact round trip, with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldloom.llm import chat, components, decontam, exact_dedup, neardup, packing, quality, queries, secrets, simhash, toxicity, urls, warc
from fieldloom.llm.common import join_groups

DOCS = "doc_id bigint, text string, lang string, keep_id string, n bigint, __x string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "own", 1, "x") for i, t in rows], DOCS)


def odd_rows():
    long = " ".join(random.Random(1).choices(WORDS, k=20_000))
    return [(1, "a b c d"), (2, "a b c d"), (3, None), (4, ""), (5, "A b c d"), (None, "a b c d"), (None, None), (6, long), (7, long), (7, long), (8, "é\u2028 ß \x1c x"), (9, "  ")]


def brute_groups(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in by.items()}
    return Counter((i, best[t or ""], len(by[t or ""]), i == best[t or ""]) for i, t in rows)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 2))])
def test_exact_dedup(spark, digest):
    rows = odd_rows() + [(100 + k, f"t{k % 700}") for k in range(1000)]
    got = exact_dedup.groups(docs_of(spark, rows), digest=digest).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == brute_groups(rows)
    left = exact_dedup.dedup(docs_of(spark, rows), digest=digest)
    assert left.columns == docs_of(spark, rows).columns
    want = Counter(i for (i, k, _, kept), n in brute_groups(rows).items() if kept for _ in range(n))
    assert Counter(r.doc_id for r in left.collect()) == want


def test_exact_dedup_index_grows(spark):
    index = exact_dedup.DigestIndex(spark, keep="min")
    index.flush(docs_of(spark, [(5, "a"), (6, "b")]))
    index.flush(docs_of(spark, [(2, "a")]))
    assert sorted((r.keep_id, r.copies) for r in index.compact().collect()) == [(2, 2), (6, 1)]


def test_empty_tables(spark):
    none, labels = docs_of(spark, []), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id bigint, text string")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    path = public_tokenizers.path("word_bpe_49k.json")
    assert exact_dedup.groups(none).count() == exact_dedup.dedup(none).count() == 0
    assert simhash.near_groups(none).count() == simhash.dedup(none).count() == 0
    assert decontam.mark(none, bench).count() == packing.pieces(none, path).count() == secrets.find(none).count() == 0
    assert quality.select(none, labels).count() == toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    assert warc.read(warc.write(pages)).count() == urls.judge(pages, queries.RULES).count() == 0
    talks = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.read_chats(chat.format_chats(talks, public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


def brute_fp(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(pairs):
    """{node: least node it reaches} of (a, b) links."""
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


INTERNAL = """id key h t n s u v m a b fp op rep copies root node digest hex kind shard state word hub hi lo open maybe taken draw good seen text_sha256 digest __digest __key __maybe __lost
    __id __good __word __bits __mask __rows __digest_lost __key_lost __fp __bands __size __text __ranges __items __log_weight __gumbel_key n_words n_hit item_ids hit_spans kept_n_words keep_id
    log_weight gumbel_key weak assign access row r host path rule verdict page_id refers_to lang part at base local_start ids start length offset conv_id turn formatted lone size""".split()


def clashing(frame, *own):
    """frame with a column for every internal name but its own, each telling its name."""
    return frame.select("*", *[F.lit(f"kept {c}").alias(c) for c in dict.fromkeys(INTERNAL) if c not in frame.columns])


@pytest.mark.parametrize("name", ["exact_dedup", "simhash", "neardup", "quality", "decontam", "decontam_parts"])
def test_filtering_operators_give_back_every_column(spark, name):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, "g h i j k l m n o p q"), (None, "z")], "doc_id bigint, text string")
    labels, bench = spark.createDataFrame([(1, 1), (4, 1)], "doc_id bigint, quality int"), spark.createDataFrame([(1, "q r"), (2, "o p q")], "item_id bigint, text string")
    run = {
        "exact_dedup": exact_dedup.dedup, "simhash": simhash.dedup, "neardup": neardup.dedup, "quality": lambda d: quality.select(d, labels, share=0.5),
        "decontam": lambda d: decontam.clean(d, bench), "decontam_parts": lambda d: decontam.clean(d, bench, max_benchmark_mb=1e-6),
    }[name]
    plain, wide = run(docs), run(clashing(docs))
    assert wide.dtypes == clashing(docs).dtypes
    rows = wide.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in plain.collect()) and 0 < len(rows) < 5
    assert all(r[c] == f"kept {c}" for r in rows for c in wide.columns[2:])


def test_other_operators_pass_over_every_column(spark):
    docs, path = spark.createDataFrame([(1, "token=abcdefgh a"), (2, None)], "doc_id bigint, text string"), public_tokenizers.path("word_bpe_49k.json")
    labels, rules = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int"), queries.RULES
    pages = spark.createDataFrame([(1, "http://x.org/es/", "<p>"), (2, None, None)], "page_id bigint, url string, html string")
    talks = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id bigint, turn bigint, role string, text string")
    chats = lambda t: chat.read_chats(chat.format_chats(t, public_tokenizers.path("byte_bpe_50k.json")))
    runs = [
        (docs, lambda d: packing.pieces(d, path)), (docs, secrets.find), (docs, exact_dedup.groups), (docs, simhash.near_groups), (docs, lambda d: toxicity.score(d, toxicity.fit(d, labels))),
        (docs, lambda d: quality.weights(d, labels.withColumnRenamed("toxic", "quality"))), (pages, lambda p: urls.judge(p, rules)), (pages, lambda p: warc.read(warc.write(p)).drop("file")), (talks, chats),
    ]
    for frame, run in runs:
        plain, wide = run(frame), run(clashing(frame))
        assert plain.columns == wide.columns and sorted(map(str, plain.collect())) == sorted(map(str, wide.collect()))


def test_no_machine_local_folder_off_one_machine():
    from fieldloom.llm.common import is_local

    assert [is_local(m) for m in ("local", "local[4]", "local[*]", "local-cluster[2,1,1024]", "yarn", "spark://h:7077", "k8s://h")] == [True] * 3 + [False] * 4


def test_index_merges_levels_and_asks_its_filters(spark):
    index = exact_dedup.DigestIndex(spark, keep="min")
    rows = [(k, f"t{k % 40}") for k in range(100)]
    for part in (rows[:50], rows[50:70], rows[70:], [(7, "new")]):
        index.flush(docs_of(spark, part))
        index.compact()
    want = Counter((min(k for k, t in rows if t == x), n) for x, n in Counter(t for _, t in rows).items()) + Counter([(7, 1)])
    assert Counter((r.keep_id, r.copies) for r in index.compact().collect()) == want
    probe = index.hit_filter().split(index.runs().withColumn("h", F.xxhash64("digest")), "h", "maybe")
    told = {bytes(r.digest): r.maybe for r in probe.collect()}
    assert all(told[hashlib.sha256(t.encode()).digest()] for _, t in rows) and not told[hashlib.sha256(b"new").digest()]


def test_simhash_fingerprints_and_components(spark):
    rng = random.Random(3)
    rows = [(i, t) for i, t in odd_rows() if i is not None]
    base = [rng.choices(WORDS, k=200) for _ in range(30)]
    for k in range(300):
        words = list(rng.choice(base))
        if k % 3:
            words[rng.randrange(200)] = "odd"
        rows.append((1000 + k, " ".join(words)))
    fps = [brute_fp(t) for _, t in rows]
    assert fps == [simhash.simhash(t) for _, t in rows]
    links = [(rows[a][0], rows[b][0]) for a in range(len(rows)) for b in range(a + 1) if (fps[a] ^ fps[b]).bit_count() <= 2]
    want = brute_components(links)
    got = simhash.near_groups(docs_of(spark, rows)).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((i, want[i]) for i, _ in rows)
    left = {r.doc_id for r in simhash.dedup(docs_of(spark, rows)).collect()}
    assert left == set(want.values())


def test_covering_masks_cover():
    rng, masks = random.Random(5), simhash.covering_masks(2)
    for a in range(64):
        for b in range(64):
            assert any(not (1 << a | 1 << b) & m for m in masks)
    x = rng.getrandbits(64)
    assert len(masks) == 7 and any((x ^ (x ^ 5)) & m == 0 for m in masks)


def test_links_between_fingerprints_at_exactly_two_bits(spark):
    rng = random.Random(9)
    fps = {rng.getrandbits(63) for _ in range(60)}
    for f in list(fps):
        for _ in range(6):
            f ^= 1 << rng.randrange(63) | 1 << rng.randrange(63)
            fps.add(f)
    fps |= {1 << b for b in range(40)} | {0}
    table = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    got = {r.node: r.root for r in components.components(simhash.links(table)).collect()}
    order = sorted(fps)
    want = brute_components([(a, b) for i, a in enumerate(order) for b in order[:i] if (a ^ b).bit_count() <= 2])
    assert got == want


def test_components_of_chains(spark):
    pairs = [(k, k + 1) for k in range(200)] + [(500, 501), (501, 700), (900, 900)] + [(1000, 1000 + k) for k in range(1, 50)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    want = brute_components([p for p in pairs if p[0] != p[1]])
    assert got == want


def brute_hits(text, items, size=10):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = low(text), set(), set()
    for item, t in items:
        own = low(t)
        for at in range(max(1, len(own) - size + 1) if own else 0):
            window = own[at : at + size]
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(None if item is None else str(item))
    return len(words), len(hit), sorted(x for x in found if x is not None)


@pytest.mark.parametrize("block", [2_000_000, 12])
def test_decontamination(spark, block):
    rng = random.Random(4)
    items = [(k, " ".join(rng.choices(WORDS[:6], k=n))) for k, n in enumerate([14, 12, 3, 1, 10, 11])] + [(50, None), (51, ""), (None, "nu xi"), (0, "omikron Pi")]
    rows = [(k, " ".join(rng.choices(WORDS[:6], k=rng.randrange(40)))) for k in range(60)]
    rows += [(100, "X; " + items[0][1].upper().replace(" ", ",\n") + "!"), (101, "nu-xi É"), (102, None), (103, ""), (104, "PI omikron pi"), (None, items[1][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = docs_of(spark, rows).withColumn("n_hit", F.lit("clash"))
    got = decontam.mark(docs, bench, max_window_words=block).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in got) == Counter((i, *brute_hits(t, items)[:2], tuple(brute_hits(t, items)[2])) for i, t in rows)
    upper = next(r for r in got if r.doc_id == 100)
    assert [upper.text[s.start : s.end] for s in upper.hit_spans] == [upper.text[3:-1]]
    parts = decontam.mark(docs, bench, max_window_words=block, max_benchmark_mb=1e-4)
    assert sorted(map(str, parts.collect())) == sorted(map(str, got)) and parts.columns == [*docs.drop("n_hit").columns, *decontam.OUT.names]
    assert {r.doc_id for r in decontam.clean(docs_of(spark, rows), bench).collect()} == {i for i, t in rows if not brute_hits(t, items)[1]}


def test_more_distinct_words_than_code_points():
    items = [(k, f"w{k}") for k in range(1_150_000)] + [(-1, "w1 w2"), (-2, "w2 w1149999")]
    matchers = [decontam.Matcher(b) for b in decontam.blocks_of(items, 10, 2_000_000)]
    assert len(matchers) == 1 and matchers[0].width == 4
    n_words, n_hit, found, _ = decontam.hits("W1 w2 w1149999 w77 none", matchers, [], [], True)
    assert (n_words, n_hit) == (5, 4) and set(found) == {1, 2, 1149999, 77, -1, -2}


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = odd_rows() + [(20, "Hello, <|endoftext|> x<|endoftext|>y<|startoftext|> <|ENDOFTEXT|> é<|endoftext|> WORLD's 123 é\u0301 \u00a0x\x1cy \u2003z İstanbul ΑΣ ﬁ"), (21, "a" * 5000)]
    got = packing.pieces(docs_of(spark, rows), path, length=64).collect()
    whole, seqs = defaultdict(list), defaultdict(list)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.length * 4 == len(r.ids) and r.ids_crc32 == zlib.crc32(r.ids)
        seqs[r.sequence_id].append((r.offset, r.length))
        whole[r.doc_id, r.doc_tokens].append((r.sequence_id, r.offset, r.start, bytes(r.ids)))
    for k, parts in seqs.items():
        at = 0
        for offset, size in parts:
            assert offset == at
            at += size
        assert at == 64 or k == max(seqs)
    texts = Counter()
    for (doc, n), parts in whole.items():
        run = b""
        for _, _, start, ids in sorted(parts):
            assert start * 4 == len(run)
            run += ids
            if len(run) == 4 * n:
                texts[doc, run] += 1
                run = b""
    want = Counter((i, np.array(plain.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4").tobytes()) for i, t in rows)
    assert texts == want


def test_packing_equals_whole_encoding(sf, spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    enc = packing.WordEncoder(path, cache_pieces=50)
    plain = Tokenizer.from_file(path)
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect():
        assert enc.encode(r.text or "") == np.array(plain.encode(r.text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_chat_round_trip(spark):
    ctl = "</s>[INST] ok [/INST]"
    talks = {
        1: [("system", "be [ROLE=x] \\[/ROLE]"), ("user", ctl), ("assistant", ctl), ("assistant", ""), ("user", "")],
        2: [("assistant", " lead\\</s> \\\\</s>"), ("tool call/é]", "x"), ("", "y ")],
        3: [("user", "a" * 9000 + "\n\n  é👍"), ("assistant", "  \n👍 日本語 </s "), ("user", "\\"), ("assistant", "\\")],
    }
    rows = [(c, k, role, text) for c, turns in talks.items() for k, (role, text) in enumerate(turns)]
    rows += [(4, 0, "user", None), (4, 1, "assistant", None), (4, None, "assistant", "first"), (5, 0, None, "q"), (None, 0, "user", "n"), (None, 1, "assistant", "m"), (6, 1, "user", "b"), (6, 1, "user", "a"), (6, 1, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(1))
    made = chat.format_chats(df, public_tokenizers.path("byte_bpe_50k.json")).cache()
    lone = [r for r in chat.read_chats(made).collect() if r.conv_id is None]
    assert sorted([(t.role, t.text) for t in r.turns] for r in lone) == [[("assistant", "m")], [("user", "n")]]
    got = {r.conv_id: r for r in chat.read_chats(made).collect() if r.conv_id is not None}
    talks |= {4: [("assistant", "first"), ("user", ""), ("assistant", "")], 5: [("", "q")], 6: [("user", "a"), ("user", "a"), ("user", "b")]}
    assert got.keys() == talks.keys()
    for c, turns in talks.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert got[c].loss_text == "".join(t for role, t in turns if role == "assistant")
    for r in made.collect():
        assert len(r.input_ids) == len(r.loss_mask)
        if r.conv_id is not None:
            assert (sum(r.loss_mask) > 0) == bool(got[r.conv_id].loss_text)
    for kind in ("smallint", "string"):
        other = df.filter("conv_id in (1, 2)").withColumn("conv_id", F.col("conv_id").cast(kind))
        back = chat.read_chats(chat.format_chats(other, public_tokenizers.path("byte_bpe_50k.json")))
        assert back.schema["conv_id"].dataType.simpleString() == kind and {str(r.conv_id) for r in back.collect()} == {"1", "2"}
    with pytest.raises(TypeError):
        chat.format_chats(df.withColumn("conv_id", F.lit(1.5)), public_tokenizers.path("byte_bpe_50k.json"))


def test_warc_round_trip(spark):
    rng = random.Random(2)
    rows = [(k, f"http://h/{k % 7} x\n", f"<p>{rng.randrange(40)}</p>é" * rng.randrange(1, 300)) for k in range(300)]
    rows += [(1000, None, None), (1001, "u", ""), (None, "n", "<b>"), (None, None, None), (1003, "d", "<b>"), (1003, "d", "<b>"), (1004, "big", "z" * 2_000_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("n", F.lit("clash")).repartition(5)
    manifest = warc.write(pages, shard_bytes=200_000, roll_bytes=20_000)
    got = warc.read(manifest).collect()
    best = {}
    for p, _, h in rows:
        best[h or ""] = max([x for x in (p, best.get(h or "")) if x is not None], default=None)
    want = Counter()
    for p, _, h in rows:
        data = (h or "").encode()
        keep = best[h or ""]
        want[p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if p == keep else "revisit", None if p == keep else keep] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    again = warc.write(pages.repartition(3), shard_bytes=200_000, roll_bytes=20_000)
    sums = [sorted((r.name, hashlib.sha256(open(r.path.removeprefix("file://") + "/" + r.name, "rb").read()).hexdigest()) for r in m.collect()) for m in (manifest, again)]
    assert sums[0] == sums[1] and len(sums[0]) > 5
    named = warc.read(warc.write(pages.withColumn("page_id", F.concat(F.lit("p"), "page_id")), shard_bytes=200_000)).collect()
    assert {r.page_id for r in named} == {None if p is None else f"p{p}" for p, _, _ in rows} and len(named) == len(rows)
    with pytest.raises(TypeError):
        warc.write(pages.withColumn("page_id", F.lit(1.5)))
    every = warc.read(warc.write(pages, revisit_min_bytes=1 << 40)).filter("record_type != 'response'")
    assert every.count() == 0


def brute_secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        out += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    ids = [(m.start(), 3, m.end()) for m in re.finditer(secrets.WEAK["id"], text)]
    bare = [(m.start(), 4, m.end()) for m in re.finditer(secrets.WEAK["secret"], text)]
    ends = [(m.start(), 5, m.end()) for m in re.finditer(secrets.WEAK["endpoint"], text)]
    near = lambda a, others: any(max(b[0] - a[2], a[0] - b[2]) <= 400 for b in others)
    names, keys = [s for s in out if s[1] == 1] + ids, [s for s in out if s[1] == 0] + bare
    weak = [a for a in ids if near(a, keys)] + [a for a in bare if near(a, names)] + [a for a in ends if near(a, names) and near(a, keys)]
    return out, sorted(out + weak)


def test_secrets(spark):
    rng = random.Random(8)
    bits = ["token: ", "Token=", "password'='", "api_key : \"", "APIKEY:", "abcdef", "ab", "=", "AKIA" + "A1" * 8, "AKIAAKIA", "AKIA" + "Z" * 20, "f" * 24, "0123456789abcdef" * 2, "ASIA" + "B2" * 8, "aB3" * 14, "https://s3.example.com/x", " ", "\n", "é👍", "x" * 390, "sts.eu.example.org", "secret", "passwd:"]
    rows = [(k, "".join(rng.choices(bits, k=rng.randrange(1, 30)))) for k in range(400)] + odd_rows() + [(900, "token: token: abcdefgh"), (901, "token:\nabcdefg"), (902, "token = abcdef " * 1500)]
    for n, size in enumerate((10, 100, 390, 410, 800, 1199, 1200, 1201, 2000)):
        long_secret, long_id = ("A1b" * size)[:size], "ASIA" + "Q" * size
        rows += [(1000 + 10 * n + k, t) for k, t in enumerate((f"x {long_secret} ASIAQQQQQQQQQQQQQQQQ", f"{long_id} {'aB3' * 14}", f"{'aB3' * 14}{' ' * 399}{long_id}", f"{long_id}{' ' * 400}{long_secret}", f"{long_id}{' ' * 401}{long_secret}", f"token={long_secret}{' ' * 30}https://{'a' * size}.example.org:80 {long_id}"))]
    df = docs_of(spark, rows)
    got = secrets.find(df).select("doc_id", F.col("assign").alias("a"), F.concat("assign", "access", "hex").alias("base"), secrets.spelled(F.concat("assign", "access", "hex", "linked")).alias("spans")).collect()
    spell = lambda spans: ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
    want = Counter((i, len(brute_secrets(t)[0]), spell(brute_secrets(t)[1])) for i, t in rows)
    assert Counter((r.doc_id, len(r.base), r.spans) for r in got) == want
    assert sum("secret:" in r.spans for r in got) > 5 and sum("endpoint:" in r.spans for r in got) > 5


def test_urls(spark):
    rng = random.Random(6)
    rows = [(k, f"http://{rng.choice(['a.', 'B.c.', ''])}example.{rng.choice(['org', 'com', 'net', 'ORG'])}/{rng.choice(['es', 'en', 'fr', 'de'])}/{rng.randrange(99)}{rng.choice(['', '?page=2&ref=x', '#top'])}") for k in range(600)]
    rows += [(1000, None), (1001, "nothing"), (1002, "http://org"), (1003, "ftp://x.org?/es/#"), (1004, ""), (None, "http://q.com/de/1"), (1005, "http://notexample.org/es/"), (1006, "://Org/"), (1007, "a://b://c.org/d")]
    df = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("clash"))

    def brute(url):
        _, found, rest = (url or "").partition("://")
        host = re.match(r"[^/?#]*", rest)[0] if found else ""
        path = re.match(r"[^?#]*", rest[len(host) :])[0] if found else ""
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), h + p, v) for v, h, p in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits, default=(0, None, None))[1:]

    got = urls.judge(df, queries.RULES).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == Counter((i, brute(u)[0], brute(u)[1], brute(u)[2][0]) for i, u in rows)
    for r in got:
        u = next(u for i, u in rows if i == r.page_id)
        assert r.verdict == brute(u)[2][1] if brute(u)[2][1] else r.verdict in ("allow", "block")
    # what the rules block everywhere that they reach is blocked beyond their reach too; the rest is not
    net = [(r.path.split("/")[1], r.verdict) for r in got if r.host.endswith("net")]
    assert {v for p, v in net if p == "es"} == {"block"} and {v for p, v in net if p == "fr"} == {"allow"}


def test_mined_rules_against_counts(spark):
    from itertools import combinations

    rng = random.Random(1)
    rows = []
    for _ in range(300):
        tokens = sorted(set(rng.choices("abcdef", k=4)))
        rows.append((tokens, "block" if "a" in tokens and "b" in tokens or rng.random() < 0.1 else "allow"))
    got = urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), min_support=0.02, min_confidence=0.8).collect()
    both, alone = Counter(), Counter()
    for tokens, verdict in rows:
        for n in (1, 2, 3):
            for c in combinations(tokens, n):
                alone[c] += 1
                both[c, verdict] += 1
    rules = {(c, v): n / alone[c] for (c, v), n in both.items() if n / alone[c] >= 0.8 and n >= 0.02 * len(rows)}
    subs = lambda c: {s for n in range(1, len(c)) for s in combinations(c, n)}
    want = {k: conf for k, conf in rules.items() if not any(rules.get((s, k[1]), 0) >= conf for s in subs(k[0]))}
    assert {(tuple(sorted(r.tokens)), r.verdict): round(r.confidence, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}


def test_mining_keeps_the_common_tokens_of_rich_urls(spark):
    """Seventeen frequent tokens a url, the labels told by the most common ones, one of which has a twin that goes wherever it goes."""
    from itertools import combinations

    rng, rows = random.Random(8), []
    for _ in range(200):
        tokens = {f"r{k:02}" for k in range(16) if rng.random() < 0.7} | {c for c in "xyz" if rng.random() < 0.9}
        tokens |= {"twin"} if "x" in tokens else set()
        rows.append((sorted(tokens), "block" if {"x", "y"} <= tokens and rng.random() < 0.95 else "allow"))
    assert sum(len(t) - ("twin" in t) > 12 for t, _ in rows) > 100
    both, alone = Counter(), Counter()
    for tokens, verdict in rows:
        for n in (1, 2, 3):
            for c in combinations(tokens, n):
                alone[c] += 1
                both[c, verdict] += 1
    rules = {(c, v): n / alone[c] for (c, v), n in both.items() if n / alone[c] >= 0.9 and n >= 0.2 * len(rows)}
    want = {k: conf for k, conf in rules.items() if not any(rules.get((s, k[1]), 0) >= conf for n in range(1, len(k[0])) for s in combinations(k[0], n))}
    got = urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), min_support=0.2, min_confidence=0.9).collect()
    assert {(tuple(r.tokens), r.verdict): round(r.confidence, 9) for r in got} == {k: round(v, 9) for k, v in want.items()} and len(got) == len(want)
    assert (("x", "y"), "block") in want and (("twin", "y"), "block") in want


def test_mining_is_bounded_where_many_tokens_go_together(spark):
    """Forty tokens in all urls of a site, and thirty that each miss one url: sets of all sizes would be 2^70."""
    site = [f"s{k}" for k in range(40)]
    rows = [(sorted({*site, *(f"t{k}" for k in range(30) if k != i % 40)}), "block") for i in range(80)] + [(["other", f"u{i % 3}"], "allow") for i in range(100)]
    got = urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), min_support=0.05, min_confidence=0.9).collect()
    told = {(tuple(r.tokens), r.verdict): (r.confidence, r.support) for r in got}
    assert told[("other",), "allow"] == (1.0, 100 / 180)
    blocked = [k for k, (tokens, v) in enumerate(rows) if v == "block" and any(set(r) <= set(tokens) for r, w in told if w == "block")]
    assert blocked == list(range(80))


def auc(truth, scores):
    """Probability that a positive row scores above a negative one."""
    up, down = ([s for t, s in zip(truth, scores, strict=True) if t == k] for k in (1, 0))
    return sum((a > b) + 0.5 * (a == b) for a in up for b in down) / (len(up) * len(down))


def test_toxicity_learns_pairs_of_words_that_tell_nothing_alone(spark):
    """Both words or neither: each is as common in toxic rows as in others."""
    rng, rows, labels = random.Random(5), [], []
    for k in range(3000):
        words = rng.choices([f"word{j}" for j in range(400)], k=30) + {0: ["silly", "group"], 1: ["silly"], 2: ["group"], 3: []}[k % 4]
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 4 in (0, 3))))
    docs, lab = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit(docs, lab)
    for fm, right in ((model, True), (model.without_pairs(), False), (toxicity.fit(docs, lab, pairs=False), False)):
        got = {r.doc_id: r for r in toxicity.score(docs, fm).collect() if r.held_out}
        value = auc([labels[k][1] for k in got], [r.score for r in got.values()])
        assert value > 0.9 if right else value < 0.6


def test_toxicity_pairs_rare_words_among_thousands_of_frequent_ones(spark):
    """The words that decide together are in 6 per cent of the rows; 5,000 other words are more frequent."""
    rng, rows, labels = np.random.default_rng(3), [], []
    for k in range(2400):
        words = [f"w{j}" for j in rng.choice(5000, 600, replace=False)] + {0: ["silly", "group"], 1: ["silly"], 2: ["group"]}.get(k % 16, [])
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 16 == 0 or k % 16 not in (1, 2) and rng.uniform() < 0.5)))
    docs, lab = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit(docs, lab)
    ends = np.flatnonzero(model.paired >= 0)
    assert {zlib.crc32(w.encode()) % toxicity.DIMS for w in ("silly", "group")} <= set(ends.tolist()) and len(ends) < 50
    for fm, right in ((model, True), (toxicity.fit(docs, lab, pairs=False), False)):
        got = {r.doc_id: r.score for r in toxicity.score(docs.filter("doc_id % 16 < 3"), fm).collect() if r.held_out}
        value = auc([labels[k][1] for k in got], list(got.values()))
        assert value > 0.9 if right else value < 0.7


def test_pair_ends_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [np.flatnonzero(rng.uniform(size=700) < 0.05) for _ in range(500)]
    y = np.array([0.95 if {3, 9} <= set(r.tolist()) or {650, 12} <= set(r.tolist()) else rng.normal(0, 0.1) for r in rows])
    for r in rows[:60]:
        r[:2] = (3, 9)
    rows = [np.unique(r) for r in rows]
    y[:60] = 0.95
    spread = rng.uniform(0, 0.2, 500)
    x = np.zeros((500, 700))
    for k, r in enumerate(rows):
        x[k, r] = 1
    z = np.abs(x.T @ (x * y[:, None])) / np.sqrt(1 + x.T @ (x * spread[:, None]))
    np.fill_diagonal(z, 0)
    able = np.maximum(np.maximum(x * y[:, None], 0).sum(0), np.maximum(-x * y[:, None], 0).sum(0)) > 3
    least = max(3.0, np.sqrt(2 * np.log(able.sum() * (able.sum() - 1) / 2 + 1)) - 1)
    want = np.flatnonzero((z > least).any(axis=1))
    assert 2 <= len(want) < 100
    assert toxicity.pair_ends(spark, rows, y, spread, 700, 3.0).tolist() == want.tolist()


def brute_score(fm, text):
    """The model's formula, pair by pair."""
    words = set(re.findall(r"\w+", (text or "").lower()))
    terms = {zlib.crc32(p.encode()) % toxicity.DIMS for w in words for p in [w, *(f"{w[:n]}*{n}" for n in (4, 5, 6) if len(w) > n)]}
    z = fm.bias + sum(fm.w[fm.linear[t]] * fm.x[fm.linear[t]] for t in terms if fm.linear[t] >= 0)
    paired = [fm.v[fm.paired[t]] for t in terms if fm.paired[t] >= 0]
    z += sum(float(a @ b) for i, a in enumerate(paired) for b in paired[:i]) / max(1, len(paired)) ** 0.5
    return 1 / (1 + np.exp(-max(-30.0, min(30.0, z))))


def test_toxicity_scores_by_formula_and_keeps_held_out_rows_out(spark):
    rng, rows, labels = random.Random(5), [], []
    for k in range(3000):
        words = rng.choices([f"word{j}" for j in range(400)], k=30)
        words += {0: ["silly", "group"], 1: ["silly"], 2: ["group"], 3: ["Fool,"]}[k % 4] + (["Fool"] if k % 8 == 0 else [])
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 4 in (0, 3))))
    rows += [(5000, None), (5001, ""), (None, "silly group"), (5002, " ".join(rng.choices(WORDS, k=20_000))), (5003, "x\x1csilly\u2028GROUP")]
    labels += [(None, 1), (7777, 1), (0, None)]
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit(docs_of(spark, rows), lab)
    assert len(model.v) and len(model.w)
    got = toxicity.score(docs_of(spark, rows), model).collect()
    want = {(i, t): brute_score(model, t) for i, t in rows}
    assert len(got) == len(rows) and all(r.predicted == (r.score >= 0.3) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert all(abs(by_id[i].score - s) < 1e-9 for (i, _), s in want.items())
    assert all(by_id[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in range(3000))
    out = [k for k in range(3000) if by_id[k].held_out]
    assert sum(by_id[k].predicted == labels[k][1] for k in out) / len(out) > 0.97
    flipped = spark.createDataFrame([(k, 1 - y if k is not None and y is not None and by_id.get(k) and by_id[k].held_out else y) for k, y in labels], "doc_id bigint, toxic int")
    other = toxicity.fit(docs_of(spark, rows), flipped)
    assert np.array_equal(other.w, model.w) and np.array_equal(other.v, model.v) and other.bias == model.bias


def brute_quality(rows, labels, buckets=quality.BUCKETS, evidence=16.0, prior=4.0):
    """{(id, text): (log weight, key)} from the definition."""
    def grams(text):
        h = [zlib.crc32(w.encode()) for w in re.findall(r"\w+|[^\w\s]+", text or "")]
        both = [x * 0x9E3779B97F4A7C15 for x in h] + [x * 0x9E3779B97F4A7C15 + y * 0xC2B2AE3D27D4EB4F for x, y in zip(h, h[1:])]
        return [(x % 2**64 >> 32) % buckets for x in both]

    def spark_hash(*values):
        seed = 42
        for v in values:
            if v is not None:
                seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), seed)
        return seed

    seen = lambda i: (spark_hash("fold", i) + 2**63) % 4 != (3 + 2**63) % 4  # noqa: E731 (remainder of a signed number)
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if labels.get(i) == 1 and seen(i):
            target.update(grams(t))
    n, m = sum(raw.values()), sum(target.values())
    ratio = {g: np.log((target[g] + prior) / (c * m / n + prior)) for g, c in raw.items()}
    out = {}
    for i, t in rows:
        own = grams(t)
        w = sum(ratio[g] for g in own) * min(1.0, evidence / max(1, len(own)))
        u = ((spark_hash("gumbel", i, t) >> 11) + 0.5) / 2**53
        out[i, t] = (w, w - np.log(-np.log(u)))
    return out


def quality_rows():
    rng, rows, labels = random.Random(5), [], []
    for k in range(2000):
        words = rng.choices([f"word{j}" for j in range(300)], k=40)
        good = k % 5 != 0
        rows.append((k, " ".join(w if good else w + "$$$" for w in words)))
        if k % 3 == 0:
            labels.append((k, int(good)))
    return rows + [(9000, None), (9001, ""), (None, "word1 word2"), (9002, "word1$$$ word2"), (9002, "word1$$$ word2"), (9003, rows[5][1])], labels


def test_quality_weights_and_keys_against_brute_force(spark):
    rows, labels = quality_rows()
    lab = spark.createDataFrame(labels + [(None, 1), (3, None), (5, 1), (5, 0)], "doc_id bigint, quality int")
    table = quality.sample(quality.weights(docs_of(spark, rows), lab), share=0.5)
    want = brute_quality(rows, dict(labels) | {5: 1})
    got = table.collect()
    assert len(got) == len(rows)
    mine = Counter((r.id, round(r.log_weight, 6), round(r.gumbel_key, 6)) for r in got)
    assert mine == Counter((i, round(want[i, t][0], 6), round(want[i, t][1], 6)) for i, t in rows)
    keys = sorted((want[x][1] for x in rows), reverse=True)
    assert Counter(r.taken for r in got)[True] in (len(rows) // 2, len(rows) // 2 + 1)  # repeated rows have one key
    assert {r.id for r in got if r.taken} == {i for i, t in rows if want[i, t][1] >= keys[len(rows) // 2 - 1] - 1e-6}


def test_quality_keeps_good_and_samples_exactly(spark):
    rows, labels = quality_rows()
    lab = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id bigint, quality int")
    docs = docs_of(spark, rows)
    kept = quality.select(docs, lab)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    good = [k for k in range(2000) if k % 5]
    assert sum(k in ids for k in good) >= 0.99 * len(good) and sum(k in ids for k in range(0, 2000, 5)) <= 4
    table = quality.weights(docs, lab)
    for s in (0.0, 0.25, 1.0):
        taken = quality.sample(table, share=s).filter("taken")
        assert abs(taken.count() - round(s * len(rows))) <= 1
    assert quality.select(docs, lab.filter("quality = 0")).count() == len(rows)


def test_gumbel_top_k_follows_weights(spark):
    """A row of three times the weight is taken three times as often, so the draw decides."""
    flat = spark.range(20000).select("id", F.xxhash64("id").alias("draw"), F.when(F.col("id") % 2 == 0, 0.0).otherwise(float(np.log(3))).alias("log_weight"), F.lit(None).cast("int").alias("good"), F.lit(True).alias("seen"))
    taken = quality.sample(flat, share=0.05).filter("taken").groupBy(F.col("id") % 2).count().collect()
    n = {r[0]: r[1] for r in taken}
    assert n[0] + n[1] == 1000 and 2.4 < n[1] / n[0] < 3.7


def test_cached_parts_give_the_tokens_and_offsets_of_whole_texts():
    import random

    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, rng = chat.Encoder(path, cache_parts=40), random.Random(3)
    plain = "".join(c for c in map(chr, range(0x250)) if chat.PLAIN.fullmatch(c))
    texts = [plain, "", "  a  b\n\n c's don't 12ab_x ", "\u4e2d\U0001f600 x\u0301", "<|endoftext|> <s>"]
    texts += ["".join(rng.choice(plain if k % 2 else "ab 'stre.\n\xe9\xa0") for _ in range(rng.randrange(80))) for k in range(300)]
    for text in texts:
        want = enc.tokenizer.encode(text, add_special_tokens=False)
        ids, starts, ends = enc(text)
        assert ids.tolist() == want.ids
        assert ends.tolist() == np.maximum.accumulate([b for _, b in want.offsets] or [0]).tolist()[: len(want.ids)]
        assert starts.tolist() == [0, *ends.tolist()[:-1]][: max(1, len(want.ids))]


def test_hot_keys_are_joined_like_others(spark):
    rows = [(k, "hot") for k in range(500)] + [(500 + k, f"t{k % 300}") for k in range(900)] + [(2000, "lone")]
    frame = spark.createDataFrame(rows, "n bigint, key string")
    counted = frame.groupBy("key").agg(F.count("*").alias("size"), F.max("n").alias("last"))
    last = {key: max(n for n, k in rows if k == key) for _, key in rows}
    for parts in (2, 100, 4096):  # the hot key, hot and some others, all keys by broadcast
        got = join_groups(frame, counted, ["key"], "size", parts=parts)
        assert set(got.columns) == {"n", "key", "last"}
        assert Counter((r.n, r.key, r.last) for r in got.collect()) == Counter((n, k, last[k]) for n, k in rows)
    assert join_groups(frame.limit(0), counted.limit(0), ["key"], "size").count() == 0


def test_spans_of_a_text_with_very_many_matches(spark):
    text = " ".join(f"é {k:x} token={k:08d} " + "ab" * 12 for k in range(3000))
    (got,) = secrets.find(docs_of(spark, [(1, text)])).collect()
    assert [(x.start, x.end) for x in got.hex] == [m.span() for m in re.finditer("[0-9a-f]{24,}", text)]
    assert [(x.start, x.end) for x in got["assign"]] == [m.span() for m in re.finditer("token=[0-9]+", text)]
    assert len(got.hex) == len(got["assign"]) == 3000
