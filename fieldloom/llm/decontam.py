"""Benchmark decontamination with one Aho-Corasick automaton over the normalised benchmark items.

Normalised text is a sequence of words. Each word of the benchmark gets a code of a few letters, all of one length, a window
becomes a string of them, and all windows go into one automaton. A document's words are turned into such a string once (words
that no item has become one reserved code) and the automaton scans it once, so a match's end gives the
number of a word; for documents that are hit, word numbers are mapped to offsets in the original text.

The automaton is built once in each task. Its size is bounded: windows are taken in blocks of at most
`max_window_words` words in total, so that a larger benchmark means more scans, each over all rows, whose hits
are joined row by row in the same pass, with no shuffle. What is sent to the executors is bounded too: a benchmark of more
than `max_benchmark_mb` is dealt by hash into parts of about that size, each part has a pass of its own, and the passes hand
on the hits so far in a written table.

Defined results: a null or empty text has no words. Items without words or of null text have no windows. Items
of null id mark words but are not listed. Repeated items count once. Empty tables give no rows or no hits.
Words of any length and texts of any length are taken whole. Other columns are kept as they are, unless
they have the name of a result column; those are replaced.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import product, repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.columns import freed
from fieldloom.llm.common import LOWER, UPPER, fresh, stored, tidy

#: bytes.translate table: A-Z to a-z; ASCII other than letters and digits to a blank; UTF-8 bytes from 0x80 on stay.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b) in LOWER + "0123456789" else ord(chr(b).lower()) if chr(b) in UPPER else 0x20 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # in the original text, before A-Z are lower-cased
#: The base of the words' numbers: successors of a state are searched one by one, so they are to be few.
DIGITS = 64
OUT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def windows_of(words: list[bytes], size: int) -> Iterator[tuple[bytes, ...]]:
    for at in range(max(1, len(words) - size + 1) if words else 0):
        yield tuple(words[at : at + size])


class Matcher:
    """The automaton of some windows; made from {window: item ids}.

    Each word has a number, written in digits of base DIGITS, as many for every word. The digits of each place are letters of their own,
    so that an occurrence begins and ends with a word, and no state has more than DIGITS successors however many words there are.
    """

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]]):
        vocabulary = sorted({w for window in windows for w in window})
        self.width = 1
        while DIGITS**self.width < len(vocabulary):
            self.width += 1
        letters = [[chr(1 + place * DIGITS + digit) for digit in range(DIGITS)] for place in range(self.width)]
        codes = map("".join, product(*letters))
        self.code = dict(zip(vocabulary, codes, strict=False))
        self.automaton = ahocorasick.Automaton()
        for window, items in windows.items():
            self.automaton.add_word("".join([self.code[w] for w in window]), (len(window), sorted(items)))
        self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges (end exclusive, merged, in order) inside occurrences, and the items that occur."""
        code, width, other = self.code, self.width, "\0" * self.width
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        for end, (size, ids) in self.automaton.iter("".join([code.get(w, other) for w in words])):
            stop = end // width + 1
            start = stop - size
            while ranges and ranges[-1][1] >= start:
                start = min(start, ranges.pop()[0])
            ranges.append((start, stop))
            items.update(ids)
        return ranges, items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks_of(items: list[tuple[str | None, str | None]], size: int, max_window_words: int) -> list[dict]:
    """{window: item ids} in blocks within the bound; a window is in one block only."""
    windows: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, text in items:
        for window in windows_of(words_of(text), size):
            windows[window].update([] if item is None else [item])
    blocks, room = [], 0
    for window, ids in windows.items():
        if room < len(window):
            blocks.append({})
            room = max_window_words
        blocks[-1][window] = ids
        room -= len(window)
    return blocks


@tidy
def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 10, max_window_words: int = 2_000_000, max_benchmark_mb: int = 256) -> DataFrame:
    """docs with n_words, n_hit, item_ids (those with windows that occur) and hit_spans (offsets in the text).

    The benchmark is the stated query set; its size is checked before it is sent to the executors as text, in parts if need be.
    """
    bench = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text).alias("t")).distinct()
    mb = (bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0) / 1e6
    parts = max(1, math.ceil(mb / max_benchmark_mb))
    if parts > 1:
        bench = stored(bench, "benchmark")
    docs = docs.drop(*OUT.names)
    held = fresh(docs.columns, "__ranges", "__items")
    for part in range(parts):
        own = bench if parts == 1 else bench.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part)
        docs = _pass(docs, own, text_col, size, max_window_words, held, first=part == 0, last=part == parts - 1)
        if part < parts - 1:
            docs = stored(docs, "hits")
    return docs


def _pass(docs: DataFrame, bench: DataFrame, text_col: str, size: int, max_window_words: int, held: list[str], first: bool, last: bool) -> DataFrame:
    """One part of the benchmark against all rows; the hits of the parts before come as columns and go on so, or as the result."""
    sent = docs.sparkSession.sparkContext.broadcast([(r.i, r.t) for r in bench.collect()])
    at = docs.columns.index(text_col)
    kept = docs.schema.fields if first else docs.schema.fields[:-2]
    more, kinds = (OUT.fields, KINDS) if last else ([T.StructField(n, t) for n, t in zip(held, HELD, strict=True)], HELD_KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freed()
        matchers = [Matcher(b) for b in blocks_of(sent.value, size, max_window_words)]
        for batch in batches:
            texts = (x.as_py() for x in batch.column(at))
            before = repeat(([], [])) if first else zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist(), strict=True)
            rows = [hits(text, matchers, ranges, items, last) for text, (ranges, items) in zip(texts, before, strict=False)]
            new = [pa.array([r[k] for r in rows], type=kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *new], names=[f.name for f in [*kept, *more]])

    return docs.mapInArrow(run, T.StructType([*kept, *more]))


#: The hits that one pass hands to the next: word ranges and items.
HELD = [T.ArrayType(T.ArrayType(T.LongType())), T.ArrayType(T.StringType())]
HELD_KINDS = [pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())]
KINDS = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]


def hits(text: str | None, matchers: list[Matcher], ranges: list, items: list[str], last: bool) -> tuple:
    """A row's hits, with those of earlier passes; as OUT has them, or as HELD has them."""
    words = words_of(text)
    found, named, scans = [(a, b) for a, b in ranges], set(items), int(bool(ranges))
    for m in matchers:
        here, ids = m.scan(words)
        found += here
        named |= ids
        scans += bool(here)
    joined = merged(found) if scans > 1 else found
    if not last:
        return joined, sorted(named)
    at = [(m.start(), m.end()) for m in WORD.finditer(text)] if joined else []
    return len(words), sum(b - a for a, b in joined), sorted(named), [{"start": at[a][0], "end": at[b - 1][1]} for a, b in joined]


@tidy
def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without those in which a window of an item occurs; their columns as they were."""
    # columns that have the name of a result column wait under another
    others = [c for c in docs.columns if c.lower() in OUT.names]
    names = fresh([*docs.columns, *OUT.names], *[f"kept_{c}" for c in others])
    held = docs.withColumnsRenamed(dict(zip(others, names, strict=True)))
    kept = mark(held, benchmark, **how).filter("n_hit = 0").drop(*OUT.names)
    return kept.withColumnsRenamed(dict(zip(names, others, strict=True))).select(*docs.columns)
