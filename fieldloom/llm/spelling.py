"""Spelling variants grouped by PartEnum signatures.

Two words are near if exactly one inserted, deleted or replaced code point tells them apart. A word's letter multiset is a
binary vector with a place for each (letter, how often so far); an edit changes at most two places, so near words are
at a Hamming distance of at most two.

Signatures. The places are dealt to `PARTS` parts, and a word has a signature for each way to leave out `EDITS` parts: the hash of the places
in the others. Two differing places lie in at most two parts, so for near words at least one choice leaves out all of them, and
they share that signature with certainty. Equal signatures are joined, pairs are verified by the edit distance, and each pair counts once.

In a large vocabulary of like words, signatures of letters alone are shared by thousands of words. So each signature is
asked together with one half of the word: an edit leaves the first half of the shorter word's length or the rest as it
is, at the beginning or at the end. A word gives its halves as the shorter word (of its own length) and as the longer one (of one less),
and near words agree in one of these. This too is exact; no bucket is capped.

Forms. A word's form is its near word of largest count, if that has at least `times` its own count; counts rise along forms, so
there are no circles, and roots come by doubling steps, in as many joins as the logarithm of the longest chain.

Defined results: null and empty texts have no runs. Repeated rows count again; a null id counts as the empty text. Runs and words of
any length are taken whole. Without words the result is empty. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import Steps, ascii_lower, text_of, tidy

# Fixed value: what a run is.
RUN = r"[A-Za-zÀ-ÿ]+"
PARTS, EDITS = 4, 2
# Letters by frequency, so that the parts get like shares; other code points go by their number.
FREQUENT = "etaoinsrhldcumfpgwybvkxjqz"
_RANK = {c: i for i, c in enumerate(FREQUENT)}
_KEPT = [[p for p in range(PARTS) if p not in left] for left in combinations(range(PARTS), EDITS)]
_SALT = np.array([xxhash.xxh64_intdigest(f"signature {i}") for i in range(len(_KEPT))], dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word): the runs of all texts, A-Z in lower case, one row per occurrence."""
    found = F.regexp_extract_all(text_of(text_col), F.lit(RUN), F.lit(0))
    return docs.select(F.col(id_col).alias("id"), F.explode(found).alias("word")).select("id", ascii_lower(F.col("word")).alias("word"))


def damaged(words: DataFrame, every: int = 199, least: int = 6) -> DataFrame:
    """Words in which some occurrences lost a code point: those where crc32 of '<id>:<word>' is divisible by `every` lose that at the crc's remainder by their length.

    What has fewer than `least` code points to begin with is passed over, as it stays below.
    """
    n = F.length("word")
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
    at = (h % n).cast("int")
    cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, n))
    return words.filter(n >= least).select(F.when(h % every == 0, cut).otherwise(F.col("word")).alias("word"))


def _halves(w: str) -> list[bytes]:
    """What one edit may leave as it is: of a word as the shorter one of two, and as the longer one."""
    out = []
    for shorter in (len(w), len(w) - 1):
        half = shorter // 2
        out += [f"{shorter}<{w[:half]}".encode(), f"{shorter}>{w[len(w) - shorter + half:]}".encode()]
    return out


class Signer:
    """Keys of words: signatures of the letter multiset, each with each half; hashes of places are kept."""

    def __init__(self, limit: int = 100_000):
        self.places, self.limit = {}, limit

    def parts(self, w: str) -> list[int]:
        """Per part the hash of the word's places in it."""
        if len(self.places) > self.limit:
            self.places.clear()
        seen: dict[str, int] = {}
        out, known = [0] * PARTS, self.places
        for c in w:
            n = seen[c] = seen.get(c, 0) + 1
            if (place := known.get((c, n))) is None:
                place = known[c, n] = ((_RANK.get(c, ord(c)) + n) % PARTS, xxhash.xxh64_intdigest(f"{c}{n}"))
            out[place[0]] ^= place[1]
        return out

    def __call__(self, words: list[str]) -> np.ndarray:
        """(word, key): for each word the halves as the shorter word with all signatures, then those as the longer one."""
        parts = np.array([self.parts(w) for w in words], dtype=np.uint64).reshape(-1, PARTS)
        halves = np.array([[xxhash.xxh64_intdigest(h) for h in _halves(w)] for w in words], dtype=np.uint64).reshape(-1, 4)
        signs = np.stack([np.bitwise_xor.reduce(parts[:, kept], axis=1) ^ salt for kept, salt in zip(_KEPT, _SALT, strict=True)], axis=1)
        keys = (signs * _MIX)[:, None, :] ^ halves[:, :, None]
        keys ^= keys >> np.uint64(31)
        return (keys * _MIX).reshape(len(words), -1).view(np.int64)


def _signed(words: DataFrame) -> DataFrame:
    """(key, longer, number, word, n): a row for each key of a word; longer: as the longer one of two."""
    names = ["key", "longer", "number", "word", "n"]
    each = 4 * len(_KEPT)
    longer = np.arange(each) >= each // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Signer()
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                keys = of(part.column("word").to_pylist())
                same = pa.array(np.repeat(np.arange(len(part)), each))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.tile(longer, len(part))), *(part.column(c).take(same) for c in ("number", "word", "n"))], names=names)

    return words.select("number", "word", "n").mapInArrow(run, "key bigint, longer boolean, number bigint, word string, n bigint")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_word, a_n, b, b_word, b_n) for near words a < b by number; words: (number, word, n), a written table."""
    keys = _signed(words)
    x, y = keys.alias("x"), keys.alias("y")
    once = (F.col("x.key") == F.col("y.key")) & (F.col("x.number") < F.col("y.number")) & ~(F.col("x.longer") & F.col("y.longer"))
    met = x.join(y.hint("merge"), once).filter(F.levenshtein("x.word", "y.word", 1) == 1)
    sides = [F.col(f"{s}.{c}").alias(f"{name}{suffix}") for s, name in (("x", "a"), ("y", "b")) for c, suffix in (("number", ""), ("word", "_word"), ("n", "_n"))]
    return met.select(*sides).distinct()


@tidy
def variants(found: DataFrame, least: int = 6, occurrences: int = 5, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words found (a row per occurrence) of at least `least` code points and `occurrences`; a written table."""
    steps = Steps(found.sparkSession)
    words = found.filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= occurrences)
    words = steps.stored(words.select(F.monotonically_increasing_id().alias("number"), "word", "n"), "words")
    pairs = near_pairs(words)
    side = lambda a, b: F.struct(F.col(a).alias("number"), F.struct((-F.col(f"{b}_n")).alias("less"), F.col(f"{b}_word").alias("word")).alias("other"))
    both = pairs.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("x")).select("x.*")
    near = both.groupBy("number").agg(F.count("*").alias("n_near"), F.min("other").alias("best"))
    big = (-F.col("best.less")) >= times * F.col("n")
    told = words.join(near.hint("merge"), "number", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(big, F.col("best.word")).alias("form"), F.when(big, -F.col("best.less")).alias("form_n")
    )
    told = steps.stored(told, "forms")
    roots = _roots(told.filter("form is not null").select("word", F.col("form").alias("root")), steps)
    out = told.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    out = steps.stored(out, "variants")
    steps.drop(*steps.tables[:-1])
    return out


def _roots(forms: DataFrame, steps: Steps) -> DataFrame:
    """(word, root) of (word, root): every step doubles how far a word has followed; a written table."""
    now = steps.stored(forms, "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = steps.stored(now.join(further.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        steps.drop(now)
        now = new
        if not now.filter("moved").limit(1).count():
            return now.select("word", "root")
