"""Packing by concatenating and cutting: global offsets from two passes of prefix sums.

Pass one encodes every document once and writes, per task, its documents with their offsets inside the task
(one running sum per task). The tasks' token totals, one row each, are summed up to each task's base. Pass two
adds the base to the offsets, which numbers all tokens of the corpus, and cuts them at multiples of the
sequence length; a document that crosses a boundary gives a record on each side. No text or token is shuffled.
The order of the corpus is that of the written pass-one table, which does not change when a task is run again.

Encoding is exact, but each distinct piece between blanks is encoded once per worker while it stays in a bounded cache: neither the
tokenizer's normal form nor its pre-tokens nor its special tokens reach over white space, so a text's ids are those of its pieces, one
after the other. Strings of special tokens in a text become those tokens, as the tokenizer does without any flag.

Defined results: a null or empty text is a document of the end token only. Repeated rows and null ids are packed
as documents of their own. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.columns import TwoGenerations, freed, groups, numbers
from fieldloom.llm.common import stored, tidy

#: The bases are broadcast up to so many tasks of pass one (16 bytes each), and joined by a shuffle beyond.
MOST_TASKS = 1_000_000
#: Texts of these characters only are cut, lower-cased and composed alike by Python and the tokenizer's library.
PLAIN = re.compile("[\t-\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]*")
#: Blank to Python, but not to the tokenizer; a text that has one is encoded whole.
ODD_BLANKS = "[\x1c-\x1f]"
#: The tokenizer's pre-tokens in lower-case plain text: clitics, letters, single digits, runs of anything else; and the blank.
PRE_TOKEN = re.compile(r" |'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
WORD_END = "</w>"


def byte_letters() -> str:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in prints else chr(next(spare)) for b in range(256))


LETTERS = byte_letters()


class WordEncoder:
    """ids of texts as little-endian unsigned 32-bit bytes, by a byte-level tokenizer with word ends.

    Texts are cut at blanks and the pieces are looked up in a bounded cache. New plain pieces are lower-cased and cut into
    pre-tokens here, which have a cache of their own; new pre-tokens go through the tokenizer's merges together, one call for many, and
    the ids are told apart by the word ends. Any other new piece goes through the whole tokenizer. The ids are those of encoding
    each text whole.
    """

    def __init__(self, path: str, cache_pieces: int = 200_000, cache_parts: int = 200_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.merges = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # a special token's string in a text is that token, as in the plain call; pieces that hold one are encoded whole
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special) or r"(?!)")
        self.merges.normalizer, self.merges.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.pieces, self.parts = TwoGenerations(cache_pieces), TwoGenerations(cache_parts)

    def encode_whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _merged(self, parts: list[str]) -> list[bytes]:
        """ids of pre-tokens."""
        line = " ".join([p if p.isascii() else "".join([LETTERS[b] for b in p.encode()]) for p in parts])
        ids = np.array(self.merges.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(cuts) != len(parts):
            raise ValueError("the tokenizer's words have no ends")
        data, cuts = ids.tobytes(), cuts.tolist()
        return [data[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def learn(self, new: list[str]) -> None:
        """Adds the ids of pieces to the cache."""
        known = self.pieces.young
        plain = [p for p in new if (p.isprintable() if p.isascii() else PLAIN.fullmatch(p)) and not self.special.search(p)]
        if len(plain) < len(new):
            known.update((p, self.encode_whole(p)) for p in set(new).difference(plain))
        if not plain:
            return
        # all pieces are cut in one call; a blank, which no piece has, ends each
        parts = PRE_TOKEN.findall(" ".join(plain).lower() + " ")
        unknown = self.parts.missing(set(parts).difference(" "))
        for at in range(0, len(unknown), 4096):
            self.parts.young.update(zip(unknown[at : at + 4096], self._merged(unknown[at : at + 4096]), strict=True))
        find = self.parts.young
        find[" "] = b""
        ids = list(map(find.__getitem__, parts))
        at = np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))
        ends = at[np.fromiter(map(" ".__eq__, parts), dtype=bool, count=len(parts))].tolist()
        data = b"".join(ids)
        known.update(zip(plain, [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def _plain(self, texts: pa.StringArray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, the end token after each, and where each text ends; texts have no odd blanks."""
        ids, ends = numbers(texts, self.pieces, self.learn, "<u4")
        return np.insert(ids, ends, end), ends + np.arange(1, len(ends) + 1)

    def encode_column(self, texts: pa.StringArray, end: int, at_once: int = 1 << 22) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """In groups of about `at_once` bytes: how many texts, their ids, the end token after each, and where each ends."""
        for group in groups(texts, at_once):
            for odd, run in self._runs(group):
                yield len(run), *(self._whole(run, end) if odd else self._plain(run, end))

    @staticmethod
    def _runs(texts: pa.StringArray) -> Iterator[tuple[bool, pa.StringArray]]:
        """Stretches of texts with and without odd blanks."""
        odd = pc.match_substring_regex(texts, ODD_BLANKS).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(odd[1:] != odd[:-1]) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield bool(odd[a]), texts.slice(a, b - a)

    def _whole(self, texts: pa.StringArray, end: int) -> tuple[np.ndarray, np.ndarray]:
        each = [np.frombuffer(self.encode_whole(t), dtype="<u4") for t in texts.to_pylist()]
        return np.concatenate([x for ids in each for x in (ids, np.array([end], dtype="<u4"))]), np.cumsum([len(ids) + 1 for ids in each])

    def encode(self, text: str) -> bytes:
        ((_, ids, _),) = self.encode_column(pa.array([text]), 0)
        return ids[:-1].astype("<u4").tobytes()


def tokens(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pass one: (doc_id, part, local_start, n, ids) per document, written to the shared folder."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freed()
        enc, part, at = WordEncoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            row = 0
            for size, ids, ends in enc.encode_column(batch.column(0).fill_null(""), end_id):
                n = np.diff(ends, prepend=0)
                packed = pa.Array.from_buffers(pa.large_binary(), size, [None, pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(row, size), pa.array(np.full(size, part)), pa.array(at + ends - n), pa.array(n), packed.cast(pa.binary())], names=["doc_id", "part", "local_start", "n", "ids"])
                at, row = at + int(ends[-1]), row + size

    kind = docs.schema[id_col].dataType.simpleString()
    return stored(rows.mapInArrow(run, f"doc_id {kind}, part bigint, local_start bigint, n bigint, ids binary"), "tokens")


@tidy
def pieces(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (bytes, little-endian unsigned 32-bit), ids_crc32.

    Pass two is arithmetic on columns.
    """
    coded = tokens(docs, tokenizer, end_id, id_col, text_col)
    totals = coded.groupBy("part").agg(F.sum("n").alias("total"))
    # one row per task of pass one
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    small = totals.count() <= MOST_TASKS
    placed = coded.join(F.broadcast(bases) if small else bases, "part").select("doc_id", "n", "ids", (F.col("base") + F.col("local_start")).alias("at"))
    whole = lambda c: F.floor(c / length)
    cut = placed.select("*", F.explode(F.sequence(whole(F.col("at")), whole(F.col("at") + F.col("n") - 1))).alias("sequence_id"))
    cut = cut.withColumn("start", F.greatest(F.col("sequence_id") * length - F.col("at"), F.lit(0)))
    cut = cut.withColumn("length", F.least((F.col("sequence_id") + 1) * length - F.col("at"), F.col("n")) - F.col("start"))
    own = F.expr("substring(ids, int(start * 4 + 1), int(length * 4))")
    cut = cut.select("doc_id", "start", "length", F.col("n").alias("doc_tokens"), "sequence_id", (F.col("at") + F.col("start") - F.col("sequence_id") * length).alias("offset"), own.alias("ids"))
    return cut.withColumn("ids_crc32", F.crc32("ids"))
