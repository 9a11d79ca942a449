"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, with the place of each turn's text; the rendering is encoded once, with
offsets; the sorted token spans and the sorted spans of the turns to learn are intersected by binary search.
The mask holds for tokens (`loss_mask`), and for characters (`loss_spans`) where a token reaches over a turn's edge.

Template: `<s>`, then turn after turn: `[INST] text [/INST]` for user, ` text </s>` for assistant, and
`[ROLE=name] text [/ROLE]` for any other role, its name in percent-encoding. Each control string inside a text
gets a backslash before it, in front of those that it has already; reading back takes one away. A control string
of the template always follows a blank or a bracket, so none can be mistaken for the other.

Conversations are read in order from sorted partitions; memory holds one conversation, or several short ones of about a
million characters together.

Encoding is exact, but the tokens and offsets of each distinct pre-token are found once per worker while they stay in a bounded
cache: those of a rendering are those of its pre-tokens, one after the other.

Defined results: a null text is empty. A null role is read back as the empty role. Rows of one conversation come in
order of turn, then role, then text; null turns come first; repeated rows are turns of their own. A row of null
conversation id is a conversation of its own, so that no task gets all of them. Ids may be integers or strings; others are refused.
Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count, groupby
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import text_of
from fieldloom.llm.packing import PLAIN

CONTROL = re.compile(r"(\\*)(<s>|</s>|\[/?INST\]|\[ROLE=[^\]\s]*\]|\[/ROLE\])")
ESCAPED = re.compile(r"\\(\\*)(<s>|</s>|\[/?INST\]|\[ROLE=[^\]\s]*\]|\[/ROLE\])")
START = "<s>"


def escape(text: str) -> str:
    return CONTROL.sub(r"\\\1\2", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2", text) if "\\" in text else text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the turns' escaped texts."""
    out, at, spans = [START], len(START), []
    for role, text in turns:
        before, after = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")}.get(role, (f"[ROLE={quote(role, safe='')}] ", " [/ROLE]"))
        body = escape(text)
        spans.append((at + len(before), at + len(before) + len(body)))
        out += [before, body, after]
        at = spans[-1][1] + len(after)
    return "".join(out), spans


#: Ends of a turn: a blank and the control string that is not escaped.
ENDS = {"[INST] ": re.compile(r" \[/INST\]"), " ": re.compile(r" </s>"), "[ROLE": re.compile(r" \[/ROLE\]")}


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    at, turns = len(START), []
    while at < len(text):
        kind = next(k for k in ENDS if text.startswith(k, at))
        if kind == "[ROLE":
            close = text.index("] ", at)
            role, body = unquote(text[at + 6 : close]), close + 2
        else:
            role, body = ("user" if kind == "[INST] " else "assistant"), at + len(kind)
        # A text may end in a blank of its own; an end is a blank and a control string, and one inside a text has a backslash between.
        end = ENDS[kind].search(text, body)
        turns.append((role, unescape(text[body : end.start()])))
        at = end.end()
    return turns


class Encoder:
    """Byte-level tokenizer with offsets that cover every character: ids and, per token, how many characters it adds.

    Parts of one character share it, so the first takes it and the others add none.
    """

    def __init__(self, path: str, cache_parts: int = 300_000):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer, pre_tokenizers, processors

        self.tokenizer, self.apart = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.tokenizer, self.apart):
            t.encode_special_tokens = True
            t.post_processor = processors.ByteLevel(trim_offsets=False)
        # takes pre-tokens that are already cut, a zero character between them
        self.apart.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\0", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        self.ids: dict[str, bytes] = {}
        self.lengths: dict[str, bytes] = {}
        self.limit = cache_parts

    def encoded(self, tokenizer, text: str) -> tuple[np.ndarray, np.ndarray]:
        """ids and ends of a text."""
        e = tokenizer.encode(text, add_special_tokens=False)
        return np.array(e.ids, dtype=np.int32), np.maximum.accumulate(np.array([b for _, b in e.offsets], dtype=np.int64))

    def learn(self, parts: list[str]) -> None:
        """One call for many pre-tokens; places tell whose a token is."""
        ids, ends = self.encoded(self.apart, "\0".join(parts))
        stops = np.cumsum([len(p) + 1 for p in parts]) - 1
        cuts = np.searchsorted(ends, stops, side="right")
        lengths = np.diff(ends, prepend=0)
        lengths[cuts[:-1]] -= 1  # the zero character before a pre-token
        raw, size, start = (ids.tobytes(), lengths.astype(np.int32).tobytes()), ids.itemsize, 0
        for part, end in zip(parts, (cuts * size).tolist(), strict=True):
            self.ids[part], self.lengths[part] = raw[0][start:end], raw[1][start:end]
            start = end

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and the tokens' starts and ends."""
        if PLAIN.fullmatch(text):
            parts = self.cut(text)
            if new := set(parts).difference(self.ids):
                if len(self.ids) + len(new) > self.limit:
                    self.ids.clear(), self.lengths.clear()
                    new = set(parts)
                ordered = list(new)
                for at in range(0, len(ordered), 4096):
                    self.learn(ordered[at : at + 4096])
            ids = np.frombuffer(b"".join(map(self.ids.__getitem__, parts)), dtype=np.int32)
            ends = np.cumsum(np.frombuffer(b"".join(map(self.lengths.__getitem__, parts)), dtype=np.int32), dtype=np.int64)
        else:
            ids, ends = self.encoded(self.tokenizer, text)
        return ids, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends


def masked(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The token mask, and per span the characters of it that masked tokens cover."""
    mask, chars = np.zeros(len(ends), dtype=np.int8), []
    for a, b in spans:
        lo, hi = int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(starts, b, side="left"))
        if a < b and lo < hi:
            mask[lo:hi] = 1
            chars.append((max(a, int(starts[lo])), min(b, int(ends[hi - 1]))))
    return mask, chars


def format_chats(conversations: DataFrame, tokenizer: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, input_ids, loss_mask (0/1 per token), loss_spans."""
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), text_of(text_col).alias("text"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    if kind not in KINDS:
        raise TypeError(f"conversation ids are of type {kind}, not one of {', '.join(KINDS)}")
    # rows without an id are dealt by what they say; their order inside a task is no matter
    lone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    ordered = rows.withColumn("lone", lone).repartition("conv_id", "lone").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        each = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True))
        rows, chars = [], 0
        for (conv, _), own in groupby(each, key=lambda r, n=count(): (r[0], next(n) if r[0] is None else 0)):
            turns = [(role, text) for _, role, text in own]
            text, spans = render(turns)
            ids, starts, ends = encode(text)
            mask, learnt = masked(starts, ends, [s for s, (role, _) in zip(spans, turns, strict=True) if role == learn])
            rows.append((conv, len(turns), text, ids, mask, learnt))
            chars += len(text)
            if chars > BATCH_CHARS:
                yield batch_of(rows, KINDS[kind])
                rows, chars = [], 0
        if rows:
            yield batch_of(rows, KINDS[kind])

    return ordered.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, n_turns bigint, formatted string, input_ids array<int>, loss_mask array<tinyint>, loss_spans array<struct<start: bigint, end: bigint>>")


#: Types that ids may have.
KINDS = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}
BATCH_CHARS = 1 << 20
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def batch_of(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    conv, turns, texts, ids, masks, spans = zip(*rows, strict=True)
    at = pa.array(np.cumsum([0, *map(len, ids)]), type=pa.int32())
    nested = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], type=pa.list_(SPAN))
    flat = lambda parts, t: pa.ListArray.from_arrays(at, pa.array(np.concatenate(parts), type=t))
    columns = [pa.array(conv, type=kind), pa.array(turns, type=pa.int64()), pa.array(texts, type=pa.string()), flat(ids, pa.int32()), flat(masks, pa.int8()), nested]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", "n_turns", "formatted", "input_ids", "loss_mask", "loss_spans"])


def read_chats(formatted: DataFrame) -> DataFrame:
    """What the output says: conv_id, turns (role, text), loss_text (unescaped), formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, loss, chars = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns.append([{"role": r, "text": t} for r, t in parse(text)])
                loss.append("".join(unescape(text[s["start"] : s["end"]]) for s in spans))
                chars.append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(turns, type=pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), pa.array(loss, type=pa.string()), pa.array(chars, type=pa.int64())], names=["conv_id", "turns", "loss_text", "formatted_chars"])

    sql = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, f"conv_id {sql}, turns array<struct<role: string, text: string>>, loss_text string, formatted_chars bigint")
