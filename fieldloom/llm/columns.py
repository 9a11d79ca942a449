"""Texts of an Arrow column cut into pieces between blanks, so that each distinct piece of a group is worked on once."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class TwoGenerations:
    """A bounded cache that forgets what has not been asked for lately: entries move to the young half when they are used."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def missing(self, keys: Iterable[str]) -> list[str]:
        """Makes room for the keys, and says which of them are new; the others are in `young` then."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, old, new = self.young, self.old, []
        for k in [k for k in keys if k not in young]:
            if k in old:
                young[k] = old[k]
            else:
                new.append(k)
        return new


def freed() -> None:
    """Workers serve many tasks and stages: what earlier ones have freed goes back to the system, from Arrow's pool and from the C library's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def groups(texts: pa.StringArray, at_once: int = 1 << 22) -> Iterator[pa.StringArray]:
    """Slices of about `at_once` bytes, one text at least. The collector of cycles rests while one is worked on: none are made."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + at_once, side="right")))
        collecting = gc.isenabled()
        gc.disable()
        try:
            yield texts.slice(start, stop - start)
        finally:
            if collecting:
                gc.enable()
        start = stop


def numbers(texts: pa.StringArray, cache: TwoGenerations, learn, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """What the cache has, as bytes of numbers of that kind, for all pieces of the texts one after the other; and where each text ends.

    learn(pieces) adds what the cache lacks.
    """
    words = pc.utf8_split_whitespace(texts)
    coded = words.flatten().dictionary_encode()
    pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    learn(cache.missing(pieces))
    found = pa.array(map(cache.young.__getitem__, pieces), type=pa.large_binary()).take(coded.indices)
    at, size = np.frombuffer(found.buffers()[1], dtype=np.int64, count=len(found) + 1), np.dtype(kind).itemsize
    values = np.frombuffer(found.buffers()[2] or b"", dtype=kind)[at[0] // size : at[-1] // size]
    return values, (at[words.offsets.to_numpy()[1:] - words.offsets[0].as_py()] - at[0]) // size
