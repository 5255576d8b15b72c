"""Arrow batches in tasks: added columns, words, and lines of whole texts.

Texts go to Python as bytes. ``bytes.split`` cuts at exactly space and \\x09-\\x0D, which is
the word rule of every operator here, and ``bytes.lower`` lowers exactly A-Z.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Distinct words that a task remembers before it starts its table anew (memory only).
TABLE_WORDS = 1_000_000


def add_columns(
    df: DataFrame,
    fields: list[T.StructField],
    start: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    drop: Iterable[str] = (),
) -> DataFrame:
    """``df`` with the columns that ``start()`` (called once per task) makes of each batch.

    A new column takes the place of an input column of the same name; ``drop`` names inputs
    that are not passed on.
    """
    new = [f.name for f in fields]
    keep = [f for f in df.schema.fields if f.name not in {*new, *drop}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for batch in batches:
            if batch.num_rows:
                old = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
                made = make(batch)
                yield pa.RecordBatch.from_arrays([*old, *made], [*[f.name for f in keep], *new])

    return df.mapInArrow(run, T.StructType([*keep, *fields]))


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def as_bytes(text: str) -> F.Column:
    """The text as bytes, NULL as no bytes."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers (a fixed public finaliser)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def split_words(texts: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
    """Words of many texts, one after the other, and how many each text has."""
    if not texts:
        return pa.array([], pa.binary()), np.zeros(0, np.int64)
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = SPACE[data]
    inside = ~space
    first, last = inside.copy(), inside.copy()
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    lengths = np.flatnonzero(last) - np.flatnonzero(first) + 1
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(data[inside])]
    words = pa.Array.from_buffers(pa.binary(), len(lengths), buffers)
    starts = offsets(len(t) + 1 for t in texts)[:-1]
    sizes = np.add.reduceat(first, starts, dtype=np.int64)
    return words, sizes


def buffers_of(words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all words, and where each starts (and the last ends)."""
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def bytes_list(words: pa.BinaryArray) -> list[bytes]:
    """The values of an array without NULLs, cut from its buffer: several times as fast as ``to_pylist``."""
    data, ends = buffers_of(words)
    raw, at = data.tobytes(), ends.tolist()
    return [raw[a:b] for a, b in zip(at[:-1], at[1:])]


def hash_runs(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of bytes; no run is empty.

    A sum of the bytes times fixed pseudo-random factors per place, scrambled.
    """
    sizes = np.diff(ends)
    if not len(sizes):
        return np.zeros(0, np.uint64)
    factors = mix(np.arange(1, sizes.max() + 1, dtype=np.uint64)) | np.uint64(1)
    parts = factors[np.arange(len(data)) - np.repeat(ends[:-1], sizes)]
    parts *= data + np.uint64(1)
    return mix(np.add.reduceat(parts, ends[:-1]) + sizes.astype(np.uint64) * MIX)


class WordTable(dict):
    """Numbers words as they come and keeps one row of facts per distinct word.

    ``facts(words)`` gets the new words of a batch and returns arrays, a row per word.
    """

    def __init__(self, facts: Callable[[list], list[np.ndarray]], limit: int = TABLE_WORDS):
        super().__init__()
        self._facts, self._limit = facts, limit
        self._columns: list[np.ndarray] = []

    def number(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of many texts, one after the other, and how many each text has."""
        words, sizes = split_words(texts)
        words = words.dictionary_encode()
        if len(self) > self._limit:
            self.clear()
            self._columns = []
        distinct = words.dictionary.to_pylist()
        used = len(self)
        numbers = np.array([self.setdefault(w, len(self)) for w in distinct], np.int64)
        if len(self) > used:
            new = [w for w, k in zip(distinct, numbers.tolist()) if k >= used]
            self._store([np.asarray(m) for m in self._facts(new)], used)
        return numbers[words.indices.to_numpy()] if distinct else numbers, sizes

    def _store(self, made: list[np.ndarray], used: int) -> None:
        end = len(self)
        if not self._columns or len(self._columns[0]) < end:
            grown = [np.zeros((max(1024, 2 * end), *m.shape[1:]), m.dtype) for m in made]
            for old, new in zip(self._columns, grown):
                new[:used] = old[:used]
            self._columns = grown
        for col, m in zip(self._columns, made):
            col[used:end] = m

    def fact(self, k: int) -> np.ndarray:
        return self._columns[k] if self._columns else np.zeros(1, np.int64)


def slices(batch: pa.RecordBatch, name: str, most: int = 4 << 20) -> Iterator[tuple[int, list]]:
    """The values of a bytes or string column in runs of about ``most`` bytes: (first row, values).

    Bounds the memory that arrays derived from the texts take; every row is in one run.
    """
    values = batch.column(batch.schema.get_field_index(name))
    start, held, run = 0, 0, []
    for k, v in enumerate(values):
        v = v.as_py()
        run.append(v)
        held += len(v) if v is not None else 0
        if held >= most:
            yield start, run
            start, held, run = k + 1, 0, []
    if run:
        yield start, run


def offsets(sizes: Iterable[int]) -> np.ndarray:
    """Starts of consecutive runs, and the end of the last."""
    sizes = sizes if isinstance(sizes, np.ndarray) else np.fromiter(sizes, np.int64)
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` neighbours in an array of 64-bit word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h *= MIX
        h += words[k : k + n]
    return mix(h)
