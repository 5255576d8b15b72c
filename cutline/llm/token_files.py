"""Token ids in block files: one zstandard frame per document, one shared dictionary.

A dataset is a folder with two Parquet tables:

* ``dictionary``: ``hash`` (SHA-256) and ``bytes`` of the shared dictionary, one row;
* ``blocks``: ``part``, ``block``, ``n_docs``, ``n_tokens``, ``first_id``, ``last_id``, ``payload``.

A payload is ``magic, dictionary hash, n`` followed by ``n`` entries each of key, key-is-set, start
(ids of the part before the document) and count of ids, ``n + 1`` frame offsets, and the frames.
A frame holds the document's ids as little-endian unsigned 32-bit numbers. One document is
read by its offset, without touching its neighbours.

Edge cases: NULL and empty texts hold only the end id; NULL keys come first; equal keys are
ordered by their text; an empty table gives an empty dataset; too few samples for a dictionary
give an empty one, whose hash is stored all the same.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutline.llm.batches import bytes_list, column, offsets, slices
from cutline.session import scratch_dir

MAGIC = b"TOKBLK1\n"
HEADER = "<8s32sq"
BLOCK_BYTES = 4 << 20  # raw ids per block
DICTIONARY_BYTES = 64 << 10
SAMPLE_DOCS, SAMPLE_BYTES = 1000, 8 << 20  # bound of the dictionary's training sample
TABLE_CHUNKS = 500_000  # of each of the two tables that a worker holds
TOGETHER = 1000  # new stretches that are encoded as one text
# Bytes behind a blank before which the pretokenizer certainly cuts: visible ASCII, and lead bytes of
# characters among which there is no white space.
VISIBLE = np.zeros(256, bool)
VISIBLE[33:127] = VISIBLE[0xC3:0xE1] = VISIBLE[0xE4:] = True
LETTER, MARK, SEEN = np.zeros((3, 256), bool)  # ASCII letters, ASCII signs, both and digits
LETTER[65:91] = LETTER[97:123] = SEEN[33:127] = True
MARK[33:127] = ~LETTER[33:127]
MARK[48:58] = False
WIDTH = 4  # bytes of an id


class ChunkTable(dict):
    """Ids per distinct stretch between two certain cuts of a byte-level tokenizer.

    Every blank before a visible character opens a stretch, and so do a sign behind a letter and a letter
    behind a single line end (all ASCII): a word is the same stretch whatever stands behind it. Stretches are found in arrays of bytes, each
    distinct one is encoded once, and ids are put back by position. The table holds ids as bytes of 32-bit
    numbers, which are cut and joined without an array per stretch. A full table stays at hand as ``past``: stretches
    that come again move to the new one, so frequent ones are not encoded anew.
    """

    def __init__(self, path: str, limit: int = TABLE_CHUNKS):
        from tokenizers import Tokenizer

        super().__init__()
        self.limit, self.past = limit, {}
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        self.model = Tokenizer.from_file(path)
        added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        vocabulary = self.model.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a character stands for a byte
        self.bytes_of[list(vocabulary.values())] = list(map(len, vocabulary))

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        coded = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(c.ids, np.uint32) for c in coded]

    def _of(self, chunks: list[bytes]) -> list[bytes]:
        if len(self) > self.limit:
            self.past = dict(self)
            self.clear()
        new = [c for c in chunks if c not in self]
        if self.past:
            known = list(map(self.past.get, new))
            self.update((c, ids) for c, ids in zip(new, known) if ids is not None)
            new = [c for c, ids in zip(new, known) if ids is None]
        # Stretches that open with a blank and a visible character are cut apart wherever they stand
        # side by side, so many go to the library as one text; the bytes of each id tell where a stretch
        # ends. The first stretch of a text may open with a blank and more white space: it goes alone.
        spaced, first = [], []
        visible = VISIBLE.tolist()
        for c in new:
            (spaced if c[0] == 32 and len(c) > 1 and visible[c[1]] else first).append(c)
        groups = [spaced[k : k + TOGETHER] for k in range(0, len(spaced), TOGETHER)]
        for group, ids in zip(groups, self._plain([b"".join(g).decode() for g in groups])):
            ends = np.cumsum(self.bytes_of[ids])
            at = ((np.searchsorted(ends, np.cumsum(list(map(len, group)))) + 1) * WIDTH).tolist()
            raw = ids.tobytes()
            self.update(zip(group, [raw[a:b] for a, b in zip([0, *at[:-1]], at)]))
        self.update(zip(first, [ids.tobytes() for ids in self._plain([c.decode() for c in first])]))
        return [self[c] for c in chunks]

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text. Special strings cut first: such a text is left to the library as a whole."""
        whole = [bool(t and self.special and self.special.search(t)) for t in texts]
        raw = [t.encode() if t and not w else b"" for t, w in zip(texts, whole)]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = offsets(map(len, raw))
        if len(data):
            opens = data == 32
            opens[:-1] &= VISIBLE[data[1:]]
            opens[-1] = False
            letter = LETTER[data]
            opens[1:] |= MARK[data[1:]] & letter[:-1]
            opens[2:] |= letter[2:] & (data[1:-1] == 10) & SEEN[data[:-2]]
            opens[ends[:-1][np.diff(ends) > 0]] = True
            starts = np.flatnonzero(opens)
            runs = np.append(starts, len(data)).astype(np.int32)
            buffers = [None, pa.py_buffer(runs), pa.py_buffer(data)]
            chunks = pa.Array.from_buffers(pa.binary(), len(starts), buffers).dictionary_encode()
            found = self._of(bytes_list(chunks.dictionary))
            sizes = np.array(list(map(len, found)), np.int64) // WIDTH
            at = offsets(sizes)
            number = chunks.indices.to_numpy()
            places = offsets(sizes[number])
            flat = np.frombuffer(b"".join(found), np.uint32)
            take = np.arange(places[-1]) + np.repeat(at[number] - places[:-1], sizes[number])
            cuts = places[np.searchsorted(starts, ends)]
            flat = flat[take]
        else:
            flat, cuts = np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        out = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        for k in np.flatnonzero(whole).tolist():
            out[k] = self._plain([texts[k]])[0]
        return out


_TABLES: dict[str, ChunkTable] = {}


def table_of(path: str) -> ChunkTable:
    """This worker's table: the tasks that a Python worker runs share it, and its bound holds."""
    if path not in _TABLES:
        _TABLES[path] = ChunkTable(path)
    return _TABLES[path]


def _tokenizer(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return path


def train_dictionary(docs: DataFrame, key: str, text: str, end_id: int, path: str) -> DataFrame:
    """One row (hash, bytes): a dictionary from the ids of a fixed number of documents.

    The documents are those with the least key hashes. One task takes them, up to
    ``SAMPLE_BYTES`` of ids; the bound is what the dictionary format can use.
    """
    picked = docs.select(F.xxhash64(key).alias("__h")).distinct().orderBy("__h").limit(SAMPLE_DOCS)
    sample = docs.withColumn("__h", F.xxhash64(key)).join(F.broadcast(picked), "__h")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        table, samples, held = table_of(path), [], 0
        for batch in batches:
            for ids in table.ids(column(batch, text)):
                if held < SAMPLE_BYTES:
                    samples.append(np.append(ids, np.uint32(end_id)).astype("<u4").tobytes())
                    held += len(samples[-1])
        try:
            made = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except (zstandard.ZstdError, ValueError):
            made = b""
        digest = hashlib.sha256(made).digest()
        yield pa.RecordBatch.from_pydict({"hash": [digest], "bytes": [made]})

    return (
        sample.select(text, "__h").repartition(1).sortWithinPartitions("__h", text).select(text)
        .mapInArrow(train, "hash binary, bytes binary")
    )


def _dictionary(spark: SparkSession, path: str) -> tuple[bytes, bytes]:
    """Hash and bytes (64 KB at most) of a dataset's dictionary; an empty dataset has none."""
    rows = spark.read.parquet(f"{path}/dictionary").collect()
    made = bytes(rows[0]["bytes"]) if rows else b""
    return hashlib.sha256(made).digest(), made


def write_dataset(
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
    tokenizer_path: str | None = None,
) -> None:
    """Writes the ids of every document, in ascending key order, end id last."""
    spark, tokenizer = docs.sparkSession, _tokenizer(tokenizer_path)
    docs = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    train_dictionary(docs, "__key", "__text", end_id, tokenizer).write.parquet(f"{path}/dictionary")
    digest, dictionary = _dictionary(spark, path)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        table = table_of(tokenizer)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=3, dict_data=shared, write_dict_id=False)
        part, number, before = TaskContext.get().partitionId(), 0, 0
        rows: list[tuple] = []

        def close() -> pa.RecordBatch:
            keys = [r[0] for r in rows]
            index = np.array(
                [(k or 0, k is not None, s, n) for k, s, n, _ in rows], np.int64
            ).T.astype("<i8")
            ends = np.concatenate([[0], np.cumsum([len(f) for *_, f in rows])]).astype("<i8")
            head = struct.pack(HEADER, MAGIC, digest, len(rows))
            payload = b"".join([head, index.tobytes(), ends.tobytes(), *[f for *_, f in rows]])
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "block": pa.array([number], pa.int32()),
                    "n_docs": pa.array([len(rows)], pa.int64()),
                    "n_tokens": pa.array([sum(r[2] for r in rows)], pa.int64()),
                    "first_id": pa.array([keys[0]], pa.int64()),
                    "last_id": pa.array([keys[-1]], pa.int64()),
                    "payload": pa.array([payload], pa.binary()),
                }
            )

        held = 0
        for batch in batches:
            keys = column(batch, "__key")
            for first, texts in slices(batch, "__text"):
                for k, ids in zip(keys[first : first + len(texts)], table.ids(texts)):
                    raw = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                    rows.append((k, before, len(ids) + 1, press.compress(raw)))
                    before += len(ids) + 1
                    held += len(raw)
                    if held >= BLOCK_BYTES:
                        yield close()
                        rows, held, number = [], 0, number + 1
        if rows:
            yield close()

    (
        docs.repartitionByRange(F.col("__key").asc_nulls_first())
        .sortWithinPartitions(F.col("__key").asc_nulls_first(), F.xxhash64("__text"))
        .mapInArrow(
            blocks,
            "part int, block int, n_docs long, n_tokens long, first_id long, last_id long, "
            "payload binary",
        )
        .write.parquet(f"{path}/blocks")
    )


class Block:
    """Random access to the documents of one payload."""

    def __init__(self, payload: bytes, digest: bytes, dictionary: bytes):
        import zstandard

        magic, used, n = struct.unpack_from(HEADER, payload)
        if magic != MAGIC:
            raise ValueError("not a token block")
        if used != digest:
            raise ValueError("the block was written with another dictionary")
        at = struct.calcsize(HEADER)
        index = np.frombuffer(payload, "<i8", 4 * n, at).reshape(4, n)
        self.keys, self.has_key, self.starts, self.counts = index
        self.ends = np.frombuffer(payload, "<i8", n + 1, at + 32 * n)
        self._payload, self._at = payload, at + 32 * n + 8 * (n + 1)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self._unpress = zstandard.ZstdDecompressor(dict_data=shared)

    def __len__(self) -> int:
        return len(self.keys)

    def raw(self, k: int) -> bytes:
        frame = self._payload[self._at + self.ends[k] : self._at + self.ends[k + 1]]
        return self._unpress.decompress(frame)


def read_dataset(spark: SparkSession, path: str, keys: list[int] | None = None) -> DataFrame:
    """Documents of a dataset: doc_id, start, n_tokens and ``ids_le``, the ids as bytes.

    With ``keys`` only blocks whose key range holds one of them are read, and only the
    frames of those documents are decompressed.
    """
    digest, dictionary = _dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("__n"))  # a row per written file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    wanted = None if keys is None else {*keys}
    if keys is not None:
        hit = F.lit(False)
        for k in keys:
            hit |= F.lit(k).between(F.col("first_id"), F.col("last_id"))
        blocks = blocks.filter(hit)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, payload in zip(column(batch, "part"), column(batch, "payload")):
                block = Block(payload, digest, dictionary)
                ids = [int(k) if s else None for k, s in zip(block.keys, block.has_key)]
                at = [k for k, i in enumerate(ids) if wanted is None or i in wanted]
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([part] * len(at), pa.int32()),
                        "doc_id": pa.array([ids[k] for k in at], pa.int64()),
                        "__start": pa.array(block.starts[at], pa.int64()),
                        "n_tokens": pa.array(block.counts[at], pa.int64()),
                        "ids_le": pa.array([block.raw(k) for k in at], pa.binary()),
                    }
                )

    rows = blocks.select("part", "payload").mapInArrow(
        unpack, "part int, doc_id long, __start long, n_tokens long, ids_le binary"
    )
    return rows.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("__base") + F.col("__start")).alias("start"), "n_tokens", "ids_le"
    )


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    """Writes all documents, reads them back, and returns the place and checksum of each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = scratch_dir(spark, "tokens")
    write_dataset(docs, path)
    return read_dataset(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids_le").alias("ids_crc32")
    )
