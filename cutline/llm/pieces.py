"""SentencePiece ids by a table of distinct marked words, and back to text.

No piece of the vocabulary has a whitespace marker behind another character, so no merge can
cross from a word into the next marker. A text is therefore cut before each run of markers;
each distinct marked word is segmented once per table and its ids are put back by position.
The constructor checks the vocabulary; a model without that property is refused.

Edge cases: NULL and empty texts have no ids and decode to the empty text; texts of blanks
only are one marked word; texts of any length are read whole; repeated rows stay; an empty
table stays empty; an input column named like an output column is replaced by it.
"""

from __future__ import annotations

import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutline.llm.batches import add_columns, offsets, slices

MARK = "▁"
MARKED = re.compile(f"({MARK}+)([^{MARK}]*)")
TABLE_CHUNKS = 500_000  # distinct marked words a task remembers (memory only)


class PieceTable(dict):
    """Ids per distinct marked word, as bytes of 32-bit numbers: they take least memory and are joined fastest.

    The key is the word behind all markers but the first.
    """

    def __init__(self, model: bytes, limit: int = TABLE_CHUNKS):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.limit = limit
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece crosses a whitespace marker: words cannot be cut apart")
        self.lone = np.array([self.model.piece_to_id(MARK)], np.int32).tobytes()

    @staticmethod
    def cut(text: str | None) -> list[str]:
        """Marked words of a text; without double blanks these are the words between blanks."""
        if not text:
            return []
        if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        marked = MARK + text.replace(" ", MARK)
        return [" " * (len(m) - 1) + w for m, w in MARKED.findall(marked)]

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self) > self.limit:
            self.clear()
        cuts = [self.cut(t) for t in texts]
        new = [w for w in {*chain.from_iterable(cuts)} if w not in self]
        for word, ids in zip(new, self.model.encode(new, num_threads=1) if new else []):
            self[word] = array("i", ids).tobytes()
        if "" in self:
            self[""] = self.lone  # a marker with nothing behind it
        get = self.__getitem__
        return [np.frombuffer(b"".join(map(get, c)), np.int32) for c in cuts]


def _model(path: str | None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as file:
        return file.read()


def encode(
    df: DataFrame, text: str = "text", ids: str = "ids", model_path: str | None = None
) -> DataFrame:
    """``df`` with the piece ids of each whole text, without begin or end ids.

    The model file is read by the driver and its bytes (a fixed size, below 1 MB for 32,000
    pieces) go to the tasks.
    """
    model = df.sparkSession.sparkContext.broadcast(_model(model_path))

    def start():
        table = PieceTable(model.value)

        def make(batch: pa.RecordBatch) -> list[pa.Array]:
            parts = []
            for _, texts in slices(batch, text):
                found = table.ids(texts)
                ends = offsets(map(len, found)).astype(np.int32)
                flat = np.concatenate(found) if found else np.zeros(0, np.int32)
                parts.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            return [pa.concat_arrays(parts)]

        return make

    return add_columns(df, [T.StructField(ids, T.ArrayType(T.IntegerType()))], start)


def decode(
    df: DataFrame, ids: str = "ids", text: str = "decoded", model_path: str | None = None
) -> DataFrame:
    """``df`` with the text that the library's ``decode`` gives for the ids (NULL: empty)."""
    model = df.sparkSession.sparkContext.broadcast(_model(model_path))

    def start():
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model.value)

        def make(batch: pa.RecordBatch) -> list[pa.Array]:
            lists = batch.column(batch.schema.get_field_index(ids))
            ends = offsets(pc.fill_null(pc.list_value_length(lists), 0).to_pylist()).tolist()
            flat = lists.flatten().to_numpy(zero_copy_only=False)  # leaves out what NULL lists hide
            return [pa.array([sp.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])], pa.string())]

        return make

    return add_columns(df, [T.StructField(text, T.StringType())], start)


def op4_pieces(spark, sf_dir: str) -> DataFrame:
    """Digest of ids and decoded text per document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = decode(encode(docs).drop("text"))
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
