"""Line deduplication by MinHash: one line stays of each group of similar lines.

Lines are lower-cased and their blanks run together; a line's set holds its stretches of eight bytes (a
shorter line is one stretch). Signatures of ``BANDS`` x ``ROWS`` minima cut into bands propose
candidates: at similarity 0.8 a pair shares no band once in 38,000 cases, at 0.85 once in
2,500,000. ``graph.linked`` turns bands into candidates without all pairs of a group, the exact
Jaccard similarity of the sets decides, and distributed union-find forms components. Of each
component the first line stays (by document, then place); all others are removed from their texts. Equal lines
(after lowering) share one signature row.

Edge cases: lines without a word are never removed; NULL texts stay NULL and empty ones empty; a text
of any length is read whole; ids may repeat or be NULL (NULL ids come last, then a digest of the
text decides; rows that agree in id and text are one document); empty tables stay empty; all columns are
passed on, but for those named n_lines and n_removed, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from cutline.llm.batches import MIX, column, mix, offsets, slices
from cutline.llm.graph import bit_table, has_bit, linked
from cutline.session import materialise

SIZE = 8  # bytes of a shingle: it fills one 64-bit number, so sets are exact
BANDS, ROWS = 20, 4
PART = (4, 5)  # the least similarity
AGREE = 45  # equal minima of 80 that make a pair plausible
BLOCK = 1 << 20  # shingles of lines of like length that are laid side by side
STRIP = 1 << 15  # of them hashed at a time, so that they stay in cache
NARROW = 64  # fewer lines than this are laid one after the other
BUCKETS = 1 << 12  # of band keys: a bucket is what a task holds at once
RECORD = np.dtype([("key", "<u4"), ("node", "<i8")])  # a band key in its bucket and the line that has it
SHORT = [f"s{k}" for k in range(BANDS * ROWS // 8)]


def plain_lines(text: str | None) -> list[bytes]:
    """Every line of a text, lower-cased, its blanks run together; those without a word are empty."""
    return [b" ".join(x.split()) for x in text.lower().encode("utf-8", "replace").split(b"\n")] if text else []


def padded(line: bytes) -> bytes:
    return line if len(line) >= SIZE else line + b"\n" * (SIZE - len(line))


def shingles(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each line, one line after the other, and where each line starts."""
    if not lines:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    lines = [padded(x) for x in lines]
    joined = b"".join(lines)
    ends = offsets(map(len, lines))
    # Eight bytes from every place on, read as one number.
    code = np.ndarray(len(joined) - SIZE + 1, ">u8", joined, strides=(1,)).astype(np.uint64)
    inside = np.ones(len(joined), bool)
    for k in range(1, SIZE):
        inside[ends[1:] - k] = False
    return code[inside[: len(code)]], ends - np.arange(len(ends)) * (SIZE - 1)


def shingle_set(line: bytes) -> frozenset[bytes]:
    line = padded(line)
    return frozenset([line[k : k + SIZE] for k in range(len(line) - SIZE + 1)])


FACTORS = (mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)


def _minima(part: np.ndarray) -> np.ndarray:
    """The least value of each hash function in each column."""
    n, wide = part.shape
    least = np.full((len(FACTORS), wide), np.iinfo(np.uint32).max, np.uint32)
    if wide < NARROW:
        part = np.ascontiguousarray(part.T)
        axis, strips = 1, [part[:, k : k + STRIP] for k in range(0, n, STRIP)]
    else:
        rows = max(1, STRIP // wide)
        axis, strips = 0, [part[k : k + rows] for k in range(0, n, rows)]
    for strip in strips:
        hashed = np.empty(strip.shape, np.uint32)
        for k in range(len(FACTORS)):
            np.multiply(strip, FACTORS[k], out=hashed)
            np.minimum(least[k], hashed.min(axis=axis), out=least[k])
    return least


def minima(lines: list[bytes]) -> np.ndarray:
    """The least value of each hash function (a row) in each line."""
    code, starts = shingles(lines)
    # The hash functions are products with odd factors: of scrambled numbers, each another order.
    low = mix(code).astype(np.uint32)
    sizes = np.diff(starts)
    order, first = np.argsort(sizes, kind="stable"), 0
    ordered = sizes[order]
    least = np.empty((len(FACTORS), len(lines)), np.uint32)
    while first < len(lines):
        # Lines of like length side by side; a shorter one repeats its last shingle.
        alike = int(np.searchsorted(ordered, ordered[first] * 9 // 8 + 8, "right"))
        some = order[first : min(alike, first + max(1, BLOCK // int(ordered[first])))]
        first += len(some)
        at = np.minimum(np.arange(sizes[some[-1]])[:, None], sizes[some] - 1) + starts[some]
        least[:, some] = _minima(low[at])
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """Per line the keys of its bands."""
    keys = np.empty((least.shape[1], BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(keys), band + 1, np.uint64)
        for row in least[band * ROWS : band * ROWS + ROWS]:
            key = mix(key * MIX + row)
        keys[:, band] = key
    return keys.view(np.int64)


def signatures(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per line its band keys, and a byte of each minimum, eight to a number."""
    least = minima(lines)
    short = np.ascontiguousarray((mix(least) & np.uint64(255)).astype(np.uint8).T)
    return band_keys(least), short.view(np.int64)


def _same_bytes(a: F.Column, b: F.Column) -> F.Column:
    """How many of the eight bytes of two numbers agree."""
    x = a.bitwiseXOR(b)
    for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
        x = x.bitwiseOR(F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(mask)))
    return F.lit(8) - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))


def _plausible(x, y) -> F.Column:
    """Enough equal minima: a pair of similarity 0.8 fails this once in 2,500,000 cases."""
    return sum((_same_bytes(x(c), y(c)) for c in SHORT[1:]), _same_bytes(x(SHORT[0]), y(SHORT[0]))) >= AGREE


def _digests(lines: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxh3_128_digest, lines)), "<i8").reshape(-1, 2)


def _doc(doc: str, text: str) -> list[F.Column]:
    """What names a document: its id and a digest of its text."""
    return [F.col(doc).alias("doc"), F.xxhash64(text).alias("digest")]


def occurrences(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """A row per line with a word: h1, h2 (128 bits of the line), doc, digest, at."""
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = batch.column(0), batch.column(1)
            for first, texts in slices(batch, "text"):
                lines, of, at = [], [], []
                for k, t in enumerate(texts):
                    for i, line in enumerate(plain_lines(t)):
                        if line:
                            lines.append(line)
                            of.append(first + k)
                            at.append(i)
                h, of = _digests(lines), pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[:, 0]),
                        pa.array(h[:, 1]),
                        ids.take(of),
                        digests.take(of),
                        pa.array(at, pa.int32()),
                    ],
                    ["h1", "h2", "doc", "digest", "at"],
                )

    picked = docs.select(*_doc(doc, text), F.col(text).alias("text"))
    return picked.mapInArrow(run, f"h1 long, h2 long, doc {kind}, digest long, at int")


def _distinct_lines(docs: DataFrame, text: str, fields: str, make) -> DataFrame:
    """``make(distinct plain lines)`` of each run of texts, as rows of ``fields``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch, "text"):
                yield make(list(dict.fromkeys(x for t in texts for x in plain_lines(t) if x)))

    return docs.select(F.col(text).alias("text")).mapInArrow(run, fields)


def _packed(lines: list[bytes]) -> pa.RecordBatch:
    """(bucket, data): the band keys of distinct lines as records of 12 bytes, a row per bucket."""
    keys = band_keys(minima(lines)).view(np.uint64).reshape(-1)
    order = np.argsort(keys)
    keys = keys[order]
    records = np.empty(len(keys), RECORD)
    records["key"] = keys >> np.uint64(20)
    records["node"] = _digests(lines)[:, 0][order // BANDS]
    bucket = (keys >> np.uint64(52)).astype(np.int32)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = (np.append(first, len(keys)) * RECORD.itemsize).astype(np.int32)
    data = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(records.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(bucket[first]), data], ["bucket", "data"])


def _met(bucket: int, blobs: list[bytes]) -> pa.RecordBatch:
    """(key, node, size): the keys of a bucket that several lines hold, their lines and how many."""
    records = np.frombuffer(b"".join(blobs), RECORD)
    keys = records["key"]
    order = np.argsort(keys)
    keys = keys[order]
    again = np.zeros(len(keys), bool)
    again[1:] = keys[1:] == keys[:-1]
    again[:-1] |= again[1:]
    keys, nodes = keys[again], records["node"][order[again]]
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes = keys[new].astype(np.int64), nodes[new]
    sizes = np.diff(np.append(np.flatnonzero(np.diff(keys, prepend=-1)), len(keys)))
    sizes = np.repeat(sizes, sizes)
    several = sizes > 1
    return pa.RecordBatch.from_arrays(
        [pa.array(keys[several] + (bucket << 32)), pa.array(nodes[several]), pa.array(sizes[several])],
        ["key", "node", "size"],
    )


def _lists(docs: DataFrame, text: str) -> DataFrame:
    """(key, node, rank) for the band keys that two different lines hold.

    The rank is the number of rows in all lists of a line: high for the original of edited copies.

    Most keys have one line. They go to their bucket as packed records, 12 bytes each, and only those that
    meet another line become rows. A key is known by 44 of its bits: two that agree in those are one list more to verify.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs = None, []
        for batch in batches:
            for own, blob in zip(column(batch, "bucket"), column(batch, "data")):
                if own != bucket and blobs:
                    yield _met(bucket, blobs)
                    blobs = []
                bucket = own
                blobs.append(blob)
        if blobs:
            yield _met(bucket, blobs)

    packed = _distinct_lines(docs, text, "bucket int, data binary", _packed)
    found = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        meet, "key long, node long, size long"
    )
    found = materialise(found, "found")
    return found.drop("size").join(found.groupBy("node").agg(F.sum("size").alias("rank")), "node")


def _texts(docs: DataFrame, text: str, nodes: DataFrame) -> DataFrame:
    """(node, data, s0..): the lines that ``nodes`` names, and their short signatures."""
    table = docs.sparkSession.sparkContext.broadcast(bit_table(nodes, "node"))

    def pick(lines: list[bytes]) -> pa.RecordBatch:
        h = _digests(lines)
        at = np.flatnonzero(has_bit(table.value, h[:, 0]))
        lines = [lines[k] for k in at]
        short = signatures(lines)[1]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(h[at, 0]),
                pa.array(h[at, 1]),
                pa.array(lines, pa.binary()),
                *[pa.array(short[:, k]) for k in range(len(SHORT))],
            ],
            ["node", "h2", "line", *SHORT],
        )

    fields = "node long, h2 long, line binary, " + ", ".join(f"{c} long" for c in SHORT)
    texts = _distinct_lines(docs, text, fields, pick).join(nodes, "node", "left_semi")
    once = texts.groupBy("node").agg(F.min_by(F.struct("line", *SHORT), "h2").alias("v"))
    return once.select("node", F.col("v.line").alias("data"), *[F.col(f"v.{c}").alias(c) for c in SHORT])


def _with_bit(seen: DataFrame, lines: DataFrame) -> DataFrame:
    """The rows of ``seen`` whose line may be one of ``lines``, by h1: all of these, and few others."""
    table = seen.sparkSession.sparkContext.broadcast(bit_table(lines, "h1"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has_bit(table.value, batch.column(0).to_numpy())))

    return seen.mapInArrow(pick, seen.schema)


def _decode(line: bytes) -> np.ndarray:
    return np.unique(shingles([line])[0])


def duplicate_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, digest, at): the places of all lines but the first of each component.

    A line is known by 128 bits, in the graph by the first 64; of two lines that agree in
    those alone only one takes part in fuzzy groups.
    """
    seen = materialise(occurrences(docs, doc, text), "occurrences")
    lists = materialise(_lists(docs, text), "lists")
    texts = materialise(_texts(docs, text, lists.select("node").distinct()), "texts")
    traits = texts.select("node", *SHORT)
    again = seen.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1")
    seen = materialise(_with_bit(seen, again.unionByName(traits.select(F.col("node").alias("h1")))), "seen")
    order = F.struct(F.col("doc").isNull().alias("none"), "doc", "digest", "at")
    per_line = seen.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    per_line = materialise(per_line, "lines")
    comps = linked(lists, lambda nodes: texts.select("node", "data").join(nodes, "node", "left_semi"), _decode, PART, traits, _plausible)
    grouped = per_line.join(comps.withColumnRenamed("node", "h1"), "h1")
    single = grouped.groupBy("h1").agg(F.min("h2").alias("h2"))
    grouped = materialise(grouped.join(single, ["h1", "h2"]).select("h1", "h2", "first", "comp"), "grouped")
    least = grouped.groupBy("comp").agg(F.min("first").alias("keep"))
    fuzzy = grouped.join(least, "comp").select("h1", "h2", "keep")
    equal = per_line.filter("n > 1").join(grouped, ["h1", "h2"], "left_anti")
    keepers = materialise(
        fuzzy.unionByName(equal.select("h1", "h2", F.col("first").alias("keep"))), "keepers"
    )
    stays = (
        F.col("doc").eqNullSafe(F.col("keep.doc"))
        & (F.col("digest") == F.col("keep.digest"))
        & (F.col("at") == F.col("keep.at"))
    )
    return seen.join(keepers, ["h1", "h2"]).filter(~stays).select("doc", "digest", "at")


def deduplicate(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one line of each component left, and n_lines (with a word, before) and n_removed.

    Rows that agree in id and text are one document and lose the same lines.
    """
    gone = duplicate_lines(docs, doc, text)
    gone = gone.groupBy(F.col("doc").alias("__doc"), F.col("digest").alias("__digest")).agg(
        F.collect_set("at").alias("__gone")  # at most the lines of one text
    )
    gone = materialise(gone, "gone")
    keyed = docs.withColumn("__text", F.xxhash64(text))
    same = F.col(doc).eqNullSafe(F.col("__doc")) & (F.col("__text") == F.col("__digest"))
    lines = F.split(F.col(text), "\n", -1)
    with_word = F.filter(lines, lambda x: x.rlike("[^ \\t-\\r]"))

    def rest(x: F.Column) -> F.Column:
        every = F.sequence(F.lit(0), F.size(x) - 1)
        return F.array_join(F.transform(F.array_except(every, F.col("__gone")), lambda i: F.get(x, i)), "\n")

    left = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(
        F.transform(F.array(lines), rest)[0]
    )
    return (
        keyed.join(gone, same, "left")
        .withColumn("n_lines", F.coalesce(F.size(with_word), F.lit(0)).cast("long"))
        .withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
        .withColumn(text, left)
        .drop("__doc", "__digest", "__gone", "__text")
    )


def op8_lines(spark, sf_dir: str) -> DataFrame:
    """Lines removed from each document, and a digest of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicate(docs).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )
