"""Near-duplicate documents by bottom-k sketches.

A document's set holds the 64-bit hashes of its five-word shingles (lower-cased A-Z); the sketch is the
``KEPT`` least of them. Documents with equal sets are one class. Inverted lists of retained
values generate overlaps: if two sets have Jaccard similarity 0.75, their sketches share a number of
values that is binomial at worst with mean 48 of 64, so below ``SHARED`` = 28 once in 10**8 cases.
Each class therefore enters only the lists of its rarest values, as many as ensure that two
sketches with ``SHARED`` common values meet in one list (ordered by frequency, then value). Passages that
many documents share are frequent, so documents meet by them only if they fill most of the
sketch. ``graph.linked`` turns lists into candidates (documents that one comparison per list leaves open must
also meet among the rarest shingles of their full sets); the union-sketch estimate filters them and the
Jaccard similarity of the full sets decides.

Edge cases: NULL and empty texts have no shingles and no links; a text of fewer than five words is one
shingle; equal texts with the same id are rows of one class; NULL ids: a class without any id has component
NULL, its rows are kept if they are its first; empty tables stay empty; ``documents`` passes all columns on
and reads only id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from cutline.llm.batches import (
    as_bytes,
    buffers_of,
    hash_runs,
    offsets,
    slices,
    split_words,
    window_hashes,
)
from cutline.llm.graph import bit_table, has_bit, linked
from cutline.session import materialise

WORDS, KEPT, SHARED = 5, 64, 28
NUMERATOR, DENOMINATOR = 75, 100
THRESHOLD = NUMERATOR / DENOMINATOR
SIGN = np.uint64(1 << 63)  # flipped in sketches: their signed order is the order of the hashes
# Union-sketch estimates this far below the threshold (five standard deviations of 64 draws at
# 0.75) are not verified.
SLACK = 0.27


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, sizes = split_words([t.lower() for t in texts])
    hashes = hash_runs(*buffers_of(words))
    every = window_hashes(hashes, WORDS)
    ends = offsets(sizes)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(every[a : b - WORDS + 1]))
        else:
            out.append(window_hashes(hashes[a:b], b - a) if b > a else every[:0])
    return out


def sketches(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """A row per document: row (a number of its own), doc, digest (of the text), n, h1, h2 (128 bits of
    the set), sketch."""
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column(0)
            for first, texts in slices(batch, "text"):
                sets = shingle_sets(texts)
                digests = b"".join(xxh3_128_digest(s.tobytes()) for s in sets)
                h = np.frombuffer(digests, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(at, at + len(texts), dtype=np.int64) + (part << 40)),
                        ids.slice(first, len(texts)),
                        batch.column(2).slice(first, len(texts)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(h[:, 0]),
                        pa.array(h[:, 1]),
                        pa.array([(s[:KEPT] ^ SIGN).view(np.int64).tolist() for s in sets], pa.list_(pa.int64())),
                    ],
                    ["row", "doc", "digest", "n", "h1", "h2", "sketch"],
                )
                at += len(texts)

    digest = F.xxhash64(text).alias("digest")
    return docs.select(F.col(doc).alias("doc"), as_bytes(text).alias("text"), digest).mapInArrow(
        run, f"row long, doc {kind}, digest long, n long, h1 long, h2 long, sketch array<long>"
    )


def _lists(classes: DataFrame) -> DataFrame:
    """(key, node, rank): each class in the lists of its rarest shared values."""
    values = classes.select("node", F.col("n").alias("size"), F.explode("sketch").alias("key"))
    often = values.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    kept = F.least(F.lit(KEPT), "size")
    needed = F.least(F.lit(SHARED), F.ceil(F.col("size") * NUMERATOR / DENOMINATOR))
    own = (
        values.join(often, "key").groupBy("node", "size")
        .agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("found"))  # KEPT at most
    )
    # Values without another owner come first in the order and take up their places.
    places = (kept - needed + 1) - (kept - F.size("found"))
    ranked = own.withColumn("places", places.cast("int")).filter("places > 0")
    total = F.aggregate("found", F.lit(0).cast("long"), lambda a, v: a + v["df"])
    return ranked.select(
        "node", total.alias("rank"), F.explode(F.slice("found", F.lit(1), F.col("places"))).alias("v")
    ).select(F.col("v.key").alias("key"), "node", "rank")


def _estimate(a: F.Column, b: F.Column, most: int = KEPT) -> F.Column:
    """Share of the least ``most`` values of two sketches' union that are in both."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, most)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)


def _payload(docs: DataFrame, classes: DataFrame, text: str):
    """Gives (node, data) of classes: their full sets, from the texts."""

    def payload(nodes: DataFrame) -> DataFrame:
        nodes = materialise(nodes.join(classes.select("node", "h1", "h2"), "node"), "nodes")
        table = docs.sparkSession.sparkContext.broadcast(bit_table(nodes, "h1"))

        def reread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, texts in slices(batch, "text"):
                    sets = shingle_sets(texts)
                    digests = b"".join(xxh3_128_digest(s.tobytes()) for s in sets)
                    h = np.frombuffer(digests, "<i8").reshape(-1, 2)
                    at = np.flatnonzero(has_bit(table.value, h[:, 0]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(h[at, 0]),
                            pa.array(h[at, 1]),
                            pa.array([sets[k].tobytes() for k in at], pa.binary()),
                        ],
                        ["h1", "h2", "data"],
                    )

        found = docs.select(as_bytes(text).alias("text")).mapInArrow(reread, "h1 long, h2 long, data binary")
        return nodes.join(found, ["h1", "h2"]).groupBy("node").agg(F.first("data").alias("data"))

    return payload


def _decode(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def components(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: row, doc, digest, n_shingles, component (least id), kept.

    ``kept`` holds for one row of each component: that of the least id (the first such row).
    """
    base = materialise(sketches(docs, doc, text), "sketches")
    full = base.filter("n > 0")
    first = full.groupBy("h1", "h2").agg(
        F.min_by("row", F.struct(F.col("doc").isNull(), "doc", "row")).alias("node")
    )
    nodes = materialise(first, "classes")
    classes = full.join(nodes.select(F.col("node").alias("row"), "node"), "row").select(
        "node", "n", "h1", "h2", "sketch"
    )
    classes = materialise(classes, "representatives")

    def plausible(x, y) -> F.Column:
        """Sizes that fit, then the union-sketch estimate."""
        least, most = F.least(x("n"), y("n")), F.greatest(x("n"), y("n"))
        close = _estimate(x("sketch"), y("sketch")) >= THRESHOLD - SLACK
        return (DENOMINATOR * least >= NUMERATOR * most) & close

    traits = classes.select("node", "n", "sketch")
    payload, part = _payload(docs, classes, text), (NUMERATOR, DENOMINATOR)
    comps = linked(materialise(_lists(classes), "lists"), payload, _decode, part, traits, plausible)
    named = nodes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rows = base.join(named.select("h1", "h2", "comp"), ["h1", "h2"], "left")
    rows = rows.withColumn("comp", F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("row")))
    rows = materialise(rows.drop("sketch"), "rows")
    order = F.struct(F.col("doc").isNull(), "doc", "row")
    least = rows.groupBy("comp").agg(F.min(order).alias("least")).select(
        "comp", F.col("least.doc").alias("component"), F.col("least.row").alias("__row")
    )
    return rows.join(least, "comp").select(
        "row", "doc", "digest", F.col("n").alias("n_shingles"), "component",
        (F.col("row") == F.col("__row")).alias("kept"),
    )


def documents(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, with all its columns.

    Rows go by id and text; of rows that agree in both one stays (all, if they have no words).
    """
    found = materialise(components(docs, doc, text), "components")
    # A key whose row is kept stays, even if other rows repeat it.
    gone = found.groupBy("doc", "digest").agg(F.bool_or("kept").alias("kept")).filter("NOT kept")
    gone = gone.select(F.col("doc").alias("__doc"), F.col("digest").alias("__digest"))
    keyed = docs.withColumn("__text", F.xxhash64(text))
    same = F.col(doc).eqNullSafe(F.col("__doc")) & (F.col("__text") == F.col("__digest"))
    left = keyed.join(gone, same, "left_anti")
    again = found.filter("n_shingles > 0").groupBy("doc", "digest").count().filter("count > 1")
    again = materialise(
        again.select(F.col("doc").alias("__doc"), F.col("digest").alias("__digest")), "repeated"
    )
    if again.limit(1).count():
        once = left.join(again, same, "left_semi").dropDuplicates([doc, "__text"])
        left = left.join(again, same, "left_anti").unionByName(once)
    return left.drop("__text")


def op7_bottom_k(spark, sf_dir: str) -> DataFrame:
    """Component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return components(docs).select(
        F.col("doc").alias("doc_id"),
        "n_shingles",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("doc") == F.col("component"), "kept").alias("kept"),
    )
