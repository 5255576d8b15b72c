"""How a chain of filters interacts: counts in each order, by contraction of contingency tensors.

Each document fails or passes each of five filters, so a part of the corpus is described by 2x2x2x2x2
counts (one tensor for all documents, one for the good, one for the toxic ones). What a filter
removes at a step of an order is a contraction: ``pass`` along the axes of the filters before it,
``fail`` along its own, ``all`` along the others. One einsum per block of parts does this for all
600 steps of the 120 orders.

Spark counts: a document's first four verdicts follow from its text alone. For the fifth (a copy of a
smaller id's text) the least id is found per text digest, with map-side combining, and joined back on
(digest, id) together, so that a text which a third of all rows share is spread over the tasks. Only
32 counts per part are gathered for the contraction, in tasks that hold whole parts.

Edge cases: NULL texts are empty texts and copies of each other; a NULL id is smaller and greater than
none, so such a row is no copy and makes none; rows that repeat an id share its verdict, each counts;
NULL parts are the empty string; a document is good or toxic if any of its label rows says 1; an empty
table has no parts and gives no rows; further columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.llm.outliers import let

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
PARTS_AT_ONCE = 64  # parts that one einsum takes; memory only

ALL, PASS, FAIL = np.array([[1, 1], [1, 0], [0, 1]], np.int64)


def failures(text: Column) -> dict[str, Column]:
    """The four verdicts on a text alone, as 0 or 1: short, repetitive, shouting, symbols."""
    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(whole, "[ \\t-\\r]+"), lambda w: w != "")

    def of_words(w: Column) -> Column:
        n, distinct = F.size(w), F.size(F.array_distinct(w))
        return F.struct((n < 200).alias("a"), (100 * distinct < 50 * n).alias("b"))

    counted = let(words, of_words)
    upper = F.regexp_count(whole, F.lit("[A-Z]"))
    return {
        "A": counted["a"].cast("int"),
        "B": counted["b"].cast("int"),
        "C": (100 * upper.cast("long") > 3 * F.length(whole)).cast("int"),
        "D": whole.rlike("[#$%&*|]").cast("int"),
    }


def with_cells(
    docs: DataFrame, labels: DataFrame, part: str = "lang", text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Counts per part and cell (bit k of ``cell`` is set if the document fails filter k).

    Columns: part, cell, n, good, toxic. Rows equal in id, text and part are counted before the
    first shuffle.
    """
    bare = docs.select(
        F.col(key).alias("doc_id"),
        F.coalesce(F.col(part), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"),
        F.struct(*[c.alias(k) for k, c in failures(F.col(text)).items()]).alias("f"),
    )
    bits = sum((F.col(f"f.{x}") * (1 << k) for k, x in enumerate("ABCD")), F.lit(0))
    rows = bare.select("doc_id", "part", "digest", bits.alias("cell"))
    rows = rows.groupBy("digest", "doc_id", "part", "cell").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.groupBy(F.col("doc_id").alias("__id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("__good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("__toxic"),
    )
    least = rows.groupBy(F.col("digest").alias("__digest")).agg(F.min("doc_id").alias("__least"))
    first = (F.col("digest") == F.col("__digest")) & (F.col("doc_id") == F.col("__least"))
    copied = F.col("__least").isNull() & F.col("doc_id").isNotNull()
    told = rows.join(least, first, "left").join(marks, F.col("doc_id") == F.col("__id"), "left")
    return told.groupBy("part", (F.col("cell") + copied.cast("int") * 16).alias("cell")).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.coalesce("__good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("__toxic", F.lit(0))).alias("toxic"),
    )


def _selectors() -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray], np.ndarray]:
    """Per step of every order: what each axis takes for kept and for removed; the step's filter;
    per filter what each axis takes if only that filter fails, and if it fails whatever the rest."""
    kept, removed, own = [], [], []
    for order in ORDERS:
        axes = [ALL] * 5
        for letter in order:
            k = LETTERS.index(letter)
            removed.append([*axes[:k], FAIL, *axes[k + 1 :]])
            axes = [*axes[:k], PASS, *axes[k + 1 :]]
            kept.append(axes)
            own.append(k)
    alone = [[FAIL if j == k else PASS for j in range(5)] for k in range(5)]
    fails = [[FAIL if j == k else ALL for j in range(5)] for k in range(5)]
    return np.array(kept), np.array(removed), np.array(own), np.array([alone, fails])


def contract(tensors: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """``tensors`` (m, 2, 2, 2, 2, 2) under selections ``axes`` (z, 5, 2): an (m, z) table."""
    steps = np.einsum("mabcde,ze->mzabcd", tensors, axes[:, 4])
    for k, letters in ((3, "abcd"), (2, "abc"), (1, "ab"), (0, "a")):
        steps = np.einsum(f"mz{letters},z{letters[-1]}->mz{letters[:-1]}", steps, axes[:, k])
    return steps


def interactions(counts: np.ndarray) -> dict[str, np.ndarray]:
    """All measures, each (parts, 600), of counts (parts, 3, 32): all, good, toxic documents."""
    kept, removed, own, (alone, fails) = _selectors()
    # Bit k of a cell number is filter k: the last filter is the first axis as stored.
    shaped = counts.reshape(-1, 3, 2, 2, 2, 2, 2).transpose(0, 1, 6, 5, 4, 3, 2)
    all_, good, toxic = (np.ascontiguousarray(shaped[:, k]) for k in range(3))
    gone = contract(all_, removed)
    share = np.stack([gone[:, own == k].sum(1) for k in range(5)], 1)
    return {
        "kept": contract(all_, kept),
        "removed": gone,
        "redundant": contract(all_, fails)[:, own] - gone,
        "unique_fails": contract(all_, alone)[:, own],
        "good_lost": contract(good, removed),
        "toxic_lost": contract(toxic, removed),
        "shapley": share[:, own],
    }


def audit(cells: DataFrame) -> DataFrame:
    """A row per part, order and step from the counts of :func:`with_cells`."""
    names = ["n", "good", "toxic"]
    lists = F.map_from_entries(F.collect_list(F.struct("cell", F.struct(*names).alias("v"))))
    parts = cells.groupBy("part").agg(lists.alias("m"))
    cell = lambda k, c: F.coalesce(F.col("m")[F.lit(k)][c], F.lit(0))
    wide = parts.select("part", F.array(*[cell(k, c) for c in names for k in range(32)]).alias("counts"))
    orders = pa.array([o for o in ORDERS for _ in LETTERS])
    steps = pa.array([k for _ in ORDERS for k in range(1, 6)], pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS_AT_ONCE):
                some = batch.slice(at, PARTS_AT_ONCE)
                names_ = some.column(0).to_pylist()
                counts = some.column(1).flatten().to_numpy().reshape(-1, 3, 32)
                made = interactions(counts)
                for i, name in enumerate(names_):
                    columns = [pa.array([name] * len(orders), pa.string()), orders, steps]
                    columns += [pa.array(made[m][i]) for m in MEASURES]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *MEASURES])

    schema = "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES)
    return wide.mapInArrow(run, schema)


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """All documents by language, in all 120 orders."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return audit(with_cells(docs, labels))


SQL = """
    WITH docs AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
    ), worded AS (
        SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
            coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
        FROM docs
    ), flagged AS (
        SELECT part, len(words) < 200 AS a,
            100 * len(list_distinct(words)) < 50 * len(words) AS b,
            100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c,
            regexp_matches(text, '[#$%&*|]') AS d, e,
            doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
            doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic
        FROM worded
    ), cells AS (
        SELECT part, concat(if(a, 'A', ''), if(b, 'B', ''), if(c, 'C', ''), if(d, 'D', ''), if(e, 'E', '')) AS fails,
            count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
        FROM flagged GROUP BY ALL
    ), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
        SELECT p.x || q.x || r.x || s.x || t.x AS o
        FROM letters p, letters q, letters r, letters s, letters t
        WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
    ), steps AS (
        SELECT o AS filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders
    ), told AS (
        SELECT filter_order, step, filter_order[step] AS own, part, n, good, toxic, fails,
            contains(fails, own) AS hit,
            step > 1 AND regexp_matches(fails, '[' || filter_order[:step - 1] || '_]') AS gone
        FROM steps, cells
    ), counted AS (
        SELECT part, filter_order, step, own,
            CAST(sum(n) FILTER (NOT hit AND NOT gone) AS BIGINT) AS kept,
            CAST(sum(n) FILTER (hit AND NOT gone) AS BIGINT) AS removed,
            CAST(sum(n) FILTER (hit AND gone) AS BIGINT) AS redundant,
            CAST(sum(n) FILTER (fails = own) AS BIGINT) AS unique_fails,
            CAST(sum(good) FILTER (hit AND NOT gone) AS BIGINT) AS good_lost,
            CAST(sum(toxic) FILTER (hit AND NOT gone) AS BIGINT) AS toxic_lost
        FROM told GROUP BY ALL
    )
    SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed,
        coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
        coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
        CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley
    FROM counted"""
