"""Connected components and verified links over candidate lists, without pairs inside a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.llm.batches import column, mix
from cutline.session import materialise

BITS = 1 << 26  # of a bit table of ids: 8 MB, whatever the number of ids
ROUNDS = 50
FEW = 32  # nodes of a list whose pairs are all made: at most 16 a row
OFTEN = (2, 16, 256)  # numbers of owners that part the elements of sets into classes


def bit_table(ids: DataFrame, column: str) -> np.ndarray:
    """Bits of hashed 64-bit ids: never misses one, may hold others. Always of one size."""
    place = F.pmod(F.col(column), F.lit(BITS))
    words = ids.select(
        F.shiftright(place, 6).cast("int").alias("word"),
        F.expr(f"shiftleft(1L, cast(pmod(`{column}`, {BITS}L) & 63 as int))").alias("bit"),
    )
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(BITS // 64, np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    return table


def has_bit(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    place = ids.astype(np.int64) & (BITS - 1)
    return (table[place >> 6] >> (place & 63) & 1).astype(bool)


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the least node that can be reached, for all nodes of links (a, b).

    Alternating star contractions: each round points the larger neighbours of a node, then the node and its
    smaller ones, to the least of them, until every edge leads straight to a root. A node's
    neighbours are never collected; the least comes from a combining aggregate.
    """
    wide, low = F.greatest("a", "b"), F.least("a", "b")
    edges = links.filter("a <> b").select(wide.alias("a"), low.alias("b")).distinct()
    edges = materialise(edges, "edges")
    for _ in range(ROUNDS):
        roots = edges.select(F.col("b").alias("a")).distinct()
        inner = edges.join(roots, "a", "left_semi").limit(1).count()
        many = edges.groupBy("a").count().filter("count > 1").limit(1).count()
        if not inner and not many:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(
                roots.select("a", "a")
            )
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.filter("a <> b").distinct(), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        tops = least.select("a", F.col("m").alias("b"))
        edges = materialise(small.union(tops).filter("a <> b").distinct(), "edges")
    raise RuntimeError("components did not settle")


def _shares(pairs: DataFrame, data: DataFrame, decode: Callable[[bytes], np.ndarray]) -> DataFrame:
    """Pairs (a, b) of nodes with the exact Jaccard similarity of their sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[bytes, np.ndarray] = {}
            shares = []
            for pair in zip(column(batch, "data_a"), column(batch, "data_b")):
                x, y = (sets[d] if d in sets else sets.setdefault(d, decode(d)) for d in pair)
                both = len(np.intersect1d(x, y, assume_unique=True))
                shares.append(both / (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(shares, pa.float64())], ["a", "b", "share"]
            )

    sided = _sided(pairs, data, ("a", "b")).select("a", "b", "data_a", "data_b")
    return sided.mapInArrow(compare, "a long, b long, share double")


def _sided(pairs: DataFrame, data: DataFrame, names: tuple[str, str]) -> DataFrame:
    """``pairs`` with the data of the nodes in two of their columns, as data_a and data_b."""
    for name, side in zip(names, "ab"):
        own = data.select(F.col("node").alias(name), F.col("data").alias(f"data_{side}"))
        pairs = pairs.join(own, name)
    return pairs


def _edits(pairs: DataFrame, data: DataFrame, decode: Callable[[bytes], np.ndarray], part: tuple[int, int]) -> DataFrame:
    """(node, hub, size, close, least, data): where the set of a node differs from that of its hub.

    ``data`` has the elements that are in one of the two sets, scrambled with the hub, so that those of
    different hubs do not meet. Sets of sizes n and m have Jaccard similarity ``num / den`` if they differ in at most
    ``(n + m) (den - num) / (den + num)`` elements. So of nodes with d and e edits, similar ones have at least
    half of ``d + e`` less that in common. ``least`` is the least such number: a similar set has not more than
    ``n den / num`` elements and not fewer than d less the bound edits. The partner of a node that is ``close`` to the hub
    counts only if it is not, so it has more edits than the bound of its own size and the hub's.
    """
    num, den = part
    more, less = den + num, den - num

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[bytes, np.ndarray] = {}
            rows = []
            for hub, *pair in zip(column(batch, "hub"), column(batch, "data_a"), column(batch, "data_b")):
                x, h = (sets[d] if d in sets else sets.setdefault(d, decode(d)) for d in pair)
                edits = np.setxor1d(x, h, assume_unique=True) ^ mix(np.array([hub]))
                least = max(1, len(edits) - less * len(x) // num)
                close = more * len(edits) <= less * (len(x) + len(h))
                if close:
                    least = max(least, -(-(more * len(edits) + less * (len(h) - len(x))) // (2 * more)))
                rows.append((len(x), close, least, np.sort(mix(edits)).tobytes()))
            kinds = pa.int64(), pa.bool_(), pa.int64(), pa.binary()
            made = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *made], ["node", "hub", "size", "close", "least", "data"]
            )

    sided = _sided(pairs, data, ("node", "hub")).select("node", "hub", "data_a", "data_b")
    return sided.mapInArrow(compare, "node long, hub long, size long, close boolean, least long, data binary")


def _prefixes(edits: DataFrame) -> DataFrame:
    """(token, node, size, edits, place): the first edits of each node, the rarest first.

    Two sets that share ``least`` elements share one of the first ``n - least + 1`` of each in any common
    order. The order here is by class of owners, then value. The class is read from bit tables of fixed size, so
    it may be too high for some elements but is the same in all sets. Elements with one owner take up their places
    and are not listed.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = np.unique(np.frombuffer(b"".join(column(batch, "data")), np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n, pa.int64())], ["token", "n"])

    counts = edits.select("data").mapInArrow(tally, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = materialise(counts.filter(F.col("n") >= OFTEN[0]), "tokens")
    tables = [bit_table(counts.filter(F.col("n") >= n), "token") for n in OFTEN]
    shared = edits.sparkSession.sparkContext.broadcast(np.array(tables))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in batches:
            tokens, of, places, counts = [], [], [], []
            for k, (least, d) in enumerate(zip(column(batch, "least"), column(batch, "data"))):
                own = np.frombuffer(d, np.int64)
                most = len(own) - least + 1
                if most <= 0:
                    continue
                level = sum(has_bit(t, own).astype(np.int8) for t in levels)
                single = len(own) - np.count_nonzero(level)
                if single < most:
                    order = np.lexsort((own, level))[single:most]
                    tokens.append(own[order])
                    of.append(np.full(len(order), k))
                    counts.append(np.full(len(order), len(own)))
                    places.append(np.arange(single, single + len(order)))
            if tokens:
                of = pa.array(np.concatenate(of))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(tokens)),
                        batch.column(0).take(of),
                        batch.column(1).take(of),
                        pa.array(np.concatenate(counts), pa.int64()),
                        pa.array(np.concatenate(places), pa.int64()),
                    ],
                    ["token", "node", "size", "edits", "place"],
                )

    return edits.select("node", "size", "least", "data").mapInArrow(
        first, "token long, node long, size long, edits long, place long"
    )


def linked(
    lists: DataFrame,
    payload: Callable[[DataFrame], DataFrame],
    decode: Callable[[bytes], np.ndarray],
    part: tuple[int, int],
    traits: DataFrame,
    plausible: Callable[[Callable[[str], F.Column], Callable[[str], F.Column]], F.Column],
) -> DataFrame:
    """(node, comp) of the nodes that links of at least ``num / den`` Jaccard similarity join.

    ``lists`` (a written table, as it is read twice) has (key, node, rank): nodes that share a key are candidates. ``traits`` has a row per
    node; ``plausible`` tells from the traits of two nodes whether they may be similar. ``payload`` gives
    (node, data) of a table of nodes, and ``decode`` makes of data the sorted distinct elements of a set.

    First every node of a key meets one node of it, that of the highest rank; so a group of copies makes
    as many pairs as it has rows. Then only pairs that are still in different components are
    left; pairs inside one component cannot change the result. Of a key that still holds several
    components and at most ``FEW`` nodes, all pairs between them are made. The nodes of larger such keys
    are open. Of their differences from the hub (``_edits``) the rarest are listed, as many as make similar nodes
    meet (``_prefixes``); of each such list, nodes outside its largest component meet those of
    other components where sizes and places leave room for enough common edits. So nodes that share a
    passage or are edited from a common original in different places make no pairs.
    """
    num, den = part
    names = [c for c in traits.columns if c != "node"]

    def of(side: str) -> Callable[[str], F.Column]:
        return lambda name: F.col(f"{side}_{name}")

    def likely(pairs: DataFrame) -> DataFrame:
        for node, side in (("a", "x"), ("b", "y")):
            own = traits.select(F.col("node").alias(node), *[F.col(c).alias(f"{side}_{c}") for c in names])
            pairs = pairs.join(own, node)
        return pairs.filter(plausible(of("x"), of("y"))).select("a", "b")

    first = F.min_by("node", F.struct(-F.col("rank"), F.col("node"))).alias("hub")
    hubs = lists.groupBy("key").agg(first, F.min("node").alias("__a"), F.max("node").alias("__b"))
    hubs = materialise(hubs.filter("__a <> __b").select("key", "hub"), "hubs")
    shared = lists.drop("rank").join(hubs, "key")
    pair = [F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")]
    stars = materialise(likely(shared.filter("node <> hub").select(*pair).distinct()), "stars")

    def links_of(pairs: DataFrame, data: DataFrame) -> DataFrame:
        close = _shares(pairs, data, decode).filter(F.col("share") >= num / den)
        return materialise(close.select("a", "b"), "links")

    def nodes_of(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    links = links_of(stars, materialise(payload(materialise(nodes_of(stars), "nodes")), "sets"))
    comps = materialise(components(links), "components")
    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("width"))
    comps = materialise(comps.join(sizes, "comp"), "components")

    def placed(df: DataFrame) -> DataFrame:
        """``df`` with the component of its nodes and its width, themselves where they have no link."""
        found = df.join(comps, "node", "left")
        return found.withColumn("comp", F.coalesce("comp", "node")).fillna(1, ["width"])

    def mixed(df: DataFrame, key: str) -> DataFrame:
        """The keys that hold several components, the widest of them, and the number of nodes."""
        main = F.max_by("comp", F.struct("width", "comp")).alias("main")
        ends = F.min("comp").alias("__a"), F.max("comp").alias("__b"), F.count(F.lit(1)).alias("nodes")
        return df.groupBy(key).agg(main, *ends).filter("__a <> __b").select(key, "main", "nodes")

    def open_pairs(rows: DataFrame) -> DataFrame:
        """Distinct pairs that were not compared yet."""
        pair = [F.greatest("x_node", "y_node").alias("a"), F.least("x_node", "y_node").alias("b")]
        return rows.select(*pair).distinct().join(stars, ["a", "b"], "left_anti")

    own = placed(lists.select("key", "node"))
    own = materialise(own.select("key", "node", "comp").join(mixed(own, "key").drop("main"), "key"), "several")
    few = own.filter(F.col("nodes") <= FEW)
    x, y = (few.select("key", *[F.col(c).alias(f"{s}_{c}") for c in ("node", "comp")]) for s in "xy")
    near = x.join(y, "key").filter("x_comp <> y_comp AND x_node > y_node")
    near = materialise(likely(open_pairs(near)), "near")
    left = own.filter(F.col("nodes") > FEW).select("key", "node").join(hubs, "key").filter("node <> hub")
    left = materialise(left.select("node", "hub").distinct(), "open")
    closer = links_of(near, materialise(payload(materialise(nodes_of(near), "nodes")), "sets"))
    both = left.select(F.explode(F.array("node", "hub")).alias("node")).distinct()
    data = materialise(payload(materialise(both, "nodes")), "sets")
    edits = materialise(_edits(left, data, decode, part), "edits")
    tokens = placed(materialise(_prefixes(edits), "prefixes"))
    tokens = materialise(tokens.join(mixed(tokens, "token").drop("nodes"), "token"), "mixed")

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("token", *[F.col(c).alias(f"{name}_{c}") for c in rows.columns if c != "token"])

    room = F.least(F.expr("x_edits - x_place"), F.expr("y_edits - y_place"))
    spare = (F.expr("x_edits + y_edits") - 2 * room) * (den + num)
    fits = (
        F.expr("x_comp <> y_comp AND (y_comp = y_main OR x_node > y_node)")
        & (spare <= F.expr("x_size + y_size") * (den - num))
        & (F.expr("least(x_size, y_size)") * den >= F.expr("greatest(x_size, y_size)") * num)
    )
    rest = side(tokens.filter("comp <> main"), "x").join(side(tokens, "y"), "token").filter(fits)
    more = links_of(materialise(likely(open_pairs(rest)), "rest"), data)
    more = more.unionByName(edits.filter("close").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    # The components so far, as nodes, are joined further by the new links.
    joined = closer.unionByName(more)
    for node in ("a", "b"):
        own = comps.select(F.col("node").alias(node), F.col("comp").alias("__comp"))
        joined = joined.join(own, node, "left").withColumn(node, F.coalesce("__comp", node)).drop("__comp")
    wider = materialise(components(joined), "wider")
    final = comps.join(wider.select(F.col("node").alias("comp"), F.col("comp").alias("wide")), "comp", "left")
    return final.select("node", F.coalesce("wide", "comp").alias("comp")).unionByName(
        wider.join(comps, "node", "left_anti")
    )
