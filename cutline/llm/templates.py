"""Benchmark decontamination by canonical templates.

A text becomes a sequence of tokens in which numbers, units behind numbers and names
(capitalised words inside a sentence) are typed placeholders; other words are lower-cased without outer
punctuation, and bare punctuation is left out. Windows of ``WINDOW`` tokens with at least
``LITERALS`` words are hashed. Names make three readings: without placeholders, with them, and with
capitalised words that open a sentence as names too, so a change of capitals hides nothing. Windows
of fewer words are too general as templates and are hashed with their values, so a verbatim
copy is always found. Windows of documents meet those of benchmark items by hash join. On one
alignment (document position minus item position) the slots must be consistent: each value of the
item stands for one value in the document. A document is contaminated if consistent windows
cover ``COVER`` tokens of an item (all tokens of a shorter one). Windows with opening names and those
with values may add to the others but never take from them: each is counted with and without.

Items that agree but for numbers and units, and whose values are equal at the same places, are one
class, named by its least id; so an item is consistent with its own class. In windows that are
hashed with their values these must agree too. Documents meet classes (:func:`matches`);
:func:`links` then gives every item of the class its own link, with its own changed values.

A document's windows are first held against the hashes of all items inside the scan, as long as
there are at most ``PROBE`` of them (8 bytes each, checked); beyond that all windows go
through the join.

Edge cases: NULL and empty texts match nothing; items with fewer than ``LITERALS`` tokens
are too general to match; ids may repeat or be NULL: rows with the same id and text are one
document; empty tables give no rows; further columns are not read, so they cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from cutline.llm.batches import (
    add_columns,
    as_bytes,
    buffers_of,
    column,
    hash_runs,
    mix,
    offsets,
    slices,
    split_words,
    window_hashes,
)
from cutline.session import materialise

WINDOW, LITERALS, COVER = 8, 5, 13
PROBE = 2_000_000
# Units by symbol or name (fixed values).
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres "
    "mg g kg t lb lbs oz gram grams kilogram kilograms ton tons pound pounds ounce ounces "
    "ml l liter liters litre litres gallon gallons s sec ms min h hr second seconds minute minutes hour "
    "hours day days week weeks month months year years hz khz mhz ghz v w kw mw a j kj n pa kpa c f k "
    "degree degrees percent usd eur gbp dollar dollars euro euros cent cents mph kph kmh".encode().split()
)
NUMBER = re.compile(r"[+-]?[0-9]+(?:[.,:/x-][0-9]+)*")
GLUED = re.compile(r"([+-]?[0-9]+(?:[.,][0-9]+)*)([^\W\d_]+)")
OUTER = re.compile(r"^[\W_]+|[\W_]+$")
SLOT_NUMBER, SLOT_UNIT, SLOT_NAME = 1, 2, 3
BASE, EXACT, OPENED = range(3)  # kinds of windows
VIEWS = [(BASE,), (BASE, EXACT), (BASE, OPENED), (BASE, EXACT, OPENED)]
SLOTS = mix(np.arange(4, dtype=np.uint64) + np.uint64(1))
SKIP, NUMERIC, UNIT, TITLE, STOP, MEASURE = 1, 2, 4, 8, 16, 32


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


LETTER = _mask(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
PLAIN = LETTER | _mask(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
STOPS, CLOSERS = _mask(b".!?:"), _mask(b"\"')]}")


def _hash_list(words: list[bytes]) -> np.ndarray:
    words = [w or b"\0" for w in words]
    return hash_runs(np.frombuffer(b"".join(words), np.uint8), offsets(map(len, words)))


def word_facts(words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each bare lower-cased word, and flags.

    Words of ASCII letters between ASCII punctuation are read as arrays of bytes, others one by one.
    """
    data, ends = buffers_of(words)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    starts, sizes = ends[:-1], np.diff(ends)
    letter = LETTER[data]
    place = np.arange(len(data))
    first = np.minimum.reduceat(np.where(letter, place, len(data)), starts)
    last = np.maximum.reduceat(np.where(letter, place, -1), starts)
    letters = np.add.reduceat(letter, starts, dtype=np.int64)
    plain = np.logical_and.reduceat(PLAIN[data], starts)
    simple = plain & (letters > 0) & (last - first + 1 == letters)
    flags = np.zeros(len(words), np.uint8)
    flags[plain & (letters == 0)] = SKIP
    upper = letter & (data < 97)
    title = (np.add.reduceat(upper, starts, dtype=np.int64) == 1) & (letters > 1)
    title[title] = upper[first[title]]
    flags[simple & title] |= TITLE
    open_end = np.maximum.reduceat(np.where(CLOSERS[data], -1, place), starts)
    stop = (open_end >= 0) & STOPS[data[open_end]]
    flags[stop] |= STOP
    hashes = np.zeros(len(words), np.uint64)
    kept = letter & np.repeat(simple, sizes)
    hashes[simple] = hash_runs(data[kept] | 32, offsets(letters[simple]))
    flags[simple & np.isin(hashes, UNIT_HASHES)] |= UNIT
    others = np.flatnonzero(~plain | ((letters > 0) & ~simple))
    lows = []
    for k in others.tolist():
        word = OUTER.sub("", words[k].as_py().decode("utf-8", "replace"))
        low = word.lower().encode()
        lows.append(low)
        if not word:
            flags[k] |= SKIP
        elif not word.isalpha():
            if NUMBER.fullmatch(word):
                flags[k] |= NUMERIC
            elif (glued := GLUED.fullmatch(word)) and glued[2].lower().encode() in UNITS:
                flags[k] |= MEASURE
        elif low in UNITS:
            flags[k] |= UNIT
        if len(word) > 1 and word[0].isupper() and word[1:].islower():
            flags[k] |= TITLE
    if lows:
        hashes[others] = _hash_list(lows)
    return hashes, flags


UNIT_HASHES = _hash_list(sorted(UNITS))


class Probe:
    """A set of hashes: a bit table first, then the sorted hashes themselves."""

    def __init__(self, hashes: np.ndarray, bits: int = 22):
        self.hashes, self.shift = np.unique(hashes), np.uint64(64 - bits)
        self.bits = np.zeros(1 << bits, bool)
        self.bits[self.hashes >> self.shift] = True

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = self.bits[hashes >> self.shift]
        some = np.flatnonzero(out)
        if len(some):
            at = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
            out[some] = self.hashes[at] == hashes[some]
        return out


class Tokens:
    """The tokens of many texts in a row: text, plain hash, slot type without names, with them, and with
    those that open a sentence."""

    def __init__(self, texts: list[bytes]):
        words, sizes = split_words(texts)
        words = words.dictionary_encode()
        found = words.indices.to_numpy()
        doc = np.repeat(np.arange(len(texts)), sizes)
        hashes, flags = (fact[found] for fact in word_facts(words.dictionary))
        # A token opens a sentence if it is the first, or if a stop stands between it and the
        # token before it, bare punctuation included.
        stops = np.concatenate([[0], np.cumsum(flags & STOP > 0)])[:-1]
        used = flags & SKIP == 0
        self.doc, self.hash, flags = doc[used], hashes[used], flags[used]
        stops = stops[used]
        first = np.ones(len(self.doc), bool)
        first[1:] = (self.doc[1:] != self.doc[:-1]) | (stops[1:] > stops[:-1])
        before = np.zeros(len(flags), np.uint8)
        before[1:] = np.where(self.doc[1:] == self.doc[:-1], flags[:-1], 0)
        slot = np.where(flags & (NUMERIC | MEASURE) > 0, SLOT_NUMBER, 0).astype(np.int8)
        slot[(flags & UNIT > 0) & (before & NUMERIC > 0)] = SLOT_UNIT
        self.slot, self.named = slot, slot.copy()
        title = (slot == 0) & (flags & TITLE > 0)
        self.named[title & ~first] = SLOT_NAME
        self.opened = np.where(title, SLOT_NAME, slot)
        self.sizes = np.bincount(self.doc, minlength=len(texts))

    def codes(self, types: np.ndarray) -> np.ndarray:
        return np.where(types > 0, SLOTS[types], self.hash)

    @staticmethod
    def _literals(types: np.ndarray, size: int) -> np.ndarray:
        """Words of each window."""
        literal = np.concatenate([[0], np.cumsum(types == 0)])
        return literal[size:] - literal[:-size]

    def classes(self) -> Iterator[int]:
        """Per text a hash of its codes, of its names, of which of its slots (possible names too) hold equal
        values, and of the values that are hashed as they are: equal in all readings but for values."""
        ends, codes = offsets(self.sizes), self.codes(self.slot)
        for a, b in zip(ends[:-1], ends[1:]):
            size = min(b - a, WINDOW)
            if size >= LITERALS:
                for p in (a + np.flatnonzero(self._literals(self.slot[a:b], size) < LITERALS)).tolist():
                    codes[p : p + size] = self.hash[p : p + size]
            slots, pattern = self.opened[a:b] > 0, np.full(b - a, -1, np.int64)
            _, first, which = np.unique(self.hash[a:b][slots], return_index=True, return_inverse=True)
            pattern[slots] = first[which]
            known = codes[a:b].tobytes() + pattern.tobytes() + self.named[a:b].tobytes()
            yield xxh64_intdigest(known) - (1 << 63)

    def values(self) -> Iterator[np.ndarray]:
        """Per text the plain hash of each slot, possible names too, in order."""
        ends = offsets(self.sizes)
        for a, b in zip(ends[:-1], ends[1:]):
            yield self.hash[a:b][self.opened[a:b] > 0]

    def windows(
        self, size: int, probe: Probe | None
    ) -> Iterator[tuple[int, int, int, int, np.ndarray, int]]:
        """(text, place, size, hash, slot values, kind) of the windows that the probe holds."""
        n = len(self.doc) - size + 1
        if n <= 0:
            return
        starts = np.concatenate([[0], np.cumsum(self.sizes)])
        whole = self.doc[:n] == self.doc[size - 1 :]
        few = self._literals(self.slot, size) < min(LITERALS, size)
        readings = [
            (BASE, self.slot, self.codes(self.slot), ~few),
            (EXACT, self.slot, self.hash, few),
            (BASE, self.named, self.codes(self.named), None),
            (OPENED, self.opened, self.codes(self.opened), None),
        ]
        seen: list[np.ndarray] = []
        for kind, types, codes, use in readings:
            if use is None:
                use = self._literals(types, size) >= min(LITERALS, size)
            use = use & whole
            if not use.any():
                continue
            hashes = window_hashes(codes, size)
            for other in seen:
                use &= hashes != other
            seen.append(hashes)
            at = np.flatnonzero(use)
            if probe is not None:
                at = at[probe.holds(hashes[at])]
            for p in at.tolist():
                run = slice(p, p + size)
                values = np.where(types[run] > 0, self.hash[run], 0)
                doc = int(self.doc[p])
                yield doc, p - int(starts[doc]), size, int(hashes[p]), values, kind


def _signed(values: np.ndarray) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


def _batch(rows: list[tuple], lead: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    hashes = np.array([r[3] for r in rows], np.uint64)
    values = [_signed(r[4]).tolist() for r in rows]
    return pa.RecordBatch.from_arrays(
        [
            *lead,
            pa.array([r[1] for r in rows], pa.int32()),
            pa.array([r[2] for r in rows], pa.int32()),
            pa.array(_signed(hashes), pa.int64()),
            pa.array(values, pa.list_(pa.int64())),
            pa.array([r[5] for r in rows], pa.int32()),
        ],
        names,
    )


def item_classes(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Every item with its class and the values of its slots in order: class, item, text, values."""
    kind = items.schema[item].dataType.simpleString()

    def templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, values = [], []
            for _, texts in slices(batch, "text"):
                read = Tokens(texts)
                classes.extend(read.classes())
                values.extend(_signed(v).tolist() for v in read.values())
            columns = [pa.array(classes, pa.int64()), *batch.columns, pa.array(values, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["class", "item", "text", "values"])

    raw = items.select(F.col(item).alias("item"), as_bytes(text).alias("text"))
    return raw.mapInArrow(templates, f"class long, item {kind}, text binary, values array<long>")


def _first_of_class(classed: DataFrame) -> DataFrame:
    one = F.min(F.struct("item", "text", "values")).alias("one")
    return classed.groupBy("class").agg(one).select("class", "one.*")


def item_windows(classed: DataFrame) -> DataFrame:
    """Windows of one item per class: class, item, n_tokens, at, size, hash, slots, kind.

    They find the documents of the whole class; :func:`links` gives the other items their links.
    """
    kind = classed.schema["item"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch, "text"):
                read = Tokens(texts)
                own = np.minimum(read.sizes, WINDOW)
                rows = [
                    r
                    for size in range(LITERALS, WINDOW + 1)
                    for r in read.windows(size, None)
                    if own[r[0]] == size
                ]
                lead = [
                    *[c.take(pa.array([first + r[0] for r in rows], pa.int64())) for c in batch.columns[:2]],
                    pa.array([read.sizes[r[0]] for r in rows], pa.int32()),
                ]
                names = ["class", "item", "n_tokens", "item_at", "size", "hash", "item_slots", "item_kind"]
                yield _batch(rows, lead, names)

    return _first_of_class(classed).select("class", "item", "text").mapInArrow(
        cut,
        f"class long, item {kind}, n_tokens int, item_at int, size int, hash long, item_slots array<long>, item_kind int",
    )


CLASS = ["class", "item", "n_tokens"]


def _aligned(docs: DataFrame, classed: DataFrame, doc: str, text: str) -> DataFrame:
    """Consistent alignments of documents with classes that cover enough: doc, text_hash, class, item,
    n_tokens, n_covered, pairs (of a value of the item and the document's value for it)."""
    known = materialise(item_windows(classed), "windows")
    hashes = known.select("hash", "size").distinct()
    sizes = [r[0] for r in hashes.select("size").distinct().collect()]  # at most WINDOW
    probe = None
    if hashes.count() <= PROBE:
        found = hashes.select("hash").toArrow()["hash"].to_numpy().astype(np.int64)
        probe = Probe(found.view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast(probe)
    kind = docs.schema[doc].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = shared.value
        for batch in batches:
            ids = batch.column(0)
            for first, texts in slices(batch, "text"):
                if sizes:
                    read = Tokens(texts)
                    rows = [r for size in sizes for r in read.windows(size, probe)]
                    picked = [first + r[0] for r in rows]
                    names = ["doc", "text_hash", "doc_at", "size", "hash", "doc_slots", "doc_kind"]
                    texts_hash = [xxh64_intdigest(texts[r[0]]) for r in rows]
                    lead = [
                        ids.take(pa.array(picked, pa.int64())),
                        pa.array(_signed(np.array(texts_hash, np.uint64)), pa.int64()),
                    ]
                    yield _batch(rows, lead, names)

    scanned = docs.select(F.col(doc).alias("doc"), as_bytes(text).alias("text")).mapInArrow(
        scan,
        f"doc {kind}, text_hash long, doc_at int, size int, hash long, doc_slots array<long>, doc_kind int",
    )
    pairs = F.filter(
        F.zip_with("item_slots", "doc_slots", lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        lambda p: (p["a"] != 0) | (p["b"] != 0),
    )
    covered = F.sequence("item_at", F.col("item_at") + F.col("size") - 1)
    hits = (
        scanned.join(known, ["hash", "size"])
        .select(
            "doc", "text_hash", *CLASS,
            (F.col("doc_at") - F.col("item_at")).alias("shift"),
            pairs.alias("pairs"), covered.alias("covered"),
            F.greatest("item_kind", "doc_kind").alias("kind"),
        )
    )

    def joined(values: str, kinds: tuple[int, ...]) -> F.Column:
        return F.array_distinct(F.flatten(F.collect_set(F.when(F.col("kind").isin(*kinds), F.col(values)))))

    # One group is one alignment of one item: it holds no more windows than the item has tokens, for
    # each kind and reading.
    lined = hits.groupBy("doc", "text_hash", *CLASS, "shift").agg(
        F.array(
            *[
                F.struct(joined("pairs", v).alias("pairs"), F.size(joined("covered", v)).alias("n_covered"))
                for v in VIEWS
            ]
        ).alias("views")
    )
    lined = lined.select("doc", "text_hash", *CLASS, F.inline("views"))
    values = F.array_distinct(F.transform("pairs", lambda p: p["a"]))
    return lined.filter(
        (F.col("n_covered") >= F.least(F.lit(COVER), "n_tokens")) & (F.size(values) == F.size("pairs"))
    )


def matches(
    docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id"
) -> DataFrame:
    """Contaminated (document, item class) pairs.

    Columns: doc, text_hash, class, item (of least id), n_tokens (of the item), n_covered, n_changed (slot
    values that differ). ``doc`` and ``text_hash`` name the document.
    """
    good = _aligned(docs, item_classes(items, item), doc, text)
    good = good.withColumn("n_changed", F.size(F.filter("pairs", lambda p: p["a"] != p["b"])))
    best = F.max_by(F.struct("n_covered", "n_changed"), F.struct("n_covered", -F.col("n_changed")))
    return (
        good.groupBy("doc", "text_hash", *CLASS).agg(best.alias("b"))
        .select("doc", "text_hash", *CLASS, "b.n_covered", "b.n_changed")
    )


def links(
    docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id"
) -> DataFrame:
    """Contaminated (document, item) pairs, with every item of a class: the columns of :func:`matches`.

    Items of a class have their slots at the same places, equal at the same places, so a value of the
    first item stands for one value of each other item, and an alignment with the one holds for all.
    """
    classed = materialise(item_classes(items, item), "classes")
    # One list holds the alignments of a document with an item: no more than it has windows.
    found = _aligned(docs, classed, doc, text).groupBy("doc", "text_hash", "class", "n_tokens").agg(
        F.max("n_covered").alias("n_covered"), F.collect_list(F.struct("n_covered", "pairs")).alias("all")
    )
    best = F.filter("all", lambda e: e["n_covered"] == F.col("n_covered"))
    first = _first_of_class(classed).select("class", F.col("values").alias("from"))
    member = classed.join(first, "class").select(
        "class", "item", F.map_from_entries(F.array_distinct(F.arrays_zip("from", "values"))).alias("own")
    )

    def changed(e):
        return F.size(F.filter(e["pairs"], lambda p: F.coalesce(F.col("own")[p["a"]], p["a"]) != p["b"]))

    paired = found.withColumn("all", best).join(member, "class")
    return paired.select(
        "doc", "text_hash", *CLASS, "n_covered", F.array_min(F.transform("all", changed)).alias("n_changed")
    )


def decontaminate(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without contaminated rows."""
    bad = matches(docs, items, doc, text).select("doc", "text_hash").distinct()

    def start():
        def make(batch: pa.RecordBatch) -> list[pa.Array]:
            hashes = [xxh64_intdigest((t or "").encode()) for t in column(batch, text)]
            return [pa.array(_signed(np.array(hashes, np.uint64)), pa.int64())]

        return make

    keyed = add_columns(docs, [T.StructField("__text_hash", T.LongType())], start)
    same = keyed[doc].eqNullSafe(bad["doc"]) & (keyed["__text_hash"] == bad["text_hash"])
    return keyed.join(bad, same, "left_anti").drop("__text_hash")


def op2_templates(spark, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with every such item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = links(docs, items)
    return found.select(
        F.col("doc").alias("doc_id"),
        F.col("item").alias("item_id"),
        F.col("n_tokens").cast("long"),
        F.col("n_covered").cast("long"),
        F.col("n_changed").cast("long"),
    ).distinct()
