"""Language-model scores by a probabilistic suffix tree over words, kept as tables.

A text is its lower-cased words (A-Z) and an end symbol; a begin symbol stands before it. A context is
a run of up to ``DEPTH`` symbols before the next one. Contexts are grown level by level: a
candidate was seen at least ``FLOOR`` times, and both the context without its first symbol and the one
without its last are in the tree. It is retained if its next-symbol counts diverge from its
parent's distribution (the context without its first symbol): the sum over occurrences of
``ln p(symbol | context) / p(symbol | parent)``, each occurrence left out of the counts that predict it,
must reach ``COST``. Both limits are absolute, so the tree grows with the corpus.

Each distribution is smoothed with its parent's by absolute discounting. Next symbols seen once in a
context (under ``LEAST``) count as part of the mass left to the parent:

    p(s | c) = (n - D) / N + B / N p(s | parent),  p(s | c) = B / N p(s | parent) if n < LEAST

with B the discounts plus the occurrences under ``LEAST``. The root is the add-one unigram of the base. The
log probability under the longest retained suffix is then a sum of terms that do not depend on
each other: the base term of the symbol, ``log10 B / N`` of each retained suffix, and for each seen
(suffix, symbol) what it gains over backing off. A retained suffix is a run of symbols that ended at the
symbol before, so its term is kept with that run. A text's score is the sum of the terms of the runs that
it holds, of 1 to ``DEPTH`` + 1 symbols: one join by key, whatever the depth.

Nothing of the size of the corpus is gathered: counts, contexts and terms are tables. Tasks get bit tables
of fixed size that tell which keys cannot be in a table, the hashes of the ``NAMED`` most frequent symbols and the
terms of the ``FREQUENT`` most used keys (24 bytes each). What tasks count, and the other keys that a text holds, go to
``BUCKETS`` buckets by hash as packed records, where no key is hot: a run of up to three named symbols as their
numbers of 20 bits, any other by its hashes. Symbols and contexts are compared by 64-bit hashes.

Edge cases: NULL, empty and blank texts are the end symbol alone; with no training text
base and score are 0; repeated rows each get a row; an empty table stays empty; only the key and text
columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cutline.llm.batches import MIX, as_bytes, buffers_of, column, hash_runs, mix, offsets, slices, split_words
from cutline.llm.graph import BITS, has_bit
from cutline.llm.languages import held_out
from cutline.session import discard, materialise

DEPTH = 3  # symbols of the longest context
FLOOR = 4  # occurrences of a context
LEAST = 2  # occurrences of a next symbol in a context that gets a term of its own
DISCOUNT = 0.75
COST = 5.0  # nats that a context must gain
FREQUENT = 2_000_000  # terms that every task gets
NUMBER = 20  # bits of the number of a symbol
NAMED = (1 << NUMBER) - 2  # symbols that have a number, besides the begin
BUCKETS = 1 << 12  # of runs and keys: a bucket is what a task holds at once
RUN = 1 << 20  # bytes of text that are hashed at once
HELD = 1 << 20  # positions that a task counts at once
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def raw_text(text: str) -> F.Column:
    """The input of ``learn``: the bytes of a text, NULL as no bytes."""
    return as_bytes(text).alias("__text")


def _joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of a run of symbols from those of the run without its last and without its first."""
    return mix(first * MIX + second)


@dataclass
class Index:
    """Places of hashes in a sorted array of them, by way of their leading bits."""

    keys: np.ndarray
    starts: np.ndarray
    shift: np.uint64

    @classmethod
    def of(cls, keys: np.ndarray) -> Index:
        bits = max(1, len(keys).bit_length())
        shift = np.uint64(64 - bits)
        lead = (keys >> shift).astype(np.int32)
        return cls(keys, np.searchsorted(lead, np.arange((1 << bits) + 1, dtype=np.int32)).astype(np.int32), shift)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it is not among the keys."""
        found = np.full(len(hashes), -1, np.int64)
        lead = (hashes >> self.shift).astype(np.int64)
        at, end = self.starts[lead], self.starts[lead + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            hit = self.keys[here] == hashes[left]
            found[left[hit]] = here[hit]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return found


@dataclass
class Symbols:
    """Symbols of some texts, one after the other; ``place`` is 0 at the begin of each text, and ``numbers``
    the place among the names from 1 on, 0 if a symbol is none of them."""

    doc: np.ndarray
    place: np.ndarray
    hashes: np.ndarray
    numbers: np.ndarray | None

    @classmethod
    def of(cls, texts: list[bytes], names: Index | None = None) -> Symbols:
        words, sizes = split_words([t.lower() for t in texts])
        words = words.dictionary_encode()
        starts = offsets(int(n) + 2 for n in sizes)
        doc = np.repeat(np.arange(len(texts)), sizes + 2)
        place = np.arange(starts[-1]) - starts[doc]
        inside = np.ones(starts[-1], bool)
        inside[starts[:-1]] = inside[starts[1:] - 1] = False
        own = hash_runs(*buffers_of(words.dictionary)) if len(words) else np.zeros(0, np.uint64)

        def spread(of_words: np.ndarray, begin: np.uint64, end: np.uint64) -> np.ndarray:
            column = np.empty(len(inside), np.uint64)
            column[starts[:-1]], column[starts[1:] - 1] = begin, end
            if len(words):
                column[inside] = of_words[words.indices.to_numpy()]
            return column

        hashes, numbers = spread(own, BEGIN, END), None
        if names is not None:
            numbers = (names.find(np.append(own, [BEGIN, END])) + 1).astype(np.uint64)
            numbers = spread(numbers[:-2], *numbers[-2:])
        return cls(doc, place, hashes, numbers)

    def contexts(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For contexts of ``k`` symbols what ``levels`` gives of them, without the hash of all."""
        runs = self.hashes
        for _ in range(k - 1):
            runs = np.concatenate([runs[:1], _joined(runs[:-1], runs[1:])])
        return self.place[1:] >= k, runs[:-1], runs[1:]

    def levels(self, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For contexts of 1 to ``depth`` symbols, at each position from the second on: whether the
        text reaches back so far; hashes of the context, of the run without its first symbol, and of all."""
        runs = self.hashes
        for k in range(1, depth + 1):
            context, rest = runs[:-1], runs[1:]
            whole = _joined(context, rest)
            yield self.place[1:] >= k, context, rest, whole
            runs = np.concatenate([runs[:1], whole])


def _numbers(symbols: Symbols, k: int) -> np.ndarray:
    """At each position from the second on, the numbers of the last ``k`` + 1 symbols in one, 0 if one has none."""
    own = symbols.numbers
    code, whole = own, own > 0
    for _ in range(k):
        code = np.concatenate([own[:1], code[:-1] << np.uint64(NUMBER) | own[1:]])
        whole = np.concatenate([whole[:1], whole[:-1] & (own[1:] > 0)])
    return np.where(whole, code, np.uint64(0))[1:]


def _named(codes: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs without the last and without the first symbol, from the numbers of ``k`` + 1 symbols."""
    parts = [codes >> np.uint64(NUMBER * j) & np.uint64((1 << NUMBER) - 1) for j in range(k, -1, -1)]
    runs = [names[part.astype(np.int64) - 1] for part in parts]
    while len(runs) > 2:
        runs = [_joined(x, y) for x, y in zip(runs, runs[1:])]
    return runs[0], runs[1]


def _sums(columns: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of one or two columns, and the sum of ``n`` of each (how often it occurs if None)."""
    if n is None and len(columns) == 1:
        columns = [np.sort(columns[0])]
    else:
        order = np.argsort(columns[0] if len(columns) == 1 else _joined(*columns))
        columns = [c[order] for c in columns]
        n = n[order] if n is not None else None
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    first = np.flatnonzero(new)
    if n is None:
        n = np.diff(np.append(first, len(new)))
    elif len(first):
        n = np.add.reduceat(n, first)
    return [c[first] for c in columns], n


def _packed(bucket: np.ndarray, columns: list[np.ndarray], widths: tuple[int, ...]) -> tuple[np.ndarray, list[bytes]]:
    """The buckets that occur, and for each its records: the low ``widths`` bytes of 8-byte numbers.

    All first bytes of a bucket come first, then all second ones: alike bytes are neighbours and compress.
    """
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    records = np.concatenate(
        [c[order].view(np.uint8).reshape(-1, 8)[:, w - 1 :: -1] for c, w in zip(columns, widths)], axis=1
    )
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(first, len(bucket))
    return bucket[first], [records[x:y].T.tobytes() for x, y in zip(ends[:-1], ends[1:])]


def _unpacked(blobs: list[bytes], widths: tuple[int, ...]) -> list[np.ndarray]:
    """The columns of all records, as 8-byte numbers."""
    wide = sum(widths)
    planes = np.concatenate([np.frombuffer(b, np.uint8).reshape(wide, -1) for b in blobs], axis=1)
    columns, at = [], 0
    for w in widths:
        raw = np.zeros((planes.shape[1], 8), np.uint8)
        raw[:, :w] = planes[at : at + w][::-1].T
        columns.append(raw.view(np.uint64)[:, 0])
        at += w
    return columns


def _times(columns: list[np.ndarray], n: np.ndarray) -> list[np.ndarray]:
    """The columns with ``n`` as the last one, a row again for each 255 of it."""
    more = (n - 1) // 255
    last = np.cumsum(more + 1) - 1
    each = np.full(int((more + 1).sum()), 255, np.uint64)
    each[last] = n - 255 * more
    return [*(np.repeat(c, more + 1) for c in columns), each]


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(52)).astype(np.int16)


def _by_bucket(rows: DataFrame, schema: str, order: list[str], make: Callable) -> DataFrame:
    """What ``make(batches)`` yields of rows with a ``bucket``, those of a bucket one after the other."""
    return rows.repartition("bucket").sortWithinPartitions(*order).mapInArrow(make, schema)


def _merged(rows: DataFrame, schema: str, make: Callable[[int, list[bytes]], pa.RecordBatch]) -> DataFrame:
    """``make(bucket, blobs)`` of all rows (bucket, data) of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs = None, []
        for batch in batches:
            for own, blob in zip(column(batch, "bucket"), column(batch, "data")):
                if own != bucket and blobs:
                    yield make(bucket, blobs)
                    blobs = []
                bucket = own
                blobs.append(blob)
        if blobs:
            yield make(bucket, blobs)

    return _by_bucket(rows, schema, ["bucket"], run)


def _bits(ids: DataFrame, name: str) -> np.ndarray:
    """``bit_table`` of hashes, whose places go to their buckets as two bytes each."""
    wide = BITS // BUCKETS

    def batch_of(parts: list[np.ndarray]) -> pa.RecordBatch:
        place = _sums([np.concatenate(parts)])[0][0]
        bucket, blobs = _packed((place // wide).astype(np.int16), [place % wide], (2,))
        return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            parts.append(batch.column(0).to_numpy() & (BITS - 1))
            held += batch.num_rows
            if held >= HELD:
                yield batch_of(parts)
                parts, held = [], 0
        if held:
            yield batch_of(parts)

    def marked(bucket: int, blobs: list[bytes]) -> pa.RecordBatch:
        bits = np.zeros(wide, bool)
        bits[_unpacked(blobs, (2,))[0].astype(np.int64)] = True
        data = pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), data], ["bucket", "data"])

    schema = "bucket int, data binary"
    found = _merged(ids.select(name).mapInArrow(run, schema), schema, marked).toArrow()
    table = np.zeros((BUCKETS, wide // 8), np.uint8)
    for bucket, data in zip(found["bucket"].to_pylist(), found["data"].to_pylist()):
        table[bucket] = np.frombuffer(data, np.uint8)
    return table.reshape(-1).view(np.int64)


def _counted(
    training: DataFrame, find: Callable, widths: tuple[tuple[int, ...], ...], schema: str, finish: Callable
) -> DataFrame:
    """Rows of ``schema``, made by ``finish(kind, columns, n)`` of counted rows.

    ``find(texts)`` gives the columns of each kind of rows, and last how often each occurs or None;
    ``widths`` has the bytes of the numbers in the columns.
    """
    fields = [f.split()[0] for f in schema.split(", ")]

    def batch_of(parts: list) -> Iterator[pa.RecordBatch]:
        for kind, own in enumerate(zip(*parts)):
            *columns, n = zip(*own)
            columns = [np.concatenate(c) for c in columns]
            if len(columns[0]):
                columns = _times(*_sums(columns, None if n[0] is None else np.concatenate(n)))
                mixed = columns[0] if len(columns) == 2 else _joined(columns[0], columns[1])
                bucket, blobs = _packed(_buckets(mix(mixed)), columns, (*widths[kind], 1))
                bucket = bucket.astype(np.int32) + kind * BUCKETS
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(blobs, pa.binary())], ["bucket", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for _, texts in slices(batch, "__text", RUN):
                parts.append(find(texts))
                held += sum(len(columns[0]) for columns in parts[-1])
                if held >= HELD:
                    yield from batch_of(parts)
                    parts, held = [], 0
        if held:
            yield from batch_of(parts)

    def summed(bucket: int, blobs: list[bytes]) -> pa.RecordBatch:
        kind = bucket // BUCKETS
        *columns, n = _unpacked(blobs, (*widths[kind], 1))
        made = finish(kind, *_sums(columns, n.astype(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in made], fields)

    return _merged(training.mapInArrow(run, "bucket int, data binary"), schema, summed)


def _words(texts: list[bytes]) -> tuple[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the distinct symbols after the begin, and how often each occurs."""
    words = split_words([t.lower() for t in texts])[0].dictionary_encode()
    n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary)) if len(words) else np.zeros(0, int)
    own = hash_runs(*buffers_of(words.dictionary)) if len(words) else np.zeros(0, np.uint64)
    return ((np.append(own, END), np.append(n, len(texts))),)


def _most_used(rows: DataFrame, uses: str, most: int) -> F.Column:
    """Whether a row is one of the most used, at most ``most`` in all: a class of like use is taken whole or not."""
    n = F.col(uses)
    kind = F.when(n < 1024, n).otherwise(F.floor(F.log2(n) * 8) + 1024)
    left, least = most, None
    for r in sorted(rows.groupBy(kind.alias("kind")).count().collect(), reverse=True):
        left -= r["count"]
        if left < 0:
            break
        least = r["kind"]
    return F.lit(False) if least is None else kind >= least


def _names(words: DataFrame) -> Index:
    """The most frequent symbols, in order of their hashes: the place is the number."""
    top = words.filter(_most_used(words, "n", NAMED)).select("gram").toArrow()["gram"].to_numpy()
    return Index.of(np.sort(np.append(top.view(np.uint64), BEGIN)))


def _grams(training: DataFrame, k: int, candidates: DataFrame, known: DataFrame, names) -> DataFrame:
    """(context, rest, n, gram) at least ``LEAST`` times seen, at candidate contexts of ``k`` symbols.

    ``rest``, the gram at the parent, is seen as often and must be known there. Rows that only the bit
    tables let pass are left to the joins that follow. ``names`` is a broadcast of ``_names``.
    """
    context = training.sparkSession.sparkContext
    possible = context.broadcast(_bits(candidates, "context"))
    parents = context.broadcast(_bits(known.filter(F.col("n") >= LEAST), "gram"))
    fits = (k + 1) * NUMBER <= 64

    def find(texts: list[bytes]) -> tuple[tuple[np.ndarray | None, ...], ...]:
        symbols = Symbols.of(texts, names.value if fits else None)
        inside, ctx, rest = symbols.contexts(k)
        found = np.flatnonzero(inside & has_bit(possible.value, ctx.view(np.int64)))
        found = found[has_bit(parents.value, rest[found].view(np.int64))]
        if not fits:
            return (ctx[:0], None), (ctx[found], rest[found], None)
        codes = _numbers(symbols, k)[found]
        long = found[codes == 0]
        return (codes[codes > 0], None), (ctx[long], rest[long], None)

    def finish(kind: int, columns: list[np.ndarray], n: np.ndarray) -> list[np.ndarray]:
        seen = n >= LEAST
        columns, n = [c[seen] for c in columns], n[seen]
        ctx, rest = columns if kind else _named(columns[0], names.value.keys, k)
        return [ctx, rest, n, _joined(ctx, rest)]

    widths = ((-(-(k + 1) * NUMBER // 8) if fits else 8,), (8, 8))
    return _counted(training, find, widths, "context long, rest long, n long, gram long", finish)


def _retained(grams: DataFrame) -> DataFrame:
    """(context, total, mass) of contexts that pass the divergence test.

    ``grams`` has context, n, total (occurrences of the context) and p_rest (of the parent).
    """
    sums = grams.groupBy("context").agg(
        F.first("total").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("seen")
    )
    single = F.col("total") - F.col("seen")
    sums = sums.select("context", "total", single.alias("single"), (DISCOUNT * F.col("kinds") + single).alias("mass"))
    one_less = F.col("n") - 1
    backed = F.when(one_less < LEAST, F.col("mass") - DISCOUNT + one_less).otherwise(F.col("mass"))
    own = F.when(one_less < LEAST, 0.0).otherwise(one_less - DISCOUNT)
    ratio = (own / F.col("p_rest") + backed) / (F.col("total") - 1)
    of_single = F.when(
        F.col("single") > 0, F.col("single") * F.log((F.col("mass") - 1) / (F.col("total") - 1))
    ).otherwise(0.0)
    gains = (
        grams.select("context", "n", "p_rest").join(sums, "context")
        .groupBy("context")
        .agg(
            F.sum(F.col("n") * F.log(ratio)).alias("gain"),
            F.first(of_single).alias("of_single"),
            F.first("total").alias("total"),
            F.first("mass").alias("mass"),
        )
    )
    return gains.filter(F.col("gain") + F.col("of_single") >= COST).select("context", "total", "mass")


@dataclass
class Tree:
    """``terms``: (key, uses, word, tree) of runs; ``word`` is the base term of one symbol (over 0 if known),
    ``tree`` what the run gains, and in a second row what it costs as the context of the next symbol.
    ``contexts``: (context, level, backed)."""

    terms: DataFrame
    contexts: DataFrame
    total: int
    distinct: int

    @property
    def denominator(self) -> int:
        return self.total + self.distinct + 1


def learn(training: DataFrame) -> Tree:
    """The tree of a table with the bytes of each text in ``__text``."""
    words = materialise(
        _counted(training, _words, ((8,),), "gram long, n long", lambda _, columns, n: [*columns, n]),
        "words",
    )
    names = training.sparkSession.sparkContext.broadcast(_names(words))
    sums = words.agg(F.sum("n"), F.count("n")).first()
    total, distinct = sums[0] or 0, sums[1]
    begins = words.filter(F.col("gram") == int(END.view(np.int64))).select(
        F.lit(int(BEGIN.view(np.int64))).alias("gram"), "n"
    )
    known = words.withColumn("p", (F.col("n") + 1) / F.lit(float(total + distinct + 1)))
    sources = words.select("gram", "n", F.log10(F.col("n") + 1).alias("word"), F.lit(0.0).alias("tree"))
    sources = sources.unionByName(begins.withColumns({"word": F.lit(0.0), "tree": F.lit(0.0)}))
    terms, contexts = sources, None
    for k in range(1, DEPTH + 1):
        candidates = sources.filter(F.col("n") >= FLOOR).select(
            F.col("gram").alias("context"), F.col("n").alias("total")
        )
        grams = _grams(training, k, candidates, known, names).join(candidates, "context").join(
            known.select(F.col("gram").alias("rest"), F.col("p").alias("p_rest")), "rest"
        )
        grams = materialise(grams.select("context", "gram", "n", "total", "p_rest"), "grams")
        grown = materialise(
            _retained(grams).withColumn("backed", F.log10(F.col("mass") / F.col("total"))), "contexts"
        )
        found = grown.select("context", F.lit(k).alias("level"), "backed")
        contexts = found if contexts is None else contexts.unionByName(found)
        backed = F.col("mass") / F.col("total") * F.col("p_rest")
        p = (F.col("n") - DISCOUNT) / F.col("total") + backed
        kept = grams.join(grown.select("context", "mass"), "context").select(
            "gram", "n", p.alias("p"), F.lit(0.0).alias("word"), (F.log10(p) - F.log10(backed)).alias("tree")
        )
        sources = known = materialise(kept, "kept")
        discard(grams)
        costs = grown.select(
            F.col("context").alias("gram"), F.col("total").alias("n"), F.lit(0.0).alias("word"), F.col("backed").alias("tree")
        )
        terms = terms.unionByName(costs).unionByName(sources.drop("p"))
    terms = terms.select(F.col("gram").alias("key"), F.col("n").alias("uses"), "word", "tree")
    return Tree(terms, contexts, total, distinct)


def _by_key(keys: np.ndarray, *facts: np.ndarray) -> list[np.ndarray]:
    """The distinct keys in order and the sums of their facts."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return [keys[first], *(np.add.reduceat(f[order], first) if len(first) else f for f in facts)]


def _keys(symbols: Symbols, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which symbols may have a term, and (doc, key) of all terms that longer runs may have."""
    alone = found = has_bit(table, symbols.hashes.view(np.int64))
    docs, keys = [], []
    for inside, _, _, whole in symbols.levels(DEPTH):
        # A run has a term only if the run without its first symbol has one.
        found = found[-len(whole):] & inside & has_bit(table, whole.view(np.int64))
        docs.append(symbols.doc[1:][found])
        keys.append(whole[found])
    return alone, np.concatenate(docs), np.concatenate(keys)


def score(df: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of every row of ``df`` under the tree of ``training``.

    Columns: key, n_tokens, n_known, train_tokens, base_score, score.
    """
    raw = raw_text(text)
    tree = learn(training.select(raw))
    often = _most_used(tree.terms, "uses", FREQUENT)
    table = _bits(tree.terms, "key")
    # Spark adds up and sorts: the driver holds the terms once.
    top = tree.terms.filter(often).groupBy("key").agg(F.sum("word").alias("word"), F.sum("tree").alias("tree"))
    top = top.orderBy(F.col("key") < 0, "key").toArrow()
    keys, *facts = (top[c].to_numpy() for c in ("key", "word", "tree"))
    del top
    shared = df.sparkSession.sparkContext.broadcast((table, Index.of(keys.view(np.uint64)), *facts))
    del table, keys, facts

    kind_of_key, kind_of_id = df.schema[key].dataType.simpleString(), to_arrow_type(df.schema[key].dataType)
    made_names = ["__id", "n_tokens", "is_word", "word", "tree"]
    names = ["bucket", "__row", "data", *made_names]
    sums = f"__id {kind_of_key}, n_tokens long, is_word long, word double, tree double"
    schema = f"bucket int, __row long, data binary, {sums}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per text with the sum of its frequent terms, and rows with the other keys of some texts.

        A record has a key and the number of the text after ``__row``.
        """
        table, index, words, gains = shared.value
        part, at = TaskContext.get().partitionId(), 0
        base, rare = 0, []
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(key)).cast(kind_of_id)
            for first, texts in slices(batch, "__text", RUN):
                symbols = Symbols.of(texts, index)
                tokens = np.bincount(symbols.doc, minlength=len(texts)) - 1
                alone, doc, keys = _keys(symbols, table)
                common = symbols.numbers > 0
                alone &= ~common
                own, place = symbols.doc[common], symbols.numbers[common].astype(np.int64) - 1
                known = np.bincount(own[words[place] > 0], minlength=len(texts))
                word, gain = (np.bincount(own, f[place], len(texts)) for f in (words, gains))
                place = index.find(keys)
                found = place >= 0
                gain += np.bincount(doc[found], gains[place[found]], len(texts))
                keys = np.concatenate([symbols.hashes[alone], keys[~found]])
                doc = np.concatenate([symbols.doc[alone], doc[~found]])
                rows = np.arange(at, at + len(texts), dtype=np.int64) + (part << 40)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((rows % BUCKETS + BUCKETS).astype(np.int32)), pa.array(rows),
                        pa.nulls(len(rows), pa.binary()), ids.slice(first, len(texts)),
                        *(pa.array(c.astype(np.int64)) for c in (tokens, known)),
                        *(pa.array(c, pa.float64()) for c in (word, gain)),
                    ],
                    names,
                )
                rare.append((keys, (doc + (at - base)).astype(np.uint64)))
                at += len(texts)
                if sum(len(r[0]) for r in rare) >= HELD // 2 or at - base >= 1 << 23:
                    yield from of_keys(rare, (part << 40) + base)
                    base, rare = at, []
        yield from of_keys(rare, (part << 40) + base)

    def of_keys(rare: list, base: int) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*rare)]
        if columns and len(columns[0]):
            order = np.argsort(columns[0])
            yield blobs_of([c[order] for c in columns], (8, 3), base)

    def blobs_of(columns: list, widths: tuple, base: int, bucket: np.ndarray | None = None) -> pa.RecordBatch:
        bucket, blobs = _packed(_buckets(columns[0]) if bucket is None else bucket, columns, widths)
        none = [pa.nulls(len(blobs), t) for t in (kind_of_id, *[pa.int64()] * 2, *[pa.float64()] * 2)]
        start = pa.array(np.full(len(blobs), base))
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket.astype(np.int32)), start, pa.array(blobs, pa.binary()), *none], names
        )

    def pack_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            parts.append([batch.column(k).to_numpy().view(np.uint64) for k in range(3)])
            held += batch.num_rows
            if held >= HELD // 4:
                yield blobs_of([np.concatenate(c) for c in zip(*parts)], (8, 8, 8), -1)
                parts, held = [], 0
        if held:
            yield blobs_of([np.concatenate(c) for c in zip(*parts)], (8, 8, 8), -1)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of the texts as they are, and records with the sums of texts over some buckets of keys."""
        bucket, blobs, facts, hits, held = None, [], None, [], 0
        for batch in batches:
            own = pc.is_null(batch.column(2))
            yield texts_of(batch, own)
            batch = batch.filter(pc.invert(own))
            for here, base, blob in zip(*(column(batch, c) for c in names[:3])):
                if here != bucket:
                    bucket, blobs, facts = here, [], None
                if base < 0:  # the terms of a bucket come first
                    blobs.append(blob)
                    continue
                if facts is None and blobs:
                    keys, *facts = _unpacked(blobs, (8, 8, 8))
                    facts = _by_key(keys, *(np.ascontiguousarray(f).view(np.float64) for f in facts))
                if facts is None:
                    continue
                keys, doc = _unpacked([blob], (8, 3))
                place = np.minimum(np.searchsorted(facts[0], keys), len(facts[0]) - 1)
                found = facts[0][place] == keys
                if found.any():
                    hits.append((doc[found].astype(np.int64) + base, *(f[place[found]] for f in facts[1:])))
                    held += len(hits[-1][0])
                if held >= HELD // 2:
                    yield sums_of(hits)
                    hits, held = [], 0
        if hits:
            yield sums_of(hits)

    def sums_of(hits: list) -> pa.RecordBatch:
        row, word, gain = (np.concatenate(c) for c in zip(*hits))
        row, of = np.unique(row, return_inverse=True)
        known, word, gain = (np.bincount(of, f, len(row)) for f in (word > 0, word, gain))
        columns = [row.astype(np.uint64), known.astype(np.uint64), word, gain]
        # The bucket of the text's own row.
        return blobs_of(columns, (8, 4, 8, 8), -1, (row % BUCKETS + BUCKETS).astype(np.int16))

    def texts_of(batch: pa.RecordBatch, own: pa.Array) -> pa.RecordBatch:
        columns = batch.filter(own).columns
        return pa.RecordBatch.from_arrays([*columns[:3], columns[3].cast(kind_of_id), *columns[4:]], names)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of the texts, with all their sums."""
        texts, blobs = [], []
        for batch in batches:
            own = pc.is_null(batch.column(2))
            texts.append(texts_of(batch, own))
            blobs += column(batch.filter(pc.invert(own)), "data")
        texts = pa.Table.from_batches(texts).combine_chunks() if texts else None
        if not texts:
            return
        rows, *sums = (texts[c].to_numpy() for c in ("__row", "is_word", "word", "tree"))
        if blobs:
            row, known, *facts = _unpacked(blobs, (8, 4, 8, 8))
            order = np.argsort(rows)
            at = order[np.searchsorted(rows[order], row.astype(np.int64))]
            facts = [known, *(np.ascontiguousarray(f).view(np.float64) for f in facts)]
            sums = [s + np.bincount(at, f, len(rows)) for s, f in zip(sums, facts)]
        columns = [pa.array(sums[0].astype(np.int64)), *map(pa.array, sums[1:])]
        for name, values in zip(("is_word", "word", "tree"), columns):
            texts = texts.set_column(texts.schema.get_field_index(name), name, values)
        yield from texts.select(made_names).to_batches()

    held = df.select(key, raw).mapInArrow(run, schema)
    rest = tree.terms.filter(~often).select("key", "word", "tree").mapInArrow(pack_terms, schema)
    met = _by_bucket(held.unionByName(rest), schema, ["bucket", "__row"], meet)
    summed = _by_bucket(met, sums, ["bucket"], total)
    base = F.col("word") - F.col("n_tokens") * F.lit(float(np.log10(tree.denominator)))
    return summed.select(
        F.col("__id").alias(key),
        "n_tokens",
        F.col("is_word").alias("n_known"),
        F.lit(tree.total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (base + F.col("tree")).alias("score"),
    )


def op6_suffix_tree(spark, sf_dir: str) -> DataFrame:
    """Learns from the documents outside the held-out part and scores all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept_out = held_out("doc_id", 7, 2)
    return score(docs, docs.filter(~kept_out)).select(
        "doc_id", kept_out.alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score",
    )
