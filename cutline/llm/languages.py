"""Language shares of a document by expectation-maximisation over n-gram likelihoods.

Training counts byte trigrams of lower-cased words per language (hashed to a fixed number of
features). A document is a mixture: each word comes from one language, with the probability
of its trigrams there; EM finds the shares. The language set is grown one language at a time, in
order of its share, as long as the penalised likelihood ``-2 log L + m log(words)`` falls.

Edge cases: NULL and empty texts and texts without a letter are ``und`` with score 0 and no
shares; so is everything if nothing was learned; words without a letter say nothing about
the language; languages with equal shares go by name; repeated rows stay; empty tables stay
empty; input columns named like output columns are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutline.llm.batches import WordTable, add_columns, column, offsets, slices, split_words

FEATURES = 1 << 16
SMOOTHING = 0.5
ROUNDS = 12
SMALL = 0.02  # a share below this cannot pay for its language
MOST_LANGUAGES = 200  # bounds the model: 200 x 65,536 numbers of 4 bytes
LATIN = re.compile("[A-Za-z]")


@dataclass
class Model:
    """Log-probabilities of the features, a row per language in order of name."""

    names: list[str]
    logs: np.ndarray


def lowered(text: str | None) -> bytes:
    return text.lower().encode("utf-8", "replace") if text else b""


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(LATIN.search(text)) or any(map(str.isalpha, text)))


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature of every trigram of the words (with one blank on either side), and its word."""
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    blank = data == 32
    mid = np.flatnonzero(~blank[1:-1]) + 1
    code = (
        data[mid - 1].astype(np.uint32) << np.uint32(16)
        | data[mid].astype(np.uint32) << np.uint32(8)
        | data[mid + 1]
    )
    feature = (code * np.uint32(2654435761)) >> np.uint32(16)
    return feature.astype(np.int64), np.cumsum(blank)[mid] - 1


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts features of all rows with a language. Only the counts reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = column(batch, lang)
            for first, texts in slices(batch, text):
                words, sizes = split_words([lowered(t) for t in texts])
                words = words.dictionary_encode()
                distinct, numbers = words.dictionary.to_pylist(), words.indices.to_numpy()
                if not distinct:
                    continue
                feature, word = grams(distinct)
                own = np.array(langs[first : first + len(texts)], object)
                for name in set(own):
                    used = numbers[np.repeat(own == name, sizes)]
                    weight = np.bincount(used, minlength=len(distinct))[word]
                    sums = totals.setdefault(name, np.zeros(FEATURES))
                    sums += np.bincount(feature, weights=weight, minlength=FEATURES)
        for name, sums in totals.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(at), pa.string()),
                    pa.array(at.astype(np.int32)),
                    pa.array(sums[at].astype(np.int64)),
                ],
                ["lang", "feature", "n"],
            )

    rows = labelled.select(text, lang).filter(F.col(lang).isNotNull())
    counted = rows.mapInArrow(count, "lang string, feature int, n long")
    counted = counted.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counted["lang"].to_pylist()))
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"{len(names)} languages; the model holds {MOST_LANGUAGES}")
    sums = np.zeros((len(names), FEATURES))
    number = {name: k for k, name in enumerate(names)}
    at = [number[x] for x in counted["lang"].to_pylist()]
    sums[at, counted["feature"].to_numpy()] = counted["n"].to_numpy()
    sums += SMOOTHING
    return Model(names, np.log(sums / sums.sum(1, keepdims=True)).astype(np.float32))


class Mixture:
    """EM over the words of many documents at once."""

    def __init__(self, model: Model):
        self.model = model
        logs = model.logs.T.copy()

        def facts(words: list[bytes]) -> list[np.ndarray]:
            feature, word = grams(words)
            starts = np.searchsorted(word, np.arange(len(words)))
            sums = np.add.reduceat(logs[feature], starts, axis=0)
            plain = [w.isalpha() or has_letter(w.decode("utf-8", "replace")) for w in words]
            return [sums * np.array(plain, np.float32)[:, None]]

        self.table = WordTable(facts)

    def shares(self, texts: list[str | None]) -> list[list[tuple[str, float]]]:
        """Languages and shares per text, largest first."""
        none: list[list[tuple[str, float]]] = [[] for _ in texts]
        if not self.model.names:
            return none
        docs = [k for k, t in enumerate(texts) if has_letter(t)]
        if not docs:
            return none
        found, sizes = self.table.number([lowered(texts[k]) for k in docs])
        ends = offsets(sizes)
        logs = self.table.fact(0)[found]
        top = logs.max(1)
        like = np.exp(logs - top[:, None])
        base = np.add.reduceat(top.astype(np.float64), ends[:-1])
        allowed = np.ones((len(docs), len(self.model.names)), bool)
        full, _ = self.fit(like, ends, allowed)
        order = np.argsort(-full, axis=1, kind="stable")
        best_share, best_cost = np.zeros_like(full), np.full(len(docs), np.inf)
        live = np.arange(len(docs))
        for m in range(1, len(self.model.names) + 1):
            if m > 1:
                live = live[full[live, order[live, m - 1]] >= SMALL]
            if not len(live):
                break
            some = np.zeros((len(live), full.shape[1]), bool)
            np.put_along_axis(some, order[live, :m], True, axis=1)
            rows = np.concatenate([np.arange(ends[k], ends[k + 1]) for k in live])
            share, log = self.fit(like[rows], offsets(sizes[live]), some, 1 if m == 1 else ROUNDS)
            cost = -2 * (log + base[live]) + m * np.log(sizes[live])
            better = cost < best_cost[live]
            live = live[better]
            best_share[live], best_cost[live] = share[better], cost[better]
        for k, share in zip(docs, best_share):
            at = np.lexsort((np.arange(len(share)), -share))
            none[k] = [(self.model.names[i], min(1.0, float(share[i]))) for i in at if share[i] > 0]
        return none

    @staticmethod
    def fit(
        like: np.ndarray, ends: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS
    ) -> tuple[np.ndarray, np.ndarray]:
        """Shares and log-likelihood per document; only the allowed languages get a share."""
        sizes = np.diff(ends)
        share = (allowed / allowed.sum(1, keepdims=True)).astype(np.float32)
        tiny = np.float32(1e-30)
        for _ in range(rounds):
            each = like * np.repeat(share, sizes, axis=0)
            each /= each.sum(1, keepdims=True) + tiny
            share = np.add.reduceat(each, ends[:-1], axis=0) / sizes[:, None].astype(np.float32)
            share *= allowed
            share /= share.sum(1, keepdims=True) + tiny
            share = np.where(share.sum(1, keepdims=True) > 0, share, allowed / allowed.sum(1, keepdims=True)).astype(np.float32)
        total = (like * np.repeat(share, sizes, axis=0)).sum(1).astype(np.float64)
        return share, np.add.reduceat(np.log(total + 1e-300), ends[:-1])


def detect(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with lang_pred, score (its share) and languages (every language and its share)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = T.ArrayType(
        T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())])
    )
    fields = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("languages", kind),
    ]

    def start():
        mixture = Mixture(shared.value)

        def make(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [s for _, texts in slices(batch, text) for s in mixture.shares(texts)]
            lists = [[{"lang": n, "share": s} for n, s in f] for f in found]
            of = pa.struct([("lang", pa.string()), ("share", pa.float64())])
            return [
                pa.array([f[0][0] if f else "und" for f in found], pa.string()),
                pa.array([f[0][1] if f else 0.0 for f in found], pa.float64()),
                pa.array(lists, pa.list_(of)),
            ]

        return make

    return add_columns(df, fields, start)


def held_out(doc_id: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text falls into the part kept from training."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(name.cast("binary")) % parts == part


def op10_languages(spark, sf_dir: str) -> DataFrame:
    """Trains on the documents outside the held-out part and predicts all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out()))
    found = detect(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
