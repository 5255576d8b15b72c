"""Personal data by patterns, extended by a skip-chain conditional random field.

Patterns find emails, IP addresses, card and phone numbers; their spans are always kept. The field labels
every *mention* (a number run of at least seven digits, or a token with an ``@``) with one
of these kinds or none. Node factors use shape, digits, checks and neighbouring words; chain
factors join neighbouring mentions; skip factors join distant mentions that repeat or resemble
each other (the same digits in another writing, the same address in other capitals). Factors are
estimated piecewise from counts over all documents, with the pattern spans as labels, and
loopy sum-product passing makes labels consistent across a document. A mention that no pattern
has found gets a span if its marginal for a kind is above ``SURE``.

Edge cases: NULL and empty texts have no spans; texts of any length are read whole (all patterns
run in linear time); positions count code points; repeated rows stay; with no mention at all
nothing is learned and only patterns speak; input columns named like output columns are
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutline.llm.batches import add_columns, slices

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)  # label 0: none
LEAST_DIGITS = 7
SURE = 0.5
ROUNDS, DAMPING = 12, 0.3

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive, and never from inside a digit run: the same matches in linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
NUMBER = re.compile(r"[+(]?[0-9](?:[\x20().:/-]{0,2}[0-9])*")
SHAPE = re.compile("[0-9]+")
BEFORE, AFTER = re.compile(r"(\w+)\W*\Z"), re.compile(r"\W*(\w+)")

# Values per feature of a mention; the names stand in the table of counts.
TEMPLATES = {"shape": 256, "digits": 64, "before": 256, "after": 256, "checks": 8}


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all pattern matches, by kind, then start."""
    found = [(1, s, e) for s, e in emails(text)]
    if not DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        if all(map(octet, m[0].split("."))):
            found.append((2, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((3, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(digits_of(m[0])) <= 15:
            found.append((4, m.start(), m.end()))
    return found


@dataclass
class Mention:
    start: int
    end: int
    key: str
    features: tuple[int, ...]
    label: int  # of the pattern span that covers most of it, else 0


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[Mention]:
    """Mentions in text order."""
    places = []
    at, right = text.find("@"), 0
    while at >= 0:
        start, end = at, at + 1
        while start > right and not text[start - 1].isspace() and text[start - 1] != "@":
            start -= 1
        while end < len(text) and not text[end].isspace() and text[end] != "@":
            end += 1
        if start < at and end > at + 1:
            places.append((start, end, "@" + text[start:end].lower().strip(".,;:()<>[]\"'")))
            right = end
        at = text.find("@", end)
    if DIGIT.search(text):
        for m in NUMBER.finditer(text):
            digits = digits_of(m[0]) if m.end() - m.start() >= LEAST_DIGITS else ""
            if len(digits) >= LEAST_DIGITS:
                dotted = m[0].count(".") == 3 and IP.fullmatch(m[0])
                key = m[0] if dotted else digits if len(digits) > 15 else digits[-9:]
                places.append((m.start(), m.end(), key))
    places.sort()
    out, k = [], 0
    spans = sorted((s, e, kind) for kind, s, e in spans)
    for start, end, key in places:
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        best, label = 0, 0
        j = k
        while j < len(spans) and spans[j][0] < end:
            shared = min(end, spans[j][1]) - max(start, spans[j][0])
            if shared > best:
                best, label = shared, spans[j][2]
            j += 1
        out.append(Mention(start, end, key, _features(text, start, end, key), label))
    return out


def _features(text: str, start: int, end: int, key: str) -> tuple[int, ...]:
    own = text[start:end]
    digits = digits_of(own)
    before, after = BEFORE.search(text[max(0, start - 40) : start]), AFTER.match(text[end : end + 40])
    hashed = [crc32(m[1].lower().encode("utf-8", "replace")) % 256 if m else 0 for m in (before, after)]
    shape = crc32(SHAPE.sub("9", own)[:24].encode("utf-8", "replace")) % 256
    dotted = own.count(".") == 3 and IP.fullmatch(own) and all(map(octet, own.split(".")))
    checks = own.startswith("+") + 2 * bool(dotted) + 4 * key.startswith("@")
    return shape, min(len(digits), 31) + 32 * luhn(digits), *hashed, checks


def links(found: list[Mention]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain pairs, and skip pairs: each repeat with the first labelled mention of its key."""
    chain = [(k, k + 1) for k in range(len(found) - 1)]
    anchors: dict[str, int] = {}
    for k, m in enumerate(found):
        if m.key not in anchors or (m.label and not found[anchors[m.key]].label):
            anchors[m.key] = k
    return chain, [(anchors[m.key], k) for k, m in enumerate(found) if anchors[m.key] != k]


@dataclass
class Field:
    """Log-potentials: per template (value x label), chain and skip (label x label)."""

    nodes: list[np.ndarray]
    prior: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, docs: list[list[Mention]]) -> np.ndarray:
        """Label marginals of all mentions of many documents, one document after the other."""
        every = [m for d in docs for m in d]
        known = np.array([m.label for m in every], np.int64)
        theta = np.repeat(self.prior[None], len(every), axis=0)
        for t, table in enumerate(self.nodes):
            theta += table[[m.features[t] for m in every]]
        theta[known > 0] = -1e3  # pattern spans stay
        theta[known > 0, known[known > 0]] = 0
        first, pairs, kinds = 0, [], []
        for d in docs:
            chain, skip = links(d)
            pairs += [(a + first, b + first) for a, b in (*chain, *skip)]
            kinds += [0] * len(chain) + [1] * len(skip)
            first += len(d)
        belief = theta
        if pairs:
            a, b = np.array(pairs, np.int64).T
            src, dst = np.concatenate([a, b]), np.concatenate([b, a])
            table = np.stack([self.chain, self.skip])[np.array(kinds * 2)]
            flip = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
            sent = np.zeros((len(src), LABELS))
            for _ in range(ROUNDS):
                lead = belief[src] - sent[flip]
                new = np.logaddexp.reduce(lead[:, :, None] + table, axis=1)
                new -= np.logaddexp.reduce(new, axis=1)[:, None]
                sent = DAMPING * sent + (1 - DAMPING) * new
                belief = theta + np.stack(
                    [np.bincount(dst, sent[:, y], minlength=len(every)) for y in range(LABELS)], axis=1
                )
        belief = belief - belief.max(1, keepdims=True) if len(belief) else belief
        p = np.exp(belief)
        return p / p.sum(1, keepdims=True) if len(p) else p


def train(df: DataFrame, text: str = "text") -> Field:
    """Counts factors over all rows; a few thousand counts reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, int, int], int] = {}

        def add(*key) -> None:
            totals[key] = totals.get(key, 0) + 1

        for batch in batches:
            for _, texts in slices(batch, text):
                for t in texts:
                    found = mentions(t, base_spans(t)) if t else []
                    for m in found:
                        for name, value in zip(TEMPLATES, m.features):
                            add(name, value, m.label)
                    for name, pairs in zip(("chain", "skip"), links(found)):
                        for a, b in pairs:
                            add(name, found[a].label, found[b].label)
        yield pa.RecordBatch.from_pydict(
            {
                "factor": pa.array([k[0] for k in totals], pa.string()),
                "a": pa.array([k[1] for k in totals], pa.int32()),
                "b": pa.array([k[2] for k in totals], pa.int32()),
                "n": pa.array(list(totals.values()), pa.int64()),
            }
        )

    rows = df.select(text).mapInArrow(count, "factor string, a int, b int, n long")
    tables = {name: np.zeros((size, LABELS)) for name, size in TEMPLATES.items()}
    tables |= {name: np.zeros((LABELS, LABELS)) for name in ("chain", "skip")}
    for factor, a, b, n in rows.groupBy("factor", "a", "b").agg(F.sum("n")).collect():
        tables[factor][a, b] = n
    by_label = tables["shape"].sum(0) + 1
    prior = np.log(by_label / by_label.sum())
    nodes = []
    for name in TEMPLATES:
        smooth = tables[name] + 0.1
        nodes.append(np.log(smooth / smooth.sum(0)))
    pairwise = []
    for name in ("chain", "skip"):
        both = tables[name] + tables[name].T + 0.5
        side = both.sum(1) / both.sum()
        pairwise.append(np.log(both / both.sum() / np.outer(side, side)))
    return Field(nodes, prior, *pairwise)


def find(df: DataFrame, field: Field, text: str = "text", spans: str = "spans") -> DataFrame:
    """``df`` with all spans of each text: kind, start, end (exclusive), and whether a pattern
    found it; by kind, then start."""
    shared = df.sparkSession.sparkContext.broadcast(field)
    of = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
    parts = [("kind", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("base", T.BooleanType())]
    kind = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in parts]))

    def start():
        model = shared.value

        def make(batch: pa.RecordBatch) -> list[pa.Array]:
            out = []
            for _, texts in slices(batch, text):
                base = [base_spans(t) if t else [] for t in texts]
                docs = [mentions(t, b) if t else [] for t, b in zip(texts, base)]
                p, first = model.marginals(docs), 0
                for own, found in zip(base, docs):
                    rows = [(k, s, e, True) for k, s, e in own]
                    for m, marginal in zip(found, p[first : first + len(found)]):
                        best = int(marginal.argmax())
                        if not m.label and best and marginal[best] > SURE:
                            rows.append((best, m.start, m.end, False))
                    first += len(found)
                    rows.sort()
                    out.append([(KINDS[k - 1], *rest) for k, *rest in rows])
            names = [n for n, _ in parts]
            return [pa.array([[dict(zip(names, r)) for r in rows] for rows in out], pa.list_(of))]

        return make

    return add_columns(df, [T.StructField(spans, kind)], start)


def op3_personal(spark, sf_dir: str) -> DataFrame:
    """Counts and positions of personal data per document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, train(docs)).drop("text")

    def count(kind: str):
        hits = F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))
        return F.size(hits).cast("long").alias(f"n_{kind}")

    def joined(spans):
        text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        return F.concat_ws(",", F.transform(spans, text))

    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
