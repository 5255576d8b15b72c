"""Operators 6 and 10 against plain Python, and their held-out quality."""

import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cutline.llm import languages, suffix_tree
from cutline.session import scratch_dir
from tests.llm.cases import clashing, edge_docs, edge_rows, no_docs, save

SF = "/root/testdata/sf0.001"


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def remainder(doc_id, parts):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts


def plain_tree(texts, base):
    """Scorer that grows the tree from its definition and walks to the longest retained suffix."""
    m = suffix_tree
    counts = defaultdict(Counter)
    for ws in texts:
        full = [b"<", *ws, b" "]
        for k in range(1, len(full)):
            for d in range(m.DEPTH + 1):
                if d <= k:
                    counts[tuple(full[k - d : k])][full[k]] += 1
    sizes = {c: sum(v.values()) for c, v in counts.items()}
    kept = {()}

    def mass(c, less=None):
        each = [n - (x == less) for x, n in counts[c].items()]
        return sum(m.DISCOUNT if n >= m.LEAST else n for n in each)

    def p(c, x, less=False):
        if not c:
            return base(x)
        n, size = counts[c][x] - less, sizes[c] - less
        own = n - m.DISCOUNT if n >= m.LEAST else 0.0
        return (own + mass(c, x if less else None) * p(c[1:], x)) / size

    for d in range(1, m.DEPTH + 1):
        grown = set()
        for c in [c for c, n in sizes.items() if len(c) == d and n >= m.FLOOR]:
            if c[1:] in kept and c[:-1] in kept:
                if max(counts[c].values()) < m.LEAST:
                    continue
                gain = sum(n * math.log(p(c, x, True) / p(c[1:], x)) for x, n in counts[c].items())
                if gain >= m.COST:
                    grown.add(c)
        kept |= grown

    def score(ws):
        full, out = [b"<", *ws, b" "], 0.0
        for k in range(1, len(full)):
            c = tuple(full[max(0, k - m.DEPTH) : k])
            while c not in kept:
                c = c[1:]
            out += math.log10(p(c, full[k]))
        return out

    return score, len(kept)


def check_op6(got, rows, some):
    lowered = [(i, (t or "").encode().lower().split()) for i, t in rows]
    counts, ends = Counter(), 0
    for i, ws in lowered:
        if remainder(i, 7) != 2:
            counts.update(ws)
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    learned = [ws for i, ws in lowered if remainder(i, 7) != 2]
    tree, _ = plain_tree(learned, lambda x: ((ends if x == b" " else counts[x]) + 1) / (n + v + 1))
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    want = []
    for i, ws in lowered:
        each = [counts[w] for w in ws] + [ends]
        base = sum(math.log10((c + 1) / (n + v + 1)) for c in each)
        want.append((i, remainder(i, 7) == 2, len(ws) + 1, sum(c > 0 for c in each), n, base, ws))
    for k, (g, w) in enumerate(zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True)):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)
        if k % some == 0 and len(w[6]) < 5000:
            assert g[6] == pytest.approx(tree(w[6]), rel=1e-6), w[0]


def test_op6(spark):
    got = suffix_tree.op6_suffix_tree(spark, SF).collect()
    check_op6(got, documents(spark), 25)


def test_op6_beats_its_base_and_grows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = suffix_tree.op6_suffix_tree(spark, "/root/testdata/sf0.01").filter("held_out").collect()
    tokens = sum(r.n_tokens for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.02 * tokens
    contexts = []
    for part in (docs.filter("doc_id % 4 = 0"), docs):
        contexts.append(suffix_tree.learn(part.select(suffix_tree.raw_text("text"))).contexts.count())
    assert contexts[1] > 2 * contexts[0] > 0


def test_op6_edges(spark, tmp_path):
    got = suffix_tree.op6_suffix_tree(spark, save(edge_docs(spark), tmp_path)).collect()
    check_op6(got, [(r[0], r[1]) for r in edge_rows()], 1)


def test_op6_rare_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "FREQUENT", 20)
    check_op6(suffix_tree.op6_suffix_tree(spark, SF).collect(), documents(spark), 200)


def test_op6_runs_do_not_matter(spark, monkeypatch):
    docs = edge_docs(spark).select("doc_id", "text").filter("doc_id < 10")
    whole = {r.doc_id: r.score for r in suffix_tree.score(docs, docs).collect()}
    monkeypatch.setattr(suffix_tree, "RUN", 7)
    monkeypatch.setattr(suffix_tree, "HELD", 3)
    parts = {r.doc_id: r.score for r in suffix_tree.score(docs, docs).collect()}
    assert parts == pytest.approx(whole)


def test_op6_records(spark):
    numbers = np.array([3, 1 << 39, 7, 3], np.uint64)
    facts = np.array([0.5, -1.0, 2.0, 0.0])
    buckets, blobs = suffix_tree._packed(np.array([1, 0, 1, 2], np.int16), [numbers, facts], (5, 8))
    assert buckets.tolist() == [0, 1, 2] and [len(b) for b in blobs] == [13, 26, 13]
    first, second = suffix_tree._unpacked(blobs, (5, 8))
    assert first.tolist() == [1 << 39, 3, 7, 3]
    assert np.ascontiguousarray(second).view(np.float64).tolist() == [-1.0, 0.5, 2.0, 0.0]


def test_op6_rows_are_not_joined_key_by_key(spark):
    base = os.path.dirname(scratch_dir(spark).removeprefix("file:"))
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    docs = edge_docs(spark).select("doc_id", "text")
    scored = suffix_tree.score(docs, docs)
    assert "Join" not in scored._jdf.queryExecution().executedPlan().toString()
    left = {d.split("-")[0] for d in set(os.listdir(base)) - before}
    assert "kept" in left and "grams" not in left


def test_op6_nothing_learned(spark, tmp_path):
    assert suffix_tree.op6_suffix_tree(spark, save(no_docs(spark), tmp_path)).count() == 0
    docs = edge_docs(spark).select("doc_id", "text").filter("doc_id = 6")
    row = suffix_tree.score(docs, docs.limit(0)).first()
    assert row.base_score == 0 and row.n_known == 0
    assert row.score == 0


def test_op10(spark):
    got = {r.doc_id: r for r in languages.op10_languages(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [r for r in docs if remainder(r.doc_id, 4) == 2]
    assert {r.doc_id for r in held} == {i for i, r in got.items() if r.held_out}
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_op10_edges(spark, tmp_path):
    got = {r.doc_id: r for r in languages.op10_languages(spark, save(edge_docs(spark), tmp_path)).collect()}
    blank = {i for i, t, *_ in edge_rows() if not any(c.isalpha() for c in t or "")}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == blank
    assert all(got[i].score == 0 for i in blank)


def test_op10_mixture(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = languages.train(docs)
    text = {lang: " ".join(r.text for r in docs.filter(f"lang = '{lang}'").limit(5).collect()) for lang in ("de", "es")}
    mixed = " ".join([*text["de"].split()[:300], *text["es"].split()[:100]])
    rows = [(1, mixed, "x"), (2, text["es"], "x"), (3, "123 456", "x"), (4, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, languages string")
    got = {r.doc_id: r for r in languages.detect(clashing(df, "lang_pred", "score"), model).collect()}
    shares = {s.lang: s.share for s in got[1].languages}
    assert set(shares) == {"de", "es"} and abs(shares["de"] - 0.75) < 0.08
    assert got[1].score == pytest.approx(shares["de"])
    assert [s.lang for s in got[2].languages] == ["es"]
    assert got[3].lang_pred == got[4].lang_pred == "und"


def test_op10_nothing_learned(spark, tmp_path):
    model = languages.train(no_docs(spark))
    assert {r.lang_pred for r in languages.detect(edge_docs(spark), model).collect()} == {"und"}
    assert languages.op10_languages(spark, save(no_docs(spark), tmp_path)).count() == 0
