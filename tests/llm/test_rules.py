"""Operators 1 and 3 against plain Python and numpy."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cutline.llm import outliers, personal
from tests.llm.cases import SCHEMA, clashing, edge_docs, edge_rows, no_docs, save

SF = "/root/testdata/sf0.01"


def statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for k, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            covered |= {k, k + 1, k + 2}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def failed(s):
    return s[0] < 50 or 100 * s[4] > 50 * s[0]


def vector(s):
    n, chars, symbols, lines, repeats = s
    rates = [math.log1p(100 * symbols / (chars + 1)), math.log1p(100 * lines / (n + 1))]
    return [math.log1p(n), math.log((chars + 1) / (n + 1)), *rates, math.log1p(100 * repeats / (n + 1))]


def quantile_bin(bins, share):
    bins = np.sort(bins)
    return bins[math.ceil(len(bins) * share) - 1]


def plain_mcd(x):
    """Mean and covariance (floored) by the operator's rules, in matrix form."""
    floor = np.diag(np.square(outliers.FLOORS))
    med = np.array([(quantile_bin(np.floor(c * 64), 0.5) + 0.5) / 64 for c in x.T])
    mad = np.array([(quantile_bin(np.floor(c * 64), 0.5) + 0.5) / 64 * 1.4826 for c in np.abs(x - med).T])
    s = np.maximum(mad, outliers.FLOORS)
    soft = np.cov(np.tanh((x - med) / s).T, bias=True)
    ridge = np.diag(soft) + 1e-3
    tied = soft / np.sqrt(np.outer(ridge, ridge))
    np.fill_diagonal(tied, 1)
    best = None
    for mean, cov in [(med, np.diag(s * s)), (med, tied * np.outer(s, s)), (x.mean(0), np.cov(x.T, bias=True))]:
        cov = cov + floor
        for _ in range(outliers.STEPS):
            off = x - mean
            d2 = np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off)
            bins = np.floor(np.log(d2 + 1e-6) * outliers.BINS)
            bulk = x[bins <= quantile_bin(bins, outliers.BULK)]
            mean, cov = bulk.mean(0), np.cov(bulk.T, bias=True) * outliers.CONSISTENCY + floor
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0] - 1e-9:
            best = det, mean, np.linalg.inv(cov)
    return best[1:]


def test_op1(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(10_000 + k, *r[1:]) for k, r in enumerate(edge_rows())]
    folder = save(spark.createDataFrame(rows, SCHEMA), tmp_path)
    got = Counter((r.doc_id, *[r[s] for s in outliers.STATS], r.base_failed) for r in outliers.op1_outliers(spark, folder).collect())
    want = Counter((r[0], *statistics(r[1]), failed(statistics(r[1]))) for r in rows)
    assert got == want


def test_op1_distances(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: (statistics(r.text), r.lang, r.source) for r in docs.collect()}
    good = {i: np.array(vector(s)) for i, (s, *_) in rows.items() if not failed(s)}
    groups = defaultdict(list)
    for i in good:
        for g in (("all",), rows[i][1:2], rows[i][1:]):
            groups[g].append(i)
    fits = {}
    got = {r.doc_id: r for r in outliers.op1_outliers(spark, SF).collect()}
    assert set(got) == set(rows)
    for i, r in got.items():
        if i not in good:
            assert not r.kept and r.distance is None
            continue
        g = next(g for g in (rows[i][1:], rows[i][1:2], ("all",)) if len(groups[g]) >= outliers.LEAST_ROWS)
        if g not in fits:
            fits[g] = plain_mcd(np.array([good[k] for k in groups[g]]))
        mean, inverse = fits[g]
        want = (good[i] - mean) @ inverse @ (good[i] - mean)
        assert r.distance == pytest.approx(want, rel=1e-6, abs=1e-6)
        assert r.kept == (want <= outliers.CUTOFF)
    assert len(fits) > 1


def test_op1_rejects_a_bad_cluster(spark):
    """A tenth of a source in another shape does not pull the estimate to itself."""
    rows = [(k, " ".join(f"w{(k * 31 + j * j) % 997}" for j in range(60 + k % 90)), "en", "s", 0) for k in range(300)]
    rows += [(1000 + k, " ".join(f"###{j}$$$%%%&&&***" for j in range(80 + k)), "en", "s", 0) for k in range(30)]
    got = {r.doc_id: r.kept for r in outliers.judge(clashing(spark.createDataFrame(rows, SCHEMA), "distance", "v0")).collect()}
    assert not any(got[1000 + k] for k in range(30))
    assert sum(got[k] for k in range(300)) >= 299


def test_op1_rejects_for_one_statistic_alone(spark):
    """Planted texts that differ from the bulk in their symbols or their repeats only."""
    make = lambda k, n: [f"w{1000 * (k % 9 + 1) + j}a" for j in range(n)]
    rows = [(k, " ".join(make(k, 60 + k % 90)), "en", "s", 0) for k in range(300)]
    for k in range(5):
        words = make(k, 90 + k)
        rows.append((1000 + k, " ".join(words + words[:12]), "en", "s", 0))
        rows.append((2000 + k, " ".join(w[:-1] + "|" for w in words), "en", "s", 0))
    got = {r.doc_id: r for r in outliers.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(got[k].base_failed for k in got)
    assert [k for k in got if k >= 1000 and got[k].kept] == []
    assert sum(got[k].kept for k in range(300)) >= 299


def test_op1_native_and_empty(spark, tmp_path):
    assert outliers.op1_outliers(spark, save(no_docs(spark), tmp_path)).count() == 0
    plan = outliers.with_statistics(edge_docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            double = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 13 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in double) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


HARD = [
    "a@b.c_d@e.f", "x.y@z @@ a@b", "1.2.3.4.5.6.7.8", "001.02.3.255 256.1.1.1", "4111 1111 1111 1111x4111-1111-1111-1111",
    "+1 (415) 555-0100, +1", "++12345678901+123456789", "\U0001f600 me@x.org", "4785380592391139 152.143.123.131", "1" * 3000,
    "a" * 3000 + "@", "a@b." * 500, "1.2.3." * 400,
]


def test_op3_patterns(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(20_000 + k, *r[1:]) for k, r in enumerate(edge_rows())]
    rows += [(30_000 + k, t, "en", "s", 0) for k, t in enumerate(HARD)]
    got = personal.op3_personal(spark, save(spark.createDataFrame(rows, SCHEMA), tmp_path)).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        want = plain_spans(texts[r.doc_id])
        kinds = Counter(s.split(":")[0] for s in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds[k] for k in PATTERNS], r.doc_id
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) | ({""} - set(want)) or not want
    clean = [r for r in got if r.doc_id < 20_000 and not plain_spans(texts[r.doc_id])]
    assert not any(r.spans for r in clean)


def test_op3_skip_links_carry_labels(spark):
    rows = []
    for k in range(200):
        phone = f"+1 415 555 {1000 + 37 * k}"
        rows.append((k, f"call {phone} now. some words and then again call {phone} today", "en", "s", 0))
        rows.append((1000 + k, f"order {3_000_000 + 7919 * k} was shipped", "en", "s", 0))
    field = personal.train(spark.createDataFrame(rows, SCHEMA))
    late = "reach me at +1 415 555 7777 please. " + "word " * 200 + "call 415-555-7777 today"
    tests = [(1, late, "en", "s", 0), (2, "word " * 200 + "order 415-555-7777 today", "en", "s", 0), (3, None, "en", "s", 0)]
    df = clashing(spark.createDataFrame(tests, SCHEMA), "spans")
    got = {r.doc_id: r.spans for r in personal.find(df, field).collect()}
    assert [(s.kind, s.base) for s in got[1]] == [("phone", True), ("phone", False)]
    assert late[got[1][1].start : got[1][1].end] == "415-555-7777"
    assert got[2] == [] and got[3] == []


def test_op3_no_rows(spark, tmp_path):
    assert personal.op3_personal(spark, save(no_docs(spark), tmp_path)).count() == 0
