"""Operator 12: all orders of five filters against a document-by-document replay."""

import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np

from cutline.llm import filter_audit as audit
from tests.llm.cases import SCHEMA, clashing, edge_rows, no_docs, prose, save

LABELS = "doc_id long, quality int, toxic int"


def fails(text, copy):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" if len(words) < 200 else ""
    out += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else ""
    out += "D" if re.search(r"[#$%&*|]", text) else ""
    return out + ("E" if copy else "")


def replay(rows, labels):
    """Every measure by running every order over every document."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for doc, text, *_ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    docs = []
    for doc, text, lang, *_ in rows:
        copy = doc is not None and doc > least[text or ""]
        docs.append((lang or "", fails(text or "", copy), doc in good, doc in toxic))
    out, shares = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {d[0] for d in docs}:
            left = [d for d in docs if d[0] == part]
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                every = [d for d in docs if d[0] == part and letter in d[1]]
                only = sum(d[1] == letter for d in every)
                lost = sum(d[2] for d in gone), sum(d[3] for d in gone)
                out[part, order, step] = [len(left), len(gone), len(every) - len(gone), only, *lost]
                shares[part, letter] += len(gone)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def corpus():
    rows = [r[:5] for r in edge_rows()]
    long = " ".join(f"word{k}" for k in range(300))
    rows += [(100 + k, long, "en", None, 1) for k in range(5)]
    rows += [(100, long, "en", None, 1), (100, long, "fr", None, 1), (99, long, None, None, 1), (None, long, "en", None, 1)]
    rows += [(200, long + " # end", "de", None, 1), (201, long.upper(), "de", None, 1), (202, long + " X" * 400, "", None, 1)]
    rows += [(203, prose(500, 4), "de", None, 1), (204, None, "en", None, 1), (205, "", None, None, 1)]
    return rows


def test_op12(spark, tmp_path):
    rows = corpus()
    labels = [(k, k % 2, (k // 2) % 2) for k in range(0, 210, 3)]
    labels += [(100, 1, None), (100, 0, 1), (100, 0, 0), (None, 1, 1), (101, None, None), (9_999, 1, 1)]
    docs = clashing(spark.createDataFrame(rows, SCHEMA), "part", "cell", "digest", "n", "good")
    folder = save(docs, tmp_path)
    save(clashing(spark.createDataFrame(labels, LABELS), "text", "part", "n"), tmp_path, "labels")
    got = audit.op12_filter_audit(spark, folder).collect()
    assert len(got) == len({r[2] or "" for r in rows}) * 600
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == replay(rows, labels)
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    columns = ["part", "filter_order", "step", *audit.MEASURES]
    sql = con.execute(f"SELECT {', '.join(columns)} FROM ({audit.SQL})").fetchall()
    assert sorted(sql) == sorted(tuple(r[c] for c in columns) for r in got)


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], LABELS)
    assert not audit.audit(audit.with_cells(no_docs(spark), empty)).collect()
    docs = spark.createDataFrame(corpus(), SCHEMA)
    rows = audit.audit(audit.with_cells(docs, empty)).collect()
    assert rows and not any(r.good_lost or r.toxic_lost for r in rows)


def test_hot_text_is_dealt_by_id(spark):
    """A text that all rows share meets its least id by (digest, id), not by the digest alone."""
    docs = spark.range(5_000).selectExpr("id AS doc_id", "'same' AS text", "'en' AS lang")
    cells = audit.with_cells(docs, spark.createDataFrame([], LABELS)).collect()
    assert sorted((r.cell, r.n) for r in cells) == [(1 << 0, 1), ((1 << 0) + (1 << 4), 4_999)] or sorted(
        (r.cell, r.n) for r in cells
    ) == [(5, 1), (21, 4_999)]


def test_contraction_is_the_sum_over_cells():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 9, (7, 3, 32))
    made = audit.interactions(counts)
    for z, (order, step) in enumerate([(o, s) for o in audit.ORDERS for s in range(1, 6)]):
        own = audit.LETTERS.index(order[step - 1])
        before = sum(1 << audit.LETTERS.index(x) for x in order[: step - 1])
        hit = np.array([bool(c >> own & 1) for c in range(32)])
        gone = np.array([bool(c & before) for c in range(32)])
        assert (made["removed"][:, z] == counts[:, 0, hit & ~gone].sum(1)).all()
        assert (made["kept"][:, z] == counts[:, 0, ~hit & ~gone].sum(1)).all()
        assert (made["redundant"][:, z] == counts[:, 0, hit & gone].sum(1)).all()
        assert (made["unique_fails"][:, z] == counts[:, 0, 1 << own]).all()
        assert (made["toxic_lost"][:, z] == counts[:, 2, hit & ~gone].sum(1)).all()
