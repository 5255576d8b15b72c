"""Operators 2, 7 and 8 and the pipeline against brute force."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cutline.llm import graph, lines, near, templates
from tests.llm.cases import SCHEMA, clashing, edge_docs, edge_rows, no_docs, prose, save

SF = "/root/testdata/sf0.01"


def grouped(n, pairs):
    """Least member of each member's component."""
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return [top(k) for k in range(n)]


def similar(sets, share):
    """All pairs at or above ``share`` per cent."""
    owners = {}
    for k, s in enumerate(sets):
        for x in s:
            owners.setdefault(x, []).append(k)
    common = Counter()
    for own in owners.values():
        common.update((b, a) for i, a in enumerate(own) for b in own[:i])
    return [(a, b) for (a, b), n in common.items() if 100 * n >= share * (len(sets[a]) + len(sets[b]) - n)]


def shingles(text):
    w = (text or "").encode().lower().split()
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def families():
    """Exact copies, near copies, chains of near copies, and texts that share a passage."""
    rows, passage = [], prose(60, 999)
    for f in range(6):
        base = prose(120, 100 + f).split()
        for k in range(12):
            words = list(base)
            for j in range(k % 4):
                words[(17 * j + 13 * k) % 120] = f"x{k}"
            rows.append(" ".join(words))
        chain = list(base)
        for k in range(8):  # each step is similar to the last one, the ends are not
            chain[k * 14 : k * 14 + 2] = [f"c{k}", f"d{k}"]
            rows.append(" ".join(chain))
    rows += [passage + " " + " ".join(f"t{k}w{j}" for j in range(10 + k)) for k in range(60)]
    return [(k, t, "en", "s", 0) for k, t in enumerate(rows)]


def check_op7(spark, folder, rows):
    got = near.op7_bottom_k(spark, folder).collect()
    sets = [shingles(r[1]) for r in rows]
    classes = {}
    of = [classes.setdefault(frozenset(s) if s else k, len(classes)) for k, s in enumerate(sets)]
    distinct = [()] * len(classes)
    for k, s in zip(of, sets):
        distinct[k] = s
    comps = grouped(len(classes), similar(distinct, 75))
    least = {}
    for k, r in zip(of, rows):
        if r[0] is not None:
            least[comps[k]] = min(least.get(comps[k], r[0]), r[0])
    want = Counter((r[0], len(s), least.get(comps[k])) for r, s, k in zip(rows, sets, of))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.component_id is not None and r.doc_id is not None)
    return got


def test_op7(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    check_op7(spark, SF, [tuple(r) for r in docs])


def test_op7_families_and_edges(spark, tmp_path):
    rows = families()
    check_op7(spark, save(spark.createDataFrame(rows, SCHEMA), tmp_path / "f"), rows)
    check_op7(spark, save(edge_docs(spark), tmp_path / "e"), edge_rows())
    assert near.op7_bottom_k(spark, save(no_docs(spark), tmp_path / "n")).count() == 0


def test_op7_unequal_sizes_near_the_threshold(spark, tmp_path):
    """Sets a little above a sketch in size, one the longer by a third: 0.75 to 0.78."""
    rows = []
    for k in range(400):
        long = 84 + 4 * (k % 12)
        short = -(-long * (75 + k % 4) // 100)
        words = [f"p{k}w{j}" for j in range(long + 4)]
        rows += [(2 * k, " ".join(words), "en", "s", 0), (2 * k + 1, " ".join(words[: short + 4]), "en", "s", 0)]
    got = check_op7(spark, save(spark.createDataFrame(rows, SCHEMA), tmp_path), rows)
    assert sum(r.kept for r in got) == 400


def test_op7_documents(spark):
    left = near.documents(clashing(edge_docs(spark), "node", "comp", "digest")).collect()
    words = [r.text for r in left if (r.text or "").encode().split()]
    assert len(words) == len(set(words))
    assert {"node", "comp", "digest"} <= set(left[0].asDict())
    assert {r.doc_id for r in left} == {r[0] for r in edge_rows()} - {10}


def test_components(spark):
    pairs = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (95, 100), (7, 7), (200, 210), (210, 205)]
    got = dict(graph.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 95: 90, 100: 90, 200: 200, 205: 200, 210: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def line_set(line):
    x = b" ".join(line.lower().encode().split())
    x += b"\n" * (8 - len(x))
    return x, frozenset(x[k : k + 8] for k in range(len(x) - 7))


def has_word(line):
    return re.search(r"[^\x20\x09-\x0D]", line) is not None


def plain_lines(rows):
    """Text left of each (id, text)."""
    order = sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows if r[1]})
    kinds = {}
    for *_, text in order:
        for x in text.split("\n"):
            if has_word(x):
                kinds.setdefault(line_set(x), len(kinds))
    comps = grouped(len(kinds), similar([s for _, s in kinds], 80))
    seen, out = set(), {}
    for none, i, text in order:
        keep = []
        for x in text.split("\n"):
            comp = comps[kinds[line_set(x)]] if has_word(x) else None
            if comp is None or comp not in seen:
                keep.append(x)
            seen.add(comp)
        out[None if none else i, text] = "\n".join(keep)
    return out


def test_op8(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(5000 + (r[0] or 0), *r[1:]) for r in edge_rows() if r[0] is not None]
    folder = save(spark.createDataFrame(rows, SCHEMA), tmp_path)
    want = plain_lines(rows)
    got = Counter((r.doc_id, r.text_sha256) for r in lines.op8_lines(spark, folder).collect())
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert got == Counter((r[0], digest(want.get((r[0], r[1]), r[1]))) for r in rows)
    assert sum(t != k[1] for k, t in want.items()) > 20


def test_op8_bands_find_pairs_at_the_threshold():
    """20,000 pairs of lines of similarity 0.8: each shares a band."""
    both = []
    for k in range(20_000):
        digest = hashlib.sha256(str(k).encode()).hexdigest()
        both += [digest[:39].encode(), (digest[:39] + digest[-8:]).encode()]
    sets = [lines.shingle_set(x) for x in both[:2]]
    assert len(sets[0] & sets[1]) == 0.8 * len(sets[0] | sets[1])
    keys = lines.signatures(both)[0]
    missed = int((keys[::2] != keys[1::2]).all(axis=1).sum())
    assert missed <= 4, missed


def test_op8_small(spark, tmp_path):
    rows = [
        (2, "Subscribe to our weekly newsletter today!\nunique words in this line here", "en", "s", 1),
        (1, "first line of all\nSubscribe to our weekly newsletter today.\n\n  \nEnd", "en", "s", 1),
        (3, "subscribe to our  weekly newsletter today!\nend", "en", "s", 1),
        (4, None, "en", "s", 1),
        (None, "END\n", "en", "s", 1),
    ]
    got = {r.doc_id: r for r in lines.deduplicate(clashing(spark.createDataFrame(rows, SCHEMA), "n_lines")).collect()}
    assert got[1].text == rows[1][1] and got[2].text == "unique words in this line here"
    assert got[3].text == "" and got[3].n_removed == got[3].n_lines == 2
    assert got[4].text is None and got[None].text == ""
    assert lines.op8_lines(spark, save(no_docs(spark), tmp_path)).count() == 0


def bare(text):
    words = (re.sub(r"^[\W_]+|[\W_]+$", "", w).lower() for w in re.split(r"[\x20\x09-\x0D]+", text or ""))
    return [w for w in words if w]


def test_op2(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    runs = {}
    for i, t in items:
        w = bare(t)
        for k in range(len(w) - templates.COVER + 1):
            runs.setdefault(tuple(w[k : k + templates.COVER]), set()).add(i)
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w = bare(r.text)
        for k in range(len(w) - templates.COVER + 1):
            want |= {(r.doc_id, i) for i in runs.get(tuple(w[k : k + templates.COVER]), ())}
    got = {(r.doc_id, r.item_id) for r in templates.op2_templates(spark, SF).collect()}
    assert got == want and len(want) > 5


ITEM = (
    "A train leaves Paris at 9 and travels 120 km to reach Lyon. If the train from Paris stops 2 times for 5 min, "
    "when will it arrive in Lyon after 9 in the morning?"
)
NEW = ITEM.replace("Paris", "Berlin").replace("Lyon", "Munich").replace("9", "11").replace("120 km", "350 km")


def test_op2_templates(spark):
    other = "words before this. " + " ".join(f"word{chr(97 + k % 26)}" for k in range(30)) + ". "
    docs = [
        (1, other + ITEM + " " + other),
        (2, other + NEW),  # new names and numbers, the same question
        (3, other + NEW.replace("after 11", "after 7").replace("from Berlin", "from Rome")),  # slots contradict
        (4, other + ITEM.lower()),
        (5, other * 3),
        (6, other + " *** ".join(ITEM.split())),
        (7, None), (8, ""), (None, ITEM), (1, other + ITEM + " " + other),
        (9, "what is the capital of France"),
    ]
    items = [(1, ITEM), (7, NEW), (8, ITEM.replace("120", "95")), (2, "What is the capital of Peru"), (3, None), (4, ""), (5, "Is 3 4 5 6?")]
    docs = clashing(spark.createDataFrame(docs, "doc_id long, text string"), "doc", "item")
    items = clashing(spark.createDataFrame(items, "item_id long, text string"), "hash")
    found = {(r.doc, r.item): r for r in templates.matches(docs, items).collect()}
    assert {k for k in found if k[1] != 7} == {(1, 1), (2, 1), (4, 1), (6, 1), (None, 1), (9, 2)}
    assert {(1, 7), (2, 7), (None, 7)} <= set(found)  # other names, the same template
    assert found[1, 1].n_changed == 0 and found[2, 1].n_changed >= 4
    left = templates.decontaminate(docs, items)
    assert sorted(r.doc_id for r in left.collect()) == [3, 5, 7, 8]
    assert left.columns == docs.columns


def test_op2_items_of_one_template(spark):
    """Every item is found by its own copy, whichever of its numbers are equal."""
    make = "A farmer sells {} apples and {} pears at the market on monday and then buys {} bags of corn".format
    values = [(3, 3, 3), (3, 5, 5), (3, 5, 3), (3, 3, 5), (3, 5, 7), (9, 9, 9)]
    items = spark.createDataFrame([(k, make(*v)) for k, v in enumerate(values)], "item_id long, text string")
    docs = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("some words before. "), "text").alias("text"))
    found = {(r.doc, r.item): r.n_changed for r in templates.matches(docs, items).collect()}
    assert all(found[k, k] == 0 for k in range(5)) and (5, 0) in found
    assert {i for _, i in found} == set(range(5))  # the last item is in the class of the first
    assert templates.decontaminate(docs, items).count() == 0


DENSE = [
    "What is 12 + 34 - 5 * 6?",
    "What is 12 + 34 - 5 * 7?",
    "Add 3 kg 4 kg 5 kg 6 kg 7 kg 8 kg 9 kg then 10 kg",
    "Rows 1 2 3 4 5 6 7 8 9 10 11 12 13 of the table in the annex show how many tons of grain were sold in may",
]


def test_op2_dense_items_and_opening_names(spark):
    people = "Martha has 12 small red apples today. Martha gives 5 apples to him now. Martha buys 7 more of them."
    items = spark.createDataFrame([*enumerate(DENSE), (10, people)], "item_id long, text string")
    other = "some words of another kind stand here before it. "
    texts = [other + t + " and more words" for t in DENSE] + [other + "what is 12 + 34 - 5 * 8?"]
    texts += [other + people.replace("Martha", "Oliver"), other + people.replace("Martha", "Oliver", 1)]
    texts += [other + DENSE[3].replace("13", "99")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc, r.item): r.n_changed for r in templates.matches(docs, items).collect()}
    assert {k: found.get((k, k)) for k in range(4)} == dict.fromkeys(range(4), 0)
    assert not any(d == 4 or d < 2 and i < 2 and d != i for d, i in found)
    assert found[5, 10] == 1  # the name
    assert found[6, 10] == 0 and (7, 3) in found  # the rest is verbatim and long enough


def test_op2_large_benchmark_and_empty(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(1, prose(40, 1)), (2, prose(40, 2))], "doc_id long, text string")
    items = spark.createDataFrame([(1, prose(40, 1)), (2, "")], "item_id long, text string")
    monkeypatch.setattr(templates, "PROBE", 0)
    assert [(r.doc, r.item) for r in templates.matches(docs, items).collect()] == [(1, 1)]
    assert templates.matches(docs, items.limit(0)).count() == 0
    save(items, tmp_path, "benchmark")
    assert templates.op2_templates(spark, save(no_docs(spark), tmp_path)).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = corpus_pipeline.materialise(stage(spark, before, SF), name)
        assert path.columns == docs.columns, name
        rows = path.collect()
        sizes.append(len(rows))
        texts = {r.doc_id: r.text for r in before.collect()}
        if name == "language":
            assert {r.doc_id for r in rows} == set(texts) or len(rows) > 0.95 * len(texts)
        if name == "line_dedup":
            want = plain_lines([(i, t) for i, t in texts.items()]) if len(texts) < 300 else None
            assert want is None or all(r.text == want[r.doc_id, texts[r.doc_id]] for r in rows)
            assert all(r.n_chars == len(r.text) for r in rows)
        if name == "near_dedup":
            ids, sets = list(texts), [shingles(t) for t in texts.values()]
            comps = grouped(len(ids), similar(sets, 75))
            heads = {min(ids[k] for k in range(len(ids)) if comps[k] == c) for c in set(comps)}
            assert {r.doc_id for r in rows} == heads
        if name == "decontaminate":
            bad = {r.doc for r in templates.matches(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert {r.doc_id for r in rows} == set(texts) - bad
        before = path
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 700
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert last.filter("NOT round_trip").count() == 0 and last.count() == sizes[-1]


@pytest.mark.parametrize("make", [edge_docs, no_docs])
def test_pipeline_edges(spark, tmp_path, make):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, save(make(spark), tmp_path)).collect()
    assert (len(got) > 3) == (make is edge_docs)


def test_shared_passages_make_no_pairs(spark, monkeypatch):
    """Texts with a common passage and a fifth of their own are told apart without pairs of them."""
    passage = prose(80, 7)
    rows = [(k, passage + " " + " ".join(f"own{k}w{j}" for j in range(20))) for k in range(120)]
    made, write = {}, graph.materialise

    def counted(df, label="cut"):
        out = write(df, label)
        made[label] = out.count()
        return out

    monkeypatch.setattr(graph, "materialise", counted)
    got = near.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.doc == r.component for r in got)
    assert made["stars"] < 2 * len(rows) and made["rest"] == 0


def test_op2_links_every_item_of_a_class(spark, tmp_path):
    """Items that differ in numbers, capitals or not at all: each has its own link and changed values."""
    make = "A farmer sells {} apples and {} pears at the market on monday and then buys {} bags of corn".format
    texts = [make(3, 3, 3), make(9, 9, 9), make(4, 5, 6), make(7, 8, 2), make(9, 9, 9), make(3, 3, 3).replace("apples", "Apples")]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("some words before. "), "text").alias("text"))
    save(items, tmp_path, "benchmark")
    found = {(r.doc_id, r.item_id): r.n_changed for r in templates.op2_templates(spark, save(docs, tmp_path)).collect()}
    same, other = {0, 1, 4, 5}, {2, 3}
    assert {(d, i) for d in same for i in same} | {(d, i) for d in other for i in other} <= set(found)
    assert all(found[k, k] == 0 for k in range(6)) and found[1, 4] == found[4, 1] == 0
    assert found[1, 0] == found[0, 1] == found[0, 4] == 1 and found[2, 3] == found[3, 2] == 3


def test_op2_units_that_stand_for_names_elsewhere(spark):
    """A value at a slot and as a word elsewhere is one value in one item and two in another."""
    make = "After 5 {} of rest the Hours bakery in the old town sells bread with butter to all its guests".format
    items = spark.createDataFrame([(0, make("hours")), (1, make("minutes"))], "item_id long, text string")
    doc = make("days").replace("Hours", "Weeks")
    docs = spark.createDataFrame([(0, "words before it. " + doc)], "doc_id long, text string")
    assert 1 in {r.item for r in templates.links(docs, items).collect()}


def test_lists_of_few_nodes_need_no_sets(spark, monkeypatch):
    """Nodes of short lists meet directly; only those of long lists are listed by their elements."""
    base = prose(60, 9).split()
    edit = lambda k: " ".join([*base[:k], f"e{k}a", f"e{k}b", *base[k + 2 :]])
    own = [" ".join(f"d{k}w{j}" for j in range(9)) for k in range(40)]
    texts = [f"{own[k]}\n{edit(3 * (k % 13))}" for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    opened, prefixes = [], graph._prefixes

    def counted(data, *rest):
        opened.append(data.count())
        return prefixes(data, *rest)

    monkeypatch.setattr(graph, "_prefixes", counted)
    want = None
    for few in (graph.FEW, 1):
        monkeypatch.setattr(graph, "FEW", few)
        got = {(r.doc, r.at) for r in lines.duplicate_lines(docs).collect()}
        want = want or got
        assert got == want
    assert opened[0] == 0 and want == {(k, 1) for k in range(1, 40)}


def test_band_keys_are_not_kept_with_the_lines(spark):
    """What is written of a line is its place; its band keys go to their buckets as packed records."""
    docs = spark.createDataFrame([(1, "one line of some words\none line of some words!\nother")], "doc_id long, text string")
    assert lines.occurrences(docs, "doc_id", "text").columns == ["h1", "h2", "doc", "digest", "at"]
    line = [b"one line of some words", b"one line of some words!", b"other"]
    packed = lines._packed(line)
    assert sum(map(len, packed.column(1).to_pylist())) == 12 * lines.BANDS * len(line)
    keys = lines.signatures(line)[0]
    shared = int((keys[0] == keys[1]).sum())
    assert shared and lines._lists(docs, "text").count() == 2 * shared


def test_copies_edited_in_different_places_make_few_pairs(spark, monkeypatch):
    """Copies too far from their original to be linked with it meet only those with the same edits."""
    base = prose(70, 11).split()

    def edited(k, places):
        return " ".join(f"e{k}x{j}" if j in places else w for j, w in enumerate(base))

    texts = [" ".join(base)]
    texts += [edited(k, {7 * k % 70}) for k in range(60)]
    texts += [edited(k, {(k + 9 * j * (1 + k % 4)) % 70 for j in range(5)}) for k in range(60, 160)]
    texts += [texts[k] + f" t{k}" for k in range(100, 130)]  # near a far copy alone
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    made, write = {}, graph.materialise

    def counted(df, label="cut"):
        out = write(df, label)
        made[label] = out.count()
        return out

    monkeypatch.setattr(graph, "materialise", counted)
    got = {(r.doc, r.at) for r in lines.duplicate_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = plain_lines(rows)
    assert got == {(k, 0) for k, t, *_ in rows if want[k, t] == ""}
    assert len(got) > 60 and made["rest"] < 2000, (len(got), made["rest"])


def test_op8_products_order_as_independent_hashes():
    """Minima of lines of similarity 0.8 agree in 64 of 80 cases with binomial spread; keys come from them alone."""
    both = []
    for k in range(4000):
        digest = hashlib.sha256(f"m{k}".encode()).hexdigest()
        both += [digest[:39].encode(), (digest[:39] + digest[-8:]).encode()]
    least = lines.minima(both)
    agree = (least[:, ::2] == least[:, 1::2]).sum(axis=0)
    assert abs(agree.mean() - 64) < 0.3 and 11.5 < agree.var() < 14.5
    assert (lines.band_keys(least) == lines.signatures(both)[0]).all()
