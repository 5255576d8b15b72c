"""Operators 4, 5 and 9 against the libraries and against plain Python."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cutline.llm import pieces, shards, token_files
from tests.llm.cases import clashing, edge_docs, edge_rows, no_docs, save

SF = "/root/testdata/sf0.001"


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.mark.parametrize("edges", [True, False])
def test_op4(spark, tmp_path, edges):
    folder = save(edge_docs(spark), tmp_path) if edges else SF
    rows = [(r[0], r[1]) for r in edge_rows()] if edges else documents(spark)
    sp = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model")
    )
    want = Counter()
    for doc_id, text in rows:
        ids = sp.encode(text or "")
        joined = ",".join(map(str, ids)).encode()
        decoded = sp.decode(ids).encode()
        want[
            (doc_id, len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded).hexdigest())
        ] += 1
    assert Counter(map(tuple, pieces.op4_pieces(spark, folder).collect())) == want


def test_op4_table_is_renewed():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        table = pieces.PieceTable(file.read(), limit=3)
    for text in ("a b c d", "d  e", "f g h i", ""):
        assert table.ids([text])[0].tolist() == table.model.encode(text)


def test_op4_empty_and_clashing(spark):
    assert pieces.decode(pieces.encode(no_docs(spark))).count() == 0
    coded = pieces.encode(clashing(edge_docs(spark), "ids", "decoded"))
    assert dict(coded.dtypes)["ids"] == "array<int>"
    assert "source" in coded.columns


@pytest.mark.parametrize("edges", [True, False])
def test_op9(spark, tmp_path, edges):
    folder = save(edge_docs(spark), tmp_path) if edges else SF
    rows = [(r[0], r[1]) for r in edge_rows()] if edges else documents(spark)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coded = []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        coded.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = token_files.op9_token_files(spark, folder).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(coded)
    at = 0
    for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.start)):
        assert r.start == at
        at += r.n_tokens


def test_op9_access(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = f"{tmp_path}/tokens"
    token_files.write_dataset(docs, path)
    every = {r.doc_id: r for r in token_files.read_dataset(spark, path).collect()}
    some = token_files.read_dataset(spark, path, keys=[3, 77, 10**9]).collect()
    assert {r.doc_id for r in some} == {3, 77}
    assert all(r == every[r.doc_id] for r in some)
    dictionary = spark.read.parquet(f"{path}/dictionary").first()
    assert hashlib.sha256(bytes(dictionary["bytes"])).digest() == bytes(dictionary["hash"])
    payload = spark.read.parquet(f"{path}/blocks").first().payload
    with pytest.raises(ValueError):
        token_files.Block(bytes(payload), b"0" * 32, bytes(dictionary["bytes"]))


def test_op9_no_rows(spark, tmp_path):
    path = f"{tmp_path}/tokens"
    token_files.write_dataset(no_docs(spark), path)
    assert token_files.read_dataset(spark, path).count() == 0


@pytest.mark.parametrize("edges", [True, False])
def test_op5(spark, tmp_path, edges):
    folder = save(edge_docs(spark), tmp_path) if edges else SF
    rows = [(r[0], r[1]) for r in edge_rows()] if edges else documents(spark)
    got = shards.op5_shards(spark, folder).collect()
    want = Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key") for i, t in rows
    )
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_key = {}
    assert all(by_key.setdefault(r.doc_id, r.shard) == r.shard for r in got)


def test_op5_weights_and_moves(spark):
    keys = spark.range(40_000).toDF("k")
    got = shards.assign(keys, "k", [1.0, 2.0, 5.0], grown="g", grown_weight=2.0).collect()
    share = Counter(r.shard for r in got)
    assert [round(share[k] / 40_000 * 8, 1) for k in range(3)] == [1.0, 2.0, 5.0]
    moved = [r for r in got if r.g != r.shard]
    assert all(r.g == 3 for r in moved) and 0.18 < len(moved) / 40_000 < 0.22
    with pytest.raises(ValueError):
        shards.assign(keys, "k", [1.0, 0.0])


def test_op5_no_rows(spark, tmp_path):
    assert shards.op5_shards(spark, save(no_docs(spark), tmp_path)).count() == 0


def test_op9_white_space_at_the_borders_of_texts():
    """Texts that begin or end in blanks, no-break spaces and line ends, encoded side by side."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    signs = [" ", "  ", "\xa0", "\r\n", "\n", "\t", "\u3000", "\u2003", "\x85", "x", "é", "12", "'s", ".", "—", "\x0b", "日", "\x00"]
    dice = random.Random(2)
    texts = ["".join(dice.choices(signs, k=dice.randint(1, 7))) for _ in range(30_000)]
    texts[:2] = [" \xa0", " \xa0\r\n x"]
    model = Tokenizer.from_file(path)
    want = [c.ids for c in model.encode_batch(texts, add_special_tokens=False)]
    table = token_files.ChunkTable(path)
    got = [ids.tolist() for k in range(0, len(texts), 500) for ids in table.ids(texts[k : k + 500])]
    assert got == want


def test_tables_hold_ids_as_bytes():
    """No array per distinct word or stretch; the ids stay those of the libraries."""
    texts = ["one two  two", " \t lead", "", None, "naïve 世界 ok\n\n end ", "two one"]
    words = pieces.PieceTable(pieces._model(None))
    assert [x.tolist() for x in words.ids(texts)] == [words.model.encode(t) if t else [] for t in texts]
    stretches = token_files.ChunkTable(token_files._tokenizer(None))
    whole = [stretches.model.encode(t, add_special_tokens=False).ids if t else [] for t in texts]
    assert [x.tolist() for x in stretches.ids(texts)] == whole == [x.tolist() for x in stretches.ids(texts)]
    assert {type(v) for t in (words, stretches) for v in t.values()} == {bytes}


def test_decode_of_null_and_empty_lists(spark):
    df = spark.createDataFrame([(1, [5, 6, 700]), (2, None), (3, []), (4, [900])], "k INT, ids ARRAY<INT>").coalesce(1)
    model = pieces.PieceTable(pieces._model(None)).model
    got = {r.k: r.decoded for r in pieces.decode(df).collect()}
    assert got == {1: model.decode([5, 6, 700]), 2: "", 3: "", 4: model.decode([900])}


def test_values_cut_from_the_buffer():
    import pyarrow as pa

    from cutline.llm.batches import bytes_list, offsets

    words = pa.array([b"", b"ab", b"c", b"", b"\xff d"], pa.binary())
    for part in (words, words[1:4], words[5:]):
        assert bytes_list(part) == part.to_pylist()
    assert offsets(np.array([2, 0, 3], np.int32)).tolist() == offsets([2, 0, 3]).tolist() == [0, 2, 2, 5]


def test_op9_stretches_are_encoded_once(monkeypatch):
    """A word is one stretch whatever stands behind it, and a full table is not forgotten at once."""
    table = token_files.ChunkTable(token_files._tokenizer(None), limit=40)
    coded, plain = [], table._plain

    def counted(texts):
        coded.extend(texts)
        return plain(texts)

    monkeypatch.setattr(table, "_plain", counted)
    texts = ["a word, a word. A word; a word\nword it's\n\nWord x's.\nHe", *(f"a word{k * 7} new{k * 7}" for k in range(60))]
    for k in range(len(texts)):
        for t, ids in zip((texts[0], texts[k]), table.ids([texts[0], texts[k]])):
            assert ids.tolist() == plain([t])[0].tolist()
    assert "".join(coded).count(" word,") == "".join(coded).count(" word.") == 0
    assert coded.count("He") == 1
