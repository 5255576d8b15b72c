"""Operator 11: formatted conversations read back, against plain Python and its SQL."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from cutline.llm import chat
from tests.llm.cases import clashing, save

SCHEMA = "conv_id long, turn long, role string, text string"


def talk():
    """Rows of conversations with every oddity, in no order."""
    out = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "assistant", "and more"), (1, 3, "user", None),
        (2, 2, "assistant", "late"), (2, 0, "system", "s"), (2, 1, "user", "q"), (2, 3, "assistant", ""),
        (3, 5, "assistant", "only"), (3, 5, "assistant", "only"), (3, 5, "assistant", "a tie"),
        (4, None, "user", "no turn"), (4, 1, None, "no role"), (4, 2, "tool", "x[TEXT]y[/ROLE]"),
        (4, 3, "[TEXT]\\role", "odd name"), (4, 3, "", "empty name"),
        (None, 0, "user", "no conversation"), (None, 1, "assistant", "none"),
        (5, 0, "user", "w " * 30_000), (5, 1, "assistant", "é\U0001f600\x00[" * 5_000),
        (6, 0, None, None), (7, 0, "assistant", "[PART]\\[PART]\\\\<s></s>[INST]"), (7, 1, "assistant", "<"),
        (8, 0, "assistant", "ends in \\"), (8, 1, "user", "ends in [INST"), (8, 2, "assistant", "\n$0 \\$1 {x}"),
    ]
    signs = [*chat.DEFAULT.controls(), "\\", "<", "[", "/", "a", " ", "\n", "]", ">", "é", "INST]", "s>"]
    rng = random.Random(3)
    for k in range(100, 160):
        for t in range(rng.randint(1, 7)):
            text = "".join(rng.choices(signs, k=rng.randint(0, 12)))
            out.append((k, t, rng.choice(["user", "assistant", "assistant", "system", "tool"]), text))
    rng.shuffle(out)
    return out


def by_conversation(rows):
    """Turns in order by conversation."""
    found = {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns, key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))] for c, turns in found.items()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    out = {}
    for conv, turns in by_conversation(rows).items():
        learned = "".join(t for r, t in turns if r == "assistant")
        runs = 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:]))
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), runs)
    return out


def test_op11(spark, tmp_path):
    rows = talk()
    folder = save(clashing(spark.createDataFrame(rows, SCHEMA), "formatted", "loss", "n_turns"), tmp_path, "conversations")
    got = chat.op11_chat(spark, folder).collect()
    want = expected(rows + [(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)])
    assert len(got) == len(want)
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.n_blocks) for r in got} == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    sql = {r[0]: r[1:] for r in con.execute(chat.SQL).fetchall()}
    # The NUL of conversation 5 ends its text in the other engine's replace: not compared there.
    assert {k: v for k, v in sql.items() if k != 5} == {r.conv_id: tuple(r)[1:] for r in got if r.conv_id != 5}


def test_no_marker_is_left_in_texts(spark):
    rows = talk()
    out = chat.format_turns(spark.createDataFrame(rows, SCHEMA))
    controls = "|".join(map(re.escape, chat.DEFAULT.controls()))
    turns = by_conversation(rows)
    for r in out.collect():
        runs = 1 + sum(a[0] != b[0] for a, b in zip(turns[r.conv_id], turns[r.conv_id][1:]))
        named = [k for k, (role, _) in enumerate(turns[r.conv_id]) if role not in chat.DEFAULT.roles]
        other = sum(k == 0 or turns[r.conv_id][k][0] != turns[r.conv_id][k - 1][0] for k in named)
        parts = len(turns[r.conv_id]) - runs
        assert len(re.findall(controls, r.formatted)) == 2 * runs + other + parts
        data = r.formatted.encode()
        assert all(data[s.start : s.end].decode() is not None for s in r.loss)
        assert len(r.loss) == sum(role == "assistant" for role, _ in turns[r.conv_id])


def test_empty_table(spark, tmp_path):
    folder = save(spark.createDataFrame([], SCHEMA), tmp_path, "conversations")
    (row,) = chat.op11_chat(spark, folder).collect()
    assert (row.conv_id, row.n_turns, row.loss_chars) == (-1, 2, len(chat.PROBE))
    assert not chat.format_turns(spark.createDataFrame([], SCHEMA)).collect()


def test_other_template_and_columns(spark):
    template = chat.Template(
        roles={"human": ("<|h|>", "<|/h|>"), "model": ("<|m|>", "<|/m|>")},
        other=("<|r|>", "<|t|>", "<|/r|>"), part="<|p|>", learned=("model", "tool"),
    )
    rows = [(1, 0, "human", "a<|m|>"), (1, 1, "tool", "b\\"), (1, 2, "model", "<|p|>c"), (1, 3, "model", "[INST]")]
    df = spark.createDataFrame(rows, "id long, at int, who string, said string")
    out = chat.format_turns(df, "id", "at", "who", "said", template)
    back = out.select(
        chat.read_turns(F.col("formatted"), template).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("l")
    ).collect()[0]
    assert [(t.role, t.text) for t in back.t] == [r[2:] for r in rows]
    assert back.l == "b\\<|p|>c[INST]"
    with pytest.raises(ValueError):
        chat.Template(part="<<part>")


def test_long_conversation(spark):
    """20,000 turns in one conversation, most of them of one role."""
    turns = spark.range(20_000).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 5 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("t<s>"), F.col("id")).alias("text"),
    )
    (r,) = chat.format_turns(turns).select(
        F.size(chat.read_turns(F.col("formatted"))).alias("n"), F.size("loss").alias("k"),
        F.length(chat.read_loss(F.col("formatted"), F.col("loss"))).alias("c"),
    ).collect()
    assert (r.n, r.k) == (20_000, 16_000)
    assert r.c == sum(len(f"t<s>{i}") for i in range(20_000) if i % 5)
