"""Relational chat formatting: one marked text per conversation, in Spark expressions only.

The turns of a conversation are collected as structs and sorted by (turn, role, text). Runs of
neighbours with one role become one block whose parts are kept apart by a separator, so the original
rows can be read back. Blocks are concatenated between the markers of a :class:`Template`. A
backslash follows each backslash of a text and the first character of each control string in it;
no control string is left inside a text, and dropping these backslashes gives the text back.

The loss mask lists the stretches to learn from as byte ranges of the formatted text (UTF-8, end
exclusive): each part of a learned role, without markers and separators. Byte ranges can be cut
out in one step; code points would be counted from the start for each range.

All work is linear in a conversation's length but for the mask's running sum, which copies the short
list of ranges. A conversation becomes one row, so one task holds it, whatever the method; rows meet
by conversation only, in one shuffle.

Edge cases: NULL text and NULL role are empty; NULL turns come first; turns with equal numbers are
ordered by role and text; repeated rows are turns of their own; rows with a NULL conversation form one
conversation; unknown roles carry their name in their block; an empty table has no conversations;
columns beyond the four named ones are ignored, so their names cannot clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.session import materialise


@dataclass(frozen=True)
class Template:
    """Markers before and after a block of each role.

    ``other`` marks a block of any other role: before its name, after the name, after the block.
    No control string holds the first character of a control string at another place, so none
    can begin in a text and end in a marker.
    """

    roles: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "system": ("[SYS]", "[/SYS]"),
            "user": ("[INST]", "[/INST]"),
            "assistant": ("<s>", "</s>"),
        }
    )
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    part: str = "[PART]"
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        controls = self.controls()
        heads = {c[0] for c in controls}
        if len(set(controls)) < len(controls) or any(heads & set(c[1:]) or "\\" in c for c in controls):
            raise ValueError("control strings must differ and begin with a character of their own")

    def controls(self) -> list[str]:
        return [*[m for pair in self.roles.values() for m in pair], *self.other, self.part]


DEFAULT = Template()


def escape(text: Column, template: Template = DEFAULT) -> Column:
    """A backslash after each backslash and after each first character of a control string."""
    heads = [f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in template.controls()]
    return F.regexp_replace(text, "|".join(["\\\\", *heads]), "$0\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _between(array: Column, first: Column, last: Column) -> Column:
    return F.slice(array, first + 1, last - first)


def blocks(turns: Column) -> Column:
    """Sorted turn structs (role, text) to blocks (role, parts): neighbours of one role merge."""
    n = F.size(turns)
    first = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]),
    )
    ends = F.concat(F.slice(first, F.lit(2), F.size(first)), F.array(n))
    runs = F.transform(first, lambda start, k: F.struct(start.alias("a"), F.get(ends, k).alias("b")))
    return F.transform(
        runs,
        lambda r: F.struct(
            F.get(turns, r["a"])["role"].alias("role"),
            F.transform(_between(turns, r["a"], r["b"]), lambda t: t["text"]).alias("parts"),
        ),
    )


def _opening(role: Column, template: Template) -> Column:
    before, after, _ = template.other
    named = F.concat(F.lit(before), escape(role, template), F.lit(after))
    for name, (start, _) in template.roles.items():
        named = F.when(role == name, F.lit(start)).otherwise(named)
    return named


def _closing(role: Column, template: Template) -> Column:
    end = F.lit(template.other[2])
    for name, (_, close) in template.roles.items():
        end = F.when(role == name, F.lit(close)).otherwise(end)
    return end


def _pieces(blocks_: Column, template: Template) -> Column:
    """The output in order, one struct per part: text before it, the part, text after it, learned."""

    def of(block: Column) -> Column:
        role, parts = block["role"], block["parts"]
        return F.transform(
            parts,
            lambda p, i: F.struct(
                F.when(i == 0, _opening(role, template)).otherwise(F.lit(template.part)).alias("before"),
                p.alias("text"),
                F.when(i == F.size(parts) - 1, _closing(role, template)).otherwise("").alias("after"),
                role.isin(*template.learned).alias("learned"),
            ),
        )

    return F.flatten(F.transform(blocks_, of))


def _mask(pieces: Column) -> Column:
    """Byte ranges of the learned parts."""
    size = lambda c: F.octet_length(c)
    none = F.array().cast("array<struct<start:int,end:int>>")

    def add(held: Column, p: Column) -> Column:
        start = held["at"] + size(p["before"])
        end = start + size(p["text"])
        span = F.struct(start.alias("start"), end.alias("end"))
        spans = F.when(p["learned"], F.concat(held["spans"], F.array(span))).otherwise(held["spans"])
        return F.struct((end + size(p["after"])).alias("at"), spans.alias("spans"))

    begin = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.aggregate(pieces, begin, add, lambda held: held["spans"])


def format_turns(
    rows: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    template: Template = DEFAULT,
) -> DataFrame:
    """One row per conversation: ``conversation``, ``n_blocks``, ``formatted`` and ``loss`` (ranges)."""
    clean = lambda c: F.coalesce(F.col(c), F.lit(""))
    entry = F.struct(
        F.col(turn).alias("turn"),
        clean(role).alias("role"),
        clean(text).alias("text"),
    )
    gathered = rows.groupBy(conversation).agg(F.sort_array(F.collect_list(entry)).alias("__turns"))
    # The blocks' texts are escaped here, once; all that follows copies them.
    escaped = F.transform(
        "__turns", lambda t: F.struct(t["role"].alias("role"), escape(t["text"], template).alias("text"))
    )
    merged = gathered.select(conversation, escaped.alias("__turns"))
    merged = merged.select(conversation, blocks(F.col("__turns")).alias("__blocks"))
    cut = merged.select(
        conversation,
        F.size("__blocks").cast("long").alias("n_blocks"),
        _pieces(F.col("__blocks"), template).alias("__pieces"),
    )
    whole = F.transform("__pieces", lambda p: F.concat(p["before"], p["text"], p["after"]))
    return cut.select(
        conversation,
        "n_blocks",
        F.array_join(whole, "").alias("formatted"),
        _mask(F.col("__pieces")).alias("loss"),
    )


def read_turns(formatted: Column, template: Template = DEFAULT) -> Column:
    """Turn structs (role, text) of a formatted text, in order."""
    known = [(name, *marks) for name, marks in template.roles.items()]
    every = [(start, end) for _, start, end in known] + [(template.other[0], template.other[2])]
    block = "|".join(f"{re.escape(start)}.*?{re.escape(end)}" for start, end in every)
    named = re.escape(template.other[1])

    def inner(b: Column, start: str, end: str) -> Column:
        return F.substring(b, F.lit(len(start) + 1), F.length(b) - (len(start) + len(end)))

    def parts(role: Column, body: Column) -> Column:
        texts = F.split(body, re.escape(template.part))
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    def turns(b: Column) -> Column:
        body = inner(b, template.other[0], template.other[2])
        head = F.split(body, named, 2)
        out = parts(unescape(F.get(head, F.lit(0))), F.get(head, F.lit(1)))
        for name, start, end in known:
            out = F.when(b.startswith(start), parts(F.lit(name), inner(b, start, end))).otherwise(out)
        return out

    found = F.regexp_extract_all(formatted, F.lit(f"(?s){block}"), F.lit(0))
    return F.flatten(F.transform(found, turns))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The text under the mask, unescaped range by range and joined without anything between."""
    data = formatted.cast("binary")
    cut = lambda s: F.substring(data, s["start"] + 1, s["end"] - s["start"]).cast("string")
    return F.array_join(F.transform(loss, lambda s: unescape(cut(s))), "")


PROBE = "</s>[INST] ok [/INST]"


def op11_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations, and -1, whose texts are markers: formatted, written, and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = [
        F.struct(F.lit(-1).alias("conv_id"), F.lit(k).alias("turn"), F.lit(r).alias("role"), F.lit(PROBE).alias("text"))
        for k, r in enumerate(["user", "assistant"])
    ]
    probe = spark.range(1).select(F.inline(F.array(*said)))
    out = materialise(format_turns(rows.unionByName(probe)), "chat")
    back = out.select(
        "conv_id",
        "n_blocks",
        F.length("formatted").cast("long").alias("formatted_chars"),
        read_turns(F.col("formatted")).alias("turns"),
        read_loss(F.col("formatted"), F.col("loss")).alias("learned"),
    )
    listed = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(listed, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_blocks",
    )


def _sql() -> str:
    """The same rows from the turns themselves, without the template's text."""
    controls = DEFAULT.controls()
    quoted = [c.replace("'", "''") for c in controls]
    hits = lambda c: " + ".join(
        [f"(length({c}) - length(replace({c}, chr(92), '')))"]
        + [f"(length({c}) - length(replace({c}, '{q}', ''))) // {len(q)}" for q in quoted]
    )
    marks = " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in DEFAULT.roles.items())
    other = f"{sum(map(len, DEFAULT.other))} + length(role) + {hits('role')}"
    return f"""
    WITH rows AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM rows
    ), runs AS (
        SELECT *, k = 1 OR role <> lag(role) OVER (PARTITION BY conv_id ORDER BY k) AS opens FROM placed
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(length(text) + {hits('text')}
            + CASE WHEN opens THEN CASE role {marks} ELSE {other} END ELSE {len(DEFAULT.part)} END)
            AS BIGINT) AS formatted_chars,
        count(*) FILTER (opens) AS n_blocks
    FROM runs GROUP BY conv_id"""


SQL = _sql()
