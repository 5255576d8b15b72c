"""Rows that every operator must take: NULLs, empty and long texts, ties, clashing columns."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over a lazy dog while nobody near was watching it run".split()


def prose(n: int, seed: int = 0) -> str:
    """Repeatable text of ``n`` words."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 97 if x % 5 == 0 else ""))
    return " ".join(out)


def edge_rows() -> list[tuple]:
    texts = [
        None, "", " ", "   ", "\n\n", "one", "a b c", "¿Qué tal, señor? ñandú 　x", "▁ ▁a  b",
        prose(30, 1), prose(30, 1), prose(20_000, 2), "x" * 50_000, "<|endoftext|> and <s> </s>",
        "tab\tand\r\nline\x0b\x0c end ", "\U0001f600 emoji \x00 nul", "same\nsame\nsame\n\nother", "\x1c\x1d\x85   x",
    ]
    rows = [(k, t, "en" if k % 3 else None, "s0" if k % 2 else None, None) for k, t in enumerate(texts)]
    rows.append(rows[9])  # a repeated row
    rows.append((None, prose(12, 3), "en", "s0", 5))
    return rows


def edge_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(edge_rows(), SCHEMA)


def no_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def clashing(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with further columns of the given names."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("clash") for n in names})


def save(df: DataFrame, folder, name: str = "documents") -> str:
    """Writes ``df`` as a table of a test folder and returns the folder."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
