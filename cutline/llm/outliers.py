"""Quality rules and robust multivariate outliers, in DataFrame functions only.

Statistics of each text become a vector of five transformed numbers. For every language and source
a minimum-covariance-determinant (MCD) estimate describes the bulk of the vectors: from several robust
starts, concentration steps refit mean and covariance to the share ``BULK`` of rows with the
least Mahalanobis distances; the start that ends with the least determinant counts. A text is rejected
if its distance is above ``CUTOFF``.

All sums are aggregates per group with map-side combining; the distance below which the bulk
lies comes from counts in fine logarithmic bins (whole bins join the bulk), so neither a
hot source nor a large group is ever sorted or collected. The raw texts are read once. Groups under
``LEAST_ROWS`` rows use the estimate of their language, then that of all rows.

Edge cases: NULL texts are empty; NULL languages and sources are groups of their own; texts that fail
the base rules are neither fitted nor judged; constant statistics are safe because ``FLOORS`` adds
a least spread; ties share a bin; repeated rows count each; an empty table stays empty;
input columns named like output columns are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutline.session import materialise

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
DIMS = [f"v{k}" for k in range(5)]
# Least standard deviation per statistic; differences below it are no reason to reject. That of the
# last one lets a text with a fifth of its words in repeated windows be rejected for it alone.
FLOORS = [0.35, 0.12, 0.5, 0.5, 0.65]
BULK = 0.75
# BULK / P(chi2 with 7 degrees < the BULK quantile of chi2 with 5): makes the estimate of a
# normal sample's covariance consistent.
CONSISTENCY = 1.4132
CUTOFF = 20.515  # squared distance: the 0.999 quantile of chi2 with 5 degrees
STEPS = 4
LEAST_ROWS = 50
BINS = 32  # per unit of the logarithm of a squared distance


def let(value: Column, body) -> Column:
    """``body`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the five counts of each text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(whole, "[ \\t-\\r]+"), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))

    def covered(h: Column) -> Column:
        """Words in windows whose hash another window shares."""
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def shared(s: Column) -> Column:
            n = F.size(s)
            twin = F.filter(
                s,
                lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False))
                | F.coalesce(F.when(k + 1 < n, F.get(s, k + 1)["h"] == e["h"]), F.lit(False)),
            )
            at = F.transform(twin, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2))
            return F.size(F.array_distinct(F.flatten(at)))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(placed, shared))

    def of_words(w: Column) -> Column:
        n = F.size(w)
        windows = F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        )
        repeats = F.when(n < 3, 0).otherwise(let(windows, covered))
        return F.struct(n.cast("long").alias("n"), repeats.cast("long").alias("r"))

    counted = df.withColumn("__w", let(words, of_words))
    length = F.length(whole)
    return counted.withColumns(
        {
            "n_words": F.col("__w.n"),
            "word_chars": F.length(F.translate(whole, " \t\n\x0b\f\r", "")).cast("long"),
            "n_symbols": (length - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": F.col("__w.r"),
        }
    ).drop("__w")


def base_failed() -> Column:
    words = F.col("n_words")
    return (words < 50) | (100 * F.col("n_repeat_words") > 50 * words)


def vectors() -> dict[str, Column]:
    """Transformed statistics: length, word length, and three rates on a log scale."""
    n = F.col("n_words")
    rate = lambda c, of: F.log1p(100.0 * F.col(c) / of)
    return dict(
        zip(
            DIMS,
            [
                F.log1p(n),
                F.log((F.col("word_chars") + 1) / (n + 1)),
                rate("n_symbols", F.col("word_chars") + 1),
                rate("n_dup_lines", n + 1),
                rate("n_repeat_words", n + 1),
            ],
        )
    )


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(DIMS)) for j in range(i + 1)]


def _moments(rows: DataFrame, keys: list[str], values: list[str] = DIMS) -> DataFrame:
    """Mean m0.. and covariance c00.. of ``values`` per group."""
    x = [F.col(c) for c in values]
    sums = [F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)]]
    sums += [F.covar_pop(x[i], x[j]).alias(f"c{i}{j}") for i, j in _pairs()]
    return rows.groupBy(*keys).agg(*sums)


def _factored(groups: DataFrame, scale: float) -> DataFrame:
    """Groups with the Cholesky factor l00.. of their scaled and floored covariance, and log det."""
    for i, j in _pairs():
        own = F.col(f"c{i}{j}") * scale + (FLOORS[i] ** 2 if i == j else 0.0)
        rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), own)
        least = F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2 / 4)))
        groups = groups.withColumn(f"l{i}{j}", least if i == j else rest / F.col(f"l{j}{j}"))
    logdet = reduce(lambda a, b: a + b, [2 * F.log(f"l{i}{i}") for i in range(len(DIMS))])
    return groups.withColumn("logdet", logdet).drop(*[f"c{i}{j}" for i, j in _pairs()])


def _distance(rows: DataFrame) -> DataFrame:
    """Rows that hold mean and factor, with the squared distance d2 in their place."""
    for i in range(len(DIMS)):
        off = F.col(DIMS[i]) - F.col(f"m{i}")
        off = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"__z{k}"), range(i), off)
        rows = rows.withColumn(f"__z{i}", off / F.col(f"l{i}{i}"))
    d2 = reduce(lambda a, b: a + b, [F.col(f"__z{i}") * F.col(f"__z{i}") for i in range(len(DIMS))])
    used = [f"__z{i}" for i in range(len(DIMS))] + [f"m{i}" for i in range(len(DIMS))]
    return rows.withColumn("d2", d2).drop(*used, *[f"l{i}{j}" for i, j in _pairs()], "logdet", "n")


def _quantile_bin(rows: DataFrame, keys: list[str], bin_: Column, share: float) -> DataFrame:
    """Per group the first bin up to which at least ``share`` of the rows lie."""
    counts = rows.groupBy(*keys, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*keys).orderBy("bin")
    whole = Window.partitionBy(*keys)
    seen = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(whole))
    return seen.filter(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy(*keys).agg(
        F.min("bin").alias("bin")
    )


def _log_bin(d2: Column) -> Column:
    return F.floor(F.log(d2 + 1e-6) * BINS)


def _centres(rows: DataFrame) -> DataFrame:
    """Median md0.. and scaled median absolute deviation s0.. per group, from bins of 1/64."""
    long = rows.select("g", F.posexplode(F.array(*DIMS)).alias("i", "x"))
    middle = (F.col("bin") + 0.5) / 64
    med = _quantile_bin(long, ["g", "i"], F.floor(F.col("x") * 64), 0.5)
    med = materialise(med.select("g", "i", middle.alias("med")), "median")
    off = long.join(med, ["g", "i"]).withColumn("off", F.abs(F.col("x") - F.col("med")))
    mad = _quantile_bin(off, ["g", "i"], F.floor(F.col("off") * 64), 0.5)
    both = med.join(mad.select("g", "i", (middle * 1.4826).alias("mad")), ["g", "i"])
    of = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    floor = lambda i: F.greatest(of("mad", i), F.lit(FLOORS[i]))
    return both.groupBy("g").agg(
        *[of("med", i).alias(f"md{i}") for i in range(len(DIMS))],
        *[floor(i).alias(f"s{i}") for i in range(len(DIMS))],
    )


def fit(rows: DataFrame) -> DataFrame:
    """MCD estimate per group ``g`` of written rows with the columns of ``DIMS``.

    Starts: medians with deviations alone; medians with the correlation of squashed values; plain mean
    and covariance. Columns: g, n, m0.., l00.., logdet.
    """
    centres = materialise(_centres(rows), "centres")
    p = range(len(DIMS))
    squashed = rows.join(centres, "g").select(
        "g", *[F.tanh((F.col(DIMS[i]) - F.col(f"md{i}")) / F.col(f"s{i}")).alias(DIMS[i]) for i in p]
    )
    soft = _moments(squashed, ["g"]).join(centres, "g")
    middles = [F.col(f"md{i}").alias(f"m{i}") for i in p]
    spread = lambda i, j, r: (r * F.col(f"s{i}") * F.col(f"s{j}")).alias(f"c{i}{j}")
    ridge = lambda i: F.col(f"c{i}{i}") + 1e-3
    plain = [spread(i, j, F.lit(1.0 if i == j else 0.0)) for i, j in _pairs()]
    tied = [
        spread(i, j, F.lit(1.0) if i == j else F.col(f"c{i}{j}") / F.sqrt(ridge(i) * ridge(j)))
        for i, j in _pairs()
    ]
    starts = [
        soft.select("g", F.lit(0).alias("start"), "n", *middles, *plain),
        soft.select("g", F.lit(1).alias("start"), "n", *middles, *tied),
        _moments(rows, ["g"]).withColumn("start", F.lit(2)),
    ]
    together = reduce(lambda a, b: a.unionByName(b), starts)
    fits = materialise(_factored(together, 1.0), "start")
    for _ in range(STEPS):
        near = _distance(rows.join(fits, "g")).withColumn("bin", _log_bin(F.col("d2")))
        limit = materialise(
            _quantile_bin(near, ["g", "start"], F.col("bin"), BULK).withColumnRenamed("bin", "__most"),
            "bulk",
        )
        bulk = near.join(limit, ["g", "start"]).filter("bin <= __most")
        fits = materialise(_factored(_moments(bulk, ["g", "start"]), CONSISTENCY), "fit")
    best = F.min_by(F.struct(*[c for c in fits.columns if c != "g"]), F.struct("logdet", "start"))
    return materialise(fits.groupBy("g").agg(best.alias("b")).select("g", "b.*").drop("start"), "best")


def judge(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``df`` without its text, with the statistics, base_failed, distance (NULL where none was
    fitted) and kept."""
    made = {*STATS, "base_failed", "distance", "kept"}
    passed_on = [c for c in df.columns if c != text and c not in made]
    row = F.struct(*[F.col(c) for c in passed_on])  # kept apart: its names cannot clash
    bare = df.select(
        row.alias("__row"), F.col(text).alias("__text"), F.col(lang).alias("lang"), F.col(source).alias("source")
    )
    stats = with_statistics(bare, "__text").drop("__text")
    stats = materialise(stats.withColumn("base_failed", base_failed()), "statistics")
    level = [F.lit("all"), F.to_json(F.struct("lang")), F.to_json(F.struct("lang", "source"))]
    keys = [F.concat(F.lit(f"{k}"), c) for k, c in enumerate(level)]
    judged = stats.withColumns(vectors())
    passed = judged.filter(~F.col("base_failed")).select(*DIMS, *[k.alias(f"g{i}") for i, k in enumerate(keys)])
    sizes = [passed.groupBy(f"g{i}").agg(F.count(F.lit(1)).alias(f"n{i}")) for i in range(3)]
    choice = passed.select("g0", "g1", "g2").distinct()
    for i, size in enumerate(sizes):
        choice = choice.join(size, f"g{i}")
    chosen = F.when(F.col("n2") >= LEAST_ROWS, F.col("g2")).when(
        F.col("n1") >= LEAST_ROWS, F.col("g1")
    ).when(F.col("n0") >= LEAST_ROWS, F.col("g0"))
    choice = materialise(choice.select("g2", chosen.alias("g")), "groups")
    used = choice.filter("g IS NOT NULL").select("g").distinct()
    levels = F.explode(F.array("g0", "g1", "g2")).alias("g")
    fits = fit(materialise(passed.select(levels, *DIMS).join(used, "g"), "vectors"))
    placed = judged.withColumn("g2", F.when(~F.col("base_failed"), keys[2])).join(choice, "g2", "left")
    outer = placed.join(fits.withColumnRenamed("n", "__n"), "g", "left")
    inside = F.coalesce(F.col("d2") <= CUTOFF, F.lit(True))
    return _distance(outer).select(
        "__row.*",
        *STATS,
        "base_failed",
        F.col("d2").alias("distance"),
        (~F.col("base_failed") & inside).alias("kept"),
    )


def op1_outliers(spark, sf_dir: str) -> DataFrame:
    """Verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return judge(docs).select("doc_id", *STATS, "base_failed", "kept", "distance")
