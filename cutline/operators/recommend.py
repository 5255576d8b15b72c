"""Batch recommendation: requests in, tiered and ordered programmes out.

Equal requests are answered once. For the gap tiers the prediction does not depend on
the applicant's rank, so a tier is a run of neighbours in the ordered catalogue. Requests and
programmes are put in one order, and a running count over it places every programme and gives
each tier of each request its first and last place: an interval join without pairs. Answers are
kept in that form (:class:`Answers`): the catalogue once, and two intervals per request.
Pages of an answer are read from it by an equi join on blocks of places, so no applicant meets
programmes outside the page, and tier sizes are known without any join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutline.functions.ranks import (
    LIKELY_PROBABILITY,
    probability_tier,
    rounded_probability,
    route_segment,
    whole_rank,
)
from cutline.functions.text import contains_ignore_case, request_key
from cutline.operators import models
from cutline.operators.joins import product, tiled_join
from cutline.operators.ordered import running_sums, with_position
from cutline.operators.vocab import UNKNOWN
from cutline.session import materialise


@dataclass(frozen=True)
class GapRule:
    """Safe: prediction above the rank. Likely: at most ``window`` ranks below it.

    ``whole`` cuts predictions to whole ranks before tiering and includes the low end
    of Likely, which never goes under rank 1.
    """

    window: int
    descending: bool
    whole: bool


# Fixed values.
NEET_RULE = GapRule(window=1500, descending=True, whole=False)
KCET_RULE = GapRule(window=5000, descending=True, whole=False)
COMEDK_RULE = GapRule(window=1000, descending=False, whole=True)
TOP_PER_TIER = 15
TOP_OVERALL = 20

COHORT = ["segment", "quota_key", "pool_key", "category_key"]
PAGE = 500  # entries of a page of a nested response
BLOCK = 64  # neighbouring places that are fetched together
NEET_COURSE = "MBBS"


# ---- requests ----------------------------------------------------------------------


def distinct_requests(requests: DataFrame, prefix: str, cols: list[str]) -> DataFrame:
    """One row per different request, with its reuse key and how often it was asked."""
    return (
        requests.groupBy(*cols)
        .agg(F.count(F.lit(1)).alias("n_requests"))
        .withColumn("request_key", request_key(prefix, *cols))
    )


def filter_branch(df: DataFrame, course: str, branch: str | None) -> DataFrame:
    return df if not branch else df.filter(contains_ignore_case(course, branch))


# ---- candidates --------------------------------------------------------------------


def with_cohort(requests: DataFrame) -> DataFrame:
    """Adds the segment and the spellings under which a request meets its programmes."""
    return requests.withColumns(
        {
            "segment": route_segment("exam_type"),
            "quota_key": F.upper("quota"),
            "pool_key": F.lower("pool"),
            "category_key": F.upper("category"),
        }
    )


def jee_candidates(requests: DataFrame, features: DataFrame, marker: str = "IIT") -> DataFrame:
    """Programmes of the segments, quotas, pools and categories (any letter case) asked for.

    A programme belongs to one cohort, so this is a semi join: programmes are never repeated, however
    many requests share their cohort, and requests meet cohorts, not programmes.
    """
    segment = F.when(F.col("institute_type") == marker, "IIT").otherwise("NIT")
    offered = features.withColumns(
        {
            "segment": segment,
            "quota_key": F.upper("quota"),
            "pool_key": F.lower("pool"),
            "category_key": F.upper("category"),
        }
    )
    return offered.join(with_cohort(requests).select(*COHORT).distinct(), COHORT, "left_semi")


def jee_matches(
    requests: DataFrame, features: DataFrame, cols: list[str], marker: str = "IIT"
) -> DataFrame:
    """Every programme of its cohort for every different request, by ``request_key``.

    Requests times programmes of their cohort. Cohorts are few, so their rows meet in tiles.
    """
    wanted = with_cohort(distinct_requests(requests, "jee", cols)).select(*COHORT, "request_key")
    offered = jee_candidates(requests, features, marker)
    return tiled_join(materialise(wanted, "wanted"), materialise(offered, "offered"), COHORT)


def _numbered(df: DataFrame) -> DataFrame:
    """Rows with ``id`` from 0 in their order."""
    return with_position(df, [], df.columns, "id").withColumn("id", F.col("id") - 1)


def neet_candidates(contexts: DataFrame, institutes: DataFrame, year: int) -> DataFrame:
    """Every known institute for every distinct category."""
    known = institutes.filter(F.col("value") != UNKNOWN).withColumnRenamed("value", "institute")
    wanted = materialise(_numbered(contexts.distinct()), "contexts")
    return product([wanted, known]).withColumns(
        {"course": F.lit(NEET_COURSE), "year": F.lit(year)}
    )


def kcet_candidates(
    contexts: DataFrame, colleges: DataFrame, courses: DataFrame, year: int
) -> DataFrame:
    """Every college with every course, for every distinct request context."""
    attributes = {c: F.upper(c) for c in contexts.columns}
    wanted = materialise(_numbered(contexts.withColumns(attributes).distinct()), "contexts")
    parts = [
        wanted,
        colleges.withColumnRenamed("value", "college_name"),
        courses.withColumnRenamed("value", "course_name"),
    ]
    return product(parts).withColumn("year", F.lit(year))


# ---- gap tiers ---------------------------------------------------------------------

TIERS = ["safe", "likely"]


def _order_key(pred: str, rule: GapRule):
    value = whole_rank(pred) if rule.whole else F.col(pred).cast("double")
    return -value if rule.descending else value


def _known(*cols: str):
    """No column is NULL or NaN: such requests have no answer, such programmes are in none."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull() & (F.col(c).cast("string") != "NaN")
    return cond


@dataclass(frozen=True)
class Answers:
    """Answers to all distinct (group, rank) in interval form.

    ``placed``: the catalogue with ``place``, the 1-based position within the group.
    ``bounds``: first and last place of each tier per (group, rank); a tier whose last place lies
    before its first is empty.
    """

    bounds: DataFrame
    placed: DataFrame
    group: list[str]
    rank: str

    def intervals(self) -> DataFrame:
        """One row per (group, rank, tier) that has rows: ``first``, ``last``, ``n_rows``."""
        runs = F.array(
            *[
                F.struct(
                    F.lit(tier.capitalize()).alias("tier"),
                    F.col(f"{tier}_first").alias("first"),
                    F.col(f"{tier}_last").alias("last"),
                )
                for tier in TIERS
            ]
        )
        rows = self.bounds.select(*self.group, self.rank, F.explode(runs).alias("t"))
        rows = rows.select(*self.group, self.rank, "t.*").filter(F.col("first") <= F.col("last"))
        return rows.withColumn("n_rows", F.col("last") - F.col("first") + 1)

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number`` (from 0) of every tier: programmes with their position ``pos``."""
        runs = self.intervals().withColumn("__from", F.col("first") + number * size)
        until = F.least("last", F.col("__from") + (size - 1))
        return self._rows(runs.withColumn("__until", until))

    def every(self) -> DataFrame:
        """All pages at once: a row per request and programme of its tiers."""
        runs = self.intervals().withColumns({"__from": F.col("first"), "__until": F.col("last")})
        return self._rows(runs, spread=True)

    def _rows(self, runs: DataFrame, spread: bool = False) -> DataFrame:
        """Rows ``__from`` to ``__until`` of each run, fetched in blocks of neighbours.

        A request asks for the few blocks that its run touches, not for each place. A block is asked
        for by the different ranks of its group only, and those are whole and bounded. ``spread``
        deals the asked blocks over all shuffle partitions: few bytes that become many rows.
        """
        block = F.floor((F.col("place") - 1) / BLOCK)
        entry = F.struct("place", *[c for c in self.placed.columns if c not in {*self.group, "place"}])
        blocks = self.placed.groupBy(*self.group, block.alias("__block")).agg(
            F.sort_array(F.collect_list(entry)).alias("__rows")
        )
        asked = runs.filter(F.col("__from") <= F.col("__until")).withColumn(
            "__block",
            F.explode(
                F.sequence(
                    F.floor((F.col("__from") - 1) / BLOCK), F.floor((F.col("__until") - 1) / BLOCK)
                )
            ),
        )
        if spread:
            n = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            asked = asked.repartition(n, *self.group, "__block")
        found = asked.join(blocks, [*self.group, "__block"])
        inside = F.filter("__rows", lambda r: r["place"].between(F.col("__from"), F.col("__until")))
        flat = found.select(*self.group, self.rank, "tier", "first", F.explode(inside).alias("__r"))
        pos = F.col("__r.place") - F.col("first") + 1
        rest = [F.col(f"__r.{c}") for c in self.placed.columns if c not in {*self.group, "place"}]
        return flat.select(*self.group, self.rank, "tier", pos.alias("pos"), *rest)


def interval_answers(
    requests: DataFrame,
    catalogue: DataFrame,
    group: list[str],
    rank: str,
    pred: str,
    names: list[str],
    rule: GapRule,
) -> Answers:
    """Places the catalogue and bounds the tiers of every request in one ordered pass.

    Each distinct (group, rank) adds its two edges to the catalogue's order: behind all programmes
    of smaller key, or behind those of equal key as well. The programmes counted up to an edge are
    the place where a tier ends or the next one begins.
    """
    sign, kind = (-1 if rule.descending else 1), ("long" if rule.whole else "double")
    low = F.col(rank) - rule.window
    if rule.whole:
        low = F.greatest(F.lit(1), low)
    # Descending: both tiers leave out the edge itself. Ascending: Likely keeps both of its edges.
    sides = {"high": (F.col(rank), 0 if rule.descending else 2), "low": (low, 0)}
    edges = F.array(
        *[
            F.struct(
                F.lit(side).alias("__side"), (at * sign).cast(kind).alias("__key"), F.lit(k).alias("__kind")
            )
            for side, (at, k) in sides.items()
        ]
    )
    wanted = requests.select(*group, rank).filter(_known(*group, rank)).distinct()
    points = wanted.select(*group, F.col(rank).alias("__rank"), F.explode(edges).alias("e"))
    points = points.select(*group, "__rank", "e.*", F.lit(0).cast("long").alias("__n"))
    offered = catalogue.filter(_known(*group, pred)).select(
        *group, *names, pred, _order_key(pred, rule).alias("__key"),
        F.lit(1).alias("__kind"), F.lit(1).cast("long").alias("__n"),
    )
    both = offered.unionByName(points, allowMissingColumns=True)
    order = ["__key", "__kind", *names, "__rank", "__side"]
    counted = materialise(running_sums(both, group, order, ["__n"]), "placed")
    placed = counted.filter("__kind = 1").select(
        *group, *names, pred, F.col("__n_upto").alias("place")
    )

    def at(side: str):
        return F.max(F.when(F.col("__side") == side, F.col("__n_upto")))

    if rule.descending:
        # key = -prediction: Safe is key < -rank, Likely goes on to key < -(rank - window).
        ends = {
            "safe_first": F.lit(1).cast("long"), "safe_last": at("high"),
            "likely_first": at("high") + 1, "likely_last": at("low"),
        }
    else:
        ends = {
            "safe_first": at("high") + 1, "safe_last": F.max("__n_total"),
            "likely_first": at("low") + 1, "likely_last": at("high"),
        }
    found = counted.filter("__kind <> 1").withColumnRenamed("__rank", rank)
    bounds = found.groupBy(*group, rank).agg(*[c.alias(n) for n, c in ends.items()])
    return Answers(bounds, placed, group, rank)


def tier_bounds(
    requests: DataFrame, catalogue: DataFrame, group: list[str], rank: str, pred: str, rule: GapRule
) -> DataFrame:
    """First and last place of each tier, one row per distinct (group, rank)."""
    return interval_answers(requests, catalogue, group, rank, pred, [], rule).bounds


def tier_sizes(bounds: DataFrame) -> DataFrame:
    """Rows per tier, from the bounds alone."""
    out = bounds
    for tier in TIERS:
        size = F.greatest(F.lit(0), F.col(f"{tier}_last") - F.col(f"{tier}_first") + 1)
        out = out.withColumn(f"n_{tier}", size.cast("long"))
    return out.drop(*[f"{tier}_{end}" for tier in TIERS for end in ("first", "last")])


def published(answers: Answers, names: list[str], pred: str) -> DataFrame:
    """Intervals and catalogue as one table; ``part`` tells the rows of the two apart.

    Row k of a tier is the catalogue row at place ``first + k - 1`` of its group.
    """
    group, rank = answers.group, answers.rank
    runs = answers.intervals().select(
        F.lit("answer").alias("part"), *group, rank, "tier", "first", "last"
    )
    rows = answers.placed.select(
        F.lit("catalogue").alias("part"), *group, "place", *names,
        whole_rank(pred).alias("predicted_cutoff"),
    )
    return runs.unionByName(rows, allowMissingColumns=True)


def recommend_by_gap(
    requests: DataFrame,
    catalogue: DataFrame,
    group: list[str],
    rank: str,
    pred: str,
    names: list[str],
    rule: GapRule,
    limit: int | None = None,
) -> DataFrame:
    """Rows of the answer per distinct (group, rank): the first ``limit`` of each tier, or all.

    All rows are requests times programmes: meant for few requests. :func:`interval_answers` keeps
    the complete answers of many.
    """
    answers = interval_answers(requests, catalogue, group, rank, pred, names, rule)
    rows = answers.every() if limit is None else answers.page(0, limit)
    return rows.withColumn("predicted_cutoff", whole_rank(pred)).select(
        *group, rank, "tier", "pos", *names, "predicted_cutoff"
    )


def request_summary(
    requests: DataFrame, bounds: DataFrame, group: list[str], rank: str
) -> DataFrame:
    """Tier sizes of every request; a request without any row says so."""
    sizes = tier_sizes(bounds)
    found = requests.join(sizes, [*group, rank], "left").fillna({"n_safe": 0, "n_likely": 0})
    has_result = ((F.col("n_safe") + F.col("n_likely")) > 0).cast("int")
    return found.withColumn("has_result", has_result)


# ---- probability tiers -------------------------------------------------------------


def with_probability_tier(scored: DataFrame, prob: str = "eligibility_prob") -> DataFrame:
    """Rounds to 4 places, then tiers; rows under the lower limit leave."""
    rounded = scored.withColumn(prob, rounded_probability(prob))
    return rounded.withColumn("tier", probability_tier(prob)).filter(F.col("tier").isNotNull())


def order_tiers(
    tiered: DataFrame, request: list[str], names: list[str], prob: str = "eligibility_prob"
) -> DataFrame:
    """Adds the position by descending probability within a request's tier.

    The score depends on the applicant here, so each request orders its own rows. A
    request with a very large cohort is not sorted by one task: probabilities have four
    places, and only rows with equal probability are numbered together.
    """
    keyed = tiered.withColumn("__key", F.round(F.col(prob) * -10000).cast("long"))
    return with_position(keyed, [*request, "tier"], ["__key", *names]).drop("__key")


def top_overall(
    scored: DataFrame,
    request: list[str],
    names: list[str],
    prob: str = "eligibility_prob",
    threshold: float = LIKELY_PROBABILITY,
    limit: int = TOP_OVERALL,
) -> DataFrame:
    """Best ``limit`` rows per request at or above ``threshold``.

    The rank filter becomes a group limit before the shuffle, so each task passes on at
    most ``limit`` rows of a request.
    """
    rounded = scored.withColumn(prob, rounded_probability(prob)).filter(F.col(prob) >= threshold)
    best = Window.partitionBy(*request).orderBy(F.col(prob).desc(), *names)
    return rounded.withColumn("pos", F.row_number().over(best)).filter(F.col("pos") <= limit)


def _band(rank, points: list[float]):
    """Number of the interval between split points that holds the rank."""
    return F.size(F.filter(F.array(*[F.lit(p) for p in points]), lambda p: p < rank)) if points else F.lit(0)


def score_bands(model: models.FittedModel, programmes: DataFrame) -> DataFrame:
    """``eligibility_prob`` of each programme for every interval of the applicant's rank.

    Trees see a rank only through their split points, so between two neighbours the score is one
    number: a programme is scored once per interval, of which there are fewer than a tree has bins,
    and not once per request.
    """
    points = models.split_points(model, "student_rank")
    ends = [*points, points[-1] + 1] if points else [1.0]
    bands = F.array(*[F.struct(F.lit(k).alias("band"), F.lit(e).alias("r")) for k, e in enumerate(ends)])
    rows = programmes.withColumn("__b", F.explode(bands))
    rows = rows.withColumns({"band": F.col("__b.band"), "student_rank": F.col("__b.r")}).drop("__b")
    return models.score_eligibility(model, rows)


JEE_NAMES = ["institute_short", "program_name", "degree_short"]


def jee_answers(
    requests: DataFrame,
    segments: dict[str, tuple[DataFrame, models.FittedModel]],
    marker: str = "IIT",
) -> tuple[DataFrame, Answers]:
    """Answers of a mixed batch: each segment's requests go to its features and its model.

    Returns the requests with segment, tier sizes and ``has_result`` (0 where nothing was found, also
    where a segment has no model), and the programmes in interval form: ordered by falling probability
    within (cohort, band), so that the Safe ones come first and the Likely ones follow.
    """
    asked = with_cohort(requests).withColumn("user_rank", F.col("user_rank").cast("double"))
    band, parts = F.lit(None).cast("int"), []
    for name, (rows, model) in segments.items():
        points = models.split_points(model, "student_rank")
        band = F.when(F.col("segment") == name, _band(F.col("user_rank"), points)).otherwise(band)
        offered = jee_candidates(asked, rows, marker).filter(F.col("segment") == name)
        scored = score_bands(model, offered)
        parts.append(scored.select(*COHORT, "band", *JEE_NAMES, "closing_rank_max", "eligibility_prob"))
    asked = asked.withColumn("band", band)
    scored = materialise(with_probability_tier(_union(parts)), "scored")
    group = [*COHORT, "band"]
    keyed = scored.withColumn("__key", F.round(F.col("eligibility_prob") * -10000).cast("long"))
    placed = with_position(keyed, group, ["__key", *JEE_NAMES], "place").drop("__key", "tier")
    sizes = scored.groupBy(*group).agg(
        F.count_if(F.col("tier") == "Safe").alias("n_safe"),
        F.count_if(F.col("tier") == "Likely").alias("n_likely"),
    )
    found = asked.join(sizes, group, "left").fillna({"n_safe": 0, "n_likely": 0})
    safe, both = F.col("n_safe"), F.col("n_safe") + F.col("n_likely")
    known = found.filter(both > 0).select(*group, "user_rank", "n_safe", "n_likely").distinct()
    bounds = known.select(
        *group, "user_rank", F.lit(1).cast("long").alias("safe_first"), safe.alias("safe_last"),
        (safe + 1).alias("likely_first"), both.alias("likely_last"),
    )
    outcomes = found.withColumn("has_result", (both > 0).cast("int"))
    return outcomes, Answers(bounds, materialise(placed, "placed"), group, "user_rank")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def jee_response_rows(rows: DataFrame) -> DataFrame:
    """Published columns of rows of a JEE answer (the duration repeats the degree)."""
    published = {"institute_short", "program_name", "degree_short", "closing_rank_max", "eligibility_prob"}
    return rows.select(
        *[c for c in rows.columns if c not in published],
        F.col("institute_short").alias("institute"),
        F.col("program_name").alias("program"),
        F.col("degree_short").alias("program_duration"),
        "degree_short",
        whole_rank("closing_rank_max").alias("predicted_cutoff"),
        "eligibility_prob",
    )


# ---- responses ---------------------------------------------------------------------


def nested_response(top: DataFrame, request: list[str], fields: list[str]) -> DataFrame:
    """One row per request with an ordered array per tier and the JSON of both.

    Takes a page of the answers, so an array has at most that many entries per tier.
    """
    entry = F.struct("pos", *fields)

    def of(tier: str):
        return F.array_sort(F.collect_list(F.when(F.col("tier") == tier, entry)))

    nested = top.groupBy(*request).agg(of("Safe").alias("safe"), of("Likely").alias("likely"))
    both = F.struct(F.col("safe").alias("Safe"), F.col("likely").alias("Likely"))
    return nested.withColumn("response", F.to_json(both))


def response_pages(
    rows: DataFrame, keys: list[str], place: str, fields: list[str], size: int = PAGE
) -> DataFrame:
    """Ordered rows as JSON pages: (keys, page, n_rows, response).

    ``response`` is the array of the page's entries with their places, in order. A page holds
    ``size`` entries at most, so no answer becomes one huge value, however long it is. The keys are
    those of the catalogue, whose pages all requests share, or of single requests and tiers.
    """
    page = F.floor((F.col(place) - 1) / size).cast("long").alias("page")
    entries = F.sort_array(F.collect_list(F.struct(place, *fields)))
    pages = rows.groupBy(*keys, page).agg(entries.alias("__entries"))
    return pages.select(
        *keys, "page", F.size("__entries").cast("long").alias("n_rows"),
        F.to_json("__entries").alias("response"),
    )


def read_pages(pages: DataFrame, keys: list[str], entry: str) -> DataFrame:
    """Rows of the pages' entries; ``entry`` is their schema, such as ``place BIGINT, ...``."""
    fields = ",".join("`{}`:{}".format(*part.split()) for part in entry.split(","))
    parsed = F.from_json("response", f"array<struct<{fields}>>")
    return pages.select(*keys, F.explode(parsed).alias("__e")).select(*keys, "__e.*")
