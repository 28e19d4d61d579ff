"""Facts in context: outcomes on a common base, rates, placements, verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_SYSTEMS = 1000  # names that are put into the plan

# A checked figure's verdicts and their groups.
VERDICT_GROUP = {
    "correct": "complete",
    "duplicate": "complete",
    "wrong row": "wrong context",
    "wrong column": "wrong context",
    "sign": "wrong context",
    "correct, row not stated": "unresolved",
    "column not stated": "unresolved",
    "correct, column not assessed": "unresolved",
}


def on_common_base(eligible: DataFrame, outcomes: DataFrame, cell: Sequence[str], system: str = "system") -> DataFrame:
    """Every eligible cell for every system: (cell, system, outcome); a cell without outcome is missing."""
    names = [r[0] for r in outcomes.select(system).distinct().limit(MOST_SYSTEMS + 1).collect()]
    if len(names) > MOST_SYSTEMS:
        raise ValueError(f"more than {MOST_SYSTEMS} systems: is {system} the right column?")
    all_systems = F.array(*map(F.lit, names)) if names else F.array().cast(f"array<{dict(outcomes.dtypes)[system]}>")
    grid = eligible.select(*cell).distinct().withColumn(system, F.explode(all_systems))
    return grid.join(outcomes, [*cell, system], "left").withColumn("outcome", F.coalesce("outcome", F.lit("missing")))


def by_run(runs: DataFrame, run: str, label: str) -> DataFrame:
    """Runs with ``name``: their label, with the run's own key behind it where several runs have that label.
    Labels are no key: tables that go by label would add up different runs."""
    several = runs.groupBy(label).agg(F.count_distinct(run).alias("_n")).where("_n > 1").select(F.col(label).alias("_label"))
    marked = runs.join(several, F.col(label) == F.col("_label"), "left")
    return marked.withColumn("name", F.when(F.col("_label").isNotNull(), F.format_string("%s (%s)", label, F.col(run).cast("string"))).otherwise(F.col(label))).drop("_label")


def outcome_shares(cells: DataFrame, outcomes: Sequence[str], system: str = "system") -> DataFrame:
    """(system, cells, one share for each outcome); the shares of all outcomes add up to one."""
    share = lambda o: F.avg((F.col("outcome") == o).cast("double")).alias(o.replace(" ", "_"))
    return cells.groupBy(system).agg(F.count(F.lit(1)).alias("cells"), *[share(o) for o in outcomes])


def recovery(complete: str, base: int, scope: int):
    """A share of the base as a share of everything in scope."""
    return F.col(complete) * base / scope


def statement_level(cells: DataFrame, statement: Sequence[str], system: str = "system") -> DataFrame:
    """(system, statements, fully_right, with_critical): cells carry right and critical."""
    each = cells.groupBy(system, *statement).agg(F.bool_and("right").alias("right"), F.bool_or("critical").alias("critical"))
    return each.groupBy(system).agg(F.count(F.lit(1)).alias("statements"), F.count_if("right").alias("fully_right"), F.count_if("critical").alias("with_critical"))


def shares_by_statement(cells: DataFrame, outcomes: Sequence[str], statement: Sequence[str], system: str = "system") -> DataFrame:
    """``outcome_shares`` beside ``statement_level``, for cells that take work: they are looked at once, a statement's together."""
    name = lambda o: o.replace(" ", "_")
    each = cells.groupBy(system, *statement).agg(F.count(F.lit(1)).alias("cells"), *[F.count_if(F.col("outcome") == o).alias(name(o)) for o in outcomes], F.bool_and("right").alias("right"), F.bool_or("critical").alias("critical"))
    shares = [(F.sum(name(o)) / F.sum("cells")).alias(name(o)) for o in outcomes]
    return each.groupBy(system).agg(F.sum("cells").alias("cells"), *shares, F.count(F.lit(1)).alias("statements"), F.count_if("right").alias("fully_right"), F.count_if("critical").alias("with_critical"))


def offset_class(distance, heading=None):
    """Where a misplaced figure's label points, from its signed row distance (null: another statement) and
    whether the line there is a section heading, which goes before the distance."""
    return (
        F.when(F.lit(False) if heading is None else heading, "section heading")
        .when(distance.isNull(), "other statement")
        .when(distance == 1, "next")
        .when(distance == -1, "before")
        .when(F.abs(distance) == 2, "two lines off")
        .when(F.abs(distance) >= 3, "three or more")
        .otherwise("other cell")
    )


def side_rate(cells: DataFrame, counted: Sequence[str], base: int, system: str = "system") -> DataFrame:
    """(system, rate): counted outcomes over a fixed base, whatever is left out of the numerator."""
    return cells.groupBy(system).agg((F.count_if(F.col("outcome").isin(*counted)) / base).alias("rate"))


def placement(pages: DataFrame, system: str = "system") -> DataFrame:
    """(system, in_tables, outside_only, absent): pages by where most of their labels stand; of equally many, in
    this order. pages: system, labels_in_tables, labels_outside, labels_absent."""
    most = F.greatest("labels_in_tables", "labels_outside", "labels_absent")
    where = F.when(F.col("labels_in_tables") == most, "in_tables").when(F.col("labels_outside") == most, "outside_only").otherwise("absent")
    counted = pages.withColumn("where", where).groupBy(system).pivot("where", ["in_tables", "outside_only", "absent"]).count()
    return counted.na.fill(0)


def regroup(items: DataFrame) -> DataFrame:
    """items (item, old_fact, old_group, fact) with ``new_group``: the new verdict's where it changed, else the old."""
    names = F.create_map(*[F.lit(x) for kv in VERDICT_GROUP.items() for x in kv])
    return items.withColumn("new_group", F.when(F.col("fact") == F.col("old_fact"), F.col("old_group")).otherwise(F.try_element_at(names, F.col("fact"))))


def change_matrix(items: DataFrame, old: str = "old_fact", new: str = "fact") -> DataFrame:
    return items.where(F.col(old) != F.col(new)).groupBy(old, new).agg(F.count(F.lit(1)).alias("n"))


def worse_than(scores: DataFrame, baseline: str, unit: Sequence[str], run: str = "run", score: str = "score") -> DataFrame:
    """(run, worse, units): units on which a run scores below the baseline run."""
    base = scores.where(F.col(run) == baseline).select(*unit, F.col(score).alias("base"))
    both = scores.where(F.col(run) != baseline).join(base, list(unit))
    return both.groupBy(run).agg(F.count_if(F.col(score) < F.col("base")).alias("worse"), F.count(F.lit(1)).alias("units"))
