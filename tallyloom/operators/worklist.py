"""Work queues and expected-versus-actual checks between tables keyed alike."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pending(inputs: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Inputs without an output record."""
    return inputs.join(done, on, "left_anti")


def ready(inputs: DataFrame, records: DataFrame, on: str, upstream_ok: Column, downstream: Column) -> DataFrame:
    """Inputs with a successful upstream record and no downstream record.

    Both conditions are read off one aggregate of ``records``, which is scanned once.
    """
    state = (
        records.filter(upstream_ok | downstream).groupBy(on)
        .agg(F.bool_or(upstream_ok).alias("_up"), F.bool_or(downstream).alias("_down"))
        .filter(F.col("_up") & ~F.col("_down"))
    )
    return inputs.join(state, on, "left_semi")


def with_context(inputs: DataFrame, context: DataFrame, on: list[str], available: str = "available") -> DataFrame:
    """Left outer lookup with a flag that tells a missing context row from a NULL in it."""
    flagged = context.withColumn(available, F.lit(True))
    joined = inputs.join(flagged, on, "left")
    return joined.withColumn(available, F.coalesce(F.col(available), F.lit(False)))


def reconcile(expected: DataFrame, actual: DataFrame, on: str, tolerance: float,
              error: str | None = None) -> DataFrame:
    """Compare ``expected.expected`` with ``actual.actual`` per key.

    PASS within the tolerance, FAIL beyond it, ERROR where the actual value is missing, UNEXPECTED
    where nothing was expected. With a column of error texts on the actual side, a text that starts
    with TIMEOUT gives TIMEOUT and any other text gives ERROR.
    """
    joined = expected.join(actual, on, "full_outer")
    problem = F.col(error) if error else F.lit(None).cast("string")
    same = F.col("expected").eqNullSafe(F.col("actual")) | (
        F.abs(F.col("expected") - F.col("actual")) <= tolerance
    )
    return joined.withColumn(
        "status",
        F.when(F.col("expected").isNull(), "UNEXPECTED")
        .when(problem.startswith("TIMEOUT"), "TIMEOUT").when(problem.isNotNull(), "ERROR")
        .when(F.col("actual").isNull(), "ERROR").when(same, "PASS").otherwise("FAIL"),
    )


def against_both(cases: DataFrame, actual: str, expected: str, truth: str, tolerance: float) -> DataFrame:
    """Flags of a three-way check: does the actual value match the expected one, the true one, both?

    A missing actual value matches nothing; a missing expected or true value is matched by none.
    """
    def near(other: str) -> Column:
        return F.coalesce(F.abs(F.col(actual) - F.col(other)) <= tolerance, F.lit(False))

    return cases.withColumns({"matches_expected": near(expected), "matches_truth": near(truth),
                              "matches_both": near(expected) & near(truth)})


def unsettled(cases: DataFrame, key: str) -> DataFrame:
    """The failed and skipped cases themselves, with the reason: one row for each case that did not pass."""
    return cases.filter(F.col("status") != "PASS").select(key, "status")


def phase_chain(inputs: DataFrame, phases: list[tuple[str, DataFrame]], on: list[str]) -> DataFrame:
    """Per phase of a chain: completed, ready (every phase before is completed) and blocked inputs.

    The phases' records are joined to the inputs one after the other and counted in one pass; records of
    unknown inputs count nowhere.
    """
    state = inputs.select(*on).distinct()
    for name, done in phases:
        state = with_context(state, done.select(*on).distinct(), on, f"_{name}")
    before, counts = F.lit(True), []
    for name, _ in phases:
        own = F.col(f"_{name}")
        counts.append(F.struct(
            F.lit(name).alias("phase"), F.count_if(own).alias("completed"),
            F.count_if(~own & before).alias("ready"), F.count_if(~own & ~before).alias("blocked")))
        before = before & own
    return state.agg(F.array(*counts).alias("_all")).select(F.inline("_all"))


def pass_rates(cases: DataFrame, keys: list[str], passed: Column, tested: Column) -> DataFrame:
    """Found, tested, skipped and passed cases per key; a key succeeds if all tested cases pass."""
    found, n_tested, n_passed = F.count(F.lit(1)), F.count_if(tested), F.count_if(tested & passed)
    return cases.groupBy(*keys).agg(
        found.alias("found"), n_tested.alias("tested"), (found - n_tested).alias("skipped"),
        n_passed.alias("passed"), (n_passed == n_tested).alias("all_passed"),
    )


def roll_up(rates: DataFrame, keys: list[str]) -> DataFrame:
    """``pass_rates`` of a coarser key from those of a finer one."""
    return rates.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("found", "tested", "skipped", "passed")],
        (F.sum("passed") == F.sum("tested")).alias("all_passed"),
    )


def phase_status(phases: dict[str, tuple[DataFrame, DataFrame]], on: list[str]) -> DataFrame:
    """Per phase how many of its inputs are completed and how many are still pending."""
    rows = []
    for name, (inputs, done) in phases.items():
        state = with_context(inputs.select(*on), done.select(*on).distinct(), on, "_done")
        rows.append(state.agg(
            F.lit(name).alias("phase"), F.count_if("_done").alias("completed"),
            F.count_if(~F.col("_done")).alias("pending")))
    return reduce(DataFrame.unionByName, rows)


def similarity_summary(pairs: DataFrame, score: Column, exact: Column, available: Column) -> DataFrame:
    """Mean score and bucket counts over the available comparisons.

    The buckets put a score of exactly 0.5 under medium, while the tier label calls it LOW; both
    rules are kept apart on purpose.
    """
    live = pairs.filter(available)
    return live.agg(
        F.count(F.lit(1)).alias("compared"), F.round(F.avg(score), 6).alias("mean_score"),
        F.count_if(exact).alias("exact"), F.count_if(score > 0.8).alias("high"),
        F.count_if((score >= 0.5) & (score <= 0.8)).alias("medium"), F.count_if(score < 0.5).alias("low"),
    )


def tier(score: Column, exact: Column) -> Column:
    return F.when(exact, "EXACT").when(score > 0.8, "HIGH").when(score > 0.5, "MED").otherwise("LOW")


def outcome(success: Column, passed: Column, known: Column) -> Column:
    """UNKNOWN without a record, FAILED on error, else PASSED or NEEDS_REVIEW."""
    return (
        F.when(~F.coalesce(known, F.lit(False)), "UNKNOWN")
        .when(~F.coalesce(success, F.lit(False)), "FAILED")
        .when(F.coalesce(passed, F.lit(False)), "PASSED").otherwise("NEEDS_REVIEW")
    )
