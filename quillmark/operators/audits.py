"""Audits by rules: accessibility, security, export gates, and evaluation suites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators.scores import findings, penalised

# Fixed values ------------------------------------------------------------------------------
A11Y_ERROR, A11Y_WARNING, A11Y_PASS = 18, 6, 80
SECURITY_ERROR, SECURITY_WARNING, SECURITY_PASS = 14, 5, 90
EXPORT_FAIL, EXPORT_WARN, EXPORT_PASS = 22, 5, 85
SMALL_TARGET, CONTRAST, LARGE_CONTRAST = 24, 4.5, 3.0
RETENTION_HOURS = 24
# -------------------------------------------------------------------------------------------


def accessibility(nodes: DataFrame) -> DataFrame:
    """(fixture, pos, node_id, rules): the accessibility rules that each node of a tree breaks.

    A repeated id counts before visibility does; headings are compared with the last
    visible heading before them.
    """
    order = Window.partitionBy("fixture").orderBy("pos")
    repeated = F.row_number().over(Window.partitionBy("fixture", "node_id").orderBy("pos")) > 1
    level = F.when(F.col("visible"), F.col("heading"))
    before = F.last(level, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = nodes.withColumn("repeated", repeated).withColumn("before", before)
    seen, active = F.col("visible"), F.col("visible") & F.col("interactive")
    least = F.when(F.col("large_text"), LARGE_CONTRAST).otherwise(CONTRAST)
    rules = [
        (F.col("repeated"), "unique-id", "error"), (active & (T.normalize(F.coalesce("name", F.lit(""))) == ""), "accessible-name", "error"), (active & ~F.col("focusable"), "keyboard-focusable", "error"),
        (seen & F.col("focusable") & ~F.col("visible_focus"), "focus-visible", "error"), (seen & (F.col("contrast") < least), "text-contrast", "error"),
        (active & ((F.col("width") < SMALL_TARGET) | (F.col("height") < SMALL_TARGET)), "target-size", "warning"), (seen & (F.col("heading") > F.col("before") + 1), "heading-order", "warning"),
    ]
    return rows.select("fixture", "pos", "node_id", findings(rules).alias("found"))


def accessibility_score(found: DataFrame) -> DataFrame:
    """(fixture, errors, warnings, score, passed) of ``accessibility``'s rows, combined on the map side."""
    def count(severity: str) -> Column:
        return F.sum(F.size(F.filter("found", lambda f: f["severity"] == severity)))

    rows = found.groupBy("fixture").agg(count("error").alias("errors"), count("warning").alias("warnings"))
    rows = rows.withColumn("score", F.greatest(F.lit(0), 100 - F.col("errors") * A11Y_ERROR - F.col("warnings") * A11Y_WARNING))
    return rows.withColumn("passed", (F.col("errors") == 0) & (F.col("score") >= A11Y_PASS))


def security(profiles: DataFrame) -> DataFrame:
    """(id, found, score, passed) of security profiles, one boolean or number a control."""
    c = F.col
    rules = [
        (c("network") != "none", "document-worker-no-network", "error"), (c("root"), "document-worker-non-root", "error"), (~c("read_only"), "document-worker-read-only", "error"), (~c("limits"), "document-worker-resource-limits", "error"),
        (c("retention_hours") > RETENTION_HOURS, "retention-24h", "error"), (c("raw_logs"), "metadata-only-logs", "error"), ((c("audio") == "transient") & ~c("audio_deleted"), "audio-delete", "error"),
        (~c("redacted"), "pii-redaction", "error"), (~c("allowlist"), "skill-static-allowlist", "error"), (c("secrets"), "skill-secret-isolation", "error"), (c("grants"), "prompt-permission-boundary", "error"),
    ]
    rows = profiles.select("id", findings(rules).alias("f"))
    score = penalised(F.col("f"), SECURITY_ERROR, SECURITY_WARNING)
    return rows.select("id", F.array_join(F.transform("f", lambda x: x["code"]), ",").alias("found"), score.alias("score"), ((F.size("f") == 0) & (score >= SECURITY_PASS)).alias("passed"))


def export_gate(checks: DataFrame) -> DataFrame:
    """(id, score, gate) of (id, check, status, blocking): failed checks that don't block count as warnings."""
    status = F.when((F.col("status") == "fail") & ~F.col("blocking"), "warn").otherwise(F.col("status"))
    rows = checks.withColumn("status", status).groupBy("id").agg(F.count_if(F.col("status") == "fail").alias("fails"), F.count_if(F.col("status") == "warn").alias("warns"))
    rows = rows.withColumn("score", F.greatest(F.lit(0), 100 - F.col("fails") * EXPORT_FAIL - F.col("warns") * EXPORT_WARN))
    gate = F.when(F.col("fails") > 0, "blocked").when(F.col("score") >= EXPORT_PASS, "pass").otherwise("review")
    return rows.select("id", "fails", "warns", "score", gate.alias("gate"))


def asserted(actual: Column, operator: Column, expected: Column) -> Column:
    """Whether a resolved JSON value (null: no such path) meets an assertion; values are JSON texts."""
    number, wanted = actual.try_cast("double"), expected.try_cast("double")
    inside = F.contains(actual, expected)
    return F.coalesce(
        F.when(operator == "exists", actual.isNotNull()).when(operator == "equals", actual == expected).when(operator == "contains", inside)
        .when(operator == "not_contains", ~inside).when(operator == "gte", number >= wanted).when(operator == "lte", number <= wanted),
        F.lit(False),
    )


def suite_rollup(assertions: DataFrame) -> DataFrame:
    """(suite, fixtures, passed_fixtures, assertions, passed, rate) of (suite, fixture, passed) rows."""
    fixtures = assertions.groupBy("suite", "fixture").agg(F.count("*").alias("n"), F.count_if("passed").alias("ok"))
    rows = fixtures.groupBy("suite").agg(F.count("*").alias("fixtures"), F.count_if(F.col("n") == F.col("ok")).alias("passed_fixtures"), F.sum("n").alias("assertions"), F.sum("ok").alias("passed"))
    return rows.withColumn("rate", T.half_up(F.col("passed") / F.col("assertions") * 100, 1))
