"""Named rules: evaluate, split, report, and persist what failed together with why."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

VIOLATIONS = "_violations"

# Rule names and bounds, in the order they are reported.
RESCUED_RULE = {"no_rescued_fields": "_rescued_data IS NULL"}
SALES_RULES = {
    **RESCUED_RULE,
    "known_sku": "_sku_known IS NOT NULL",
    "positive_quantity": "quantity > 0",
    "positive_price": "unit_price > 0",
    "price_not_above_list": "unit_price <= list_price * 1.001D",
    "discount_within_bounds": "discount_pct BETWEEN 0 AND 0.9D",
}
RETURNS_RULES = {
    **RESCUED_RULE,
    "matched_to_sale": "_sale_matched IS NOT NULL",
    "positive_quantity": "quantity > 0",
    "returned_after_sale": "returned_at >= _sale_date",
}
INVENTORY_RULES = {
    **RESCUED_RULE,
    "known_sku": "_sku_known IS NOT NULL",
    "non_negative_on_hand": "on_hand >= 0",
    "non_negative_on_order": "on_order >= 0",
}


def evaluate_rules(df: DataFrame, rules: Mapping[str, str], null_policy: str = "pass") -> DataFrame:
    """Add the names of the broken rules, in declared order.

    A rule that evaluates to NULL says nothing about the row: it passes unless
    ``null_policy`` is ``"fail"``.
    """
    if null_policy not in ("pass", "fail"):
        raise ValueError(f"null_policy must be 'pass' or 'fail', not {null_policy!r}")
    when_null = F.lit(null_policy == "pass")
    holds = {name: F.coalesce(F.expr(check), when_null) for name, check in rules.items()}
    none = F.array().cast("array<string>")
    names = F.concat(none, *[F.when(~held, F.array(F.lit(name))).otherwise(none) for name, held in holds.items()])
    # The names are only put together for the rows that need them, and without a lambda, which no generated code holds.
    return df.withColumn(VIOLATIONS, F.when(reduce(and_, holds.values()), none).otherwise(names))


def passed(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size(VIOLATIONS) == 0).drop(VIOLATIONS)


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size(VIOLATIONS) > 0)


def violation_report(quarantine: DataFrame) -> DataFrame:
    """How many rows broke each rule, most frequent first."""
    return (
        quarantine.select(F.explode(VIOLATIONS).alias("rule"))
        .groupBy("rule")
        .agg(F.count(F.lit(1)).alias("failing"))
        .orderBy(F.desc("failing"), "rule")
    )


def quarantine_stats(checked: DataFrame) -> DataFrame:
    """Rows in, kept and rejected, and the rejected percentage (zero over no rows), in one pass."""
    bad = F.count_if(F.size(VIOLATIONS) > 0)
    return with_rates(checked.agg(F.count(F.lit(1)).alias("rows_in"), bad.alias("rejected")))


def with_rates(counted: DataFrame) -> DataFrame:
    """``rows_in`` and ``rejected`` with what was kept and the rejected percentage."""
    return counted.select(
        "rows_in",
        (F.col("rows_in") - F.col("rejected")).alias("kept"),
        "rejected",
        F.round(F.coalesce(F.col("rejected") / F.nullif("rows_in", F.lit(0)) * 100, F.lit(0.0)), 2).alias("rejected_pct"),
    )


def quarantine(
    checked: DataFrame, path: str, source: str, batch_id: str, counts: Observation | None = None
) -> tuple[DataFrame, DataFrame]:
    """Persist a checked batch, split into kept and quarantined rows.

    ``counts`` observes the write: ``rows_in`` and ``rejected`` of the batch, without reading it again.

    Both halves come out of one write, so the plan above runs once and nothing is cached.
    The folder is named after the batch: running a batch again replaces it instead of
    adding its quarantined rows a second time.
    """
    target = f"{path}/batch_id={batch_id}"
    seen = checked
    if counts is not None:
        bad_rows = F.count_if(F.size(VIOLATIONS) > 0)
        seen = checked.observe(counts, F.count(F.lit(1)).alias("rows_in"), bad_rows.alias("rejected"))
    (
        seen.withColumn("_quarantined", F.size(VIOLATIONS) > 0)
        .withColumn("_quarantined_at", F.current_timestamp())
        .withColumn("_source_table", F.lit(source))
        .write.mode("overwrite")
        .partitionBy("_quarantined")
        .parquet(target)
    )
    tags = T.StructType().add("_quarantined_at", "timestamp").add("_source_table", "string").add("_quarantined", "boolean")
    schema = T.StructType([*checked.schema.fields, *tags.fields])
    kept_and_bad = checked.sparkSession.read.schema(schema).parquet(target)
    kept = kept_and_bad.filter(~F.col("_quarantined")).drop(VIOLATIONS, "_quarantined", "_quarantined_at", "_source_table")
    bad = kept_and_bad.filter("_quarantined").drop("_quarantined")
    return kept, bad
