"""The queue of things a planner should look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _line(section: int, rule: int, priority: Column, item: Column, reason: Column, owner: str, order: Column) -> list[Column]:
    return [
        F.lit(section).alias("section"), order.alias("place"), F.lit(rule).alias("rule"), priority.alias("priority"),
        item.alias("item"), reason.alias("reason"), F.lit(owner).alias("owner"),
    ]


def diagnostic_rules(diagnostics: DataFrame) -> DataFrame:
    """All findings per item: quality, bias, demand class, break and isolated zeros."""
    label = F.coalesce("sku", "item_id") if "sku" in diagnostics.columns else F.col("item_id")
    poor = F.col("quality_score") < 65
    found = lambda rule, when, priority, reason, owner: F.when(
        when, F.struct(F.lit(rule).alias("rule"), F.lit(priority).alias("priority"), reason.alias("reason"), F.lit(owner).alias("owner"))
    )
    whole = lambda c: F.format_number(F.col(c).cast("double"), 0)
    rules = F.array(
        found(1, poor, "high", F.concat(F.lit("Forecast quality is "), whole("quality_score"), F.lit(" / 100.")), "Demand planner"),
        found(2, ~poor & (F.abs("bias_pct") > 15), "medium",
              F.concat(F.lit("Forecast bias is "), F.format_number("bias_pct", 1), F.lit("%.")), "Demand planner"),
        found(3, F.col("demand_class").isin("intermittent", "lumpy"), "medium",
              F.concat(F.initcap("demand_class"), F.lit(" demand needs an intermittent method review.")), "Demand planner"),
        found(4, F.col("structural_break"), "high",
              F.lit("Recent demand shifted materially from the prior operating window."), "Demand planner"),
        found(5, F.col("stockout_suspected"), "medium",
              F.concat(whole("isolated_zero_periods"), F.lit(" isolated zero period(s) may hide a stockout or lost sale.")), "Supply planner"),
    )
    rows = diagnostics.select("item_id", label.alias("item"), F.explode(F.array_compact(rules)).alias("f"))
    return rows.select(
        F.lit(3).alias("section"), F.col("item_id").alias("place"), "f.rule", "f.priority", "item", "f.reason", "f.owner"
    )


def exceptions(
    diagnostics: DataFrame, actions: DataFrame | None = None, evidence: DataFrame | None = None,
    warnings: DataFrame | None = None, n: int | None = 14,
) -> DataFrame:
    """Evidence first, then up to three warnings, item findings and up to five actions.

    ``n=None`` returns every finding; the default is the short queue for a home page.
    """
    out = diagnostic_rules(diagnostics)
    if evidence is not None:
        limited = evidence.filter("evidence_level = 'limited'").select(*_line(
            1, 1, F.lit("high"), F.lit("Whole plan"), F.col("evidence_reason"), "Demand planner", F.lit("")))
        out = out.unionByName(limited)
    if warnings is not None:
        priority = F.when(F.col("warning").contains("missing future"), "high").otherwise("medium")
        some = warnings.orderBy("warning")
        some = (some.limit(3) if n is not None else some).select(*_line(
            2, 1, priority, F.lit("Data input"), F.col("warning"), "Data owner", F.col("warning")))
        out = out.unionByName(some)
    if actions is not None:
        first = actions.orderBy(F.col("priority") != "high", "period", "type", "subject")
        place = F.concat(F.when(F.col("priority") == "high", "0").otherwise("1"), F.col("period").cast("string"), F.col("subject"))
        some = (first.limit(5) if n is not None else first).select(
            F.lit(4).alias("section"), place.alias("place"), F.lit(1).alias("rule"), "priority",
            F.col("subject").alias("item"), F.col("action").alias("reason"), "owner")
        out = out.unionByName(some)
    if n is not None:
        out = out.orderBy("section", "place", "rule").limit(n)
    return out.drop("place", "rule")


def worst_first(diagnostics: DataFrame, n: int | None = None) -> DataFrame:
    """Series by rising quality score, all or the ``n`` worst."""
    ranked = diagnostics.orderBy("quality_score", "item_id")
    return ranked if n is None else ranked.limit(n)
