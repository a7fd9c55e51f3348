"""Item metadata, hierarchy totals and view figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import columns as C
from ..functions.fixed import OPERATIONAL_FIELDS

MEASURES = ["baseline_mean", "mean", "p10", "p50", "p90"]


def series_metadata(
    df: DataFrame,
    *,
    item_col: str | None,
    sku_col: str | None = None,
    category_col: str | None = None,
    customer_col: str | None = None,
    order_by: list[str] = (),
    fields: list[str] = OPERATIONAL_FIELDS,
) -> DataFrame:
    """The last row of every item in file order: three dimensions and operational fields."""
    if not item_col or item_col not in df.columns:
        return df.select(F.lit("Total demand").alias("item_id"), F.lit("Total demand").alias("sku")).limit(1)
    order = F.struct(*order_by) if order_by else F.monotonically_increasing_id()

    def dimension(name: str | None) -> Column:
        return C.clean_text(F.col(name)) if name and name in df.columns else F.lit(None).cast("string")

    sku = dimension(sku_col) if sku_col else F.col(item_col).cast("string")
    parts = [sku.alias("sku"), dimension(category_col).alias("category"), dimension(customer_col).alias("customer")]
    parts += [F.col(f) for f in fields if f in df.columns]
    last = (
        df.filter(F.col(item_col).isNotNull())
        .groupBy(F.col(item_col).cast("string").alias("item_id"))
        .agg(F.max_by(F.struct(*parts), order).alias("m"))
    )
    return last.select("item_id", "m.*")


def last_rows(df: DataFrame, key: str, order_by: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key in the order given: small enough to join where the raw rows are not."""
    newest = F.max_by(F.struct(*columns), F.struct(*order_by)).alias("m")
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(newest).select(key, "m.*")


def dimensions(meta: DataFrame) -> DataFrame:
    """Distinct members per dimension as rows, so that no list has to fit one row."""
    names = ["category", "customer", "sku"]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(n).alias("member")) for n in names]))
    return meta.select(pairs.alias("p")).select("p.*").filter("member IS NOT NULL").distinct()


def rollup(rows: DataFrame, meta: DataFrame, levels: list[str], measures: list[str] = MEASURES) -> DataFrame:
    """Bottom-up totals for each level and for everything: ``level, member, ts, sums``.

    Unlike the portfolio range, a view adds up the ranges of its items.
    """
    joined = rows.join(meta.select("item_id", *levels), "item_id", "left")
    cols = [F.col(c) for c in levels]
    sets = [[F.col("ts"), c] for c in cols] + [[F.col("ts")]]
    sums = [F.sum(m).alias(m) for m in measures]
    totals = joined.groupingSets(sets, F.col("ts"), *cols).agg(*sums, F.grouping_id().alias("__g"))
    width = len(levels)
    level, member = F.lit("all"), F.lit(None).cast("string")
    for i, name in enumerate(levels):
        mine = F.col("__g").bitwiseAND(1 << (width - 1 - i)) == 0
        level = F.when(mine, name).otherwise(level)
        member = F.when(mine, F.col(name).cast("string")).otherwise(member)
    out = totals.select(level.alias("level"), member.alias("member"), "ts", *measures)
    return out.filter("level = 'all' OR member IS NOT NULL")


def view_kpis(history: DataFrame, forecast: DataFrame, keys: list[str]) -> DataFrame:
    """Total, range and change against as many past periods as there are forecast ones.

    ``history`` holds one row per view and date, ``forecast`` likewise.
    """
    ahead = forecast.groupBy(*keys).agg(
        F.sum("mean").alias("forecast_total"), F.sum("p10").alias("forecast_low"),
        F.sum("p90").alias("forecast_high"), F.count("*").alias("periods"),
    )
    newest = W.partitionBy(*keys).orderBy(F.desc("ts"))
    past = history.withColumn("__r", F.row_number().over(newest)).join(ahead, keys)
    prior = past.filter(F.col("__r") <= F.col("periods")).groupBy(*keys).agg(F.sum("target").alias("prior_total"))
    change = F.when(F.col("prior_total") != 0, (F.col("forecast_total") / F.col("prior_total") - 1.0) * 100.0).otherwise(0.0)
    return ahead.join(prior, keys, "left").withColumn("change_pct", F.coalesce(change, F.lit(0.0)))


def nest_run(history: DataFrame, forecast: DataFrame, methods: DataFrame, keep: int = 48) -> DataFrame:
    """Per item: last points, forecast rows and each model's values as nested columns."""
    newest = W.partitionBy("item_id").orderBy(F.desc("ts"))
    recent = history.withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") <= keep)
    past = recent.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("ts", "target"))).alias("history"))
    ahead = forecast.groupBy("item_id").agg(
        F.array_sort(F.collect_list(F.struct("ts", *MEASURES))).alias("forecast")
    )
    lanes = methods.groupBy("item_id", "model").agg(
        F.array_sort(F.collect_list(F.struct("ts", F.greatest(F.lit(0.0), "pred").alias("mean")))).alias("points")
    )
    lanes = lanes.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("model", "points"))).alias("methods"))
    return past.join(ahead, "item_id", "left").join(lanes, "item_id", "left")
