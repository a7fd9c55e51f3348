"""What a table contains, which role each column may play and which ones drive demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions import columns as C
from ..functions.fixed import (
    DATE_NAME_TOKENS, EVENT_TOKENS, EXTERNAL_TOKENS, METADATA_COLUMNS, PREFERRED_SIGNALS, ROLE_TOKENS,
)


def profile_table(df: DataFrame, name: str = "") -> DataFrame:
    """One row per column: position, row count, share of numbers, numeric or date by name.

    One aggregate over the table; the result has as many rows as the table has columns.
    """
    hits = []
    for f in df.schema:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.NumericType):
            hits += [F.count(column).alias(f"p_{f.name}"), F.count(column).alias(f"f_{f.name}")]
        else:
            hits += [
                F.count(C.to_number(column.cast("string"))).alias(f"p_{f.name}"), F.count(column).alias(f"f_{f.name}")
            ]
    one = df.agg(F.count("*").alias("n"), *hits)
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.col(f"`p_{f.name}`").alias("numbers"),
            F.col(f"`f_{f.name}`").alias("filled"),
        )
        for i, f in enumerate(df.schema)
    ]))
    long = one.select(F.lit(name).alias("table"), F.col("n").alias("rows"), rows.alias("r")).select("table", "rows", "r.*")
    lower = F.lower("column")
    return long.withColumns({
        # a column is numeric if every value it has is a number
        "is_numeric": (F.col("filled") > 0) & (F.col("numbers") == F.col("filled")),
        "is_date_name": C.contains_any(lower, DATE_NAME_TOKENS),
    })


def sample_rows(df: DataFrame, n: int = 6) -> DataFrame:
    return df.limit(n)


def suggest_roles(profile: DataFrame) -> DataFrame:
    """Best column per table and role, and the drivers that are left.

    Tokens are tried in order; within one token the first column wins. Date looks at
    columns with a date-like name and target at numeric ones, if the table has any.
    """
    per_table = W.partitionBy("table")
    base = profile.withColumns({
        "__any_date": F.max("is_date_name").over(per_table), "__any_num": F.max("is_numeric").over(per_table),
        "__lower": F.lower("column"),
    })
    roles = []
    for role, tokens in ROLE_TOKENS.items():
        rank = F.lit(None).cast("int")
        for i, token in reversed(list(enumerate(tokens))):
            rank = F.when(F.col("__lower").contains(token), i).otherwise(rank)
        pool = F.lit(True)
        if role == "date":
            pool = F.col("is_date_name") | ~F.col("__any_date")
        elif role == "target":
            pool = F.col("is_numeric") | ~F.col("__any_num")
        roles.append(F.struct(F.lit(role).alias("role"), F.when(pool, rank).alias("rank")))
    ranked = base.withColumn("r", F.explode(F.array(*roles))).filter("r.rank IS NOT NULL")
    picked = ranked.groupBy("table", F.col("r.role").alias("role")).agg(
        F.min_by("column", F.struct("r.rank", "position")).alias("column")
    )
    free = profile.join(picked.select("table", "column").distinct(), ["table", "column"], "left_anti")
    event = C.contains_any(F.lower("column"), EVENT_TOKENS)
    drivers = free.filter(F.col("is_numeric") | event).select("table", F.lit("driver").alias("role"), "column")
    return picked.unionByName(drivers)


def default_drivers(profile: DataFrame, mapped: list[str], suggested: list[str] = (), most: int = 12, fallback: int = 8) -> DataFrame:
    """Suggested, then preferred signals, at most 12; without any the first 8 numeric columns."""
    usable = profile.filter(~F.col("column").isin([*mapped, *METADATA_COLUMNS]))
    wanted = list(dict.fromkeys([*suggested, *PREFERRED_SIGNALS]))
    place = F.array_position(F.array(*[F.lit(c) for c in wanted]), F.col("column"))
    by_table = W.partitionBy("table")
    ranked = usable.withColumn("__place", F.when(place > 0, place))
    ranked = ranked.withColumn("__chosen", F.max(F.col("__place").isNotNull()).over(by_table))
    order = F.coalesce(F.col("__place").cast("bigint"), F.col("position").cast("bigint"))
    kept = ranked.filter(F.when(F.col("__chosen"), F.col("__place").isNotNull()).otherwise(F.col("is_numeric")))
    kept = kept.withColumn("rank", F.row_number().over(by_table.orderBy(order)))
    limit = F.when(F.col("__chosen"), most).otherwise(fallback)
    return kept.filter(F.col("rank") <= limit).select("table", "column", "rank")


def driver_role(name: Column, tokens: list[str] = EXTERNAL_TOKENS, overrides: dict[str, str] | None = None) -> Column:
    """External if the name contains a token, unless the user says otherwise."""
    guess = F.when(C.contains_any(F.lower(name), tokens), "external").otherwise("internal")
    for column, role in (overrides or {}).items():
        if role in ("internal", "external"):
            guess = F.when(name == column, role).otherwise(guess)
    return guess
