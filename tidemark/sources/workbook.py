"""Sheet ranking, header detection and reshaping over a table of cells.

Cells ``(path, sheet, row, col, value)`` of any number of workbooks go through the same
aggregates at once. ``row`` and ``col`` start at 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import columns as C
from ..functions.fixed import (
    HEADER_KEYWORDS, MATRIX_KEYS, MATRIX_METADATA, PROBE_ROWS, REQUIRED_TABLES, SHEET_ALIASES, SHEET_NAME_WEIGHTS,
)


def _probe(cells: DataFrame) -> DataFrame:
    return cells.filter((F.col("row") < PROBE_ROWS) & F.col("value").isNotNull())


def score_sheets(cells: DataFrame) -> DataFrame:
    """Score of every sheet from its name, how full and how wide its first rows are."""
    by_row = _probe(cells).groupBy("path", "sheet", "row").agg(F.count("*").alias("width"))
    shape = by_row.groupBy("path", "sheet").agg(F.sum("width").alias("filled"), F.max("width").alias("width"))
    name = F.lower(F.trim("sheet"))
    named = F.lit(0)
    for token, weight in SHEET_NAME_WEIGHTS.items():
        named = named + F.when(name.contains(token), weight).otherwise(0)
    score = named + F.least(F.col("filled") / 20.0, F.lit(25.0)) + F.least(F.col("width").cast("double"), F.lit(30.0))
    return shape.select("path", "sheet", score.alias("score"))


def rank_sheets(cells: DataFrame) -> DataFrame:
    """The sheet to use per workbook; equal scores go to the later name."""
    best = F.max(F.struct("score", "sheet")).alias("b")
    return score_sheets(cells).groupBy("path").agg(best).select("path", "b.sheet", "b.score")


def choose_sheet(cells: DataFrame, sheet: str) -> DataFrame:
    chosen = cells.filter(F.col("sheet") == sheet)
    if not chosen.take(1):
        raise ValueError(f"no worksheet named {sheet!r}")
    return chosen


def detect_header(cells: DataFrame) -> DataFrame:
    """The likeliest header row of every sheet; the first of equal rows wins."""
    value = F.lower(F.trim("value"))
    filled = _probe(cells).withColumn("__v", value).filter("__v <> ''")
    rows = filled.groupBy("path", "sheet", "row").agg(
        F.count_if(C.contains_any(F.col("__v"), HEADER_KEYWORDS)).alias("hits"),
        F.count("*").alias("n"), F.count_distinct("__v").alias("different"),
    )
    score = F.col("hits") * 8 + F.least("n", F.lit(30)) + F.col("different") / F.col("n")
    rows = rows.withColumn("score", score.cast("double"))
    best = F.max_by(F.struct("row", "score"), F.struct("score", -F.col("row")))
    return rows.groupBy("path", "sheet").agg(best.alias("b")).select("path", "sheet", F.col("b.row").alias("header_row"), "b.score")


def _with_header(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Cells with the header row of their sheet. There may be as many sheets as files allow, so their table never goes through the driver."""
    return cells.join(headers.select("path", "sheet", "header_row").hint("merge"), ["path", "sheet"])


def sheet_columns(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Column names by position: ``path, sheet, col, name``; repeats get .1, .2 and so on."""
    named = _with_header(cells, headers).filter("row = header_row")
    names = named.select("path", "sheet", "col", F.trim("value").alias("name"))
    turn = F.row_number().over(W.partitionBy("path", "sheet", "name").orderBy("col")) - 1
    return names.withColumn("__k", turn).select(
        "path", "sheet", "col", F.when(F.col("__k") > 0, F.concat_ws(".", "name", F.col("__k").cast("string"))).otherwise(F.col("name")).alias("name")
    )


def sheet_table(cells: DataFrame, headers: DataFrame, columns: list[str]) -> DataFrame:
    """Rows below the header with the given columns, for all sheets that have them."""
    names = sheet_columns(cells, headers).filter(F.col("name").isin(columns))
    body = _with_header(cells, headers).filter("row > header_row")
    joined = body.join(names, ["path", "sheet", "col"])
    picks = [F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in columns]
    return joined.groupBy("path", "sheet", "row").agg(*picks)


def column_status(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Status word per column: the row two above the header, filled to the right."""
    at = F.greatest(F.lit(0), F.col("header_row") - 2)
    known = _with_header(cells, headers)
    width = known.filter("row = header_row").select("path", "sheet", "col")
    words = known.filter(F.col("row") == at).select("path", "sheet", "col", F.lower(F.trim("value")).alias("word"))
    both = width.join(words, ["path", "sheet", "col"], "full_outer")
    carried = F.last("word", ignorenulls=True).over(W.partitionBy("path", "sheet").orderBy("col"))
    return both.select("path", "sheet", "col", F.coalesce(carried, F.lit("")).alias("status"))


def month_dates(columns: list[str]) -> dict:
    """First of the month of the column names that are dates between 2020 and 2100 and not a repeat of one."""
    import pandas as pd

    found = {}
    for name in columns:
        day = pd.to_datetime(name, errors="coerce") if not name.endswith(".1") else pd.NaT
        if not pd.isna(day) and 2020 <= day.year <= 2100:
            found[name] = day.date().replace(day=1)
    return found


def matrix_months(columns: list[str]) -> list[str]:
    return list(month_dates(columns))


def unpivot_matrix(df: DataFrame, status: DataFrame | None = None, sheet: str = "") -> DataFrame:
    """Wide article by month matrix to long rows; other tables are returned as they are.

    ``status`` maps a column ``name`` to its status word.
    """
    dates = month_dates(df.columns)
    months = list(dates)
    if not set(MATRIX_KEYS) <= set(df.columns) or len(months) < 3:
        return df
    meta = {new: old for new, old in MATRIX_METADATA.items() if old in df.columns}
    types = {f.name: f.dataType for f in df.schema}
    kind = "string" if any(C.is_text(types[m]) for m in months) else "double"
    kept = df.filter(F.col("Article Number").isNotNull() & F.col("Customer Name").isNotNull())
    ids = kept.select(
        F.concat_ws(" · ", "Article Number", "Customer Name").alias("series_id"),
        *[F.col(old).alias(new) for new, old in meta.items()],
        *[F.col(f"`{m}`").cast(kind).alias(m) for m in months],
    )
    # one value column is parsed, instead of one expression per month
    long = ids.unpivot(["series_id", *meta], months, "name", "demand")
    long = long.withColumn("demand", C.to_number(F.col("demand"))).filter("demand IS NOT NULL")
    if status is not None:
        long = long.join(status.select(F.col("name"), F.col("status")), "name", "left")
    else:
        long = long.withColumn("status", F.lit(""))
    record = F.when(F.coalesce(F.col("status"), F.lit("")).contains("forecast"), "forecast").otherwise("actual")
    # the date that made a column a month is the one its rows get
    day = F.create_map(*[F.lit(v) for pair in dates.items() for v in pair])
    return long.select(
        F.try_element_at(day, F.col("name")).alias("date"), "demand", "series_id", record.alias("record_type"),
        F.lit(sheet).alias("source_sheet"), *meta,
    )


# --- operations master ------------------------------------------------------------------


def _plain(name: str) -> str:
    return name.strip().lower().replace("%", "pct").replace("/", "_").replace(" ", "_")


def load_operations(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Sheets by name to the six logical tables, with plain column names and no empty rows."""
    by_alias = {alias: key for key, aliases in SHEET_ALIASES.items() for alias in aliases}
    found = {}
    for sheet, df in tables.items():
        key = by_alias.get(sheet.strip().lower())
        if key:
            found[key] = df.toDF(*[_plain(c) for c in df.columns]).dropna("all")
    missing = sorted(set(REQUIRED_TABLES) - set(found))
    if missing:
        raise ValueError(f"operations master lacks: {', '.join(missing)}")
    return found


def operations_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns per table, and the total without a name."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.lit(", ".join(df.columns)).alias("columns")
        )
        out = one if out is None else out.unionByName(one)
    total = out.agg(F.lit(None).cast("string").alias("table"), F.sum("rows").alias("rows"), F.lit(None).cast("string").alias("columns"))
    return out.unionByName(total)
