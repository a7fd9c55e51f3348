"""Queries on workbook cells, wide matrices, column roles, sinks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ...functions.fixed import (
    DATE_NAME_TOKENS, EVENT_TOKENS, EXTERNAL_TOKENS, HEADER_KEYWORDS, METADATA_COLUMNS, ROLE_TOKENS, SHEET_NAME_WEIGHTS,
)
from ...operators import cleaning as K
from ...session import staging_root
from ...sources import files as L
from ...sources import profile as R
from ...sources import sinks as S
from ...sources import workbook as B
from ...streaming import feeds as T
from . import panels as P
from .planning import plain_forecast, runs
from .registry import query, sql, table, view

# --- workbook cells: every 4096 parts are one book, every type and size class one sheet ------

_CLASS = "CASE WHEN p_size < 17 THEN ' Demand' WHEN p_size < 34 THEN ' Sales history' ELSE ' Budget' END"
view("cells", f"""
    SELECT 'book' || (p_partkey // 4096) || '.xlsx' AS path, p_type || {_CLASS} AS sheet, (p_partkey % 4096) // 32 AS row, (p_partkey % 32) * 3 + k AS col,
           CASE k WHEN 0 THEN p_name WHEN 1 THEN CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END
                  ELSE CASE WHEN p_size % 7 = 0 THEN 'Sales Volume' WHEN p_size % 7 = 1 THEN ' Order Date ' ELSE p_brand END END AS value
    FROM part CROSS JOIN (SELECT unnest([0, 1, 2]) AS k)""")


def cells(spark, d) -> DataFrame:
    size = F.col("p_size")
    kind = F.when(size < 17, " Demand").when(size < 34, " Sales history").otherwise(" Budget")
    values = F.array(
        F.col("p_name"), F.when(size % 5 != 0, F.col("p_brand")),
        F.when(size % 7 == 0, "Sales Volume").when(size % 7 == 1, " Order Date ").otherwise(F.col("p_brand")),
    )
    key = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.concat(F.lit("book"), F.floor(key / 4096).cast("string"), F.lit(".xlsx")).alias("path"),
        F.concat("p_type", kind).alias("sheet"), F.floor((key % 4096) / 32).alias("row"),
        key, F.posexplode(values).alias("k", "value"),
    ).select("path", "sheet", "row", ((key % 32) * 3 + F.col("k")).alias("col"), "value")


_NAME_SCORE = " + ".join(f"CASE WHEN contains(lower(trim(sheet)), '{t}') THEN {w} ELSE 0 END" for t, w in SHEET_NAME_WEIGHTS.items())
_HIT = " OR ".join(f"contains(v, '{t}')" for t in HEADER_KEYWORDS)
view("sheet_scores", f"""
    SELECT path, sheet, {_NAME_SCORE} + least(sum(n) / 20.0::DOUBLE, 25) + least(max(n), 30) AS score FROM (
      SELECT path, sheet, row, count(*) AS n FROM cells WHERE row < 25 AND value IS NOT NULL GROUP BY 1, 2, 3) GROUP BY path, sheet""", "cells")
view("headers", f"""
    SELECT path, sheet, row AS header_row, score FROM (
      SELECT path, sheet, row, count(*) FILTER (WHERE {_HIT}) * 8 + least(count(*), 30) + count(DISTINCT v) / count(*)::DOUBLE AS score
      FROM (SELECT *, lower(trim(value)) AS v FROM cells WHERE row < 25 AND trim(value) <> '') GROUP BY 1, 2, 3)
    QUALIFY row_number() OVER (PARTITION BY path, sheet ORDER BY score DESC, row) = 1""", "cells")


@query("sheet_rank", sql("SELECT * FROM sheet_scores QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, sheet DESC) = 1",
                         "sheet_scores", doubles="score"))
def _(spark, d):
    return B.rank_sheets(cells(spark, d))


@query("header_detect", sql("SELECT * FROM headers", "headers", doubles="score"))
def _(spark, d):
    return B.detect_header(cells(spark, d))


@query("sheet_columns", sql("""
    SELECT path, sheet, col, CASE WHEN k > 0 THEN name || '.' || k ELSE name END AS name FROM (
      SELECT c.path, c.sheet, c.col, trim(c.value) AS name, row_number() OVER (PARTITION BY c.path, c.sheet, trim(c.value) ORDER BY c.col) - 1 AS k
      FROM cells c JOIN headers h ON c.path = h.path AND c.sheet = h.sheet AND c.row = h.header_row) WHERE name IS NOT NULL""", "cells", "headers"))
def _(spark, d):
    all_cells = cells(spark, d)
    return B.sheet_columns(all_cells.filter("value IS NOT NULL"), B.detect_header(all_cells))


@query("column_status", sql("""
    SELECT path, sheet, col, coalesce(last_value(word IGNORE NULLS) OVER (PARTITION BY path, sheet ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS status FROM (
      SELECT coalesce(a.path, b.path) AS path, coalesce(a.sheet, b.sheet) AS sheet, coalesce(a.col, b.col) AS col, b.word FROM
        (SELECT c.path, c.sheet, c.col FROM cells c JOIN headers h ON c.path = h.path AND c.sheet = h.sheet AND c.row = h.header_row) a
      FULL JOIN (SELECT c.path, c.sheet, c.col, lower(trim(c.value)) AS word FROM cells c JOIN headers h ON c.path = h.path AND c.sheet = h.sheet AND c.row = greatest(0, h.header_row - 2)) b
      ON a.path = b.path AND a.sheet = b.sheet AND a.col = b.col)""", "cells", "headers"))
def _(spark, d):
    all_cells = cells(spark, d)
    return B.column_status(all_cells, B.detect_header(all_cells))


_MONTHS = [f"{y}-{m:02d}-01" for y in range(2020, 2027) for m in range(1, 13)]


def matrix(spark, d) -> DataFrame:
    """Parts by supplier nation and month, 25 years later, as a wide sheet."""
    month = F.date_format(F.add_months(F.trunc("l_shipdate", "month"), 300), "yyyy-MM-dd")
    lines = P.brand_lines(spark, d).withColumn("month", month)
    keys = ["Article Number", "Customer Name"]
    named = lines.select(
        F.col("p_brand").alias("Article Number"), F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")).alias("Customer Name"),
        "month", "l_quantity",
    )
    # a wide row takes all months, however few it has, so sheets' rows are dealt by the number of their months
    months = K.whole_items(named.groupBy(*keys, "month").agg(F.sum("l_quantity").alias("l_quantity")), *keys)
    wide = months.groupBy(*keys).pivot("month", _MONTHS).agg(F.sum("l_quantity"))
    return wide.withColumns({"Customer Summary": F.lit("all"), "Category": F.col("Article Number")})


@query("matrix_unpivot", sql("""
    SELECT CAST(date_trunc('month', l_shipdate) + to_months(300) AS DATE) AS date, sum(l_quantity) AS demand, p_brand || ' · Supplier ' || l_suppkey AS series_id,
           CASE WHEN date_trunc('month', l_shipdate) + to_months(300) >= DATE '2026-01-01' THEN 'forecast' ELSE 'actual' END AS record_type, 'Sheet' AS source_sheet,
           p_brand AS sku, 'Supplier ' || l_suppkey AS customer, 'all' AS customer_group, p_brand AS category
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""", doubles="demand"))
def _(spark, d):
    status = spark.createDataFrame(
        [(m, "Budget forecast" if m >= "2026" else "Actual") for m in _MONTHS], "name string, status string"
    ).withColumn("status", F.lower("status"))
    return B.unpivot_matrix(matrix(spark, d), status, "Sheet")


# --- profiles and roles ---------------------------------------------------------------------

_COLUMNS = {
    "customer": "c_custkey:n c_name c_nationkey:n c_acctbal:n c_mktsegment",
    "orders": "o_orderkey:n o_custkey:n o_orderstatus o_totalprice:n o_orderdate o_orderpriority",
    "lineitem": "l_orderkey:n l_partkey:n l_suppkey:n l_linenumber:n l_quantity:n l_extendedprice:n l_discount:n l_tax:n l_returnflag l_linestatus l_shipdate",
    "part": "p_partkey:n p_name p_brand p_type p_size:n p_retailprice:n",
    "events": "event_id:n ts user_id:n event_type value:n props",
}


def _likes(tokens) -> str:
    return "(" + " OR ".join(f"contains(lower(\"column\"), '{t}')" for t in tokens) + ")"


view("profiles", " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", (SELECT count(*) FROM {t}) AS rows, {i} AS position, '{c.split(':')[0]}' AS "column",
        (SELECT count({c.split(':')[0]}) FROM {t}) AS filled, {str(c.endswith(':n')).lower()} AS is_numeric"""
    for t, cols in _COLUMNS.items() for i, c in enumerate(cols.split())
))
view("profile_rows", f"""SELECT *, CASE WHEN is_numeric THEN filled ELSE 0 END AS numbers, {_likes(DATE_NAME_TOKENS)} AS is_date_name FROM profiles""", "profiles")


def profiles(spark, d) -> DataFrame:
    out = None
    for name in _COLUMNS:
        one = R.profile_table(table(spark, d, name), name)
        out = one if out is None else out.unionByName(one)
    return out


@query("profile_table", sql("SELECT * FROM profile_rows", "profile_rows", bigints="position numbers filled"))
def _(spark, d):
    return profiles(spark, d)


def _rank(tokens) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(\"column\"), '{t}') THEN {i}" for i, t in enumerate(tokens)) + " END"


_POOL = {
    "date": "(is_date_name OR NOT bool_or(is_date_name) OVER (PARTITION BY \"table\"))",
    "target": "(is_numeric OR NOT bool_or(is_numeric) OVER (PARTITION BY \"table\"))",
}
view("role_picks", " UNION ALL ".join(
    f"""SELECT "table", '{role}' AS role, arg_min("column", rank * 1000 + position) AS "column" FROM (
          SELECT *, {_rank(tokens)} AS rank, {_POOL.get(role, 'true')} AS pool FROM profile_rows) WHERE pool AND rank IS NOT NULL GROUP BY "table" """
    for role, tokens in ROLE_TOKENS.items()
), "profile_rows")


@query("role_suggest", sql(f"""
    SELECT * FROM role_picks
    UNION ALL SELECT "table", 'driver', "column" FROM profile_rows p WHERE (is_numeric OR {_likes(EVENT_TOKENS)})
      AND NOT EXISTS (SELECT 1 FROM role_picks r WHERE r."table" = p."table" AND r."column" = p."column")""", "role_picks", "profile_rows"))
def _(spark, d):
    return R.suggest_roles(profiles(spark, d))


@query("default_drivers", sql(f"""
    SELECT "table", "column", rank FROM (
      SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY CASE WHEN chosen THEN place ELSE position END) AS rank FROM (
        SELECT *, bool_or(place IS NOT NULL) OVER (PARTITION BY "table") AS chosen FROM (
          SELECT *, CASE "column" WHEN 'l_tax' THEN 1 WHEN 'l_discount' THEN 2 END AS place FROM profile_rows
          WHERE "column" NOT IN ('o_orderkey', 'l_orderkey', {', '.join(f"'{c}'" for c in METADATA_COLUMNS)})))
      WHERE CASE WHEN chosen THEN place IS NOT NULL ELSE is_numeric END) WHERE rank <= 8""", "profile_rows"))
def _(spark, d):
    return R.default_drivers(profiles(spark, d), ["o_orderkey", "l_orderkey"], ["l_tax", "l_discount"])


@query("driver_role", sql(f"""
    SELECT "table", "column", CASE WHEN "column" = 'l_tax' THEN 'external' WHEN {_likes(EXTERNAL_TOKENS)} THEN 'external' ELSE 'internal' END AS role, rows FROM profile_rows""",
    "profile_rows"))
def _(spark, d):
    return profiles(spark, d).select("table", "column", R.driver_role(F.col("column"), overrides={"l_tax": "external"}).alias("role"), "rows")


@query("operations_load", sql("""
    SELECT 'bom' AS "table", count(*) AS rows, 'sku, material_id, quantity_per_tonne, scrap_pct' AS columns FROM part WHERE p_size > 10
    UNION ALL SELECT 'materials', count(*), 'material_id, stock_kg' FROM part
    UNION ALL SELECT 'capacity', count(*), 'production_line, available_tonnes' FROM lineitem
    UNION ALL SELECT NULL, (SELECT count(*) FROM part WHERE p_size > 10) + (SELECT count(*) FROM part) + (SELECT count(*) FROM lineitem), NULL"""))
def _(spark, d):
    part, lines = table(spark, d, "part"), table(spark, d, "lineitem")
    kept = F.col("p_size") > 10
    bom = part.select(*[F.when(kept, F.col(c)).alias(n) for c, n in [
        ("p_brand", " SKU"), ("p_type", "Material ID"), ("p_retailprice", "Quantity per tonne"), ("p_size", "Scrap %")]])
    tables = {
        "Bill of Materials": bom.withColumnRenamed("Scrap %", "Scrap_%"),
        " Material Master": part.select(F.col("p_type").alias("Material ID"), F.col("p_size").alias("Stock/kg")),
        "capacity": lines.select(F.col("l_suppkey").alias("Production Line"), F.col("l_quantity").alias("Available tonnes")),
        "notes": part,
    }
    return B.operations_profile(B.load_operations(tables))


# --- sinks ------------------------------------------------------------------------------------


@query("run_sinks", sql("SELECT ts, sum(mean) AS mean, count(*) AS items, 'r1' AS run_id FROM part_plain GROUP BY ts", "part_plain", doubles="mean"))
def _(spark, d):
    import uuid

    folder = f"{staging_root(spark)}/runs-{uuid.uuid4().hex[:12]}"
    S.write_run("r1", {"forecast": plain_forecast(spark, d)}, folder)
    # an attempt at another run that was cut off before its manifest: nobody sees it
    plain_forecast(spark, d).write.parquet(f"{folder}/forecast/run_id=r2/attempt=cut")
    return S.read_run_table(spark, folder, "forecast").groupBy("ts", "run_id").agg(F.sum("mean").alias("mean"), F.count("*").alias("items"))


@query("latest_run", sql("SELECT run_id, created_at, wape_pct FROM (SELECT * FROM month_runs ORDER BY created_at DESC LIMIT 1)", "month_runs", doubles="wape_pct"))
def _(spark, d):
    return S.latest_run(runs(spark, d)).select("run_id", "created_at", "wape_pct")


# --- files ------------------------------------------------------------------------------------------


def _rewritten(spark) -> str:
    import uuid

    return f"{staging_root(spark)}/files-{uuid.uuid4().hex[:12]}"


@query("delimited_read", sql("""
    SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment,
           CASE WHEN c_nationkey % 2 = 0 THEN 'a;b, "c" | d' END AS note FROM customer"""))
def _(spark, d):
    """The customers as files of two separators and column orders in one folder, read together by name."""
    folder, rows = _rewritten(spark), table(spark, d, "customer")
    note = F.lit('a;b, "c" | d').alias("note")
    even = rows.filter("c_nationkey % 2 = 0").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", note)
    odd = rows.filter("c_nationkey % 2 = 1").select("c_mktsegment", "c_name", "c_custkey", "c_nationkey")
    even.write.option("header", "true").option("sep", ",").option("escape", '"').mode("append").csv(folder)
    odd.write.option("header", "true").option("sep", ";").option("escape", '"').mode("append").csv(folder)
    return L.read_delimited(spark, folder).select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "note")


@query("json_read", sql("SELECT o_orderkey, o_orderstatus, o_totalprice, o_custkey FROM orders", doubles="o_totalprice", bigints="o_orderkey o_custkey"))
def _(spark, d):
    """All orders as one record a line."""
    folder = _rewritten(spark) + ".jsonl"
    table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey").write.json(folder)
    return L.read_json(spark, folder).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey")


@query("snapshot_roundtrip", sql("SELECT p_brand, count(*) AS parts, sum(p_retailprice) AS price, 'monthly' AS freq FROM part GROUP BY 1", doubles="price"))
def _(spark, d):
    """The parts saved under an id of their own, with settings, and read again by it."""
    folder = _rewritten(spark)
    saved = S.snapshot(table(spark, d, "part"), {"freq": "monthly"}, folder, name="parts")
    data, settings = S.read_snapshot(spark, folder, saved)
    return data.groupBy("p_brand").agg(
        F.count("*").alias("parts"), F.sum("p_retailprice").alias("price"), F.lit(settings["freq"]).alias("freq")
    )


# --- streams ------------------------------------------------------------------------------------


def event_stream(spark, d) -> DataFrame:
    schema = table(spark, d, "events").schema
    return T.stream_folder(spark, d, schema, "parquet", pathGlobFilter="events.parquet")


def _folders(spark) -> tuple[str, str]:
    import uuid

    base = f"{staging_root(spark)}/stream-{uuid.uuid4().hex[:12]}"
    return f"{base}/out", f"{base}/state"


@query("stream_folder", sql("SELECT 'events.parquet' AS file, count(*) AS rows, sum(value) AS total FROM events", doubles="total", digits=3), digits=3)
def _(spark, d):
    out, state = _folders(spark)
    T.drain(event_stream(spark, d), out, state)
    rows = spark.read.parquet(out)
    return rows.groupBy(F.element_at(F.split("source_file", "/"), -1).alias("file")).agg(F.count("*").alias("rows"), F.sum("value").alias("total"))


for _freq, _unit in (("daily", "DAY"), ("weekly", "WEEK")):
    _days = 1 if _freq == "daily" else 7

    def _rolled(spark, d, _f=_freq):
        out, state = _folders(spark)
        rows = event_stream(spark, d).withColumnRenamed("value", "target").withColumn("item_id", F.col("user_id").cast("string"))
        T.drain(T.stream_period_rollup(rows, _f, "2 days"), out, state)
        return spark.read.parquet(out)

    query(f"stream_rollup_{_freq}", sql(f"""
    SELECT CAST(user_id AS VARCHAR) AS item_id, CAST(date_trunc('{_unit}', ts) AS DATE) AS period, sum(value) AS target, count(*) AS source_rows FROM events
    WHERE date_trunc('{_unit}', ts) + to_days({_days}) <= (SELECT max(ts) FROM events) - to_days(2) GROUP BY 1, 2""", doubles="target", digits=4), digits=4)(_rolled)


ARRIVALS = 6

for _freq, _unit in (("daily", "day"), ("weekly", "week")):

    def _late(spark, d, _f=_freq):
        """The events arrive in six files by their numbers; every tenth comes two files later than its neighbours."""
        out, state = _folders(spark)
        rows = table(spark, d, "events")
        last = rows.agg(F.max("event_id")).first()[0]
        arrival = F.floor(F.col("event_id") * ARRIVALS / F.lit(last + 1)) + F.when(F.col("event_id") % 10 == 0, 2).otherwise(0)
        arrival = F.least(arrival, F.lit(ARRIVALS - 1))
        for k in range(ARRIVALS):
            rows.filter(arrival == k).coalesce(1).write.mode("append").parquet(f"{out}-in")
        stream = T.stream_folder(spark, f"{out}-in", rows.schema, "parquet", per_trigger=1)
        stream = stream.withColumnRenamed("value", "target").withColumn("item_id", F.col("user_id").cast("string"))
        T.drain(T.stream_closed_periods(stream, _f, 2), out, state)
        kind = lambda name, column: F.coalesce(F.sum(F.when(F.col("kind") == name, F.col(column))), F.lit(0)).alias
        return spark.read.schema(T.CLOSED).parquet(out).groupBy("item_id", "period").agg(
            kind("closed", "target")("target"), kind("closed", "source_rows")("source_rows"),
            kind("late", "target")("late_target"), kind("late", "source_rows")("late_rows"),
        )

    query(f"stream_late_{_freq}", sql(f"""
    WITH r AS (SELECT CAST(user_id AS VARCHAR) AS item_id, ts, value, CAST(date_trunc('{_unit}', ts) AS DATE) AS period,
                      CAST(CAST(date_trunc('{_unit}', ts) AS TIMESTAMP) + INTERVAL 1 {_unit} AS TIMESTAMP) AS "end",
                      least(floor(event_id * {ARRIVALS} / (SELECT max(event_id) + 1 FROM events)) + CASE WHEN event_id % 10 = 0 THEN 2 ELSE 0 END, {ARRIVALS - 1}) AS arrival FROM events),
    tops AS (SELECT item_id, arrival, max(ts) AS top FROM r GROUP BY 1, 2),
    clocks AS (SELECT item_id, arrival, max(top) OVER (PARTITION BY item_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 DAY AS clock,
                      max(top) OVER (PARTITION BY item_id) - INTERVAL 2 DAY AS last FROM tops),
    told AS (SELECT r.*, last, coalesce("end" <= clock, false) AS late FROM r JOIN clocks USING (item_id, arrival))
    SELECT item_id, period, coalesce(sum(value) FILTER (NOT late), 0) AS target, count(*) FILTER (NOT late) AS source_rows,
           coalesce(sum(value) FILTER (late), 0) AS late_target, count(*) FILTER (late) AS late_rows
    FROM told WHERE "end" <= last GROUP BY 1, 2""", doubles="target late_target", digits=4), digits=4)(_late)


@query("stream_actuals", sql("""
    SELECT a.item_id, sum(abs(a.actual - f.pred)) / sum(abs(a.actual)) * 100 AS wape_pct, avg(abs(a.actual - f.pred)) AS mae, sum(f.pred - a.actual) / sum(abs(a.actual)) * 100 AS bias_pct, count(*) AS validation_points
    FROM (SELECT CAST(user_id AS VARCHAR) AS item_id, CAST(ts AS DATE) AS ts, value AS actual FROM events) a
    JOIN (SELECT item_id, ts, target / 2 AS pred FROM event_rolled) f USING (item_id, ts) GROUP BY a.item_id""", "event_rolled",
    doubles="wape_pct mae bias_pct", digits=5), digits=5)
def _(spark, d):
    out, state = _folders(spark)
    raw = K.canonicalize(table(spark, d, "events"), date_col="ts", target_col="value", item_col="user_id", order_by=["ts"])
    fixed = K.period_rollup(K.drop_invalid(raw), "daily").select("item_id", "ts", (F.col("target") / 2).alias("mean"))
    actual = event_stream(spark, d).select(
        F.col("user_id").cast("string").alias("item_id"), F.col("ts").cast("date").alias("ts"), F.col("value").alias("actual")
    )
    job = (
        actual.writeStream.foreachBatch(T.monitor_sink(fixed, out)).option("checkpointLocation", state)
        .trigger(availableNow=True).start()
    )
    job.awaitTermination()
    return T.running_metrics(spark.read.parquet(out)).select("item_id", "wape_pct", "mae", "bias_pct", "validation_points")
