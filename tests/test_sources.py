import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F, types as T

from tidemark.functions.columns import to_day
from tidemark.sources import files, profile, sinks, workbook
from tidemark.streaming import feeds

HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def cell(ref, value, style=None):
    if isinstance(value, str):
        return f'<c r="{ref}" t="inlineStr"><is><t>{value}</t></is></c>'
    return f'<c r="{ref}"{f" s={chr(34)}{style}{chr(34)}" if style else ""}><v>{value}</v></c>'


def write_book(path, sheets):
    """A minimal workbook: sheets are lists of rows; dates are written as styled numbers."""
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'{HEAD}<workbook xmlns="{MAIN}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i}" Type="x" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        z.writestr("xl/styles.xml", f'{HEAD}<styleSheet xmlns="{MAIN}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, rows in enumerate(sheets.values(), 1):
            body = ""
            for r, row in enumerate(rows, 1):
                cells = ""
                for c, v in enumerate(row):
                    if v is None:
                        continue
                    ref = f"{chr(65 + c)}{r}"
                    if isinstance(v, dt.date):
                        cells += cell(ref, (v - dt.date(1899, 12, 30)).days, 1)
                    else:
                        cells += cell(ref, v)
                body += f'<row r="{r}">{cells}</row>'
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>')


def test_workbooks_from_cells_to_long_rows(spark, tmp_path):
    months = [dt.date(2025, 11, 1), dt.date(2025, 12, 1), dt.date(2026, 1, 1)]
    matrix = [
        [None, None, None, "Actual", None, "Forecast"],
        [],
        ["Article Number", "Customer Name", "Customer Summary", *months],
        ["A1", "ACME", "big", 10, 11, 12],
        ["A2", "ACME", "big", None, 5, "n/a"],
        ["A3", None, "big", 1, 1, 1],
    ]
    write_book(tmp_path / "one.xlsx", {"Notes": [["hello"]], "Actual + Forecast": matrix})
    write_book(tmp_path / "two.xlsx", {"Sales": [["date", "qty"], [dt.date(2025, 1, 1), 3.5]], "Budget": [["x"]]})
    cells = files.read_workbooks(spark, str(tmp_path / "*.xlsx"))
    chosen = {r.path.split("/")[-1]: r.sheet for r in workbook.rank_sheets(cells).collect()}
    assert chosen == {"one.xlsx": "Actual + Forecast", "two.xlsx": "Sales"}
    headers = workbook.detect_header(cells)
    found = {r.sheet: r.header_row for r in headers.collect()}
    assert found["Actual + Forecast"] == 2 and found["Sales"] == 0
    picked = cells.filter("sheet = 'Actual + Forecast'")
    names = ["Article Number", "Customer Name", "Customer Summary", *map(str, months)]
    wide = workbook.sheet_table(picked, headers, names).drop("path", "sheet", "row")
    status = workbook.sheet_columns(picked, headers).join(workbook.column_status(picked, headers), ["path", "sheet", "col"])
    long = workbook.unpivot_matrix(wide, status.select("name", "status"), "Actual + Forecast").collect()
    got = {(r.series_id, r.date.month): (r.demand, r.record_type) for r in long}
    assert got == {
        ("A1 · ACME", 11): (10.0, "actual"), ("A1 · ACME", 12): (11.0, "actual"), ("A1 · ACME", 1): (12.0, "forecast"),
        ("A2 · ACME", 12): (5.0, "actual"),
    }
    with pytest.raises(ValueError):
        workbook.choose_sheet(cells, "Nowhere")


def test_tables_that_are_no_matrix_stay(spark):
    df = spark.createDataFrame([("a", 1)], "x string, y int")
    assert workbook.unpivot_matrix(df) is df
    assert workbook.matrix_months(["2025-01-01", "2025-01-01.1", "1999-01-01", "Price 2026x"]) == ["2025-01-01"]


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_separator_is_found(spark, tmp_path, sep):
    path = tmp_path / "data.txt"
    path.write_text("\n".join(sep.join(r) for r in [["date", "item", "note"], ["2025-01-01", "A", '"x, y; z"'], ["2025-02-01", "B", "ok"]]))
    rows = files.read_delimited(spark, str(path))
    assert rows.columns == ["date", "item", "note"] and rows.filter("item = 'A'").first().note == "x, y; z"


def test_latin1_and_tsv(spark, tmp_path):
    path = tmp_path / "data.tsv"
    path.write_bytes("item\tqty\nCafé\t1\n".encode("latin-1"))
    assert files.read_delimited(spark, str(path)).first().item == "Café"


def test_a_folder_of_mixed_files(spark, tmp_path):
    folder = tmp_path / "mixed files"
    folder.mkdir()
    (folder / "a.csv").write_bytes("item,qty\nCafé,1\n".encode())
    (folder / "b.csv").write_bytes("item,qty\nCafé,2\n".encode("latin-1"))
    (folder / "c.csv").write_bytes("qty;item;note\n3;Café;x\n".encode())
    (folder / "d.csv").write_bytes(b"")
    rows = files.read_delimited(spark, str(folder)).orderBy("qty").collect()
    assert [(r.item, r.qty, r.note) for r in rows] == [("Café", "1", None), ("Café", "2", None), ("Café", "3", "x")]


def test_line_breaks_in_quotes(spark, tmp_path):
    path = tmp_path / "data.csv"
    path.write_text('item,note\nA,"one\ntwo"\n')
    assert files.read_delimited(spark, str(path), sep=",", multi_line=True).first().note == "one\ntwo"


@pytest.mark.parametrize("text, day", [
    ("Jan 2025", "2025-01-01"), ("January 2025", "2025-01-01"), ("15-Mar-2025", "2025-03-15"), ("5 Mar 2025", "2025-03-05"),
    ("20250131", "2025-01-31"), ("soon", None),
])
def test_forms_of_dates(spark, text, day):
    got = spark.createDataFrame([(text,)], "d string").select(to_day(F.col("d"), T.StringType()).alias("d")).first().d
    assert (got and str(got)) == day


def test_whole_numbers_as_dates(spark):
    df = spark.createDataFrame([(20250131,), (7,), (None,)], "d int")
    got = df.select(to_day(F.col("d"), df.schema["d"].dataType).alias("d")).collect()
    assert [r.d for r in got] == [dt.date(2025, 1, 31), None, None]


def test_matrix_headers_with_month_names(spark):
    df = spark.createDataFrame(
        [(*["A"] * len(workbook.MATRIX_KEYS), 1.0, 2.0, 3.0)], [*workbook.MATRIX_KEYS, "Jan 2025", "Feb 2025", "15-Mar-2025"]
    )
    rows = workbook.unpivot_matrix(df).orderBy("date").collect()
    assert [(r.date, r.demand) for r in rows] == [(dt.date(2025, m, 1), float(m)) for m in (1, 2, 3)]


def test_json_by_suffix(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1},\n {"x": 2}]')
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n{"x": 2}\n{"x": 3}\n')
    assert files.read_json(spark, str(tmp_path / "a.json")).count() == 2
    assert files.read_json(spark, str(tmp_path / "b.jsonl")).count() == 3


def test_roles_of_a_small_schema(spark):
    df = spark.createDataFrame([("2025-01", "A", 1.0, "P1")], "month string, sku string, demand_tonnes double, promotion_code string")
    found = profile.suggest_roles(profile.profile_table(df, "t")).collect()
    roles = {r.role: r.column for r in found if r.role != "driver"}
    assert roles["date"] == "month" and roles["target"] == "demand_tonnes" and roles["item"] == "sku"
    assert [r.column for r in found if r.role == "driver"] == ["promotion_code"]


def test_operations_tables(spark):
    one = lambda *cols: spark.createDataFrame([(1,) * len(cols), (None,) * len(cols)], ", ".join(f"`{c}` int" for c in cols))
    tables = workbook.load_operations({"BOM": one("SKU", "Scrap %"), "material master": one("Material ID"), "Capacity": one("a/b")})
    assert tables["bom"].columns == ["sku", "scrap_pct"] and tables["bom"].count() == 1 and tables["capacity"].columns == ["a_b"]
    assert {r.table: r.rows for r in workbook.operations_profile(tables).collect()}[None] == 3
    with pytest.raises(ValueError, match="capacity"):
        workbook.load_operations({"bom": one("a"), "materials": one("b")})


def test_snapshots_are_kept(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError):
        sinks.snapshot(df, {}, str(tmp_path), name="P", warnings=df)
    first = sinks.snapshot(df, {"freq": "monthly"}, str(tmp_path), name="P", warnings=df, accept_warnings=True)
    second = sinks.snapshot(df, {}, str(tmp_path), name="P")
    data, settings = sinks.read_snapshot(spark, str(tmp_path), first)
    assert first != second and settings == {"freq": "monthly"} and data.first().x == 1


def test_run_registry(spark):
    runs = spark.createDataFrame([("a", 1, None, None), ("b", 2, "a", "Up")], "run_id string, created_at int, base_run_id string, scenario_name string")
    assert sinks.latest_run(runs).first().run_id == "b" and [r.run_id for r in sinks.run_list(runs).collect()] == ["b", "a"]
    assert sinks.scenarios_of(runs, "a").count() == 1


def test_folder_feed_reads_only_new_files(spark, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    schema = spark.createDataFrame([], "date string, demand double").schema
    (src / "one.csv").write_text("date,demand\n2026-01-01,10\n")
    feeds.drain(feeds.stream_folder(spark, str(src), schema), out, state)
    (src / "two.csv").write_text("date,demand\n2026-02-01,20\n2026-02-02,5\n")
    feeds.drain(feeds.stream_folder(spark, str(src), schema), out, state)
    rows = spark.read.parquet(out).groupBy(F.element_at(F.split("source_file", "/"), -1).alias("f")).count().collect()
    assert {r.f: r["count"] for r in rows} == {"one.csv": 1, "two.csv": 2}


def test_monthly_stream_closes_months_and_drops_late_rows(spark, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    schema = spark.createDataFrame([], "item_id string, ts timestamp, target double").schema

    def feed(name, rows):
        (src / f"{name}.csv").write_text("item_id,ts,target\n" + "".join(f"A,{d} 00:00:00,{v}\n" for d, v in rows))
        feeds.drain(feeds.stream_period_rollup(feeds.stream_folder(spark, str(src), schema), "monthly", "31 days"), out, state)

    feed("a", [("2026-01-05", 1), ("2026-01-20", 2)])
    feed("b", [("2026-02-03", 4), ("2026-01-30", 8)])
    feed("c", [("2026-03-02", 16)])
    feed("d", [("2026-01-31", 32), ("2026-04-01", 64)])
    got = {r.period: r.target for r in spark.read.parquet(out).collect()}
    assert got[dt.date(2026, 1, 1)] == 11.0 and got.get(dt.date(2026, 2, 1), 4.0) == 4.0


def test_running_accuracy_counts_each_actual_once(spark, tmp_path):
    fixed = spark.createDataFrame([("A", dt.date(2026, 1, 1), 10.0), ("A", dt.date(2026, 2, 1), 10.0)], "item_id string, ts date, mean double")
    sink = feeds.monitor_sink(fixed, str(tmp_path))
    batch = spark.createDataFrame([("A", dt.date(2026, 1, 1), 8.0)], "item_id string, ts date, actual double")
    sink(batch, 0)
    sink(batch, 0)
    sink(batch.withColumn("ts", F.add_months("ts", 1)), 1)
    row = feeds.running_metrics(spark.read.parquet(str(tmp_path))).first()
    assert row.validation_points == 2 and row.wape_pct == pytest.approx(25.0)


def test_only_a_single_machine_may_stage_in_a_temporary_folder():
    from tidemark.session import is_single_machine

    assert is_single_machine("local") and is_single_machine("local[8]")
    assert not any(is_single_machine(m) for m in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://x"))


def test_closed_periods_and_late_rows_add_up(spark, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    schema = "item_id string, ts timestamp, target double"
    arrivals = [
        [("A", "2024-01-01 10:00:00", 1.0), ("A", "2024-01-02 10:00:00", 2.0), ("B", "2024-01-01 09:00:00", 5.0)],
        [("A", "2024-01-06 00:00:00", 4.0), ("A", "2024-01-01 11:00:00", 8.0)],  # the clock still stood before the first day's end
        [("A", "2024-01-01 12:00:00", 16.0), ("A", "2024-01-03 12:00:00", 32.0), ("A", "2024-01-09 00:00:00", 64.0), (None, "2024-01-01 00:00:00", 9.0)],
    ]
    for k, rows in enumerate(arrivals):
        frame = spark.createDataFrame(rows, "item_id string, ts string, target double").withColumn("ts", F.col("ts").cast("timestamp"))
        frame.coalesce(1).write.mode("append").parquet(str(src))
    for shards in (1, 3):
        stream = feeds.stream_folder(spark, str(src), frame.schema, "parquet", per_trigger=1)
        feeds.drain(feeds.stream_closed_periods(stream, "daily", 2, shards=shards), f"{out}{shards}", f"{state}{shards}")
    got = {(r.item_id, str(r.period), r.kind): (r.target, r.source_rows) for r in spark.read.schema(feeds.CLOSED).parquet(f"{out}1").collect()}
    assert got == {
        ("A", "2024-01-01", "closed"): (9.0, 2), ("A", "2024-01-02", "closed"): (2.0, 1), ("A", "2024-01-01", "late"): (16.0, 1),
        ("A", "2024-01-03", "late"): (32.0, 1), ("A", "2024-01-06", "closed"): (4.0, 1),
    }
    dealt = spark.read.schema(feeds.CLOSED).parquet(f"{out}3").filter("item_id = 'A'").groupBy().agg(F.sum("source_rows")).first()[0]
    assert dealt <= 6


def test_a_run_that_was_cut_off_is_invisible_and_can_be_written_again(spark, tmp_path):
    path = str(tmp_path / "runs")
    good = spark.range(3).withColumn("x", F.lit(1.0))
    broken = spark.range(3).withColumn("x", F.raise_error(F.lit("lost")).cast("double"))
    assert sinks.committed_runs(spark, path).count() == 0
    sinks.write_run("2026", {"forecast": good, "portfolio": good}, path)
    with pytest.raises(Exception):
        sinks.write_run("b", {"forecast": good, "portfolio": broken}, path)
    assert {r.run_id for r in sinks.read_run_table(spark, path, "forecast").collect()} == {"2026"}
    sinks.write_run("b", {"forecast": good.limit(2), "portfolio": good}, path)
    got = sinks.read_run_table(spark, path, "forecast").groupBy("run_id").count().collect()
    assert {(r.run_id, r["count"]) for r in got} == {("2026", 3), ("b", 2)}
    assert sinks.read_run_table(spark, path, "forecast", "b").columns == ["id", "x", "run_id"]
    with pytest.raises(ValueError, match="already"):
        sinks.write_run("b", {"forecast": good}, path)
    assert sorted(r.run_id for r in sinks.committed_runs(spark, path).collect()) == ["2026", "b"]


def test_headers_of_sheets_are_never_broadcast(spark):
    cells = spark.createDataFrame([("b", "s", r, c, f"v{r}{c}") for r in range(4) for c in range(3)], "path string, sheet string, row int, col int, value string")
    headers = spark.createDataFrame([("b", "s", 3, 1.0)], "path string, sheet string, header_row int, score double")
    for made in (workbook.column_status(cells, headers), workbook.sheet_columns(cells, headers)):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    assert {(r["col"], r["status"]) for r in workbook.column_status(cells, headers).collect()} == {(0, "v10"), (1, "v11"), (2, "v12")}
