"""Named queries over the test tables and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RAW: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles, drop the sign of zero and widen integers, for comparison by value."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
            c = F.when(c == 0, F.lit(0.0)).otherwise(c)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, digits: int = 6):
    def add(fn):
        RAW[name] = fn
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir), digits)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def view(name: str, body: str, *needs: str) -> None:
    VIEWS[name] = (needs, body)


def sql(body: str, *needs: str, doubles: str = "", bigints: str = "", digits: int = 6) -> str:
    """A full statement: the needed views in order, then ``body`` with rounded columns."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in VIEWS[name][0]:
            visit(dep)
        ordered.append(name)

    for name in needs:
        visit(name)
    replaced = [
        f"CASE WHEN round({c}, {digits}) = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST({c} AS DOUBLE), {digits}) END AS {c}"
        for c in doubles.split()
    ] + [f"CAST({c} AS BIGINT) AS {c}" for c in bigints.split()]
    star = f"* REPLACE ({', '.join(replaced)})" if replaced else "*"
    head = "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered) if ordered else ""
    return f"{head}\nSELECT {star} FROM ({body}) AS final_rows"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
