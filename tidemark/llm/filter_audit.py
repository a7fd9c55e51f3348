"""How a chain of filters interacts: every order of the filters from one pass over the documents.

1. ``failures`` reads each whole text once in workers: which of the conditions A to D it fails, and a
   digest of it. Condition E, a copy of the text of a smaller doc_id, needs the whole table: rows are
   added up by digest first, so a group of copies is a handful of rows before it is shuffled.
2. ``cells`` counts documents, labelled good ones and toxic ones per part and mask of failed conditions:
   32 rows a part at most.
3. ``walk`` goes through the subsets of filters in Gray-code order. Each step toggles one filter; every
   mask cell keeps the number of active filters it fails, and running survivors change when that number
   leaves or reaches zero. The survivors of all 32 states are stored; any step of any order is the
   difference of two of them.

Defined cases: a null text is empty and fails A (no words) and nothing else but E; B and C compare
zero with zero and pass. A null and an empty text are the same text. Rows that repeat a doc_id count
each; of equal texts those with the smallest doc_id pass E, and a null doc_id neither fails E nor makes
others fail it. A document is good or toxic if any of its label rows says so; null labels say nothing.
A null lang counts with the empty string. An empty table has no parts and gives no rows. Further columns
are ignored. Ties in doc_id and repeated label rows do not multiply documents.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .registry import query
from .support import table
from .words import slices

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PCT, MOST_CAPITALS_PCT = 100, 80, 10
CAPITALS = bytes(range(65, 91))
MARKS = re.compile(r"[#$%&*|]").search


def conditions(text: str) -> int:
    """Bits of the failed conditions A to D of a text. Words end at the six white characters of ASCII."""
    raw = text.encode()
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT_PCT * len(words)) << 1
        | (100 * capitals > MOST_CAPITALS_PCT * len(text)) << 2
        | (MARKS(text) is not None) << 3
    )


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask, digest`` of every row; ``mask`` without condition E."""

    def batches(source):
        for whole in source:
            for rows in slices(whole, "text"):
                texts = [t or "" for t in rows.column("text").to_pylist()]
                yield pa.record_batch([
                    rows.column("doc_id"), rows.column("part"), pa.array(map(conditions, texts), pa.int32()),
                    pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary()),
                ], names=["doc_id", "part", "mask", "digest"])

    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")
    )
    return rows.mapInArrow(batches, "doc_id long, part string, mask int, digest binary")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the conditions they fail, E among them."""
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).cast("int").alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int").alias("toxic"),
    )
    marked = failures(docs).join(marks, "doc_id", "left").fillna({"good": 0, "toxic": 0})
    own = ["part", "mask", "good", "toxic"]
    # rows of one document together, then copies of a text with the same part and labels
    rows = marked.groupBy("doc_id", "digest", *own).agg(F.count(F.lit(1)).alias("times"))
    alike = rows.groupBy("digest", *own).agg(
        F.sum("times").alias("n"), F.min("doc_id").alias("least"), F.min_by("times", "doc_id").alias("first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("times")).otherwise(0)).alias("unnamed"),
    )
    smallest = F.min("least").over(W.partitionBy("digest"))  # a few rows: one for each kind of copy
    spared = F.col("unnamed") + F.when(F.col("least") == smallest, F.col("first")).otherwise(0)
    alike = alike.withColumn("spared", spared)
    parts = F.explode(F.array(
        F.struct(F.col("mask").alias("m"), F.col("spared").alias("k")),
        F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("m"), (F.col("n") - F.col("spared")).alias("k")),
    ))
    spread = alike.select("part", "good", "toxic", parts.alias("x"))
    return spread.groupBy("part", F.col("x.m").alias("mask")).agg(
        F.sum("x.k").alias("n"), F.sum(F.col("x.k") * F.col("good")).alias("good"), F.sum(F.col("x.k") * F.col("toxic")).alias("toxic"),
    )


def survivors(table: list[tuple[int, int, int, int]], filters: int = len(FILTERS)) -> list[tuple[int, int, int]]:
    """Documents, good and toxic ones that pass all filters of each subset, by Gray-code steps.

    ``table`` lists ``mask, n, good, toxic``. Consecutive Gray codes differ in one bit, so a step touches
    only the cells that fail the toggled filter.
    """
    active = [0] * len(table)  # active filters that each cell fails
    now = [sum(row[k] for row in table) for k in (1, 2, 3)]
    stored = [tuple(now)] * (1 << filters)
    code = 0
    for step in range(1, 1 << filters):
        bit = (step & -step).bit_length() - 1
        code ^= 1 << bit
        on = code >> bit & 1
        for at, row in enumerate(table):
            if row[0] >> bit & 1:
                active[at] += 1 if on else -1
                if active[at] == on:  # the first active failure, or the last one gone
                    for k in range(3):
                        now[k] += row[k + 1] * (-1 if on else 1)
        stored[code] = tuple(now)
    return stored


def walk(part: str, table: list[tuple[int, int, int, int]], filters: str = FILTERS) -> list[tuple]:
    """All orders and steps of one part, each from the stored survivors before and after the step."""
    state = survivors(table, len(filters))
    total = state[0][0]
    orders = list(itertools.permutations(range(len(filters))))
    failing = [sum(row[1] for row in table if row[0] >> f & 1) for f in range(len(filters))]
    alone = [sum(row[1] for row in table if row[0] == 1 << f) for f in range(len(filters))]
    shapley = [0] * len(filters)
    out = []
    for order in orders:
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            gone = [a - b for a, b in zip(state[before], state[after])]
            shapley[f] += gone[0]
            out.append((part, "".join(filters[i] for i in order), step, f, state[after][0], gone[0], failing[f] - gone[0], alone[f], gone[1], gone[2]))
            before = after
    assert all(sum(r[5] for r in out[i : i + len(filters)]) + out[i + len(filters) - 1][4] == total for i in range(0, len(out), len(filters)))
    return [(*r[:3], *r[4:], shapley[r[3]]) for r in out]


AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, "
    "toxic_lost long, shapley long"
)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step."""
    names = [x.split(" ")[0] for x in AUDIT.split(", ")]

    def of_part(key, rows):
        found = list(rows[["mask", "n", "good", "toxic"]].itertuples(index=False, name=None))
        return pd.DataFrame(walk(key[0], [tuple(map(int, r)) for r in found]), columns=names)

    return cells(docs, labels).groupBy("part").applyInPandas(of_part, AUDIT)


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
first AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
marks AS (SELECT doc_id, max(coalesce(quality = 1, false)::int) AS good, max(coalesce(toxic = 1, false)::int) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT d.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
    [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
     100 * (length(d.t) - length(regexp_replace(d.t, '[A-Z]', '', 'g'))) > 10 * length(d.t),
     regexp_matches(d.t, '[#$%&*|]'), coalesce(d.doc_id > f.least, false)] AS f
  FROM d JOIN first f ON d.t = f.t LEFT JOIN marks m ON m.doc_id = d.doc_id),
cells AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, f),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, e.i, g.i] AS o, chr(64 + a.i) || chr(64 + b.i) || chr(64 + c.i) || chr(64 + e.i) || chr(64 + g.i) AS filter_order
  FROM letters a, letters b, letters c, letters e, letters g
  WHERE len(list_distinct([a.i, b.i, c.i, e.i, g.i])) = 5),
steps AS (SELECT o, filter_order, i AS step, o[i] AS own, o[1:i - 1] AS earlier FROM orders, letters),
marked AS (
  SELECT s.filter_order, s.step, s.own, c.part, c.n, c.good, c.toxic, c.f[s.own] AS fails_own,
    len(list_filter(s.earlier, lambda e: c.f[e])) > 0 AS gone, len(list_filter(c.f, lambda x: x)) AS n_fails
  FROM steps s, cells c),
counted AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (NOT gone AND NOT fails_own), 0) AS kept,
    coalesce(sum(n) FILTER (NOT gone AND fails_own), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND fails_own), 0) AS redundant,
    coalesce(sum(n) FILTER (fails_own AND n_fails = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND fails_own), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (NOT gone AND fails_own), 0) AS toxic_lost
  FROM marked GROUP BY ALL)
SELECT part, filter_order, step::int AS step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant,
  unique_fails::bigint AS unique_fails, good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::bigint AS shapley
FROM counted
"""


@query("op11_filter_audit", SQL)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
