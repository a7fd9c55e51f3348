"""Exact linear-interpolated quantiles for groups that may hold most of the rows.

``percentile`` keeps every distinct value of a group in one buffer. That is right for one
item's periods, but not for a portfolio-wide residual. Here a bracket around the wanted rank is
made narrower until at most ``LEFT`` rows or one value are in it; only those are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Rows of a group that are ranked together.
LEFT = 4096
#: Accuracy of the sketch that finds the next bracket; it narrows a bracket about ``ACCURACY / 4`` times.
ACCURACY = 10_000


def _in_group(keys: list[str], group: tuple) -> Column:
    out = F.lit(True)
    for key, value in zip(keys, group):
        out = out & F.col(key).eqNullSafe(F.lit(value))
    return out


def _by_group(keys: list[str], values: dict[tuple, float]) -> Column:
    """A value per group as one expression."""
    out = None
    for group, value in values.items():
        out = F.when(_in_group(keys, group), F.lit(value)) if out is None else out.when(_in_group(keys, group), F.lit(value))
    return out if out is not None else F.lit(None).cast("double")


def _narrowed(rows: DataFrame, keys: list[str], q: float) -> tuple[dict[tuple, tuple[float, float]], dict[tuple, tuple[int, int]]]:
    """A bracket of every group, and the group's rows and those below the bracket.

    Each round is a job for the sketch of the groups that are still wide and one that counts exactly; a bracket
    that does not hold both neighbours of the rank is opened again at that side, so sketch errors cost a round only.
    """
    facts = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi")).collect()
    of = lambda r: tuple(r[k] for k in keys)
    n = {of(r): r["n"] for r in facts}
    bracket = {of(r): (r["lo"], r["hi"]) for r in facts}
    below, inside = dict.fromkeys(n, 0), dict(n)
    wide = {g for g in n if n[g] > LEFT and bracket[g][0] < bracket[g][1]}
    slack = 1.0
    while wide:
        lo, hi = _by_group(keys, {g: bracket[g][0] for g in wide}), _by_group(keys, {g: bracket[g][1] for g in wide})
        held = rows.filter(F.col("__v").between(lo, hi))
        # where the rank lies among the rows inside, a little lower and a little higher
        share = {g: (q * (n[g] - 1) - below[g]) / inside[g] for g in wide}
        steps = sorted({min(1.0, max(0.0, share[g] + side * slack * 2 / ACCURACY)) for g in wide for side in (-1, 1)})
        found = {of(r): r["b"] for r in held.groupBy(*keys).agg(F.percentile_approx("__v", steps, ACCURACY).alias("b")).collect()}
        new = {}
        for g in wide:
            a, b = (min(1.0, max(0.0, share[g] + side * slack * 2 / ACCURACY)) for side in (-1, 1))
            new[g] = (found[g][steps.index(a)] if a > 0 else bracket[g][0], found[g][steps.index(b)] if b < 1 else bracket[g][1])
        lo, hi = _by_group(keys, {g: x for g, (x, _) in new.items()}), _by_group(keys, {g: x for g, (_, x) in new.items()})
        counted = rows.groupBy(*keys).agg(F.count_if(F.col("__v") < lo).alias("below"), F.count_if(F.col("__v").between(lo, hi)).alias("inside")).collect()
        missed = False
        for r in counted:
            g = of(r)
            if g not in wide:
                continue
            first = int(q * (n[g] - 1))
            if r["below"] > first or r["below"] + r["inside"] < min(first + 2, n[g]):
                missed = True  # the sketch was off: the bracket stays as it was, and the next one is wider
                continue
            shrunk = r["inside"] < inside[g]
            bracket[g], below[g], inside[g] = new[g], r["below"], r["inside"]
            if inside[g] <= LEFT or new[g][0] == new[g][1] or not shrunk:
                wide.discard(g)  # one that does not shrink holds few values, each many times
        slack = 4 * slack if missed else 1.0
    return bracket, {g: (n[g], below[g]) for g in n}


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float, out: str) -> DataFrame:
    """One row per key set: ``keys..., n, <out>``; equals a linear-interpolated quantile.

    Meant for a handful of large groups, such as all rows or the steps of a horizon: their brackets are part
    of the expression. The brackets are found when this is called, so pass a staged table.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    if not keys:
        keys_in, rows = ["__all"], rows.withColumn("__all", F.lit(0))
    else:
        keys_in = keys
    bracket, counts = _narrowed(rows, keys_in, q)
    by = lambda at: _by_group(keys_in, at)
    lo, hi = by({g: b[0] for g, b in bracket.items()}), by({g: b[1] for g, b in bracket.items()})
    kept = rows.filter(F.col("__v").between(lo, hi)).groupBy(*keys_in, "__v").agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(W.partitionBy(*keys_in).orderBy("__v")) + by({g: float(c[1]) for g, c in counts.items()})
    rank = F.lit(q) * (by({g: float(c[0]) for g, c in counts.items()}) - 1)
    ranked = kept.withColumns({"__upto": upto, "__pos": rank, "n": by({g: float(c[0]) for g, c in counts.items()})})
    lower = F.floor("__pos")
    picked = ranked.groupBy(*keys_in, "n", "__pos").agg(
        F.min(F.when(F.col("__upto") > lower, F.col("__v"))).alias("__a"),
        F.min(F.when(F.col("__upto") > lower + 1, F.col("__v"))).alias("__z"),
    )
    step = (F.col("__pos") - lower) * (F.coalesce("__z", "__a") - F.col("__a"))
    return picked.select(*keys, F.col("n").cast("long").alias("n"), (F.col("__a") + step).alias(out))
