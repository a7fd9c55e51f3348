"""Plan events, overrides and the approved plan, as log analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.fixed import EVIDENCE_STATES, LOCKED_STATES, PLAN_STATES, PLAN_TRANSITIONS

_RUN = 256


def _code(status: Column) -> Column:
    """Position of a state in the state list, 0 if unknown."""
    return F.array_position(F.array(*[F.lit(s) for s in PLAN_STATES]), status).cast("int")


def _name(code: Column) -> Column:
    return F.array(*[F.lit(s) for s in PLAN_STATES])[code - 1]


def _verdict(state: Column, event: Column) -> Column:
    """Null if the event may follow the state, else why it may not."""
    moves = [F.lit(PLAN_STATES.index(a) * 10 + PLAN_STATES.index(b) + 11) for a, to in PLAN_TRANSITIONS.items() for b in to]
    gated = [PLAN_STATES.index(s) + 1 for s in EVIDENCE_STATES]
    return (
        F.when(event["wanted"] == 0, "unknown status")
        .when(~F.array_contains(F.array(*moves), state * 10 + event["wanted"]), "transition not allowed")
        .when(event["wanted"].isin(gated) & event["limited"], "limited evidence")
    )


def _step(state: Column, event: Column) -> Column:
    return F.when(_verdict(state, event).isNull(), event["wanted"]).otherwise(state)


def _compose(maps: str) -> Column:
    """One state map for an ordered list of them."""
    states = F.sequence(F.lit(1), F.lit(len(PLAN_STATES)))
    return F.transform(states, lambda s: F.aggregate(maps, s, lambda at, m: m["ends"][at - 1]))


def _entry_states(maps: str, key: str, first: Column) -> Column:
    """The state before each map of an ordered list."""
    none = F.expr(f"cast(array() as array<struct<{key}: bigint, at: int>>)")
    return F.aggregate(
        maps,
        F.struct(first.alias("at"), none.alias("seen")),
        lambda acc, m: F.struct(
            m["ends"][acc["at"] - 1].alias("at"),
            F.concat(acc["seen"], F.array(F.struct(m[key].alias(key), acc["at"].alias("at")))).alias("seen"),
        ),
        lambda acc: acc["seen"],
    )


def _collect(rows: DataFrame, keys: list[str], key: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(key, "ends"))).alias("maps"))


def audit_transitions(events: DataFrame, plans: DataFrame) -> DataFrame:
    """Replay every requested transition: state before, valid or not, and the reason.

    A rejected request leaves the state as it was, so the outcome of an event depends on all
    earlier ones. A run of events still maps each of the five states to one state, and such
    maps compose. Runs of 256 sequence numbers are folded in parallel, blocks of 256 runs
    likewise, and only one small map per block meets in one row per plan. Then every run
    knows its start and is replayed on its own, so one busy plan is spread over many tasks.

    ``events`` has plan_id, seq, status; ``plans`` has plan_id, evidence_level.
    """
    evidence = plans.select("plan_id", F.coalesce("evidence_level", F.lit("limited")).alias("evidence"))
    tagged = events.select("plan_id", "seq", "status").join(evidence, "plan_id", "left")
    entry = F.struct(
        "seq", "status", _code(F.col("status")).alias("wanted"),
        (F.coalesce("evidence", F.lit("limited")) == "limited").alias("limited"),
    )
    runs = tagged.groupBy("plan_id", F.floor(F.col("seq") / _RUN).alias("run")).agg(
        F.array_sort(F.collect_list(entry)).alias("log")
    )
    states = F.sequence(F.lit(1), F.lit(len(PLAN_STATES)))
    folded = runs.select(
        "plan_id", "run", F.floor(F.col("run") / _RUN).alias("block"),
        F.transform(states, lambda s: F.aggregate("log", s, _step)).alias("ends"),
    )
    blocks = _collect(folded, ["plan_id", "block"], "run")
    tops = _collect(blocks.select("plan_id", "block", _compose("maps").alias("ends")), ["plan_id"], "block")
    draft = F.lit(PLAN_STATES.index("draft") + 1)
    block_start = tops.select("plan_id", F.inline(_entry_states("maps", "block", draft)))
    run_start = blocks.join(block_start, ["plan_id", "block"]).select(
        "plan_id", F.inline(_entry_states("maps", "run", F.col("at"))).alias("run", "start")
    )
    none = F.expr("cast(array() as array<struct<seq: bigint, status: string, before: string, reason: string>>)")
    replay = F.aggregate(
        "log",
        F.struct(F.col("start").alias("at"), none.alias("out")),
        lambda acc, e: F.struct(
            _step(acc["at"], e).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                e["seq"].cast("bigint").alias("seq"), e["status"].alias("status"), _name(acc["at"]).alias("before"),
                _verdict(acc["at"], e).alias("reason"),
            ))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    played = runs.join(run_start, ["plan_id", "run"]).select("plan_id", F.inline(replay))
    return played.withColumn("valid", F.col("reason").isNull())


def plan_status(audit: DataFrame) -> DataFrame:
    """Current state of each plan: its last valid event, or draft."""
    last = F.max_by(F.when(F.col("valid"), F.col("status")), F.when(F.col("valid"), F.col("seq")))
    return audit.groupBy("plan_id").agg(F.coalesce(last, F.lit("draft")).alias("status"))


def plan_counts(plans: DataFrame) -> DataFrame:
    return plans.filter(F.col("status") != "archived").groupBy("status").agg(F.count("*").alias("plans"))


def audit_overrides(overrides: DataFrame, plans: DataFrame, forecast: DataFrame | None = None) -> DataFrame:
    """Why an override does not count: blank reason, locked plan or unknown item and period.

    ``status_at`` in ``overrides`` is the plan's state when the override was entered.
    """
    rows = overrides.join(plans.select("plan_id", "run_id"), "plan_id", "left")
    known = F.lit(True)
    if forecast is not None:
        keys = forecast.select("run_id", "item_id", F.col("ts").alias("period")).distinct().withColumn("__known", F.lit(True))
        rows = rows.join(keys, ["run_id", "item_id", "period"], "left")
        known = F.col("__known").isNotNull()
    reason = (
        F.when(F.coalesce(F.trim("reason"), F.lit("")) == "", "reason required")
        .when(F.col("status_at").isin(LOCKED_STATES), "plan locked")
        .when(~known, "unknown item or period")
    )
    return rows.select(*overrides.columns, reason.alias("rejected"))


def state_at(log: DataFrame, audit: DataFrame, out: str = "status_at") -> DataFrame:
    """Rows of a log of plans with the state of their plan at their time ``at``: an as-of join of two logs.

    ``audit`` carries ``at``; its last accepted change at or before a row's time counts, of equal times the
    one with the highest number, and a plan without one is a draft. Both logs are cut into days: what a
    day starts from is found over one row per day, and rows meet changes of their own day only, so a busy
    plan is spread over as many places as it has days.
    """
    day = lambda c: F.date_trunc("day", F.col(c).cast("timestamp"))
    changes = audit.filter("valid").select(
        "plan_id", day("at").alias("__day"), F.struct(F.col("at").cast("timestamp").alias("at"), "seq", "status").alias("change")
    )
    by_day = changes.groupBy("plan_id", "__day").agg(
        F.array_sort(F.collect_list("change")).alias("changes"), F.max("change").alias("last")
    )
    # days of the log and days with changes, so that every day knows the last change before it
    days = log.select("plan_id", day("at").alias("__day")).distinct().withColumn("asked", F.lit(True))
    both = by_day.join(days, ["plan_id", "__day"], "full")
    before = W.partitionBy("plan_id").orderBy("__day").rowsBetween(W.unboundedPreceding, -1)
    known = both.withColumn("start", F.last("last.status", ignorenulls=True).over(before)).filter("asked")
    rows = log.withColumn("__day", day("at")).join(known.select("plan_id", "__day", "changes", "start"), ["plan_id", "__day"])
    earlier = F.filter("changes", lambda c: c["at"] <= F.col("at").cast("timestamp"))
    within = F.when(F.size(earlier) > 0, F.element_at(earlier, -1)["status"])
    return rows.withColumn(out, F.coalesce(within, "start", F.lit("draft"))).select(*log.columns, out)


def audit_reversals(reversals: DataFrame, overrides: DataFrame, audit: DataFrame) -> DataFrame:
    """Why a reversal does not count: blank reason, locked plan, an override that is not there, or one already reversed.

    ``reversals`` has plan_id, override_id, seq, at, reason; the plan's state is taken at that time. Of several
    reversals of an override that nothing else speaks against, the first one counts. Overrides that were
    rejected, or entered later, are not there.
    """
    standing = overrides.filter(F.col("rejected").isNull()) if "rejected" in overrides.columns else overrides
    there = standing.groupBy("plan_id", F.col("id").alias("override_id")).agg(F.min("at").alias("__entered"))
    rows = state_at(reversals, audit).join(there, ["plan_id", "override_id"], "left")
    reason = (
        F.when(F.coalesce(F.trim("reason"), F.lit("")) == "", "reason required")
        .when(F.col("status_at").isin(LOCKED_STATES), "plan locked")
        .when(F.col("__entered").isNull() | (F.col("__entered") > F.col("at")), "unknown override")
    )
    rows = rows.withColumn("rejected", reason)
    first = rows.filter("rejected IS NULL").groupBy("plan_id", "override_id").agg(F.min(F.struct("at", "seq")).alias("__first"))
    rows = rows.join(first, ["plan_id", "override_id"], "left")
    late = F.col("rejected").isNull() & (F.struct("at", "seq") != F.col("__first"))
    return rows.withColumn("rejected", F.when(late, "already reversed").otherwise(F.col("rejected"))).select(
        *reversals.columns, "status_at", "rejected"
    )


def reversed_overrides(overrides: DataFrame, reversals: DataFrame) -> DataFrame:
    """Overrides with ``reverted_at`` and ``revert_reason`` from the accepted rows of ``audit_reversals`` alone."""
    done = reversals.filter("rejected IS NULL").select(
        "plan_id", F.col("override_id").alias("id"), F.col("at").alias("reverted_at"), F.trim("reason").alias("revert_reason")
    )
    return overrides.drop("reverted_at", "revert_reason").join(done, ["plan_id", "id"], "left")


def active_overrides(overrides: DataFrame) -> DataFrame:
    """The value that counts per plan, item and period: the last write that was not reversed.

    ``max_by`` combines before the shuffle, so a much-edited cell is no hot spot.
    """
    live = overrides.filter(F.col("reverted_at").isNull())
    if "rejected" in overrides.columns:
        live = live.filter(F.col("rejected").isNull())
    last = F.max_by(F.greatest(F.lit(0.0), F.col("value")), F.struct("at", "id"))
    return live.groupBy("plan_id", "item_id", "period").agg(last.alias("value"))


def deciding_plan(plans: DataFrame) -> DataFrame:
    """The first approved or published plan of every run."""
    done = plans.filter(F.col("status").isin(EVIDENCE_STATES))
    return done.groupBy("run_id").agg(F.min_by("plan_id", F.struct("created_at", "plan_id")).alias("plan_id"))


def approved_plan(forecast: DataFrame, active: DataFrame, plans: DataFrame) -> DataFrame:
    """Forecast rows of a run with ``approved``: the override where the deciding plan has one."""
    chosen = active.join(deciding_plan(plans), "plan_id").select(
        "run_id", "item_id", F.col("period").alias("ts"), F.col("value").alias("__value")
    )
    rows = forecast.join(chosen, ["run_id", "item_id", "ts"], "left")
    return rows.withColumn("approved", F.coalesce("__value", "baseline_mean")).drop("__value")


def overlay_rollup(approved: DataFrame, keys: list[str]) -> DataFrame:
    """A view's total with the differences that overrides of its items make."""
    change = F.col("approved") - F.col("baseline_mean")
    return approved.groupBy(*keys).agg(F.sum("mean").alias("mean"), F.sum(F.col("mean") + change).alias("approved"))


def plan_timeline(audit: DataFrame, comments: DataFrame, overrides: DataFrame) -> DataFrame:
    """Status changes, comments, overrides and reversals of every plan in one order.

    ``audit`` must carry ``at``; only accepted changes are part of the history.
    """
    note = lambda *parts: F.concat(*parts).alias("note")
    status = audit.filter("valid").select("plan_id", "at", F.lit("status").alias("kind"), F.col("status").alias("note"))
    words = comments.select("plan_id", "at", F.lit("comment").alias("kind"), note(F.lit("Comment: "), F.trim("text")))
    cell = F.concat("item_id", F.lit(" · "), F.col("period").cast("string"))
    added = overrides.select(
        "plan_id", "at", F.lit("override").alias("kind"),
        note(F.lit("Override added for "), cell, F.lit(": "), F.trim("reason")),
    )
    undone = overrides.filter(F.col("reverted_at").isNotNull()).select(
        "plan_id", F.col("reverted_at").alias("at"), F.lit("reversal").alias("kind"),
        note(F.lit("Override "), F.col("id"), F.lit(" reversed: "), F.coalesce(F.trim("revert_reason"), F.lit(""))),
    )
    rows = status.unionByName(words).unionByName(added).unionByName(undone)
    return rows.orderBy("plan_id", "at", "kind", "note")
