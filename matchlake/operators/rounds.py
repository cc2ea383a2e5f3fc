"""Raw round files -> cleaned rounds -> curated rounds -> next-round features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

# Other names of raw columns, in the order in which they are looked at.
ALIASES = {
    "file": ("file", "demo_file"),
    "round": ("round", "round_number", "round_num", "round_id"),
    "ct_eq_val": ("ct_eq_val", "ct_eq", "ct_money"),
    "t_eq_val": ("t_eq_val", "t_eq", "t_money"),
}
REASONS = ("missing_required", "invalid_winner", "invalid_round", "invalid_economy")
SILVER = ("file", "round_number", "map", "round_type", "winner_side_current", "ct_eq_val", "t_eq_val")
GOLD = (*SILVER, "eq_diff", "half", "overtime_flag")
LAGGED = ("eq_diff", "winner_side_code", "ct_eq_val", "t_eq_val", "kills_round", "total_hp_dmg")
ROLLED = ("eq_diff", "total_hp_dmg", "kills_round")


def need(df: DataFrame, columns, what: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {', '.join(missing)}")


def alias_of(df: DataFrame, name: str) -> Column:
    """The first of a column's names that is there and not empty."""
    found = [S.clean_cell(F.col(c)) for c in ALIASES.get(name, (name,)) if c in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def once(rows: DataFrame, *columns: Column) -> DataFrame:
    """`src_ord` and columns that are worked out once a row however often they are used: filters on them stay above the
    generator, and projections do not merge with it."""
    return rows.select("src_ord", F.inline(F.array(F.struct(*columns))))


def silver_checked(raw: DataFrame) -> DataFrame:
    """Raw rows with a source ordinal `src_ord` -> the columns of SILVER, `src_ord` and the reason of a rejection."""
    side = S.side_name(F.col("winner_side")) if "winner_side" in raw.columns else F.lit(None).cast("string")
    cells = once(raw, *[alias_of(raw, c).alias(c) for c in ("file", "round", "map", "ct_eq_val", "t_eq_val", "round_type")], side.alias("winner"))
    number = lambda c: F.col(c).try_cast(S.DECIMAL)
    lacks = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in ("file", "round", "map", "winner", "ct_eq_val", "t_eq_val")))
    rows = once(cells, "file", "map", "round_type", lacks.alias("lacks"), S.side_of(F.col("winner")).alias("winner"), number("round").alias("n"), number("ct_eq_val").alias("ct"), number("t_eq_val").alias("t"))
    n, ct, t = S.positive_of(F.col("n")), S.amount_of(F.col("ct")), S.amount_of(F.col("t"))
    reason = F.when(F.col("lacks"), REASONS[0]).when(F.col("winner").isNull(), REASONS[1]).when(n.isNull(), REASONS[2]).when(ct.isNull() | t.isNull(), REASONS[3])
    kind = F.coalesce("round_type", F.lit("unknown")).alias("round_type")
    return rows.select("src_ord", "file", n.alias("round_number"), "map", kind, F.col("winner").alias("winner_side_current"), ct.alias("ct_eq_val"), t.alias("t_eq_val"), reason.alias("reason"))


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that comes last; `order` ranks it first."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def silver(raw: DataFrame) -> DataFrame:
    good = silver_checked(raw).where("reason IS NULL")
    return keep_last(good, ["file", "round_number"], [F.col("src_ord").desc()]).select(*SILVER)


def silver_quality(raw: DataFrame, files: int | None = None) -> DataFrame:
    """One row of counters."""
    rows = silver_checked(raw)
    per_key = rows.groupBy("reason", "file", "round_number").agg(F.count(F.lit(1)).alias("n"))
    good = F.when(F.col("reason").isNull(), F.col("n"))
    out = per_key.agg(
        F.sum("n").cast("long").alias("rows_read"),
        F.count(good).cast("long").alias("rows_output"),
        F.coalesce(F.sum(good - 1), F.lit(0)).cast("long").alias("duplicate_round_keys"),
        *[F.coalesce(F.sum(F.when(F.col("reason") == r, F.col("n"))), F.lit(0)).cast("long").alias(r) for r in REASONS],
    ).withColumn("rows_removed", F.col("rows_read") - F.col("rows_output"))
    return out if files is None else out.withColumn("files_processed", F.lit(files))


def gold_checked(rows: DataFrame) -> DataFrame:
    """Silver rows (text or typed) -> typed columns, `src_ord` and whether the row is valid."""
    need(rows, SILVER, "silver input")
    cells = once(
        rows, *[S.clean_cell(F.col(c)).alias(c) for c in ("file", "map", "round_type")], S.side_name(F.col("winner_side_current")).alias("winner"),
        *[S.decimal_of(F.col(c)).alias(c) for c in ("round_number", "ct_eq_val", "t_eq_val")],
    )
    out = cells.select(
        "src_ord", "file", S.positive_of(F.col("round_number")).alias("round_number"), "map", F.coalesce("round_type", F.lit("unknown")).alias("round_type"),
        S.side_of(F.col("winner")).alias("winner_side_current"), S.amount_of(F.col("ct_eq_val")).alias("ct_eq_val"), S.amount_of(F.col("t_eq_val")).alias("t_eq_val"),
    )
    valid = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in ("file", "round_number", "map", "winner_side_current", "ct_eq_val", "t_eq_val")))
    return out.withColumn("valid", valid)


def gold(rows: DataFrame) -> DataFrame:
    good = keep_last(gold_checked(rows).where("valid"), ["file", "round_number"], [F.col("src_ord").desc()])
    n = F.col("round_number")
    return good.select(*SILVER, (F.col("ct_eq_val") - F.col("t_eq_val")).cast(S.DECIMAL).alias("eq_diff"), S.half_of(n).alias("half"), S.overtime(n).alias("overtime_flag"))


def gold_quality(rows: DataFrame) -> DataFrame:
    per_key = gold_checked(rows).groupBy("valid", "file", "round_number").agg(F.count(F.lit(1)).alias("n"))
    good = F.when(F.col("valid"), F.col("n"))
    return per_key.agg(
        F.sum("n").cast("long").alias("rows_read"), F.count(good).cast("long").alias("rows_output"), F.coalesce(F.sum(good - 1), F.lit(0)).cast("long").alias("duplicate_round_keys"),
        F.coalesce(F.sum(F.when(~F.col("valid"), F.col("n"))), F.lit(0)).cast("long").alias("invalid_rows"),
    ).withColumn("rows_removed", F.col("rows_read") - F.col("rows_output"))


def as_text(rows: DataFrame) -> DataFrame:
    """Decimals in their canonical text form, as the CSV tables hold them."""
    return rows.select(*[S.canonical(F.col(c)).alias(c) if c in ("ct_eq_val", "t_eq_val", "eq_diff") else F.col(c) for c in rows.columns])


# ---- event mode


def combat(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin("damage", "kill") & F.col("file").isNotNull() & S.number(F.col("round")).isNotNull()).withColumn("round", S.number(F.col("round")).cast("int"))


def combat_totals(events: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(S.number(F.col(c)), F.lit(0.0))
    return combat(events).groupBy("file", "round").agg(
        F.sum(zero("hp_dmg")).alias("total_hp_dmg"), F.sum(zero("arm_dmg")).alias("total_arm_dmg"), F.sum(F.when(F.col("event_type") == "kill", 1).otherwise(0)).cast("long").alias("kills_round"), F.max(S.flag(F.col("is_bomb_planted")).cast("int")).alias("bomb_planted_any")
    )


def end_states(events: DataFrame) -> DataFrame:
    """The state after a round's last fight that has a tick."""
    rows = combat(events).withColumn("tick", S.number(F.col("tick"))).where("tick IS NOT NULL")
    last = rows.groupBy("file", "round").agg(F.max_by(F.struct("ct_alive", "t_alive"), F.struct("tick", "src_ord")).alias("x"))
    return last.select("file", "round", S.number(F.col("x.ct_alive")).alias("ct_alive_end"), S.number(F.col("x.t_alive")).alias("t_alive_end"))


def latest_meta(events: DataFrame) -> DataFrame:
    """A round's last meta row; one without a tick counts as the latest."""
    rows = events.where(F.col("event_type") == "round_meta").withColumns({"round": S.number(F.col("round")).cast("int"), "winner_side_norm": S.winner_side(F.col("winner_side")), "tick": S.number(F.col("tick"))})
    rows = rows.dropna(subset=["file", "round", "map", "winner_side_norm"])
    last = keep_last(rows, ["file", "round"], [F.col("tick").desc_nulls_first(), F.col("src_ord").desc()])
    return last.select("file", "round", "map", F.coalesce(F.col("round_type"), F.lit("unknown")).alias("round_type"), "winner_side_norm", S.number(F.col("ct_eq_val")).alias("ct_eq_val"), S.number(F.col("t_eq_val")).alias("t_eq_val"))


def event_rounds(events: DataFrame) -> DataFrame:
    need(events, ("file", "round", "event_type", "map", "round_type", "winner_side", "ct_eq_val", "t_eq_val", "hp_dmg", "arm_dmg", "tick", "ct_alive", "t_alive", "is_bomb_planted"), "events")
    rows = latest_meta(events).join(combat_totals(events), ["file", "round"], "left").join(end_states(events), ["file", "round"], "left")
    n = F.col("round")
    return rows.fillna(0, subset=["total_hp_dmg", "total_arm_dmg", "kills_round", "bomb_planted_any"]).withColumns({
        "eq_diff": F.col("ct_eq_val") - F.col("t_eq_val"), "alive_diff_end": F.col("ct_alive_end") - F.col("t_alive_end"), "round_number": n, "overtime_flag": S.overtime(n), "half": S.half_of(n), "winner_side_code": (F.col("winner_side_norm") == "CT").cast("int"),
    })


def context_rounds(rows: DataFrame) -> DataFrame:
    """Gold rows -> the round frame."""
    need(rows, GOLD, "round context")
    num = lambda c: S.number(F.col(c))
    out = rows.withColumns({"round_number": num("round_number").cast("int"), "winner_side_norm": S.winner_side(F.col("winner_side_current"))}).dropna(subset=["file", "round_number", "map", "winner_side_norm"])
    return out.select(
        "file", "round_number", "map", F.coalesce("round_type", F.lit("unknown")).alias("round_type"), "winner_side_norm", (F.col("winner_side_norm") == "CT").cast("int").alias("winner_side_code"), num("ct_eq_val").alias("ct_eq_val"), num("t_eq_val").alias("t_eq_val"),
        F.coalesce(num("eq_diff"), num("ct_eq_val") - num("t_eq_val")).alias("eq_diff"), F.coalesce(F.col("half"), F.lit("H1")).alias("half"), F.coalesce(num("overtime_flag").cast("int"), F.lit(0)).alias("overtime_flag"),
    )


# ---- supervised frame


def supervised(rounds: DataFrame, lags: int = 3, cross_file: bool = False) -> DataFrame:
    """The winner of a file's next round, lags of the columns of LAGGED and rolling means of the columns of ROLLED that
    `rounds` has; the last round of a file has no target and is dropped.

    With cross_file=True rolling means run on over the files in one order; by default, they stay within a file and share
    the lags' partitioning.
    """
    need(rounds, ("file", "round_number", "winner_side_norm", "winner_side_code"), "rounds")
    own = Window.partitionBy("file").orderBy("round_number")
    out = rounds.withColumns({"target_winner_side_next": F.lead("winner_side_norm").over(own), "target_winner_side_next_code": F.lead("winner_side_code").over(own)})
    out = out.withColumns({f"{c}_lag{k}": F.lag(c, k).over(own) for c in LAGGED if c in rounds.columns for k in range(1, lags + 1)})
    means = lambda w: {f"{c}_rollmean3": F.avg(f"{c}_lag1").over(w.rowsBetween(-2, 0)) for c in ROLLED if c in rounds.columns}
    if cross_file:
        out = _with_rows_before(out, ["file", "round_number"], 2)
        out = out.withColumns(means(Window.partitionBy("_range").orderBy("file", "round_number"))).where("NOT _guest").drop("_range", "_guest")
    else:
        out = out.withColumns(means(own))
    return out.where("target_winner_side_next_code IS NOT NULL")


def _with_rows_before(rows: DataFrame, order: list[str], n: int, ranges: int = 256) -> DataFrame:
    """`rows` in ranges of the first column of `order` (_range), each led by the n rows before it as guests (_guest), so that
    a window of n + 1 rows within a range sees what it would see over all rows. Bounds are `ranges` values at most, those
    with the least hashes; nulls come first, as they are sorted."""
    names = rows.select(order[0]).where(F.col(order[0]).isNotNull()).distinct().orderBy(F.xxhash64(order[0]), order[0]).limit(ranges)
    bounds = F.array(*[F.lit(r[0]) for r in sorted(names.collect())]).cast("array<string>")
    rows = rows.withColumn("_range", F.when(F.col(order[0]).isNull(), -1).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col(order[0])))))
    last = Window.partitionBy("_range").orderBy(*[F.col(c).desc() for c in order])
    tails = rows.withColumn("_rn", F.row_number().over(last)).where(F.col("_rn") <= n).drop("_rn")  # n rows a range
    later = rows.select(F.col("_range").alias("_later")).distinct()
    near = Window.partitionBy("_later").orderBy(*[F.col(c).desc() for c in ["_range", *order]])
    guests = tails.join(F.broadcast(later), F.col("_range") < F.col("_later")).withColumn("_rn", F.row_number().over(near)).where(F.col("_rn") <= n)
    guests = guests.withColumn("_range", F.col("_later")).drop("_later", "_rn")
    return rows.withColumn("_guest", F.lit(False)).unionByName(guests.withColumn("_guest", F.lit(True)))


def consistency(frame: DataFrame) -> DataFrame:
    """One row: repeated keys, and whether targets and lags agree with the rounds that are there."""
    own = Window.partitionBy("file").orderBy("round_number")
    nxt, before = F.lead("winner_side_norm").over(own), F.lag("winner_side_code").over(own)
    rows = frame.select("file", "round_number", nxt.isNull().alias("end"), (F.col("target_winner_side_next") == nxt).alias("target"), before.isNull().alias("start"), F.col("winner_side_code_lag1").eqNullSafe(before).alias("lag"))
    return rows.agg(
        (F.count(F.lit(1)) - F.count_distinct("file", "round_number")).cast("long").alias("duplicate_round_keys"),
        F.coalesce(F.bool_and(F.when(~F.col("end"), F.col("target"))), F.lit(True)).alias("target_shift_is_valid"),
        F.coalesce(F.bool_and(F.when(~F.col("start"), F.col("lag"))), F.lit(True)).alias("lag1_is_past_only"),
    )


def feature_columns(frame: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns of the model."""
    base = [c for c in ("round_number", "overtime_flag", "ct_eq_val", "t_eq_val", "eq_diff", "total_hp_dmg", "total_arm_dmg", "kills_round", "bomb_planted_any", "ct_alive_end", "t_alive_end", "alive_diff_end") if c in frame.columns]
    made = [c for c in frame.columns if "_lag" in c or "_rollmean" in c]
    return base + made, [c for c in ("map", "round_type", "half", "winner_side_norm") if c in frame.columns]


def head(rows: DataFrame, max_rows: int, order: str = "src_ord") -> DataFrame:
    """The first rows in the order of the source."""
    return rows.orderBy(order).limit(max_rows)
