import pytest
from pyspark.sql import functions as F

from matchlake.functions import scalars as S
from matchlake.operators import rounds

# One match with a repeated round, one with a cell that is no amount, one with a row that lacks its map.
RAW = """north,7,harbour,T,eco,650,4100
north,8,harbour,ct,full,5200,4900
north,8,harbour, counter-terrorist ,full,5150.50,4900
south,1,quarry,CT,pistol,free,800
south,3,quarry,TERRORIST,full,3900,1e3
west,2,,T,full,100,100"""


def table(spark, text, names):
    rows = [(i, *x.split(",")) for i, x in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "src_ord long, " + ", ".join(f"{n} string" for n in names))


@pytest.fixture
def raw(spark):
    return table(spark, RAW, ["file", "round", "map", "winner_side", "round_type", "ct_eq_val", "t_eq_val"])


def test_silver_keeps_the_last_valid_row(raw):
    rows = {(r.file, r.round_number): r for r in rounds.as_text(rounds.silver(raw)).collect()}
    assert set(rows) == {("north", 7), ("north", 8), ("south", 3)}
    assert rows["north", 8].ct_eq_val == "5150.5" and rows["north", 8].winner_side_current == "CT"
    assert rows["south", 3].t_eq_val == "1000" and rows["south", 3].winner_side_current == "T"
    q = rounds.silver_quality(raw).first()
    assert (q.rows_read, q.rows_output, q.rows_removed, q.duplicate_round_keys, q.invalid_economy, q.missing_required) == (6, 3, 3, 1, 1, 1)


def test_gold(spark):
    text = """north,15,harbour,full,T,2000,2600
north,16,harbour,full,CT,100,50
north,16,harbour,full,CT,75.25,50
north,30,harbour,eco,T,0,10
north,31,harbour,full,CT,9,10
south,0,quarry,eco,T,1,2
south,4,quarry,eco,draw,1,2
south,5,quarry,,T,1,2"""
    rows = table(spark, text, rounds.SILVER)
    got = {(r.file, r.round_number): r for r in rounds.as_text(rounds.gold(rows)).collect()}
    assert set(got) == {("north", 15), ("north", 16), ("north", 30), ("north", 31), ("south", 5)}
    halves = {k: (r.eq_diff, r.half, r.overtime_flag) for k, r in got.items()}
    assert halves["north", 15] == ("-600", "H1", 0) and halves["north", 16] == ("25.25", "H2", 0)
    assert halves["north", 30] == ("-10", "H2", 0) and halves["north", 31] == ("-1", "H1", 1) and got["south", 5].round_type == "unknown"
    q = rounds.gold_quality(rows).first()
    assert (q.rows_read, q.rows_output, q.rows_removed, q.duplicate_round_keys, q.invalid_rows) == (8, 5, 3, 1, 2)
    with pytest.raises(ValueError, match="missing required columns"):
        rounds.gold(rows.drop("map"))


def test_cells(spark):
    rows = spark.createDataFrame([("  1.50\t",), ("0",), ("1e3",), ("-1",), ("x",), (" ",), (None,), ("NaN",), ("3.9",)], "c string")
    got = [tuple(r) for r in rows.select(S.canonical(S.amount(F.col("c"))), S.positive_int(F.col("c")), S.finite(F.col("c"))).collect()]
    assert got == [("1.5", 1, 1.5), ("0", None, 0.0), ("1000", 1000, 1000.0), (None, None, -1.0), (None, None, None), (None, None, None), (None, None, None), (None, None, None), ("3.9", 3, 3.9)]
    assert [r[0] for r in spark.createDataFrame([(6.25,), (1.15,), (27.0,)], "x double").select(S.one_decimal("x")).collect()] == ["6.2", "1.1", "27.0"]


#: Winners of each match, a letter a round; T wins where the money says so.
MATCHES = {"north": "CCTTC", "south": "TCT", "west": "C", "east": "TTTTTTCT", "hill": "CTCT", "dale": "TCCTT", "moor": "CCCTC", "fen": "TTC", "tarn": "CTTCTC"}


def events(spark, matches=MATCHES):
    """For each round a meta row, a first shot for 10 and one for each kill up to the number of the round."""
    out = []
    add = lambda *cells: out.append((len(out), *(None if x is None else str(x) for x in cells)))
    for file, winners in matches.items():
        for r, w in enumerate(winners, 1):
            place = "harbour" if len(winners) % 2 else "quarry"
            add(file, r, place, "round_meta", "full", w.replace("C", "CT"), 3000 + (700 if w == "C" else -400), 3000, None, None, 50, None, None, r == 2)
            add(file, r, place, "damage", None, None, None, None, 10, 3, 60, 5, 5, False)
            for k in range(r):
                add(file, r, place, "kill", None, None, None, None, 100, None, 70 + k, 5 - k % 5, 4, r == 2)
    names = "file round map event_type round_type winner_side ct_eq_val t_eq_val hp_dmg arm_dmg tick ct_alive t_alive is_bomb_planted".split()
    return spark.createDataFrame(out, "src_ord long, " + ", ".join(f"{c} string" for c in names))


def test_supervised_frame(spark):
    frame = rounds.event_rounds(events(spark)).cache()
    assert frame.count() == frame.select("file", "round_number").distinct().count() == sum(map(len, MATCHES.values()))
    assert frame.where("total_hp_dmg <> 10 + 100 * round_number OR kills_round <> round_number OR bomb_planted_any <> int(round_number = 2)").count() == 0
    sup = rounds.supervised(frame)
    per = {r["file"]: r["count"] for r in sup.groupBy("file").count().collect()}
    assert per == {f: len(w) - 1 for f, w in MATCHES.items() if len(w) > 1}
    for r in sup.collect():
        assert r.target_winner_side_next[0] == MATCHES[r.file][r.round_number]
        assert r.winner_side_code_lag1 == (None if r.round_number == 1 else int(MATCHES[r.file][r.round_number - 2] == "C"))
    assert tuple(rounds.consistency(sup).first()) == (0, True, True)
    numeric, categorical = rounds.feature_columns(sup)
    assert len(numeric) + len(categorical) == 37 and len(categorical) == 4 and "winner_side_code" not in numeric  # 12 now, 18 lags, 3 means


def test_rolling_mean_within_and_across_files(spark):
    rows = spark.createDataFrame([("a", 1, "CT", 1, 1.0), ("a", 2, "CT", 1, 2.0), ("a", 3, "CT", 1, 3.0), ("b", 1, "CT", 1, 10.0), ("b", 2, "CT", 1, 20.0), ("b", 3, "CT", 1, 0.0)], "file string, round_number int, winner_side_norm string, winner_side_code int, eq_diff double")
    mean = lambda cross: [r[0] for r in rounds.supervised(rows, cross_file=cross).orderBy("file", "round_number").select("eq_diff_rollmean3").collect()]
    assert mean(False) == [None, 1.0, None, 10.0]
    assert mean(True) == [None, 1.0, 1.5, 6.0]


def test_meta_without_tick_is_the_latest(spark):
    rows = events(spark).where("file = 'north' AND round = '1'")
    late = rows.where("event_type = 'round_meta'").withColumns({"tick": F.lit(None).cast("string"), "winner_side": F.lit("T"), "src_ord": F.lit(-1).cast("long")})
    assert rounds.latest_meta(rows.unionByName(late)).first().winner_side_norm == "T"


def test_context_rounds(spark):
    text = "north,9,harbour,,CT,3000,1200,,,\nnorth,10,harbour,eco,draw,1,2,3,H2,1"
    got = rounds.context_rounds(table(spark, text, rounds.GOLD)).collect()
    assert len(got) == 1 and (got[0].eq_diff, got[0].half, got[0].overtime_flag) == (1800.0, "", 0)
