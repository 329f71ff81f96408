"""Edge cases of the tables that the driver's data does not reach."""

import random
from datetime import timedelta

import __spark_entry__
import pandas as pd
from pyspark.sql import functions as F
from samples import START, events_df

from skirmish.functions import scalars as sc
from skirmish.operators import compare as cp
from skirmish.operators import kills as kl
from skirmish.operators import metrics as mt
from skirmish.operators import runs as rn
from skirmish.operators import spells as sp
from skirmish.operators import timeseries as tm
from skirmish.plans import adapters as ad


def ev(combat, at, source="A", target="T", kind="damage", amount=10, spell="S", zone="Z", event="E", raw=None):
    return (combat, at, event, source, target, spell, raw or amount, amount, kind, 1, zone, 7)


def test_labels(spark):
    row = spark.range(1).select(
        sc.minutes_label(F.lit(125.9)), sc.bracket_label(F.lit(0.4)), sc.bracket_label(F.lit(0.0)),
        sc.played_label(F.lit(3725)), sc.played_label(F.lit(59)), sc.compact_amount(F.lit(2500)),
        sc.compact_amount(F.lit(1500000.0)), sc.compact_amount(F.lit(0.5)), sc.compact_amount(F.lit(152300), html=True),
        sc.is_player_name(F.lit("A-B-C")), sc.is_player_name(F.lit("A--C")), sc.class_of_spec(F.lit("Mistweaver")),
        sc.target_set_label(F.array(*[F.lit(x) for x in "abcdef"])), sc.spell_label(F.lit("S"), F.lit(3.14159)),
    ).first()
    assert list(row) == [
        "2:05", "[00:00]", "", "1h 2m", "0m 59s", "2 K", "2 M", "0", "152&nbsp;<strong>K</strong>",
        True, False, "Monk", "a, b, c, d +2", "S »  3.1%",
    ]


def test_durations_rates_and_combat_zero(spark):
    df = events_df(spark, [ev(0, 0), ev(1, 0, amount=30), ev(1, 10, kind="absorb", amount=5), ev(2, 20), ev(3, None)])
    stats = {r.combat_id: r for r in mt.encounter_stats(df).collect()}
    assert set(stats) == {1, 2, 3}
    assert (stats[1].dps, stats[1].hps, stats[2].dps, stats[3].duration_s) == (3.0, 0.5, 0.0, 0.0)
    assert mt.totals_meta(df).first().total_combats == 4
    assert mt.character_counts(df).first().combats == 4
    assert mt.overall_stats(df.filter("combat_id > 9")).first().n_encounters == 0


def test_main_target_fallbacks(spark):
    rows = [
        ev(1, 0, "Me", "Me", "heal"), ev(1, 1, "Me", "Foe", "heal"), ev(1, 5, "Me", "Foe", "heal"), ev(1, 2, "Me", "Me"),
        ev(2, 0, "Me", "B", amount=1), ev(2, 1, "Me", "B", amount=1), ev(2, 2, "Me", "A", amount=50),
        ev(3, 0, "Me", "", "heal"), ev(3, 1, "Me", "Me", "heal"),
    ]
    df = events_df(spark, rows)
    pick = {p: {r.combat_id: r.main_target for r in mt.main_target(df, p).collect()} for p in ("hits", "damage", "header")}
    assert pick["hits"] == {2: "B"}
    assert pick["damage"] == {1: "Me", 2: "A", 3: "Me"}
    assert pick["header"] == {1: "Foe", 2: "B", 3: "Me"}


def test_headline_counts_overkill_and_first_kill(spark):
    rows = [ev(1, 0, raw=40, amount=30), ev(1, 3, target="Foe", kind="other", event="UNIT_DIED"),
            ev(1, 2, target="A", kind="other", event="UNIT_DIED"), ev(1, 10, kind="absorb")]
    r = mt.combat_headline(events_df(spark, rows)).first()
    assert (r.player, r.overkill_pct, r.first_kill_s, r.total_absorb, r.hps) == ("A", 25.0, 3.0, 10, 1.0)


def test_recent_cut_comes_before_hiding(spark):
    df = events_df(spark, [ev(c, c * 100) for c in range(1, 6)])
    hidden = spark.createDataFrame([(5,)], "combat_id bigint")
    assert sorted(r.combat_id for r in mt.recent_encounters(df, hidden, n=2).collect()) == [4]
    other = df.withColumn("log_id", F.lit("other"))
    of_main = spark.createDataFrame([("main", 5)], "log_id string, combat_id bigint")
    seen = mt.recent_encounters(df.unionByName(other), of_main, n=20).collect()
    assert ("other", 5) in {(r.log_id, r.combat_id) for r in seen}
    assert ("main", 5) not in {(r.log_id, r.combat_id) for r in seen}


def test_dominant_kind_and_share_before_cut(spark):
    df = events_df(spark, [ev(1, 0, kind="heal", amount=5, spell="X"), ev(1, 1, kind="absorb", amount=9, spell="X"),
                           ev(1, 2, kind="heal", amount=6, spell="Y")])
    (row,) = sp.spell_aggregates(df, ["heal", "absorb"], 1).collect()
    assert (row.spell, row.kind, row["count"], row.total, row.pct) == ("X", "absorb", 2, 14, 70.0)


def test_series_keeps_the_hole_between_the_sides(spark):
    rows = [ev(1, 0), ev(1, 6), ev(1, 20, kind="heal"), ev(1, 26, kind="absorb")]
    got = tm.time_series(events_df(spark, rows), 2).orderBy("bucket_ts").collect()
    assert [(r.bucket_ts - START).seconds for r in got] == [0, 2, 4, 6, 20, 22, 24, 26]
    assert [r.dps for r in got][:4] == [10, 0, 0, 10]


def test_series_and_smoothing_match_pandas(spark):
    rng = random.Random(5)
    rows = [ev(1, rng.random() * 90, kind=rng.choice(["damage", "heal"]), amount=rng.randrange(99), spell=rng.choice("ab")) for _ in range(60)]
    series = tm.time_series(events_df(spark, rows), 3, "a", "healing")
    frame = pd.DataFrame({"t": [START + timedelta(seconds=r[1]) for r in rows], "k": [r[8] for r in rows],
                          "v": [r[7] for r in rows], "s": [r[5] for r in rows]}).set_index("t").sort_index()
    d = frame[frame.k == "damage"].v.resample("3s").sum()
    h = frame[frame.k == "heal"].v.resample("3s").sum()
    want = pd.DataFrame({"dps": d, "hps": h}).fillna(0)
    chosen = frame[(frame.k == "heal") & (frame.s == "a")].v.resample("3s").sum()
    want["selected_dps"], want["selected_hps"] = 0, chosen.reindex(want.index).fillna(0)
    got = series.toPandas().set_index("bucket_ts").sort_index()[list(want.columns)].astype(float)
    assert (got.to_numpy() == want.to_numpy()).all()
    for seconds, width in ((5, 1), (6, 2), (15, 5)):
        smooth = tm.smooth(series, seconds, 3).toPandas().set_index("bucket_ts").sort_index()[list(want.columns)]
        pandas = want.rolling(width, min_periods=1, center=True).mean()
        assert abs(smooth.to_numpy() - pandas.to_numpy()).max() < 1e-9


def test_frames_show_damage_from_its_second_on(spark):
    rows = [ev(1, 0, "A", amount=5), ev(1, 1.5, "A", amount=7), ev(1, 2, "B", amount=1), ev(1, 300, "A")]
    every = tm.cumulative_frames(events_df(spark, rows)).collect()
    assert len(every) == 602 and max((r.frame, r.damage) for r in every if r.source == "A")[0] == 300
    shown = tm.cumulative_frames(events_df(spark, rows), max_bars=5, max_frames=120)
    got = {(r.source, r.frame): r.damage for r in shown.collect()}
    assert len(got) == 240
    assert [got["A", t] for t in range(4)] == [5, 5, 12, 12] and got["B", 119] == 1


def test_frames_of_every_second_are_registered(spark, tmp_path):
    """A registered query has a frame for each second, with the damage until then."""
    rng = random.Random(4)
    rows = [(i, START.replace(hour=i % 2 * 5 + 1, minute=rng.randrange(9), second=rng.randrange(60), microsecond=rng.randrange(3) * 400_000),
             rng.randrange(30), rng.choice(["click", "purchase", "view"]), rng.randrange(999) / 100, '{"k": %d}' % rng.randrange(50)) for i in range(300)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    hits = [r for r in ad.combat_events(spark, str(tmp_path)).collect()]
    span = {c: [min(r.ts for r in hits if r.combat_id == c), max(r.ts for r in hits if r.combat_id == c)] for c in {r.combat_id for r in hits}}
    want = {}
    for c, s in {(r.combat_id, r.source) for r in hits if r.type == "damage"}:
        mine = [r for r in hits if (r.combat_id, r.source, r.type) == (c, s, "damage")]
        for frame in range(max(1, -((span[c][0] - span[c][1]) // timedelta(seconds=1))) + 1):
            want[c, s, frame] = sum(r.effective_amount for r in mine if r.ts <= span[c][0] + timedelta(seconds=frame))
    got = __spark_entry__.queries()["cumulative_frames_second"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.combat_id, r.source, r.frame): r.damage for r in got} == want


def test_runs_break_on_zone_and_on_gap_after_the_end(spark):
    rows = [ev(1, 0), ev(1, 600), ev(2, 1700), ev(3, 1800, zone="Y"), ev(4, 1900), ev(5, 1900 + 1201), ev(6, 90000), ev(7, 90100)]
    enc = rn.assign_runs(rn.encounter_summary(events_df(spark, rows))).orderBy("combat_id").collect()
    assert [r.run_id for r in enc] == [1, 1, 2, 3, 4, 5, 5]


def test_kill_tolerances(spark):
    enc = rn.assign_runs(rn.encounter_summary(events_df(spark, [ev(1, 0), ev(1, 100), ev(2, 101), ev(2, 130)])))
    kills = spark.createDataFrame(
        [("main", i, f"B{i}", START, START + timedelta(seconds=at), 1, zone) for i, at, zone in
         ((0, 120, 1), (1, 115, 0), (2, 150, 1), (3, 151, 1), (4, 115, 9))],
        "log_id string, seq bigint, boss_name string, start_ts timestamp, end_ts timestamp, kill_flag int, zone_id int",
    )
    got = {r.combat_id: r.boss_name for r in kl.kills_to_encounters(enc, kills).collect()}
    assert got == {1: "B0", 2: "B2"}
    marked = {r.combat_id: r.is_boss for r in kl.mark_boss_encounters(enc, kills).collect()}
    assert marked == {1: True, 2: True}
    runs = kl.kills_to_runs(rn._run_totals(enc), kills).first()
    assert runs.boss_names == "B0, B2, B3"


def best_pairs(prints, chars, threshold):
    """Greedy pairing, one reference encounter after the other."""
    order = sorted(chars, key=lambda c: (len(prints[c]), chars.index(c)))
    ref, others = order[0], [c for c in chars if c != order[0]]
    taken, groups = set(), set()
    for rid in sorted(prints[ref]):
        mine, group = prints[ref][rid], {}
        for c in others:
            scored = [
                (-len(mine & f) / len(mine | f), i) for i, f in sorted(prints[c].items()) if f and (c, i) not in taken
            ]
            if mine and scored and 0 < -min(scored)[0] >= threshold:
                group[c] = min(scored)[1]
        if mine and len(group) == len(others):
            taken |= set(group.items())
            groups |= {(rid, c, i) for c, i in group.items()} | {(rid, ref, rid)}
    return groups


def test_pairing_is_the_greedy_one(spark):
    rng = random.Random(3)
    for chars in (["A", "B"], ["A", "B", "C"]):
        for threshold in (0.5, 0.75, 1.0):
            prints = {
                c: {i: frozenset(rng.sample("uvwxyz", rng.randrange(0, 4))) for i in rng.sample(range(100), rng.randrange(8, 14))}
                for c in chars
            }
            rows = [(c, "main", i, sorted(f)) for c, p in prints.items() for i, f in p.items()]
            df = spark.createDataFrame(rows, "character string, log_id string, combat_id bigint, targets array<string>")
            got = {(r.ref_combat_id, r.character, r.combat_id) for r in cp.pair_encounters(df, chars, threshold).collect()}
            assert got == best_pairs(prints, chars, threshold), (chars, threshold)
            if threshold < 1:  # blocks of few encounters give the same
                one = [("", c, place, len(chars)) for place, c in enumerate(chars)]
                comparison = spark.createDataFrame(one, "comparison string, character string, place int, _n int")
                small = cp.pair_encounters_each(df, comparison, threshold, block=3).collect()
                assert {(r.ref_combat_id, r.character, r.combat_id) for r in small} == got


def test_every_two_characters_are_paired(spark):
    rng = random.Random(6)
    prints = {
        c: {i: frozenset(rng.sample("uvwxyz", rng.randrange(0, 5))) for i in rng.sample(range(100), rng.randrange(8, 14))}
        for c in "ABCD"
    }
    rows = [(c, "main", i, sorted(f)) for c, p in prints.items() for i, f in p.items()]
    df = spark.createDataFrame(rows, "character string, log_id string, combat_id bigint, targets array<string>")
    for threshold in (0.3, 0.5, 0.75, 1.0):
        each = cp.pair_exact_each if threshold == 1.0 else lambda p, t: cp.pair_encounters_each(p, t, threshold)
        pairs = each(df, cp.every_two(df))
        got = {(r.comparison, r.ref_combat_id, r.character, r.combat_id) for r in pairs.collect()}
        want = {
            (f'["{a}","{b}"]', *g) for a in "ABCD" for b in "ABCD" if a < b for g in best_pairs(prints, [a, b], threshold)
        }
        assert got == want and cp.pair_table_each(pairs).count() * 2 == len(want), threshold
    registered = __spark_entry__.queries()["every_pair_exact"](spark, "/root/testdata/sf0.001")
    assert registered.select("comparison").distinct().count() > 1


def test_source_options_order(spark):
    rows = [ev(c, c, "npc") for c in (1, 2, 3)] + [ev(1, 1, "rare"), ev(1, 1, "Z-R-E"), ev(1, 1, "B-R-E"), ev(1, 1, "")]
    got = [r.source for r in mt.source_options(events_df(spark, rows), include_others=True).collect()]
    assert got == ["B-R-E", "Z-R-E", "npc"]
    assert [r.source for r in mt.source_options(events_df(spark, rows)).collect()] == ["B-R-E", "Z-R-E"]


def test_rotation_pads_missing_spells(spark):
    rows = [ev(1, 0, spell="a"), ev(1, 1, spell="b"), ev(2, 10, spell="c"), ev(2, 11, spell="a")]
    got = cp.rotation_compare(events_df(spark, rows), 1, 2).collect()
    assert {(r.side, r.spell_name, r.position) for r in got if r.is_padding} == {("Left", "c", 3), ("Right", "b", 2)}
    assert sum(not r.is_padding for r in got) == 4


def test_combat_delta(spark):
    boss = spark.createDataFrame(
        [("main", "B", 1, 10.0, 1.0, 60.0), ("main", "B", 2, 4.0, 3.0, 50.0)],
        "log_id string, boss_name string, combat_id bigint, dps double, hps double, duration_s double",
    )
    r = cp.combat_delta(boss, 1, 2).first()
    assert (r.delta_dps, r.delta_hps, r.delta_duration_s) == (6.0, -2.0, 10.0)


def test_trend_matches_pandas_for_every_width(spark):
    rng = random.Random(8)
    rows = {n: [(f"log{n}", 2 * i + 1, rng.random(), rng.random()) for i in range(n)] for n in (1, 2, 7, 9, 13, 16)}
    df = spark.createDataFrame(sum(rows.values(), []), "log_id string, combat_id bigint, dps double, hps double")
    got = tm.encounter_trend(df).toPandas().sort_values(["log_id", "combat_id"])
    for n, part in rows.items():
        want = pd.DataFrame(part, columns=["log_id", "combat_id", "dps", "hps"])
        rolled = want[["dps", "hps"]].rolling(max(2, min(5, n // 3 or 1)), min_periods=1, center=True).mean()
        mine = got[got.log_id == f"log{n}"]
        assert list(mine.combat_id) == list(want.combat_id)
        assert abs(mine[["dps_roll", "hps_roll"]].to_numpy() - rolled.to_numpy()).max() < 1e-9
