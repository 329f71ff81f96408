"""Encounter detection against a plain row-by-row account of the rules."""

import random
import re
from datetime import timedelta

import pytest
from samples import ME, START, died, line, lines_df, mob, spell_hit, swing, units, zone

from skirmish.operators import scans, stamp
from skirmish.plans.import_logs import boss_kills_of, encounters_of, stamped_events


def found(spark, texts, timeout_s=8.0):
    rows = encounters_of(lines_df(spark, texts), timeout_s).orderBy("combat_id").collect()
    return [
        (
            r.combat_id, round((r.start_ts - START).total_seconds(), 4),
            round((r.end_ts - START).total_seconds(), 4), r.enemy_guids, r.zone_name, r.close_reason,
        )
        for r in rows
    ]


@pytest.mark.parametrize(
    "texts, want",
    [
        ([spell_hit(0, ME, mob(1)), died(3, mob(1))], [(1, 0, 3, ["Creature-1"], "", "all_dead")]),
        (
            [swing(0, mob(1), ME), swing(1, mob(2), ME), died(2, mob(1)), died(3, ME), died(4, mob(2))],
            [(1, 0, 3, ["Creature-1", "Creature-2"], "", "player_death")],
        ),
        (
            [spell_hit(0, ME, mob(1)), spell_hit(8, ME, mob(1)), spell_hit(16.5, ME, mob(1))],
            [(1, 0, 8, ["Creature-1"], "", "timeout"), (2, 16.5, 16.5, ["Creature-1"], "", "end_of_log")],
        ),
        (
            [spell_hit(0, ME, mob(1)), died(1, mob(1)), spell_hit(1.1, ME, mob(1)), swing(2, mob(2), ME)],
            [(1, 0, 1, ["Creature-1"], "", "all_dead"), (2, 2, 2, ["Creature-2"], "", "end_of_log")],
        ),
        (
            [zone(0, 1, "A"), zone(1, 2, "UNKNOWN AREA"), spell_hit(2, ME, mob(1)), zone(3, 3, "B"),
             spell_hit(4, ME, mob(2)), died(5, mob(1)), died(6, mob(2)), spell_hit(7, ME, mob(3))],
            [(1, 2, 6, ["Creature-1", "Creature-2"], "A", "all_dead"), (2, 7, 7, ["Creature-3"], "B", "end_of_log")],
        ),
        # A death of an enemy from an earlier, timed-out fight does not prolong this one.
        (
            [spell_hit(0, ME, mob(9)), spell_hit(20, ME, mob(1)), died(26, mob(9)), spell_hit(30, ME, mob(1))],
            [(1, 0, 0, ["Creature-9"], "", "timeout"), (2, 20, 20, ["Creature-1"], "", "timeout"),
             (3, 30, 30, ["Creature-1"], "", "end_of_log")],
        ),
        # The clock runs back; an old death leads the new lap and cuts nothing.
        (
            [spell_hit(0, ME, mob(9)), spell_hit(100, ME, mob(1)), died(50, mob(9)), spell_hit(70, ME, mob(1))],
            [(1, 0, 0, ["Creature-9"], "", "timeout"), (2, 100, 70, ["Creature-1"], "", "end_of_log")],
        ),
        # Friends hitting friends and the dead hitting nobody open nothing.
        ([swing(0, ME, ME), died(1, mob(1)), spell_hit(2, ME, mob(1))], []),
    ],
)
def test_rules(spark, texts, want):
    assert found(spark, texts) == want


def account(rows, timeout):
    """Encounters of (t, what, guid) rows in order; what is hit, death or player."""
    out, dead, current = [], set(), None
    for t, what, guid in rows:
        if current and t - current["last"] > timeout:
            out.append((current["start"], current["last"], frozenset(current["met"])))
            current = None
        if what == "hit":
            if guid in dead:
                continue
            current = current or {"start": t, "met": set(), "alive": set()}
            current["met"].add(guid)
            current["alive"].add(guid)
            current["last"] = t
            continue
        dead.add(guid)
        if current and guid in current["alive"]:
            current["alive"].remove(guid)
            current["last"] = t
            over = not current["alive"]
        else:
            over = bool(current) and what == "player"
        if over:
            out.append((current["start"], t, frozenset(current["met"])))
            current = None
    if current:
        out.append((current["start"], current["last"], frozenset(current["met"])))
    return out


def random_log(rng, n, backwards):
    ms, rows, texts, fresh = 0, [], [], 0
    for _ in range(n):
        ms += rng.choice([0, 500, 1000, 3000, 5000, 7900, 8000, 8100, 15000])
        if backwards and rng.random() < 0.05:
            ms -= rng.choice([500, 6000, 40000])
        t = ms / 1000
        dice, k = rng.random(), rng.randrange(fresh, fresh + 4)
        fresh += rng.random() < 0.1
        if dice < 0.6:
            rows.append((ms, "hit", f"Creature-{k}"))
            texts.append(spell_hit(t + 100, ME, mob(k)) if k % 2 else swing(t + 100, mob(k), ME))
        elif dice < 0.9:
            rows.append((ms, "death", f"Creature-{k}"))
            texts.append(died(t + 100, mob(k)))
        else:
            rows.append((ms, "player", "Player-1"))
            texts.append(died(t + 100, ME))
    return rows, texts


@pytest.mark.parametrize("backwards", [False, True])
def test_random_logs_in_small_blocks(spark, monkeypatch, backwards):
    """Many logs at once, with blocks of eight rows so that every scan crosses blocks."""
    monkeypatch.setattr(scans, "BLOCK_BITS", 3)
    rng = random.Random(11)
    want, texts = {}, []
    for i in range(40):
        rows, log = random_log(rng, 60, backwards and i % 2 == 0)
        want[f"log{i}"] = account(rows, 8000)
        texts += [(f"log{i}", seq, text) for seq, text in enumerate(log)]
    lines = spark.createDataFrame(texts, "log_id string, seq bigint, value string")
    got = {k: [] for k in want}
    base = START + timedelta(seconds=100)
    for r in encounters_of(lines).orderBy("log_id", "combat_id").collect():
        assert r.combat_id == len(got[r.log_id]) + 1
        got[r.log_id].append(
            (
                (r.start_ts - base) // timedelta(milliseconds=1),
                (r.end_ts - base) // timedelta(milliseconds=1),
                frozenset(r.enemy_guids),
            )
        )
    assert got == want
    assert sum(map(len, want.values())) > 300


def test_stamping_at_the_edges(spark):
    texts = [
        spell_hit(0, ME, mob(1)), died(2, mob(1)), spell_hit(2, ME, mob(2)), died(3, mob(2)),
        spell_hit(5, ME, mob(1), 9), "3/4/2026 16:00:01  " + swing(0, ME, mob(5)).split("  ", 1)[1],
    ]
    lines = lines_df(spark, texts)
    rows = stamped_events(lines, encounters_of(lines)).orderBy("seq").collect()
    assert [(r.seq, r.combat_id) for r in rows] == [(0, 1), (2, 2), (4, 0), (5, 0)]


def test_stamping_long_encounters_meet_every_minute(spark):
    texts = [spell_hit(t, ME, mob(1)) for t in range(0, 400, 5)]
    lines = lines_df(spark, texts)
    assert stamp.BUCKET_S == 60
    assert stamped_events(lines, encounters_of(lines)).filter("combat_id = 1").count() == 80


def marker(at, kind, boss, value):
    return line(at, f"ENCOUNTER_{kind}", 1, f'"{boss}"', 16, 5, value)


def test_marker_pairing(spark):
    texts = [
        marker(0, "END", "X", 1), marker(1, "START", "A", 7), marker(2, "START", "B", 8),
        marker(3, "END", "B", 1), marker(4, "END", "B", 1), marker(5, "START", "C", 9), marker(6, "END", "C", 0),
    ]
    rows = boss_kills_of(lines_df(spark, texts)).orderBy("seq").collect()
    assert [(r.boss_name, r.zone_id, r.kill_flag, (r.end_ts - START).seconds) for r in rows] == [
        ("B", 8, 1, 3), ("C", 9, 0, 6),
    ]


def test_units_helper_shape():
    assert len(units(ME, mob(1))) == 8


def test_one_stamp_per_event_where_the_clock_steps_back(spark):
    """Three fights; the third starts 96 s before the second by the log's clock."""
    texts = [
        spell_hit(0, ME, mob(1)), died(2, mob(1)),
        spell_hit(100, ME, mob(2)), spell_hit(101, ME, mob(2)), died(102, mob(2)),
        spell_hit(4, ME, mob(3)), spell_hit(101, ME, mob(3)), spell_hit(102, ME, mob(3)), died(103, mob(3)),
    ]
    lines = lines_df(spark, texts)
    encounters = spark.createDataFrame(
        [("main", 1, 0, 0, 2), ("main", 2, 2, 100, 102), ("main", 3, 5, 4, 103)],
        "log_id string, combat_id long, open_seq long, a int, b int",
    ).selectExpr(
        "log_id", "combat_id", "open_seq",
        f"timestamp'{START}' + make_interval(0,0,0,0,0,0,a) AS start_ts",
        f"timestamp'{START}' + make_interval(0,0,0,0,0,0,b) AS end_ts",
        "1 AS zone_id", "'Z' AS zone_name",
    )
    got = stamped_events(lines, encounters).orderBy("seq").collect()
    assert [(r.seq, r.combat_id) for r in got] == [(0, 1), (2, 2), (3, 2), (5, 3), (6, 3), (7, 3)]


def test_stamps_where_the_clock_steps_back_a_little(spark):
    """The second fight starts and ends, by the clock, inside the first one."""
    texts = [
        spell_hit(0, ME, mob(1)), spell_hit(250, ME, mob(1)), spell_hit(290, ME, mob(1)), spell_hit(300, ME, mob(1)),
        spell_hit(240, ME, mob(2)), spell_hit(250, ME, mob(2)), spell_hit(260, ME, mob(2)), spell_hit(290, ME, mob(2)),
    ]
    encounters = spark.createDataFrame(
        [("main", 1, 0, 0, 300), ("main", 2, 4, 240, 260)],
        "log_id string, combat_id long, open_seq long, a int, b int",
    ).selectExpr(
        "log_id", "combat_id", "open_seq",
        f"timestamp'{START}' + make_interval(0,0,0,0,0,0,a) AS start_ts",
        f"timestamp'{START}' + make_interval(0,0,0,0,0,0,b) AS end_ts",
        "1 AS zone_id", "'Z' AS zone_name",
    )
    got = stamped_events(lines_df(spark, texts), encounters).orderBy("seq").collect()
    assert [r.combat_id for r in got] == [1, 1, 1, 1, 2, 2, 2, 0]


def test_many_laps_are_joined_by_lap(spark, capsys):
    """Forty laps over the same minute: an event meets the encounter of its own lap only."""
    texts = [x for k in range(40) for x in (spell_hit(k % 7, ME, mob(k)), spell_hit(k % 7 + 1, ME, mob(k)), spell_hit(50, ME, mob(k)))]
    encounters = spark.createDataFrame(
        [("main", k + 1, 3 * k, k % 7, k % 7 + 2) for k in range(40)],
        "log_id string, combat_id long, open_seq long, a int, b int",
    ).selectExpr(
        "log_id", "combat_id", "open_seq",
        f"timestamp'{START}' + make_interval(0,0,0,0,0,0,a) AS start_ts",
        f"timestamp'{START}' + make_interval(0,0,0,0,0,0,b) AS end_ts",
        "1 AS zone_id", "'Z' AS zone_name",
    )
    laps, last = [], None
    for k in range(40):
        laps.append(laps[-1] + (k % 7 < last) if laps else 0)
        last = k % 7 + 2
    want = []
    for k in range(40):
        for at in (k % 7, k % 7 + 1, 50):
            inside = [i for i in range(40) if laps[i] == laps[k] and i % 7 <= at <= i % 7 + 2]
            inside = [i for i in inside if not (i + 1 < 40 and laps[i + 1] == laps[i] and at >= (i + 1) % 7)]
            want.append(inside[0] + 1 if inside else 0)
    df = stamped_events(lines_df(spark, texts), encounters)
    assert [r.combat_id for r in df.orderBy("seq").collect()] == want
    capsys.readouterr()
    df.explain()
    assert re.search(r"Join \[[^\]]*_lap", capsys.readouterr().out)


def test_one_busy_log_without_a_quiet_gap(spark, monkeypatch):
    """Hundreds of blocks, nothing longer than the timeout without a hit: built-in steps only."""
    monkeypatch.setattr(scans, "BLOCK_BITS", 4)
    rng, ms, rows, texts = random.Random(5), 0, [], []
    for k in range(3000):
        ms += rng.choice([0, 200, 900, 3000])
        unit = k // 12 + rng.randrange(4)
        if rng.random() < 0.75:
            rows.append((ms, "hit", f"Creature-{unit}"))
            texts.append(spell_hit(ms / 1000, ME, mob(unit)))
        else:
            rows.append((ms, "death", f"Creature-{unit}"))
            texts.append(died(ms / 1000, mob(unit)))
    df = encounters_of(lines_df(spark, texts))
    got = [
        ((r.start_ts - START) // timedelta(milliseconds=1), (r.end_ts - START) // timedelta(milliseconds=1), frozenset(r.enemy_guids))
        for r in df.orderBy("combat_id").collect()
    ]
    assert got == account(rows, 8000) and len(got) > 20
