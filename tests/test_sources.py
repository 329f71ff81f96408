import gzip
import json
import os
import threading
import time
from datetime import timedelta

from samples import ME, START, died, events_df, heal, line, mob, spell_hit, zone

from skirmish.operators.metrics import combat_players, encounter_stats
from skirmish.operators.runs import assign_runs, encounter_summary, run_roles, runs
from skirmish.plans.import_logs import import_logs, imported
from skirmish.sources import layout, logs, sidecars, tables


def test_lines_keep_file_order_over_files_and_splits(spark, tmp_path):
    folder = tmp_path / "mylog"
    folder.mkdir()
    early = [f"early {i}" for i in range(3000)]
    late = [f"late {i}" for i in range(500)]
    # By name the early file sorts last; by the time in its name, first.
    (folder / "Log-010226_200000.txt").write_text("\n".join(late) + "\n")
    (folder / "Log-123125_200000.txt").write_text("\n".join(early) + "\n")
    with gzip.open(folder / "Log-010326_000000.txt.gz", "wt") as f:
        f.write("zipped\n")
    (folder / "nodate.txt").write_text("first\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        rows = logs.read_raw_logs(spark, str(folder)).orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.value for r in rows] == ["first", *early, *late, "zipped"]
    assert [r.seq for r in rows] == list(range(len(rows)))
    assert {r.log_id for r in rows} == {"mylog"}


def test_latest_log_and_freshness(spark, tmp_path):
    for name, age in (("Log-010126_000000.txt", 50), ("Log-010127_000000.txt", 500)):
        (tmp_path / name).write_text(name + "\n")
        os.utime(tmp_path / name, (time.time() - age,) * 2)
    (row,) = logs.latest_log_only(spark, str(tmp_path)).collect()
    assert row.value == "Log-010126_000000.txt"
    age = logs.source_freshness(spark, str(tmp_path)).first()
    assert 45 <= age.age_s <= 120


def test_event_csv_of_any_age(spark, tmp_path):
    new = tmp_path / "new.csv"
    new.write_text(
        "combat_id,timestamp,event,source,target,spell_name,amount,effective_amount,type,zone_id,zone_name,spell_id\n"
        '1,3/4/2026 16:00:00.5,SPELL_HEAL,A,,"Mend, Big",10,9,heal,4,Deep,77\n'
    )
    old = tmp_path / "old.csv"
    old.write_text(
        "combat_id,timestamp,event,player,target,spell_name,amount,effective_amount,type\n"
        "2,bad,SPELL_DAMAGE,B,T,Bolt,5,5,damage\n"
    )
    a = tables.read_events(spark, str(new)).first()
    assert (a.combat_id, a.spell_name, a.target, a.zone_id, a.spell_id) == (1, "Mend, Big", None, 4, 77)
    assert a.ts.microsecond == 500000
    b = tables.read_events(spark, str(old)).first()
    assert (b.source, b.ts, b.zone_id, b.zone_name, b.spell_id) == ("B", None, 0, "", 0)


def test_tables_round_trip(spark, tmp_path):
    ev = events_df(spark, [(1, 0, "E", "A", "T", "S", 5, 5, "damage", 1, "Z", 7), (2, 1, "E", "A", "T", "S", 5, 4, "heal", 1, "Z", 7)])
    tables.write_events(ev, str(tmp_path / "ev"))
    back = tables.read_event_table(spark, str(tmp_path / "ev"))
    assert sorted(back.collect()) == sorted(ev.collect())
    assert tables.next_combat_id(back).first().max_combat_id == 2
    tables.write_events_csv(ev, str(tmp_path / "csv"))
    again = tables.read_events(spark, str(tmp_path / "csv")).orderBy("combat_id").drop("seq")
    assert again.collect() == ev.orderBy("combat_id").drop("seq").collect()
    tables.export_table_csv(ev.select("combat_id", "source"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["combat_id", "source"]


def test_boss_kill_lines(spark, tmp_path):
    path = tmp_path / "kills.jsonl"
    good = {"boss_name": "B", "start_ts": "03/04/2026 16:00:00.000000", "end_ts": "03/04/2026 16:01:00.000000",
            "kill_flag": 1, "zone_id": 3}
    path.write_text(json.dumps(good) + "\n{broken\n\n")
    kills = tables.read_boss_kills(spark, str(path))
    (row,) = kills.collect()
    assert (row.boss_name, (row.end_ts - START).seconds, row.kill_flag) == ("B", 60, 1)
    tables.write_boss_kills(kills, str(tmp_path / "k"))
    tables.write_boss_kills(kills, str(tmp_path / "k"), mode="append")
    assert tables.read_boss_kills(spark, str(tmp_path / "k")).count() == 2
    assert tables.read_boss_kills(spark, str(tmp_path / "none")).count() == 0


def test_side_files(spark, tmp_path):
    path = tmp_path / "healers.json"
    path.write_text('{"Holy_Priest": [123, "Mend", "45"], "Discipline_Priest": []}')
    rows = {tuple(r) for r in sidecars.read_healer_spells(spark, str(path)).collect()}
    assert rows == {("Holy_Priest", 123, None), ("Holy_Priest", None, "Mend"), ("Holy_Priest", 45, None)}
    assert sidecars.read_healer_spells(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "bad.json").write_text("not json")
    assert sidecars.read_healer_spells(spark, str(tmp_path / "bad.json")).count() == 0

    hidden = spark.createDataFrame([(1,), (2,)], "combat_id bigint")
    flipped = sidecars.toggle_hidden(hidden, spark.createDataFrame([(2,), (3,)], "combat_id bigint"))
    sidecars.write_hidden(flipped, str(tmp_path / "hidden"))
    assert sorted(r[0] for r in sidecars.read_hidden(spark, str(tmp_path / "hidden")).collect()) == [1, 3]

    notes_path = tmp_path / "notes.jsonl"
    notes_path.write_text('{"combat_id": 1, "note": "a"}\n{"combat_id": 2, "note": "b"}\nxx\n{"combat_id": 1, "note": "c"}\n')
    notes = sidecars.read_notes(spark, str(notes_path))
    changes = spark.createDataFrame([(2, ""), (5, "new")], "combat_id bigint, note string")
    assert [tuple(r) for r in sidecars.upsert_note(notes, changes).collect()] == [(1, "c"), (5, "new")]


def test_import_writes_all_tables(spark, tmp_path):
    folder = tmp_path / "ann"
    folder.mkdir()
    first = [zone(0, 3, "Deep"), line(1, "ENCOUNTER_START", 9, '"Boss"', 16, 5, 3), spell_hit(2, ME, mob(1), 100)]
    second = [heal(3, ME, ME), died(4, mob(1)), line(5, "ENCOUNTER_END", 9, '"Boss"', 16, 5, 1), spell_hit(60, ME, ME)]
    (folder / "Log-010126_200000.txt").write_text("\n".join(first) + "\n")
    with gzip.open(folder / "Log-010126_210000.txt.gz", "wt") as f:
        f.write("\n".join(second) + "\n")
    out = str(tmp_path / "out")
    import_logs(spark, str(folder), out)
    events = imported(spark, out, "events")
    assert [(r.combat_id, r.zone_name, r.type) for r in events.orderBy("seq").collect()] == [
        (1, "Deep", "damage"), (1, "Deep", "heal"), (0, "", "damage"),
    ]
    kills = imported(spark, out, "boss_kills")
    enc = assign_runs(encounter_summary(events))
    healers = spark.createDataFrame([("Mistweaver", 8, None)], "spec string, spell_id bigint, spell_name string")
    run = runs(events, enc, kills, healers).first()
    assert (run.has_boss_kill, run.boss_names, run.run_role, run.run_class) == (True, "Boss", "Healer", "Monk")
    # a second import takes the place of the first
    import_logs(spark, str(folder / "Log-010126_200000.txt"), out, "ann")
    assert [(r.log_id, r.combat_id, r.type) for r in imported(spark, out, "events").collect()] == [("ann", 1, "damage")]
    assert imported(spark, out, "boss_kills").count() == 0


def test_one_healer_spell_marks_the_run(spark):
    ev = events_df(
        spark,
        [(1, 0, "SPELL_HEAL", "HealerOne-Server", "HealerOne-Server", "Test Heal", 100, 100, "heal", 1, "TestZone", 123456)],
    )
    spells = spark.createDataFrame([("Holy_Priest", 123456, None)], "spec string, spell_id bigint, spell_name string")
    row = run_roles(ev, assign_runs(encounter_summary(ev)), spells).first()
    assert (row.run_role, row.run_spec, row.run_class) == ("Healer", "Holy_Priest", "Priest")


def test_role_by_name_and_order_of_matches(spark):
    ev = events_df(
        spark,
        [
            (1, 5, "E", "A", "T", "MEND", 1, 1, "heal", 1, "Z", 0),
            (1, 3, "E", "A", "T", "Other", 1, 1, "heal", 1, "Z", 50),
            (2, 5000, "E", "A", "T", "mend", 1, 1, "heal", 1, "Z", 50),
            (3, 9000, "E", "A", "T", "none", 1, 1, "heal", 1, "Z", 1),
        ],
    )
    spells = spark.createDataFrame(
        [("Zeta", 50, None), ("Beta", 50, None), ("Alpha", None, "Mend")],
        "spec string, spell_id bigint, spell_name string",
    )
    roles = run_roles(ev, assign_runs(encounter_summary(ev)), spells).orderBy("run_id").collect()
    assert [(r.run_role, r.run_spec) for r in roles] == [("Healer", "Beta"), ("Healer", "Beta"), ("DPS", "")]


def test_kills_keep_their_order_over_many_files(spark, tmp_path):
    rows = [("main", i, f"B{i}", START, START, 1, 3) for i in range(40)]
    kills = spark.createDataFrame(rows, "log_id string, seq long, boss_name string, start_ts timestamp, end_ts timestamp, kill_flag int, zone_id int")
    tables.write_boss_kills(kills.repartition(7, "boss_name"), str(tmp_path / "kills"))
    back = tables.read_boss_kills(spark, str(tmp_path / "kills")).orderBy("seq").collect()
    assert [r.boss_name for r in back] == [f"B{i}" for i in range(40)]


def test_event_csv_keeps_file_order(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    n = 0
    for name, rows in (("a.csv", 5), ("b.csv", 400), ("c.csv", 50), ("d.csv", 900)):
        lines = [f"{n + i},bad,SPELL_DAMAGE,B,T,Bolt,5,5,damage" for i in range(rows)]
        n += rows
        head = "combat_id,timestamp,event,player,target,spell_name,amount,effective_amount,type"
        (folder / name).write_text("\n".join([head, *lines]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000b")
    try:
        got = tables.read_events(spark, str(folder)).orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.combat_id for r in got] == list(range(n))


def test_notes_and_hidden_ids_change_in_place(spark, tmp_path):
    path, errors = str(tmp_path / "side"), []
    table = "log_id string, combat_id bigint, note string"

    def write(n):
        try:
            for k in range(3):
                sidecars.change_notes(spark, path, spark.createDataFrame([("ann", 10 * n + k, f"w{n}")], table))
        except Exception as error:  # shown by the assertion below
            errors.append(error)

    writers = [threading.Thread(target=write, args=(n,)) for n in (1, 2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not errors
    # no note of either writer is lost
    assert sorted(tuple(r) for r in sidecars.stored_notes(spark, path).collect()) == [
        ("ann", 10 * n + k, f"w{n}") for n in (1, 2) for k in range(3)
    ]
    old = sidecars.stored_notes(spark, path)
    sidecars.change_notes(spark, path, spark.createDataFrame([("ann", 10, ""), ("ann", 11, "new"), ("bob", 11, "own")], table))
    assert len(old.collect()) == 6  # a reader keeps the version it began with
    got = {(r.log_id, r.combat_id): r.note for r in sidecars.stored_notes(spark, path).collect()}
    assert len(got) == 6 and got["ann", 11] == "new" and got["bob", 11] == "own" and ("ann", 10) not in got
    ids = spark.createDataFrame([("ann", 1), ("ann", 2)], "log_id string, combat_id bigint")
    sidecars.toggle_stored(spark, path, ids)
    sidecars.toggle_stored(spark, path, ids.limit(1).union(spark.createDataFrame([("bob", 2)], ids.schema)))
    assert sorted(tuple(r) for r in sidecars.stored_hidden(spark, path).collect()) == [("ann", 2), ("bob", 2)]
    assert len(sidecars.stored_notes(spark, path).collect()) == 6


def test_bucketed_events_need_no_shuffle_and_skip_days(spark, tmp_path):
    day = 24 * 3600
    rows = [(k % 7, d * day + k, "E", "A", f"T{k % 3}", "S", 5, 5, "damage", 1, "Z", 7) for d in range(6) for k in range(40)]
    ev = events_df(spark, rows + [(3, None, "E", "A", "T", "S", 5, 5, "damage", 1, "Z", 7)])
    spark.sql(f"CREATE DATABASE IF NOT EXISTS laid LOCATION '{tmp_path}/laid'")
    layout.save_events(ev, "laid.events", 4)
    saved = layout.saved_events(spark, "laid.events")
    assert sorted(map(tuple, saved.collect()), key=repr) == sorted(map(tuple, ev.collect()), key=repr)
    adaptive, small = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = encounter_stats(saved).join(combat_players(saved), ["log_id", "combat_id"], "left")
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        at = lambda d, s=0: START + timedelta(days=d, seconds=s)
        cut_ = layout.saved_events(spark, "laid.events", at(2, 10), at(3, 5))
        assert cut_.count() == 30 + 6
        cut_.collect()
        scan = cut_._jdf.queryExecution().executedPlan().collectLeaves().head()
        # two days of four buckets, of six such days and a row without a time
        assert scan.metrics().apply("numFiles").value() == 2 * 4 and len(saved.inputFiles()) == 6 * 4 + 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
        spark.sql("DROP DATABASE laid CASCADE")
