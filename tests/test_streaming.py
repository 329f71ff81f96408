"""Following growing logs: appended bytes, keyed state, commits, kills, idle close, late rows."""

import time

import pytest
from samples import ME, died, events_df, heal, line, lines_df, mob, spell_hit, swing, zone

from skirmish import schemas
from skirmish.plans.import_logs import boss_kills_of, encounters_of, import_followed, imported
from skirmish.sources import manifest, tail
from skirmish.streaming import live

FIRST = [zone(0, 3, "Deep"), spell_hit(1, ME, mob(1)), heal(2, ME, ME), line(2.5, "ENCOUNTER_START", 1, '"Boss"', 1, 1, 3)]
# The first fight goes on over the border; the second has no event of ours.
SECOND = [
    spell_hit(3, ME, mob(2)), died(4, mob(1)), died(5, mob(2)), line(5.5, "ENCOUNTER_END", 1, '"Boss"', 1, 1, 1),
    spell_hit(5.6, ME, mob(1)), swing(20, mob(3), ME), zone(31, 4, "Up"), swing(40, mob(4), ME), heal(40, ME, ME), heal(41, ME, ME),
]
THIRD = [heal(60, ME, ME), spell_hit(70, ME, mob(5)), died(71, ME), spell_hit(90, ME, mob(6))]


class Logs:
    def __init__(self, folder):
        self.source, self.out, self.checkpoint = str(folder / "logs"), str(folder / "out"), str(folder / "check")
        self.file = folder / "logs" / "ann" / "Log-010101_000000.txt"
        self.file.parent.mkdir(parents=True)

    def append(self, text):
        with self.file.open("a") as f:
            f.write(text)

    def follow(self, spark, **options):
        return live.follow_logs(spark, self.source, self.out, self.checkpoint, **options)


def text(lines):
    return "".join(x + "\n" for x in lines)


@pytest.fixture
def logs(tmp_path):
    return Logs(tmp_path)


def seen(spark, logs):
    enc = live.live_encounters(spark, logs.out).orderBy("combat_id").collect()
    events = live.live_events(spark, logs.out).orderBy("seq").collect()
    kills = live.live_kills(spark, logs.out).collect()
    return enc, events, kills


def test_appended_bytes_give_the_encounters_of_the_batch(spark, logs):
    logs.append(text(FIRST)[:-9])  # the last line is half written
    logs.follow(spark)
    assert seen(spark, logs) == ([], [], [])
    logs.append(text(FIRST)[-9:] + text(SECOND))
    logs.follow(spark)
    logs.append(text(THIRD))
    logs.follow(spark, max_bytes=200)
    live.close_at_stop(spark, logs.source, logs.out, logs.checkpoint)
    enc, events, kills = seen(spark, logs)
    whole = lines_df(spark, FIRST + SECOND + THIRD, "ann")
    want = [tuple(r) for r in encounters_of(whole).orderBy("open_seq").select("start_ts", "end_ts", "enemy_guids", "zone_name").collect()]
    assert len(want) == 5  # one encounter has no event of the log owner and takes no live id
    assert [r.combat_id for r in enc] == [1, 2, 3, 4]
    assert [(r.start_ts, r.end_ts, r.enemy_guids, r.zone_name) for r in enc] == [w for i, w in enumerate(want) if i != 1]
    # The heal at 41 comes after the last hostile moment of its fight.
    assert [(r.combat_id, r.type, r.zone_name) for r in events] == [
        (1, "damage", "Deep"), (1, "heal", "Deep"), (1, "damage", "Deep"),
        (2, "heal", "Up"), (3, "damage", "Up"), (4, "damage", "Up"),
    ]
    assert [(k.boss_name, k.start_ts, k.end_ts, k.kill_flag, k.zone_id) for k in kills] == [
        tuple(r) for r in boss_kills_of(whole).select("boss_name", "start_ts", "end_ts", "kill_flag", "zone_id").collect()
    ]
    recent, loaded = live.live_view(spark, logs.out)
    assert tuple(loaded.first()) == (4, 4) and [r.combat_id for r in recent.collect()] == [4, 3, 1]


def test_state_of_a_retried_batch_is_committed_once(spark, logs):
    logs.append(text(FIRST + SECOND))
    logs.follow(spark)
    before = seen(spark, logs)
    assert len(before[2]) == 1
    # a new checkpoint reads everything again; the same writer's batches are known by number
    state = manifest.state(spark, logs.out)
    writer = f"follow:{logs.checkpoint}"
    rows = spark.createDataFrame([], live._OUTPUT.replace("start_us bigint, end_us bigint", "start_ts timestamp, end_ts timestamp"))
    assert not live.flush(spark, rows, logs.source, {}, logs.out, writer, state.writers[writer])
    # a restart with nothing new, then with more: kills and encounters stay single
    logs.follow(spark)
    assert seen(spark, logs) == before
    logs.append(text([line(100, "ENCOUNTER_START", 1, '"Two"', 1, 1, 3), line(101, "ENCOUNTER_END", 1, '"Two"', 1, 1, 0)]))
    logs.follow(spark)
    assert [k.boss_name for k in sorted(seen(spark, logs)[2], key=lambda k: k.seq)] == ["Boss", "Two"]


def test_import_then_follow(spark, logs):
    logs.append(text(FIRST + SECOND[:5]) + "half of a l")
    begin = import_followed(spark, logs.source, logs.out)
    assert [r.combat_id for r in imported(spark, logs.out, "encounters").collect()] == [1]
    logs.append("ine\n" + text(SECOND[5:] + THIRD))
    logs.follow(spark, begin=begin)
    enc, events, kills = seen(spark, logs)
    assert [r.combat_id for r in enc] == [1, 2, 3]
    assert {r.combat_id for r in events if r.combat_id} == {1, 2, 3} and len(kills) == 1
    assert imported(spark, logs.out, "events").count() == len(events)
    # both parts are read by one reader; merging folders changes nothing
    assert manifest.merge_folders(spark, logs.out, "events", schemas.EVENTS, ["log_id", "seq"])
    assert seen(spark, logs)[1] == events


def test_idle_encounter_closes_by_the_clock(spark, logs):
    logs.append(text(FIRST))
    query = logs.follow(spark, once=False, idle_s=3.0, every="500 milliseconds")
    try:
        end = time.time() + 90
        while time.time() < end and not live.live_encounters(spark, logs.out).count():
            time.sleep(1)
        (enc,) = live.live_encounters(spark, logs.out).collect()
        assert enc.close_reason == "timeout" and enc.enemy_guids == ["Creature-1"]
        # a quiet gap in the log's own time closes the next one without any wait
        logs.append(text([spell_hit(100, ME, mob(7)), spell_hit(120, ME, mob(8))]))
        end = time.time() + 90
        while time.time() < end and live.live_encounters(spark, logs.out).count() < 2:
            time.sleep(1)
        assert live.live_encounters(spark, logs.out).where("combat_id = 2").first().enemy_guids == ["Creature-7"]
    finally:
        query.stop()


def test_state_holds_living_units_only(spark, logs):
    logs.append(text([spell_hit(k, ME, mob(k)) for k in range(1, 6)] + [died(6 + k, mob(k)) for k in range(1, 5)]))
    logs.follow(spark)
    state = spark.read.format("statestore").option("path", logs.checkpoint)
    rows = state.option("stateVarName", "enemies").load().select("user_map_key.guid", "user_map_value.alive").collect()
    assert {r.guid for r in rows if r.alive} == {"Creature-5"}
    logs.append(text([died(11, mob(5)), swing(30, mob(1), ME)]))  # the last closes it; a dead unit opens none
    logs.follow(spark)
    state = spark.read.format("statestore").option("path", logs.checkpoint)
    assert state.option("stateVarName", "enemies").load().count() == 0
    assert len(seen(spark, logs)[0]) == 1


def test_splits_and_steps_of_a_file_lose_no_line(spark, tmp_path):
    logs = Logs(tmp_path)
    rows = [f"line {k} " + "é" * (k % 50) for k in range(400)]
    logs.append("\r\n".join(rows) + "\r\nno end")
    (size,) = tail.log_files(logs.source).values()
    for split in (7, 64, 1 << 20):
        spans = [s for s in tail._spans(logs.source, "ann/Log-010101_000000.txt", 2, 0, size - 6, split)]
        got = [(q, v) for s in spans for b in tail._lines(s) for q, v in zip(b.column("seq").to_pylist(), b.column("value").to_pylist())]
        assert [v for _, v in got] == rows and [q for q, _ in got] == sorted({q for q, _ in got})
        assert all(q >> tail.OFFSET_BITS == 2 for q, _ in got)
    at, steps = {}, 0
    while (ahead := tail._advance(logs.source, at, 100)) != at:
        at, steps = ahead, steps + 1
    assert steps > 50 and at["ann/Log-010101_000000.txt"] == [0, size - 6]


def test_commits_of_two_writers(spark, tmp_path):
    out = str(tmp_path)
    seen = manifest.state(spark, out)
    assert manifest.try_commit(spark, out, seen, {"t": ["t/a"]})
    assert not manifest.try_commit(spark, out, seen, {"t": ["t/b"]})
    for k in range(manifest.BASE_EVERY + 5):
        assert manifest.commit(spark, out, {"t": [f"t/{k}"]}, writer="w", batch=k)
    assert not manifest.commit(spark, out, {"t": ["t/again"]}, writer="w", batch=3)
    now = manifest.state(spark, out)
    assert now.tables["t"] == ["t/a", *(f"t/{k}" for k in range(manifest.BASE_EVERY + 5))]
    manifest.commit(spark, out, {"t": ["t/new"]}, replace=["t"])
    assert manifest.state(spark, out).tables["t"] == ["t/new"]


def test_series_counts_late_rows(spark, tmp_path):
    def batch(n, times):
        rows = [(1, t, "E", "A", "T", "S", 10, 10, "damage" if t % 2 else "heal", 1, "Z", 7) for t in times]
        events_df(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
        stream = spark.readStream.schema(schemas.EVENTS).parquet(str(tmp_path / "ev"))
        live.follow_series(spark, stream, str(tmp_path / "out"), str(tmp_path / "check"), 5).awaitTermination()

    batch(1, range(0, 100, 3))
    batch(2, [1, 2, 84, 95, 120])  # 84 is in a bucket that ends ten seconds before 99: late, as 1 and 2
    batch(3, [3, 119])
    late, counts = live.late_rows(spark, str(tmp_path / "out"))
    assert sorted((r.batch, r.late) for r in counts.collect()) == [(0, 0), (1, 3), (2, 1)]
    assert late.count() == 4
    rows = live.series(spark, str(tmp_path / "out")).collect()
    assert sum(r.dps + r.hps for r in rows) == 10 * (len(range(0, 100, 3)) + 2 + 1)
    assert len({r.bucket_ts for r in rows}) == len(rows) and all(r.bucket_ts.second % 5 == 0 for r in rows)
