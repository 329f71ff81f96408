from samples import ME, MATE, heal, line, lines_df, mob, spell_hit, swing, units, zone

from skirmish.operators import parse as ps
from skirmish.operators.positions import extract_positions, position_units


def player_rows(spark, texts):
    rows = ps.parse_player_events(lines_df(spark, texts)).orderBy("seq").collect()
    return {r.seq: r for r in rows}


def test_damage_and_healing_rows(spark):
    texts = [
        spell_hit(0, ME, mob(1), 123),
        line(1, "SPELL_DAMAGE", *units(ME, mob(1)), 7, 55),  # ten fields: the last one
        swing(2, ME, mob(1), 40),
        line(3, "SWING_DAMAGE", *ME, 31),  # four fields
        heal(4, ME, MATE, 90, 20),
        heal(5, ME, MATE, 10, 20),
        spell_hit(6, MATE, mob(1)),  # not mine
        line(7, "SPELL_HEAL", *units(ME, ME)),  # too short
        line(8, "RANGE_DAMAGE", *units(ME, mob(1)), *range(20)),
        line(9, "SPELL_DAMAGE", *ME[:2], "zz", 0, *mob(1), 0, *range(20)),  # bad flags
        "no comma here",
        "3/4/2026,SPELL_HEAL",
        "3/4/2026 16:00:11  " + spell_hit(0, ME, mob(1)).split("  ", 1)[1],  # no fraction
        spell_hit(13, ME, mob(1), "nil", "x7"),
    ]
    r = player_rows(spark, texts)
    assert sorted(r) == [0, 1, 2, 3, 4, 5, 12, 13]
    assert (r[0].amount, r[0].spell_id, r[0].spell_name, r[0].target) == (123, 7, "Bolt", "Mob 1")
    assert (r[1].amount, r[1].spell_name) == (55, "55")
    assert (r[2].amount, r[2].spell_name, r[2].type, r[2].spell_id) == (40, "Melee", "damage", 0)
    assert (r[3].amount, r[3].target) == (31, "")
    assert (r[4].amount, r[4].effective_amount, r[4].type) == (90, 70, "heal")
    assert r[5].effective_amount == 0
    assert r[12].ts is None
    assert (r[13].amount, r[13].spell_id) == (0, 0)


def absorb(at, caster, width, by_spell):
    shield = [*caster, "0x0", "17", '"Shield, Holy"', "0x2", "66", "0", "nil"]
    middle = ["9", '"Bite"', "0x1"] if by_spell else []
    return line(at, "SPELL_ABSORBED", *(units(mob(1), ME) + middle + shield)[:width])


def test_absorb_layouts(spark):
    texts = [
        absorb(0, ME, 18, False),
        absorb(1, ME, 21, True),
        absorb(2, ME, 20, True),  # spell layout, too short
        absorb(3, MATE, 21, True),  # not mine
        line(4, "SPELL_ABSORBED", *units(mob(1), ME), "", *range(12)),  # no layout mark
    ]
    assert ps.unreadable_absorbs(lines_df(spark, texts)).first().dropped == 1
    r = player_rows(spark, texts)
    assert sorted(r) == [0, 1]
    for row in r.values():
        assert (row.source, row.spell_name, row.amount, row.type, row.target, row.spell_id) == (
            "Ann-Realm-EU", "Shield, Holy", 66, "absorb", "Ann-Realm-EU", 0,
        )


def test_quoted_fields(spark):
    texts = [spell_hit(0, ("Player-1", '"A, ""x"", B"', "0x511"), mob(1), name='"Bolt, Big"')]
    (row,) = player_rows(spark, texts).values()
    assert (row.source, row.spell_name, row.amount) == ("A, x, B", "Bolt, Big", 100)


def test_raw_events_need_eight_fields_and_a_time(spark):
    texts = [
        line(0, "UNIT_DIED", *units(("0", "nil", "none"), mob(3))),
        line(1, "EMOTE", 1, 2, 3),
        "x/4/2026 16:00:00.1  UNIT_DIED," + ",".join("12345678"),
        "3/4/2026 16:00:00.1+2  UNIT_DIED," + ",".join("12345678"),
    ]
    (row,) = ps.parse_raw_events(lines_df(spark, texts)).collect()
    assert (row.src_flags, row.dst_guid, row.dst_flags) == (0, "Creature-3", 0x10A48)


def test_zones_and_markers(spark):
    texts = [
        zone(0, 5, "The Deep, Lower"),
        line(1, "ZONE_CHANGE", "x", '"Odd"'),
        line(2, "ZONE_CHANGE", "6"),
        line(3, "ENCOUNTER_START", 1, '"Boss"', 16, 5, 77),
        line(4, "ENCOUNTER_END", 1, '"Boss"', 16, 5, 1, 999),
        line(5, "ENCOUNTER_START", 1),
    ]
    zones = ps.parse_zone_changes(lines_df(spark, texts)).orderBy("seq").collect()
    assert [(z.zone_id, z.zone_name) for z in zones] == [(5, "The Deep, Lower"), (0, "Odd")]
    marks = ps.parse_boss_markers(lines_df(spark, texts)).orderBy("seq").collect()
    assert [(m.marker, m.boss_name, m.zone_id, m.kill_flag) for m in marks] == [
        ("START", "Boss", 77, None), ("END", "Boss", None, 1), ("START", "Unknown", 0, None),
    ]


def test_summary_and_active_character(spark):
    texts = [absorb(0, ME, 18, False), spell_hit(2, ME, mob(1), 300), heal(4, ME, ME, 90, 30)]
    lines = lines_df(spark, texts)
    assert ps.active_character(lines).first().active_character == "Ann-Realm-EU"
    s = ps.log_summary(ps.parse_player_events(lines)).first()
    assert (s.total_damage, s.total_heal, s.duration_s, s.avg_dps) == (300, 126, 4.0, 75.0)
    one = ps.log_summary(ps.parse_player_events(lines_df(spark, texts[1:2]))).first()
    assert one.duration_s == 1.0


def test_positions(spark):
    tail = ["0", "0", "-120.5", "431.25", "3", "0", "0", "0", "0", "0"]
    texts = [
        spell_hit(0, ME, mob(1), 5, tail=tail),
        swing(1, MATE, mob(1)),
        spell_hit(2.345, MATE, mob(2), 5, tail=tail),
        spell_hit(9, ME, mob(1), 5, tail=tail),
    ]
    span = ("2026-03-04 16:00:00", "2026-03-04 16:00:05")
    rows = extract_positions(lines_df(spark, texts), *span).orderBy("seq").collect()
    assert [(r.guid, r.x, r.y) for r in rows] == [("Player-1", -120.5, 431.25), ("Player-2", -120.5, 431.25)]
    assert abs(rows[1].t - 2.345) < 0.0051
    units_ = {r.guid: (r.name, r.color_slot) for r in position_units(lines_df(spark, texts), *span).collect()}
    assert units_ == {
        "Player-1": ("Ann-Realm-EU", 0), "Player-2": ("Bob-Realm-EU", 1),
        "Creature-1": ("Mob 1", None), "Creature-2": ("Mob 2", None),
    }
