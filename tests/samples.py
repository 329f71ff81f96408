"""Hand-made log lines and events."""

from __future__ import annotations

from datetime import datetime, timedelta

from skirmish import schemas

ME = ("Player-1", '"Ann-Realm-EU"', "0x511")
MATE = ("Player-2", '"Bob-Realm-EU"', "0x512")
START = datetime(2026, 3, 4, 16, 0, 0)


def mob(n: int) -> tuple[str, str, str]:
    return (f"Creature-{n}", f'"Mob {n}"', "0x10a48")


def line(at: float, event: str, *fields) -> str:
    ts = START + timedelta(seconds=at)
    stamp = f"{ts.month}/{ts.day}/{ts.year} {ts:%H:%M:%S}.{ts.microsecond // 100:04d}"
    return f"{stamp}  {event}," + ",".join(str(f) for f in fields)


def units(src, dst) -> list:
    return [*src, "0x0", *dst, "0x0"]


def spell_hit(at, src, dst, amount=100, spell_id=7, name='"Bolt"', tail=None):
    rest = tail if tail is not None else ["0"] * 10
    return line(at, "SPELL_DAMAGE", *units(src, dst), spell_id, name, "0x1", amount, *rest)


def swing(at, src, dst, amount=50):
    return line(at, "SWING_DAMAGE", *units(src, dst), amount, *["0"] * 7)


def heal(at, src, dst, amount=90, over=20, spell_id="8"):
    return line(at, "SPELL_HEAL", *units(src, dst), spell_id, '"Mend"', "0x2", amount, amount, over, 0, "nil")


def died(at, dst):
    nobody = ("0000", "nil", "0x80000000")
    return line(at, "UNIT_DIED", *units(nobody, dst))


def zone(at, zone_id, name):
    return line(at, "ZONE_CHANGE", zone_id, f'"{name}"', 0)


def lines_df(spark, texts, log_id="main"):
    rows = [(log_id, i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schemas.RAW_LINES)


def events_df(spark, rows):
    """rows of (combat_id, seconds, event, source, target, spell, amount, effective, type, zone_id, zone, spell_id)."""
    full = [
        ("main", i, r[0], None if r[1] is None else START + timedelta(seconds=r[1]), *r[2:])
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, schemas.EVENTS)
