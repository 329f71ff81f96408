"""Values fixed by the log format and by the dashboards that read the results."""

# Unit-flag bits of the log format.
FLAG_MINE = 0x0001
FLAG_PARTY = 0x0002
FLAG_RAID = 0x0004
FLAG_FRIENDLY = 0x0010
FLAG_PLAYER = 0x0400
FLAG_NPC = 0x0800
FLAG_ACTIVE_PLAYER = FLAG_MINE | FLAG_PLAYER

# Events that count as fighting, and events that report a death.
COMBAT_EVENTS = (
    "SWING_DAMAGE",
    "SWING_DAMAGE_LANDED",
    "SWING_MISSED",
    "RANGE_DAMAGE",
    "RANGE_MISSED",
    "SPELL_DAMAGE",
    "SPELL_PERIODIC_DAMAGE",
    "SPELL_MISSED",
    "SPELL_ABSORBED",
)
DEATH_EVENTS = ("UNIT_DIED", "PARTY_KILL")

# Healer specialisation to class.
SPEC_CLASS = {
    "Mistweaver": "Monk",
    "Restoration_Shaman": "Shaman",
    "Restoration_Druid": "Druid",
    "Holy_Paladin": "Paladin",
    "Preservation_Evoker": "Evoker",
    "Holy_Priest": "Priest",
    "Discipline_Priest": "Priest",
}

# Defaults of the analysis.
ENCOUNTER_TIMEOUT_S = 8.0
RUN_GAP_MINUTES = 20
KILL_GRACE_MINUTES = 10
KILL_TOLERANCE_S = 20
RECENT_COMBATS = 25
DEFAULT_ABILITIES = 7
MIN_SOURCE_COMBATS = 3
PALETTE_SLOTS = 6
UNKNOWN_ZONE = "UNKNOWN AREA"
HEALING_TYPES = ("heal", "absorb")
TIMESTAMP_FORMAT = "M/d/yyyy H:mm:ss.SSSSSS"
