"""Encounter state machine over condensed activity rows.

The rows it takes are few: one per stretch of hostile hits between two deaths
within one timeout slot, and one per death. It keeps only the living enemies
of the open encounter and the names seen in it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

HITS, DEATH = "H", "D"
QUIET = "timeout"


@dataclass
class Fight:
    """State of one log or one independent part of it; times in microseconds."""

    alive: set = field(default_factory=set)
    seen: set = field(default_factory=set)
    open_seq: int | None = None
    start: int = 0
    last: int = 0

    def _close(self, end: int, reason: str) -> tuple:
        done = (self.open_seq, self.start, end, sorted(self.seen), reason)
        self.open_seq = None
        self.alive.clear()
        self.seen.clear()
        return done

    def expire(self, now: int, timeout_us: int) -> tuple | None:
        """Close at the last hostile time if it lies more than the timeout back."""
        if self.open_seq is not None and now - self.last > timeout_us:
            return self._close(self.last, QUIET)
        return None

    def hits(self, seq: int, first: int, last: int, guids) -> None:
        if self.open_seq is None:
            self.open_seq, self.start = seq, first
        self.alive.update(guids)
        self.seen.update(guids)
        self.last = last

    def death(self, ts: int, guid: str, is_player: bool) -> tuple | None:
        if guid in self.alive:
            self.alive.discard(guid)
            self.last = ts
            return None if self.alive else self._close(ts, "all_dead")
        if is_player and self.open_seq is not None:
            return self._close(ts, "player_death")
        return None

    def finish(self) -> tuple | None:
        """End of the rows: of the log, or of a part with a quiet gap after it."""
        return None if self.open_seq is None else self._close(self.last, QUIET)
