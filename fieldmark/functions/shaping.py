"""Query results as JSON of bounded size.

A result is measured once from its leaves up and then written once from the root down, each part with
the characters that it may take. Members of an object share theirs by level: the small ones stay
whole and all others get as much as each other. An array keeps its first items, a string its first
characters, and either says what is missing.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

# Most characters of a reply, least characters of a shortened string, the words of a notice.
LIMIT = 100_000
SHORTEST = 100
MARK = "--- TRUNCATED"
ADVICE = "Narrow the query with LIMIT, WHERE or aggregation."

#: Room for the line break, indent, quotes and comma of a notice within an array or object.
_AROUND = 8


def _text(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, default=str)


def size(value: object) -> int:
    """Characters of the value as indented JSON."""
    return len(json.dumps(value, indent=2, ensure_ascii=False, default=str))


def _notice(kept: int, whole: int, what: str) -> str:
    return f"{MARK}: first {kept} of {whole} {what}. {ADVICE} ---"


@dataclass
class _Part:
    """A value with its size as indented JSON at its depth, and the least that it can be cut to."""

    value: object
    depth: int
    parts: list[_Part] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)
    size: int = 0
    least: int = 0

    def __post_init__(self) -> None:
        line = 2 * (self.depth + 1) + 2
        if isinstance(self.value, dict) and self.value:
            self.keys = [f"{_text(k if isinstance(k, str) else str(k))}: " for k in self.value]
            self.parts = [_Part(v, self.depth + 1) for v in self.value.values()]
            frame = 2 + line + sum(len(k) + line for k in self.keys)
            self.size, self.least = (frame + sum(x) for x in ([p.size for p in self.parts], [p.least for p in self.parts]))
        elif isinstance(self.value, list | tuple) and self.value:
            self.parts = [_Part(v, self.depth + 1) for v in self.value]
            self.size = 2 + line + sum(p.size + line for p in self.parts)
            n = len(self.parts)
            self.least = 2 + 3 * line + self.parts[0].least + len(_notice(n, n, "items")) + _AROUND if n > 1 else 2 + 2 * line + self.parts[0].least
        else:
            self.size = self.least = len(_text(self.value))
            if isinstance(self.value, str) and len(self.value) > SHORTEST:
                n = len(self.value)
                self.least = min(self.size, len(_text(self.value[:SHORTEST])) + len(_notice(n, n, "characters")))
        self.least = min(self.least, self.size)

    def written(self, room: int) -> object:
        """The value in at most ``room`` characters, or its least form where that is more."""
        if self.size <= room:
            return self.value
        if isinstance(self.value, str):
            return self._string(room)
        if self.keys:
            return self._object(room)
        return self._array(room) if self.parts else self.value

    def _string(self, room: int) -> str:
        n = len(self.value)
        # escapes make some characters longer: they are paid for in order
        left = room - len(_notice(n, n, "characters")) - 2
        kept = 0
        for c in self.value:
            left -= len(_text(c)) - 2
            if left < 0:
                break
            kept += 1
        kept = max(kept, min(SHORTEST, n))
        return self.value if kept >= n else self.value[:kept] + _notice(kept, n, "characters")

    def _object(self, room: int) -> dict:
        left = room - (self.size - sum(p.size for p in self.parts))
        # the level: parts in order of size take what they need while it is less than an equal share
        grants = [0] * len(self.parts)
        order = sorted(range(len(self.parts)), key=lambda k: self.parts[k].size)
        for done, k in enumerate(order):
            grants[k] = min(self.parts[k].size, max(left // (len(order) - done), self.parts[k].least))
            left -= grants[k]
        return {k: p.written(g) for k, p, g in zip(self.value, self.parts, grants, strict=True)}

    def _array(self, room: int) -> list:
        n, line = len(self.parts), 2 * (self.depth + 1) + 2
        left = room - 2 - 2 * line - len(_notice(n, n, "items")) - _AROUND
        out = []
        for p in self.parts:
            left -= p.size + line
            if left < 0:
                break
            out.append(p.value)
        if not out:
            out.append(self.parts[0].written(left + self.parts[0].size))
        return out if len(out) == n else [*out, _notice(len(out), n, "items")]


def bounded(value: object, limit: int = LIMIT) -> object:
    """``value``, made of JSON types, in at most ``limit`` characters of indented JSON. One that cannot
    be cut that far is replaced by a notice. The value itself is left as it is."""
    whole = _Part(value, 0)
    if whole.size <= limit or size(value) <= limit:
        return value
    cut = whole.written(limit)
    if size(cut) <= limit:
        return cut
    return f"{MARK}: the result has {size(value)} characters, over the {limit}-character limit, and no array or string to shorten. {ADVICE} ---"
