"""Boolean trigram queries from regular expressions: which trigrams of the folded text every match must hold.

A query is a disjunction of conjunctions, a frozenset of frozensets of trigrams. ALL, the disjunction with one empty conjunction,
says that nothing is mandatory. The analysis follows the exact strings that a part of the expression can match, up to LIMIT of
them; where there are more, or where a part repeats, it starts afresh and conjoins what it has found so far. Of an exact string the
trigrams that cover it are asked for, every third one and the last.

Expressions may hold literals, escapes, classes, groups of any kind, alternatives and repeats, greedy, lazy or possessive. Anything
else raises a ValueError.
"""

from __future__ import annotations

import re

LIMIT = 32
Query = frozenset[frozenset[str]]
ALL: Query = frozenset({frozenset()})


def trigrams(text: str) -> frozenset[str]:
    """Those that cover a string: no letter of it is in none, if it has three."""
    last = len(text) - 3
    return frozenset(text[i : i + 3] for i in {*range(0, last + 1, 3), last} if i >= 0)


def _both(a: Query, b: Query) -> Query:
    out = frozenset(x | y for x in a for y in b)
    return _least(out) if len(out) <= LIMIT * 2 else min(a, b, key=len)


def _least(q: Query) -> Query:
    """Without conjunctions that another one implies."""
    return frozenset(x for x in q if not any(y < x for y in q))


class _Part:
    """What a part of an expression can match: all its strings, if they are few, and a query that holds for every match."""

    def __init__(self, exact: set[str] | None, query: Query = ALL):
        self.exact, self.query = exact, query

    def closed(self) -> Query:
        if not self.exact:
            return self.query
        return _both(self.query, _least(frozenset(trigrams(s) for s in self.exact)))


def _sequence(parts: list[_Part]) -> _Part:
    run, query = _Part({""}), ALL
    for part in parts:
        if part.exact is not None and run.exact is not None and len(run.exact) * len(part.exact) <= LIMIT:
            run = _Part({x + y for x in run.exact for y in part.exact}, _both(run.query, part.query))
        else:
            query = _both(query, run.closed())
            run = part if part.exact is not None else _Part({""}, part.query)
    return run if query == ALL else _Part(None, _both(query, run.closed()))


def _any_of(parts: list[_Part]) -> _Part:
    if len(parts) == 1:
        return parts[0]
    if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= LIMIT:
        return _Part(set().union(*[p.exact for p in parts]))
    return _Part(None, _least(frozenset().union(*[p.closed() for p in parts])))


def _repeated(part: _Part, low: int, high: int | None) -> _Part:
    if low == high and low <= 8 and part.exact is not None and len(part.exact) ** low <= LIMIT:
        return _sequence([part] * low)
    if (low, high) == (0, 1) and part.exact is not None:
        return _Part(part.exact | {""})
    return _Part(None, part.closed() if low else ALL)


_GROUP = re.compile(r"\(\?(?:<?[=!]|[a-z]*:|>)|\((?!\?)")
_REPEAT = re.compile(r"(?:([*+?])|\{(\d+)(?:(,)(\d*))?\})[+?]?")
_RANGES = {"d": "0123456789", "w": None, "s": None, "D": None, "W": None, "S": None}


class _Expression:
    """Reads an expression from left to right; at is the place."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def starts(self, what: str) -> bool:
        return self.text.startswith(what, self.at)

    def alternatives(self) -> _Part:
        parts = [self.sequence()]
        while self.starts("|"):
            self.at += 1
            parts.append(self.sequence())
        return _any_of(parts)

    def sequence(self) -> _Part:
        parts = []
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            part = self.item()
            if found := _REPEAT.match(self.text, self.at):
                self.at = found.end()
                sign, low, comma, high = found.groups()
                bounds = {"*": (0, None), "+": (1, None), "?": (0, 1)}[sign] if sign else (int(low), int(high) if high else None if comma else int(low))
                part = _repeated(part, *bounds)
            parts.append(part)
        return _sequence(parts)

    def item(self) -> _Part:
        if self.starts("("):
            return self.group()
        if self.starts("["):
            found = self.one_of()
            return _Part(found if found and len(found) <= 8 else None)
        c = self.text[self.at]
        if c == "\\":
            if self.text[self.at + 1 : self.at + 2] in "bBAGzZ":
                self.at += 2
                return _Part({""})
            found = self.escaped()
            return _Part({found.lower()} if found else None)
        if c in "*+?{":
            raise ValueError(f"nothing to repeat at {self.at} in {self.text}")
        self.at += 1
        return _Part({""} if c in "^$" else None if c == "." else {c.lower()})

    def group(self) -> _Part:
        found = _GROUP.match(self.text, self.at)
        if not found:
            raise ValueError(f"unknown group at {self.at} in {self.text}")
        self.at = found.end()
        inner = self.alternatives()
        if not self.starts(")"):
            raise ValueError(f"open group in {self.text}")
        self.at += 1
        return _Part({""}) if found[0].endswith(("=", "!")) else inner

    def escaped(self) -> str | None:
        """The character of an escape, or None for a class."""
        c = self.text[self.at + 1 : self.at + 2]
        if c == "x":
            self.at += 4
            return chr(int(self.text[self.at - 2 : self.at], 16))
        self.at += 2
        if c in _RANGES:
            return None
        if not c or c.isalnum() and c not in "nrtf":
            raise ValueError(f"unknown escape at {self.at - 2} in {self.text}")
        return {"n": "\n", "r": "\r", "t": "\t", "f": "\f"}.get(c, c)

    def one_of(self) -> set[str] | None:
        """The folded characters of a class, or None if they are not few."""
        self.at += 1
        negated = self.starts("^")
        self.at += negated
        found: set[str] = set()
        few, first = not negated, True
        while first or not self.starts("]"):
            if self.at >= len(self.text):
                raise ValueError(f"open class in {self.text}")
            low, first = self.one(), False
            high = low
            if self.starts("-") and not self.text.startswith("-]", self.at):
                self.at += 1
                high = self.one()
            if low is None or high is None or ord(high) - ord(low) > 8:
                few = False
            else:
                found |= {chr(x).lower() for x in range(ord(low), ord(high) + 1)}
        self.at += 1
        return found if few else None

    def one(self) -> str | None:
        if self.starts("\\"):
            return self.escaped()
        self.at += 1
        return self.text[self.at - 1]


def query(pattern: str) -> Query:
    """Of the text in lower case. A conjunction with no trigram makes it ALL."""
    read = _Expression(pattern)
    found = read.alternatives()
    if read.at != len(pattern):
        raise ValueError(f"unopened group at {read.at} in {pattern}")
    q = found.closed()
    return ALL if frozenset() in q else q
