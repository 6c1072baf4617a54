"""The locator language: a URI that selects elements of a hierarchy, compiled to DataFrame predicates.

``[MSE://]comp(.comp)*`` with ``comp = ~* name [a][-][b]``, deepest level first.
A bare name selects every element, ``n`` one, ``n-`` from n on, ``-n`` up to n,
``a-b`` inclusively, and ``~`` complements (twice cancels).  An element's ordinal
counts inside the nearest ancestor level that the locator names, not inside its
parent; a subset name (``vcl``, ``idr``, ..) counts the subset's members inside
the access unit, and brings its superset level with it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.literals import parse_range
from .ordered import with_rank

# Level names of each scheme, shallow to deep, and subsets with the level that they narrow.
LEVELS = {"nal": ["vseq", "cvs", "au", "nu", "seimsg", "seipl"], "av1": ["vseq", "cvs", "tu", "fu", "obu"], "mpv": ["vseq", "gop", "au", "se", "mb"], "audio": ["au"]}
SUBSETS = {"nal": {"vcl": "nu", "seinu": "nu", "aud": "nu", "vps": "nu", "sps": "nu", "pps": "nu", "idr": "nu", "fil": "nu"}, "av1": {"frame": "obu"}, "mpv": {"slice": "se"}, "audio": {}}


class LocatorError(ValueError):
    pass


@dataclass(frozen=True)
class Selector:
    name: str
    level: str
    first: int | None  # None: the level is only implied
    last: int | None
    inverted: bool

    def accepts(self, ordinal: Column) -> Column:
        inside = ordinal >= self.first
        if self.last is not None:
            inside &= ordinal <= self.last
        return ~inside if self.inverted else inside


def compile_locator(uri: str, scheme: str) -> list[Selector]:
    """Selectors from shallow to deep."""
    head, mark, rest = uri.partition("://")
    if mark and head.lower() != "mse":
        raise LocatorError(f"scheme {head}")
    body = re.split(r"[/?#]", rest if mark else uri, maxsplit=1)[0]
    levels, subsets = LEVELS[scheme], SUBSETS[scheme]
    names = [*levels, *subsets]
    found: list[Selector] = []
    for part in filter(None, body.split(".")):
        bare = part.lstrip("~")
        low = bare.lower()
        name = max((n for n in names if low.startswith(n)), key=len, default=None)
        if name is None:
            raise LocatorError(f"no level is called {bare}")
        span = parse_range(bare[len(name) :])
        if span is None:
            raise LocatorError(f"no range: {bare}")
        found.append(Selector(name, subsets.get(name, name), span[0], span[1], (len(part) - len(bare)) % 2 == 1))
    depth = [levels.index(s.level) for s in found]
    if any(b >= a for a, b in zip(depth, depth[1:], strict=False)):
        raise LocatorError("from lower to higher" if len(set(depth)) == len(depth) else "one level twice")
    return found[::-1]


def locate(elements: DataFrame, uri: str, scheme: str, order: dict[str, tuple[str, ...]], subset_flags: dict[str, str] | None = None) -> DataFrame:
    """The elements at the locator's deepest level, with their canonical ``uri``.

    elements: one row per element of the deepest level in use.  order: for each
    level, the columns that name its elements and give their stream order (equal
    within an element).  subset_flags: for each subset in use, a BOOLEAN column.
    """
    selectors = compile_locator(uri, scheme)
    above: list[str] = []  # what the ordinals are relative to: selected levels only
    rows = elements
    for s in selectors:
        columns = [c for c in order[s.level] if c not in above]
        flag = F.col(subset_flags[s.name]) if s.name != s.level else F.lit(True)
        key = f"_{s.name}"
        inside = above
        if s.name != s.level:  # a subset counts inside its access unit
            unit = LEVELS[scheme][LEVELS[scheme].index(s.level) - 1]
            inside = [*above, *(c for c in order.get(unit, ()) if c not in above)]
            columns = [c for c in columns if c not in inside]
        members = rows.where(flag).select(*inside, *columns).distinct()
        if inside:
            members = members.withColumn(key, F.row_number().over(Window.partitionBy(*inside).orderBy(*columns)) - 1)
        else:
            members = with_rank(members, key, columns)
        members = members.where(s.accepts(F.col(key)))
        rows = rows.where(flag).join(members, [*inside, *columns])
        above = [*inside, *columns]
    shown = F.concat_ws(".", *(F.concat(F.lit(s.name), F.col(f"_{s.name}").cast("string")) for s in reversed(selectors)))
    return rows.withColumn("uri", shown).drop(*(f"_{s.name}" for s in selectors))
