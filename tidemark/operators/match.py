"""Row pattern matching over ordered partitions, as SQL's MATCH_RECOGNIZE.

A pattern is a sequence of variables with quantifiers (+ * ? {n} {n,m}), greedy, over
contiguous rows. Definitions and measures are Python functions of the match so far, so
definitions may refer to their own variable's earlier rows. The matcher is plain Python;
Spark hands it one partition of rows after another, sorted.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


@dataclass
class Match:
    """Rows by variable, in order; ``row`` is the one under test while matching."""

    rows: list[tuple[str, dict]] = field(default_factory=list)
    row: dict | None = None
    #: Whether the search looked beyond the rows at hand, so that more rows might change it.
    starved: bool = False

    def of(self, *names: str) -> list[dict]:
        return [r for v, r in self.rows if not names or v in names]

    def first(self, name: str, column: str) -> Any:
        found = self.of(name)
        return found[0][column] if found else None

    def last(self, name: str, column: str, back: int = 0) -> Any:
        """Of the variable's rows the last one's column, or that ``back`` rows before it."""
        found = self.of(name)
        return found[-1 - back][column] if len(found) > back else None

    def mean(self, name: str, value: Callable[[dict], float]) -> float | None:
        found = [value(r) for r in self.of(name)]
        return sum(found) / len(found) if found else None


Test = Callable[[Match], bool]


def parse(pattern: str) -> list[tuple[str, int, float]]:
    """(variable, least, most) in order."""
    out = []
    for name, mark in re.findall(r"([A-Za-z_]\w*)\s*([+*?]|\{\s*\d*\s*,?\s*\d*\s*\})?", pattern):
        if mark.startswith("{"):
            low, comma, high = mark.strip("{} ").partition(",")
            least, most = int(low or 0), float(high) if high.strip() else float("inf") if comma else int(low)
        else:
            least, most = {"": (1, 1), "+": (1, float("inf")), "*": (0, float("inf")), "?": (0, 1)}[mark]
        out.append((name, least, most))
    return out


def match_at(rows: list[dict], start: int, steps: list[tuple[str, int, float]], define: dict[str, Test], within: tuple[str, timedelta] | None) -> Match:
    """The match that begins at a row, greedy with backtracking, without recursion; without rows if there is none.

    The trail holds one choice a row: which step took it, and how many rows of that step it made.
    """
    trail: list[tuple[int, int]] = []
    match = Match()

    def fits(step: int, at: int) -> bool:
        if at >= len(rows):
            match.starved = True
            return False
        if within and rows[at][within[0]] - rows[start][within[0]] > within[1]:
            return False
        name = steps[step][0]
        match.rows.append((name, rows[at]))
        match.row = rows[at]
        ok = bool(define.get(name, lambda m: True)(match))
        if not ok:
            match.rows.pop()
        return ok

    step = count = 0
    while True:
        if step < len(steps) and count < steps[step][2] and fits(step, start + len(trail)):
            count += 1
            trail.append((step, count))
            continue
        while True:  # leave this step if it has enough rows, or give rows back
            if step == len(steps):
                if trail:
                    match.row = None
                    return match
            elif count >= steps[step][1]:
                step, count = step + 1, 0
                break
            if not trail:
                match.rows = []
                return match
            step, count = trail.pop()
            match.rows.pop()
            count -= 1
            if count >= steps[step][1]:  # that step ends one row earlier
                step, count = step + 1, 0
                break


def matches(rows: list[dict], pattern: str, define: dict[str, Test], after: str = "PAST LAST ROW", within: tuple[str, timedelta] | None = None) -> Iterator[Match]:
    """Matches in the order of their first rows.

    after: "PAST LAST ROW", "TO NEXT ROW", "TO FIRST v" or "TO LAST v". A skip that would
    not move on goes to the next row.
    """
    steps, at = parse(pattern), 0
    while at < len(rows):
        found = match_at(rows, at, steps, define, within)
        if found.rows:
            yield found
        at = skip(at, found, after)


def skip(at: int, found: Match, after: str) -> int:
    """Where the search goes on after what began at a row."""
    words = after.upper().split()
    if not found.rows or words[:2] == ["TO", "NEXT"]:
        return at + 1
    if words[:2] == ["PAST", "LAST"]:
        return at + len(found.rows)
    places = [i for i, (v, _) in enumerate(found.rows) if v.upper() == words[-1]]
    to = at + (places[0] if words[1] == "FIRST" else places[-1]) if places else at
    return max(to, at + 1)


def settled(rows: list[dict], pattern: str, define: dict[str, Test], after: str, within: tuple[str, timedelta] | None, now: Any) -> tuple[list[Match], int]:
    """For a partition that goes on: the matches that later rows can't change, and how many rows are done with.

    Rows from the first undecided start on are kept. ``now`` is the time that later rows
    can't be before; with ``within`` it decides what would otherwise wait for ever.
    """
    steps, at, out = parse(pattern), 0, []
    while at < len(rows):
        found = match_at(rows, at, steps, define, within)
        if found.starved and not (within and now - rows[at][within[0]] > within[1]):
            break
        if found.rows:
            out.append(found)
        at = skip(at, found, after)
    return out, min(at, len(rows))


def match_recognize(
    df: DataFrame,
    *,
    partition_by: list[str],
    order_by: list[str],
    pattern: str,
    define: dict[str, Test],
    measures: dict[str, Callable[[Match], Any]],
    schema: str,
    after: str = "PAST LAST ROW",
    within: tuple[str, timedelta] | None = None,
) -> DataFrame:
    """ONE ROW PER MATCH: the partition columns and the measures; ``schema`` types both. Batch.

    Filters on partition columns belong before the call; they can't be pushed through it.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = part.sort_values(order_by, kind="stable").to_dict("records")
        out = [{**{k: rows[0][k] for k in partition_by}, **{k: f(m) for k, f in measures.items()}} for m in matches(rows, pattern, define, after, within)]
        return pd.DataFrame(out, columns=[*partition_by, *measures])

    return df.groupBy(*partition_by).applyInPandas(run, schema)
