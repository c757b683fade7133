"""Metrics, sides and splits of slices, as column builders."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import as_count, ground

c = F.col


@dataclass(frozen=True)
class Metric:
    """num / den * scale; den None is a count.  innings: counted on whole innings, not on balls."""

    num: str
    den: str | None = None
    scale: float = 1.0
    higher_is_better: bool = True
    innings: Callable[[], Column] | None = None


METRICS = {
    "runs": Metric("R"), "wickets": Metric("W"), "sixes": Metric("S6"), "fours": Metric("F4"), "balls": Metric("B"), "dots": Metric("DOT"), "boundaries": Metric("BND"),
    "strike_rate": Metric("R", "B", 100), "run_rate": Metric("R", "B", 6), "economy": Metric("R", "B", 6, False), "average": Metric("R", "W"),
    "bowling_average": Metric("R", "W", 1, False), "bowling_strike_rate": Metric("B", "W", 1, False), "boundary_pct": Metric("BND", "B", 100), "dot_pct": Metric("DOT", "B", 100),
    "six_pct": Metric("S6", "B", 100), "balls_per_boundary": Metric("B", "BND", 1, False), "high_score": Metric("R"),
    "ducks": Metric("R", innings=lambda: (c("runs") == 0) & c("is_out")), "fifties": Metric("R", innings=lambda: c("runs").between(50, 99)), "hundreds": Metric("R", innings=lambda: c("runs") >= 100),
}

_ALL = {"runs", "wickets", "sixes", "fours", "balls", "dots", "boundaries", "boundary_pct", "dot_pct"}
_BAT = _ALL | {"strike_rate", "average", "six_pct", "high_score"}
SIDE_METRICS = {
    "batter": _BAT | {"balls_per_boundary", "ducks", "fifties", "hundreds"}, "batting_team": _BAT | {"run_rate"}, "league": _BAT | {"run_rate", "economy"},
    "bowler": _ALL | {"economy", "bowling_average", "bowling_strike_rate"}, "bowling_team": _ALL | {"economy", "bowling_average", "bowling_strike_rate", "run_rate"},
}
#: What a batting word means for a bowler.
BOWLER_WORDS = {"average": "bowling_average", "strike_rate": "bowling_strike_rate"}
SUBJECTS = tuple(SIDE_METRICS)
UNITS = ("career", "season", "match")


def metric_of(subject: str, name: str) -> str:
    """The metric's name for this subject; ValueError if it has none."""
    if subject in ("bowler", "bowling_team"):
        name = BOWLER_WORDS.get(name, name)
    if subject not in SIDE_METRICS or name not in SIDE_METRICS[subject]:
        raise ValueError(f"{name!r} is not a metric of {subject!r}; there are {', '.join(sorted(SIDE_METRICS.get(subject, ())))}")
    return name


def measures(subject: str) -> dict[str, Column]:
    """Per-ball measures of a side: runs, balls, wickets, dots, boundaries, fours, sixes."""
    legal, faced = c("is_legal"), ~c("is_wide")
    if subject == "batter":
        runs, balls, out = c("runs_bat"), faced, c("is_wicket")
        dot = faced & (c("runs_bat") == 0)
    elif subject == "bowler":
        runs, balls, out = c("bowler_runs"), legal, c("bowler_wicket")
        dot = legal & (c("bowler_runs") == 0)
    else:
        runs, balls, out = c("runs_total"), legal, c("is_wicket")
        dot = legal & (c("runs_total") == 0)
    return {"R": runs.cast("long"), "B": as_count(balls), "W": as_count(out), "DOT": as_count(dot), "BND": as_count(c("is_four") | c("is_six")), "F4": as_count(c("is_four")), "S6": as_count(c("is_six"))}


def sides(subject: str) -> tuple[Column, Column, Column, Column]:
    """Team, other team, key and name columns of a subject."""
    bat, bowl = c("batting_team"), c("bowling_team")
    team, other = (bowl, bat) if subject in ("bowler", "bowling_team") else (bat, bowl)
    key = {"batter": c("batter_id"), "bowler": c("bowler_id"), "league": F.lit("all")}.get(subject, team)
    name = {"batter": c("batter"), "bowler": c("bowler")}.get(subject, key)
    return team, other, key, name


def splits(subject: str) -> dict[str, Column]:
    """What a slice can be split by (won, toss_won: franchise of the match's and the toss's winner)."""
    team, other, _, _ = sides(subject)
    unknown = lambda x: F.coalesce(F.nullif(c(x), F.lit("")), F.lit("unknown"))
    return {
        "innings": F.when(c("inning") == 1, "batting first").otherwise("chasing"), "phase": c("phase"), "season": c("year").cast("string"), "venue": ground(c("venue")), "opposition": other,
        "result": F.when(c("won") == team, "won").when(c("won") == "", "no result").otherwise("lost"), "toss": F.when(c("toss_won") == team, "won toss").otherwise("lost toss"),
        "bowl_kind": unknown("bowl_kind"), "bat_hand": unknown("bat_hand"),
    }
