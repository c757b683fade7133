"""A slice for every metric and every filter: its specification, and SQL that asks the same."""

from __future__ import annotations

from .oracles import _BATTER, _BOWLER, _COLS, _OUTS, _PLAIN, _STYLE, _TEAM, _slice, rd, sql

_BY = {"bowler": {"key": "bowler_id", "name": "bowler"}, "batting_team": {"key": "batting_team", "name": "batting_team"}}
_MATCHED = "(SELECT b.*, w1, w2, ww, rain FROM b JOIN g USING (match_id))"
_CHASE = "(SELECT st.*, f1, rain FROM st JOIN (SELECT match_id, sum(runs_total) AS f1 FROM b WHERE inning = 1 GROUP BY 1) USING (match_id) JOIN g USING (match_id))"
_FACED = "(SELECT *, sum(CASE WHEN is_wide THEN 0 ELSE 1 END) OVER (PARTITION BY match_id, inning, batter_id ORDER BY sequence ROWS UNBOUNDED PRECEDING) AS nth FROM b)"


def _ranked(value: str, where: str, down: bool, f: str) -> str:
    return sql(f"SELECT {_COLS}, value FROM (SELECT *, {value} AS value FROM r) WHERE {where} AND value IS NOT NULL ORDER BY value {'DESC' if down else 'ASC'}, k LIMIT 20", f)


def _batters(value: str, where: str = "TRUE", balls: str = "TRUE", frm: str = "b", down: bool = True) -> str:
    return _ranked(value, where, down, _slice(_BATTER, balls, frm=frm) + ", " + _OUTS)


def _bowlers(value: str, where: str = "TRUE", balls: str = "TRUE", down: bool = True) -> str:
    return _ranked(value, where, down, _slice(_BOWLER, balls, **_BY["bowler"]) + ", " + _PLAIN)


def _teams(balls: str, frm: str = "b") -> str:
    return _ranked("CAST(R AS DOUBLE)", "TRUE", True, _slice(_TEAM, balls, frm=frm, **_BY["batting_team"]) + ", " + _PLAIN)


def _split(label: str, frm: str = "b", more: str = "") -> str:
    """Run rates of all balls by a label."""
    return sql(f"SELECT {_COLS}, {rd('6e0 * R / nullif(B, 0)', 2)} AS value FROM r WHERE B > 0", more + _slice(_TEAM, key="'all'", name="'all'", s=label, frm=frm) + ", " + _PLAIN)


def innings_that(test: str) -> str:
    """Batters by how many of their innings pass a test on runs."""
    inns = "(SELECT f.match_id, f.inning, f.k, u, any_value(name) AS name, sum(R) AS runs FROM f GROUP BY f.match_id, f.inning, f.k, u)"
    return sql(f"SELECT k, u, any_value(name) AS name, count(*) FILTER ({test}) AS n, count(*) AS innings, CAST(sum(runs) AS BIGINT) AS runs FROM {inns} GROUP BY k, u HAVING count(*) FILTER ({test}) > 0 ORDER BY n DESC, innings, name, k, u LIMIT 20", _slice(_BATTER))


_TOSSED = "CASE WHEN match_id % 2 = 0 THEN w1 ELSE w2 END"
_STYLED = "(SELECT b.*, x.bat_hand, y.bowl_kind FROM b LEFT JOIN stl x ON x.player_id = batter_id LEFT JOIN stl y ON y.player_id = bowler_id)"
_REQUIRED = "(SELECT st.*, rain, CASE WHEN inning = 2 AND legal_before < 160 THEN 6e0 * (f1 + 1 - score_before) / (160 - legal_before) END AS need FROM st LEFT JOIN (SELECT match_id, sum(runs_total) AS f1 FROM b WHERE inning = 1 GROUP BY 1) USING (match_id) JOIN g USING (match_id))"
_LEAGUE = {"subject": "league", "metric": "run_rate"}
_RUNS = "CAST(R AS DOUBLE)"
_SPECS: dict[str, tuple[dict, str]] = {
    # -- metrics
    **{f"metric_{m}": ({"metric": m}, _batters(f"CAST({x} AS DOUBLE)")) for m, x in (("sixes", "S6"), ("fours", "F4"), ("dots", "DOT"), ("boundaries", "BND"), ("balls", "B"))},
    "metric_dot_pct": ({"subject": "bowler", "metric": "dot_pct", "least_balls": 30}, _bowlers(rd("100e0 * DOT / nullif(B, 0)", 2), "B >= 30")),
    "metric_six_pct": ({"metric": "six_pct", "least_balls": 30}, _batters(rd("100e0 * S6 / nullif(B, 0)", 2), "B >= 30")),
    "metric_balls_per_boundary": ({"metric": "balls_per_boundary", "least_balls": 30}, _batters(rd("1e0 * B / nullif(BND, 0)", 2), "B >= 30", down=False)),
    "metric_bowling_average": ({"subject": "bowler", "metric": "average", "least_balls": 0}, _bowlers(rd("1e0 * R / nullif(W, 0)", 2), "W >= 3", down=False)),
    "metric_bowling_strike_rate": ({"subject": "bowler", "metric": "strike_rate", "least_balls": 0}, _bowlers(rd("1e0 * B / nullif(W, 0)", 2), "W >= 3", down=False)),
    # -- filters
    "filter_years": ({"years": (2001, 2003)}, _batters(_RUNS, balls="year BETWEEN 2001 AND 2003")),
    "filter_stage_final": ({"stage": "final"}, _batters(_RUNS, balls="match_title = 'Final'")),
    "filter_stage_playoff": ({"stage": "playoff"}, _batters(_RUNS, balls="match_title IN ('Final', 'Qualifier 1', 'Eliminator')")),
    "filter_result_won": ({"subject": "batting_team", "result": "won"}, _teams("ww = batting_team", _MATCHED)),
    "filter_result_lost": ({"subject": "batting_team", "result": "lost"}, _teams("ww <> batting_team AND ww <> ''", _MATCHED)),
    "filter_toss_won": ({"subject": "batting_team", "toss": "won"}, _teams("batting_team = CASE WHEN match_id % 2 = 0 THEN w1 ELSE w2 END", _MATCHED)),
    "filter_toss_lost": ({"subject": "batting_team", "toss": "lost"}, _teams("batting_team <> CASE WHEN match_id % 2 = 0 THEN w1 ELSE w2 END", _MATCHED)),
    "filter_venue": ({"venue": "Eden Gardens"}, _batters(_RUNS, balls="ground = 'Eden Gardens'")),
    "filter_target": ({"target_min": 20, "target_max": 480}, _batters(_RUNS, balls="inning = 2 AND f1 + 1 BETWEEN 20 AND 480 AND NOT rain", frm=_CHASE)),
    "filter_batter_balls": ({"batter_balls": (1, 2)}, _batters(_RUNS, balls="nth BETWEEN 1 AND 2", frm=_FACED)),
    "filter_player_vs": ({"players": (7,), "vs": 3}, _batters(_RUNS, "k = 7", "bowler_id = 3")),
    "filter_team": ({"team": "DC"}, _batters(_RUNS, balls="batting_team = 'DC'")),
    # -- filters and splits that had no SQL
    "filter_bowl_kind": ({"bowl_kind": "spin"}, _ranked(_RUNS, "TRUE", True, _STYLE + ", " + _slice(_BATTER, "bowl_kind = 'spin'", frm=_STYLED) + ", " + _OUTS)),
    "filter_rrr_max": ({"rrr_max": 9.0}, _batters(_RUNS, balls="need < 9 AND NOT rain", frm=_REQUIRED)),
    "filter_worst": ({"metric": "strike_rate", "least_balls": 30, "worst": True}, _batters(rd("100e0 * R / nullif(B, 0)", 2), "B >= 30", down=False)),
    "split_innings": (_LEAGUE | {"split": "innings"}, _split("CASE inning WHEN 1 THEN 'batting first' ELSE 'chasing' END")),
    "split_phase": (_LEAGUE | {"split": "phase"}, _split("phase")),
    "split_season": (_LEAGUE | {"split": "season"}, _split("CAST(year AS VARCHAR)")),
    "split_opposition": (_LEAGUE | {"split": "opposition"}, _split("bowling_team")),
    "split_toss": (_LEAGUE | {"split": "toss"}, _split(f"CASE WHEN batting_team = {_TOSSED} THEN 'won toss' ELSE 'lost toss' END", "(SELECT b.*, w1, w2 FROM b JOIN g USING (match_id))")),
    "split_bat_hand": (_LEAGUE | {"split": "bat_hand"}, _split("coalesce(nullif(bat_hand, ''), 'unknown')", _STYLED, _STYLE + ", ")),
    "filter_opposition": ({"opposition": "MI"}, _batters(_RUNS, balls="bowling_team = 'MI'")),
}

SLICES = {f"slice_{name}": spec for name, (spec, _) in _SPECS.items()}
SLICE_SQL = {f"slice_{name}": text for name, (_, text) in _SPECS.items()}

#: Overs with what is required of the side that chases, and the state after its last over.
_OVERS = f"""
ao AS (SELECT match_id, inning, over_number, CAST(sum(runs_total) AS BIGINT) AS runs, count(*) FILTER (is_wicket) AS wickets, count(*) FILTER (is_legal) AS legal FROM b GROUP BY ALL),
aim AS (SELECT match_id, CAST(sum(runs) + 1 AS BIGINT) AS target FROM ao WHERE inning = 1 GROUP BY 1),
rq AS (SELECT x.match_id, x.inning, x.over_number, x.runs, x.wickets, CAST(sum(y.runs) AS BIGINT) AS total, CAST(sum(y.wickets) AS BIGINT) AS down, coalesce({rd("6e0 * sum(y.runs) / nullif(sum(y.legal), 0)", 2)}, 0e0) AS run_rate,
  CAST(greatest(160 - sum(y.legal), 0) AS BIGINT) AS balls_left, CASE WHEN x.inning = 2 AND any_value(target) > 0 THEN greatest(any_value(target) - CAST(sum(y.runs) AS BIGINT), 0) END AS required
  FROM ao x JOIN ao y ON y.match_id = x.match_id AND y.inning = x.inning AND y.over_number <= x.over_number LEFT JOIN aim ON aim.match_id = x.match_id GROUP BY x.match_id, x.inning, x.over_number, x.runs, x.wickets)"""
_RATE = rd("6e0 * required / nullif(CAST(balls_left AS DOUBLE), 0)", 2)
CHASE_SQL = {
    "over_requirements": sql(f"SELECT *, {_RATE} AS required_rate FROM rq", _OVERS.strip()),
    "chase_states": sql(f"SELECT match_id, inning, required, balls_left, {_RATE} AS required_rate FROM rq WHERE required <> 0 AND over_number = (SELECT max(over_number) FROM ao WHERE ao.match_id = rq.match_id AND ao.inning = rq.inning)", _OVERS.strip()),
}
