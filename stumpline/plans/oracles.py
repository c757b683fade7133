"""SQL of the catalog's queries for an independent engine (DuckDB dialect): the same questions, put another way."""

from __future__ import annotations


def rd(x: str, digits: int) -> str:
    scale = f"1{'0' * digits}e0"
    return f"(round(({x}) * {scale}, 0) / {scale})"


def rt(num: str, den: str, scale: float = 1, digits: int = 2) -> str:
    return rd(f"{float(scale)!r}::DOUBLE * ({num}) / nullif(CAST({den} AS DOUBLE), 0)", digits)


_TEAMS = "['KXIP','DD','MI','CSK','RCB','KKR','RR','SRH']"
_VENUES = "['Feroz Shah Kotla, Delhi','Eden Gardens, Kolkata','Wankhede Stadium, Mumbai','Sardar Patel Stadium, Ahmedabad','Sheikh Zayed Stadium, Abu Dhabi']"
_GROUNDS = "['Arun Jaitley Stadium','Eden Gardens','Wankhede Stadium','Narendra Modi Stadium','Zayed Cricket Stadium']"
_NOW = "['PBKS','DC','MI','CSK','RCB','KKR','RR','SRH']"
_TITLE = "CASE day % 15 WHEN 14 THEN 'Final' WHEN 13 THEN 'Qualifier 1' WHEN 12 THEN 'Eliminator' ELSE 'Match ' || (day % 15) END"

#: ev, b (balls with all derived columns), g (matches; w1, w2, ww: present codes of teams and winner).
BASE = f"""
ev AS (SELECT *, date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) AS day FROM events),
b0 AS (
  SELECT day AS match_id, CAST(ts AS DATE) AS start_date, 2000 + week(ts) AS year, hour(ts) // 12 + 1 AS inning, event_id AS sequence, hour(ts) % 12 + 1 AS over_number,
         user_id AS batter_id, 'Batter ' || user_id AS batter, event_id % 20 AS bowler_id, 'Bowler ' || (event_id % 20) AS bowler,
         CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value) AS BIGINT) % 5 + user_id % 3 END AS runs_bat,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS wide_runs, CASE WHEN event_type = 'signup' AND event_id % 4 = 0 THEN 1 ELSE 0 END AS noball_runs,
         CASE WHEN event_type <> 'error' AND event_id % 17 = 0 THEN 1 ELSE 0 END AS bye_runs, CASE WHEN event_type <> 'error' AND event_id % 19 = 0 THEN 1 ELSE 0 END AS legbye_runs,
         event_type = 'error' AS is_wide, event_type = 'signup' AND event_id % 4 = 0 AS is_noball, event_type = 'purchase' AS is_wicket,
         CASE WHEN event_type = 'purchase' THEN list_extract(['run out','bowled','caught','lbw'], CAST(event_id % 4 + 1 AS BIGINT)) END AS dismissal_type,
         CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 5 = 0 THEN user_id + 1 ELSE user_id END END AS player_out_id, props AS commentary, day
  FROM ev),
b AS (
  SELECT *, NOT is_wide AND NOT is_noball AS is_legal, wide_runs + noball_runs + bye_runs + legbye_runs AS extras, runs_bat + wide_runs + noball_runs + bye_runs + legbye_runs AS runs_total,
         runs_bat + wide_runs + noball_runs AS bowler_runs, runs_bat = 4 AS is_four, runs_bat = 6 AS is_six, is_wicket AND dismissal_type <> 'run out' AS bowler_wicket, 'Batter ' || player_out_id AS player_out,
         CASE WHEN over_number <= 4 THEN 'powerplay' WHEN over_number <= 9 THEN 'middle' ELSE 'death' END AS phase,
         list_extract({_NOW}, CAST((CASE inning WHEN 1 THEN day ELSE day + 1 + day % 7 END) % 8 + 1 AS BIGINT)) AS batting_team,
         list_extract({_NOW}, CAST((CASE inning WHEN 1 THEN day + 1 + day % 7 ELSE day END) % 8 + 1 AS BIGINT)) AS bowling_team,
         list_extract({_GROUNDS}, CAST(day % 5 + 1 AS BIGINT)) AS ground, {_TITLE} AS match_title
  FROM b0),
g0 AS (
  SELECT day AS match_id, day, min(CAST(ts AS DATE)) AS start_date, 2000 + min(week(ts)) AS year, list_extract({_TEAMS}, CAST(day % 8 + 1 AS BIGINT)) AS team1, list_extract({_TEAMS}, CAST((day + 1 + day % 7) % 8 + 1 AS BIGINT)) AS team2,
         list_extract({_NOW}, CAST(day % 8 + 1 AS BIGINT)) AS w1, list_extract({_NOW}, CAST((day + 1 + day % 7) % 8 + 1 AS BIGINT)) AS w2,
         list_extract({_GROUNDS}, CAST(day % 5 + 1 AS BIGINT)) AS ground, list_extract({_VENUES}, CAST(day % 5 + 1 AS BIGINT)) AS venue, {_TITLE} AS title
  FROM ev GROUP BY day),
g AS (
  SELECT *, CASE WHEN day % 10 = 0 THEN '' WHEN day % 3 = 0 THEN team2 ELSE team1 END AS winner, CASE WHEN day % 10 = 0 THEN '' WHEN day % 3 = 0 THEN w2 ELSE w1 END AS ww, day % 9 = 0 AS rain, day % 13 = 1 AND day % 10 <> 0 AS is_tied,
         CASE WHEN day % 10 = 0 THEN 'No result' WHEN day % 13 = 1 THEN 'Match tied' WHEN day % 3 = 0 THEN team2 || ' won by ' || (day % 9 + 1) || ' wickets' ELSE team1 || ' won by ' || (day % 40 + 1) || ' runs' END
           || CASE WHEN day % 9 = 0 THEN ' (D/L method)' ELSE '' END AS status_text,
         CASE WHEN day % 2 = 0 THEN w1 ELSE w2 END AS tw, CASE WHEN day % 3 = 0 THEN 'bat' ELSE 'field' END AS td
  FROM g0),
inn AS (
  SELECT match_id, inning, any_value(year) AS year, any_value(batting_team) AS team, any_value(bowling_team) AS opposition, CAST(sum(runs_total) AS BIGINT) AS runs, count(*) FILTER (is_wicket) AS wickets, count(*) FILTER (is_legal) AS balls, any_value(ground) AS ground, any_value(match_title) AS match_title
  FROM b GROUP BY match_id, inning),
bi AS (
  SELECT match_id, inning, player_id, any_value(year) AS year, 'Batter ' || player_id AS player, any_value(team) AS team, CAST(sum(r) AS BIGINT) AS runs, CAST(sum(f) AS BIGINT) AS balls, CAST(sum(r4) AS BIGINT) AS fours, CAST(sum(r6) AS BIGINT) AS sixes, bool_or(o) AS is_out
  FROM (SELECT match_id, inning, batter_id AS player_id, year, batting_team AS team, runs_bat AS r, CASE WHEN is_wide THEN 0 ELSE 1 END AS f, CASE WHEN is_four THEN 1 ELSE 0 END AS r4, CASE WHEN is_six THEN 1 ELSE 0 END AS r6, FALSE AS o FROM b
        UNION ALL SELECT match_id, inning, player_out_id, year, batting_team, 0, 0, 0, 0, TRUE FROM b WHERE is_wicket)
  GROUP BY match_id, inning, player_id),
wi AS (
  SELECT match_id, inning, bowler_id AS player_id, any_value(year) AS year, any_value(bowler) AS player, any_value(bowling_team) AS team, count(*) FILTER (is_legal) AS balls, CAST(sum(bowler_runs) AS BIGINT) AS conceded, count(*) FILTER (bowler_wicket) AS wickets
  FROM b GROUP BY match_id, inning, bowler_id),
st AS (
  SELECT b.*, coalesce(sum(runs_total) OVER p, 0) AS score_before, coalesce(sum(CASE WHEN is_wicket THEN 1 ELSE 0 END) OVER p, 0) AS wkts_before, coalesce(sum(CASE WHEN is_legal THEN 1 ELSE 0 END) OVER p, 0) AS legal_before,
         sum(CASE WHEN is_wide THEN 0 ELSE 1 END) OVER (PARTITION BY match_id, inning, batter_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bat_ball_no
  FROM b WINDOW p AS (PARTITION BY match_id, inning ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""


def sql(body: str, more: str = "") -> str:
    """body over the base tables; more: further common tables."""
    return f"WITH {BASE}{', ' + more if more else ''} {body}"


_BAT = f"""CAST(sum(runs) AS BIGINT) AS runs, count(*) AS inns, count(*) FILTER (is_out) AS outs, {rt('sum(runs)', 'count(*) FILTER (is_out)')} AS avg, {rt('sum(runs)', 'sum(balls)', 100)} AS sr,
 count(*) FILTER (runs BETWEEN 50 AND 99) AS fifties, count(*) FILTER (runs >= 100) AS hundreds, CAST(sum(fours) AS BIGINT) AS fours, CAST(sum(sixes) AS BIGINT) AS sixes, max(runs) AS hs"""
_BOWL = f"""CAST(sum(wickets) AS BIGINT) AS wkts, (CAST(sum(balls) AS BIGINT) // 6) || '.' || (CAST(sum(balls) AS BIGINT) % 6) AS overs, CAST(sum(conceded) AS BIGINT) AS runs, {rt('sum(conceded)', 'sum(balls)', 6)} AS econ,
 {rt('sum(conceded)', 'sum(wickets)')} AS avg, {rt('sum(balls)', 'sum(wickets)', 1, 1)} AS sr, count(*) FILTER (wickets >= 4) AS four_wkts, arg_max(wickets || '/' || conceded, wickets * 100000 - conceded) AS best"""
_FACED = "count(*) FILTER (NOT is_wide)"
_LEGAL = "count(*) FILTER (is_legal)"
_WHEN = "PARTITION BY player_id ORDER BY match_id, inning ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_NO_RAIN = "NOT rain"
_SIDES = "sd AS (SELECT g.*, w1 AS team, w2 AS opponent FROM g UNION ALL SELECT g.*, w2, w1 FROM g)"
_HOME = """hn AS (SELECT year, team, ground, count(*) AS n FROM sd GROUP BY ALL), hg AS (
  SELECT year, team, ground FROM (SELECT *, sum(n) OVER (PARTITION BY year, team) AS t, row_number() OVER (PARTITION BY year, team ORDER BY n DESC, ground) AS k FROM hn) WHERE k = 1 AND n >= 1 AND n >= 0.25 * t)"""
_TOT = """tot AS (SELECT match_id, CAST(sum(runs_total) FILTER (inning = 1) AS BIGINT) AS first, max(batting_team) FILTER (inning = 1) AS bat_first, max(batting_team) FILTER (inning = 2) AS chaser,
  CAST(coalesce(sum(runs_total) FILTER (inning = 2 AND over_number < 8), 0) AS BIGINT) AS early FROM b GROUP BY match_id)"""
_GAMES = """gm AS (SELECT a.match_id, g.year, g.ground, a.runs AS first, a.balls AS b1, a.team AS bat_first, z.runs AS second, z.balls AS b2, z.team AS chaser, g.ww FROM inn a JOIN g USING (match_id) LEFT JOIN inn z ON z.match_id = a.match_id AND z.inning = 2 WHERE a.inning = 1)"""
_HERE = "hs AS (SELECT b.*, ground = 'Eden Gardens' AS here FROM b WHERE year IN (SELECT year FROM b WHERE ground = 'Eden Gardens'))"
_STYLE = "stl AS (SELECT player_id, CASE WHEN player_id % 3 = 0 THEN 'left' ELSE 'right' END AS bat_hand, CASE WHEN player_id % 7 = 0 THEN '' WHEN player_id % 2 = 0 THEN 'spin' ELSE 'pace' END AS bowl_kind FROM (SELECT user_id AS player_id FROM events UNION SELECT event_id % 20 FROM events))"
_KNOWN = "count(*) FILTER (w.bowl_kind <> '')"
_OV = """ov AS (SELECT match_id, inning, over_number, CAST(sum(runs_total) AS BIGINT) AS runs, count(*) FILTER (is_wicket) AS wickets, count(*) FILTER (is_legal) AS balls, count(*) FILTER (is_four OR is_six) AS boundaries FROM b GROUP BY ALL),
rate AS (SELECT match_id, inning, sum(runs_total)::DOUBLE / greatest(count(*) FILTER (is_legal), 1) AS rate FROM b GROUP BY match_id, inning HAVING count(*) >= 12),
bl AS (SELECT st.*, row_number() OVER (PARTITION BY match_id, inning ORDER BY sequence) AS ball, legal_before + CASE WHEN is_legal THEN 1 ELSE 0 END AS l, score_before + runs_total AS t, wkts_before + CASE WHEN is_wicket THEN 1 ELSE 0 END AS w, rate FROM st JOIN rate USING (match_id, inning)),
ob AS (SELECT match_id, inning, over_number, min(ball) AS fb, max(ball) AS lb, any_value(batting_team) AS bat, any_value(bowling_team) AS bowl FROM bl GROUP BY ALL)"""


def _rollup(figures: str, source: str) -> str:
    return f"SELECT CAST(year AS VARCHAR) AS year, {figures} FROM {source} GROUP BY year UNION ALL SELECT 'Total', {figures} FROM {source} HAVING count(*) > 0"


def _milestone(measure: str, value: int, table: str) -> str:
    return f"""SELECT player_id, any_value(player) AS player, min(k) AS innings, min(start_date) AS reached_on
    FROM (SELECT x.*, g.start_date, row_number() OVER (PARTITION BY player_id ORDER BY x.match_id, inning) AS k, sum({measure}) OVER ({_WHEN.replace('match_id', 'x.match_id')}) AS c FROM {table} x JOIN g USING (match_id))
    WHERE c >= {value} GROUP BY player_id ORDER BY innings, reached_on, player_id LIMIT 20"""


def _slice(measures: str, where: str = "TRUE", frm: str = "b", key: str = "batter_id", name: str = "batter", s: str = "''", u: str = "''") -> str:
    return f"f AS (SELECT {key} AS k, {name} AS name, {s} AS s, {u} AS u, match_id, inning, year, is_wicket, player_out_id, batting_team, {measures} FROM {frm} WHERE {where})"


_BATTER = "runs_bat AS R, CASE WHEN is_wide THEN 0 ELSE 1 END AS B, CASE WHEN is_wicket THEN 1 ELSE 0 END AS W, CASE WHEN NOT is_wide AND runs_bat = 0 THEN 1 ELSE 0 END AS DOT, CASE WHEN is_four OR is_six THEN 1 ELSE 0 END AS BND, CASE WHEN is_four THEN 1 ELSE 0 END AS F4, CASE WHEN is_six THEN 1 ELSE 0 END AS S6"
_BOWLER = "bowler_runs AS R, CASE WHEN is_legal THEN 1 ELSE 0 END AS B, CASE WHEN bowler_wicket THEN 1 ELSE 0 END AS W, CASE WHEN is_legal AND bowler_runs = 0 THEN 1 ELSE 0 END AS DOT, CASE WHEN is_four OR is_six THEN 1 ELSE 0 END AS BND, CASE WHEN is_four THEN 1 ELSE 0 END AS F4, CASE WHEN is_six THEN 1 ELSE 0 END AS S6"
_TEAM = "runs_total AS R, CASE WHEN is_legal THEN 1 ELSE 0 END AS B, CASE WHEN is_wicket THEN 1 ELSE 0 END AS W, CASE WHEN is_legal AND runs_total = 0 THEN 1 ELSE 0 END AS DOT, CASE WHEN is_four OR is_six THEN 1 ELSE 0 END AS BND, CASE WHEN is_four THEN 1 ELSE 0 END AS F4, CASE WHEN is_six THEN 1 ELSE 0 END AS S6"
_ROWS = "CAST(sum(R) AS BIGINT) AS R, CAST(sum(B) AS BIGINT) AS B, CAST(sum(W) AS BIGINT) AS W, CAST(sum(DOT) AS BIGINT) AS DOT, CAST(sum(BND) AS BIGINT) AS BND, CAST(sum(F4) AS BIGINT) AS F4, CAST(sum(S6) AS BIGINT) AS S6, count(DISTINCT (match_id, inning)) AS inns"
_OUTS = "r0 AS (SELECT k, s, u, any_value(name) AS name, " + _ROWS + " FROM f GROUP BY k, s, u), o AS (SELECT player_out_id AS k, s, u, count(*) AS n FROM f WHERE is_wicket GROUP BY 1, 2, 3), r AS (SELECT r0.* REPLACE (coalesce(o.n, 0) AS W) FROM r0 LEFT JOIN o USING (k, s, u))"
_PLAIN = "r AS (SELECT k, s, u, any_value(name) AS name, " + _ROWS + " FROM f GROUP BY k, s, u)"
_COLS = "k, s, u, name, R, B, W, DOT, BND, F4, S6, inns"


ORACLES: dict[str, str] = {
    # -- views and leaderboards
    "leader_runs": sql(f"SELECT player_id, any_value(player) AS player, {_BAT}, CAST(sum(balls) AS BIGINT) AS balls FROM bi GROUP BY player_id ORDER BY runs DESC, sr DESC NULLS LAST, player_id LIMIT 20"),
    "leader_rate_floor": sql(f"SELECT player_id, any_value(player) AS player, {_BAT}, CAST(sum(balls) AS BIGINT) AS balls FROM bi GROUP BY player_id HAVING sum(balls) >= 30 ORDER BY sr DESC NULLS LAST, runs DESC, player_id LIMIT 20"),
    "leader_sixes_team": sql(f"SELECT player_id, any_value(player) AS player, {_BAT}, CAST(sum(balls) AS BIGINT) AS balls FROM bi WHERE team = 'DC' GROUP BY player_id ORDER BY sixes DESC, runs DESC, player_id LIMIT 20"),
    "best_figures": sql(f"SELECT player_id, any_value(player) AS player, count(*) AS inns, {_BOWL}, CAST(sum(balls) AS BIGINT) AS balls FROM wi GROUP BY player_id ORDER BY wkts DESC, econ, player_id LIMIT 20"),
    "leader_economy": sql(f"SELECT player_id, any_value(player) AS player, count(*) AS inns, {_BOWL}, CAST(sum(balls) AS BIGINT) AS balls FROM wi GROUP BY player_id HAVING sum(balls) >= 10 ORDER BY econ, wkts DESC, player_id LIMIT 20"),
    "full_outer_innings": sql("SELECT match_id, inning, player_id, year, player, team, runs, balls, fours, sixes, is_out FROM bi"),
    "bowling_innings": sql("SELECT match_id, inning, player_id, year, player, team, balls, conceded, wickets FROM wi"),
    "rollup_year": sql(_rollup(_BAT, "(SELECT * FROM bi WHERE player_id = 7)")),
    "rollup_year_bowling": sql(_rollup("count(*) AS inns, " + _BOWL, "(SELECT * FROM wi WHERE player_id = 3)")),
    "player_phases": sql(f"SELECT phase, CAST(sum(runs_bat) AS BIGINT) AS runs, {_FACED} AS balls, {rt('sum(runs_bat)', _FACED, 100)} AS sr, {rt('count(*) FILTER (NOT is_wide AND runs_bat = 0)', _FACED, 100, 1)} AS dot_pct, count(*) FILTER (is_four OR is_six) AS boundaries, (SELECT count(*) FROM b o WHERE o.player_out_id = 7 AND o.phase = b.phase) AS outs FROM b WHERE batter_id = 7 GROUP BY phase"),
    "bowler_phases": sql(f"SELECT phase, {_LEGAL} AS balls, CAST(sum(bowler_runs) AS BIGINT) AS runs, {rt('sum(bowler_runs)', _LEGAL, 6)} AS econ, {rt('count(*) FILTER (is_legal AND runs_total = 0)', _LEGAL, 100, 1)} AS dot_pct, count(*) FILTER (bowler_wicket) AS wkts FROM b WHERE bowler_id = 3 GROUP BY phase"),
    "matchup": sql(_rollup(f"{_FACED} AS balls, CAST(sum(runs_bat) AS BIGINT) AS runs, count(*) FILTER (bowler_wicket AND player_out_id = 7) AS outs, {rt('sum(runs_bat)', _FACED, 100)} AS sr, {rt('count(*) FILTER (NOT is_wide AND runs_bat = 0)', _FACED, 100, 1)} AS dot_pct, count(*) FILTER (is_four) AS fours, count(*) FILTER (is_six) AS sixes", "(SELECT * FROM b WHERE batter_id = 7 AND bowler_id = 3)")),
    "season_summary": sql(f"SELECT year, l.matches, i.with_balls, i.run_rate, i.avg_1st_inns, i.highest, coalesce(s.sixes, 0) AS sixes FROM (SELECT year, count(*) AS matches FROM g GROUP BY 1) l LEFT JOIN (SELECT year, count(DISTINCT match_id) AS with_balls, {rt('sum(runs)', 'sum(balls)', 6)} AS run_rate, {rt('sum(runs) FILTER (inning = 1)', 'count(*) FILTER (inning = 1)', 1, 1)} AS avg_1st_inns, max(runs) AS highest FROM inn GROUP BY 1) i USING (year) LEFT JOIN (SELECT year, count(*) AS sixes FROM b WHERE is_six GROUP BY 1) s USING (year)"),
    "phase_leaders": sql(f"SELECT batter_id AS player_id, any_value(batter) AS player, CAST(sum(runs_bat) AS BIGINT) AS runs, {_FACED} AS balls, {rt('sum(runs_bat)', _FACED, 100)} AS sr, count(*) FILTER (is_six) AS sixes, {rt('count(*) FILTER (NOT is_wide AND runs_bat = 0)', _FACED, 100, 1)} AS dot_pct, count(*) FILTER (is_wicket AND player_out_id = batter_id) AS outs FROM b WHERE phase = 'death' GROUP BY batter_id HAVING {_FACED} >= 5 ORDER BY sr DESC, balls DESC, player_id LIMIT 20"),
    "overs_leaders": sql(f"SELECT bowler_id AS player_id, any_value(bowler) AS player, count(*) FILTER (bowler_wicket) AS wkts, {_LEGAL} AS balls, CAST(sum(bowler_runs) AS BIGINT) AS runs, {rt('sum(bowler_runs)', _LEGAL, 6)} AS econ, {rt('count(*) FILTER (is_legal AND runs_total = 0)', _LEGAL, 100, 1)} AS dot_pct FROM b WHERE over_number BETWEEN 3 AND 8 AND inning = 2 GROUP BY bowler_id HAVING {_LEGAL} >= 5 ORDER BY wkts DESC, econ, player_id LIMIT 20"),
    "find_players": sql("SELECT player_id, max(player) AS player, count(*) FILTER (t = 1) AS bat_inns, count(*) FILTER (t = 2) AS bowl_inns, min(year) AS first_year, max(year) AS last_year FROM (SELECT player_id, player, year, 1 AS t FROM bi UNION ALL SELECT player_id, player, year, 2 FROM wi) GROUP BY player_id HAVING contains(lower(max(player)), 'ler 1') OR CAST(player_id AS VARCHAR) = 'ler 1' ORDER BY count(*) DESC, player_id LIMIT 25"),
    # -- results
    "results_close_runs": sql("SELECT match_id, start_date, title, w1 AS team1, w2 AS team2, status_text AS result FROM g WHERE NOT rain AND NOT is_tied AND winner = team1 AND day % 40 + 1 < 20"),
    "results_close_wickets": sql("SELECT count(*) AS matches FROM g WHERE NOT rain AND NOT is_tied AND winner = team2 AND day % 9 + 1 < 6"),
    "results_tied": sql("SELECT match_id, start_date, title, w1 AS team1, w2 AS team2, status_text AS result FROM g WHERE is_tied"),
    "results_defended_under": sql("SELECT bat_first AS team, count(*) AS times, max(first) AS highest_defended, min(first) AS lowest_defended FROM tot JOIN g USING (match_id) WHERE NOT rain AND first < 100000 AND ww = bat_first GROUP BY 1", _TOT),
    "results_chased_over": sql("SELECT chaser AS team, count(*) AS times, max(first) AS highest_target, min(first) AS lowest_target FROM tot JOIN g USING (match_id) WHERE NOT rain AND first + 1 >= 20 AND ww = chaser GROUP BY 1", _TOT),
    "results_needed_at_over": sql("SELECT match_id, chaser AS team, first + 1 - early AS needed, start_date, status_text AS result FROM tot JOIN g USING (match_id) WHERE NOT rain AND ww = chaser ORDER BY needed DESC, match_id LIMIT 20", _TOT),
    "results_scored_over": sql("SELECT team, count(*) AS times, count(*) FILTER (ww = team) AS won_match, max(runs) AS highest FROM inn JOIN g USING (match_id) WHERE runs >= 40 GROUP BY team"),
    "results_conceded_over": sql("SELECT opposition AS team, count(*) AS times, count(*) FILTER (ww = opposition) AS won_match, max(runs) AS highest FROM inn JOIN g USING (match_id) WHERE runs >= 40 AND inning = 2 GROUP BY opposition"),
    "match_list": sql("SELECT match_id, start_date, title, w1 AS team1, w2 AS team2, status_text AS result, 'deliveries' AS data FROM g WHERE 'MI' IN (w1, w2)"),
    "champions": sql("SELECT year, ww AS champion, CASE WHEN ww = w1 THEN w2 ELSE w1 END AS runner_up, status_text AS result, ground, match_id FROM g WHERE title = 'Final'"),
    "string_agg_ordered": sql("SELECT ww AS team, count(*) AS titles, string_agg(CAST(year AS VARCHAR), ', ' ORDER BY start_date) AS years FROM g WHERE title = 'Final' GROUP BY ww"),
    "union_total": sql(f"SELECT year, played, won, lost, no_result, {rt('won', 'won + lost', 100, 1)} AS win_pct, finish FROM (SELECT CAST(year AS VARCHAR) AS year, played, won, lost, no_result, finish FROM ts UNION ALL SELECT 'Total', CAST(sum(played) AS BIGINT), CAST(sum(won) AS BIGINT), CAST(sum(lost) AS BIGINT), CAST(sum(no_result) AS BIGINT), count(*) FILTER (finish = 'Champions') || ' titles' FROM ts HAVING count(*) > 0)", _SIDES + ", ts AS (SELECT year, count(*) AS played, count(*) FILTER (ww = 'MI') AS won, count(*) FILTER (ww NOT IN ('', 'MI')) AS lost, count(*) FILTER (ww = '') AS no_result, CASE max(CASE WHEN title = 'Final' AND ww = 'MI' THEN 3 WHEN title = 'Final' THEN 2 WHEN title IN ('Qualifier 1', 'Eliminator') THEN 1 ELSE 0 END) WHEN 3 THEN 'Champions' WHEN 2 THEN 'Runner-up' WHEN 1 THEN 'Playoffs' ELSE 'League stage' END AS finish FROM sd WHERE team = 'MI' GROUP BY year)"),
    "head_to_head": sql(_rollup("count(*) AS played, count(*) FILTER (ww = 'MI') AS team1_won, count(*) FILTER (ww = 'CSK') AS team2_won, count(*) FILTER (ww = '') AS no_result", "(SELECT * FROM g WHERE 'MI' IN (w1, w2) AND 'CSK' IN (w1, w2))")),
    "home_ground": sql("SELECT year, team, ground FROM hg", f"{_SIDES}, {_HOME}"),
    "home_record": sql("SELECT team, count(*) FILTER (p = 'h') AS home_played, count(*) FILTER (p = 'h' AND ww = team) AS home_won, " + rt("count(*) FILTER (p = 'h' AND ww = team)", "count(*) FILTER (p = 'h')", 100, 1) + " AS home_win_pct, count(*) FILTER (p = 'a') AS away_played, " + rt("count(*) FILTER (p = 'a' AND ww = team)", "count(*) FILTER (p = 'a')", 100, 1) + " AS away_win_pct FROM (SELECT sd.team, ww, CASE WHEN h.ground = sd.ground THEN 'h' WHEN o.ground = sd.ground THEN 'a' ELSE 'n' END AS p FROM sd LEFT JOIN hg h ON h.year = sd.year AND h.team = sd.team LEFT JOIN hg o ON o.year = sd.year AND o.team = sd.opponent WHERE winner <> '') GROUP BY team HAVING count(*) FILTER (p = 'h') >= 1", f"{_SIDES}, {_HOME}"),
    "toss_split": sql("SELECT ground AS venue, count(*) AS matches, " + ", ".join(f"{rt(n, d, 100, 1)} AS {a}" for n, d, a in (("count(*) FILTER (td = 'field')", "count(*)", "chose_field_pct"), ("count(*) FILTER (tw = ww)", "count(*)", "toss_winner_won_pct"), ("count(*) FILTER (td = 'field' AND tw = ww)", "count(*) FILTER (td = 'field')", "won_pct_when_fielding"), ("count(*) FILTER (td = 'bat' AND tw = ww)", "count(*) FILTER (td = 'bat')", "won_pct_when_batting"))) + " FROM g WHERE winner <> '' AND NOT rain GROUP BY ground"),
    # -- records and milestones
    "record_totals": sql("SELECT match_id, inning, team, runs || '/' || wickets AS score, (balls // 6) || '.' || (balls % 6) AS overs, year, match_title AS match, runs FROM inn ORDER BY runs DESC, match_id, inning LIMIT 5"),
    "record_scores": sql(f"SELECT match_id, player_id, player, team, runs || CASE WHEN is_out THEN '' ELSE '*' END AS score, runs, balls, {rt('runs', 'balls', 100, 1)} AS sr, sixes, year FROM bi ORDER BY runs DESC, balls, match_id, player_id LIMIT 5"),
    "record_figures": sql("SELECT match_id, inning, player_id, player, wickets || '/' || conceded AS figures, (balls // 6) || '.' || (balls % 6) AS overs, wickets, conceded, year FROM wi ORDER BY wickets DESC, conceded, match_id, inning, player_id LIMIT 5"),
    "record_sixes": sql("SELECT match_id, player_id, player, team, sixes, runs || CASE WHEN is_out THEN '' ELSE '*' END AS score, runs, balls, year FROM bi ORDER BY sixes DESC, runs DESC, match_id, player_id LIMIT 5"),
    "fastest_fifty": sql("SELECT match_id, inning, player_id, any_value(batter) AS player, CAST(min(k) AS BIGINT) AS balls, any_value(year) AS year FROM (SELECT match_id, inning, batter_id AS player_id, batter, year, sum(runs_bat) OVER w AS c, sum(CASE WHEN is_wide THEN 0 ELSE 1 END) OVER w AS k FROM b WINDOW w AS (PARTITION BY match_id, inning, batter_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE c >= 8 GROUP BY match_id, inning, player_id ORDER BY balls, year, match_id, inning, player_id LIMIT 5"),
    "milestone_innings": sql(_milestone("runs", 50, "bi")),
    "milestone_ducks": sql(_milestone("CASE WHEN runs = 0 AND is_out THEN 1 ELSE 0 END", 2, "bi")),
    "milestone_wickets": sql(_milestone("wickets", 10, "wi")),
    "milestone_balls": sql("SELECT player_id, any_value(bowler) AS player, CAST(min(k) AS BIGINT) AS balls, min(start_date) AS reached_on FROM (SELECT bowler_id AS player_id, bowler, start_date, sum(CASE WHEN is_legal THEN 1 ELSE 0 END) OVER w AS k, sum(CASE WHEN bowler_wicket THEN 1 ELSE 0 END) OVER w AS c FROM b WINDOW w AS (PARTITION BY bowler_id ORDER BY match_id, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE c >= 10 GROUP BY player_id ORDER BY balls, reached_on, player_id LIMIT 20"),
    "nth_match": sql("SELECT p.match_id, start_date, title, team1, team2, result, n, role, figures, balls, fours, sixes FROM p JOIN (SELECT match_id, g.start_date, g.title, g.w1 AS team1, g.w2 AS team2, g.status_text AS result, row_number() OVER (ORDER BY g.start_date, match_id) AS n FROM (SELECT DISTINCT match_id FROM p) JOIN g USING (match_id)) x USING (match_id) WHERE n = 3", "p AS (SELECT match_id, 'batting' AS role, CAST(runs AS VARCHAR) AS figures, balls, fours, sixes FROM bi WHERE player_id = 7 UNION ALL SELECT match_id, 'bowling', wickets || '/' || conceded, balls, NULL, NULL FROM wi WHERE player_id = 7)"),
    "match_card_batting": sql(f"SELECT bi.inning, bi.player, CASE WHEN k.kind IS NULL THEN 'not out' WHEN k.cr THEN k.kind || ' b ' || k.bw ELSE k.kind END AS dismissal, bi.runs, bi.balls, bi.fours, bi.sixes, {rt('bi.runs', 'bi.balls', 100, 1)} AS sr FROM bi LEFT JOIN (SELECT match_id, inning, player_out_id, max(dismissal_type) AS kind, max(bowler) AS bw, bool_or(bowler_wicket) AS cr FROM b WHERE is_wicket GROUP BY ALL) k ON k.match_id = bi.match_id AND k.inning = bi.inning AND k.player_out_id = bi.player_id WHERE bi.match_id = 8767"),
    "match_card_bowling": sql(f"SELECT inning, player, (balls // 6) || '.' || (balls % 6) AS overs, conceded, wickets, {rt('conceded', 'balls', 6)} AS econ FROM wi WHERE match_id = 8767"),
    "match_card_phases": sql(f"SELECT inning, phase, CAST(sum(runs_total) AS BIGINT) AS runs, count(*) FILTER (is_wicket) AS wkts, {rt('sum(runs_total)', _LEGAL, 6)} AS run_rate, count(*) FILTER (is_four) AS fours, count(*) FILTER (is_six) AS sixes FROM b WHERE match_id = 8767 GROUP BY inning, phase"),
    "commentary_search": sql("""SELECT match_id, inning, over_number, sequence, CASE WHEN length(commentary) > 7 THEN substr(commentary, 1, 7) || '...' ELSE commentary END AS text FROM b WHERE contains(commentary, '9}') AND inning = 1 ORDER BY match_id, sequence LIMIT 50"""),
    # -- grounds
    "venue_table": sql(f"SELECT ground, count(*) AS matches, {rt('sum(first)', 'count(*)', 1, 1)} AS avg_1st_inns, count(*) FILTER (ww = bat_first) AS bat_first_won, count(*) FILTER (ww = chaser) AS chasing_won, max(greatest(first, coalesce(second, 0))) AS highest_total, {rt('sum(first + coalesce(second, 0))', 'sum(b1 + coalesce(b2, 0))', 6)} AS run_rate, min(year) AS first_year, max(year) AS last_year FROM gm GROUP BY ground", _GAMES),
    "ground_seasons": sql(f"""SELECT year, matches, avg_1st_inns, league_1st, vs_league, run_rate, league_rr, chase_win_pct FROM y
      UNION ALL SELECT 'Total', matches, a, l, {rd('a - l', 1)}, rr, lr, cw FROM (SELECT count(*) AS matches, {rt('sum(first)', 'count(*)', 1, 1)} AS a, {rt('sum(first + coalesce(second, 0))', 'sum(b1 + coalesce(b2, 0))', 6)} AS rr, {rt('count(*) FILTER (ww = chaser)', 'count(second)', 100, 0)} AS cw FROM gm WHERE ground = 'Eden Gardens' HAVING count(*) > 0), (SELECT {rt('sum(CAST(round(league_1st * 10) AS BIGINT) * matches)', 'sum(matches) * 10', 1, 1)} AS l, {rt('sum(CAST(round(league_rr * 100) AS BIGINT) * matches)', 'sum(matches) * 100', 1, 2)} AS lr FROM y)""",
      f"""{_GAMES}, lg AS (SELECT year, sum(first)::DOUBLE / count(*) AS lf, 6e0 * sum(first + coalesce(second, 0)) / sum(b1 + coalesce(b2, 0))::DOUBLE AS lr FROM gm GROUP BY year),
      y AS (SELECT CAST(year AS VARCHAR) AS year, matches, {rd('o', 1)} AS avg_1st_inns, {rd('lf', 1)} AS league_1st, {rd('o - lf', 1)} AS vs_league, run_rate, {rd('lr', 2)} AS league_rr, chase_win_pct FROM (SELECT year, count(*) AS matches, 1e0 * sum(first) / count(*)::DOUBLE AS o, {rt('sum(first + coalesce(second, 0))', 'sum(b1 + coalesce(b2, 0))', 6)} AS run_rate, {rt('count(*) FILTER (ww = chaser)', 'count(second)', 100, 0)} AS chase_win_pct FROM gm WHERE ground = 'Eden Gardens' GROUP BY year) JOIN lg USING (year))"""),
    "grouping_sets_phase": sql("SELECT h.phase, h.run_rate, h.boundary_pct, h.dot_pct, h.wkts_per_inns, l.run_rate AS league_run_rate, l.boundary_pct AS league_boundary_pct, l.dot_pct AS league_dot_pct, l.wkts_per_inns AS league_wkts_per_inns FROM q h JOIN q l ON l.phase = h.phase AND l.here IS NULL WHERE h.here", f"{_HERE}, q AS (SELECT here, phase, {rt('sum(runs_total)', _LEGAL, 6)} AS run_rate, {rt('count(*) FILTER (is_four OR is_six)', _LEGAL, 100, 1)} AS boundary_pct, {rt('count(*) FILTER (is_legal AND runs_total = 0)', _LEGAL, 100, 1)} AS dot_pct, {rt('count(*) FILTER (bowler_wicket)', 'count(DISTINCT (match_id, inning))', 1, 2)} AS wkts_per_inns FROM hs GROUP BY GROUPING SETS ((here, phase), (phase)))"),
    "share_within_group": sql("SELECT o.dismissal, " + rt("o.n", "(SELECT count(*) FROM k WHERE here)", 100, 1) + " AS pct, " + rt("e.n", "(SELECT count(*) FROM k)", 100, 1) + " AS league_pct FROM (SELECT dismissal, count(*) AS n FROM k WHERE here GROUP BY 1) o JOIN (SELECT dismissal, count(*) AS n FROM k GROUP BY 1) e USING (dismissal) WHERE dismissal <> 'other'", f"{_HERE}, k AS (SELECT here, CASE WHEN dismissal_type IN ('bowled', 'lbw', 'stumped', 'run out', 'caught') THEN dismissal_type ELSE 'other' END AS dismissal FROM hs WHERE is_wicket)"),
    "ground_pace_spin": sql(f"SELECT h.bowl_kind AS kind, {rt('h.n', '(SELECT sum(n) FROM q WHERE here)', 100, 1)} AS share_of_overs, h.econ, l.econ AS league_econ, h.bpw AS balls_per_wkt, l.bpw AS league_balls_per_wkt, h.dot AS dot_pct, l.dot AS league_dot_pct FROM q h JOIN q l ON l.bowl_kind = h.bowl_kind AND l.here IS NULL WHERE h.here", f"{_HERE}, {_STYLE}, q AS (SELECT here, bowl_kind, {_LEGAL} AS n, {rt('sum(bowler_runs)', _LEGAL, 6)} AS econ, {rt(_LEGAL, 'count(*) FILTER (bowler_wicket)', 1, 1)} AS bpw, {rt('count(*) FILTER (is_legal AND bowler_runs = 0)', _LEGAL, 100, 1)} AS dot FROM hs JOIN stl ON player_id = bowler_id AND bowl_kind <> '' GROUP BY GROUPING SETS ((here, bowl_kind), (bowl_kind)))"),
    "pitch_phases": sql(f"SELECT phase, {rt('sum(runs_total) FILTER (match_id = 8767)', 'count(*) FILTER (match_id = 8767 AND is_legal)', 6)} AS rr_here, {rt('sum(runs_total)', _LEGAL, 6)} AS rr_league FROM b WHERE year = (SELECT year FROM g WHERE match_id = 8767) GROUP BY phase"),
    "pitch_kinds": sql(f"SELECT bowl_kind AS kind, count(*) FILTER (h AND is_legal) AS balls, count(*) FILTER (h AND bowler_wicket) AS wickets, {rt('sum(bowler_runs) FILTER (h)', 'count(*) FILTER (h AND is_legal)', 6)} AS econ_here, {rt('sum(bowler_runs)', _LEGAL, 6)} AS econ_league, {rt('count(*) FILTER (h AND is_legal AND bowler_runs = 0)', 'count(*) FILTER (h AND is_legal)', 100, 1)} AS dot_pct_here, {rt('count(*) FILTER (is_legal AND bowler_runs = 0)', _LEGAL, 100, 1)} AS dot_pct_league FROM (SELECT b.*, match_id = 8767 AS h, bowl_kind FROM b JOIN stl ON player_id = bowler_id AND bowl_kind <> '' WHERE year = (SELECT year FROM g WHERE match_id = 8767)) GROUP BY bowl_kind", _STYLE),
    "pitch_wickets": sql("SELECT " + rt("count(*) FILTER (match_id = 8767 AND dismissal_type IN ('bowled', 'lbw'))", "count(*) FILTER (match_id = 8767)", 100, 1) + " AS bowled_lbw_pct_here, " + rt("count(*) FILTER (dismissal_type IN ('bowled', 'lbw'))", "count(*)", 100, 1) + " AS bowled_lbw_pct_league, count(*) FILTER (match_id = 8767) AS wickets_here FROM b WHERE bowler_wicket AND year = (SELECT year FROM g WHERE match_id = 8767)"),
    "pitch_cues": "SELECT cue, mentions FROM (SELECT 'and then' AS cue, count(*) FILTER (regexp_matches(text, '\\b(and|und) th', 'i')) AS mentions FROM documents UNION ALL SELECT 'not been', count(*) FILTER (regexp_matches(text, '(^| )be( |$)', 'i')) FROM documents UNION ALL SELECT 'never', count(*) FILTER (regexp_matches(text, '\\bqqqq\\b', 'i')) FROM documents) WHERE mentions > 0",
    "adhoc_sql": sql("SELECT year, batting_team AS team, count(*) AS balls, CAST(sum(runs_total) AS BIGINT) AS runs, count(DISTINCT match_id) AS games FROM b WHERE is_legal AND over_number > 6 GROUP BY year, batting_team HAVING count(*) > 5"),
    "surface_cues": sql("SELECT cue, count(*) AS mentions FROM b JOIN (VALUES (0, 'turn'), (3, 'seam or swing'), (4, 'dew'), (5, 'low bounce'), (6, 'bounce'), (7, 'slow, two-paced'), (8, 'flat, good to bat')) v(k, cue) ON sequence % 10 = k GROUP BY cue"),
    # -- families
    "match_state": sql("SELECT match_id, inning, sequence, CAST(score_before AS BIGINT) AS score_before, CAST(wkts_before AS BIGINT) AS wkts_before, CAST(legal_before AS BIGINT) AS legal_before, CAST(bat_ball_no AS BIGINT) AS bat_ball_no, CAST(CASE WHEN inning = 2 THEN f + 1 - score_before END AS BIGINT) AS needed, CAST(160 - legal_before AS BIGINT) AS balls_left, CAST(10 - wkts_before AS BIGINT) AS wkts_in_hand, " + rd("CASE WHEN inning = 2 AND legal_before < 160 THEN 6e0 * (f + 1 - score_before) / (160 - legal_before) END", 6) + " AS rrr FROM st LEFT JOIN (SELECT match_id, sum(runs_total) AS f FROM b WHERE inning = 1 GROUP BY 1) t USING (match_id)"),
    "partnerships": sql("SELECT match_id, inning, CAST(wkts_before + 1 AS BIGINT) AS wicket, CAST(sum(runs_total) AS BIGINT) AS runs, count(*) FILTER (is_legal) AS balls, string_agg(DISTINCT batter, ' & ' ORDER BY batter) AS pair, bool_or(is_wicket) AS ended FROM st GROUP BY match_id, inning, wkts_before"),
    "partnership_top": sql("SELECT p.match_id, inning, wicket, pair, runs, balls, team, opposition, g.start_date FROM p JOIN g USING (match_id) ORDER BY runs DESC, start_date, inning, wicket LIMIT 20", "p AS (SELECT match_id, inning, CAST(wkts_before + 1 AS BIGINT) AS wicket, string_agg(DISTINCT batter, ' & ' ORDER BY batter) AS pair, CAST(sum(runs_total) AS BIGINT) AS runs, count(*) FILTER (is_legal) AS balls, any_value(batting_team) AS team, any_value(bowling_team) AS opposition FROM st GROUP BY match_id, inning, wkts_before)"),
    "partnership_pairs": sql(f"SELECT any_value(pair) AS pair, count(*) AS stands, CAST(sum(runs) AS BIGINT) AS runs, {rt('sum(runs)', 'count(*)', 1, 1)} AS avg_stand, max(runs) AS best, count(*) FILTER (runs >= 100) AS hundred_stands, {rt('sum(runs)', 'sum(balls)', 100, 1)} AS rate FROM p WHERE len(ids) = 2 GROUP BY ids ORDER BY runs DESC, ids LIMIT 20", "p AS (SELECT list_sort(list(DISTINCT batter_id)) AS ids, string_agg(DISTINCT batter, ' & ' ORDER BY batter) AS pair, CAST(sum(runs_total) AS BIGINT) AS runs, count(*) FILTER (is_legal) AS balls FROM st GROUP BY match_id, inning, wkts_before)"),
    "hattricks": sql("SELECT match_id, bowler_id, any_value(bowler) AS bowler, max(bowling_team) AS team, max(batting_team) AS against, min(start_date) AS start_date FROM (SELECT *, sum(CASE WHEN bowler_wicket THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, bowler_id ORDER BY inning, sequence ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS three FROM b) WHERE three = 3 GROUP BY match_id, bowler_id"),
    "awards_topk": sql("SELECT player_id, 'Batter ' || player_id AS player, count(*) AS awards, max(start_date) AS latest FROM (SELECT match_id % 11 AS player_id, start_date FROM g) GROUP BY player_id ORDER BY awards DESC, latest DESC, player_id LIMIT 20"),
    "impact_subs": sql(f"SELECT player_id, any_value(player) AS player, count(*) AS times, coalesce(any_value(bt.runs), 0) AS runs, coalesce(any_value(bt.bf), 0) AS balls_faced, coalesce(any_value(bw.wkts), 0) AS wkts, any_value(bw.economy) AS economy FROM sb LEFT JOIN (SELECT sb.player_id, CAST(sum(runs_bat) AS BIGINT) AS runs, {_FACED} AS bf FROM sb JOIN b ON b.match_id = sb.match_id AND b.batter_id = sb.player_id GROUP BY 1) bt USING (player_id) LEFT JOIN (SELECT sb.player_id, count(*) FILTER (bowler_wicket) AS wkts, {rt('sum(bowler_runs)', _LEGAL, 6)} AS economy FROM sb JOIN b ON b.match_id = sb.match_id AND b.bowler_id = sb.player_id GROUP BY 1) bw USING (player_id) GROUP BY player_id ORDER BY times DESC, player_id LIMIT 20", "sb AS (SELECT match_id, batter_id AS player_id, batter AS player FROM b WHERE sequence % 97 = 0 AND sequence % 2 = 0)"),
    "par_by_over": sql(f"SELECT over_number, {rt('sum(runs_total)', 'count(DISTINCT (match_id, inning))')} AS runs, {rt('count(*) FILTER (is_wicket)', 'count(DISTINCT (match_id, inning))', 1, 3)} AS wickets FROM b GROUP BY over_number"),
    "style_coverage": sql(f"SELECT count(*) AS balls, {rt(_KNOWN, 'count(*)', 100, 1)} AS bowl_kind_pct, {rt('count(t.bat_hand)', 'count(*)', 100, 1)} AS bat_hand_pct FROM b LEFT JOIN stl w ON w.player_id = bowler_id LEFT JOIN stl t ON t.player_id = batter_id", _STYLE),
    # -- course of innings
    "irregular_overs": sql("SELECT match_id, inning, over_number, count(*) FILTER (is_legal) AS legal FROM b GROUP BY ALL HAVING count(*) FILTER (is_legal) <> 6"),
    "running_score": sql("SELECT match_id, inning, sequence, CAST(sum(runs_total) OVER w AS BIGINT) || '/' || CAST(sum(CASE WHEN is_wicket THEN 1 ELSE 0 END) OVER w AS BIGINT) AS score FROM b WINDOW w AS (PARTITION BY match_id, inning ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
    "over_series": sql(f"SELECT match_id, inning, over_number, runs, wickets, balls, boundaries, CAST(sum(runs) OVER w AS BIGINT) AS total, CAST(sum(wickets) OVER w AS BIGINT) AS down, {rt('sum(runs) OVER w', 'sum(balls) OVER w', 6)} AS run_rate FROM ov WINDOW w AS (PARTITION BY match_id, inning ORDER BY over_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", _OV),
    "worm": sql("SELECT match_id, inning, sequence, CAST(legal_before + CASE WHEN is_legal THEN 1 ELSE 0 END AS BIGINT) AS legal, CAST(score_before + runs_total AS BIGINT) AS total, CAST(wkts_before + CASE WHEN is_wicket THEN 1 ELSE 0 END AS BIGINT) AS down, CAST(score_before + runs_total AS BIGINT) || '/' || CAST(wkts_before + CASE WHEN is_wicket THEN 1 ELSE 0 END AS BIGINT) AS score FROM st"),
    "fall_of_wickets": sql("SELECT match_id, inning, CAST(wkts_before + 1 AS BIGINT) AS wicket, CAST(t AS BIGINT) || '/' || CAST(wkts_before + 1 AS BIGINT) AS score, over_number, player_out, CAST(t - coalesce(lag(t) OVER (PARTITION BY match_id, inning ORDER BY sequence), 0) AS BIGINT) AS stand FROM (SELECT *, score_before + runs_total AS t FROM st WHERE is_wicket)"),
    "ewma_momentum": "WITH RECURSIVE " + BASE + f", {_OV}, n AS (SELECT match_id, inning, over_number, runs, wickets, runs - avg(runs) OVER (PARTITION BY match_id, inning) - 8e0 * wickets AS off, row_number() OVER (PARTITION BY match_id, inning ORDER BY over_number) AS k FROM ov), m AS (SELECT match_id, inning, over_number, runs, wickets, k, 0.3::DOUBLE * off AS e FROM n WHERE k = 1 UNION ALL SELECT n.match_id, n.inning, n.over_number, n.runs, n.wickets, n.k, 0.3::DOUBLE * n.off + 0.7::DOUBLE * m.e FROM m JOIN n ON n.match_id = m.match_id AND n.inning = m.inning AND n.k = m.k + 1) SELECT match_id, inning, over_number, runs, wickets, {rd('e', 4)} AS momentum FROM m",
    "shift_wicket_cluster": sql(f"SELECT match_id, inning, 'wicket_cluster' AS kind, CAST(fb AS BIGINT) AS first_ball, CAST(lb AS BIGINT) AS last_ball, fo AS first_over, lo AS last_over, CAST(n AS BIGINT) AS wickets, CAST(r AS BIGINT) AS runs, CAST(q AS BIGINT) AS balls, bw AS favours, {rd('8e0 * n + rate * greatest(q, 1) - r', 1)} AS magnitude FROM (SELECT match_id, inning, max(rate) AS rate, count(*) AS n, min(ball) AS fb, max(ball) AS lb, min(over_number) AS fo, max(over_number) AS lo, arg_max(t, ball) - arg_min(score_before, ball) AS r, arg_max(l, ball) - arg_min(legal_before, ball) AS q, any_value(bowling_team) AS bw FROM (SELECT *, sum(s) OVER (PARTITION BY match_id, inning ORDER BY ball ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM (SELECT *, CASE WHEN l - lag(l) OVER (PARTITION BY match_id, inning ORDER BY ball) <= 9 THEN 0 ELSE 1 END AS s FROM bl WHERE is_wicket)) GROUP BY match_id, inning, isl) WHERE n >= 3 OR (n = 2 AND q <= 6)", _OV),
    "shift_burst": sql(f"SELECT match_id, inning, 'scoring_burst' AS kind, CAST(min(fb) AS BIGINT) AS first_ball, CAST(max(lb) AS BIGINT) AS last_ball, min(over_number) AS first_over, max(over_number) AS last_over, CAST(sum(wickets) AS BIGINT) AS wickets, CAST(sum(runs) AS BIGINT) AS runs, CAST(sum(balls) AS BIGINT) AS balls, any_value(bat) AS favours, {rd('sum(runs) - max(rate) * sum(balls) - 8e0 * sum(wickets)', 1)} AS magnitude FROM (SELECT ov.*, rate, fb, lb, bat, bowl, over_number - row_number() OVER (PARTITION BY match_id, inning ORDER BY over_number) AS isl FROM ov JOIN rate USING (match_id, inning) JOIN ob USING (match_id, inning, over_number) WHERE runs >= greatest(10e0, 1.1::DOUBLE * rate * 6)) GROUP BY match_id, inning, isl HAVING (count(*) >= 2 OR sum(runs) >= 20) AND sum(wickets) <= 1", _OV),
    "shift_squeeze": sql(f"SELECT match_id, inning, 'squeeze' AS kind, CAST(min(fb) AS BIGINT) AS first_ball, CAST(max(lb) AS BIGINT) AS last_ball, min(over_number) AS first_over, max(over_number) AS last_over, CAST(sum(wickets) AS BIGINT) AS wickets, CAST(sum(runs) AS BIGINT) AS runs, CAST(sum(balls) AS BIGINT) AS balls, any_value(bowl) AS favours, {rd('max(rate) * sum(balls) - sum(runs) + 8e0 * sum(wickets)', 1)} AS magnitude FROM (SELECT ov.*, rate, fb, lb, bat, bowl, over_number - row_number() OVER (PARTITION BY match_id, inning ORDER BY over_number) AS isl FROM ov JOIN rate USING (match_id, inning) JOIN ob USING (match_id, inning, over_number) WHERE boundaries = 0 AND runs <= 1.0::DOUBLE * rate * 6) GROUP BY match_id, inning, isl HAVING count(*) >= 2", _OV),
    "shift_chase": sql(f"SELECT match_id, inning, 'chase_swing' AS kind, CAST(x.ball + 1 AS BIGINT) AS first_ball, CAST(y.ball AS BIGINT) AS last_ball, z.over_number AS first_over, y.over_number AS last_over, CAST(y.w - x.w AS BIGINT) AS wickets, CAST(y.t - x.t AS BIGINT) AS runs, CAST(y.l - x.l AS BIGINT) AS balls, CASE WHEN {rd('y.t - x.t - need * (y.l - x.l) / 6 - 8e0 * (y.w - x.w)', 1)} > 0 THEN x.batting_team ELSE x.bowling_team END AS favours, abs({rd('y.t - x.t - need * (y.l - x.l) / 6 - 8e0 * (y.w - x.w)', 1)}) AS magnitude FROM (SELECT *, 6e0 * (f + 1 - t) / nullif(160 - l, 0) AS need FROM bl JOIN (SELECT match_id, sum(runs) AS f FROM ov WHERE inning = 1 GROUP BY 1) USING (match_id) WHERE inning = 2 AND is_legal AND l % 6 = 0 AND l < 160 AND t < f + 1) x JOIN (SELECT * FROM bl WHERE is_legal) y USING (match_id, inning) JOIN bl z USING (match_id, inning) WHERE y.l = x.l + 12 AND z.ball = x.ball + 1 AND need <= 18 AND abs({rd('y.t - x.t - need * (y.l - x.l) / 6 - 8e0 * (y.w - x.w)', 1)}) >= 3", _OV),
    "shift_chance": sql("SELECT match_id, inning, 'missed_chance' AS kind, CAST(ball AS BIGINT) AS first_ball, CAST(ball AS BIGINT) AS last_ball, over_number AS first_over, over_number AS last_over, CAST(w - wkts_before AS BIGINT) AS wickets, CAST(runs_total AS BIGINT) AS runs, CAST(l - legal_before AS BIGINT) AS balls, batting_team AS favours, 6e0 AS magnitude FROM bl WHERE sequence % 7 = 0 AND sequence % 6 IN (0, 1, 3, 4)", _OV),
    "impact_board": sql(f"SELECT match_id, inning, player_id, role, impact + 0e0 AS impact FROM (SELECT match_id, inning, player_id, 'bat' AS role, {rd('r - p * f + CASE WHEN s IS NOT NULL AND r > 15 AND tt > 0 THEN 3e0 * (1e0 - s / tt::DOUBLE) ELSE 0e0 END - CASE WHEN s IS NULL THEN 0e0 ELSE 12e0 END', 1)} AS impact FROM (SELECT match_id, inning, batter_id AS player_id, CAST(sum(runs_bat) AS BIGINT) AS r, {_FACED} AS f FROM b GROUP BY ALL) LEFT JOIN (SELECT match_id, inning, player_out_id AS player_id, min(score_before + runs_total) AS s FROM st WHERE is_wicket GROUP BY ALL) USING (match_id, inning, player_id) JOIN (SELECT match_id, inning, CAST(sum(runs_total) AS BIGINT) AS tt FROM b GROUP BY ALL) USING (match_id, inning) JOIN par USING (match_id) WHERE f > 0 UNION ALL SELECT match_id, inning, bowler_id, 'bowl', {rd('p * q - v + 12e0 * w', 1)} FROM (SELECT match_id, inning, bowler_id, {_LEGAL} AS q, CAST(sum(bowler_runs) AS BIGINT) AS v, count(*) FILTER (bowler_wicket) AS w FROM b GROUP BY ALL) JOIN par USING (match_id) WHERE q > 0)", f"par AS (SELECT match_id, sum(runs_total)::DOUBLE / {_LEGAL} AS p FROM b GROUP BY match_id)"),
    "key_moments": sql("SELECT match_id, place, inning, sequence, priority FROM (SELECT match_id, inning, sequence, p AS priority, row_number() OVER (PARTITION BY match_id ORDER BY p, inning, sequence) AS place FROM (SELECT *, CASE WHEN is_wicket THEN 1 WHEN row_number() OVER (PARTITION BY match_id, inning ORDER BY sequence DESC) <= 4 THEN 2 WHEN is_six THEN 3 END AS p FROM b) WHERE p IS NOT NULL) WHERE place <= 8"),
    "maidens": sql("SELECT match_id, inning, player_id, count(*) AS maidens FROM (SELECT match_id, inning, over_number, max(bowler_id) AS player_id FROM b GROUP BY ALL HAVING count(*) FILTER (is_legal) = 6 AND count(DISTINCT bowler_id) = 1 AND sum(bowler_runs) = 0) GROUP BY match_id, inning, player_id"),
    # -- slices
    "slice_career": sql(f"SELECT {_COLS}, {rd('100e0 * R / B', 2)} AS value FROM r WHERE B >= 30 ORDER BY 100e0 * R / B DESC, k LIMIT 20".replace("100e0 * R / B DESC", rd("100e0 * R / B", 2) + " DESC"), _slice(_BATTER) + ", " + _OUTS),
    "slice_season": sql(f"SELECT {_COLS}, CAST(W AS DOUBLE) AS value FROM r ORDER BY W DESC, k, u LIMIT 20", _slice(_BOWLER, key="bowler_id", name="bowler", u="CAST(year AS VARCHAR)") + ", " + _PLAIN),
    "slice_match": sql(f"SELECT {_COLS}, CAST(R AS DOUBLE) AS value FROM r ORDER BY R DESC, k, u LIMIT 20", _slice(_TEAM, "phase = 'middle'", key="batting_team", name="batting_team", u="CAST(match_id AS VARCHAR)") + ", " + _PLAIN),
    "slice_split": sql(f"SELECT {_COLS}, {rd('6e0 * R / nullif(B, 0)', 2)} AS value FROM r WHERE B > 0", _slice(_TEAM, key="'all'", name="'all'", s="ground") + ", " + _PLAIN),
    "slice_result": sql(f"SELECT {_COLS}, {rd('6e0 * R / nullif(B, 0)', 2)} AS value FROM r WHERE B > 0", _slice(_TEAM, "NOT is_out_of", frm="(SELECT b.*, ww, rain AS is_out_of FROM b JOIN g USING (match_id))", key="bowling_team", name="bowling_team", s="CASE WHEN ww = bowling_team THEN 'won' WHEN ww = '' THEN 'no result' ELSE 'lost' END").replace("WHERE NOT is_out_of", "") + ", " + _PLAIN),
    "slice_state": sql(f"SELECT {_COLS}, {rd('100e0 * BND / nullif(B, 0)', 2)} AS value FROM r WHERE B >= 3 ORDER BY value DESC, k LIMIT 20", _slice(_BATTER, "inning = 2 AND 10 - wkts_before BETWEEN -60 AND 8 AND legal_before < 160 AND 6e0 * (f1 + 1 - score_before) / (160 - legal_before) > 1 AND NOT rain", frm="(SELECT st.*, f1, rain FROM st JOIN (SELECT match_id, sum(runs_total) AS f1 FROM b WHERE inning = 1 GROUP BY 1) USING (match_id) JOIN g USING (match_id))") + ", " + _OUTS),
    "slice_styles": sql(f"SELECT {_COLS}, {rd('1e0 * R / nullif(W, 0)', 2)} AS value FROM r WHERE W >= 3 AND B >= 0 ORDER BY value DESC NULLS LAST, k, s LIMIT 20", _STYLE + ", " + _slice(_BATTER, "bat_hand = 'left'", frm="(SELECT b.*, x.bat_hand, y.bowl_kind FROM b LEFT JOIN stl x ON x.player_id = batter_id LEFT JOIN stl y ON y.player_id = bowler_id)", s="coalesce(nullif(bowl_kind, ''), 'unknown')") + ", " + _OUTS),
    "slice_high_score": sql("SELECT match_id, inning, name, team, runs || CASE WHEN o THEN '' ELSE '*' END AS score, runs, balls, start_date FROM (SELECT f.match_id, f.inning, f.k, any_value(name) AS name, any_value(batting_team) AS team, CAST(sum(R) AS BIGINT) AS runs, CAST(sum(B) AS BIGINT) AS balls, EXISTS (SELECT 1 FROM f z WHERE z.is_wicket AND z.match_id = f.match_id AND z.inning = f.inning AND z.player_out_id = f.k) AS o FROM f GROUP BY f.match_id, f.inning, f.k) JOIN g USING (match_id) ORDER BY runs DESC, balls, match_id, inning, k LIMIT 20", _slice(_BATTER, "over_number BETWEEN 1 AND 6")),
    "slice_counts": sql("SELECT k, u, any_value(name) AS name, count(*) FILTER (runs = 0 AND o) AS n, count(*) AS innings, CAST(sum(runs) AS BIGINT) AS runs FROM (SELECT f.match_id, f.inning, f.k, u, any_value(name) AS name, sum(R) AS runs, EXISTS (SELECT 1 FROM f z WHERE z.is_wicket AND z.match_id = f.match_id AND z.inning = f.inning AND z.player_out_id = f.k) AS o FROM f GROUP BY f.match_id, f.inning, f.k, u) GROUP BY k, u HAVING count(*) FILTER (runs = 0 AND o) > 0 ORDER BY n DESC, innings, name, k, u LIMIT 20", _slice(_BATTER, u="CAST(year AS VARCHAR)")),
    "slice_adjusted": sql(f'SELECT {_COLS}, {rd("100e0 * R / B", 2)} AS value, {rd("100e0 * R / nullif(due, 0)", 2)} AS "index" FROM r JOIN (SELECT k, sum(d * rate) AS due FROM (SELECT k, year, sum(B)::DOUBLE AS d FROM f GROUP BY 1, 2) JOIN (SELECT year, sum(R)::DOUBLE / nullif(sum(B), 0)::DOUBLE AS rate FROM f GROUP BY 1) USING (year) GROUP BY k) USING (k) WHERE B >= 30 ORDER BY "index" DESC NULLS LAST, k LIMIT 20', _slice(_BATTER) + ", " + _OUTS),
    "slice_shrunk": sql(f"SELECT {_COLS}, {rd('100e0 * R / B', 2)} AS value, {rd('100e0 * CASE WHEN t2 > 0 THEN (R + s2 / t2 * p0) / (B + s2 / t2) ELSE p0 END', 2)} AS shrunk FROM r, (SELECT p0, s2, (spread - n * s2) / w AS t2 FROM lg, (SELECT sum(B * (R::DOUBLE / B - p0) ** 2) AS spread, count(*) AS n, sum(B)::DOUBLE AS w FROM r, lg WHERE B > 0)) WHERE B >= 30 ORDER BY shrunk DESC NULLS LAST, k LIMIT 20", _slice(_BATTER) + ", " + _OUTS + ", lg AS (SELECT sum(n)::DOUBLE / sum(d) AS p0, sum(coalesce(v, 0) * d) / sum(d) AS s2 FROM (SELECT year, sum(R) AS n, sum(B) AS d, var_pop(R) FILTER (B = 1) AS v FROM f GROUP BY year))"),
    # -- general relational operators on the other tables
    "scan_filter_project": "SELECT p_partkey, upper(p_name) AS name, CASE WHEN p_size < 10 THEN 'small' WHEN p_size <= 30 THEN 'medium' ELSE 'large' END AS size_class FROM part WHERE contains(lower(p_name), 'ring') AND p_size BETWEEN 5 AND 40",
    "macro_normalise": "SELECT n_nationkey, CASE split_part(n_name, '_', 1) WHEN 'NATION' THEN 'N' ELSE n_name END || split_part(n_name, '_', 2) AS code FROM nation",
    "replace_columns": "SELECT c_custkey, lower(c_name) AS c_name, c_nationkey, round(c_acctbal * 100, 0) / 100 * 2 AS c_acctbal, c_mktsegment, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey",
    "regex_margin": "SELECT TRY_CAST(nullif(regexp_extract(o_orderpriority, '^(\\d)-', 1), '') AS BIGINT) AS priority, count(*) AS n FROM orders WHERE NOT regexp_matches(o_orderpriority, 'NOT') GROUP BY 1",
    "inner_join_dim": "SELECT p_brand, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0 GROUP BY p_brand",
    "triple_dim_join": "SELECT a.n_nationkey, b.n_name AS next_name, c.n_name AS twice_name FROM nation a LEFT JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 LEFT JOIN nation c ON c.n_nationkey = a.n_nationkey * 2",
    "self_join_innings": sql("SELECT a.match_id, a.team AS first_team, a.runs AS first_runs, z.team AS second_team, z.runs AS second_runs FROM inn a LEFT JOIN inn z ON z.match_id = a.match_id AND z.inning = 2 WHERE a.inning = 1"),
    "anti_source_union": "SELECT user_id, count(*) AS n, max(source) AS source FROM (SELECT user_id, 'canonical' AS source FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id, 'fallback' FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')) GROUP BY user_id",
    "semi_years": "SELECT year(o_orderdate) AS year, count(*) AS n FROM orders WHERE year(o_orderdate) IN (SELECT year(o_orderdate) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3 AND o_totalprice > 300000) GROUP BY 1",
    "null_safe_reconcile": "SELECT l_orderkey, CASE WHEN r IS NULL THEN 'extra' WHEN o IS NULL THEN 'missing' ELSE 'differs' END AS status FROM (SELECT l_orderkey, CASE WHEN l_orderkey % 7 <> 0 THEN count(*) END AS o FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1) a FULL OUTER JOIN (SELECT l_orderkey, CASE WHEN l_orderkey % 11 = 0 THEN count(*) + 1 ELSE count(*) END AS r FROM lineitem WHERE l_orderkey % 3 <> 0 AND l_orderkey % 7 <> 0 GROUP BY 1) b USING (l_orderkey) WHERE o IS DISTINCT FROM r",
    "null_safe_reconcile_whole": "WITH h AS (SELECT o_orderkey, o_custkey AS customer, year(o_orderdate) AS year, o_totalprice FROM orders), l AS (SELECT x.o_orderkey, customer, year, price FROM (SELECT l_orderkey AS o_orderkey, sum(l_extendedprice) AS price FROM lineitem GROUP BY 1) x LEFT JOIN h USING (o_orderkey)) SELECT 'order' AS level, key, CASE WHEN r.key IS NULL THEN 'extra' WHEN a.key IS NULL THEN 'missing' ELSE 'differs' END AS status FROM (SELECT o_orderkey AS key, round(sum(price), 2) AS total FROM l GROUP BY 1) a FULL OUTER JOIN (SELECT o_orderkey AS key, round(sum(o_totalprice), 2) AS total FROM h GROUP BY 1) r USING (key) WHERE r.key IS NULL OR a.key IS NULL OR a.total IS DISTINCT FROM r.total UNION ALL SELECT 'customer' AS level, key, CASE WHEN r.key IS NULL THEN 'extra' WHEN a.key IS NULL THEN 'missing' ELSE 'differs' END AS status FROM (SELECT customer AS key, round(sum(price), 2) AS total FROM l GROUP BY 1) a FULL OUTER JOIN (SELECT customer AS key, round(sum(o_totalprice), 2) AS total FROM h GROUP BY 1) r USING (key) WHERE r.key IS NULL OR a.key IS NULL OR a.total IS DISTINCT FROM r.total UNION ALL SELECT 'year' AS level, key, CASE WHEN r.key IS NULL THEN 'extra' WHEN a.key IS NULL THEN 'missing' ELSE 'differs' END AS status FROM (SELECT year AS key, round(sum(price), 2) AS total FROM l GROUP BY 1) a FULL OUTER JOIN (SELECT year AS key, round(sum(o_totalprice), 2) AS total FROM h GROUP BY 1) r USING (key) WHERE r.key IS NULL OR a.key IS NULL OR a.total IS DISTINCT FROM r.total",
    "occurrence_merge": "WITH a AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), z AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE NOT (conv_id % 3 = 0 AND turn = 1)), s AS (SELECT DISTINCT conv_id, n AS m FROM z) SELECT a.conv_id, a.turn, a.role, z.turn AS right_turn FROM a LEFT JOIN s USING (conv_id) LEFT JOIN z ON z.conv_id = a.conv_id AND CASE WHEN a.n = s.m THEN a.p = z.p ELSE a.role = z.role AND a.k = z.k END",
    "asof_day_pair": "SELECT o_orderkey, matched_id, gap FROM (SELECT o.o_orderkey, s.o_orderkey AS matched_id, abs(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(s.o_orderdate AS DATE))) AS gap, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY abs(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(s.o_orderdate AS DATE))) NULLS LAST, s.o_orderdate, s.o_orderkey) AS k FROM (SELECT * FROM orders WHERE o_orderkey % 50 = 0) o LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 2 = 1) s ON s.o_orderpriority = o.o_orderpriority AND abs(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(s.o_orderdate AS DATE))) <= 1) WHERE k = 1",
    "asof_day_pair_whole": "SELECT o_orderkey, matched_id, gap FROM (SELECT o.o_orderkey, s.l_orderkey AS matched_id, abs(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(s.l_shipdate AS DATE))) AS gap, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY abs(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(s.l_shipdate AS DATE))) NULLS LAST, s.l_shipdate, s.l_orderkey) AS k FROM orders o LEFT JOIN (SELECT l_orderkey, l_shipdate, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey) s ON s.o_orderpriority = o.o_orderpriority AND abs(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(s.l_shipdate AS DATE))) <= 1) WHERE k = 1",
    "filtered_aggs": "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS open_lines, CAST(sum(l_linenumber) FILTER (l_quantity > 25) AS BIGINT) AS big_lines, round(var_pop(l_linenumber) FILTER (l_quantity > 25), 6) AS spread FROM lineitem GROUP BY l_returnflag",
    "distinct_tuple": "SELECT l_returnflag, count(DISTINCT (l_partkey, l_suppkey)) AS pairs FROM lineitem GROUP BY l_returnflag",
    "list_distinct_sorted": "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS priorities FROM orders GROUP BY o_custkey",
    "overs_text": "SELECT user_id, (count(*) // 6) || '.' || (count(*) % 6) AS overs FROM events GROUP BY user_id",
    "event_share": "SELECT user_id, event_type, count(*) AS n, round(1e8 * (100e0 * count(*) / sum(count(*)) OVER (PARTITION BY user_id)), 0) / 1e8 AS pct FROM events GROUP BY user_id, event_type",
    "dedupe_keep_last": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS k FROM lineitem) WHERE k = 1",
    "topk_tiebreak": "SELECT c_mktsegment, place, c_custkey, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey DESC, c_custkey) AS place FROM customer) WHERE place <= 3",
    "ties_at_top": "SELECT p_brand, p_partkey, p_size FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS k FROM part) WHERE k = 1",
    "evenly_spaced": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n <= 5 OR i = 0 OR (i * 4) // greatest(n - 1, 1) > ((i - 1) * 4) // greatest(n - 1, 1)",
    "keyword_search": "SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'ring') AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'economy')",
    "fill_gaps": "SELECT c_nationkey, count(*) AS n, CAST(sum(t) AS BIGINT) AS new_rows FROM (SELECT c_custkey, c_nationkey, 0 AS t FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_nationkey, 1 FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0) GROUP BY c_nationkey",
    "fill_gaps_whole": "SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "page_of_orders": "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50",
    "tumbling_batch": "SELECT date_trunc('hour', ts) AS hour_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "session_batch": "SELECT user_id, session_start, n FROM (SELECT user_id, s, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, s)",
    "json_props": "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY 1",
}
