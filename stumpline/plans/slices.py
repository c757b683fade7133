"""Slices: (subject, metric, filters, split, unit, ranking) as a specification that becomes one lazy DataFrame.

Filters come in two kinds.  The context (years, overs, phase, venue, match state, ...) says which balls count at all and
makes the league's baseline; the selection (player, opponent, team) says whose balls are ranked.  A batter's dismissals
belong to the player out, not to the striker.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import franchise, ground, innings_text, is_final, is_playoff, rain_revised, rounded, score_text
from ..operators.grounds import best_matching_ground
from ..operators.innings import home_grounds, match_state
from .archive import Archive
from .metrics import METRICS, SUBJECTS, UNITS, measures, metric_of, sides, splits

c = F.col
Range = tuple[int, int]


@dataclass(frozen=True)
class SliceSpec:
    """One question.  Ranges hold both ends; None leaves a filter out."""

    subject: str = "batter"
    metric: str = "runs"
    years: Range | None = None
    overs: Range | None = None
    phase: str | None = None
    innings: int | None = None
    stage: str | None = None
    result: str | None = None
    toss: str | None = None
    venue: str | None = None
    target_min: int | None = None
    target_max: int | None = None
    rrr_min: float | None = None
    rrr_max: float | None = None
    wickets_in_hand: Range | None = None
    batter_balls: Range | None = None
    bowl_kind: str | None = None
    bat_hand: str | None = None
    venue_type: str | None = None
    players: tuple[int, ...] = ()
    vs: int | None = None
    team: str | None = None
    opposition: str | None = None
    split: str | None = None
    per: str = "career"
    adjust: bool = False
    shrink: bool = False
    worst: bool = False
    least_balls: int | None = None
    limit: int | None = 20

    def __post_init__(self) -> None:
        object.__setattr__(self, "metric", metric_of(self.subject, self.metric))
        for name, allowed in (("subject", SUBJECTS), ("per", UNITS), ("phase", (None, "powerplay", "middle", "death")), ("innings", (None, 1, 2)), ("stage", (None, "final", "playoff")), ("result", (None, "won", "lost")), ("toss", (None, "won", "lost")), ("venue_type", (None, "home", "away"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} is {getattr(self, name)!r}; allowed: {', '.join(map(str, allowed))}")
        if self.split is not None and self.split not in splits(self.subject):
            raise ValueError(f"unknown split {self.split!r}")
        for name in ("years", "overs", "wickets_in_hand", "batter_balls"):
            r = getattr(self, name)
            if r is not None and r[0] > r[1]:
                raise ValueError(f"{name}: {r[0]} > {r[1]}")
        if self.players and self.subject not in ("batter", "bowler"):
            raise ValueError("players need subject batter or bowler")

    @property
    def needs_state(self) -> bool:
        """Whether a filter looks at the match state before the ball (else its windows are left out)."""
        return any(getattr(self, n) is not None for n in ("target_min", "target_max", "rrr_min", "rrr_max", "wickets_in_hand", "batter_balls"))

    @property
    def is_chase(self) -> bool:
        """Whether a revised target would not compare: such matches are then left out."""
        return (self.innings == 2 and self.result is not None) or any(getattr(self, n) is not None for n in ("target_min", "target_max", "rrr_min", "rrr_max"))

    def describe(self) -> str:
        """Subject, metric and every filter that is set, in words."""
        said = [f"{f.name.replace('_', ' ')} {getattr(self, f.name)}" for f in fields(self) if f.name not in ("subject", "metric", "limit") and getattr(self, f.name) != f.default]
        return f"{self.subject} by {self.metric}" + (": " + ", ".join(said) if said else "")


def _balls(a: Archive, s: SliceSpec, balls_in_innings: int, home: dict) -> DataFrame:
    """Context: qualifying balls with k, name, s, u, measures, and the selection as sel and sel_out."""
    team, other, key, name = sides(s.subject)
    a = a.years(*(s.years or (None, None)))
    x = match_state(a.d, balls_in_innings) if s.needs_state else a.d
    m = a.matches.select("match_id", F.coalesce(franchise(c("winner")), F.lit("")).alias("won"), "status_text")
    x = x.join(m, "match_id")
    if s.toss or s.split == "toss":
        x = x.join(a.info.select("match_id", franchise(c("toss_winner")).alias("toss_won")), "match_id", "left")
    if s.bowl_kind or s.split == "bowl_kind":
        x = x.join(a.styles.select(c("player_id").alias("bowler_id"), "bowl_kind"), "bowler_id", "left")
    if s.bat_hand or s.split == "bat_hand":
        x = x.join(a.styles.select(c("player_id").alias("batter_id"), "bat_hand"), "batter_id", "left")
    keep: list[Column] = []
    between = lambda col, r: keep.append(c(col).between(*r)) if r else None
    equal = lambda col, v: keep.append(c(col) == v) if v is not None else None
    between("over_number", s.overs)
    equal("phase", s.phase)
    equal("inning", s.innings)
    between("wkts_in_hand", s.wickets_in_hand)
    between("bat_ball_no", s.batter_balls)
    equal("bowl_kind", s.bowl_kind)
    equal("bat_hand", s.bat_hand)
    if s.stage:
        keep.append((is_final if s.stage == "final" else is_playoff)(c("match_title")))
    if s.result:
        keep.append(c("won") == team if s.result == "won" else (c("won") != team) & (c("won") != ""))
    if s.toss:
        keep.append(c("toss_won") == team if s.toss == "won" else c("toss_won") != team)
    if s.venue:
        keep.append(ground(c("venue")) == F.lit(best_matching_ground(a, s.venue)))
    if s.is_chase:
        keep.append(~rain_revised(c("status_text")))
    if s.target_min is not None:
        keep.append((c("inning") == 2) & (c("first_total") + 1 >= s.target_min))
    if s.target_max is not None:
        keep.append((c("inning") == 2) & (c("first_total") + 1 <= s.target_max))
    if s.rrr_min is not None:
        keep.append(c("rrr") > s.rrr_min)
    if s.rrr_max is not None:
        keep.append(c("rrr") < s.rrr_max)
    if s.venue_type:
        h = home_grounds(a.matches, **home).select(c("year").alias("__y"), c("team").alias("__t"), c("ground").alias("__g"))
        x = x.join(h, (c("year") == c("__y")) & ((team if s.venue_type == "home" else other) == c("__t")))
        keep.append(ground(c("venue")) == c("__g"))
    for k in keep:
        x = x.filter(k)
    sel, sel_out = F.lit(True), F.lit(True)
    if s.players:
        sel &= key.isin(*s.players)
        sel_out &= c("player_out_id").isin(*s.players)
    both = F.lit(True)
    if s.vs is not None:
        both &= c("batter_id" if s.subject in ("bowler", "bowling_team") else "bowler_id") == s.vs
    if s.team:
        both &= team == s.team
    if s.opposition:
        both &= other == s.opposition
    unit = {"career": F.lit(""), "season": c("year").cast("string"), "match": c("match_id").cast("string")}[s.per]
    split = splits(s.subject)[s.split] if s.split else F.lit("")
    return x.select(
        "match_id", "inning", "year", "is_wicket", "player_out_id", "batting_team", key.alias("k"), name.alias("name"), split.alias("s"), unit.alias("u"),
        *(v.alias(n) for n, v in measures(s.subject).items()), (sel & both).alias("sel"), (sel_out & both).alias("sel_out"),
    )


def _high_scores(a: Archive, s: SliceSpec, f: DataFrame) -> DataFrame:
    inns = f.filter("sel").groupBy("k", "match_id", "inning").agg(F.max("name").alias("name"), F.max("batting_team").alias("team"), F.sum("R").alias("runs"), F.sum("B").alias("balls"), F.sum("W").alias("wickets"))
    if s.subject == "batter":  # out or not is judged within the slice
        outs = f.filter("is_wicket").select("match_id", "inning", c("player_out_id").alias("k")).distinct().withColumn("out", F.lit(True))
        inns = inns.join(outs, ["match_id", "inning", "k"], "left")
        score = innings_text(c("runs"), c("out").isNotNull())
    else:
        score = score_text(c("runs"), c("wickets"))
    out = inns.join(a.matches.select("match_id", "start_date"), "match_id").select("match_id", "inning", "name", "team", score.alias("score"), "runs", "balls", "start_date", "k")
    out = out.orderBy(c("runs").desc(), "balls", "match_id", "inning", "k").drop("k")
    return out.limit(s.limit) if s.limit else out


def _innings_counts(s: SliceSpec, f: DataFrame) -> DataFrame:
    inns = f.filter("sel").groupBy("k", "u", "match_id", "inning").agg(F.max("name").alias("name"), F.sum("R").alias("runs"))
    outs = f.filter("is_wicket").select("match_id", "inning", c("player_out_id").alias("k")).distinct().withColumn("out", F.lit(True))
    inns = inns.join(outs, ["match_id", "inning", "k"], "left").withColumn("is_out", c("out").isNotNull())
    out = inns.groupBy("k", "u").agg(F.max("name").alias("name"), F.count_if(METRICS[s.metric].innings()).alias("n"), F.count(F.lit(1)).alias("innings"), F.sum("runs").alias("runs")).filter("n > 0")
    out = out.orderBy(c("n").desc(), "innings", "name", "k", "u")
    return out.limit(s.limit) if s.limit else out


def slice_stats(a: Archive, s: SliceSpec, balls_in_innings: int = 120, home: dict | None = None) -> DataFrame:
    """The slice as one plan: k, name, s, u, value, index and shrunk where asked for, R, B, W, and the other measures.

    adjust: index = 100 * num / sum over seasons of den * the league's rate.  shrink: empirical Bayes, towards the
    league's rate by k = sampling variance / variance between subjects (all the way if that is not positive).
    """
    m = METRICS[s.metric]
    f = _balls(a, s, balls_in_innings, home or {})
    if s.metric == "high_score":
        return _high_scores(a, s, f)
    if m.innings is not None:
        return _innings_counts(s, f)
    own = ["k", "s", "u"]
    rows = f.filter("sel").groupBy(*own).agg(F.max("name").alias("name"), *(F.sum(x).alias(x) for x in ("R", "B", "W", "DOT", "BND", "F4", "S6")), F.count_distinct(F.struct("match_id", "inning")).alias("inns"))
    if s.subject == "batter":
        outs = f.filter("is_wicket and sel_out").groupBy(c("player_out_id").alias("k"), "s", "u").agg(F.count(F.lit(1)).alias("__outs"))
        rows = rows.join(outs, own, "left").withColumn("W", F.coalesce("__outs", F.lit(0))).drop("__outs")
    num, den = c(m.num).cast("double"), F.nullif(c(m.den).cast("double"), F.lit(0.0)) if m.den else None
    rows = rows.withColumn("value", num if m.den is None else num / den * F.lit(float(m.scale)))
    if m.den:
        by_year = f.groupBy("year").agg(F.sum(m.num).alias("__num"), F.sum(m.den).alias("__den"), F.var_pop(F.when(c(m.den) == 1, c(m.num))).alias("__v"))
    rank = "value"
    if m.den and s.shrink and m.den == "B":
        league = by_year.agg((F.sum("__num") / F.nullif(F.sum("__den").cast("double"), F.lit(0.0))).alias("__p0"), (F.sum(F.coalesce("__v", F.lit(0.0)) * c("__den")) / F.nullif(F.sum("__den").cast("double"), F.lit(0.0))).alias("__s2"))
        with_p = rows.crossJoin(league)  # one row
        spread = with_p.filter("B > 0").agg(F.sum(c("B") * F.pow(num / c("B") - c("__p0"), F.lit(2))).alias("__spread"), F.count(F.lit(1)).alias("__n"), F.sum("B").alias("__balls"))
        x = with_p.crossJoin(spread)
        tau2 = (c("__spread") - c("__n") * c("__s2")) / c("__balls")
        k = c("__s2") / tau2
        shrunk = F.when(tau2 > 0, (num + k * c("__p0")) / (c("B") + k)).otherwise(c("__p0")) * F.lit(float(m.scale))
        rows, rank = x.withColumn("shrunk", rounded(shrunk, 2)).drop("__p0", "__s2", "__spread", "__n", "__balls"), "shrunk"
    if m.den and s.adjust:
        rate = by_year.select("year", (c("__num") / F.nullif(c("__den").cast("double"), F.lit(0.0))).alias("__rate"))
        mix = f.filter("sel").groupBy(*own, "year").agg(F.sum(m.den).alias("__d")).join(rate, "year", "left")
        due = mix.groupBy(*own).agg(F.sum(c("__d") * F.coalesce("__rate", F.lit(0.0))).alias("__due"))
        rows = rows.join(due, own, "left").withColumn("index", rounded(F.lit(100.0) * num / F.nullif(c("__due"), F.lit(0.0)), 2)).drop("__due")
        rank = "index"
    solo = s.subject not in ("batter", "bowler") or bool(s.players)
    least = s.least_balls if s.least_balls is not None else 0 if m.den is None or solo else 500 if s.adjust else 60
    rows = rows.filter(c("value").isNotNull() & (c("B") >= least))
    if m.den == "W":
        rows = rows.filter(c("W") >= (1 if solo else 3))
    rows = rows.withColumn("value", rounded(c("value"), 2))
    key = c(rank).desc_nulls_last() if m.higher_is_better != s.worst else c(rank).asc_nulls_last()
    order = ["name", "s"] if s.split and (s.subject == "league" or s.players) else [key]
    out = rows.orderBy(*order, "k", "s", "u")
    return out.limit(s.limit) if s.limit else out
