"""Ordered state over a feed that comes out of order: scores by ball and clusters of wickets as a stream.

A ball waits in its innings' state until the watermark has passed it; balls then leave in order of time and sequence,
so what is computed is what a batch over the same balls would compute.  Balls behind the watermark are dropped.  Event-time timers release the balls and end an innings that has had none for a while.  Both operators give
rows in append mode and take no session settings but the state store, which must be RocksDB.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import as_count, score_text
from ..operators.match_flow import CLUSTER_GAP, INNINGS, LEAST_BALLS, cluster_shifts

c = F.col
#: What both operators read of a ball, `at` being its time in milliseconds.
BALL = "at long, sequence long, runs long, wicket long, legal long, over_number long, batting string, bowling string"
NAMES = [x.split()[0] for x in BALL.split(", ")]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedBalls(StatefulProcessor):
    """Hands an innings' balls to `step` in order, once the watermark has passed them.

    carried: schema of the state that goes from ball to ball, start: its first value.  listed: schema of rows that go
    with it, as the state's last item.  An innings without a ball for `idle` milliseconds of event time is over: `end`
    gives its last rows and its state goes.
    """

    carried, start, listed, output, idle = "n long", (0,), "n long", "n long", None

    def step(self, state: list, ball: dict) -> Iterable[tuple]:
        return ()

    def end(self, state: list) -> Iterable[tuple]:
        return ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", BALL)
        self.state = handle.getValueState("state", f"{self.carried}, last_at long")
        self.rows = handle.getListState("rows", self.listed)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due, passed = None, timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            pdf = pdf[pdf["at"] >= passed]  # later ones would come after balls that have left
            if len(pdf):
                self.waiting.appendList([tuple(map(_plain, r)) for r in pdf[NAMES].itertuples(index=False, name=None)])
                due = min(int(pdf["at"].min()), due if due is not None else 1 << 62)
        if due is not None:
            self.handle.registerTimer(due + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        balls = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [b for b in balls if b[0] < passed], [b for b in balls if b[0] >= passed]
        *state, last = self.state.get() if self.state.exists() else (*self.start, None)
        state.append([tuple(r) for r in self.rows.get()] if self.rows.exists() else [])
        out: list[tuple] = []
        for b in ready:
            if self.idle is not None and last is not None and b[0] - last > self.idle:  # the innings had ended before this ball
                out += self.end(state)
                state = [*self.start, []]
            out += self.step(state, dict(zip(NAMES, b, strict=True)))
            last = b[0]
        over = self.idle is not None and last is not None and not rest and passed > last + self.idle
        if over:
            out += self.end(state)
            for kept in (self.state, self.waiting, self.rows):
                kept.clear()
        elif last is not None:
            self.state.update((*state[:-1], last))
            if ready:
                self.waiting.put(rest) if rest else self.waiting.clear()
                self.rows.put(state[-1]) if state[-1] else self.rows.clear()
            if rest:
                self.handle.registerTimer(rest[0][0] + 1)
            elif self.idle is not None:
                self.handle.registerTimer(last + self.idle + 1)
        if out:
            names = [x.split()[0] for x in self.output.split(", ")]
            yield pd.DataFrame([(*key, *r) for r in out], columns=names)

    def close(self) -> None:
        pass


def _plain(x):
    """A cell of a pandas frame as the state's encoder takes it."""
    return None if x is None or (isinstance(x, float) and x != x) else x.item() if hasattr(x, "item") else x


class _Scores(OrderedBalls):
    """Runs and wickets up to and with each ball."""

    carried, start, output = "total long, down long", (0, 0), "match_id long, inning long, sequence long, total long, down long"

    def step(self, state, ball):
        state[0] += ball["runs"]
        state[1] += ball["wicket"]
        return [(ball["sequence"], state[0], state[1])]


class _Clusters(OrderedBalls):
    """Groups of wickets with at most `gap` legal balls from one to the next, told when the innings is over.

    The state has the innings' number of balls, runs and legal balls, and the groups so far, the last of which may go
    on: number, first and last ball, first and last over, and runs and legal balls before and after.
    """

    carried, start = "ball long, total long, legal long, batting string, bowling string", (0, 0, 0, None, None)
    listed = "n long, first_ball long, last_ball long, first_over long, last_over long, runs_before long, runs long, legal_before long, legal long"
    output = "match_id long, inning long, n long, first_ball long, last_ball long, first_over long, last_over long, wickets long, runs long, balls long, rate double, batting string, bowling string"

    def __init__(self, gap: int, idle_ms: int):
        self.gap, self.idle = gap, idle_ms

    def step(self, state, ball):
        state[0] += 1
        before, legal_before = state[1], state[2]
        state[1] += ball["runs"]
        state[2] += ball["legal"]
        state[3:5] = [max((x for x in (old, new) if x is not None), default=None) for old, new in zip(state[3:5], (ball["batting"], ball["bowling"]), strict=True)]
        if ball["wicket"]:
            groups, over = state[5], ball["over_number"]
            if groups and state[2] - groups[-1][8] <= self.gap:
                n, first, _, low, high, runs, _, legal, _ = groups.pop()
                groups.append((n + 1, first, state[0], min(low, over), max(high, over), runs, state[1], legal, state[2]))
            else:
                groups.append((1, state[0], state[0], over, over, before, state[1], legal_before, state[2]))
            # Single wickets of the past stay no group of two: only the last may still grow.
            state[5] = [g for g in groups[:-1] if g[0] > 1] + groups[-1:]
        return ()

    def end(self, state):
        ball, total, legal, batting, bowling, groups = state
        if ball >= LEAST_BALLS:
            for n, first, last, low, high, runs_before, runs, legal_before, legal_after in groups:
                yield n, first, last, low, high, n, runs - runs_before, legal_after - legal_before, total / max(legal, 1), batting, bowling


def _balls(d: DataFrame, ts: str, late: str) -> DataFrame:
    at = F.unix_millis(c(ts)).alias("at")
    long = lambda x, name: x.cast("long").alias(name)
    d = d.withColumn(ts, c(ts).cast("timestamp")).withWatermark(ts, late)
    return d.select(
        c(ts), *(c(k).cast("long").alias(k) for k in INNINGS), at, long(c("sequence"), "sequence"), long(c("runs_total"), "runs"), as_count(c("is_wicket")).alias("wicket"), as_count(c("is_legal")).alias("legal"),
        long(c("over_number"), "over_number"), c("batting_team").alias("batting"), c("bowling_team").alias("bowling"),
    )


def running_score(d: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """match_id, inning, sequence, score of each ball of a stream of deliveries, in whatever order they come."""
    out = _balls(d, ts, late).groupBy(*INNINGS).transformWithStateInPandas(_Scores(), _Scores.output, "append", "eventTime")
    return out.select(*INNINGS, "sequence", score_text(c("total"), c("down")).alias("score"))


def wicket_clusters(d: DataFrame, ts: str = "ts", late: str = "1 hour", gap: int = CLUSTER_GAP, idle: str = "12 hours") -> DataFrame:
    """match_flow.wicket_clusters of a stream: an innings' clusters come when it has had no ball for `idle`.

    A cluster's magnitude needs the rate of the whole innings, so none can come before its end.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    out = _balls(d, ts, late).groupBy(*INNINGS).transformWithStateInPandas(_Clusters(gap, idle_ms), _Clusters.output, "append", "eventTime")
    return cluster_shifts(out)
