"""Repair of conversation structure: the cheapest edits that make the roles of a conversation fit a grammar.

Role initials must read `(s?(ua)+)?`: nothing, or an optional system turn and then pairs of user and assistant.  The
grammar has four states: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn; 0 and
3 may be the end.  A forward Viterbi pass carries the least (cost, audit) of each state, the audit being the initials
of the edits so far; after each row at most two inserts close its layer.  Prefixes of equal cost over the same rows
never extend each other (an insert costs), so the least prefix gives the least audit.

A conversation is cut into blocks of turns.  One pass over a block gives its least (cost, audit) from each state to
each state, blocks being processed apart, and a pass over the blocks of each conversation puts these together.  So no
task needs the rows of a conversation together, however long it is, but for the digest over its whole repaired text,
which a stream of sorted rows feeds.  Equal rows of one turn travel as one row with their number.

Edits of a row: Keep 0, Rerole (to user or assistant) 1, Delete 2, which blank and duplicate rows must; a truncated row
that stays costs 5 more.  Insert (an empty user or assistant turn) costs 5.

Defined results: null role and text count as one space; null turns come first; rows of one turn follow each other by
role and text; a null conv_id is a conversation of its own; a conversation without rows has nothing to repair; empty
table, empty result; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, arrow_map, stored

SPACES, ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")
STATES, START, FINAL = range(4), 0, (0, 3)
#: State after a role's initial; what is missing does not fit.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
ROLES = {"u": "user", "a": "assistant"}
RENAME, DELETE, TRUNCATED, INSERT = 1, 2, 5, 5
#: Turns of a block.
BLOCK = 4096

Best = dict[int, tuple[int, str]]
#: Columns that order the rows of a conversation.
ORDER = ("conv_id", "block", "turn", "role", "text")


def _same(names: Iterable[str], left: str = "l", right: str = "r") -> Column:
    """Equality of columns of two aliased frames, nulls alike."""
    return reduce(Column.__and__, (F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names))


def conversation_rows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, weight (1): null roles and texts are one space."""
    filled = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    return turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), filled(role).alias("role"), filled(text).alias("text"), F.lit(1).cast("long").alias("weight"))


def damaged(rows: DataFrame, modulus: int = 20) -> DataFrame:
    """Rows with faults put in by crc32(`conv_id:turn`) % modulus: 0 goes, 1 is emptied, 2 loses its `.!?`, 3 comes twice, 4 becomes the user's."""
    name = lambda k: F.coalesce(F.col(k).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % modulus
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = rows.withColumn("kind", kind).filter("kind <> 0")
    return out.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, F.col("weight") * 2).otherwise(F.col("weight")).alias("weight"))


def faults(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, block, turn, role, text, n, blank, seen, truncated: equal rows of a turn as one, with their number.

    seen: role and text are in an earlier turn, so all n are duplicates; else all but one are.
    """
    own = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("weight").alias("n"))
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = rows.groupBy("conv_id", "role", "text").agg(F.min(at).alias("first"))
    met = own.alias("l").join(first.alias("r"), _same(("conv_id", "role", "text"))).select("l.*", "r.first")
    said = F.rtrim("text", F.lit(SPACES))
    blank = said == ""
    return met.select(
        "conv_id", F.expr(f"turn div {block}").alias("block"), "turn", "role", "text", "n", blank.alias("blank"),
        (~blank & (at > F.col("first"))).alias("seen"), (~blank & (at == F.col("first")) & ~F.right(said, F.lit(1)).isin(*ENDS)).alias("truncated"),
    )


def counts(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated from the rows of faults()."""
    turn = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    duplicate = F.when(F.col("blank"), 0).when(F.col("seen"), F.col("n")).otherwise(F.col("n") - 1)
    return rows.groupBy("conv_id").agg(
        F.coalesce(turn, F.lit(0)).alias("gaps"), F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"), F.sum(duplicate).alias("duplicate"), F.count_if("truncated").alias("truncated"),
    )


def _better(best: Best, state: int, cost: int, audit: str) -> None:
    if state not in best or (cost, audit) < best[state]:
        best[state] = (cost, audit)


def closed(best: Best) -> Best:
    """A layer with what inserts reach: a user turn, then an assistant's; more of them come back to where they were."""
    for initial in "ua":
        for state, (cost, audit) in list(best.items()):
            if (state, initial) in NEXT:
                _better(best, NEXT[state, initial], cost + INSERT, audit + "I")
    return best


def after(best: Best, initial: str, must_go: bool, truncated: bool) -> Best:
    """The layer after a row."""
    out: Best = {}
    more = TRUNCATED if truncated else 0
    for state, (cost, audit) in best.items():
        _better(out, state, cost + DELETE, audit + "D")
        if not must_go:
            if (state, initial) in NEXT:
                _better(out, NEXT[state, initial], cost + more, audit + "K")
            for other in ROLES:
                if (state, other) in NEXT:
                    _better(out, NEXT[state, other], cost + RENAME + more, audit + "R")
    return closed(out)


def _read(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _written(rows: Iterable[tuple], schema: pa.Schema, size: int = 500):
    rows = iter(rows)
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def _elements(n: int, blank: bool, seen: bool, truncated: bool) -> Iterator[tuple[bool, bool]]:
    """(must go, truncated) of each of n equal rows."""
    yield blank or seen, truncated
    for _ in range(n - 1):
        yield True, False


def block_costs(rows: DataFrame) -> DataFrame:
    """conv_id, block, steps, head, tail, illegal: for each block the least cost and audit between any two states.

    steps: (entry, exit, cost, audit).  head and tail: initials of its first and last row.  illegal: neighbours within
    the block whose initials are none of su, ua, au.
    """
    kinds = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))

    def each(batches):
        for key, group in groupby(_read(batches), key=lambda r: r[:2]):
            best, head, tail, illegal = {s: {s: (0, "")} for s in STATES}, None, None, 0
            for _, _, _, role, _, n, blank, seen, truncated in group:
                initial = role[:1]
                head = initial if head is None else head
                illegal += (tail is not None and not _fits(tail, initial)) + (n - 1) * (not _fits(initial, initial))
                tail = initial
                for must_go, cut in _elements(n, blank, seen, truncated):
                    best = {s: after(layer, initial, must_go, cut) for s, layer in best.items()}
            steps = [{"entry": s, "exit": t, "cost": cost, "audit": audit} for s, layer in best.items() for t, (cost, audit) in layer.items()]
            yield (*key, steps, head, tail, illegal)

    of = dict(rows.dtypes)["conv_id"]
    schema = lambda batch: pa.schema([batch.schema.field(0), batch.schema.field(1), ("steps", kinds), ("head", pa.string()), ("tail", pa.string()), ("illegal", pa.int64())])
    dealt = rows.repartition("conv_id", "block").sortWithinPartitions(*ORDER).select(*ORDER, "n", "blank", "seen", "truncated")
    return arrow_map(dealt, _mapped(each, schema), f"conv_id {of}, block long, steps array<struct<entry int, exit int, cost long, audit string>>, head string, tail string, illegal long")


def _fits(first: str, second: str) -> bool:
    return first + second in ("su", "ua", "au") and len(first) == len(second)


def _mapped(each, schema):
    """For mapInArrow: rows that `each` makes of all batches, as batches of schema(first batch)."""

    def run(batches):
        batches = iter(batches)
        first = next(batches, None)
        if first is not None:
            yield from _written(each(_chain(first, batches)), schema(first))

    return run


def _chain(first, rest):
    yield first
    yield from rest


def plans(blocks: DataFrame) -> DataFrame:
    """conv_id, cost, audit, illegal, edits: the blocks of each conversation put together.

    edits: (block, entry, audit) of each block on the cheapest way.
    """
    kinds = pa.list_(pa.struct([("block", pa.int64()), ("entry", pa.int32()), ("audit", pa.string())]))

    def each(batches):
        for (conv,), group in groupby(_read(batches), key=lambda r: r[:1]):
            # For each state the least cost and audit, and the way there: (way before, block, entry, audit of the block).
            layer = {s: (cost, audit, None) for s, (cost, audit) in closed({START: (0, "")}).items()}
            first, before, illegal = True, None, 0
            for _, block, steps, head, tail, own in group:
                illegal += own + (before is not None and not _fits(before, head))
                before, new = tail, {}
                for step in steps:
                    if (entry := step["entry"]) in layer:
                        cost, audit, way = layer[entry]
                        total = (cost + step["cost"], audit + step["audit"])
                        if step["exit"] not in new or total < new[step["exit"]][:2]:
                            # The inserts before the first row go with the first block, which then begins in START.
                            here = (block, START, audit + step["audit"]) if first else (block, entry, step["audit"])
                            new[step["exit"]] = (*total, (way, *here))
                layer, first = new, False
            cost, audit, way = min(layer[s] for s in FINAL if s in layer)
            edits = []
            while way is not None:
                way, block, entry, own = way
                edits.append({"block": block, "entry": entry, "audit": own})
            yield conv, cost, audit, illegal, edits[::-1]

    of = dict(blocks.dtypes)["conv_id"]
    schema = lambda batch: pa.schema([batch.schema.field(0), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64()), ("edits", kinds)])
    dealt = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return arrow_map(dealt, _mapped(each, schema), f"conv_id {of}, cost long, audit string, illegal long, edits array<struct<block long, entry int, audit string>>")


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """conv_id, block, place, turn, role, text, edit: the rows that stay, and inserted ones (turn null), in order of (block, place)."""

    def each(batches):
        for (conv, block), group in groupby(_read(batches), key=lambda r: r[:2]):
            place, state, letters = 0, None, None
            for _, _, turn, role, text, n, blank, seen, truncated, entry, audit in group:
                if letters is None:
                    state, letters = entry, iter(audit)
                for _ in range(n):
                    for letter in letters:
                        if letter != "D":
                            initial = role[:1] if letter == "K" else next(r for r in ROLES if (state, r) in NEXT)
                            state = NEXT[state, initial]
                            yield conv, block, place, None if letter == "I" else turn, role if letter == "K" else ROLES[initial], "" if letter == "I" else text, letter
                            place += 1
                        if letter != "I":
                            break
            for _ in letters:  # inserts after the last row
                initial = next(r for r in ROLES if (state, r) in NEXT)
                state = NEXT[state, initial]
                yield conv, block, place, None, ROLES[initial], "", "I"
                place += 1

    of = dict(rows.dtypes)["conv_id"]
    schema = lambda batch: pa.schema([batch.schema.field(0), batch.schema.field(1), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    edits = planned.select("conv_id", F.explode("edits").alias("e")).select("conv_id", "e.*")
    met = rows.alias("l").join(edits.alias("r"), _same(("conv_id", "block"))).select("l.*", "r.entry", "r.audit")
    dealt = met.repartition("conv_id", "block").sortWithinPartitions(*ORDER).select(*ORDER, "n", "blank", "seen", "truncated", "entry", "audit")
    return arrow_map(dealt, _mapped(each, schema), f"conv_id {of}, block long, place long, turn long, role string, text string, edit string")


def digests(lines: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of each conversation's `role:text` lines with newlines between them, row by row."""

    def each(batches):
        for (conv,), group in groupby(_read(batches), key=lambda r: r[:1]):
            digest, between = hashlib.sha256(), b""
            for *_, role, text in group:
                digest.update(between + f"{role}:{text}".encode())
                between = b"\n"
            yield conv, digest.hexdigest()

    of = dict(lines.dtypes)["conv_id"]
    dealt = lines.repartition("conv_id").sortWithinPartitions("conv_id", "block", "place").select("conv_id", "block", "place", "role", "text")
    return arrow_map(dealt, _mapped(each, lambda batch: pa.schema([batch.schema.field(0), ("repaired_sha256", pa.string())])), f"conv_id {of}, repaired_sha256 string")


def repair(rows: DataFrame, scratch: Scratch, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Of the rows of conversation_rows() or damaged(): the repaired rows, and by conversation gaps, faults, cost and audit.

    Both read tables in the scratch.  block: turns of a block.
    """
    told = scratch.stored(faults(rows, block), "conversation-rows")
    planned = scratch.stored(plans(block_costs(told)), "conversation-plans")
    both = counts(told).alias("l").join(planned.alias("r"), _same(("conv_id",)))
    return repaired(told, planned), both.select("l.*", "r.illegal", "r.cost", "r.audit")


def op12_role_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_digests(conversation_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet")), damaged)


def repaired_digests(rows: DataFrame, changed=lambda rows: rows, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of rows, after `changed`."""
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    with Scratch(rows.sparkSession) as scratch:
        lines, told = repair(changed(rows), scratch, block)
        every = rows.select("conv_id").distinct().alias("e").join(told.alias("t"), _same(("conv_id",), "e", "t"), "left").join(digests(lines).alias("d"), _same(("conv_id",), "e", "d"), "left")
        zero = [F.coalesce(f"t.{n}", F.lit(0)).cast("long").alias(n) for n in numbers]
        nothing = F.lit(hashlib.sha256().hexdigest())
        return stored(every.select("e.conv_id", *zero, F.coalesce("t.audit", F.lit("")).alias("audit"), F.coalesce("d.repaired_sha256", nothing).alias("repaired_sha256")), "conversation-repairs")
