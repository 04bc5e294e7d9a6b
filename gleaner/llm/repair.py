"""Conversation structure repair by branch and bound.

A conversation is repaired by the cheapest edits that leave no blank and no repeated row and whose role initials
read `(s?(ua)+)?`. Rows are first reduced to one sign each (`DELETED`, or the role's initial, in capitals where the
row is truncated); the search sees these signs only. It goes depth first with an explicit stack over nodes
(rows read, state of the pattern):

- Suffix lower bounds: the least cost from each node to the end, found backwards, ties ignored.
- The incumbent (cost, audit) is what a prefix must be able to beat: cost so far and bound together.
- Edits are tried in ASCII order, so prefixes come in order of their audit. Each node's dominance table holds
  the cost of the first prefix that came: a later one that is not cheaper is worse in (cost, audit) and dropped.

The search ends with an empty stack: everything left out is proved not to be better.

Long conversations are cut into chunks of bounded size. A chunk is searched for every pair of entry and exit
states; a second search of the same kind goes over the chunks in order, with at most one best prefix per
state, and hands on what all of them agree in. Texts are joined to the edits at the end, chunk by chunk.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import digest_of_pieces, in_order
from gleaner.session import write_table

# Costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
# A chunk holds 2^20 bytes of text, each row counted as LEAST_ROW bytes at least, and the row that crosses them.
CHUNK_BITS, LEAST_ROW = 20, 64
BLANK = " \t\n\x0b\x0c\r"
DELETED = "D"
# States of the pattern: nothing yet, after s, after u, after a; FULL are those that may be last.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
FULL = (START, ASSISTANT)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
# The one role that an inserted or reroled row can have, told by the state after it.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
PLANS = "array<struct<entry:int,exit:int,cost:long,audit:string>>"

# Tasks get this module's functions with the job; executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def moves(sign: str | None, state: int) -> list[tuple[str, int, int, int]]:
    """(edit, cost, rows read, state after), in ASCII order; `sign` is None behind the last row."""
    insert = ("I", INSERT, 0, NEXT[state])
    if sign is None:
        return [insert]
    out = [("D", DELETE, 1, state), insert]
    if sign != DELETED:
        initial, more = sign.lower(), TRUNCATED if sign.isupper() else 0
        if (state, initial) in KEPT:
            out.append(("K", more, 1, KEPT[state, initial]))
        out.append(("R", REROLE + more, 1, NEXT[state]))
    return out


def suffix_bounds(signs: str, exits: tuple[int, ...]) -> list[list[float]]:
    """bounds[i][state]: the least cost of edits from row i on that end in one of `exits`."""
    ends = [0.0 if state in exits else float("inf") for state in STATES]
    bounds = []
    for sign in [None, *reversed(signs)]:
        below = ends if sign is None else [min(c + bounds[-1][to] for _, c, read, to in moves(sign, s) if read) for s in STATES]
        # Two insertions reach every state that any number of them reaches.
        for _ in range(2):
            below = [min(below[s], INSERT + below[NEXT[s]]) for s in STATES]
        bounds.append(below)
    return bounds[::-1]


def search(signs: str, entry: int = START, exits: tuple[int, ...] = FULL) -> tuple[int, str, int] | None:
    """(cost, audit, exit) of the cheapest edits, the ASCII-least of equal cost; None if no edits lead to an exit."""
    bounds = suffix_bounds(signs, exits)
    if bounds[0][entry] == float("inf"):
        return None
    incumbent, least = None, bounds[0][entry]
    dominance: dict[tuple[int, int], float] = {}
    path: list[str] = []
    stack = [(0, "", 0, entry, 0)]
    while stack:
        depth, edit, at, state, cost = stack.pop()
        # What comes now has an audit after all that came before, so equal costs do not help it.
        if cost + bounds[at][state] > least or (incumbent and cost + bounds[at][state] >= incumbent[0]):
            continue
        if dominance.get((at, state), float("inf")) <= cost:
            continue
        dominance[at, state] = cost
        path[max(0, depth - 1) :] = [edit]
        if at == len(signs) and state in exits:
            incumbent = (cost, "".join(path), state)
        for letter, more, read, to in reversed(moves(signs[at] if at < len(signs) else None, state)):
            stack.append((depth + 1, letter, at + read, to, cost + more))
    return incumbent


def plans(signs: str, first: bool, last: bool) -> list[dict]:
    """The best edits of a chunk: one entry for the first, either full state for the last, else each state apart."""
    found = []
    for entry in (START,) if first else STATES:
        for exits in (FULL,) if last else [(state,) for state in STATES]:
            if best := search(signs, entry, exits):
                found.append({"entry": entry, "exit": best[2], "cost": best[0], "audit": best[1]})
    return found


def actions(audit: str, entry: int, signs: str) -> list[str]:
    """For each row `before action after`: initials of the rows inserted there and what becomes of it:
    `=` kept, `-` deleted, `U` or `A` reroled. Only the last row has rows inserted after it."""
    out, before, state, at = [], "", entry, 0
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            before += ROLES[state][0]
            continue
        if edit == "K":
            state, action = KEPT[state, signs[at].lower()], "="
        elif edit == "R":
            state = NEXT[state]
            action = ROLES[state][0].upper()
        else:
            action = "-"
        out.append(f"{before} {action} ")
        before, at = "", at + 1
    out[-1] += before
    return out


def _plans(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for columns in batches:
        yield pd.Series([plans(*row) for row in zip(*columns)], dtype=object)


def _actions(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for columns in batches:
        yield pd.Series([actions(*row) for row in zip(*columns)], dtype=object)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order of (key, chunk) to the chosen plan of each: key, chunk, entry, cost, audit.

    `best` holds per state the cheapest prefix of plans, ASCII-least of equal cost. Plans at the beginning of all
    prefixes are settled and handed on, so only what the states differ in is held.
    """
    names = ["key", "chunk", "entry", "cost", "audit"]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, types)], names=names)

    last, best = None, {}
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if row["key"] != last:
                last, best = row["key"], {START: (0, [])}
            reached: dict[int, tuple] = {}
            for plan in row["plans"]:
                if plan["entry"] not in best:
                    continue
                cost, before = best[plan["entry"]]
                mine = (cost + plan["cost"], [*before, (row["key"], row["chunk"], plan["entry"], plan["cost"], plan["audit"])])
                other = reached.get(plan["exit"])
                if other is None or (mine[0], "".join(p[4] for p in mine[1])) < (other[0], "".join(p[4] for p in other[1])):
                    reached[plan["exit"]] = mine
            if row["last"]:
                done += min(reached.values(), key=lambda found: (found[0], "".join(p[4] for p in found[1])))[1]
                best = {}
                continue
            best = reached
            one = next(iter(best.values()))[1]
            while one and all(found[1] and found[1][0] == one[0] for found in best.values()):
                settled = one[0]
                best = {state: (cost, rest[1:]) for state, (cost, rest) in best.items()}
                one = next(iter(best.values()))[1]
                done.append(settled)
        yield table(done)


@dataclass(frozen=True)
class Repair:
    """`rows`: key, pos, chunk, turn, one, two, blank, duplicate, truncated, initial; `plans`: key, chunk, cost, audit,
    illegal; `turns`: key, chunk, pos, said (array of role, text), a row for each row that leaves or brings turns.
    `key` is the id as text, '' for NULL."""

    rows: DataFrame
    plans: DataFrame
    turns: DataFrame


def _keyed(conversations: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    return conversations.select(
        key.alias("key"), "turn", role.alias("role"), text.alias("text"), F.xxhash64(role, text).alias("one"), F.xxhash64(text, F.lit(1), role).alias("two")
    )


def _judged(keyed: DataFrame, chunk_bits: int) -> DataFrame:
    """One narrow row per row with its place, chunk and first fault; two hashes stand for role and text."""
    tie = F.substr(F.concat("role", F.lit("\0"), "text"), F.lit(1), F.lit(64)).alias("tie")
    blanks = F.lit(BLANK)
    end = F.right(F.rtrim(F.col("text"), blanks), F.lit(1))
    narrow = keyed.select(
        "key", "turn", tie, "one", "two", F.left("role", F.lit(1)).alias("initial"), (F.btrim("text", blanks) == "").alias("blank"),
        (~end.isin(".", "!", "?")).alias("open"), F.greatest(F.lit(LEAST_ROW), F.octet_length("role") + F.octet_length("text")).alias("bytes"),
    )
    placed = in_order(narrow, "key", ["turn", "tie", "one", "two"], "bytes")
    placed = write_table(placed.withColumn("chunk", F.shiftright("before", chunk_bits)).drop("tie", "bytes", "before"), "placed")
    firsts = placed.groupBy("key", "one", "two").agg(F.min("pos").alias("pos")).select("key", "pos", F.lit(True).alias("first"))
    known = placed.join(firsts, ["key", "pos"], "left")
    duplicate = ~F.col("blank") & F.col("first").isNull()
    judged = known.withColumn("duplicate", duplicate).withColumn("truncated", ~F.col("blank") & ~duplicate & F.col("open"))
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    return write_table(judged.withColumn("initial", initial).drop("first", "open"), "judged")


def _planned(rows: DataFrame) -> DataFrame:
    """(key, chunk, start, signs, entry, cost, audit, illegal): the chosen edits of each chunk."""
    sign = F.when(F.col("blank") | F.col("duplicate"), DELETED).when(F.col("truncated"), F.upper("initial")).otherwise(F.col("initial"))
    said = F.array_sort(F.collect_list(F.struct("pos", sign.alias("sign"), "initial")))
    cut = rows.groupBy("key", "chunk").agg(said.alias("said"))
    signs, initials = (F.array_join(F.transform("said", lambda x: x[c]), "").alias(c) for c in ("sign", "initial"))
    cut = cut.select("key", "chunk", F.col("said")[0]["pos"].alias("start"), signs, initials)
    in_turn = Window.partitionBy("key").orderBy("chunk")
    # One row per chunk: the sign before it, and whether it is the first or last.
    seen = cut.withColumn("initials", F.concat(F.coalesce(F.lag(F.right("initial", F.lit(1))).over(in_turn), F.lit("")), "initial"))
    seen = seen.withColumns({"is_first": F.lag("chunk").over(in_turn).isNull(), "is_last": F.lead("chunk").over(in_turn).isNull()})
    legal = F.regexp_count("initials", F.lit("(?=su|ua|au)"))
    illegal = (F.length("initials") - 1 - legal).cast("long").alias("illegal")
    found = F.pandas_udf(_plans, PLANS)("sign", "is_first", "is_last")
    tried = write_table(seen.select("key", "chunk", "start", "sign", illegal, "is_first", "is_last", found.alias("plans")), "plans")
    alone = F.col("is_first") & F.col("is_last")
    direct = tried.where(alone).select("key", "chunk", *[F.col("plans")[0][c].alias(c) for c in ("entry", "cost", "audit")])
    several = tried.where(~alone).select("key", "chunk", F.col("is_last").alias("last"), "plans")
    chained = several.repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(_chain, direct.schema)
    return write_table(tried.select("key", "chunk", "start", "sign", "illegal").join(direct.unionByName(chained), ["key", "chunk"]), "planned")


def _said(keyed: DataFrame, rows: DataFrame, planned: DataFrame) -> DataFrame:
    """The turns that each row leaves. Only kept and reroled rows need their text, and no two of a
    conversation have the same role and text, so one joins by that."""
    done = F.pandas_udf(_actions, "array<string>")("audit", "entry", "sign")
    edits = planned.select("key", "chunk", "start", F.posexplode(done).alias("at", "action"))
    split = F.split("action", " ")
    edits = edits.select("key", "chunk", (F.col("start") + F.col("at")).alias("pos"), *[split[i].alias(c) for i, c in enumerate(("ahead", "action", "behind"))])
    edits = write_table(edits.where("action <> '-' or ahead <> '' or behind <> ''").join(rows.select("key", "pos", "one", "two"), ["key", "pos"]), "edits")

    def inserted(initials: str) -> Column:
        signs = F.filter(F.split(initials, ""), lambda x: x != "")
        return F.transform(signs, lambda x: F.struct(F.when(x == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")))

    texts = keyed.groupBy("key", "one", "two").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    role = F.when(F.col("action") == "U", "user").when(F.col("action") == "A", "assistant").otherwise(F.col("role"))
    own = F.array(F.struct(role.alias("role"), "text"))
    kept = edits.where("action <> '-'").join(texts, ["key", "one", "two"])
    kept = kept.select("key", "chunk", "pos", F.concat(inserted("ahead"), own, inserted("behind")).alias("said"))
    gone = edits.where("action = '-'").select("key", "chunk", "pos", F.concat(inserted("ahead"), inserted("behind")).alias("said"))
    return kept.unionByName(gone)


def repair(conversations: DataFrame, chunk_bits: int = CHUNK_BITS) -> Repair:
    """Faults, cheapest edits and repaired turns of (conv_id, turn, role, text).

    Rows are in order of turn (NULL first), ties of the first 64 characters of role and text, then of their hashes. NULL
    role or text is one space; rows of NULL conv_id are one conversation; repeated rows are duplicates, each
    but the first; other columns are ignored. A role is known by its first character; one that is none of s, u, a can
    be reroled or deleted. `chunk_bits` moves work between tasks, never results.
    """
    keyed = _keyed(conversations)
    rows = _judged(keyed, chunk_bits)
    planned = _planned(rows)
    return Repair(rows, planned, _said(keyed, rows, planned))


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations, `place` ordering the turns of each."""
    said = repair(conversations).turns.select("key", "pos", F.posexplode("said").alias("at", "turn"))
    return said.select(F.expr("cast(nullif(key, '') as long)").alias("conv_id"), F.struct("pos", "at").alias("place"), "turn.role", "turn.text")


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's damage: crc32 of `conv_id:turn` modulo 20 says what happens to a row; NULLs are one space."""
    space = F.lit(" ")
    which = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])) % 20
    hit = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), which.alias("hit")).where("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


def op12_structure_repair(conversations: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    found = repair(damage(conversations), chunk_bits)
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    faults = found.rows.groupBy("key").agg(span.alias("gaps"), *[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")])
    audits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]), "")
    costs = found.plans.groupBy("key").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), audits.alias("audit"))
    line = F.array_join(F.transform("said", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    lines = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    pieces = found.turns.groupBy("key", F.col("chunk").alias("no")).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("piece"))
    digests = digest_of_pieces(pieces, ["key"], "\n").withColumnRenamed("sha256", "repaired_sha256")
    every = conversations.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key")).distinct()
    whole = every.join(faults, "key", "left").join(costs, "key", "left").join(digests, "key", "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return whole.select(
        "conv_id", *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
