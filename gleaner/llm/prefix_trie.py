"""Conversations rebuilt on shared heads, and the trie of their prefixes.

A rebuilt conversation is the first turns of its base followed by its own later turns. A sequence of turns
has the fingerprint sum(value(turn i) * G^i) modulo a prime, together with its length an element of a monoid:

    (m, x) + (n, y) = (m + n, x + G^m * y)

So prefixes are summed once over the conversations as they are stored, and the fingerprint of every rebuilt
prefix follows from them by one multiplication and one addition (`_heads`, `_prefixes`); no rebuilt text is
made and no text is moved for it. Four primes' worth of fingerprint (124 bits) and the depth name a node.

Nothing rests on luck: turns are known by references, each checked to stand for one stored (role, text), and the
members of a node must agree in the reference of their last turn and in their parent, hence by induction in
the whole prefix. Should two differ, all is done again with other constants.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import NON_BLANK, digest_of_pieces, in_order, running
from gleaner.session import write_table

LANES = 4
PRIME = 2**31 - 1
# Digits of a place within a conversation, base 16: up to 2^40 turns.
DIGITS = 10
# Turns of a conversation that one window sums; ids whose digits one piece holds.
CHUNK_BITS = 16
# The contract's rule: the base is the block's first conversation, heads have up to 3 turns.
BLOCK, HEADS = 20, 4
NODE = ["depth", "k1", "k2"]


@dataclass(frozen=True)
class Trie:
    """`nodes`: depth, k1, k2 (name), p1, p2 (the parent's), conv_id (smallest member), n_convs, n_children, words,
    one, two (reference of the last turn in `stored`). `prefixes`: conv_id, depth, k1, k2, length, ..., one row
    per rebuilt conversation and prefix. `stored`: one, two, role, text, the distinct turns."""

    nodes: DataFrame
    prefixes: DataFrame
    stored: DataFrame


def block_plan(conv_id: Column) -> tuple[Column, Column]:
    """(base, head) by the contract: the block's first id, and crc32 of the decimal id modulo 4."""
    return conv_id - conv_id % BLOCK, (F.crc32(conv_id.cast("string")) % HEADS).cast("int")


def _generators(attempt: int) -> list[int]:
    """Powers of 7, a generator of the prime's units, by exponents that differ with lane and attempt."""
    return [pow(7, 1_000_003 * (LANES * attempt + lane) + 524_287, PRIME) for lane in range(LANES)]


def _literals(values: list[int]) -> Column:
    return F.expr(f"array({','.join(f'{v}L' for v in values)})")


def _power(generator: int, exponent: Column) -> Column:
    """generator^exponent modulo the prime, digit by digit."""
    out = None
    for digit in range(DIGITS):
        table = _literals([pow(generator, d << 4 * digit, PRIME) for d in range(16)])
        factor = F.get(table, F.shiftright(exponent, 4 * digit).bitwiseAND(F.lit(15)).cast("int"))
        out = factor if out is None else out * factor % PRIME
    return out


def _packed(lanes: list[Column]) -> list[Column]:
    return [F.shiftleft(lanes[i], 31).bitwiseOR(lanes[i + 1]) for i in range(0, LANES, 2)]


def _reference(conversations: DataFrame, attempt: int) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"),
        F.xxhash64(F.lit(attempt), role, text).alias("one"), F.xxhash64(text, F.lit(~attempt), role).alias("two"),
    )


def _turns(referred: DataFrame, generators: list[int]) -> DataFrame:
    """One narrow row per stored turn: its place, reference and words; its term (t) in each lane and the sum (c) up to it."""
    tie = F.substr(F.concat("role", F.lit("\0"), "text"), F.lit(1), F.lit(64)).alias("tie")
    words = F.regexp_count("text", F.lit(f"{NON_BLANK}+")).cast("long").alias("words")
    narrow = referred.select("conv_id", "turn", tie, "one", "two", words, F.lit(1).alias("unit"))
    placed = in_order(narrow, "conv_id", ["turn", "tie", "one", "two"], "unit").select("conv_id", "pos", "one", "two", "words")
    values = [F.shiftrightunsigned(name, bits).bitwiseAND(F.lit(PRIME)) % PRIME for name in ("one", "two") for bits in (0, 31)]
    terms = {f"t{i}": v * _power(g, F.col("pos")) % PRIME for i, (v, g) in enumerate(zip(values, generators))}
    termed = placed.withColumns(terms).withColumn("chunk", F.shiftright("pos", CHUNK_BITS))
    summed = running(termed, "conv_id", "chunk", ["pos"], {f"c{i}": f"t{i}" for i in range(LANES)})
    return write_table(summed.withColumns({f"c{i}": F.col(f"c{i}") % PRIME for i in range(LANES)}), "turns")


def _heads(turns: DataFrame, generators: list[int], plan, longest: int) -> DataFrame:
    """One row per conversation: head (own turns left out), k (turns of the base), length (rebuilt), the base's
    first turns, and by lane `a`, `b`: a rebuilt prefix has the fingerprint a * (own prefix) + b."""
    kept = ["one", "two", "words", *[f"c{i}" for i in range(LANES)]]
    firsts = [F.max(F.when(F.col("pos") == at, F.col(c))).alias(f"{c}_{at}") for at in range(longest) for c in kept]
    convs = turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("n"), *firsts)
    base, head = plan(F.col("conv_id"))
    theirs = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), *[F.col(f"{c}_{at}").alias(f"base_{c}_{at}") for at in range(longest) for c in kept])
    both = convs.withColumns({"base": base, "head": head}).join(theirs, "base", "left")
    both = both.withColumn("k", F.least("head", F.coalesce("base_n", F.lit(0))).cast("int"))

    def upto(turns_taken: str, side: str, lane: int) -> Column:
        return F.coalesce(F.get(F.array(F.lit(0).cast("long"), *[F.col(f"{side}c{lane}_{at}") for at in range(longest)]), F.col(turns_taken)), F.lit(0))

    maps = {}
    for lane, g in enumerate(generators):
        back = F.get(_literals([pow(g, -gone, PRIME) for gone in range(longest + 1)]), F.col("head") - F.col("k"))
        maps[f"a{lane}"] = back
        maps[f"b{lane}"] = (upto("k", "base_", lane) + PRIME - back * upto("head", "", lane) % PRIME) % PRIME
    both = both.withColumns(maps).withColumn("length", F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("head")))
    return write_table(both, "heads")


def _prefixes(turns: DataFrame, heads: DataFrame, longest: int) -> DataFrame:
    """One row per rebuilt conversation and prefix, the empty one included."""
    columns = ["conv_id", "depth", "k1", "k2", "p1", "p2", "one", "two", "words", "length"]
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")

    def row(depth: Column, key: list[Column], parent: list[Column], one: Column, two: Column, words: Column) -> list[Column]:
        values = [F.col("conv_id"), depth.cast("long"), *key, *parent, one, two, words, F.col("length").cast("long")]
        return [v.alias(c) for v, c in zip(values, columns)]

    roots = heads.select(*row(zero, [zero, zero], [none, none], none, none, zero))
    shared = heads.where("k > 0").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))

    def pick(name: str, at: Column) -> Column:
        return F.get(F.array(*[F.col(f"base_{name}_{i}") for i in range(longest)]), at)

    key = [pick(f"c{i}", F.col("at")) for i in range(LANES)]
    parent = [F.coalesce(pick(f"c{i}", F.col("at") - 1), zero) for i in range(LANES)]
    of_base = shared.select(*row(F.col("at") + 1, _packed(key), _packed(parent), *(pick(c, F.col("at")) for c in ("one", "two", "words"))))

    # A conversation's facts meet its turns by chunk: a third of all turns is no single group.
    facts = heads.select("conv_id", "head", "k", "length", *[f"{x}{i}" for x in "ab" for i in range(LANES)])
    facts = turns.select("conv_id", "chunk").distinct().join(facts, "conv_id")
    own = turns.join(facts, ["conv_id", "chunk"]).where("pos >= head")
    key = [(F.col(f"a{i}") * F.col(f"c{i}") + F.col(f"b{i}")) % PRIME for i in range(LANES)]
    parent = [(F.col(f"a{i}") * ((F.col(f"c{i}") + PRIME - F.col(f"t{i}")) % PRIME) + F.col(f"b{i}")) % PRIME for i in range(LANES)]
    depth = F.col("pos") + 1 + F.col("k") - F.col("head")
    of_own = own.select(*row(depth, _packed(key), _packed(parent), F.col("one"), F.col("two"), F.col("words")))
    return write_table(roots.unionByName(of_base).unionByName(of_own), "prefixes")


def prefix_trie(conversations: DataFrame, plan=block_plan, longest: int = HEADS - 1) -> Trie:
    """The trie of the rebuilt conversations of (conv_id, turn, role, text).

    `plan(conv_id)` gives (base, head): the id whose first `head` turns, at most `longest`, stand in place of
    the own first `head`. Turns are in order of `turn` (NULL first), ties of the first 64 characters of role and text,
    then of their hashes. NULL role or text is empty; rows of NULL conv_id belong to no conversation and are
    left out; a repeated row is a turn of its own; other columns are ignored. No conversation: no node.
    """
    for attempt in count():
        generators = _generators(attempt)
        referred = _reference(conversations, attempt)
        stored = referred.select("one", "two", "role", "text").distinct()
        turns = _turns(referred, generators)
        prefixes = _prefixes(turns, _heads(turns, generators, plan, longest), longest)
        agree = [F.min(c).eqNullSafe(F.max(c)) for c in ("p1", "p2", "one", "two")]
        nodes = prefixes.groupBy(*NODE).agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[F.max(c).alias(c) for c in ("p1", "p2", "one", "two", "words")],
            (agree[0] & agree[1] & agree[2] & agree[3]).alias("sure"),
        )
        nodes = write_table(nodes, "nodes")
        if nodes.where("not sure").isEmpty() and stored.groupBy("one", "two").count().where("count > 1").isEmpty():
            break
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    counted = nodes.drop("sure").join(children.agg(F.count(F.lit(1)).alias("n_children")), NODE, "left").fillna(0, ["n_children"])
    return Trie(write_table(counted, "tree"), prefixes, stored)


def subtree_sums(trie: Trie, **values: Column) -> DataFrame:
    """(depth, k1, k2, one column for each of `values`): the sums of whole-number columns of the nodes over every node's subtree.

    Each node lies on the path of its smallest member, where its value is put; sums from a depth on along each
    path, added over a node's members, count every node of its subtree once.
    """
    put = trie.nodes.select("conv_id", "depth", *[v.cast("long").alias(f"_{n}") for n, v in values.items()])
    path = trie.prefixes.select("conv_id", *NODE).join(put, ["conv_id", "depth"], "left").fillna(0, [f"_{n}" for n in values])
    path = path.withColumn("_back", -F.shiftright("depth", CHUNK_BITS))
    below = running(path, "conv_id", "_back", [F.desc("depth")], {n: f"_{n}" for n in values})
    return below.groupBy(*NODE).agg(*[F.sum(n).alias(n) for n in values])


def ends_digests(trie: Trie) -> DataFrame:
    """(depth, k1, k2, sha256): of the ids of the conversations that end in a node, ascending and comma-joined."""
    ends = trie.prefixes.where("depth = length").groupBy(*NODE, F.shiftright("conv_id", CHUNK_BITS).alias("no"))
    pieces = ends.agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("piece"))
    return digest_of_pieces(pieces, NODE, ",")


def op13_prefix_trie(conversations: DataFrame) -> DataFrame:
    trie = prefix_trie(conversations)
    saved = (F.col("n_convs") - 1) * F.col("words")
    sums = subtree_sums(trie, n_leaves=F.col("n_children") == 0, saved_tokens=saved)
    parents = trie.nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    whole = trie.nodes.join(sums, NODE).join(ends_digests(trie), NODE, "left").join(parents, ["depth", "p1", "p2"], "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )


SQL = r"""WITH bits AS (
  SELECT list(list_reduce(list_concat([n], range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY n) AS t
  FROM range(256) r(n)
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said
  FROM conversations WHERE conv_id IS NOT NULL
), owned AS (SELECT conv_id, list(said ORDER BY pos) AS own FROM turns GROUP BY conv_id),
planned AS (
  SELECT conv_id, own, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])
  )) % 4 AS head FROM owned, bits
), rebuilt AS (
  SELECT p.conv_id, list_concat(coalesce(b.own[1:p.head], []), p.own[p.head + 1:]) AS seq FROM planned p LEFT JOIN owned b ON b.conv_id = p.base
), prefixes AS (
  SELECT conv_id, d AS depth, seq[1:d] AS seq, len(seq) AS length FROM (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS d FROM rebuilt)
), named AS (SELECT *, sha256(to_json(seq)::VARCHAR) AS name, sha256(to_json(seq[1:depth - 1])::VARCHAR) AS parent FROM prefixes),
nodes AS (
  SELECT depth, name, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
         any_value(len(regexp_extract_all(coalesce(seq[depth].text, ''), '[^\x20\x09-\x0D]+'))) AS words,
         coalesce(string_agg(CASE WHEN depth = length THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends
  FROM named GROUP BY depth, name
), children AS (SELECT depth - 1 AS depth, parent AS name, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
tree AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (depth, name)),
-- a node's ancestors are the prefixes of its smallest member
sums AS (
  SELECT up.depth, up.name, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
  FROM tree JOIN named up ON up.conv_id = tree.conv_id AND up.depth <= tree.depth GROUP BY ALL
)
SELECT tree.conv_id, tree.depth, p.conv_id AS parent_conv_id, tree.n_convs, n_children, n_leaves, saved_tokens, sha256(tree.ends) AS ends_sha256
FROM tree JOIN sums USING (depth, name) LEFT JOIN nodes p ON tree.depth > 0 AND p.depth = tree.depth - 1 AND p.name = tree.parent"""
