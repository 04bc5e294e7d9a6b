"""Structure repair and the prefix trie against plain brute force: random and odd conversations."""

import hashlib
import heapq
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gleaner.llm import common, prefix_trie, repair

TURNS = "conv_id long, turn long, role string, text string, audit string, depth long"
WORD = re.compile("[^\x20\x09-\x0d]")


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], TURNS)


def odd_rows():
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, other roles, negative and missing bases."""
    long = "word. " * 30_000
    return [
        (None, 1, "user", "no id."), (None, 1, "user", "no id."), (None, None, None, None), (1, None, "user", "first?"), (1, 0, None, None),
        (1, 1, "assistant", None), (2, 5, "tool", "a tool says."), (2, 5, "", "no role."), (2, 5, "System", "capital."), (3, 1, "system", " \n\t "),
        (4, 1, "user", long), (4, 2, "assistant", long), (4, 2, "assistant", long), (5, 3, "user", "one\ntwo: three"), (5, 9, "assistant", "über straße!"),
        (-7, 1, "user", "below zero."), (-7, 2, "assistant", "yes."), (10**15 + 3, 1, "user", "large id."),
    ]


def random_rows(seed, n, longest=9):
    rng = np.random.default_rng(seed)
    texts = ["", " ", "yes", "yes.", "why?", "no!", "and then", "so be it.", "a b c d", "eé f."]
    rows = []
    for conv in range(n):
        for turn in range(rng.integers(1, longest)):
            role = rng.choice(["user", "assistant", "system", "tool"], p=[0.42, 0.42, 0.1, 0.06])
            rows.append((conv, turn if rng.random() < 0.9 else None, str(role), str(rng.choice(texts))))
    return rows


def crc(text):
    return zlib.crc32(text.encode())


# op12


def brute_repair(rows):
    """conv_id -> the contract's columns, by a search that pops (cost, audit) in order."""
    ids, kept = {r[0] for r in rows}, defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        hit = crc(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}") % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        kept[conv] += [(turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    out = {}
    for conv in ids:
        found = sorted(kept[conv], key=lambda r: (r[0] is not None, r[0] or 0, f"{r[1]}\0{r[2]}".encode()))
        turns = [r[0] for r in found if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        kinds, seen = [], set()
        for _, role, text in found:
            chars = WORD.findall(text)
            kinds.append("blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(found))
        heap, done = [(0, "", 0, ())], set()
        while True:
            cost, audit, at, said = heapq.heappop(heap)
            marks = "".join(role[:1] or "-" for role, _ in said)
            if at == len(found) and re.fullmatch("(s?(ua)+)?", marks):
                break
            state = (at, marks[-1:], len(marks) > 0)
            if state in done or not re.match("(s?(ua)*u?)?$", marks):
                continue
            done.add(state)
            options = [("I", 5, 0, (role, "")) for role in ("user", "assistant")]
            if at < len(found):
                _, role, text = found[at]
                options.append(("D", 2, 1, None))
                if kinds[at] not in ("blank", "duplicate"):
                    more = 5 * (kinds[at] == "truncated")
                    options += [("K", more, 1, (role, text)), ("R", 1 + more, 1, ("user", text)), ("R", 1 + more, 1, ("assistant", text))]
            for letter, price, read, turn in options:
                heapq.heappush(heap, (cost + price, audit + letter, at + read, said + ((turn,) if turn else ())))
        text = "\n".join(f"{role}:{text}" for role, text in said)
        out[conv] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired(frame, **options):
    rows = repair.op12_structure_repair(frame, **options).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}


@pytest.mark.parametrize("chunk_bits", [repair.CHUNK_BITS, 7])
def test_repair_equals_brute_force(spark, chunk_bits):
    rows = random_rows(11, 150) + [(a + 10**6 if a is not None and a > 0 else a, *r) for a, *r in odd_rows()]
    assert repaired(table(spark, rows), chunk_bits=chunk_bits) == brute_repair(rows)


def test_repair_of_given_conversations(spark, folder):
    given = spark.read.parquet(f"{folder}/conversations.parquet")
    assert repaired(given) == brute_repair([tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()])


def test_long_conversation_in_chunks_equals_one_search(spark):
    rows = [(1, i, r, t) for i, (_, _, r, t) in enumerate(random_rows(5, 120))]
    whole, cut = repaired(table(spark, rows)), repaired(table(spark, rows), chunk_bits=9)
    assert whole == cut and whole[1][:-2] == brute_repair(rows)[1][:-2]


def test_search_proves_its_optimum():
    rng = np.random.default_rng(2)
    for _ in range(300):
        signs = "".join(rng.choice(list("suaxSUAXD"), rng.integers(0, 9)))
        cost, audit, _ = repair.search(signs)
        heap = [(0, "", 0, repair.START)]
        while True:
            c, a, at, state = heapq.heappop(heap)
            if at == len(signs) and state in repair.FULL:
                break
            for letter, more, read, to in repair.moves(signs[at] if at < len(signs) else None, state):
                if a.count("I") < 12:
                    heapq.heappush(heap, (c + more, a + letter, at + read, to))
        assert (cost, audit) == (c, a)


def test_repaired_turns_and_empty_table(spark):
    rows = [(1, 1, "user", "hello."), (1, 2, "user", "cut of"), (1, 3, "assistant", "good."), (2, 1, "user", "   ")]
    said = repair.repaired_turns(table(spark, rows)).orderBy("conv_id", "place").collect()
    assert [(r.conv_id, r.role, r.text) for r in said] == [(1, "user", "hello."), (1, "assistant", "good.")]
    assert repaired(table(spark, [])) == {}
    # A conversation whose rows are all dropped.
    gone = next((i, 0, "user", "x.") for i in range(1000) if crc(f"{i}:0") % 20 == 0)
    assert repaired(table(spark, [gone])) == {gone[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


# op13


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn, role or "", text or ""))
    for said in own.values():
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, f"{r[1]}\0{r[2]}".encode()))
    members, ends, children = defaultdict(set), defaultdict(set), defaultdict(set)
    for conv, said in own.items():
        head = crc(str(conv)) % 4
        base = conv - int(np.fmod(conv, 20))
        seq = tuple(r[1:] for r in own.get(base, [])[:head] + said[head:])
        for d in range(len(seq) + 1):
            members[seq[:d]].add(conv)
            if d:
                children[seq[: d - 1]].add(seq[:d])
        ends[seq].add(conv)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        saved = sum((len(members[n]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", n[-1][1])) for n in below if n)
        joined = ",".join(map(str, sorted(ends[node])))
        parent = min(members[node[:-1]]) if node else None
        leaves = sum(not children[n] for n in below)
        out.append((min(convs), len(node), parent, len(convs), len(children[node]), leaves, saved, hashlib.sha256(joined.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(frame):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[c] for c in columns) for r in prefix_trie.op13_prefix_trie(frame).collect()), key=str)


def shared_rows(seed, n):
    """Conversations of few different turns, so that prefixes meet; some with more turns than a head, some with fewer."""
    rng = np.random.default_rng(seed)
    texts = ["Hello there.", "Hello there.", "", "one two three", None]
    return [(int(c), t, str(rng.choice(["user", "assistant"])), texts[rng.integers(5)]) for c in range(n) if c % 20 != 7 for t in range(rng.integers(1, 6))]


@pytest.mark.parametrize("bits", [16, 1])
def test_trie_equals_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", bits)
    rows = shared_rows(4, 130) + [r for r in odd_rows() if r[0] is None or r[0] > 100 or r[0] < 0]
    assert trie(table(spark, rows)) == brute_trie(rows)
    assert trie(table(spark, odd_rows())) == brute_trie(odd_rows())
    assert trie(table(spark, [])) == []


def test_trie_is_made_again_when_fingerprints_meet(spark, monkeypatch):
    """Generators of 0 give every prefix the fingerprint of its first turn; the check sees it."""
    tries, honest = [], prefix_trie._generators
    monkeypatch.setattr(prefix_trie, "_generators", lambda attempt: tries.append(attempt) or ([1] * 4 if attempt == 0 else honest(attempt)))
    # With generators of 1 the sum knows no order.
    rows = [(7, 0, "user", "a"), (7, 1, "user", "b"), (7, 2, "user", "c"), (7, 3, "user", "d"), (7, 4, "user", "e"), (9, 0, "user", "x"), (9, 1, "user", "y"), (9, 2, "user", "z"), (9, 3, "user", "e"), (9, 4, "user", "d")]
    plan = lambda c: (c * 0 + 7, c * 0 + 3)
    got = prefix_trie.prefix_trie(table(spark, rows), plan).nodes
    assert sorted(tries) == [0, 1] and got.count() == 8


def test_digest_of_pieces_streams_in_order(spark):
    rows = [(k, n, f"{k}-{n}") for k in (1, 2, None) for n in range(40 if k != 2 else 1)]
    got = common.digest_of_pieces(spark.createDataFrame(rows, "k long, no long, piece string").repartition(5), ["k"], ",")
    want = {k: hashlib.sha256(",".join(p for j, _, p in rows if j == k).encode()).hexdigest() for k in (1, 2, None)}
    assert {r.k: r.sha256 for r in got.collect()} == want
