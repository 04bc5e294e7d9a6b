"""The training-data operators on small tables: brute force, odd inputs, defined results."""

import itertools
import tracemalloc
import zlib
from collections import Counter

import ahocorasick  # noqa: F401  the automaton's package must be there
import numpy as np
import pandas as pd
import pytest
import xxhash

from gleaner.llm import decontam, hnsw, langid, linedup, mixing, quality, simhash, substring, toxicity, urls
from gleaner.llm.common import components, numbered

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, size string"
LONG = " ".join(f"word{i}" for i in range(30_000))


def odd_documents(spark, rows=()):
    """Nulls in every column, empty and very long texts, repeated rows, columns that clash by name."""
    base = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, LONG, "en", "a"), (5, LONG, "en", "b"),
        (6, "one two", "de", None), (6, "one two", "de", None), (6, "other text", "de", "b"), (None, "no id", None, "c"), (None, None, None, None),
    ]
    rows = [(i, t, g, s, len(t) if t is not None else None, "x", "y") for i, t, g, s in [*base, *rows]]
    return spark.createDataFrame(rows, DOCS)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


# components and numbering


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(3)
    pairs = {tuple(sorted(map(int, p))) for p in rng.integers(0, 300, (220, 2)) if p[0] != p[1]} | {(i, i + 1) for i in range(400, 460)}
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(pairs):
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_numbered_is_the_order_of_the_whole_table(spark):
    rows = spark.range(1000).selectExpr("pmod(id * 7919, 1000) as x").repartition(7)
    assert [(r.x, r.place) for r in numbered(rows, ["x"], "place").orderBy("x").collect()] == [(i, i) for i in range(1000)]


# op1


def brute_fingerprint(text):
    words = text.encode().lower().split() if text else []
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_simhash_links_are_all_pairs_within_two_bits(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 60)]
    prints = set(base)
    for x in base:
        for _ in range(12):
            y = x % 2**64
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                y ^= 1 << int(b)
            prints.add(y - 2**64 if y >= 2**63 else y)
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long")).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(prints), 2) if ((a ^ b) % 2**64).bit_count() <= 2}
    assert got == want and len(want) > 100


def test_simhash_fingerprints_and_groups(spark):
    docs = odd_documents(spark)
    got = simhash.op1_simhash(docs).collect()
    texts = {(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()}
    assert {(r.doc_id, int(r.fingerprint, 16)) for r in got} == texts and len(got) == 10
    zero = {r.doc_id: r.component_id for r in got if r.fingerprint == "0" * 16}
    assert zero == {1: 1, 2: 1, 3: 1, None: 1}
    assert {r.component_id for r in got if r.doc_id in (4, 5)} == {4}
    assert simhash.op1_simhash(empty(spark)).count() == 0


def test_simhash_keeps_one_of_each_group(spark):
    docs = odd_documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(
        [(1, None), (4, LONG), (6, "one two"), (6, "other text"), (None, "no id")]
    )
    assert simhash.keep_one(empty(spark)).count() == 0


def test_keep_one_equals_brute_force_over_all_pairs(spark, folder):
    rng = np.random.default_rng(8)
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    for i in range(40):
        words = [f"w{rng.integers(5000)}" for _ in range(rng.integers(200, 400))]
        for j in range(4):
            texts.append((10_000 + 10 * i + j, " ".join(words)))
            words[rng.integers(len(words))] = "another"
    prints = [brute_fingerprint(text) for _, text in texts]
    root, different = list(range(len(texts))), 0
    for a, b in itertools.combinations(range(len(texts)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            different += texts[a][1] != texts[b][1]
            old, new = root[b], root[a]
            root = [new if r == old else r for r in root]
    want = {min(texts[i][0] for i in range(len(texts)) if root[i] == r) for r in set(root)}
    assert different >= 10 and {r.doc_id for r in simhash.keep_one(spark.createDataFrame(texts, "doc_id long, text string")).collect()} == want


# op2, op6, op8


def taught(spark, good, bad, column):
    rows = [(i, bad(i) if i % 3 == 0 else good(i), int((i % 3 == 0) == (column == "toxic"))) for i in range(100, 500)]
    docs = odd_documents(spark, [(i, t, "en", "s") for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 1), (1, None, None)], f"doc_id long, {column} int, extra int")
    return docs, labels, {i: y for i, _, y in rows}


def plain(i):
    rng = np.random.default_rng(i)
    return " ".join("".join(rng.choice(list("aeioulmnrst"), 5)) for _ in range(40))


def check_scores(out, truth, divisor, fold, least):
    rows = out.collect()
    assert len(rows) == len(truth) + 10 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % divisor == fold) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= least


def test_quality(spark):
    docs, labels, truth = taught(spark, plain, lambda i: plain(i).replace(" ", "!! ").upper(), "quality")
    check_scores(quality.op2_quality(docs, labels), truth, 4, 2, 0.95)
    unlabelled = quality.op2_quality(docs, empty(spark, "doc_id long, quality int")).select("score").distinct().collect()
    assert [r.score for r in unlabelled] == [0.5]
    assert quality.op2_quality(empty(spark), labels).count() == 0


def test_toxicity(spark):
    docs, labels, truth = taught(spark, plain, lambda i: f"{plain(i)} you stupid idiot", "toxic")
    disguised = "what a 5tupid 1d10t st.u.p.i.d iiidiooot"
    docs = docs.union(odd_documents(spark, [(9000, f"{plain(1)} {disguised}", "en", "s")]).where("doc_id = 9000"))
    scores = toxicity.op6_toxicity(docs, labels)
    check_scores(scores.where("doc_id is null or doc_id <> 9000"), truth, 3, 1, 0.95)
    assert scores.where("doc_id = 9000").first().predicted == 1
    assert toxicity.op6_toxicity(empty(spark), labels).count() == 0


def test_restoring_disguised_words():
    flat = "  ".join(["idiot", "stupid", "moron", "loser", "the", "hello", "clown"] * 50)
    c = np.frombuffer(f"  {flat}  ".encode("utf-32-le"), dtype=np.uint32)
    tables = [
        np.bincount(toxicity.learn.mix(h, bits), minlength=1 << bits)
        for h, bits in ((toxicity._hashed(c[:-2], c[1:-1], c[2:]), toxicity.TRIGRAM_BITS), (toxicity._hashed(c[:-2], c[1:-1]), toxicity.CONTEXT_BITS))
    ]
    restorer = toxicity.Restorer(*tables)
    for word, plain_word in {"1d10t": "idiot", "m0r0n": "moron", "$tupid": "stupid", "st*pid": "stupid", "l00000ser": "loser", "s.t.u.p.i.d": "stupid"}.items():
        assert restorer.restored(word) == [plain_word]
    assert restorer.restored("2019") == ["2019"] and restorer.restored("hello") == ["hello"]
    assert "idiot" in toxicity.tokens_of("You I d i o t there") and toxicity.tokens_of(None) == set()


def test_language(spark):
    alphabets = {"en": "abcde", "de": "äöüxy", "fr": "éèçàê"}
    rows = [(100 + i, " ".join("".join(np.random.default_rng(i * 9 + j).choice(list(a), 4)) for j in range(9)), lang, "s") for i in range(200) for k, (lang, a) in enumerate(alphabets.items()) if i % 3 == k]
    docs = odd_documents(spark, [*rows, (8000, "12 34 !!", None, None)])
    out = {r.doc_id: r for r in langid.op8_language(docs).where("doc_id is not null").collect()}
    held = [(out[i].lang_pred, lang) for i, _, lang, _ in rows if out[i].held_out]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert all(out[i].lang_pred == "und" and out[i].score == 0.0 for i in (1, 2, 3, 8000))
    assert langid.op8_language(empty(spark)).count() == 0
    assert {r.lang_pred for r in langid.op8_language(docs.withColumn("lang", docs.lang.substr(9, 2)).where("lang is null")).collect()} <= {"und", ""}


def test_codewords_differ():
    for n in (1, 2, 4, 6, 40):
        code = langid.codewords(n)
        assert len(np.unique(code, axis=0)) == n


# op3


def brute_spans(texts, least):
    import re

    units = []
    for t in texts:
        cut = [0, *(m.end() for m in re.finditer(r"\n|[.!?](?=[ \t])", t)), len(t)]
        units.append([(a, b, " ".join(t[a:b].lower().split())) for a, b in zip(cut, cut[1:]) if t[a:b].strip()])
    seen, out = set(), []
    for x in units:
        spans, run = [], []
        for a, b, u in [*x, (0, 0, None)]:
            if u in seen and u is not None:
                run.append((a, b, len(u.split())))
                continue
            if sum(n for *_, n in run) >= least:
                spans.append((run[0][0], run[-1][1]))
            run = []
            seen.add(u)
        out.append(spans)
    return out


def test_substring_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    pool = [" ".join(rng.choice(list("abcdé"), rng.integers(1, 12))) + str(rng.choice([".", "!", "", "?"])) for _ in range(30)]
    texts = ["".join(x + str(rng.choice([" ", "\n", "  \n"])) for x in rng.choice(pool, rng.integers(1, 20))) for _ in range(50)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in substring.repeats(docs, 10).collect()}
    want = brute_spans(texts, 10)
    assert [got.get(i, []) for i in range(len(texts))] == want and any(want)
    left = {r.doc_id: r.text for r in substring.without_repeats(docs, 10).collect()}
    for i, t in enumerate(texts):
        assert left[i] == "".join(c for k, c in enumerate(t) if not any(a <= k < b for a, b in want[i]))


def test_substring_odd_rows(spark):
    docs = odd_documents(spark)
    got = substring.without_repeats(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    report = {r.doc_id: (r.n_chars, r.n_removed, r.removed) for r in substring.op3_substring(docs).where("doc_id is not null").collect()}
    assert report[5] == (len(LONG), len(LONG), f"0-{len(LONG)}") and report[1] == (0, 0, "") and report[4][1] == 0
    assert substring.op3_substring(empty(spark)).count() == 0


# op4


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 16))
    near = base[:40].repeat(4, axis=0) + rng.normal(scale=0.1, size=(160, 16))
    vectors = np.concatenate((base, near, base[:3], base[:1] * 2)).astype(np.float32)
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(vectors)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [None] + [1.0] * 15), (904, [float("nan")] * 16), (905, [float("inf")] * 16), (906, [1.0, 2.0]), (None, [5.0, 1.0, 0.0])]
    table = spark.createDataFrame([*rows, *[(i, v, None) for i, v in odd]], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in hnsw.op4_embeddings(table).collect()}
    unit = hnsw.unit(vectors)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    root = list(range(len(unit)))
    while True:
        new = [min([root[i], *(root[j] for j in np.flatnonzero(linked[i]))]) for i in range(len(unit))]
        if new == root:
            break
        root = new
    for i in range(len(unit)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (linked[i].sum(), root[i], root[i] == i)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(900, 907))
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, True)
    assert hnsw.op4_embeddings(empty(spark, "vec_id long, embedding array<float>, label int")).count() == 0


def test_a_dense_group_beyond_the_beam(spark):
    rng = np.random.default_rng(4)
    vectors = np.concatenate((np.ones((300, 8)) + rng.normal(scale=0.01, size=(300, 8)), rng.normal(size=(200, 8))))
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in hnsw.op4_embeddings(table).collect()}
    unit = hnsw.unit(vectors)
    want = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    assert sum(got.values()) >= 0.99 * want.sum() and all(got[i] <= want[i] for i in got)


def links_of(vectors: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Brute force: numbers of links, smallest ids reachable."""
    near = hnsw.unit(vectors) @ hnsw.unit(vectors).T >= 0.9
    root = np.arange(len(vectors))
    while True:
        least = np.array([root[row].min() for row in near])
        if (least == root).all():
            return near.sum(axis=1) - 1, root.tolist()
        root = least


def test_rare_links_to_another_shard_are_audited(monkeypatch):
    """Queries drawn at random have next to no link here: planted ones widen a beam that is too narrow all the same."""
    rng = np.random.default_rng(1)
    x = np.concatenate((hnsw.unit(rng.normal(size=(1200, 200))), hnsw.unit(1 + 0.1 * rng.normal(size=(300, 200))))).astype(np.float32)
    near = hnsw.unit(x[:30] + 0.42 * hnsw.unit(rng.normal(size=(30, 200))))
    asked = np.concatenate((near, hnsw.unit(rng.normal(size=(1800, 200))))).astype(np.float32)
    want = set(zip(*np.nonzero(asked @ x.T >= 0.9)))
    graph = hnsw.Graph(x)
    queries, found, beam, recall = hnsw.linked(graph, asked, 0.9)
    assert len(want) == 30 and want <= set(zip(queries, found)) and min(recall) >= hnsw.RECALL
    monkeypatch.setattr(hnsw, "BEAM", 1)
    audit = hnsw.Audit(graph, asked, np.full(len(asked), -1), 0.9)
    assert min(audit.recall(1)) < 0.9
    queries, found, beam, recall = hnsw.linked(graph, asked, 0.9)
    assert beam > 1 and min(recall) >= hnsw.RECALL and len(want & set(zip(queries, found))) >= 29


def test_every_node_of_a_graph_is_reached():
    rng = np.random.default_rng(7)
    groups = 1 + np.concatenate([0.05 * rng.normal(size=(400, 8)) + rng.normal(size=8) for _ in range(3)])
    graph = hnsw.Graph(np.concatenate((groups, rng.normal(size=(500, 8)))))
    reached, todo = np.zeros(len(graph.x), dtype=bool), graph.order[:1]
    while len(todo):
        reached[todo] = True
        near = np.unique(graph.near[0][todo])
        todo = near[(near >= 0) & ~reached[np.maximum(near, 0)]]
    assert reached.all()


def test_dense_and_small_groups_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_VECTORS", 300)
    monkeypatch.setattr(hnsw, "BLOCK_QUERIES", 500)
    rng = np.random.default_rng(9)
    dense = 1 + rng.normal(scale=0.05, size=(700, 24))
    single = rng.normal(size=(900, 24))
    small = single[:80].repeat(2, axis=0) + rng.normal(scale=0.2, size=(160, 24))
    vectors = np.concatenate((dense, single, small, dense[:40], single[:5]))
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in hnsw.op4_embeddings(table).collect()}
    counts, roots = links_of(vectors)
    assert [got[i].n_links for i in range(len(vectors))] == counts.tolist()
    assert [got[i].component_id for i in range(len(vectors))] == roots
    nodes = spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in enumerate(vectors[:1600])], "node long, vector array<double>, copies long")
    found = hnsw.links(nodes).collect()
    audits = [r for r in found if r.kind == hnsw.AUDIT]
    assert len(audits) == 6 * 4 and all(min(r.few, r.many, r.planted) >= hnsw.RECALL for r in audits)
    # No square of the dense group: counts and edges for it, pairs for the others.
    assert len(found) < 1600 * 6 * 4 and sum(r.kind == hnsw.COUNT for r in found) >= 700


def test_a_search_task_holds_no_square_of_a_dense_group(monkeypatch):
    monkeypatch.setattr(hnsw, "HELD_PAIRS", 200_000, raising=False)
    rng = np.random.default_rng(11)
    x = np.concatenate((1 + 0.01 * rng.normal(size=(2000, 16)), rng.normal(size=(500, 16)))).astype(np.float32)
    rows = pd.DataFrame({"dim": 16, "shard": 0, "node": np.arange(len(x)), "copies": 1, "vector": list(x)})
    graph = hnsw._build(rows)
    tracemalloc.start()
    found = hnsw._met(0.9)((16, 0, 0), graph, rows[["node", "vector"]])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    counts, roots = links_of(x)
    got = dict(zip(found["a"][found["kind"] == hnsw.COUNT], found["n"][found["kind"] == hnsw.COUNT]))
    assert {i: n for i, n in enumerate(counts.tolist()) if n >= hnsw.DENSE} == got and len(got) >= 2000
    edges = found[found["kind"] == hnsw.EDGE]
    assert dict(zip(edges["b"], edges["a"])) == {i: root for i, root in enumerate(roots) if i != root}
    # Four million links of some 150 bytes each are never together.
    assert peak < 120_000_000


# op5


def test_mixing_odd_rows_and_shards(spark):
    docs = odd_documents(spark, [(100 + i, " ".join(["w"] * (i % 50)), "en", f"s{i % 7}") for i in range(400)])
    rows = mixing.op5_mixing(docs).collect()
    assert len(rows) == docs.count()
    by_source = {}
    for r, source in zip(sorted(rows, key=lambda r: (r.doc_id or 0, r.size)), [None] * len(rows)):
        assert 0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size
    drawn = mixing.mix_documents(docs, shards=5).collect()
    for r in drawn:
        by_source.setdefault(r.source, [r.target, 0])[1] += r.taken
        assert sum(p.n_words for p in r.pieces) == r.taken and all(0 <= p.shard < 5 and p.first_word + p.n_words <= r.size for p in r.pieces)
    assert all(abs(target - taken) <= 1 for target, taken in by_source.values())
    assert sorted(map(str, drawn)) == sorted(map(str, mixing.mix_documents(docs, shards=5).collect()))
    assert mixing.op5_mixing(empty(spark)).count() == 0 and mixing.mix_documents(empty(spark)).count() == 0


def test_splitting_tree_keeps_quotas_and_fills_shards_evenly(spark):
    quotas = {None: 70, "a": 5000, "b": 3, "c": 1200}
    wanted = spark.createDataFrame(list(quotas.items()), "source string, quota long")
    leaves = mixing.split_tree(wanted, 6).collect()
    got, size = Counter(), Counter()
    for r in leaves:
        got[r.source] += r.quota
        size[r.shard] += r.quota
        assert r.quota >= 0
    assert got == quotas and max(size.values()) - min(size.values()) <= 3
    blocks = mixing.blocks(wanted, 6).collect()
    assert Counter((r.source, r.block) for r in blocks) == Counter({(s, b): 1 for s, n in quotas.items() for b in range(n)})
    assert Counter((r.source, r.shard) for r in blocks) == Counter({(r.source, r.shard): r.quota for r in leaves if r.quota})


def test_hypergeometric_draws_have_the_right_mean_and_spread(spark):
    draws = spark.range(2000).selectExpr("named_struct('k', 40L, 'm', 100L, 'n', 30L, 'u', (id + 0.5D) / 2000) as d").selectExpr(f"{mixing._drawn('d')} as x")
    x = np.array([r.x for r in draws.collect()])
    assert abs(x.mean() - 12) < 0.01 and abs(x.var() - 30 * 0.4 * 0.6 * 70 / 99) < 0.05 and x.min() >= 0


# op7


def test_decontamination_odd_rows(spark):
    item = " ".join(f"q{i}" for i in range(15))
    bench = spark.createDataFrame([(1, item, 0), (2, "short Item", 0), (3, None, 0), (None, "ghost words here", 0), (4, "!!", 0), (1, item, 0)], "item_id long, text string, doc_id int")
    docs = odd_documents(spark, [(50, f"Zürich, {item.upper()}!", "en", "s"), (51, "a SHORT--item b", "en", "s"), (52, "ghost words here", "en", "s"), (53, f"{LONG} {item}", "en", "s")])
    got = {(r.doc_id, r.n_words): r for r in decontam.op7_decontamination(docs, bench).collect()}
    assert (got[50, 16].n_hit, got[50, 16].n_items, got[50, 16].contaminated) == (15, 1, True)
    assert (got[51, 4].n_hit, got[51, 4].n_items) == (2, 1)
    assert (got[52, 3].n_hit, got[52, 3].n_items) == (3, 0)
    assert (got[53, 30015].n_hit, got[53, 30015].contaminated) == (15, False)
    assert got[1, 0].n_hit == 0 and not got[1, 0].contaminated
    spans = decontam.find(docs.where("doc_id = 50"), bench).first()
    assert [(s.start, s.end) for s in spans._found.spans] == [(8, 8 + len(item))]
    kept = decontam.keep_clean(docs, bench)
    assert kept.columns == docs.columns and {50, 51, 52}.isdisjoint(r.doc_id for r in kept.collect())
    none = decontam.op7_decontamination(docs, empty(spark, "item_id long, text string"))
    assert none.where("n_hit > 0").isEmpty() and none.count() == docs.count()
    assert decontam.op7_decontamination(empty(spark), bench).count() == 0


def test_decontamination_in_several_passes(spark, folder, monkeypatch):
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    one = decontam.op7_decontamination(docs, bench).collect()
    monkeypatch.setattr(decontam, "AUTOMATON_CHARS", 40_000)
    assert sorted(one) == sorted(decontam.op7_decontamination(docs, bench).collect())
    assert any(r.contaminated for r in one)


# op9


def brute_deleted(texts, least):
    """Deleted line indexes: each line of any run of `least` words or more that occurs before."""
    lines = [[(i, x.strip()) for i, x in enumerate(t.split("\n")) if x.strip()] for t in texts]
    seen, gone = {}, [set() for _ in texts]
    runs = [(d, a, b) for d, x in enumerate(lines) for a in range(len(x)) for b in range(a + 1, len(x) + 1)]
    for d, a, b in runs:
        run = tuple(x for _, x in lines[d][a:b])
        if sum(len(x.split()) for x in run) < least:
            continue
        if (d, a) > seen.setdefault(run, (d, a)):
            gone[d].update(i for i, _ in lines[d][a:b])
    return [sorted(x) for x in gone]


def test_line_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    pool = [" ".join(rng.choice(list("abcdefgh"), rng.integers(1, 9))) for _ in range(25)]
    texts = ["\n".join(rng.choice([*pool, "", "  "], rng.integers(1, 25))) for _ in range(40)]
    texts += [texts[3], texts[5] + "\n" + texts[7], "\n".join(["same line again"] * 30), LONG, LONG]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: list(r.deleted) for r in linedup.repeats(docs, 12).collect()}
    assert [got.get(i, []) for i in range(len(texts))] == brute_deleted(texts, 12)


def test_line_dedup_odd_rows(spark):
    docs = odd_documents(spark)
    got = linedup.without_repeats(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    rows = {(r.doc_id, r.text, r.n_chars) for r in got.collect()}
    assert {(4, LONG, len(LONG)), (5, "", 0), (1, None, None), (2, "", 0)} <= rows
    report = {r.doc_id: (r.n_lines, r.n_removed, r.removed) for r in linedup.op9_line_dedup(docs).collect()}
    assert report[5] == (1, 1, "0") and report[1] == (0, 0, "") and report[3] == (0, 0, "")
    assert linedup.op9_line_dedup(empty(spark)).count() == 0


# op10


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("https://A.com/x?y#z", "a.com", "/x", "com/", "allow"),
        ("http://com", "com", "", None, None),
        ("http://www.example.com/en/1?q", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"),
        ("http://x.net/es/", "x.net", "/es/", "net/es/", "block"),
        ("http://xnet/es/", "xnet", "/es/", None, None),
        ("no scheme", "", "", None, None),
        (None, "", "", None, None),
        ("a://b?c://d/e", "b", "", None, None),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url)], "page_id long, url string")
    name, says = urls.rule_of(urls.host_of(pages.url), urls.path_of(pages.url))
    row = pages.select(urls.host_of(pages.url), urls.path_of(pages.url), name, says).first()
    assert tuple(row) == (host, path, rule, verdict)


def test_trees_judge_the_rest(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    rows = urls.op10_urls(pages).collect()
    assert len(rows) == pages.count() and {r.verdict for r in rows} == {"allow", "block"} and any(r.rule is None for r in rows)
    odd = spark.createDataFrame([(1, None, "h"), (None, "", "h"), (2, "x://y.org/" + "z" * 50_000, "h"), (2, "http://a.com/", "h")], "page_id long, url string, host string")
    assert {r.verdict for r in urls.op10_urls(odd).collect()} <= {"allow", "block"}
    assert urls.op10_urls(empty(spark, "page_id long, url string")).count() == 0


def test_host_path_and_rule_as_the_statement_says(spark, folder, duck):
    mine = [tuple(r) for r in urls.op10_urls(spark.read.parquet(f"{folder}/pages.parquet")).select("page_id", "host", "path", "rule").collect()]
    assert Counter(mine) == Counter(duck.execute(urls.RULES_SQL).fetchall())


def test_suffix_statistics_count_all_rows_and_the_sample_different_urls(spark, monkeypatch):
    monkeypatch.setattr(urls, "TRAIN_URLS", 30)
    hot = [(i, "http://hot.net/es/1") for i in range(2000)]
    rest = [(5000 + i, f"http://a{i}.{('com', 'net')[i % 2]}/{('x', 'fr')[i % 2]}/{i}") for i in range(200)]
    pages = spark.createDataFrame([*hot, *rest, (9000, "http://b.org/fr/1"), (9001, "http://b.org/x/1")], "page_id long, url string")
    host, path = urls.host_of(pages.url), urls.path_of(pages.url)
    labelled = pages.select("url", urls.suffix_of(host).alias("_suffix"), (urls.rule_of(host, path)[1] == "block").cast("double").alias("_label")).where("_label is not null")
    share = 2100 / 2200
    stats = {r._suffix: (r._x_suffix_share, r._x_suffix_count) for r in urls.suffix_statistics(labelled, share).collect()}
    assert stats["com"] == pytest.approx((10 * share / 110, np.log1p(100))) and stats["net"] == pytest.approx(((2100 + 10 * share) / 2110, np.log1p(2100)))
    learned = urls.learnable(labelled).collect()
    # The one hot URL is one row of the sample, and both verdicts are in it.
    assert Counter(r._label for r in learned) == {0.0: 30, 1.0: 30} and len({r.url for r in learned}) == 60
    out = {r.page_id: r.verdict for r in urls.op10_urls(pages).collect()}
    assert len(out) == 2202 and {out[i] for i in range(2000)} == {"block"} and out[5000] == "allow"


def test_url_columns_that_clash_are_replaced(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x", "h", "p"), (2, "http://a.net/es/", None, None)], "page_id long, url string, host string, verdict string")
    found = urls.judged(pages)
    assert found.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert {(r.host, r.verdict) for r in found.collect()} == {("a.com", "allow"), ("a.net", "block")}


def test_language_sample_of_repeated_rows(spark):
    """A repeated row counts once, a document with several texts gives one, and each language gives its first rows by hash."""
    rows = [(7, "same text", "en")] * 500 + [(9, f"text {i}", "en") for i in range(50)] + [(100 + i, f"wort {i}", ("de", "en")[i % 2]) for i in range(40)]
    docs = spark.createDataFrame([*rows, (None, "x", "en"), (3, None, "en"), (4, "x", None)], "doc_id long, text string, lang string")
    learned = langid.sample(docs).collect()
    usable = {(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    assert len(learned) == len(usable) and Counter(r.lang for r in learned) == Counter(lang for _, lang in usable)
    held = [i for i, _, lang in rows if (i, lang) in usable]
    assert {r.text for r in learned} - {f"text {i}" for i in range(50)} == {t for i, t, _ in rows if i in held and i != 9}


def test_language_sample_is_the_first_by_hash(spark, monkeypatch):
    monkeypatch.setattr(langid, "ROWS_PER_LANGUAGE", 5)
    docs = spark.range(400).selectExpr("id as doc_id", "cast(id as string) as text", "if(id % 3 = 0, 'de', 'en') as lang")
    got = {(r.lang, int(r.text)) for r in langid.sample(docs).collect()}
    hashed = {r.id: r.h for r in spark.range(400).selectExpr("id", "xxhash64(id) as h").collect()}
    kept = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    for lang, rest in (("de", {0}), ("en", {1, 2})):
        first = sorted((i for i in kept if i % 3 in rest), key=lambda i: hashed[i])[:5]
        assert {i for name, i in got if name == lang} == set(first)
