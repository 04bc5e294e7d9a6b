"""Order MinHash against a plain version of the same hashes, and what its likeness tells."""

import hashlib
import re
import struct
from collections import Counter

import numpy as np
import xxhash

from gleaner.llm import order_minhash
from tests.llm.test_operators import LONG, empty, odd_documents


def chained(*values):
    """Spark's xxhash64 of strings (str), longs (int) and ints (np.int32), as an unsigned number."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<i", int(v)) if isinstance(v, np.int32) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def brute_entries(text):
    tokens = [signed(chained(t)) for t in re.findall("[^ \t\n\x0b\f\r]{1,16}", text)]
    kmers = [signed(chained(*tokens[i : i + order_minhash.K])) for i in range(max(1, len(tokens) - order_minhash.K + 1))] if tokens else []
    seen, bins = Counter(), {}
    for at, kmer in enumerate(kmers):
        short = kmer >> order_minhash.PLACE_BITS
        x = signed(chained(kmer, np.int32(seen[short])))
        seen[short] += 1
        found = (x >> order_minhash.PLACE_BITS, at)
        bins[x % order_minhash.BINS] = min(found, bins.get(x % order_minhash.BINS, found))
    if not bins:
        return [0] * order_minhash.ENTRIES
    full = [bins[min((b for b in bins if b >= i), default=min(bins))] for i in range(order_minhash.BINS)]
    out = []
    for (x, i), (y, j) in zip(full[::2], full[1::2]):
        out.append((chained(np.int32(0), x, y) if i <= j else chained(np.int32(1), y, x)) & order_minhash.ENTRY)
    return out


def as_hex(entries):
    return "".join(f"{e:08x}" for e in entries)


def brute(rows):
    """The contract's columns for (doc_id, text) rows; repeated rows are one document."""
    ring = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, -(r[0] or 0), -signed(chained(r[1]))))
    out = Counter()
    copies = Counter((i, t or "") for i, t in rows)
    for at, (i, text) in enumerate(ring):
        after = ring[(at + 1) % len(ring)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = (brute_entries(t) for t in (text, edited, after))
        like = lambda x, y: sum(p == q for p, q in zip(x, y)) / len(x)
        out[i, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_hex(a), as_hex(b), like(a, b), like(a, c)] += copies[i, text]
    return out


def got(docs):
    columns = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    return Counter(tuple(r[c] for c in columns) for r in order_minhash.op11_order_minhash(docs).collect())


def test_given_documents_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_odd_documents_equal_brute_force(spark):
    unbroken = "äöü" * 400
    extra = [(9, unbroken, "de", "a"), (10, unbroken + "x", "de", "a"), (11, "a a a a a a a a", "en", "b"), (-3, "𝄞 b", "en", "b")]
    docs = odd_documents(spark, extra)
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got(empty(spark)) == Counter()
    lone = docs.where("doc_id = 4")
    assert got(lone) == brute([(4, LONG)]) and next(iter(got(lone)))[-1] == 1.0


def test_likeness_follows_edits_and_order(spark):
    words = [f"w{i}" for i in range(400)]
    swapped = words[200:] + words[:200]
    texts = {"same": words, "few": words[:395] + [f"x{i}" for i in range(5)], "half": words[:200] + [f"x{i}" for i in range(200)], "swapped": swapped, "other": [f"y{i}" for i in range(400)]}
    rows = [(0, " ".join(words)), *[(i, " ".join(t)) for i, t in enumerate(texts.values(), 1)]]
    docs = spark.createDataFrame([(i, t, "mine") for i, t in rows], "doc_id long, text string, fingerprint string")
    found = order_minhash.fingerprints(docs)
    assert found.columns == docs.columns and found.count() == len(rows)
    prints = {r.doc_id: r.fingerprint for r in found.collect()}
    near = {name: sum(prints[0][k : k + 8] == prints[i][k : k + 8] for k in range(0, 256, 8)) / 32 for i, name in enumerate(texts, 1)}
    assert near["same"] == 1.0 and near["other"] == 0.0
    # The same k-mers in another order agree less than Jaccard similarity would say.
    assert near["few"] > 0.8 > near["swapped"] > 0.2 and near["few"] > near["half"] > 0
