"""SimHash near-duplicates by anchors of a covering code.

Two 23-bit slices of the 64-bit fingerprint are covered by the perfect binary
Golay code: every slice lies within 3 bits of exactly one codeword. A pair of
codewords is an anchor. A fingerprint's home is its nearest anchor (3 + 3 bits);
it is replicated to every anchor within that radius plus the threshold, shared
between the slices. Of two fingerprints within the threshold one therefore has a
replica at the other's home, so homes meet replicas in one equi-join per anchor
and every link is found, once. A fingerprint has about 61 replicas among 2^24 anchors.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import components, text_digest
from gleaner.session import broadcast_if_small, write_table

THRESHOLD = 2
SEED = 42
SHINGLE = 3
# Words hashed at once; bounds a task's memory on very long texts.
CHUNK = 200_000

# Generator polynomial, length and covering radius of the binary Golay code.
GOLAY, LENGTH, RADIUS = 0b110001110101, 23, 3
SLICE = (1 << LENGTH) - 1
NEAR = pa.list_(pa.struct([("change", pa.int64()), ("over", pa.int32())]))

# Tasks get this module's functions with the job; executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of one text's 3-word shingles, as a signed integer."""
    words = text.encode().lower().split() if text else []
    n = max(1, len(words) - SHINGLE + 1)
    if not words:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, n, CHUNK):
        hashes = [
            xxhash.xxh64_intdigest(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(start, min(n, start + CHUNK))
        ]
        octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint(text) for text in texts], dtype="int64")


def fingerprints(text: Column) -> Column:
    return F.pandas_udf(_fingerprints, "long")(text)


def _syndrome_masks() -> list[int]:
    """masks[j]: the bits whose parity is bit j of the remainder modulo the generator."""
    masks = [0] * (LENGTH - 12)
    for i in range(LENGTH):
        rest = 1 << i
        for shift in range(i, 10, -1):
            if rest >> shift & 1:
                rest ^= GOLAY << (shift - 11)
        for j in range(11):
            masks[j] |= (rest >> j & 1) << i
    return masks


def _syndrome(bits: Column) -> Column:
    parts = [
        F.shiftleft(F.bit_count(bits.bitwiseAND(F.lit(mask))) % 2, j) for j, mask in enumerate(_syndrome_masks())
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.bitwiseOR(part)
    return out


def _nearby(spark: SparkSession, threshold: int, name: str) -> DataFrame:
    """One row per syndrome: differences to the codewords within radius + threshold, and by
    how much each exceeds the radius. 2,048 rows of 45,000 pairs in all, whatever the data."""
    masks = _syndrome_masks()
    rows: dict[int, list[tuple[int, int]]] = {}
    for weight in range(RADIUS + threshold + 1):
        for places in combinations(range(LENGTH), weight):
            change = sum(1 << p for p in places)
            syndrome = sum(((change & mask).bit_count() & 1) << j for j, mask in enumerate(masks))
            rows.setdefault(syndrome, []).append((change, max(0, weight - RADIUS)))
    near = [[{"change": change, "over": over} for change, over in rows[s]] for s in sorted(rows)]
    table = pa.table({f"{name}_syndrome": pa.array(sorted(rows), pa.int32()), name: pa.array(near, NEAR)})
    return F.broadcast(spark.createDataFrame(table))


def links(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Distinct fingerprints (fp) to every pair (a, b), a < b, within `threshold` bits, once."""
    spark = prints.sparkSession
    high = F.shiftrightunsigned("fp", LENGTH).bitwiseAND(F.lit(SLICE))
    low = F.col("fp").bitwiseAND(F.lit(SLICE))
    sliced = prints.select("fp", low.alias("low"), high.alias("high"))
    sliced = sliced.withColumn("one_syndrome", _syndrome(F.col("low"))).withColumn("two_syndrome", _syndrome(F.col("high")))

    def reached(reach: int) -> DataFrame:
        return sliced.join(_nearby(spark, reach, "one"), "one_syndrome").join(_nearby(spark, reach, "two"), "two_syndrome")

    def anchor(one: Column, two: Column) -> Column:
        first = F.shiftleft(F.col("low").bitwiseXOR(one["change"]), LENGTH)
        return first.bitwiseOR(F.col("high").bitwiseXOR(two["change"])).alias("anchor")

    halves = reached(threshold).select("fp", "low", "high", "two", F.explode("one").alias("o"))
    near = halves.select(
        "fp", "low", "high", "o", F.explode(F.filter("two", lambda t: t["over"] + F.col("o.over") <= threshold)).alias("t")
    )
    replicas = near.select(anchor(F.col("o"), F.col("t")), F.col("fp").alias("b"))
    homes = reached(0).select(anchor(F.col("one")[0], F.col("two")[0]), F.col("fp").alias("a"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    return homes.join(replicas, "anchor").where(close).select("a", "b")


def near_duplicates(documents: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, digest, fp, root, component_id) for every document row.

    component_id is the smallest doc_id reachable over links, the row's own
    included; rows of NULL id alone get NULL. NULL and blank texts have
    fingerprint zero and link like any other; repeated rows stay repeated.
    """
    printed = write_table(
        documents.select("doc_id", text_digest(F.col("text")).alias("digest"), fingerprints(F.col("text")).alias("fp")), "prints"
    )
    nodes = write_table(printed.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes.select("fp"), threshold)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    rooted = write_table(rooted.select("fp", "root").join(least, "root").select("fp", "root", "component_id"), "rooted")
    return printed.join(rooted, "fp").select("doc_id", "digest", "fp", "root", "component_id")


def op1_simhash(documents: DataFrame) -> DataFrame:
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_duplicates(documents).select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The documents' own columns, one row of each group that links of `threshold` bits connect: that of the smallest
    (doc_id, digest), NULL ids last. Repeated rows are one document."""
    found = near_duplicates(documents, threshold)
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    # By root, not component_id: groups of one repeated doc_id share that.
    best = found.groupBy("root").agg(F.min(rank).alias("best"))
    kept = write_table(best.select(F.col("best.doc_id").alias("_id"), F.col("best.digest").alias("_digest")).distinct(), "kept")
    kept = broadcast_if_small(kept, kept.count())
    marked = documents.withColumn("_print", text_digest(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_digest"))
    return marked.join(kept, same).dropDuplicates(["doc_id", "_print"]).select(*[documents[c] for c in documents.columns])
