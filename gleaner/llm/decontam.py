"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows.

Texts and items are normalised byte by byte (A-Z lower-cased, separators to
blanks), so a word's place in the normalised text is its place in the original.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.session import write_table

WINDOW = 13
# Characters of windows in one automaton (some 40 bytes each in a worker); a larger
# benchmark is scanned for in several passes over the documents.
AUTOMATON_CHARS = 3_000_000

# Bytes 0-9, a-z and all of other scripts stay, A-Z is lower-cased, the rest becomes blank.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")

# Tasks get this module's functions with the job; executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_NORMAL).split() if text else []


def windows_of(text: str | None, length: int = WINDOW) -> list[str]:
    """All windows of `length` words; the whole of a shorter item; nothing without words."""
    words = words_of(text)
    n = max(1, len(words) - length + 1) if words else 0
    return [b" ".join(words[i : i + length]).decode() for i in range(n)]


def _windows(texts: pd.Series) -> pd.Series:
    return pd.Series([windows_of(text) for text in texts], dtype=object)


def _automaton(patterns: list[tuple[str, list[str]]]) -> ahocorasick.Automaton:
    """Keys are ` w1 .. wn ` as Latin-1, one character per byte."""
    machine = ahocorasick.Automaton()
    for window, items in patterns:
        machine.add_word(f" {window} ".encode().decode("latin-1"), (window.count(" ") + 1, items))
    if patterns:
        machine.make_automaton()
    return machine


def _scan(text: str | None, machine: ahocorasick.Automaton) -> dict:
    normal = text.encode().translate(_NORMAL) if text else b""
    words = normal.split()
    out = {"n_words": len(words), "hits": [], "spans": [], "items": []}
    if not words or not len(machine):
        return out
    flat = b" " + b" ".join(words) + b" "
    found = list(machine.iter(flat.decode("latin-1")))
    if not found:
        return out
    blanks = np.flatnonzero(np.frombuffer(flat, dtype=np.uint8) == 32)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    items: set[str] = set()
    for end, (n, ids) in found:
        stop = int(np.searchsorted(blanks, end))
        change[stop - n] += 1
        change[stop] -= 1
        items.update(ids)
    hits = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    # Original character offsets of each stretch of hit words.
    places = [m.span() for m in _WORD.finditer(normal)]
    before = np.concatenate(([0], np.cumsum((np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80)))
    breaks = np.flatnonzero(np.diff(hits) > 1)
    firsts, lasts = hits[np.concatenate(([0], breaks + 1))], hits[np.concatenate((breaks, [len(hits) - 1]))]
    spans = [{"start": int(before[places[a][0]]), "end": int(before[places[b][1]])} for a, b in zip(firsts, lasts)]
    return out | {"hits": hits.tolist(), "spans": spans, "items": sorted(items)}


FOUND = "n_words long, hits array<long>, spans array<struct<start: long, end: long>>, items array<string>"


def _scanner(shared: Broadcast) -> Column:
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = _automaton(shared.value)
        for texts in batches:
            yield pd.DataFrame([_scan(text, machine) for text in texts], columns=["n_words", "hits", "spans", "items"])

    return F.pandas_udf(scan, FOUND)


def find(documents: DataFrame, benchmark: DataFrame, length: int = WINDOW, name: str = "_found") -> DataFrame:
    """The documents' rows with one more column `name`: number of words, indexes of hit words,
    original (start, end) character offsets of the stretches found, and the items found.

    NULL or blank texts and items have no words. Rows of the benchmark with a NULL
    item_id count for hits but are no items. Repeated rows on either side change nothing
    but the number of rows out.
    """
    spark = documents.sparkSession
    windows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.explode(F.pandas_udf(_windows, "array<string>")("text")).alias("window"))
    windows = write_table(windows.distinct(), "windows")
    chars = windows.agg(F.sum(F.octet_length("window"))).first()[0] or 0
    passes = max(1, -(-chars // AUTOMATON_CHARS))
    rows, parts = documents, []
    for k in range(passes):
        some = windows.where(F.pmod(F.xxhash64("window"), F.lit(passes)) == k)
        patterns: dict[str, list[str]] = {}
        for item, window in some.toLocalIterator():
            patterns.setdefault(window, []).extend([] if item is None else [item])
        shared = spark.sparkContext.broadcast(list(patterns.items()))
        parts.append(f"{name}{k}")
        rows = rows.withColumn(parts[-1], _scanner(shared)("text"))
        if passes > 1:  # one automaton in a worker at a time
            rows = write_table(rows, "scanned")

    def all_of(field: str) -> Column:
        found = F.col(f"{parts[0]}.{field}")
        for part in parts[1:]:
            found = F.array_union(found, F.col(f"{part}.{field}"))
        return F.array_sort(found).alias(field)

    merged = F.struct(F.col(f"{parts[0]}.n_words").alias("n_words"), *[all_of(x) for x in ("hits", "spans", "items")])
    return rows.withColumn(name, merged).drop(*parts)


def op7_decontamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find(documents.select("doc_id", "text"), benchmark)
    n_hit = F.size("_found.hits").cast("long")
    return found.select(
        "doc_id",
        F.col("_found.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_found.items"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("_found.n_words"))).alias("contaminated"),
    )


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents' own columns; contaminated rows (a twentieth of the words or more hit) go."""
    found = find(documents, benchmark)
    n_hit = F.size("_found.hits")
    return found.where((n_hit == 0) | (20 * n_hit < F.col("_found.n_words"))).drop("_found")


# Words by code point classes as above; windows per length of the items' own windows.
SQL = r"""
with item_words as (
  select cast(item_id as varchar) item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') w
  from benchmark where text is not null),
item_windows as (
  select distinct item, least(len(w), 13) n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') as win
  from (select item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) i from item_words where len(w) > 0)),
doc_words as (
  select row_number() over () r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) w
  from documents),
sized as (select r, w, n, unnest(range(1, len(w) - n + 2)) i from doc_words, (select distinct n from item_windows) where len(w) >= n),
hit as (
  select r, i, sized.n, item from sized join item_windows x
    on x.n = sized.n and x.win = array_to_string(list_slice(w, i, i + sized.n - 1), ' ')),
n_hit as (select r, count(distinct p) n_hit from (select distinct r, unnest(range(i, i + n)) p from hit) group by r),
items as (select r, count(distinct item) n_items, array_to_string(list_sort(list(distinct item)), ',') ids from hit group by r)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from doc_words left join n_hit using (r) left join items using (r)
"""
