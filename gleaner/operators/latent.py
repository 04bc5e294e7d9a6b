"""Dense vectors of texts: the leading right singular vectors of the corpus' tf-idf matrix.

The matrix A (a unit row per document, a column per word) is factored by subspace iteration from random
signs. It is dealt into blocks of documents of some BLOCK_ENTRIES entries, packed once and written. A pass makes
Y = A'D, a row per word, and A Y, a row per document, a few columns of these in each task: a task reads the blocks one
after the other and holds its columns alone. So what moves in a pass is the columns themselves, however many blocks there are:
those of Y for words of several blocks, written once, and those of D. A word of one block has its row of Y made there from D.
Only matrices of (dims + EXTRA) squared numbers pass the driver. A text's vector is its tf-idf
row times the singular vectors, for documents and questions alike.

The written vectors are two tables, `words` (term, vector) and `docs` (doc_id, vector); `numbers` has the places of
words of several blocks in the columns. Every document with a word has a vector; texts without a known word have none.
Fewer dimensions come out where A has a lower rank. A document whose entries outnumber a block is a block of its own.
Repeated doc_ids count as one document.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.operators.index import Index, smooth_idf
from gleaner.operators.search import question_terms
from gleaner.session import write_table

DIMS = 64
# Columns beyond the wanted ones, and passes before the last: both sharpen the last dimensions.
EXTRA = 16
PASSES = 3
# Some 150 bytes each in a task that packs, 50 in one that reads.
BLOCK_ENTRIES = 1_000_000
BLOCK_DOCS = 200_000
# Of the columns in one task: a number for every document and every word of several blocks.
COLUMN_BYTES = 128 * 1024 * 1024
# Words that are numbered in one task.
PART_WORDS = 100_000
# Directions with less than this part of the largest squared length are rounding errors.
TINY = 1e-12
ENTRIES = ("starts", "steps", "counts", "norms", "dfs", "numbers", "alone")
# `found` is the block's rows of A times the first signs.
PACKED = "block long, docs binary, " + "".join(f"{name} binary, " for name in ENTRIES) + "terms array<string>, found binary"
# A Y of a block's documents, with D' A Y, which sums up to Y'Y, and (A Y)' A Y.
STATE = "block long, found binary, squares binary, lengths binary"
# Rows of vectors that a task gives at a time.
GIVEN = 10_000

# Tasks get this module's functions with the job; executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Latent:
    words: DataFrame
    docs: DataFrame


def _signs(words: list[bytes], columns: int) -> Iterator[np.ndarray]:
    """Column i, from 1: a sign a word, the last bit of Spark's xxhash64(word, i), so that a rebuilt index has the same vectors."""
    rounds = np.array([11400714785074694791, 14029467366897019727, 1609587929392839161, 2870177450012600261], dtype=np.uint64)
    seeds = np.array([xxhash.xxh64_intdigest(word, 42) for word in words], dtype=np.uint64)
    for i in range(1, columns + 1):
        x = (seeds + rounds[3] + np.uint64(4)) ^ (np.uint64(i) * rounds[:1])
        x = (x << np.uint64(23) | x >> np.uint64(41)) * rounds[1] + rounds[2]
        x = (x ^ x >> np.uint64(33)) * rounds[1]
        x = (x ^ x >> np.uint64(29)) * rounds[2]
        yield ((x ^ x >> np.uint64(32)) & np.uint64(1)) * 2.0 - 1.0


def _idfs(dfs: np.ndarray, n_docs: int) -> np.ndarray:
    """`smooth_idf` of the index."""
    return np.log((n_docs + 1) / (dfs + 1)) + 1


def _packer(n_docs: int, width: int) -> Callable[[pa.Table], pa.Table]:
    def pack(rows: pa.Table) -> pa.Table:
        """One block's entries as sorted runs per document: word counts and `steps` from place to place in `terms`, which compress
        well, the documents' lengths, and the entries of words that no other block has."""
        term = rows["term"].combine_chunks().dictionary_encode()
        by = pc.sort_indices(term.dictionary).to_numpy()
        rank = np.empty(len(by), dtype=np.int64)
        rank[by] = np.arange(len(by))
        docs, at = np.unique(rows["doc_id"].to_numpy(), return_inverse=True)
        places = rank[term.indices.to_numpy()]
        order = np.lexsort((places, at))
        places, at = places[order], at[order]
        dfs, numbers = np.zeros(len(by), dtype=np.int64), np.zeros(len(by), dtype=np.int32)
        dfs[places], numbers[places] = rows["df"].to_numpy()[order], rows["number"].to_numpy()[order]
        terms = term.dictionary.take(pa.array(by)).to_pylist()
        counts, starts = rows["tf"].to_numpy()[order].astype(np.int32), np.flatnonzero(np.diff(at, prepend=-1))
        norms = np.sqrt(np.add.reduceat((counts * _idfs(dfs, n_docs)[places]) ** 2, starts))
        packed = {
            "block": rows["block"][0].as_py(),
            "docs": docs.tobytes(),
            "starts": starts.tobytes(),
            "steps": np.diff(places, prepend=0).astype(np.int32).tobytes(),
            "counts": counts.tobytes(),
            "norms": norms.tobytes(),
            "dfs": dfs.tobytes(),
            "numbers": numbers.tobytes(),
            "alone": np.flatnonzero(numbers[places] < 0).tobytes(),
            "terms": terms,
        }
        block = _Block(packed, n_docs)
        found = np.stack([block.times(column) for column in _signs([t.encode() for t in terms], width)], axis=1)
        schema = pa.schema([(name, {"long": pa.int64(), "binary": pa.binary()}.get(kind, pa.list_(pa.string()))) for name, kind in (x.split() for x in PACKED.split(", "))])
        return pa.Table.from_pylist([packed | {"found": found.tobytes()}], schema)

    return pack


def _numbered_words(postings: DataFrame, terms: DataFrame, path: str) -> tuple[DataFrame, int]:
    """(term, df, number) of all words and how many have a number; numbers are from 0 on, -1 for words of one block."""
    held = postings.groupBy("term").agg((F.min("block") < F.max("block")).alias("several"))
    parts = max(16, math.ceil(terms.count() / PART_WORDS))
    part = F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")
    place = F.row_number().over(Window.partitionBy("part", "several").orderBy("term")) - 1
    found = terms.select("term", "df").join(held, "term").withColumn("part", part)
    found.withColumn("place", F.when(F.col("several"), place)).drop("several").write.parquet(f"{path}/numbers")
    found = terms.sparkSession.read.parquet(f"{path}/numbers")
    sizes = {r["part"]: r["n"] for r in found.groupBy("part").agg(F.count("place").alias("n")).collect()}
    firsts = np.cumsum([0, *(sizes.get(i, 0) for i in range(parts))]).tolist()
    first = F.get(F.array(*[F.lit(n).cast("long") for n in firsts]), F.col("part"))
    return found.select("term", "df", F.coalesce(first + F.col("place"), F.lit(-1)).alias("number")), firsts[-1]


def packed_rows(index: Index, path: str, width: int, block_entries: int = BLOCK_ENTRIES) -> tuple[DataFrame, DataFrame, int]:
    """A in blocks of documents, a written table of PACKED rows; (term, df, number) of its words, and how many have a number."""
    n_docs = index.corpus.first().n_docs
    entries = index.terms.agg(F.sum("df")).first()[0] or 0
    n_blocks = max(1, math.ceil(entries / block_entries), math.ceil(n_docs / BLOCK_DOCS))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks))
    postings = index.postings.where("doc_id is not null").select(block.alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "term", "tf")
    words, n_numbers = _numbered_words(postings, index.terms, path)
    packed = postings.join(words, "term").groupBy("block").applyInArrow(_packer(n_docs, width), PACKED)
    return write_table(packed, "packed-rows"), words, n_numbers


class _Block:
    """A block's rows of A, unpacked: word counts, whose weights are put on columns. `shared` are the places of words that
    other blocks have too, `numbers` theirs, `own` the others'."""

    def __init__(self, packed: dict, n_docs: int):
        kinds = ("i8", "i4", "i4", "f8", "i8", "i4", "i8")
        self.starts, steps, counts, self.norms, dfs, numbers, alone = (np.frombuffer(packed[name], dtype=kind) for name, kind in zip(ENTRIES, kinds))
        self.places, self.counts = np.cumsum(steps, dtype=np.int64), counts.astype(np.float64)
        self.lengths, self.idfs = np.diff(np.append(self.starts, len(steps))), _idfs(dfs, n_docs)
        self.shared, self.own = np.flatnonzero(numbers >= 0), np.flatnonzero(numbers < 0)
        self.numbers = numbers[self.shared]
        # Entries of words that no other block has: their documents, places and counts.
        self.alone = np.searchsorted(self.starts, alone, side="right") - 1, self.places[alone], self.counts[alone]

    def times(self, right: np.ndarray) -> np.ndarray:
        """A times a column over the block's words."""
        return np.add.reduceat(self.counts * (self.idfs * right)[self.places], self.starts) / self.norms

    def transposed_times(self, left: np.ndarray) -> np.ndarray:
        """A' times a column over the block's documents."""
        entries = np.repeat(left / self.norms, self.lengths)
        entries *= self.counts
        return self.idfs * np.bincount(self.places, entries, minlength=len(self.idfs))

    def own_sums(self, left: np.ndarray) -> np.ndarray:
        """A' times a column for the words that no other block has; other places hold zeros."""
        rows, places, counts = self.alone
        return self.idfs * np.bincount(places, counts * (left / self.norms)[rows], minlength=len(self.idfs))


def _lists(vectors: np.ndarray) -> pa.Array:
    rows, width = vectors.shape
    return pa.ListArray.from_arrays(np.arange(0, rows * width + 1, width, dtype=np.int32) if width else np.zeros(rows + 1, dtype=np.int32), np.ascontiguousarray(vectors).ravel())


def _given(key: str, keys: pa.Array, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(keys), GIVEN):
        yield pa.RecordBatch.from_arrays([keys[start : start + GIVEN], _lists(vectors[start : start + GIVEN])], [key, "vector"])


def _taken(packed: pa.RecordBatch, names: tuple[str, ...], row: int) -> dict:
    return {name: packed[name][row].as_buffer() for name in names}


def _unpacked_rows(found: object, columns: int) -> np.ndarray:
    return np.frombuffer(found, dtype=np.float64).reshape(-1, columns)


def _by_columns(blocks: DataFrame, tables: Callable[[int], list[DataFrame]], chunks: list[range], task: Callable, schema: str) -> DataFrame:
    """A task for each chunk of columns, which reads the rows of `tables` one table after the other; only what it gives moves."""
    each = []
    for number, chunk in enumerate(chunks):
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables(number))
        each.append(rows.coalesce(1).mapInArrow(task(number, chunk), schema))
    # Single partitions alone would be united in one; a scan without rows keeps them apart.
    none = blocks.where("block < 0").mapInArrow(lambda batches: iter(()), schema)
    return reduce(DataFrame.union, each, none)


def _shared_words(blocks: DataFrame, words: DataFrame, state: DataFrame, turn: np.ndarray, chunks: list[range], n_blocks: int, n_numbers: int, n_docs: int) -> DataFrame:
    """(term, number, chunk, vector), a written table: those columns of Y = A'D of the words of several blocks, for D = `state` turned."""
    wanted = words.where("number >= 0").select("term", "number")

    def task(number: int, chunk: range) -> Callable:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = turn[:, chunk.start : chunk.stop]
            out, left, early, done = np.zeros((len(chunk), n_numbers)), {}, [], 0

            def given(batch: pa.RecordBatch, at: np.ndarray) -> pa.RecordBatch:
                batch = batch.take(pa.array(at))
                vectors = _lists(out[:, batch["number"].to_numpy()].T)
                return pa.RecordBatch.from_arrays([batch["term"], batch["number"], pa.array(np.full(len(at), number)), vectors], ["term", "number", "chunk", "vector"])

            # The scans are read in this order; rows that a scheduler brings earlier wait.
            waiting: dict[int, dict] = {}
            for batch in batches:
                ids = batch["block"].to_pylist()
                for row in np.flatnonzero(batch["found"].is_valid().to_numpy(zero_copy_only=False)):
                    left[ids[row]] = _unpacked_rows(batch["found"][row].as_buffer(), len(turn)) @ part
                for row in np.flatnonzero(batch["steps"].is_valid().to_numpy(zero_copy_only=False)):
                    waiting[ids[row]] = _taken(batch, ENTRIES, row)
                for block in [b for b in waiting if b in left]:
                    entries, columns = _Block(waiting.pop(block), n_docs), left.pop(block)
                    done += 1
                    for k in range(len(chunk)):
                        out[k][entries.numbers] += entries.transposed_times(columns[:, k])[entries.shared]
                at = np.flatnonzero(batch["term"].is_valid().to_numpy(zero_copy_only=False))
                if len(at) and done < n_blocks:
                    early.append((batch, at))
                elif len(at):
                    yield given(batch, at)
            for batch, at in early:
                yield given(batch, at)

        return sums

    tables = [state.select("block", "found"), blocks.select("block", *ENTRIES), wanted]
    made = _by_columns(blocks, lambda _: tables, chunks, task, "term string, number long, chunk long, vector array<double>")
    return write_table(made, "word-vectors")


def _documents(blocks: DataFrame, words: DataFrame, state: DataFrame, turn: np.ndarray, chunks: list[range], n_numbers: int, n_docs: int) -> DataFrame:
    """A Y as STATE rows; Y of words of several blocks is `words`, that of others is made of D = `state` turned."""
    held = [words.where(F.col("chunk") == number).select("number", "vector") for number in range(len(chunks))]

    def task(number: int, chunk: range) -> Callable:
        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, width = turn[:, chunk.start : chunk.stop], len(chunk)
            sums, known, left, waiting = np.zeros((width, n_numbers)), 0, {}, {}
            for batch in batches:
                ids = batch["block"].to_pylist()
                for row in np.flatnonzero(batch["found"].is_valid().to_numpy(zero_copy_only=False)):
                    left[ids[row]] = _unpacked_rows(batch["found"][row].as_buffer(), len(turn)) @ part
                at = np.flatnonzero(batch["number"].is_valid().to_numpy(zero_copy_only=False))
                if len(at):
                    some = batch.take(pa.array(at))
                    sums[:, some["number"].to_numpy()] = some["vector"].flatten().to_numpy().reshape(-1, width).T
                    known += len(at)
                for row in np.flatnonzero(batch["steps"].is_valid().to_numpy(zero_copy_only=False)):
                    waiting[ids[row]] = _taken(batch, ENTRIES, row)
                for block in [b for b in waiting if b in left and known == n_numbers]:
                    entries, last = _Block(waiting.pop(block), n_docs), left.pop(block)
                    found = np.empty(last.shape)
                    for k in range(width):
                        right = entries.own_sums(last[:, k])
                        right[entries.shared] = sums[k][entries.numbers]
                        found[:, k] = entries.times(right)
                    columns = [[block], [number], [found.tobytes()], [np.ascontiguousarray(last).tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "chunk", "found", "last"])

        return products

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        found, last = (np.concatenate([_unpacked_rows(x, len(chunks[at])) for at, x in zip(rows["chunk"], rows[name])], axis=1) for name in ("found", "last"))
        out = {"found": found, "squares": last.T @ found, "lengths": found.T @ found}
        return pd.DataFrame({"block": [rows["block"].iloc[0]]} | {name: [np.ascontiguousarray(x).tobytes()] for name, x in out.items()})

    def tables(number: int) -> list[DataFrame]:
        return [state.select("block", "found"), held[number], blocks.select("block", *ENTRIES)]

    made = _by_columns(blocks, tables, chunks, task, "block long, chunk long, found binary, last binary")
    return write_table(made.groupBy("block").applyInPandas(together, STATE), "documents")


def _document_vectors(blocks: DataFrame, state: DataFrame, turn: np.ndarray) -> DataFrame:
    """(doc_id, vector): the rows of `state` times `turn`."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                docs = pa.array(np.frombuffer(batch["docs"][row].as_buffer(), dtype=np.int64))
                yield from _given("doc_id", docs, _unpacked_rows(batch["found"][row].as_buffer(), len(turn)) @ turn)

    return blocks.select("block", "docs").join(state.select("block", "found"), "block").mapInArrow(rows, "doc_id long, vector array<double>")


def _own_words(blocks: DataFrame, state: DataFrame, turn: np.ndarray, n_docs: int) -> DataFrame:
    """(term, vector): A' times the rows of `state` times `turn`, for the words that no other block has."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                block = _Block(_taken(batch, ENTRIES, row), n_docs)
                last = _unpacked_rows(batch["found"][row].as_buffer(), len(turn)) @ turn
                terms = batch["terms"][row].values.take(pa.array(block.own))
                sums = np.empty((len(block.own), turn.shape[1]))
                for k in range(turn.shape[1]):
                    sums[:, k] = block.own_sums(last[:, k])[block.own]
                yield from _given("term", terms, sums)

    return blocks.select("block", *ENTRIES, "terms").join(state.select("block", "found"), "block").mapInArrow(rows, "term string, vector array<double>")


def _summed(state: DataFrame, name: str, width: int) -> np.ndarray:
    """The sum of the blocks' matrices; zeros where there are none."""

    def numbers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for squares in batches:
            yield pd.Series([np.frombuffer(s, dtype=np.float64) for s in squares], dtype=object)

    each = state.select(F.posexplode(F.pandas_udf(numbers, "array<double>")(name)).alias("at", "value"))
    out = np.zeros(width * width)
    for r in each.groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out.reshape(width, width)


def _directions(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above TINY and their vectors, largest first; of either sign the one whose largest number is positive."""
    values, vectors = np.linalg.eigh((squares + squares.T) / 2)
    kept = np.flatnonzero(values > TINY * max(values[-1], 1e-300))[::-1] if len(values) else []
    values, vectors = values[kept], vectors[:, kept]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(kept))]) if len(kept) else np.ones(0)
    return values, vectors * signs


def _turned(rows: DataFrame, key: str, turn: np.ndarray) -> DataFrame:
    """(key, vector) with every vector multiplied by the small matrix `turn`."""

    def turned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            yield pd.Series(list(np.stack(vectors.to_numpy()) @ turn) if len(vectors) else [], dtype=object)

    return rows.select(key, F.pandas_udf(turned, "array<double>")("vector").alias("vector"))


def _chunks(width: int, numbers: int, tasks: int) -> list[range]:
    """The columns of each task: one for every core, or as few as COLUMN_BYTES hold."""
    size = max(1, min(math.ceil(width / tasks), COLUMN_BYTES // (8 * max(1, numbers))))
    return [range(at, min(at + size, width)) for at in range(0, width, size)]


def build_latent(index: Index, path: str, *, dims: int = DIMS, passes: int = PASSES, block_entries: int = BLOCK_ENTRIES) -> np.ndarray:
    """Write the vectors of an index's words and documents under `path`; the singular values, largest first."""
    if dims < 1 or passes < 1:
        raise ValueError("dims and passes must be positive")
    width, n_docs = dims + EXTRA, index.corpus.first().n_docs
    blocks, numbered, n_numbers = packed_rows(index, path, width, block_entries)
    n_blocks, tasks = blocks.count(), blocks.sparkSession.sparkContext.defaultParallelism
    state, turn = blocks.select("block", "found"), np.eye(width)
    for _ in range(passes):
        chunks = _chunks(width, n_numbers + n_docs, tasks)
        words = _shared_words(blocks, numbered, state, turn, chunks, n_blocks, n_numbers, n_docs)
        last, before = state, turn
        state = _documents(blocks, words, last, before, chunks, n_numbers, n_docs)
        values, vectors = _directions(_summed(state, "squares", width))
        turn = vectors / np.sqrt(values)
        lengths, width = turn.T @ _summed(state, "lengths", width) @ turn, turn.shape[1]
    squares, rotation = _directions(lengths)
    turn, squares = turn @ rotation[:, :dims], squares[:dims]
    ordered = F.sort_array(F.collect_list(F.struct("chunk", "vector")))
    shared = words.groupBy("term").agg(F.flatten(F.transform(ordered, lambda x: x["vector"])).alias("vector"))
    own = _own_words(blocks, last, before @ turn, n_docs)
    _turned(shared, "term", turn).unionByName(own).write.parquet(f"{path}/words")
    _document_vectors(blocks, state, turn).write.parquet(f"{path}/docs")
    return np.sqrt(squares)


def read_latent(spark: SparkSession, path: str) -> Latent:
    return Latent(spark.read.parquet(f"{path}/words"), spark.read.parquet(f"{path}/docs"))


def question_vectors(questions: DataFrame, index: Index, latent: Latent) -> DataFrame:
    """(q_id, vector) of (q_id, question) in the documents' space; a question without a known word has none."""
    n_docs = index.corpus.select("n_docs").scalar()
    weight = F.col("qtf") * smooth_idf(F.col("df"), n_docs)
    weighted = question_terms(questions).join(index.terms.select("term", "df"), "term").select("q_id", "term", weight.alias("weight"))
    entries = weighted.join(latent.words, "term").select("q_id", "weight", F.posexplode("vector").alias("at", "value"))
    sums = entries.groupBy("q_id", "at").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))
    ordered = F.sort_array(F.collect_list(F.struct("at", "value")))
    return sums.groupBy("q_id").agg(F.transform(ordered, lambda x: x["value"]).alias("vector"))
