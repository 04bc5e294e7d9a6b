"""Line deduplication: suffix ranks over line-ID sequences by distributed prefix doubling.

A document is a sequence of line IDs. Only lines that occur twice or more can be part of a
repeated run, so only they are ranked. Round k ranks every suffix by its first 2^k lines:
the pair of ranks of its two halves is sorted over the whole corpus and numbered. Suffixes
that agree in their first L lines are one interval of the suffix order (longest common
prefix at least L); for any L the two overlapping halves of 2^k lines name the interval.

A run counts as repeated if it has `min_words` words or more. Every such run is the union of
its least windows of that many words from each start and to each end, so those windows alone
are looked up: of each interval the window earliest in the corpus (by doc_id, text digest,
line) stays, and the lines of the later copies are deleted. A window has at most `min_words`
lines, hence ranks beyond that depth change nothing and the doubling stops there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import BLANKS, numbered, text_digest
from gleaner.session import write_table

MIN_WORDS = 20
EDGES = " \t\x0b\f\r"
ROW = ("doc_id", "digest")


def _lines(documents: DataFrame) -> DataFrame:
    """(doc_id, digest, pos, at, words, one, two): the non-blank lines; `at` counts them, `pos` counts all from 0."""
    line = F.struct(F.col("i").cast("int").alias("pos"), F.btrim("line", F.lit(EDGES)).alias("line"))
    split = documents.select(
        "doc_id", text_digest(F.col("text")).alias("digest"), F.posexplode(F.split("text", "\n")).alias("i", "line")
    )
    full = split.select(*ROW, line.alias("l")).where("l.line <> ''").select(*ROW, "l.*")
    # Two hashes of different seeds name a line.
    return full.select(
        *ROW, "pos", F.size(F.split("line", BLANKS)).alias("words"), F.xxhash64("line").alias("one"), F.xxhash64(F.lit(1), "line").alias("two")
    )


def _repeated(documents: DataFrame) -> DataFrame:
    """(doc_id, digest, pos, at, words, rank): lines that occur twice or more, ranked by line ID."""
    in_order = Window.partitionBy(*ROW).orderBy("pos")
    # Repeated rows give the same line twice; one of them speaks for both.
    lines = _lines(documents).dropDuplicates([*ROW, "pos"]).withColumn("at", F.row_number().over(in_order))
    lines = write_table(lines, "lines")
    ids = lines.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1").select("one", "two")
    ids = write_table(numbered(ids, ["one", "two"], "rank"), "line-ids")
    return write_table(lines.join(ids, ["one", "two"]).select(*ROW, "pos", "at", "words", "rank"), "repeated")


def _doubled(suffixes: DataFrame, k: int) -> DataFrame:
    """Ranks by the first 2^(k + 1) lines, column r<k + 1>; NULL where the repeated lines end before."""
    half, rank = 1 << k, f"r{k}"
    ahead = Window.partitionBy(*ROW).orderBy("at")
    follows = F.lead("at", half).over(ahead) == F.col("at") + half
    paired = suffixes.withColumn("next", F.when(follows, F.lead(rank, half).over(ahead)))
    paired = write_table(paired, f"paired{k}")
    pairs = paired.where(F.col("next").isNotNull() & F.col(rank).isNotNull()).groupBy(rank, "next").agg(F.count("*").alias("n"))
    # A pair that occurs once is no interval; its suffix needs no rank.
    named = write_table(numbered(pairs.where("n > 1").select(rank, "next"), [rank, "next"], f"r{k + 1}"), f"ranks{k + 1}")
    return paired.join(named, [rank, "next"], "left").select(*suffixes.columns, f"r{k + 1}")


def _least(ahead: Column, min_words: int) -> Column:
    """Number of leading elements that have `min_words` words together and no gap; NULL if there are none."""
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(seen: Column, line: Column) -> Column:
        joined = seen["open"] & (F.abs(line["at"] - ahead[0]["at"]) == seen["n"])
        words = F.when(joined, seen["words"] + line["words"]).otherwise(seen["words"])
        return F.struct(
            words.cast("int").alias("words"),
            (seen["n"] + joined.cast("int")).alias("n"),
            (joined & (words < min_words)).alias("open"),
        )

    return F.aggregate(ahead, start, step, lambda seen: F.when(seen["words"] >= min_words, seen["n"]))


def _windows(suffixes: DataFrame, levels: int, min_words: int) -> DataFrame:
    """(doc_id, digest, n, one, two, lines): the least windows; one and two name the interval of n lines."""
    names = F.struct("at", "pos", "words", *[f"r{k}" for k in range(levels + 1)])
    in_order = Window.partitionBy(*ROW).orderBy("at")
    seen = suffixes.select(
        *ROW,
        F.collect_list(names).over(in_order.rowsBetween(0, min_words - 1)).alias("ahead"),
        F.reverse(F.collect_list(names).over(in_order.rowsBetween(1 - min_words, 0))).alias("behind"),
    )
    forth = seen.select(*ROW, "ahead", _least(F.col("ahead"), min_words).alias("n"), F.slice("ahead", 1, min_words).alias("run"))
    forth = forth.where("n is not null").select(*ROW, "n", F.slice("run", 1, F.col("n")).alias("run"))
    back = seen.select(*ROW, "behind", _least(F.col("behind"), min_words).alias("n")).where("n is not null")
    back = back.select(*ROW, "n", F.reverse(F.slice("behind", 1, F.col("n"))).alias("run"))

    def name(first: bool) -> Column:
        """Rank at the greatest power of two within n lines, at the window's start or so that it ends with it."""
        found = F.lit(None).cast("long")
        for k in range(levels + 1):
            place = F.col("run")[0] if first else F.col("run")[F.col("n") - (1 << k)]
            found = F.when((F.col("n") >= 1 << k) & (F.col("n") < 2 << k), place[f"r{k}"]).otherwise(found)
        return found

    lines = F.transform("run", lambda line: line["pos"]).alias("lines")
    both = forth.union(back).select(*ROW, "n", name(True).alias("one"), name(False).alias("two"), lines)
    return both.where("one is not null and two is not null")


def repeats(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, digest, deleted): for documents that lose lines, their indexes from 0, in order.

    Lines are compared without surrounding blanks; blank lines are no lines and stay. NULL and
    blank texts lose nothing. doc_id may be NULL (earliest). Rows equal in doc_id and text are
    one document: they lose the same lines and are no copies of each other.
    """
    suffixes = _repeated(documents).withColumnRenamed("rank", "r0")
    levels = max(0, min_words.bit_length() - 1)
    for k in range(levels):
        suffixes = _doubled(suffixes, k)
    windows = write_table(_windows(suffixes, levels, min_words), "windows")
    place = F.struct(*ROW, F.col("lines")[0].alias("line"))
    first = windows.groupBy("n", "one", "two").agg(F.min(place).alias("first"), F.count("*").alias("copies"))
    first = write_table(first.where("copies > 1").drop("copies"), "intervals")
    later = windows.join(first, ["n", "one", "two"]).where(place > F.col("first"))
    gone = later.select(*ROW, F.explode("lines").alias("line")).groupBy(*ROW).agg(F.array_sort(F.collect_set("line")).alias("deleted"))
    return write_table(gone, "deleted")


def _joined(documents: DataFrame, deleted: DataFrame, digest: Column) -> DataFrame:
    gone = deleted.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_of"), F.col("deleted").alias("_deleted"))
    marked = documents.withColumn("_digest", digest)
    return marked.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_of")), "left")


def without_repeats(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents' own rows and columns, `text` without the later copies of repeated runs
    (and n_chars, where there is one, counted again)."""
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_deleted")
    left = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    found = _joined(documents, repeats(documents, min_words), text_digest(F.col("text")))
    changed = found.withColumn("text", F.when(F.col("_deleted").isNull(), F.col("text")).otherwise(left))
    if "n_chars" in documents.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("_deleted").isNull(), F.col("n_chars")).otherwise(F.length("text")))
    return changed.select(*documents.columns)


def op9_line_dedup(documents: DataFrame) -> DataFrame:
    n_lines = F.coalesce(F.size(F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(EDGES)) != "")), F.lit(0))
    rows = documents.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), text_digest(F.col("text")).alias("_d"))
    found = _joined(rows, repeats(documents), F.col("_d"))
    gone = F.coalesce("_deleted", F.array().cast("array<int>"))
    return found.select("doc_id", "n_lines", F.size(gone).cast("long").alias("n_removed"), F.array_join(gone.cast("array<string>"), ",").alias("removed"))


# min_words is 20. Documents are told apart by their row number; ties of doc_id are not expected.
SQL = r"""
with split as (
  select doc_id, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) pos
  from documents where text is not null),
lines as (
  select doc_id, pos, row_number() over (partition by doc_id order by pos) as place, t line,
         len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) words
  from (select doc_id, pos, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) t from split) where t <> ''),
forth as (
  select a.doc_id, a.place from_place, b.place to_place, sum(b.words) over w s, b.words
  from lines a join lines b on a.doc_id = b.doc_id and b.place between a.place and a.place + 19
  window w as (partition by a.doc_id, a.place order by b.place)),
back as (
  select a.doc_id, b.place from_place, a.place to_place, sum(b.words) over w s, b.words
  from lines a join lines b on a.doc_id = b.doc_id and b.place between a.place - 19 and a.place
  window w as (partition by a.doc_id, a.place order by b.place desc)),
least_runs as (
  select doc_id, from_place, to_place from forth where s >= 20 and s - words < 20
  union select doc_id, from_place, to_place from back where s >= 20 and s - words < 20),
runs as (
  select r.doc_id, from_place, string_agg(line, chr(10) order by place) run, list(pos) poses
  from least_runs r join lines l on l.doc_id = r.doc_id and l.place between from_place and to_place group by r.doc_id, from_place, to_place),
later as (
  select doc_id, poses from (select *, first_value((doc_id, from_place)) over (partition by run order by doc_id, from_place) f from runs)
  where (doc_id, from_place) > f),
gone as (select distinct doc_id, unnest(poses) pos from later),
counted as (select doc_id, count(*) n, string_agg(pos, ',' order by pos) removed from gone group by doc_id),
sizes as (select doc_id, count(*) n from lines group by doc_id)
select d.doc_id, coalesce(s.n, 0) n_lines, coalesce(c.n, 0) n_removed, coalesce(removed, '') removed
from documents d left join sizes s using (doc_id) left join counted c using (doc_id)
"""
