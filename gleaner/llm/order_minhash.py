"""Order MinHash fingerprints of documents, sensitive to edit distance, in SQL functions only.

A text's tokens are its words, words over PIECE code points cut into pieces. A k-mer is K tokens in a row (fewer tokens
are one k-mer), numbered among its equals from the left, so repeats count. Numbered k-mers are hashed once and dealt to
bins by the hash; the least of each bin is selected (one permutation, so a k-mer costs one hash and not one per
entry), and an empty bin takes that of the next bin above that has one, round the end. Each entry of the fingerprint
owns two bins: their k-mers are put in text order and hashed together, so an entry agrees where two texts share
both in the same order. The likeness of two fingerprints is the share of entries that agree.

Numbering needs no shuffle: a row's k-mer hashes, packed with their places, are sorted as one array of longs, whose
runs are the equals. Selection is a plain minimum of longs, hash above place, so it is combined in the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import numbered, text_digest
from gleaner.session import broadcast_if_small, write_table

K = 3
ENTRIES = 32
BINS = 2 * ENTRIES
PIECE = 16
# Bits of a place; an array of longs has at most 2^28 elements.
PLACE_BITS = 28
PLACE = (1 << PLACE_BITS) - 1
ENTRY = (1 << 32) - 1


def _first(text: Column, n: Column) -> Column:
    return F.left(text, n.cast("int"))


def _kmers(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, at, kmer, nth): one row per k-mer of `text`; one of NULLs where there is none."""
    tokens = F.regexp_extract_all("text", F.lit(f"[^ \\t\\n\\x0B\\f\\r]{{1,{PIECE}}}"), F.lit(0))
    hashed = rows.select(*keep, F.transform(tokens, lambda t: F.xxhash64(t)).alias("_h"))

    def kmer(i: Column) -> Column:
        return F.xxhash64(*[F.get("_h", i + j) for j in range(K)])

    places = F.when(F.size("_h") == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(F.size("_h") - K, F.lit(0))))
    above = F.lit(~PLACE)
    packed = F.transform(places, lambda i: kmer(i).bitwiseAND(above).bitwiseOR(i.cast("long")))
    ordered = hashed.withColumn("_s", F.sort_array(packed))
    indexes = F.when(F.size("_s") == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size("_s") - 1))
    opens = F.filter(indexes, lambda i: (i == 0) | (F.get("_s", i).bitwiseXOR(F.get("_s", i - 1)).bitwiseAND(above) != 0))
    runs = ordered.withColumn("_r", F.concat(opens, F.array(F.size("_s"))))
    runs = runs.select(*keep, "_h", "_s", "_r", F.posexplode_outer(F.slice("_r", F.lit(1), F.greatest(F.size("_r") - 1, F.lit(0)))).alias("_n", "_open"))
    each = runs.select(*keep, "_h", "_s", "_open", F.explode_outer(F.sequence("_open", F.get("_r", F.col("_n") + 1) - 1)).alias("_i"))
    placed = each.select(*keep, "_h", F.get("_s", "_i").bitwiseAND(F.lit(PLACE)).cast("int").alias("at"), (F.col("_i") - F.col("_open")).alias("nth"))
    return placed.select(*keep, "at", kmer(F.col("at")).alias("kmer"), "nth")


def signatures(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, entries): the fingerprint of `text` as an array of 32-bit numbers, zeros where it has no k-mer; `keep` names a row."""
    x = F.xxhash64("kmer", "nth")
    drawn = _kmers(rows, keep).select(*keep, F.when(F.col("at").isNotNull(), x).alias("x"), "at")
    packed = F.col("x").bitwiseAND(F.lit(~PLACE)).bitwiseOR(F.col("at").cast("long"))
    least = drawn.groupBy(*keep, F.col("x").bitwiseAND(F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.min(packed).alias("least"))
    held = least.groupBy(*keep).agg(F.array_sort(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "least")))).alias("held"))
    # A selected k-mer stands in its own bin and in the empty ones below it, the first one also above the last.
    below = F.flatten(F.transform("held", lambda e, i: F.array_repeat(e["least"], e["bin"] - F.when(i == 0, -1).otherwise(F.get("held", i - 1)["bin"]))))
    above = F.array_repeat(F.get("held", F.lit(0))["least"], BINS - 1 - F.get("held", F.size("held") - 1)["bin"])
    filled = held.select(*keep, F.concat(below, above).alias("m"))

    def entry(j: Column) -> Column:
        a, b = F.get("m", 2 * j), F.get("m", 2 * j + 1)
        x, y = F.shiftright(a, PLACE_BITS), F.shiftright(b, PLACE_BITS)
        in_order = a.bitwiseAND(F.lit(PLACE)) <= b.bitwiseAND(F.lit(PLACE))
        return F.when(in_order, F.xxhash64(F.lit(0), x, y)).otherwise(F.xxhash64(F.lit(1), y, x)).bitwiseAND(F.lit(ENTRY))

    entries = F.transform(F.sequence(F.lit(0), F.lit(ENTRIES - 1)), entry)
    return filled.select(*keep, F.coalesce(F.when(F.size("m") > 0, entries), F.array_repeat(F.lit(0).cast("long"), ENTRIES)).alias("entries"))


def likeness(a: str, b: str) -> Column:
    """The share of entries that agree; 1 for equal texts."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(ENTRIES))


def as_text(entries: str) -> Column:
    return F.array_join(F.transform(entries, lambda e: F.lower(F.lpad(F.hex(e), 8, "0"))), "")


def fingerprints(documents: DataFrame) -> DataFrame:
    """The documents' own rows and columns with `fingerprint` (replacing a column of that name), 8 hex digits an entry."""
    texts = documents.select(F.coalesce("text", F.lit("")).alias("text")).distinct()
    found = signatures(texts.withColumn("_digest", F.sha2("text", 256)), ["_digest"])
    found = found.select("_digest", as_text("entries").alias("_fingerprint"))
    marked = documents.withColumn("_digest", F.sha2(F.coalesce("text", F.lit("")), 256)).join(found, "_digest")
    return marked.withColumn("fingerprint", F.col("_fingerprint")).drop("_digest", "_fingerprint")


def _with_neighbours(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places in descending order of (doc_id, text digest), NULL ids last, as a ring; and per place the text and the
    edited text, whose second half is the beginning of the next place's text. Texts are shuffled once, beginnings with them."""
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", text_digest(F.col("text")))
    counted = rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"), F.max(F.length("text")).cast("long").alias("n_chars"))
    placed = write_table(numbered(counted, [F.desc_nulls_last("doc_id"), F.desc("digest")], "place"), "placed")
    n = placed.count()
    wanted = placed.select(((F.col("place") + 1) % n).alias("place"), F.col("place").alias("asking"), F.floor(F.col("n_chars") / 2).alias("asked"))
    roles = placed.join(wanted, "place").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "place", "asking", "asked")
    roles = broadcast_if_small(write_table(roles, "roles"), n)
    met = rows.join(roles, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))
    none = F.lit(None).cast("string")
    own = F.struct("place", "text", none.alias("head"))
    lent = F.struct(F.col("asking").alias("place"), none.alias("text"), _first(F.col("text"), F.col("asked")).alias("head"))
    dealt = met.select(F.explode(F.array(own, lent)).alias("dealt")).select("dealt.*")
    pairs = dealt.groupBy("place").agg(F.max("text").alias("text"), F.max("head").alias("head"))
    stays = F.length("text") - F.floor(F.length("text") / 2)
    return placed, pairs.select("place", "text", F.concat(_first(F.col("text"), stays), F.col("head")).alias("edited"))


def op11_order_minhash(documents: DataFrame) -> DataFrame:
    """Rows equal in doc_id and text are one document and get equal rows; of one doc_id's texts the order is that of
    their hashes. A NULL text is empty; a NULL doc_id comes last. A lone document is its own next one."""
    placed, pairs = _with_neighbours(documents)
    both = F.explode(F.array(F.struct(F.lit(0).alias("which"), "text"), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text"))))
    sides = pairs.select("place", both.alias("side")).select("place", "side.*")
    sides = sides.withColumn("sha", F.when(F.col("which") == 1, F.sha2("text", 256)))
    found = write_table(signatures(sides, ["place", "which", "sha"]), "signatures")
    n = placed.count()
    own = found.where("which = 0").select("place", "entries")
    edited = found.where("which = 1").select("place", "sha", F.col("entries").alias("edited_entries"))
    after = own.select(((F.col("place") + (n - 1)) % n).alias("place"), F.col("entries").alias("next_entries"))
    whole = placed.join(own, "place").join(edited, "place").join(after, "place")
    found = whole.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), as_text("entries").alias("fingerprint"), as_text("edited_entries").alias("edited_fingerprint"),
        likeness("entries", "edited_entries").alias("near_edited"), likeness("entries", "next_entries").alias("near_next"), "copies",
    )
    return found.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")
