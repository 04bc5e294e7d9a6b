"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The words of a source, its documents in a pseudo-random order, are a stream that may be read
twice; the stream up to the source's target is cut into blocks of BLOCK words. Each node of
a binary tree over the output shards splits its exact block quotas, source by source, between
its two halves as drawing without replacement would. The leaves own a stretch of each source's
permuted blocks, disjoint and exhaustive, and order theirs by a hash. All draws are hashes of
fixed seeds, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import numbered, text_digest
from gleaner.session import write_table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
TIMES = 2
BLOCK = 4096
SHARDS = 16
SEED = "mix"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, times: int = TIMES) -> DataFrame:
    """(source, source_size, target) of (source, source_size): `share` of all words by weight, none above
    `times` its size; what exceeds that is shared again among the rest until no source is above."""
    known = sizes.withColumn("missing", F.col("source").isNull())
    ranked = numbered(known, ["missing", "source"], "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * times
    rows = write_table(ranked.select("source", "source_size", weight.alias("weight"), limit.alias("limit")), "sources")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, F.lit(False)
    while True:
        # One row: what the sources at their limit take, and the weight of the others.
        taken, rest, n_full = rows.agg(
            F.sum(F.when(full, F.col("limit")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight"))), F.sum(full.cast("long"))
        ).first()
        if not rest:
            break
        level = (share * total - taken) / rest
        above = full | (F.col("weight") * F.lit(level) > F.col("limit"))
        if rows.agg(F.sum(above.cast("long"))).first()[0] == n_full:
            break
        full = above
    target = F.when(full, F.col("limit").cast("double")).otherwise(F.col("weight") * F.lit(level))
    return write_table(rows.select("source", "source_size", target.alias("target")), "targets")


def laid_out(rows: DataFrame, group: str, key: str, order: list[str], size: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `size` over the rows before, within `group`, by `key` (a hash in hex) and `order`.
    Sums of 4,096 ranges of the hash come first, so a hot group is many windows."""
    ranged = rows.withColumn("_range", F.substring(key, 1, 3))
    sums = ranged.groupBy(group, "_range").agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("_group"), F.col("_range").alias("_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(group, "_range").orderBy(key, *order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_within", F.coalesce(F.sum(size).over(within), F.lit(0)))
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of"))
    return placed.join(sums, same).withColumn(out, F.col("_before") + F.col("_within")).drop("_group", "_range", "_of", "_before", "_within")


# ln x! by Stirling's series at x + 10, good to 1e-10 for every x >= 0.
_FACT = (
    "({x} + 9.5D) * ln({x} + 10D) - ({x} + 10D) + 0.9189385332046727D + 1D / (12 * ({x} + 10D)) - 1D / (360 * pow({x} + 10D, 3))"
    " - ln(({x} + 1D) * ({x} + 2D) * ({x} + 3D) * ({x} + 4D) * ({x} + 5D) * ({x} + 6D) * ({x} + 7D) * ({x} + 8D) * ({x} + 9D))"
)


def _let(name: str, value: str, body: str) -> str:
    """SQL of `body` with `name` standing for `value`, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _drawn(of: str) -> str:
    """SQL of one hypergeometric draw by inversion over the mean and 12 deviations and more to either side,
    beyond which no probability is left in double precision."""
    far = f"12 * sqrt(mean * (1 - {of}.k / greatest({of}.m, 1)) + 1) + 12"
    low = f"greatest(0L, {of}.n - ({of}.m - {of}.k), cast(floor(mean - ({far})) as bigint))"
    high = f"least({of}.k, {of}.n, cast(ceil(mean + ({far})) as bigint))"
    # Log weight of drawing x of this source, of which there are k among m blocks, n of them drawn.
    parts = f"array(x, {of}.k - x, {of}.n - x, {of}.m - {of}.k - {of}.n + x)"
    logs = f"transform(sequence(range.low, range.high), x -> aggregate({parts}, 0D, (s, y) -> s - ({_FACT.format(x='y')})))"
    weights = _let("most", "array_max(logs)", "transform(logs, v -> exp(v - most))")
    # One pass over the weights after their sum: how many are passed before the drawn point.
    pick = f"aggregate(w, named_struct('sum', 0D, 'i', 0L), (s, y) -> named_struct('sum', s.sum + y, 'i', s.i + if(s.sum + y < {of}.u * total, 1L, 0L)), s -> s.i)"
    passed = _let("logs", logs, _let("w", weights, _let("total", "aggregate(w, 0D, (s, y) -> s + y)", pick)))
    return _let("mean", f"{of}.n * {of}.k / greatest({of}.m, 1)", _let("range", f"named_struct('low', {low}, 'high', {high})", f"range.low + {passed}"))


def split_tree(quotas: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """(shard, source, quota) of (source, quota). One row per node holds the quotas of all sources, so their
    number is taken to be moderate (a mixture states a weight for each); blocks and rows do not enter it."""
    known = quotas.where("quota > 0").select(F.struct(F.col("source").isNull().alias("none"), "source", "quota").alias("s"))
    root = known.agg(F.array_sort(F.collect_list("s")).alias("s")).select(
        F.transform("s", lambda s: s["source"]).alias("sources"),
        F.transform("s", lambda s: s["quota"]).alias("quotas"),
        F.lit(0).alias("first"),
        F.lit(shards).alias("last"),
    )
    nodes = write_table(root, "tree")
    depth = (shards - 1).bit_length()
    for _ in range(depth):
        cut = nodes.where("last - first > 1").withColumn("middle", F.expr("(first + last) div 2"))
        cut = cut.withColumn("m", F.expr("aggregate(quotas, 0L, (s, q) -> s + q)")).withColumn(
            "half", F.expr("m * (middle - first) div (last - first)")
        )
        uniform = f"shiftrightunsigned(xxhash64('{seed}', first, last, size(s.out)), 11) / pow(2D, 53)"
        draw = f"element_at(transform(array(named_struct('k', q, 'm', s.m, 'n', s.n, 'u', {uniform})), d -> {_drawn('d')}), 1)"
        step = (
            "element_at(transform(array(%s), x -> named_struct('m', s.m - q, 'n', s.n - x, 'out', concat(s.out, array(x)))), 1)" % draw
        )
        left = f"aggregate(quotas, named_struct('m', m, 'n', half, 'out', cast(array() as array<bigint>)), (s, q) -> {step}, s -> s.out)"
        cut = cut.withColumn("left", F.expr(left))
        lower = cut.select("sources", F.col("left").alias("quotas"), "first", F.col("middle").alias("last"))
        right = F.expr("zip_with(quotas, left, (q, l) -> q - l)")
        upper = cut.select("sources", right.alias("quotas"), F.col("middle").alias("first"), "last")
        nodes = write_table(nodes.where("last - first <= 1").unionByName(lower).unionByName(upper), "tree")
    leaf = nodes.select(F.col("first").alias("shard"), F.explode(F.arrays_zip("sources", "quotas")).alias("z"))
    return leaf.select("shard", F.col("z.sources").alias("source"), F.col("z.quotas").alias("quota"))


def blocks(wanted: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """(source, block, shard, slot) of (source, quota): every block of a source once, in the shard whose
    stretch of the permuted blocks it falls into; `slot` orders the blocks of a shard."""
    ends = Window.partitionBy("source").orderBy("shard")
    leaves = split_tree(wanted, shards, seed).withColumn("end", F.sum("quota").over(ends))
    edges = leaves.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("shard", "end"))).alias("edges"))
    edges = write_table(edges.select(F.col("source").alias("_from"), F.transform("edges", lambda e: e["end"]).alias("_ends")), "edges")
    # In two steps, so that no array holds all blocks of a source.
    starts = wanted.where("quota > 0").select("source", "quota", F.explode(F.expr("sequence(0L, quota - 1, 8192L)")).alias("low"))
    each = starts.repartition("source", "low").select("source", F.explode(F.expr("sequence(low, least(low + 8191, quota - 1))")).alias("block"))
    each = each.withColumn("_key", F.md5(F.concat_ws(":", F.lit(seed), F.col("block").cast("string"), F.coalesce("source", F.lit("")))))
    ranked = laid_out(each.withColumn("_one", F.lit(1)), "source", "_key", ["block"], "_one", "_place")
    shard = F.size(F.filter("_ends", lambda end: end <= F.col("_place")))
    joined = ranked.join(edges, F.col("source").eqNullSafe(F.col("_from")))
    return joined.select("source", "block", shard.alias("shard"), F.xxhash64(F.lit(seed), "_key").alias("slot"))


def mixed(rows: DataFrame, shards: int = SHARDS, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """`rows` (doc_id, source, size, digest and any other columns) with source_size, target, start (place in the
    source's stream), taken and pieces: array of (shard, slot, first_word, n_words) in the order of the stream;
    a word of the second reading counts again."""
    # Read by the totals and by both sides of the layout: words are counted once.
    rows = write_table(rows, "sized")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    known = targets(sizes)
    kept = known.select(F.col("source").alias("_source"), "source_size", "target")
    keyed = rows.withColumn("_key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    placed = laid_out(keyed, "source", "_key", ["size", "digest"], "size", "_start").drop("_key")
    placed = write_table(placed.join(kept, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "placed")

    stop = F.round("target").cast("long")
    twice = placed.where("size > 0").select(
        "source", "_start", "size", stop.alias("_stop"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(TIMES - 1)), lambda t: t * F.col("source_size") + F.col("_start"))).alias("_from")
    )
    end = F.least(F.col("_from") + F.col("size"), "_stop")
    drawn = twice.withColumn("_to", end).where("_from < _to")
    cut = drawn.withColumn("block", F.explode(F.expr(f"sequence(_from div {block}, (_to - 1) div {block})")))
    first = F.greatest("_from", F.col("block") * block)
    last = F.least("_to", (F.col("block") + 1) * block)
    cut = cut.select("source", "block", "_start", (first - F.col("_from")).alias("first_word"), (last - first).alias("n_words"), "_from")
    wanted = known.select("source", F.ceil(F.round("target") / block).cast("long").alias("quota"))
    owned = write_table(blocks(wanted, shards, seed), "blocks").withColumnRenamed("source", "_s").withColumnRenamed("block", "_b")
    pieces = cut.join(owned, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    piece = F.struct("_from", "first_word", "shard", "slot", "n_words")
    # A document's place in its source's stream is its identity: only empty ones share it.
    found = pieces.groupBy("source", "_start").agg(F.sum("n_words").alias("taken"), F.array_sort(F.collect_list(piece)).alias("pieces"))
    found = found.select(
        F.col("source").alias("_s"),
        F.col("_start").alias("_at"),
        "taken",
        F.transform("pieces", lambda p: F.struct(p["shard"].alias("shard"), p["slot"].alias("slot"), p["first_word"].alias("first_word"), p["n_words"].alias("n_words"))).alias("pieces"),
    )
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("_start") == F.col("_at")) & (F.col("size") > 0)
    out = placed.join(found, same, "left").drop("_s", "_at").withColumnRenamed("_start", "start")
    return out.withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def op5_mixing(documents: DataFrame) -> DataFrame:
    """NULL texts and texts without words have size 0 and take nothing; a source without words has target 0."""
    rows = documents.select("doc_id", "source", words(F.col("text")).alias("size"), text_digest(F.col("text")).alias("digest"))
    return mixed(rows).select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The drawn documents: their own columns, then size, source_size, target, taken and pieces (columns of
    these names are replaced). Rows of which nothing is taken go. The mix is made of narrow rows; texts join it once."""
    added = ["size", "source_size", "target", "taken", "pieces"]
    own = [c for c in documents.columns if c not in added]
    rows = documents.select("doc_id", "source", words(F.col("text")).alias("size"), text_digest(F.col("text")).alias("digest"))
    # Rows equal in these three share what is drawn of them, a piece of the stream each.
    equal = Window.partitionBy("doc_id", "source", "digest")
    ranked = mixed(rows, shards).withColumns({"_nth": F.row_number().over(equal.orderBy("start")), "_copies": F.count(F.lit(1)).over(equal)})
    drawn = write_table(ranked.where("taken > 0"), "drawn")
    named = drawn.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("digest").alias("_digest"), "_nth", "_copies", *added)
    texts = documents.select(*own).withColumn("_print", text_digest(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_print") == F.col("_digest"))
    out = texts.join(named.where("_copies = 1"), same)
    repeated = named.where("_copies > 1")
    if not repeated.isEmpty():
        again = texts.join(repeated.select("_id", "_source", "_digest").distinct(), same, "left_semi")
        place = F.row_number().over(Window.partitionBy("doc_id", "source", "_print").orderBy(F.xxhash64(*own)))
        out = out.unionByName(again.withColumn("_row", place).join(repeated, same & (F.col("_row") == F.col("_nth"))).drop("_row"))
    return out.select(*own, *added)


# Which words are taken depends on sizes and order alone; the tree only deals blocks to shards.
SQL = r"""
with sized as (
  select doc_id, source, text,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size
  from documents),
sources as (
  select source, sum(size) z, row_number() over (order by source is null, source) - 1 as place from sized group by source),
weighed as (select source, z, 2 * z as lim, case place % 3 when 0 then 5 when 1 then 2 else 1 end w from sources),
sorted as (
  select *, lim / w as ratio, coalesce(sum(lim) over before, 0) as full_before, sum(w) over () - coalesce(sum(w) over before, 0) as w_rest,
         sum(z) over () as total
  from weighed window before as (order by lim / w, source is null, source rows between unbounded preceding and 1 preceding)),
lvl as (select arg_min((1.5 * total - full_before) / w_rest, ratio) filter (where (1.5 * total - full_before) / w_rest <= ratio) lv from sorted),
targets as (
  select source, cast(z as bigint) z, case when w * lv > lim then cast(lim as double) else w * cast(lv as double) end target from weighed, lvl),
placed as (
  select doc_id, size, t.z, t.target,
         cast(coalesce(sum(size) over (partition by s.source order by md5('mix:' || coalesce(cast(doc_id as varchar), '')), size
                                       rows between unbounded preceding and 1 preceding), 0) as bigint) as start
  from sized s join targets t on s.source is not distinct from t.source)
select doc_id, cast(size as bigint) as size, z as source_size, target,
       cast(greatest(0, least(start + size, round(target)) - start) + greatest(0, least(z + start + size, round(target)) - z - start) as bigint) as taken
from placed
"""
