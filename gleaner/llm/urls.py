"""URL filter: rules by host and path, and gradient-boosted trees on lexical features for the rest.

URLs that a rule judges are the labelled ones; the trees learn allow or block from a bounded sample of
different ones and judge every URL that no rule fits. Suffix statistics count all labelled rows. All
features are SQL expressions.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import lower_ascii
from gleaner.session import broadcast_if_small, write_table

# Verdict, host and path of each rule.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# So many different URLs of each verdict are learned from, those of least hash.
TRAIN_URLS = 10_000
TREES, DEPTH = 20, 4
# Weight of the overall share in a suffix's share of blocked URLs.
PRIOR = 10.0


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for NULL or without `://`."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule, NULL if none fits. The rules are a short fixed list."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(start)
        name = F.when(fits, F.lit(domain + start)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def _entropy(text: Column) -> Column:
    """Bits per character, of the characters' frequencies."""
    signs = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    n = F.greatest(F.length(text), F.lit(1))
    rests = F.transform(signs, lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.aggregate(rests, F.lit(0.0), lambda s, p: s - p * F.log2(F.greatest(p, F.lit(1e-9))))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features that need no other row."""
    labels = F.split(host, "\\.")
    query = F.coalesce(F.regexp_extract(url, "(?s)\\?([^#]*)", 1), F.lit(""))
    return {
        "length": F.coalesce(F.length(url), F.lit(0)).cast("double"),
        "host_length": F.length(host).cast("double"),
        "host_labels": F.size(labels).cast("double"),
        "depth": F.regexp_count(path, F.lit("/[^/]+")).cast("double"),
        "first_folder": F.length(F.regexp_extract(path, "^/([^/]*)/", 1)).cast("double"),
        "folder_hash": (F.pmod(F.xxhash64(F.regexp_extract(path, "^/([^/]*)", 1)), F.lit(64))).cast("double"),
        "digits": _share(F.coalesce(url, F.lit("")), "[0-9]"),
        "hyphens": F.regexp_count(host, F.lit("-")).cast("double"),
        "entropy": _entropy(F.coalesce(url, F.lit(""))),
        "host_entropy": _entropy(host),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))).cast("double"),
        "fragment": F.coalesce(F.contains(url, F.lit("#")), F.lit(False)).cast("double"),
        "secure": F.coalesce(url.startswith("https:"), F.lit(False)).cast("double"),
    }


def suffix_of(host: Column) -> Column:
    """The host's last label."""
    return F.regexp_extract(host, "([^.]*)$", 1)


def suffix_statistics(labelled: DataFrame, share: float) -> DataFrame:
    """(_suffix, _x_suffix_share, _x_suffix_count) over all rows of (_suffix, _label): a suffix's share of blocked
    rows, drawn to the overall share by PRIOR rows, and the logarithm of its rows."""
    return labelled.groupBy("_suffix").agg(
        ((F.sum("_label") + PRIOR * share) / (F.count("*") + PRIOR)).alias("_x_suffix_share"), F.log1p(F.count("*")).alias("_x_suffix_count")
    )


def learnable(labelled: DataFrame) -> DataFrame:
    """At most TRAIN_URLS different URLs of each label, by hash; a URL has one label, as rules see nothing else."""
    different = write_table(labelled.groupBy("url").agg(F.max("_label").alias("_label")), "urls-labelled")
    some = [different.where(F.col("_label") == label).orderBy(F.xxhash64("url"), "url").limit(TRAIN_URLS) for label in (0.0, 1.0)]
    return some[0].unionByName(some[1])


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """The pages' rows with host, path, rule and verdict; verdict is allow or block everywhere.

    Without labelled URLs of both kinds nothing can be learned: then the rest gets the one
    kind there is, or allow. NULL and malformed URLs have an empty host and path, fit no rule
    and are judged by the trees like the rest. Rows of one URL get the same verdict however often it
    repeats, and equal hashes are ordered by URL. Input columns named host, path, rule or verdict are
    replaced; other columns are kept, save names that start with `_`, which are used inside.
    """
    rows = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    name, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("_says", says)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]

    labelled = rows.where(F.col("_says").isNotNull()).select("url", suffix_of(F.col("host")).alias("_suffix"), (F.col("_says") == "block").cast("double").alias("_label"))
    total, blocked = labelled.agg(F.count("*"), F.coalesce(F.sum("_label"), F.lit(0.0))).first()
    if blocked in (0, total):
        rest = "block" if total and blocked else "allow"
        return rows.withColumn("verdict", F.coalesce("_says", F.lit(rest))).select(*kept, "host", "path", "rule", "verdict")

    share = blocked / total
    suffixes = write_table(suffix_statistics(labelled, share), "suffixes")
    n_suffixes = suffixes.count()
    found = lexical(F.col("url"), F.col("host"), F.col("path"))

    def featured(some: DataFrame) -> DataFrame:
        return some.withColumns({f"_x_{k}": v for k, v in found.items()}).withColumn("_suffix", suffix_of(F.col("host")))

    rows = featured(rows)
    learned = learnable(labelled).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    learned = write_table(featured(learned), "urls-learned")

    def vectors(some: DataFrame) -> DataFrame:
        known = some.join(broadcast_if_small(suffixes, n_suffixes), "_suffix", "left").fillna({"_x_suffix_share": share, "_x_suffix_count": 0.0})
        inputs = [*[f"_x_{k}" for k in found], "_x_suffix_share", "_x_suffix_count"]
        return VectorAssembler(inputCols=inputs, outputCol="_vector").transform(known)

    trees = GBTClassifier(
        featuresCol="_vector", labelCol="_label", predictionCol="_blocks", maxIter=TREES, maxDepth=DEPTH, maxBins=64, seed=7
    )
    trees = trees.setRawPredictionCol("_raw").setProbabilityCol("_chance")
    model = trees.fit(vectors(learned).select("_vector", "_label"))
    rest = F.when(F.col("_blocks") == 1.0, "block").otherwise("allow")
    out = model.transform(vectors(rows)).withColumn("verdict", F.coalesce(F.col("_says"), rest))
    return out.select(*kept, "host", "path", "rule", "verdict")


def op10_urls(pages: DataFrame) -> DataFrame:
    return judged(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


# Host, path and rule as DuckDB statements say them; the trees' verdicts have none.
RULES_SQL = """WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(domain, start) AS (VALUES ('com', '/'), ('example.com', '/en/'), ('www.example.com', '/en/'), ('net', '/es/'), ('net', '/fr/')),
fitting AS (
  SELECT page_id, arg_max(domain || start, length(domain || start)) AS rule FROM parts, rules
  WHERE (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, start) GROUP BY page_id
)
SELECT page_id, host, path, rule FROM parts LEFT JOIN fitting USING (page_id)"""
