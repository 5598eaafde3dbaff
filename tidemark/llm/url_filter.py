"""URL filter: fixed rules first, gradient-boosted trees on lexical features for the rest.

Rules name a host and the start of a path; a rule fits the host and its subdomains, and the longest
fitting rule wins. URLs that a rule decides are labelled URLs: from a bounded sample of the different ones
(`SAMPLE`, the least by hash, so the sample does not depend on how the table is stored) Spark's
gradient-boosted trees are trained. Features are lengths, depth, digit ratio, entropy, numbers of
parameters, labels and hyphens, and how often the host's suffixes (last label, last two labels) were
blocked among all labelled URLs, smoothed towards their mean.

A null URL, or one without ``://``, has an empty host and path; the trees judge it like any other. When
the labelled URLs are of one kind only, or there are none, there is nothing to learn and the verdict is
that kind, or ``allow``. Repeated rows give repeated results. Columns other than `page_id` and `url` are
not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.scale import cut

#: (verdict, host, start of the path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SAMPLE = 20_000  # labelled URLs that the trees are trained on
SMOOTHING = 5.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null without one."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    size = F.length(text)
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / F.greatest(size, F.lit(1)))
    return F.coalesce(-F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda a, p: a + p * F.log2(p)), F.lit(0.0))


def _count(text: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{characters}]", ""))


FEATURES = ("length", "host_length", "path_length", "depth", "digits", "entropy", "parameters", "labels", "hyphens", "fragment", "secure", "top_rate", "site_rate")
SUFFIXES = {"top": lambda: F.substring_index("host", ".", -1), "site": lambda: F.substring_index("host", ".", -2)}


def lexical(pages: DataFrame) -> DataFrame:
    """`pages` (url, host, path) with the lexical features and the host's suffixes."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    return pages.withColumns(
        {
            "length": F.length(url),
            "host_length": F.length(host),
            "path_length": F.length(path),
            "depth": _count(path, "/"),
            "digits": _count(url, "0-9") / F.greatest(F.length(url), F.lit(1)),
            "entropy": _entropy(url),
            "parameters": _count(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "="),
            "labels": F.size(F.split(host, r"\.")),
            "hyphens": _count(host, "-"),
            "fragment": url.contains("#").cast("int"),
            "secure": url.startswith("https").cast("int"),
            **{name: suffix() for name, suffix in SUFFIXES.items()},
        }
    )


def _with_rates(pages: DataFrame, rates: dict[str, DataFrame], mean: float) -> DataFrame:
    for name, table in rates.items():
        pages = pages.join(table, name, "left").withColumn(f"{name}_rate", F.coalesce(f"{name}_rate", F.lit(mean)))
    return pages


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, sample: int = SAMPLE) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict and blocked (the trees' probability; null where a rule decides)."""
    seen = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    seen = seen.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    labelled = seen.filter("hit is not null").select("url", "host", "path", (F.col("hit.verdict") == "block").cast("double").alias("label")).distinct()
    labelled = cut(labelled, "labelled")
    training = cut(lexical(labelled.orderBy(F.xxhash64("url"), "url").limit(sample)), "urls")
    total = labelled.agg(F.count(F.lit(1)).alias("n"), F.mean("label").alias("mean")).first()
    result = ["page_id", "host", "path", F.col("hit.rule").alias("rule")]
    if not total["n"] or total["mean"] in (0.0, 1.0):
        only = "block" if total["n"] and total["mean"] == 1.0 else "allow"
        return seen.select(*result, F.coalesce("hit.verdict", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("blocked"))
    mean = total["mean"]
    rates = {
        name: labelled.groupBy(suffix().alias(name)).agg(((F.sum("label") + SMOOTHING * mean) / (F.count(F.lit(1)) + SMOOTHING)).alias(f"{name}_rate"))
        for name, suffix in SUFFIXES.items()
    }
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    trees = GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.2, seed=3, subsamplingRate=0.8)
    model = trees.fit(vectors.transform(_with_rates(training, rates, mean)).select("features", "label"))
    scored = model.transform(vectors.transform(_with_rates(lexical(seen), rates, mean)))
    blocked = vector_to_array("probability")[1]
    return scored.select(
        *result,
        F.coalesce("hit.verdict", F.when(blocked >= 0.5, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("hit").isNull(), blocked).alias("blocked"),
    )
