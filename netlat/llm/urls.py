"""URL filter: rules by host and path, and boosted trees for what no rule decides.

The trees see how a URL is written: lengths, depth, shares of digits, entropy,
numbers of labels, hyphens and parameters, and how frequent its host's suffixes are
in the whole table. They are fitted on at most MOST labelled URLs of each class.
"""

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlat.session import settle

# The rules, each with its action.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Words whose presence between the dots and hyphens of a host labels a URL as unwanted.
UNWANTED = ("ads", "adult", "bet", "bets", "casino", "loans", "pills", "poker", "porn", "spam", "track", "viagra", "win", "xxx")
#: Labelled URLs of each class that the trees are fitted on at most.
MOST = 20_000

FEATURES = (
    "url_length", "host_length", "path_length", "query_length", "depth", "digit_ratio", "host_digits", "entropy",
    "host_entropy", "parameters", "labels", "longest_label", "hyphens", "host_hyphens", "odd_signs", "suffix1_log", "suffix2_log",
)


def parts(url: str = "url") -> dict[str, Column]:
    """host (A-Z in lower case) and path; both empty for null or without '://'."""
    whole = F.coalesce(F.col(url).cast("string"), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return {"host": F.translate(F.regexp_extract(whole, pattern, 1), upper, upper.lower()), "path": F.regexp_extract(whole, pattern, 2)}


def ruled(rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its action; null if none does. A
    rule fits its host and all subdomains if the path starts with its own; of rules as
    long, that with the longer host wins, then the one that blocks."""
    fits = lambda host, path: ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    first = lambda value: F.coalesce(*[F.when(fits(h, p), F.lit(value(a, h, p))) for a, h, p in order], F.lit(None).cast("string"))
    return first(lambda a, h, p: h + p), first(lambda a, h, p: a)


def _count(c: Column, kind: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, kind, ""))


def _entropy(c: Column) -> Column:
    """Bits a character."""
    chars, n = F.array_distinct(F.split(c, "")), F.length(c)
    share = lambda x: (n - F.length(F.replace(c, x))) / n
    return F.when(n > 0, F.aggregate(chars, F.lit(0.0), lambda s, x: s - F.when(F.length(x) > 0, share(x) * F.log2(share(x))).otherwise(0.0))).otherwise(0.0)


def lexical(df: DataFrame) -> DataFrame:
    """df (with url, host, path) with the features that need the row alone, and the
    host's last label and last two labels."""
    url, host, path = F.coalesce(F.col("url"), F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    return df.withColumns(
        {
            "url_length": F.length(url),
            "host_length": F.length(host),
            "path_length": F.length(path),
            "query_length": F.length(query),
            "depth": _count(path, "/"),
            "digit_ratio": _count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)),
            "host_digits": _count(host, "[0-9]"),
            "entropy": _entropy(url),
            "host_entropy": _entropy(host),
            "parameters": F.when(F.length(query) > 0, 1 + _count(query, "&")).otherwise(0),
            "labels": F.when(F.length(host) > 0, F.size(labels)).otherwise(0),
            "longest_label": F.coalesce(F.array_max(F.transform(labels, F.length)), F.lit(0)),
            "hyphens": _count(url, "-"),
            "host_hyphens": _count(host, "-"),
            "odd_signs": _count(url, "[%@~!$*,;|]"),
            "suffix1": F.element_at(labels, -1),
            "suffix2": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
        }
    )


@dataclass
class UrlModel:
    """Fitted trees; None where one class has no labelled URL: then none is blocked."""

    trees: object
    suffix1: DataFrame
    suffix2: DataFrame

    def features(self, df: DataFrame) -> DataFrame:
        joined = df.join(self.suffix1, "suffix1", "left").join(self.suffix2, "suffix2", "left")
        return joined.withColumns({f"{s}_log": F.log1p(F.coalesce(F.col(f"{s}_n"), F.lit(0))) for s in ("suffix1", "suffix2")})

    def score(self, df: DataFrame) -> DataFrame:
        """df (with url, host, path) with unwanted, a probability."""
        if self.trees is None:
            return df.withColumn("unwanted", F.lit(0.0))
        rows = _vectors(self.features(lexical(df)))
        scored = self.trees.transform(rows)
        return scored.select(*df.columns, vector_to_array("probability")[1].alias("unwanted"))


def _vectors(df: DataFrame) -> DataFrame:
    cast = df.withColumns({f: F.col(f).cast("double") for f in FEATURES})
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(cast)


def seed_labels(urls: DataFrame, words: tuple[str, ...] = UNWANTED) -> DataFrame:
    """Different urls with label: 1 if a word of the list stands in the host between
    dots and hyphens, else 0; URLs without a host have none."""
    different = urls.select(F.col("url").cast("string").alias("url")).distinct().withColumns(parts())
    held = F.arrays_overlap(F.split("host", r"[.\-]"), F.array(*map(F.lit, words)))
    return different.where("host != ''").withColumn("label", held.cast("int"))


def fit(urls: DataFrame, labelled: DataFrame, most: int = MOST, trees: int = 20, depth: int = 4) -> UrlModel:
    """Fit on labelled (url, host, path, label), at most `most` of each label: those
    whose hashes come first. Suffixes are counted over all urls (host)."""
    suffixes = lexical(urls.select("url", "host", "path"))
    counted = [suffixes.groupBy(s).agg(F.count("*").alias(f"{s}_n")) for s in ("suffix1", "suffix2")]
    model = UrlModel(None, *(settle(c, "suffixes") for c in counted))
    first = lambda v: labelled.where(F.col("label") == v).orderBy(F.xxhash64("url"), "url").limit(most)
    sample = model.features(lexical(first(0).unionByName(first(1)).select("url", "host", "path", "label")))
    sample = settle(sample.select("label", *FEATURES), "labelled-urls")
    if sample.select("label").distinct().count() < 2:
        return model
    both = sample.withColumn("label", F.col("label").cast("double"))
    # Unwanted URLs are few; both classes weigh the same.
    n = {r["label"]: r["n"] for r in both.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weight = F.when(F.col("label") == 1, n[0.0] / n[1.0]).otherwise(1.0)
    gbt = GBTClassifier(labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7)
    model.trees = gbt.fit(_vectors(both.withColumn("weight", weight).repartition(4)))
    return model


def judge(pages: DataFrame, rules: tuple = RULES, words: tuple[str, ...] = UNWANTED, id_col: str = "page_id") -> DataFrame:
    """One row a row: the identifier, host, path, rule, verdict, unwanted.

    A rule decides first, else the trees. Null URLs and those without '://' have empty
    host and path, which no rule fits. Rows that repeat are judged each; other columns
    are ignored; an empty table gives an empty table.
    """
    urls = pages.select(F.col(id_col), F.col("url").cast("string").alias("url")).withColumns(parts())
    model = fit(urls, seed_labels(pages, words))
    rule, action = ruled(rules)
    by_model = F.when(F.col("unwanted") >= 0.5, "block").otherwise("allow")
    return model.score(urls).select(id_col, "host", "path", rule.alias("rule"), F.coalesce(action, by_model).alias("verdict"), "unwanted")
