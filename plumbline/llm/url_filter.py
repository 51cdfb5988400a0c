"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

Addresses are parsed and described by column expressions, page bodies are never read. The trees are fitted by Spark ML
on a bounded sample of labelled addresses; scoring is a projection without a shuffle.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import fold_ascii, text_or_empty

LABEL_SAMPLE = 20_000  # labelled addresses that the trees are fitted on, at most about this many
FOLDS = 3  # of the sample, for the block rates of suffixes
FEATURES = ["length", "host_length", "path_length", "labels", "depth", "digit_ratio", "entropy", "params", "hyphens", "fragment", "secure", "extension", "suffix_rate"]


def host_of(url: Column) -> Column:
    return fold_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    u = text_or_empty(url)
    at = F.instr(u, "://")
    return F.when(at > 0, F.substr(u, at + 3)).otherwise("")


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule (verdict, host, path) that fits; nulls if none does."""
    hit, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit, verdict = F.when(fits, h + p).otherwise(hit), F.when(fits, kind).otherwise(verdict)
    return hit, verdict


def described(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """urls with host, path and the lexical features, but for suffix_rate. A null address has length 0."""
    u = text_or_empty(url_col)
    n = F.char_length(u)
    count = lambda c, what: (F.char_length(c) - F.char_length(F.regexp_replace(c, what, ""))).cast("double")
    chars = F.split(u, "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    out = urls.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    return out.withColumns(
        {
            "suffix": F.substring_index("host", ".", -1),
            "length": n.cast("double"),
            "host_length": F.char_length("host").cast("double"),
            "path_length": F.char_length("path").cast("double"),
            "labels": count(F.col("host"), r"\."),
            "depth": count(F.col("path"), "/"),
            "digit_ratio": count(u, "[0-9]") / F.greatest(n, F.lit(1)),
            "entropy": F.when(n > 0, entropy).otherwise(0.0),
            "params": count(u, "[?&;]"),
            "hyphens": count(u, "[-_]"),
            "fragment": u.contains("#").cast("double"),
            "secure": fold_ascii(u).startswith("https://").cast("double"),
            "extension": F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
        }
    )


class UrlModel:
    """Boosted trees and the block rates of host suffixes; or one verdict, where the labels know no other."""

    def __init__(self, trees, rates: DataFrame | None, prior: float):
        self.trees, self.rates, self.prior = trees, rates, prior

    def score(self, d: DataFrame) -> DataFrame:
        """d (of described()) with block_probability."""
        if self.trees is None:
            return d.withColumn("block_probability", F.lit(self.prior))
        rates = F.broadcast(self.rates)  # at most one row a sampled label
        d = d.join(rates, "suffix", "left").withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(self.prior)))
        out = self.trees.transform(VectorAssembler(inputCols=FEATURES, outputCol="__f").transform(d))
        return out.withColumn("block_probability", vector_to_array("probability")[1]).drop("__f", "rawPrediction", "probability", "prediction")


def fit(labelled: DataFrame, label_col: str = "block", sample: int = LABEL_SAMPLE, trees: int = 8, depth: int = 3, seed: int = 5) -> UrlModel:
    """Fit on rows of described() with a 0/1 label; at most about `sample` rows, drawn by a hash of the address.

    Without labels every address is allowed; with labels of one kind all get that verdict.
    """
    rows = labelled.where(F.col(label_col).isNotNull())
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum(label_col), F.lit(0))).first()
    if ones in (0, n):
        return UrlModel(None, None, 1.0 if n and ones == n else 0.0)
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64("host", "path", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(sample / n * (1 << 30))))
    rows = rows.withColumn("y", F.col(label_col).cast("double"))
    rows = rows.select("suffix", "y", F.pmod(F.xxhash64("host", "path", F.lit(seed + 1)), F.lit(FOLDS)).alias("fold"), *FEATURES[:-1]).cache()
    prior = rows.agg(F.avg("y")).first()[0]
    if prior in (None, 0.0, 1.0):
        rows.unpersist()
        return UrlModel(None, None, float(prior or 0.0))
    rate = lambda y, n: (y + prior * 2) / (n + 2)
    folds = rows.groupBy("suffix", "fold").agg(F.sum("y").alias("y"), F.count("*").alias("n")).collect()  # no more rows than the sample
    total: dict[str, tuple[float, int]] = {}
    for r in folds:
        y, n = total.get(r.suffix, (0.0, 0))
        total[r.suffix] = y + r.y, n + r.n
    spark = rows.sparkSession
    rates = spark.createDataFrame([(s, rate(*t)) for s, t in total.items()], "suffix string, suffix_rate double")
    # the trees see, of each row's suffix, the rate in the other folds: its own label is not among what it is told
    told = [(r.suffix, r.fold, rate(total[r.suffix][0] - r.y, total[r.suffix][1] - r.n)) for r in folds]
    told = spark.createDataFrame(told, "suffix string, fold long, suffix_rate double")
    data = VectorAssembler(inputCols=FEATURES, outputCol="f").transform(rows.join(F.broadcast(told), ["suffix", "fold"]))
    gbt = GBTClassifier(featuresCol="f", labelCol="y", maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.3)
    model = gbt.fit(data.select("f", "y"))
    rows.unpersist()
    return UrlModel(model.setFeaturesCol("__f"), rates, float(prior))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict, block_probability.

    Rules label the addresses that they fit, and the trees learn from those; every other address is blocked from
    `threshold` on. A null address, or one without "://", has an empty host and path and is judged by the trees.
    Repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
    """
    d = described(pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url")), "__url")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    d = d.withColumns({"rule": rule, "__by_rule": verdict})
    model = fit(d.withColumn("block", (F.col("__by_rule") == "block").cast("int")))
    own = F.when(F.col("block_probability") >= threshold, "block").otherwise("allow")
    out = model.score(d)
    return out.select(F.col("__id").alias(id_col), "host", "path", "rule", F.coalesce("__by_rule", own).alias("verdict"), "block_probability")
