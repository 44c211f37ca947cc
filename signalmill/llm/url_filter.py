"""URL filters: host and path rules first, then logistic regression on hashed character n-grams.

The classifier learns from a small labelled table (url, blocked). ``decided_sample`` takes such a table from the urls
that the rules decide: a bounded number of distinct (host, path) pairs in hash order. Everything runs on built-in
expressions and the JVM classifier; no Python code touches a row.

The fitted model is stored and read again before it judges: a stored model is its coefficients alone, without the training
summary, whose tables would travel in every task's closure.

Defined results: a null url and one without ``://`` have an empty host and path, which give the grams of two marked empty
strings; an empty labelled table, or one with a single label, gives that label (``allow`` if empty) to all. Urls are taken
whole, however long. Repeated rows are judged one by one, alike; equal probabilities of both labels allow. An empty table
gives an empty result. Columns called host, path, rule or verdict are replaced by the results; other columns pass through, but
for those with two leading underscores, which are refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import LOWER, UPPER, table, written

#: The rules of the contract, as (host and path start, verdict).
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)


def host(url: str) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: str) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: str) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise("")


def matched_rule(host_column: Column, path_column: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits a host or its parent domain and starts the path, as struct(rule, verdict)."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, _, start = text.partition("/")
        fits = ((host_column == domain) | host_column.endswith("." + domain)) & path_column.startswith("/" + start)
        found = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def grams(prefix: str, chars: str, n: int) -> Column:
    """The n-grams of an array of characters, each marked with where it comes from; a shorter one is one gram."""
    own = F.col(chars)
    starts = F.sequence(F.lit(0), F.greatest(F.size(own) - n, F.lit(0)))
    return F.transform(starts, lambda i: F.concat(F.lit(prefix), *[F.coalesce(F.get(own, i + k), F.lit("")) for k in range(n)]))


class UrlModel:
    """Logistic regression on hashed n-grams of host and path."""

    def __init__(self, n: int = 3, buckets: int = 1 << 14, penalty: float = 1e-3, iterations: int = 60):
        self.n, self.penalty, self.iterations = n, penalty, iterations
        self.hasher = HashingTF(numFeatures=buckets, inputCol="__grams", outputCol="__features")
        self.model, self.constant = None, 0.0

    def _features(self, urls: DataFrame) -> DataFrame:
        chars = {c: F.split(F.concat(F.lit("^"), F.col(f"__{c}"), F.lit("$")), "") for c in ("host", "path")}
        urls = urls.withColumns({f"__{c}_chars": x for c, x in chars.items()})
        both = F.concat(grams("h", "__host_chars", self.n), grams("p", "__path_chars", self.n))
        return self.hasher.transform(urls.withColumn("__grams", both))

    def fit(self, labelled: DataFrame, url: str = "url", blocked: str = "blocked") -> UrlModel:
        """``labelled`` is small: one partition, in a fixed order, so that a rerun gives the same weights."""
        rows = labelled.where(F.col(blocked).isNotNull()).select(
            host(url).alias("__host"), path(url).alias("__path"), F.col(blocked).cast("double").alias("__label")
        )
        rows = written(rows.coalesce(1).sortWithinPartitions("__host", "__path", "__label"), "url-labels").coalesce(1)
        seen = [r[0] for r in rows.select("__label").distinct().collect()]
        if len(seen) < 2:
            self.constant = seen[0] if seen else 0.0
            return self
        learner = LogisticRegression(
            featuresCol="__features", labelCol="__label", probabilityCol="__probability", predictionCol="__prediction",
            rawPredictionCol="__raw", regParam=self.penalty, maxIter=self.iterations, standardization=False,
        )
        stored = scratch_path(rows.sparkSession, "url-model")
        learner.fit(self._features(rows)).write().save(stored)
        self.model = LogisticRegressionModel.load(stored)
        return self

    def blocked(self, urls: DataFrame) -> DataFrame:
        """``urls`` (with ``__host`` and ``__path``) and a column ``__blocked``."""
        if self.model is None:
            return urls.withColumn("__blocked", F.lit(self.constant >= 0.5))
        judged = self.model.transform(self._features(urls))
        return judged.select(*urls.columns, (F.col("__prediction") >= 0.5).alias("__blocked"))


def decided_sample(urls: DataFrame, url: str, rules: Sequence[tuple[str, str]] = RULES, limit: int = 4000) -> DataFrame:
    """At most ``limit`` distinct urls that the rules decide, in hash order: a labelled table (url, blocked)."""
    found = urls.select(F.col(url).alias("url"), matched_rule(host(url), path(url), rules).alias("rule")).where("rule IS NOT NULL")
    return (
        found.select("url", (F.col("rule.verdict") == "block").cast("int").alias("blocked")).distinct()
        .orderBy(F.xxhash64("url"), "url").limit(limit)
    )


def judge_urls(urls: DataFrame, labelled: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """``urls`` with host, path, the rule that decides and the verdict: the rule's, else the classifier's."""
    clash = [c for c in urls.columns if c.startswith("__")]
    if clash:
        raise ValueError(f"columns with two leading underscores are the operator's own: {clash}")
    model = UrlModel().fit(labelled)
    keep = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    parts = urls.select(*[F.col(f"`{c}`") for c in keep], host(url).alias("__host"), path(url).alias("__path"))
    ruled = model.blocked(parts).withColumn("__rule", matched_rule(F.col("__host"), F.col("__path"), rules))
    return ruled.select(
        *[F.col(f"`{c}`") for c in keep], F.col("__host").alias("host"), F.col("__path").alias("path"),
        F.col("__rule.rule").alias("rule"),
        F.coalesce(F.col("__rule.verdict"), F.when(F.col("__blocked"), "block").otherwise("allow")).alias("verdict"),
    )


def op8_url_filter(spark, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return judge_urls(pages, decided_sample(pages, "url")).drop("url")
