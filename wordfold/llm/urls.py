"""URL verdicts: rules first, then a logistic regression on hashed character n-grams of host and path.

The model is trained from a small labelled table: at most ``PER_VERDICT`` different urls that a rule blocks and as many that a rule allows, drawn
by a hash.  If all labels agree the method gives that verdict to every url, without any label ``allow``.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; the path goes on up to ``?`` or
``#``.  A null url or one without ``://`` has neither; no rule fits it and the method judges it without n-grams.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordfold.llm import sample
from wordfold.storage import materialize

PER_VERDICT = 1000
FEATURES = 1 << 14
LENGTHS = (3, 4, 5)


@dataclass(frozen=True)
class Rule:
    text: str  # host and path, like example.net/en/
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES, field: str = "text") -> Column:
    """The longest rule that fits (of equally long ones the first), or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):  # later ones win
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(getattr(rule, field))).otherwise(out)
    return out


def _grams(text: Column, mark: str) -> Column:
    def of_length(n: int) -> Column:
        last = F.greatest(F.length(text) - (n - 1), F.lit(0))
        starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))

    return F.concat(*[of_length(n) for n in LENGTHS])


def grams_of(host: Column, path: Column) -> Column:
    return F.concat(_grams(F.concat(F.lit("^"), host, F.lit("$")), "h"), _grams(path, "p"))


def labelled_sample(parts: DataFrame) -> DataFrame:
    """The small labelled table: different urls a rule decides, at most ``PER_VERDICT`` of each verdict."""
    label = rule_of(F.col("host"), F.col("path"), field="verdict")
    drawn = parts.select("host", "path", label.alias("label"), F.xxhash64("host", "path").alias("h"))
    found = sample.smallest_hashes(drawn, "label", "h", F.struct("host", "path"), PER_VERDICT)
    return materialize(found.select("value.host", "value.path", "label"), "labelled-urls")


def judge(pages: DataFrame, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """One row per row of ``pages``: id, ``host``, ``path``, ``rule``, ``verdict``."""
    url = F.col(url_col)
    parts = pages.select(F.col(id_col).alias("__id"), host_of(url).alias("host"), path_of(url).alias("path"))
    hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True)
    few = labelled_sample(parts).withColumns({"grams": grams_of(F.col("host"), F.col("path")), "y": (F.col("label") == "block").cast("double")})
    labels = [r["label"] for r in few.select("label").distinct().collect()]
    rule, given = rule_of(F.col("host"), F.col("path")), rule_of(F.col("host"), F.col("path"), field="verdict")
    if len(labels) == 2:
        model = LogisticRegression(featuresCol="features", labelCol="y", regParam=0.01, maxIter=25).fit(hashing.transform(few))
        parts = model.transform(hashing.transform(parts.withColumn("grams", grams_of(F.col("host"), F.col("path")))))
        method = F.when(vector_to_array("probability")[1] >= 0.5, "block").otherwise("allow")
    else:
        method = F.lit(labels[0] if labels else "allow")
    return parts.select(F.col("__id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(given, method).alias("verdict"))
