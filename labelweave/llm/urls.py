"""URL filters: host and path rules, and gradient-boosted trees for what no rule covers. DataFrame functions only.

The trees are trained on the URLs that the rules label, by lexical features: length, depth, digit
ratio, entropy, parameter counts and statistics of host suffixes.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm.common import Scratch, small, table


@dataclass(frozen=True)
class Rule:
    """Blocks or allows a host with its subdomains, for paths that start with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
#: Labelled URLs that the trees are trained on, at most about.
SAMPLE = 20_000
#: Parts that suffix statistics are kept for apart.
FOLDS = 5
#: Counts towards the overall rate that a suffix's rate is shrunk by.
SHRINK = 20.0
#: Suffixes of a host that statistics are kept of: its last label, and its last two.
LEVELS = (1, 2)
#: Rows among which a suffix's statistics are spread where suffixes are too many to be sent to all executors.
SALTS = 16
FEATURES = ("length", "host_length", "depth", "host_depth", "digit_ratio", "entropy", "parameters", "query_length", "hyphens", *(f"suffix_{x}_{level}" for level in LEVELS for x in ("rate", "weight")))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both are empty for null and for URLs without ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    of = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(of(1), string.ascii_uppercase, string.ascii_lowercase), of(2)


def matched(rules: tuple[Rule, ...], host: Column, path: Column) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. Rules are a short list; each is one condition of a CASE."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule: string, verdict: string>")


def suffix(host: Column, level: int) -> Column:
    """The last `level` labels of a host."""
    return F.substring_index(host, ".", -level)


def lexical(df: DataFrame) -> DataFrame:
    """Add the features that need the URL alone; df has url, host and path."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    share = lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.filter(F.split(url, ""), lambda c: c != "")), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    count = lambda text, c: (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double")
    return df.withColumns({
        "length": F.length(url).cast("double"), "host_length": F.length("host").cast("double"), "depth": count(F.col("path"), "/"), "host_depth": count(F.col("host"), "."),
        "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / n, "entropy": entropy, "parameters": F.when(query != "", count(query, "&") + 1).otherwise(0.0), "query_length": F.length(query).cast("double"), "hyphens": count(url, "-"),
    })


@dataclass
class Filter:
    """Trees and suffix statistics (s, fold, n, b: labelled and blocked URLs of a suffix in each fold); without trees every verdict is `constant`.

    totals has a written table (s, n, b) for each level, over all folds.
    """

    trees: GBTClassificationModel | None
    suffixes: DataFrame | None
    rate: float
    constant: str = "allow"
    totals: tuple[DataFrame, ...] = ()

    def features(self, df: DataFrame, *, out_of_fold: bool = False) -> DataFrame:
        """Add the vector of features. With out_of_fold, a suffix's statistics leave out the fold of the row itself, so no label tells of itself."""
        df = lexical(df).withColumn("_fold", fold(F.col("url")))
        for level, totals in zip(LEVELS, self.totals, strict=True):
            df = beside(df.withColumn("_s", suffix(F.col("host"), level)), totals)
            n, b = F.coalesce("_n", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))
            if out_of_fold:
                mine = self.suffixes.select(F.col("s").alias("_s"), F.col("fold").alias("_fold"), F.col("n").alias("_mine"), F.col("b").alias("_blocked"))
                df = df.join(mine, ["_s", "_fold"], "left")
                n, b = n - F.coalesce("_mine", F.lit(0.0)), b - F.coalesce("_blocked", F.lit(0.0))
            df = df.withColumn(f"suffix_rate_{level}", (b + SHRINK * self.rate) / (n + SHRINK)).withColumn(f"suffix_weight_{level}", F.log1p(n)).drop("_s", "_n", "_b", "_mine", "_blocked")
        return VectorAssembler(inputCols=[*FEATURES], outputCol="features").transform(df)

    def verdicts(self, df: DataFrame) -> DataFrame:
        """Add column guess to df (url, host, path and others)."""
        if self.trees is None:
            return df.withColumn("guess", F.lit(self.constant))
        return self.trees.transform(self.features(df)).withColumn("guess", F.when(F.col("prediction") == 1, "block").otherwise("allow"))


def beside(df: DataFrame, totals: DataFrame) -> DataFrame:
    """df with _n and _b of its suffix _s, null where it has none.

    Last labels, of which one is half of all hosts, are few and go to all executors, as does any table that is
    small; rows of a suffix in a larger one are spread over salts.
    """
    found = totals.select(F.col("s").alias("_s"), F.col("n").alias("_n"), F.col("b").alias("_b"))
    if (light := small(found)) is not found:
        return df.join(light, "_s", "left")
    salted = found.withColumn("_salt", F.explode(F.array([F.lit(k) for k in range(SALTS)])))
    return df.withColumn("_salt", F.pmod(F.xxhash64("url", F.lit(3)), F.lit(SALTS)).cast("int")).join(salted, ["_s", "_salt"], "left").drop("_salt")


def fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(2)), F.lit(FOLDS)).cast("int")


def labelled(pages: DataFrame, rules: tuple[Rule, ...], url_col: str) -> DataFrame:
    """(url, host, path, label) of the rows that a rule covers."""
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(url_col).alias("url"), host.alias("host"), path.alias("path")).withColumn("found", matched(rules, F.col("host"), F.col("path"))).where("found is not null")
    return rows.select("url", "host", "path", (F.col("found.verdict") == "block").cast("double").alias("label"))


def train(pages: DataFrame, rules: tuple[Rule, ...] = RULES, *, url_col: str = "url", sample: int = SAMPLE, rounds: int = 15, depth: int = 4) -> Filter:
    """Fit on a sample of about `sample` distinct URLs that rules cover, chosen by a hash of the URL.

    Statistics of host suffixes are counted over all labelled rows. Pages are read twice: for these counts
    and for the sample, which are written to the shared folder; fitting reads the sample alone. Without URLs
    of both labels there are no trees and the verdict is the only label there is, or allow.
    """
    scratch, rows = Scratch(pages.sparkSession), labelled(pages, rules, url_col)
    counts = scratch.save(rows.withColumn("s", F.explode(F.array_distinct(F.array(*[suffix(F.col("host"), x) for x in LEVELS])))).groupBy("s", fold(F.col("url")).alias("fold")).agg(F.count("*").cast("double").alias("n"), F.sum("label").alias("b")))
    # the shortest suffixes cover each row once
    n, blocked = counts.where(~F.col("s").contains(".")).agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("b"), F.lit(0.0))).first()
    if not 0 < blocked < n:
        return Filter(None, None, 0.0, "block" if n and blocked else "allow")
    chosen = F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int(min(1.0, sample / n) * (1 << 30)) + 1
    found = Filter(None, counts, blocked / n)
    found.totals = tuple(scratch.save(counts.where(F.size(F.split("s", r"\.")) <= level).groupBy("s").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))) for level in LEVELS)
    data = scratch.save(found.features(rows.where(chosen).dropDuplicates(["url"]), out_of_fold=True).select("features", "label"))
    found.trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, maxBins=32, stepSize=0.3, seed=5, cacheNodeIds=False).fit(data)
    return found


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, found: Filter | None = None, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) for each row: the longest rule's verdict, else the trees'.

    A null URL, or one without ://, has an empty host and path, fits no rule and is left to the trees;
    equal rows get equal verdicts; null ids are kept; an empty table gives no rows; other columns are not
    read.
    """
    found = found or train(pages, rules, url_col=url_col)
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path")).withColumn("_match", matched(rules, F.col("host"), F.col("path")))
    return found.verdicts(rows).select(F.col("_id").alias(id_col), "host", "path", F.col("_match.rule").alias("rule"), F.coalesce("_match.verdict", "guess").alias("verdict"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return judge(table(spark, sf_dir, "pages"))
