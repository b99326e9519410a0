"""URL filter (operator 4): listed rules, then gradient-boosted trees.

Rules (host, path) give the verdict of the URLs that they fit; those URLs are
also the labelled ones from which Spark ML's gradient-boosted trees learn to
judge the rest by lexical features of the URL: length, depth, digit ratio,
character entropy, parameter count and statistics of its suffixes (share of
blocked URLs by host ending and by first path part).

Everything is a column expression, so the scan, the rules and the model run in
the JVM. The trees are fitted on at most ``train_rows`` labelled URLs (smallest
hashes first); suffix statistics cover every labelled URL, from one scan. A
training row's statistics come from the hosts of the other folds: its own label
is not among them, and the trees learn how far a suffix tells about hosts that
no rule names. ``held_out`` judges a fold's ruled URLs by the trees of the rest.
Suffix tables have a row per ending, not per URL; the planner broadcasts them
when they are small.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, cut


class Rule(NamedTuple):
    verdict: str
    rule: str       # host + path, as in "example.org/es/"


#: The rules of the query.
RULES = (Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"),
         Rule("allow", "com/fr/"), Rule("block", "com/de/"))

NUMERIC = ("url_length", "host_length", "path_length", "depth", "host_depth", "digit_ratio", "entropy",
           "parameters", "hyphens", "has_fragment", "is_https")
SUFFIXES = ("ending", "site", "first_part")
#: Folds of hosts for the statistics of training rows.
FOLDS = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both '' for NULL and without '://'."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else NULLs. A rule fits
    its host and all subdomains where the path starts with the rule's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.rule)):       # the longest is asked first
        name, slash, rest = r.rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(r.rule)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def _entropy(c: Column) -> Column:
    """Shannon entropy of the characters of a string, in bits; '' has 0."""
    n = F.length(c).cast("double")
    chars = F.split(c, "")
    term = lambda x: -(F.size(F.filter(chars, lambda y: y == x)) / n) * F.log2(F.size(F.filter(chars, lambda y: y == x)) / n)
    return F.when(n > 0, F.aggregate(F.array_distinct(F.filter(chars, lambda x: x != "")),
                                     F.lit(0.0), lambda a, x: a + term(x))).otherwise(0.0)


def with_features(df: DataFrame) -> DataFrame:
    """Lexical features of the columns url, host, path (url not NULL)."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    length = F.length(url).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    count = lambda c, ch: (F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))).cast("double")
    return df.withColumns({
        "url_length": length, "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"),
        "depth": count(path, "/"), "host_depth": count(host, "."),
        "digit_ratio": F.when(length > 0, F.length(F.regexp_replace(url, "[^0-9]", "")) / length).otherwise(0.0),
        "entropy": _entropy(F.concat(host, path)),
        "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
        "hyphens": count(host, "-"), "has_fragment": url.contains("#").cast("double"),
        "is_https": url.startswith("https:").cast("double"),
        "ending": F.substring_index(host, ".", -1), "site": F.substring_index(host, ".", -2),
        "first_part": F.element_at(F.split(path, "/"), F.when(path.startswith("/"), 2).otherwise(1)),
    })


def _with_rules(pages: DataFrame, page_id: str, url: str, rules: Sequence[Rule]) -> DataFrame:
    """(page_id, url, host, path, rule, ruled) of every page; a NULL url is ''."""
    host, path = host_and_path(F.coalesce(F.col("url"), F.lit("")))
    rule, ruled = matching_rule(F.col("host"), F.col("path"), rules)
    return (pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"))
                 .withColumn("host", host).withColumn("path", path)
                 .withColumns({"rule": rule, "ruled": ruled}))


def _labelled(feats: DataFrame) -> DataFrame:
    """The ruled URLs with their label (1: block) and their host's fold."""
    return (feats.where(F.col("ruled").isNotNull())
                 .withColumns({"label": (F.col("ruled") == "block").cast("double"),
                               "fold": F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")}))


class Judge:
    """Trees fitted on labelled URLs. ``only`` is the verdict for all where the
    labels are alike or missing, and there are no trees."""

    def __init__(self, labelled: DataFrame, train_rows: int, trees: int, depth: int):
        sums = [F.sum("blocked").alias("blocked"), F.sum("n").alias("n")]
        counts = cut(labelled.groupBy(*SUFFIXES, "fold").agg(F.sum("label").alias("blocked"), F.count("*").alias("n")))
        self.by_fold = {s: counts.groupBy(F.col(s).alias("key"), "fold").agg(*sums) for s in SUFFIXES}
        self.by_suffix = {s: cut(counts.groupBy(F.col(s).alias("key")).agg(*sums)) for s in SUFFIXES}
        sample = cut(labelled.select("label", "fold", "url", *NUMERIC, *SUFFIXES)
                     .orderBy(F.xxhash64("url")).limit(train_rows))
        classes = {r[0] for r in sample.select("label").distinct().collect()}
        self.model = None
        self.only = "block" if classes == {1.0} else "allow"
        if len(classes) < 2:
            return
        columns = [*NUMERIC, *[f"{s}_{k}" for s in SUFFIXES for k in ("rate", "seen")]]
        train = self.with_statistics(sample, own_fold=False).coalesce(2).select("label", *columns).persist()  # train_rows rows at most
        self.model = Pipeline(stages=[
            VectorAssembler(inputCols=columns, outputCol="features"),
            GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, maxBins=32,
                          stepSize=0.3, seed=7, cacheNodeIds=False),
        ]).fit(train)
        train.unpersist()

    def with_statistics(self, df: DataFrame, own_fold: bool = True) -> DataFrame:
        """Share of blocked URLs and number of labelled ones per suffix, 0.5 and 0
        for one not seen; without those of the row's own fold where it has one."""
        for s in SUFFIXES:
            df = df.join(self.by_suffix[s].toDF("key_", "blocked_", "n_"), F.col(s) == F.col("key_"), "left")
            blocked, n = (F.coalesce(F.col(c), F.lit(0)) for c in ("blocked_", "n_"))
            if not own_fold:
                df = df.join(self.by_fold[s].toDF("key__", "fold__", "blocked__", "n__"),
                             (F.col(s) == F.col("key__")) & (F.col("fold") == F.col("fold__")), "left")
                blocked, n = blocked - F.coalesce("blocked__", F.lit(0)), n - F.coalesce("n__", F.lit(0))
            df = (df.withColumns({f"{s}_rate": (blocked + 0.5) / (n + 1.0), f"{s}_seen": F.log1p(n)})
                    .drop("key_", "blocked_", "n_", "key__", "fold__", "blocked__", "n__"))
        return df

    def with_p(self, feats: DataFrame) -> DataFrame:
        """``feats`` with the trees' probability p of a block."""
        return self.model.transform(self.with_statistics(feats)).withColumn("p", vector_to_array("probability")[1])


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: Sequence[Rule] = RULES,
          train_rows: int = 20_000, threshold: float = 0.5, trees: int = 12, depth: int = 4) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score.

    ``score`` is the trees' probability of a block (NULL where a rule decides).
    A NULL url counts as ''. Where the rules label no URL, or all alike, there
    is nothing to learn: the rest gets that one verdict, or allow without any.
    """
    base = _with_rules(pages, page_id, url, rules)
    feats = with_features(base)
    fitted = Judge(_labelled(feats), train_rows, trees, depth)
    out = ["page_id", "host", "path", "rule"]
    if fitted.model is None:
        return base.select(*out, F.coalesce("ruled", F.lit(fitted.only)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    return fitted.with_p(feats).select(
        *out, F.coalesce("ruled", F.when(F.col("p") >= threshold, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("ruled").isNull(), F.col("p")).alias("score"))


def held_out(pages: DataFrame, fold: int = 0, page_id: str = "page_id", url: str = "url", rules: Sequence[Rule] = RULES,
             train_rows: int = 20_000, threshold: float = 0.5, trees: int = 12, depth: int = 4) -> DataFrame:
    """How the method judges ruled URLs of hosts that it was not fitted on: (label,
    predicted, rows), label and prediction 1 for a block. The hosts of one fold
    are left out of the fit and the statistics, then judged as if without a rule."""
    labelled = _labelled(with_features(_with_rules(pages, page_id, url, rules)))
    fitted = Judge(labelled.where(F.col("fold") != fold), train_rows, trees, depth)
    rest = labelled.where(F.col("fold") == fold).withColumn("label", F.col("label").cast("int"))
    if fitted.model is None:
        judged = rest.withColumn("predicted", F.lit(int(fitted.only == "block")))
    else:
        judged = fitted.with_p(rest).withColumn("predicted", (F.col("p") >= threshold).cast("int"))
    return judged.groupBy("label", "predicted").agg(F.count("*").alias("rows"))
