"""URL filter: rules for hosts and paths, and gradient-boosted trees for the urls that no rule decides.

A rule is "host/path": it fits its host and all its subdomains if the url's path starts with the rule's path; the longest
rule that fits decides. Urls that a rule decides are the labelled urls: the trees learn from their lexical features
(lengths, depth, shares of digits and other signs, entropy, parameter counts, and suffix statistics: how often labelled
urls with the same host suffix or the same first path segment are blocked) and judge the rest; a url is blocked from a
probability of one half.

Suffix statistics of a labelled url come from the labelled urls of other folds only (FOLDS folds by hash of the host), so
that no url's own label, nor its host's, is an input of its features. held_out reports how a model that never saw a fold
judges it.

Edge cases: a null url, or one without "://", has an empty host and path and no rule; it is judged by its features like
any other. Without labelled urls of both kinds every undecided url is allowed. Very long urls are read whole; repeated
rows are judged each; empty tables give empty results; further columns are ignored. The trees are fitted on MAX_TRAIN
labelled urls at most, chosen by hash; the suffix statistics cover all labelled urls.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_text import url_parts
from .trees import bounded_sample, fit_trees, probability

MAX_TRAIN = 20_000
#: Labelled urls that the overall rate counts as, when the rate of a suffix is smoothed.
SMOOTHING = 10.0

LEXICAL = ["url_length", "host_length", "path_length", "depth", "host_labels", "digit_share", "host_digit_share", "sign_share", "hyphens", "entropy", "host_entropy", "parameters", "has_fragment", "has_extension", "secure", "longest_word"]
#: Parts of a url whose labelled urls make statistics: the host's last label, its last two, and the first path segment.
SUFFIXES = ["suffix1", "suffix2", "section"]
FEATURES = [*LEXICAL, *(f"{x}_rate" for x in SUFFIXES)]
FOLDS = 5


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def lexical(url: str, host: str, path: str) -> tuple:
    n, rest = max(len(url), 1), url[url.find("?") :] if "?" in url else ""
    return (
        len(url), len(host), len(path), path.strip("/").count("/") + bool(path.strip("/")), host.count(".") + bool(host),
        sum(map(str.isdigit, url)) / n, sum(map(str.isdigit, host)) / max(len(host), 1), sum(not c.isalnum() for c in url) / n, host.count("-"),
        _entropy(url), _entropy(host), rest.count("=") if rest else 0, float("#" in url), float(bool(re.search(r"\.\w{1,5}$", path))), float(url.lower().startswith("https:")),
        max(map(len, re.split(r"[\W_]+", host + path)), default=0),
    )


def with_lexical(urls: DataFrame) -> DataFrame:
    """urls (page_id, url, host, path, rule, decided) with the lexical features."""
    kept = ["page_id", "host", "path", "rule", "decided"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [lexical(u or "", h, p) for u, h, p in zip(*(batch.column(c).to_pylist() for c in ("url", "host", "path")))]
            values = [pa.array([float(x) for x in c], pa.float64()) for c in zip(*rows)] if rows else [pa.array([], pa.float64())] * len(LEXICAL)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + values, kept + LEXICAL)

    return urls.mapInArrow(run, "page_id long, host string, path string, rule string, decided string, " + ", ".join(f"{x} double" for x in LEXICAL))


def by_rules(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, url, host, path, rule (or null) and decided (the rule's verdict or null)."""
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    rule = decided = F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda x: len(x[1])):  # the longest is asked last and so stands outermost
        name, slash, below = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + below)
        rule, decided = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(decided)
    return rows.withColumns({"rule": rule, "decided": decided})


def _suffixes(rows: DataFrame) -> DataFrame:
    labels = F.split("host", r"\.")
    return rows.withColumns(
        {
            "suffix1": F.element_at(labels, -1),
            "suffix2": F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2)),
            "section": F.coalesce(F.get(F.split("path", "/"), 1), F.lit("")),
            "fold": F.when(F.col("decided").isNotNull(), F.pmod(F.xxhash64("host", F.lit(3)), F.lit(FOLDS)).cast("int")),
        }
    )


def with_suffix_rates(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """rows with the smoothed share of blocked urls per suffix among labelled urls of other folds (all, where fold is null)."""
    blocked = (F.col("decided") == "block").cast("double")
    overall = labelled.agg(F.avg(blocked)).first()[0]
    prior = 0.5 if overall is None else overall
    for key in SUFFIXES:
        folds = [F.struct(F.sum(F.when(F.col("fold") == k, blocked)).alias("b"), F.count_if(F.col("fold") == k).alias("n")) for k in range(FOLDS)]
        stats = labelled.groupBy(key).agg(F.sum(blocked).alias("_b"), F.count("*").alias("_n"), F.array(*folds).alias("_f"))
        own = F.get("_f", F.col("fold"))
        seen = F.col("_n") - F.coalesce(own["n"], F.lit(0))
        rate = (F.col("_b") - F.coalesce(own["b"], F.lit(0.0)) + SMOOTHING * prior) / (seen + SMOOTHING)
        rows = rows.join(stats, key, "left").withColumn(f"{key}_rate", F.coalesce(rate, F.lit(float(prior)))).drop("_b", "_n", "_f")
    return rows


def _features(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    rows = _suffixes(with_lexical(by_rules(pages, rules)))
    return with_suffix_rates(rows, _suffixes(by_rules(pages, rules)).where("decided is not null"))


def _fit(rows: DataFrame, max_train: int):
    train = rows.where("decided is not null").withColumn("y", (F.col("decided") == "block").cast("double"))
    return fit_trees(bounded_sample(train, "page_id", max_train), FEATURES, "y")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], max_train: int = MAX_TRAIN) -> DataFrame:
    """page_id, host, path, rule, verdict and p (the trees' probability of block) of every page."""
    rows = _features(pages, rules)
    judged = probability(_fit(rows, max_train), rows, FEATURES)
    verdict = F.coalesce("decided", F.when(F.col("p") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "p")


def held_out(pages: DataFrame, rules: list[tuple[str, str]], fold: int = 0, max_train: int = MAX_TRAIN) -> DataFrame:
    """page_id, decided and p of the labelled urls of one fold of hosts, by a model fitted on the other folds."""
    rows = _features(pages, rules)
    judged = probability(_fit(rows.where(F.col("fold") != fold), max_train), rows.where(F.col("fold") == fold), FEATURES)
    return judged.select("page_id", "decided", "p")
