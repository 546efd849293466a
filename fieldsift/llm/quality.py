"""Quality rules whose cutoffs adapt to each language and source.

Word metrics are measured per document in Arrow batches. Their distributions are gathered as mergeable KLL sketches per
(lang, source); the sketches are merged again per lang and over everything, so that a group with few documents borrows
the cutoffs of the next wider one. The cutoffs are joined back on (lang, source) and decide with the base rules.

A metric fails where it exceeds  centre + SPREAD * spread  of its group: the centre is the CENTRE quantile and the spread
its distance from the LOW quantile. No cutoff is fixed: the metrics of METRIC_NAMES take many values in every text, so
that the sketches alone decide. Only the lower part of a group counts, so junk moves no cutoff while it is less than
1 - CENTRE of the group; a group with more of it passes for one with a style of its own. Copies of one text count once
in a group's sketch. Where a group hardly varies, half the usual spread of groups of its language, or of all, stands in (a median over groups).

Edge cases: a null or empty text has no words and fails the base rule; it and all others that fail it stay out of the
sketches. null lang or source make groups of their own; very long texts are measured whole; repeated rows give repeated
result rows; a value equal to its cutoff passes; without any document that passes the
base rule there are no cutoffs and none is needed; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_table, whole_row, with_fields

#: Fixed value: the symbols that count as n_symbols.
SYMBOLS = "#*$%&|<>"
#: Metrics of the adaptive rules: other characters than letters and digits, and capitals, by characters in words; characters by word.
METRIC_NAMES = ["sign_share", "capital_share", "word_length"]
SPREAD = 10.0
#: The quantiles that a cutoff rests on.
CENTRE, LOW = 0.4, 0.1
#: Groups with fewer documents take the cutoffs of the wider group.
LEAST_DOCS = 100
_SIGNS = re.compile(r"[^\w\s]+|_+")

METRICS = "doc_id long, text_key long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"{m} double" for m in METRIC_NAMES)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    pair = np.unique(codes[:-1] * len(ids) + codes[1:], return_inverse=True)[1]
    _, where, count = np.unique(pair[:-1] * len(ids) + codes[2:], return_inverse=True, return_counts=True)
    again = count[where] > 1
    marked = np.zeros(n, bool)
    for k in range(3):
        marked[k : n - 2 + k] |= again
    return int(marked.sum())


def measure_text(text: str) -> tuple:
    data = text.encode()
    words = data.split()  # splits at the six ASCII white space characters
    n = len(words)
    lines = [x for x in data.split(b"\n") if x.strip()] if n else []
    word_chars = len(text) - sum(text.count(c) for c in " \t\n\r\x0b\x0c")
    n_symbols = sum(text.count(c) for c in SYMBOLS)
    dup_lines = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    shares = (
        sum(map(len, _SIGNS.findall(text))) / max(word_chars, 1),
        sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / max(word_chars, 1),
        word_chars / max(n, 1),
    )
    return (n, word_chars, n_symbols, dup_lines, repeats, *shares)


def metrics(docs: DataFrame, keep_row: bool = False) -> DataFrame:
    """The word metrics of every row's whole text; keep_row adds the whole row as the struct "row"."""
    kept = ["row"] if keep_row else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in METRICS.split(", ")]
        for batch in batches:
            rows = [measure_text(t) for t in batch.column("text").to_pylist()]
            columns = list(zip(*rows)) if rows else [[]] * (len(names) - 4)  # after doc_id, text_key, lang and source
            arrays = [pa.array(c, pa.int64() if i < 5 else pa.float64()) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "text_key", "lang", "source")] + arrays + [batch.column(c) for c in kept], names + kept)

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        *([whole_row(docs)] if keep_row else []),
    )
    return rows.mapInArrow(run, with_fields(METRICS, rows, kept))


#: The base rules' verdict over the measured columns.
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def _centre(sketch: str) -> Column:
    return F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(CENTRE))


def _spread(sketch: str) -> Column:
    return _centre(sketch) - F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(LOW))


def thresholds(measured: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """One row per (lang, source) with a cutoff for each metric, from sketches that merge up to lang and to all."""
    usable = measured.where(f"NOT ({BASE_FAILED})").dropDuplicates(["lang", "source", "text_key"])
    fine = usable.groupBy("lang", "source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(m).alias(m) for m in METRIC_NAMES))
    merged = [F.sum("n").alias("n"), *(F.kll_merge_agg_double(m).alias(m) for m in METRIC_NAMES)]
    large = F.col("n") >= least_docs
    usual = [F.median(F.when(large, _spread(m))).alias(f"usual_{m}") for m in METRIC_NAMES]
    by_lang = fine.groupBy("lang").agg(*merged, *usual).select(F.col("lang").alias("lang_"), F.col("n").alias("lang_n"), *(F.col(x).alias(f"lang_{x}") for m in METRIC_NAMES for x in (m, f"usual_{m}")))
    overall = fine.agg(*merged, *usual).select(*(F.col(x).alias(f"all_{x}") for m in METRIC_NAMES for x in (m, f"usual_{m}")))
    held = fine.join(by_lang, F.col("lang").eqNullSafe(F.col("lang_")), "left").join(F.broadcast(overall))  # one row of sketches
    cutoffs = []
    for m in METRIC_NAMES:
        pick = lambda f, m=m: F.when(large, f(m)).when(F.col("lang_n") >= least_docs, f(f"lang_{m}")).otherwise(f(f"all_{m}"))
        wider = F.coalesce(F.greatest(*(F.col(f"{x}_usual_{m}") / 2 for x in ("lang", "all"))), F.lit(0.0))
        cutoffs += [(pick(_centre) + SPREAD * F.greatest(pick(_spread), wider)).alias(f"most_{m}"), (pick(_spread) >= wider).alias(f"own_{m}")]
    return held.select("lang", "source", "n", *cutoffs)


def decide(measured: DataFrame, cut: DataFrame) -> DataFrame:
    """measured with base_failed, outlier (the method's verdict) and kept, by the cutoffs of each row's group."""
    m, t = measured.alias("m"), cut.alias("t")
    joined = m.join(t, F.col("m.lang").eqNullSafe(F.col("t.lang")) & F.col("m.source").eqNullSafe(F.col("t.source")), "left")
    over = F.lit(False)
    for name in METRIC_NAMES:
        over = over | F.coalesce(F.col(name) > F.col(f"most_{name}"), F.lit(False))
    return (
        joined.select("m.*", *(f"t.most_{x}" for x in METRIC_NAMES))
        .withColumn("base_failed", F.expr(BASE_FAILED))
        .withColumn("outlier", over)
        .withColumn("kept", ~F.col("base_failed") & ~F.col("outlier"))
    )


def judge(docs: DataFrame, least_docs: int = LEAST_DOCS, keep_row: bool = False) -> DataFrame:
    """The metrics and the verdict of every row; keep_row adds the whole row as the struct "row".

    Metrics and cutoffs are written to the shared folder, so texts are measured once; Spark broadcasts the cutoffs where
    their size allows it.
    """
    measured = as_table(metrics(docs, keep_row), "quality-metrics")
    return decide(measured, as_table(thresholds(measured.drop("row"), least_docs), "quality-cutoffs"))


def keep_documents(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The rows of docs that are kept, whole. Texts are never shuffled."""
    return judge(docs, least_docs, keep_row=True).where("kept").select("row.*")
