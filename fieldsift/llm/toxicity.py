"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Learning uses labelled documents with crc32(doc_id as text) mod 5 other than 0, in two parts: remainders 2, 3, 4 teach the
lexicon and the trees, remainder 1 calibrates. The lexicon holds the words (and beginnings of words) that toxic documents
use far more often than others. Features per document: lexicon density, peak and variety, hits near a second person,
shares of capitals, exclamation and other punctuation, and obfuscated spellings.

Labels, lang, source and doc_id are never inputs of a score. Fitting uses MAX_TRAIN labelled documents at most, chosen by
hash of doc_id. Every unit of these that passes the least count and the log-odds is an entry of the lexicon.

Edge cases: a null or empty text has features of zero and is scored like any other; a document without a label is scored;
several labels of one doc_id count as toxic if one is; without labels of both kinds every score is 0; repeated rows are
scored each; very long texts are read whole; further columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_table, whole_row, with_fields
from .trees import bounded_sample, fit_trees, probability

MAX_TRAIN = 20_000
#: A unit enters the lexicon from this log-odds on, and in at least so many toxic training documents.
LOG_ODDS, LEAST_TOXIC = 3.0, 3
#: Length of the word beginnings that stand beside whole words.
STEM = 5

#: Second persons of the languages in use, and common substitutes for letters.
SECOND_PERSON = {"you", "your", "yours", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "sie", "tu", "te", "toi", "ton", "ta", "vous", "votre", "vos", "ti", "tus", "usted", "ustedes", "vosotros"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

FEATURES = ["density", "weight_density", "peak", "variety", "hits", "near_second_person", "capital_share", "exclaim_share", "punctuation_share", "obfuscated_share", "log_words", "hit_obfuscated"]

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"\w[^\w\s'’-]+\w|[^\W\d_]\d+[^\W\d_]")
_TRANSLATE = str.maketrans(SUBSTITUTES)


def units(word: str) -> tuple[list[str], bool]:
    """What a word is looked up as (its plain spelling, its beginning), and whether it was obfuscated."""
    core = _EDGES.sub("", word)
    obfuscated = bool(_INNER.search(core))
    plain = core.lower()
    if obfuscated:
        plain = re.sub(r"[\W_]+", "", plain.translate(_TRANSLATE))
    if not plain:
        return [], obfuscated
    return ([plain, plain[:STEM] + "*"] if len(plain) > STEM else [plain]), obfuscated


class Scanner:
    """Counts a text's features against a lexicon; looks each distinct word up once."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.known = lexicon, {}

    def look(self, word: str) -> tuple[float, bool, bool]:
        names, obfuscated = units(word)
        found = self.known[word] = (max((self.lexicon.get(x, 0.0) for x in names), default=0.0), obfuscated, bool(names) and names[0] in SECOND_PERSON)
        return found

    def features(self, text: str) -> tuple:
        words = text.split()
        n, known = max(len(words), 1), self.known
        if len(known) > 500_000:
            known.clear()
        looked = [known.get(w) or self.look(w) for w in words]
        hits = [(i, x[0]) for i, x in enumerate(looked) if x[0]]
        obfuscated = sum(x[1] for x in looked)
        near = sum(any(y[2] for y in looked[max(0, i - 5) : i + 6]) for i, _ in hits)
        letters = max(len(text), 1)
        capitals = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        punctuation = sum(map(text.count, "#*$%&|<>?;:\"()[]{}~^_=+/\\@"))
        return (
            len(hits) / n,
            sum(w for _, w in hits) / n,
            max((w for _, w in hits), default=0.0),
            float(len({words[i].lower() for i, _ in hits})),
            float(len(hits)),
            float(near),
            capitals / letters,
            text.count("!") / n,
            punctuation / letters,
            obfuscated / n,
            math.log1p(len(words)),
            float(sum(looked[i][1] for i, _ in hits)),
        )


def learn_lexicon(train: DataFrame) -> dict[str, float]:
    """Unit -> log-odds, from the distinct units of each training document (text, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                found = {u for w in set(text.split()) for u in units(w)[0]}
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([toxic] * len(found), pa.int32())], ["unit", "toxic"])

    sizes = dict(train.groupBy("toxic").count().collect())
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_other:
        return {}
    counted = train.select("text", "toxic").mapInArrow(run, "unit string, toxic int").groupBy("unit").agg(F.sum("toxic").cast("double").alias("t"), F.count("*").cast("double").alias("n"))
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("n") - F.col("t") + 0.5) / (n_other + 1.0))
    least = max(LEAST_TOXIC, math.ceil(0.003 * n_toxic))
    told = counted.where(F.col("t") >= least).withColumn("odds", odds).where(F.col("odds") >= LOG_ODDS)
    return {r.unit: float(r.odds) for r in told.select("unit", "odds").collect()}


def with_features(docs: DataFrame, lexicon: dict[str, float], keep: list[str]) -> DataFrame:
    """The columns of keep and the features of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(lexicon)
        for batch in batches:
            rows = [scanner.features(t) for t in batch.column("text").to_pylist()]
            values = [pa.array(c, pa.float64()) for c in zip(*rows)] if rows else [pa.array([], pa.float64())] * len(FEATURES)
            yield pa.RecordBatch.from_arrays(values + [batch.column(c) for c in keep], FEATURES + keep)

    schema = with_fields(", ".join(f"{x} double" for x in FEATURES), docs, keep)
    return docs.select("text", *[c for c in keep if c != "text"]).mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, keep_row: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs; keep_row adds the whole row as the struct "row"."""
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *([whole_row(docs)] if keep_row else []))
    kept = ["row"] if keep_row else []
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    teach = bounded_sample(known.where(remainder != 0), "doc_id", max_train)
    taught = as_table(own.select("doc_id", "text").join(teach, "doc_id").withColumn("part", remainder), "toxicity-train")
    lexicon = learn_lexicon(taught.where("part <> 1"))
    seen = with_features(taught, lexicon, ["toxic", "part"])
    model = fit_trees(seen.where("part <> 1"), FEATURES, "toxic")
    raw = probability(model, with_features(own, lexicon, ["doc_id", *kept]), FEATURES)
    calibration = probability(model, seen.where("part = 1"), FEATURES).select(F.col("p").alias("features"), F.col("toxic").cast("double").alias("label")).cache()
    try:
        if model is not None and calibration.select("label").distinct().count() == 2:
            step = IsotonicRegression(featuresCol="features", labelCol="label", predictionCol="score").fit(calibration)
            scored = step.transform(raw.withColumn("features", F.col("p")))
        else:
            scored = raw.withColumn("score", F.col("p"))
    finally:
        calibration.unpersist()
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    held = F.coalesce(remainder == 0, F.lit(False))
    return scored.select(*kept, "doc_id", held.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
