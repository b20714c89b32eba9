"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardbook.llm.support import keyed, small_batches, table, written

TRAIN_ROWS = 20_000
"""Labelled documents that are learned from, at most; the ones with the smallest hash of their id."""
LEXICON_WORDS = 500
"""Learned words, at most."""
MIN_DOCUMENTS = 5
"""Toxic documents a word has to occur in to be learned."""
MIN_LIFT = 4.0
"""Times the base rate that the share of toxic documents among a word's documents has to be."""
NEAR = 4
"""Words between a hit and a second-person word that count as near."""
FOLDS = 5

# Insults that count from the start, and second-person words.
INSULTS = """idiot idiots moron morons imbecile stupid dumb fool loser losers trash garbage scum filth vermin pathetic
worthless disgusting clown clowns pig pigs jerk bastard bitch whore slut retard retarded freak creep coward liar
idiota imbecil estupido estúpido basura asqueroso payaso crétin débile ordure minable dégoûtant idiote clown
dumm dummkopf abschaum müll widerlich trottel""".split()
SECOND_PERSON = """you your yours yourself ya u ur tu te ti usted ustedes vos vosotros toi vous ton ta tes votre vos
du dich dir ihr euch dein deine euer""".split()

_WORD = re.compile(r"[^\W_]+(?:[*@$!#0-9][^\W_]+)*")
_MASKS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_MIXED = re.compile(r"[^\W\d_][*@$!#0-9]+[^\W\d_]")
_REPEATED = re.compile(r"(.)\1\1")

FEATURES = [
    "log_words",
    "insult_hits",
    "insult_density",
    "insult_kinds",
    "learned_hits",
    "learned_density",
    "learned_weight",
    "learned_strongest",
    "hidden_hits",
    "near_second_person",
    "second_person_density",
    "capital_share",
    "shouted_share",
    "exclamation_rate",
    "question_rate",
    "punctuation_rate",
    "mixed_rate",
    "repeated_rate",
]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def features_of(text: str | None, learned: dict[str, float]) -> list[float]:
    """The dense features of a text; all zero without words."""
    text = text or ""
    words = words_of(text)
    size, letters = max(1, len(words)), max(1, len(text))
    insults, second = set(INSULTS), set(SECOND_PERSON)
    hits, kinds, weight, strongest, hidden, near, learned_hits = 0, set(), 0.0, 0.0, 0, 0, 0
    for at, word in enumerate(words):
        known = word in insults
        if known:
            hits += 1
            kinds.add(word)
        w = learned.get(word, 0.0)
        if w:
            learned_hits += 1
            weight += w
            strongest = max(strongest, w)
        if not known and not w and not word.isalpha() and word.translate(_MASKS) in insults:
            hidden += 1
            known = True
        if (known or w) and not second.isdisjoint(words[max(0, at - NEAR) : at + NEAR + 1]):
            near += 1
    shouted = sum(1 for w in text.split() if len(w) > 2 and w.isupper())
    capitals = sum(map(str.isupper, text))
    marks = {c: text.count(c) for c in "!?"}
    return [
        math.log1p(len(words)),
        float(hits),
        hits / size,
        float(len(kinds)),
        float(learned_hits),
        learned_hits / size,
        weight,
        strongest,
        float(hidden),
        float(near),
        sum(w in second for w in words) / size,
        capitals / letters,
        shouted / size,
        marks["!"] / size,
        marks["?"] / size,
        sum(not (c.isalnum() or c.isspace()) for c in text) / letters,
        len(_MIXED.findall(text)) / size,
        len(_REPEATED.findall(text)) / size,
    ]


def with_features(docs: DataFrame, learned: dict[str, float]) -> DataFrame:
    """``docs`` with a column ``features`` from ``text``; the learned words travel with the function (bounded)."""

    def make(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([features_of(t, learned) for t in texts])

    small_batches(docs.sparkSession)
    return docs.withColumn("dense", F.pandas_udf(make, "array<double>")("text"))


def learn_words(labelled: DataFrame) -> dict[str, float]:
    """Words that mark toxic texts, with the logarithm of their lift, learned from ``(text, label)``."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter = Counter()
            for text, label in zip(batch["text"], batch["label"], strict=True):
                counts.update((word, int(label)) for word in set(words_of(text)))
            rows = [(w, n if y else 0, n) for (w, y), n in counts.items()]
            yield pd.DataFrame(rows, columns=["word", "toxic", "total"])

    small_batches(labelled.sparkSession)
    totals = labelled.agg(F.sum("label"), F.count("*")).first()
    base = (totals[0] or 0) / max(1, totals[1])
    if not base:
        return {}
    share = (F.col("toxic") + base) / (F.col("total") + 1)
    rows = (
        labelled.mapInPandas(found, "word string, toxic long, total long")
        .groupBy("word")
        .agg(F.sum("toxic").alias("toxic"), F.sum("total").alias("total"))
        .filter(F.col("toxic") >= MIN_DOCUMENTS)
        .withColumn("lift", share / base)
        .filter(F.col("lift") >= MIN_LIFT)
        .orderBy(F.desc(F.col("lift") * F.sqrt("toxic")), "word")
        .limit(LEXICON_WORDS)
        .collect()
    )
    return {r["word"]: math.log(r["lift"]) for r in rows}


@dataclass
class ToxicityModel:
    """What training gives; ``trees`` is None where the labels had no two classes, and every score is ``prior``."""

    learned: dict[str, float]
    trees: GBTClassificationModel | None
    curve: IsotonicRegressionModel | None
    prior: float

    def score(self, docs: DataFrame) -> DataFrame:
        """``row, score, predicted``: each row of ``docs`` as a struct, its score (0 to 1), and 1 from 0.5."""
        rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
        if self.trees is None:
            scored = rows.withColumn("score", F.lit(self.prior))
        else:
            raw = _margin(self.trees, _assembled(with_features(rows, self.learned)))
            scored = self.curve.transform(raw).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "curve")))
        return scored.select("row", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _assembled(frame: DataFrame) -> DataFrame:
    parts = frame.select("*", *(F.col("dense")[i].alias(f"_{n}") for i, n in enumerate(FEATURES))).drop("dense")
    return VectorAssembler(inputCols=[f"_{n}" for n in FEATURES], outputCol="features").transform(parts)


def _margin(trees: GBTClassificationModel, frame: DataFrame) -> DataFrame:
    return trees.transform(frame).withColumn("margin", vector_to_array("rawPrediction")[1])


def fold(ids: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(ids.cast("string").cast("binary")), F.lit(folds)).cast("int")


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Learn from labelled documents outside fold 0 of five.

    Fold 1 is kept for the calibration curve; the words and trees come from the
    others. Labels that are null and documents without a label are not used; of several
    labels of a document the largest counts. ``train_rows`` bounds the sample.
    """
    chosen = written(
        labels.filter("toxic is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("double").alias("label"))
        .withColumn("fold", fold(F.col("doc_id"), FOLDS))
        .filter("fold <> 0")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(train_rows)
    )
    texts = keyed(docs.select("doc_id", "text"), chosen.select("doc_id"), "left_semi", train_rows)
    known = written(texts.join(chosen, "doc_id").select("text", "label", "fold"))
    counts = known.groupBy("label", (F.col("fold") > 1).alias("later")).agg(F.count("*").alias("n")).collect()
    classes = {(r["label"], r["later"]): r["n"] for r in counts}
    total = sum(classes.values())
    prior = sum(n for (label, _), n in classes.items() if label) / total if total else 0.0
    if not all(classes.get((label, True)) for label in (0.0, 1.0)):
        return ToxicityModel({}, None, None, prior)
    learned = learn_words(known.filter("fold > 1").select("text", "label"))
    ready = written(with_features(known, learned).select("label", "fold", "dense"))
    rows = _assembled(ready)
    trees = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=20, maxDepth=4, stepSize=0.2, minInstancesPerNode=5, seed=7
    ).fit(rows.filter("fold > 1"))
    calibration = rows if not all(classes.get((label, False)) for label in (0.0, 1.0)) else rows.filter("fold = 1")
    curve = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="curve").fit(
        _margin(trees, calibration).select("margin", "label")
    )
    return ToxicityModel(learned, trees, curve, prior)


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    The score depends on the text alone; a null text counts as empty and is
    scored like any other. Rows that repeat a ``doc_id`` are scored each; a null
    ``doc_id`` is scored and never held out. Without labels of both classes every
    score is the share of toxic labels, 0 without any. Other columns are not used.
    """
    scored = train(docs, labels, train_rows).score(docs.select("doc_id", "text"))
    held_out = F.coalesce(fold(F.col("row.doc_id"), FOLDS) == 0, F.lit(False))
    return scored.select("row.doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
