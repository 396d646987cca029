"""Classifiers of event sentences with Spark ML, their scores and summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import date_struct, round6
from loomline.operators.corpus import hash_split, year_of
from loomline.session import shared_folder
from loomline.sources.stages import chained, exists, fingerprint

TYPES = ("method_proposed", "release", "benchmark", "trend_application")


def _types() -> Column:
    return F.array(*(F.lit(t) for t in TYPES))


def _features(features: int) -> list:
    words = RegexTokenizer(inputCol="sentence", outputCol="w", pattern=r"[^\p{L}\p{N}]+")
    pairs = NGram(n=2, inputCol="w", outputCol="w2")
    hashed = [HashingTF(inputCol=c, outputCol=f"{c}_tf", numFeatures=features) for c in ("w", "w2")]
    weighed = [IDF(inputCol=f"{c}_tf", outputCol=f"{c}_idf") for c in ("w", "w2")]
    return [words, pairs, *hashed, *weighed, VectorAssembler(inputCols=["w_idf", "w2_idf"], outputCol="features")]


def event_pipeline(features: int = 1 << 16, penalty: float = 1e-3) -> Pipeline:
    """Words and pairs of words, hashed and weighed by idf, into logistic regression on ``label`` with weights."""
    return Pipeline(stages=[*_features(features), LogisticRegression(regParam=penalty, maxIter=20, weightCol="weight")])


def type_pipeline(features: int = 1 << 16, penalty: float = 1e-3) -> Pipeline:
    """The same features into multinomial logistic regression on ``label``, the place in TYPES."""
    return Pipeline(stages=[*_features(features), LogisticRegression(regParam=penalty, maxIter=20, family="multinomial")])


@dataclass
class Models:
    """The event model and the type model; the latter is missing where no training sentence has a type."""

    event: PipelineModel
    kind: PipelineModel | None

    def save(self, path: str) -> None:
        """Writes both models under ``path``."""
        if self.kind:
            self.kind.write().overwrite().save(f"{path}/kind")
        self.event.write().overwrite().save(f"{path}/event")

    @staticmethod
    def load(path: str, kind: bool = True) -> Models:
        return Models(PipelineModel.load(f"{path}/event"), PipelineModel.load(f"{path}/kind") if kind else None)


def labelled_sentences(labelled: DataFrame) -> DataFrame:
    """One row a sentence id with a label of 0 or 1, its split by document, and its type of event."""
    rows = labelled.where("is_event in ('0', '1') and sentence is not null and sentence_id is not null")
    kind = F.lower(F.trim(F.coalesce("event_type", F.lit(""))))
    rows = rows.groupBy("sentence_id").agg(F.min(F.struct("doc_id", "sentence", "is_event", kind.alias("event_type"), "topic", "year")).alias("r")).select("sentence_id", "r.*")
    return hash_split(rows.withColumn("label", F.col("is_event").cast("double")).withColumn("doc_id", F.coalesce("doc_id", "sentence_id")), "doc_id")


def train(rows: DataFrame) -> Models:
    """Models fitted to the training documents of ``labelled_sentences``; both classes of events weigh the same."""
    fitted = rows.where("split = 'train'")
    share = fitted.agg(F.avg("label")).first()[0] or 0.5
    weighed = fitted.withColumn("weight", F.when(F.col("label") == 1, 0.5 / max(share, 0.01)).otherwise(0.5 / max(1 - share, 0.01)))
    place = F.array_position(_types(), F.col("event_type")).cast("double") - 1
    typed = fitted.where((F.col("label") == 1) & F.col("event_type").isin(*TYPES)).select("sentence", place.alias("label"))
    return Models(event_pipeline().fit(weighed), type_pipeline().fit(typed) if typed.select("label").distinct().count() > 1 else None)


def kept_models(rows: DataFrame) -> Models:
    """``train``, kept in the shared folder as long as the training rows are the same. The event model is written last."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/models/{chained('events', fingerprint(rows.select('sentence', 'label', 'event_type', 'split')))[:32]}"
    whole = lambda name: exists(spark, f"{path}/{name}/metadata/_SUCCESS")
    if not whole("event"):
        train(rows).save(path)
    return Models.load(path, whole("kind"))


def predict(rows: DataFrame, models: Models, threshold: float = 0.5) -> DataFrame:
    """``rows`` (sentence, ...) with event_probability, is_event, event_type and event_type_confidence as predicted.

    A sentence below the threshold has type ``none`` with confidence 0.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")
    kept = [c for c in rows.columns if c not in ("event_probability", "is_event", "event_type", "event_type_confidence", "label", "weight")]
    scored = models.event.transform(rows.select(*kept)).select(*kept, round6(vector_to_array("probability")[1]).alias("event_probability"))
    scored = scored.withColumn("is_event", (F.col("event_probability") >= threshold).cast("int"))
    if models.kind:
        typed = models.kind.transform(scored)
        guess, sure = F.get(_types(), F.col("prediction").cast("int")), round6(F.array_max(vector_to_array("probability")))
    else:
        typed, guess, sure = scored, F.lit("trend_application"), F.lit(0.0)
    event = F.col("is_event") == 1
    return typed.select(*kept, "event_probability", "is_event", F.when(event, guess).otherwise("none").alias("event_type"), F.when(event, sure).otherwise(0.0).alias("event_type_confidence"))


def predict_events(labelled: DataFrame) -> DataFrame:
    """(sentence_id, split, label, probability, predicted) of every labelled sentence, trained on the training documents alone."""
    rows = labelled_sentences(labelled)
    truth = rows.select("sentence_id", F.col("label").cast("int").alias("label"))
    found = predict(rows, kept_models(rows)).select("sentence_id", "split", F.col("event_probability").alias("probability"), F.col("is_event").alias("predicted"))
    return found.join(truth, "sentence_id").select("sentence_id", "split", "label", "probability", "predicted")


def predicted_rows(labelled: DataFrame) -> DataFrame:
    """Predictions of all labelled sentences with their document, topic, own year and the date in the sentence."""
    rows = labelled_sentences(labelled)
    found = predict(rows.withColumn("year", year_of("year")), kept_models(rows)).drop("label")
    return found.withColumn("d", date_struct(F.col("sentence"), F.col("year")))


def summary(predictions: DataFrame) -> DataFrame:
    """(topic, sentences, events, dated, mean_probability) of each topic, and of all with a null topic."""
    event = F.col("is_event") == 1
    counted = predictions.rollup("topic").agg(F.count("*").alias("sentences"), F.count_if(event).alias("events"), F.count_if(event & F.col("d.extracted_year").isNotNull()).alias("dated"), round6(F.avg("event_probability")).alias("mean_probability"))
    return counted


def scores(confusion: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy and macro and weighted precision, recall and F1 of each group of (by..., truth, guess, rows).

    Classes are those that occur as truth or guess; 0 where a share is not defined.
    """
    total = lambda x: F.sum(F.when(x, F.col("rows")).otherwise(0)).cast("double")
    true, guessed = F.col("truth") == F.col("label"), F.col("guess") == F.col("label")
    listed = confusion.withColumn("label", F.explode(F.array_distinct(F.array("truth", "guess"))))
    classes = listed.groupBy(*by, "label").agg(total(true).alias("support"), total(guessed).alias("guessed"), total(true & guessed).alias("hits"))
    p = F.coalesce(F.col("hits") / F.nullif("guessed", F.lit(0.0)), F.lit(0.0))
    r = F.coalesce(F.col("hits") / F.nullif("support", F.lit(0.0)), F.lit(0.0))
    f = F.coalesce(2 * F.col("hits") / F.nullif(F.col("support") + F.col("guessed"), F.lit(0.0)), F.lit(0.0))
    each = classes.withColumns({"p": p, "r": r, "f": f})
    over = lambda c: round6(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias
    return each.groupBy(*by).agg(
        F.sum("support").cast("bigint").alias("rows"), round6(F.sum("hits") / F.sum("support")).alias("accuracy"),
        round6(F.avg("p")).alias("macro_precision"), round6(F.avg("r")).alias("macro_recall"), round6(F.avg("f")).alias("macro_f1"),
        over("p")("weighted_precision"), over("r")("weighted_recall"), over("f")("weighted_f1"),
    )
