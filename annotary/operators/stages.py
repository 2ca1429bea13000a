"""The pipeline's stages as functions from table to table."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotary.functions import candidates
from annotary.functions import text as X
from annotary.models.scorers import Factory, FirstCandidate, RuleClassifier
from annotary.operators.apply import MODEL_BATCH, classify, generate


def select_eligible(articles: DataFrame) -> DataFrame:
    return articles.where(X.eligible(F.col("languages"), F.col("pubdate")))


def with_tiab(articles: DataFrame) -> DataFrame:
    """``tiab`` added, or replaced where it is there."""
    return articles.withColumn("tiab", X.tiab(F.col("title"), F.col("abstract")))


def classified(articles: DataFrame, model: Factory = RuleClassifier) -> DataFrame:
    """Eligible articles with text and class; an empty text is classified too."""
    return with_tiab(select_eligible(articles)).withColumn("bert_predict", classify(F.col("tiab"), model))


def classified_by(articles: DataFrame, trained: PipelineModel) -> DataFrame:
    """The same by a trained Spark ML model that reads ``text`` and gives ``prediction``; it stays in the JVM."""
    rows = with_tiab(select_eligible(articles))
    found = trained.transform(rows.select(F.struct("*").alias("__row"), F.col("tiab").alias("text")))
    return found.select("__row.*", "prediction").withColumn("bert_predict", F.col("prediction").cast("bigint")).drop("prediction")


def positives(rows: DataFrame) -> DataFrame:
    return rows.where("bert_predict = 1")


def adjudicated(scored: DataFrame, model: Factory = FirstCandidate, template: tuple[str, str, str] = X.PROMPT, size: int = MODEL_BATCH) -> DataFrame:
    """Scored rows with candidates, prompt, generated text and the answer in it."""
    rows = scored.withColumn("top_5_cross_lgmde", candidates.labels(F.col("top5_cross")))
    rows = rows.withColumn("llm_prompt", X.prompt(F.col("tiab"), F.col("top_5_cross_lgmde"), template))
    rows = rows.withColumn("generated_text", generate(F.col("llm_prompt"), model, size))
    return rows.withColumn("llm_dis_map", X.last_answer(F.col("generated_text")))
