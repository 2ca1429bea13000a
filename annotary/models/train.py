"""Fine-tuning stand-ins: logistic regression over hashed words on Spark ML.

The interfaces take what the original's training takes (rows, epochs, rate, decay, seed);
a transformer trained by a distributor fits behind them.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotary.operators.metrics import binary
from annotary.operators.splits import stratified
from annotary.runtime import shared_path


def validation_split(rows: DataFrame, key: str, label: str = "label", share: float = 0.1, seed: int = 42) -> DataFrame:
    """Rows with ``side``, stratified by label row by row: equal texts may fall on both sides."""
    return stratified(rows, key, label, share, seed)


def fine_tune(rows: DataFrame, text: str = "tiab", label: str = "label", epochs: int = 5, decay: float = 0.3, features: int = 1 << 14) -> tuple[PipelineModel, int]:
    """The model with the best F1 on the rows with side ``test`` among ``epochs`` numbers of steps, and that number."""
    data = rows.where(F.col(label).isin(0, 1)).select(F.coalesce(text, F.lit("")).alias("text"), F.col(label).cast("double").alias("label"), "side").cache()
    best: tuple[float, int, PipelineModel] | None = None
    for n in range(1, epochs + 1):
        steps = [RegexTokenizer(inputCol="text", outputCol="w", pattern=r"[^\p{L}\p{N}]+"), HashingTF(inputCol="w", outputCol="x", numFeatures=features, binary=True)]
        fitted = Pipeline(stages=[*steps, LogisticRegression(featuresCol="x", labelCol="label", maxIter=4 * n, regParam=decay / 100)]).fit(data.where("side = 'train'"))
        # a model that was just fitted holds the session in its summary, which cannot be sent once the session has observed a table
        at = shared_path(rows.sparkSession, "model")
        fitted.write().save(at)
        model = PipelineModel.load(at)
        f1 = binary(model.transform(data.where("side = 'test'")).select(F.col("prediction").alias("pred"), "label")).head()["f1"]
        if best is None or f1 > best[0]:
            best = (f1, n, model)
    data.unpersist()
    return best[2], best[1]


def fine_tune_pairs(
    pairs: DataFrame, text: str = "tiab", other: str = "g2p_lgmde", label: str = "label", epochs: int = 2, share: float = 0.1, seed: int = 42
) -> tuple[PipelineModel, int]:
    """A pair scorer: the pair is one text, written (text, label) as at inference.

    The model is chosen on a side of its own, ``share`` of the pairs of each label; equal pairs are on one side."""
    joined = pairs.where(F.col(label).isin(0, 1)).select(F.concat_ws(" ", text, other).alias("tiab"), F.col(label).alias("label"))
    once = joined.groupBy("tiab").agg(F.max("label").alias("label"))
    # at most two rows; of a label with a single pair nothing is held out
    several = [r["label"] for r in once.groupBy("label").agg(F.count("*").alias("n")).collect() if r["n"] > 1]
    held = (F.col("side") == "test") & F.col("label").isin(several)
    sides = stratified(once, "tiab", "label", share, seed).select("tiab", F.when(held, "test").otherwise("train").alias("side"))
    return fine_tune(joined.join(sides, "tiab"), epochs=epochs)


def save(model: PipelineModel, metrics: DataFrame, path: str) -> None:
    """The model and a table of metrics beside it."""
    model.write().overwrite().save(f"{path}/model")
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")


def scored(model: PipelineModel, rows: DataFrame, text: str = "tiab", label: str = "label") -> DataFrame:
    """``(score, pred, label)`` of rows by a trained model; the score is the probability of label 1."""
    out = model.transform(rows.select(F.coalesce(text, F.lit("")).alias("text"), F.col(label).cast("double").alias("label")))
    return out.select(vector_to_array("probability")[1].alias("score"), F.col("prediction").alias("pred"), "label")
