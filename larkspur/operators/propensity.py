"""Purchase propensity: training frame, model and evaluation."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.scalars import count_type, is_type, share
from larkspur.operators.sampling import first_share
from larkspur.plans.ranking import percentiles
from larkspur.plans.staging import staged
from larkspur.sources.schema import CART, PURCHASE, REMOVE, VIEW

FEATURES = ["events", "sessions", "views", "carts", "removes", "active_span_days", "recency_days"]


def propensity_frame(df: DataFrame, cutoff: str) -> DataFrame:
    """Behaviour of each user before the cutoff, and whether they purchase at or after it. Both sides filter before they shuffle, on user_id."""
    at = F.lit(cutoff).cast("timestamp_ntz")
    before = df.filter(F.col("event_time") < at).groupBy("user_id").agg(
        F.count("*").alias("events"), F.count_distinct("user_session").alias("sessions"), count_type(VIEW).alias("views"), count_type(CART).alias("carts"), count_type(REMOVE).alias("removes"),
        F.date_diff(F.max("event_time"), F.min("event_time")).alias("active_span_days"), F.date_diff(at, F.max("event_time")).alias("recency_days"),
    )
    after = df.filter((F.col("event_time") >= at) & is_type(PURCHASE)).select("user_id").distinct().withColumn("target", F.lit(1))
    return before.join(after, "user_id", "left").withColumn("target", F.coalesce("target", F.lit(0)))


def class_balance(frame: DataFrame) -> DataFrame:
    by = frame.groupBy("target").agg(F.count("*").alias("users"))
    return by.withColumn("share", F.round(share(F.col("users"), F.sum("users").over(Window.partitionBy())), 6))


def stratified_split(frame: DataFrame, test: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows: of each class of n users the first ceil(test * n) in a seeded order are tested, so each keeps its share."""
    frame = staged(frame, "frame")
    held = first_share(frame, "target", test, seed)
    return frame.join(held, "user_id", "left_anti"), frame.join(held, "user_id", "left_semi")


def train(frame: DataFrame, rounds: int = 1000, seed: int = 42, depth: int = 3, least: int = 50) -> PipelineModel:
    """Boosted trees that stop growing at the first round that doesn't lower the log loss on a tenth of the rows, by hash.

    Spark gives the first tree full weight and shrinks the others, so trees are shallow and every leaf holds `least`
    rows: the first can't fit the noise that the later ones then couldn't mend. The ensemble is grown once.
    """
    marked = frame.withColumn("target", F.col("target").cast("double")).withColumn("validates", F.pmod(F.xxhash64("user_id", F.lit(seed + 1)), F.lit(10)) == 0)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    trees = GBTClassifier(
        labelCol="target", featuresCol="features", stepSize=0.05, maxDepth=depth, minInstancesPerNode=least, maxIter=rounds, featureSubsetStrategy="0.9", seed=seed, validationIndicatorCol="validates", validationTol=0.0
    )
    own = assembler.transform(marked).select("features", "target", "validates").persist()
    model = trees.fit(own)
    own.unpersist()
    return PipelineModel([assembler, model])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score(model: PipelineModel, frame: DataFrame) -> DataFrame:
    return model.transform(frame).select("user_id", "target", vector_to_array("probability")[1].alias("score"))


def roc_auc(scored: DataFrame) -> float:
    """Area under the curve over all scores, ties counted half."""
    return BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="target", numBins=0).evaluate(scored.withColumn("target", F.col("target").cast("double")))


def top_share_metrics(scored: DataFrame, quantile: float = 0.95) -> DataFrame:
    """Precision, recall and lift of the users at or above the score's quantile."""
    cut = F.broadcast(scored.agg(F.avg("target").alias("base_rate")).crossJoin(percentiles(scored, "score", (quantile,)).select(F.col("p")[0].alias("threshold"))))
    top = F.col("score") >= F.col("threshold")
    rows = scored.crossJoin(cut).agg(
        F.first("threshold").alias("threshold"), F.first("base_rate").alias("base_rate"), F.count_if(top).alias("selected"), F.sum(F.when(top, F.col("target")).otherwise(0)).alias("hits"), F.sum("target").alias("positives")
    )
    precision = share(F.col("hits"), F.col("selected"))
    return rows.select("threshold", "selected", precision.alias("precision"), share(F.col("hits"), F.col("positives")).alias("recall"), (precision / F.nullif(F.col("base_rate"), F.lit(0.0))).alias("lift"))


def feature_importance(model: PipelineModel, n: int = 5) -> DataFrame:
    """The n most important features, from the model alone."""
    trees = model.stages[-1]
    rows = sorted(zip(FEATURES, (float(x) for x in trees.featureImportances.toArray()), strict=True), key=lambda x: (-x[1], x[0]))[:n]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double")
