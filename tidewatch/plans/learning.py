"""From audit snapshots and labels to trained, registered and compared models."""

from __future__ import annotations

import json
from dataclasses import dataclass
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidewatch.config import MODEL_FEATURES, LinearModel
from tidewatch.functions.values import json_number
from tidewatch.operators.labels import FRAUD, latest_matured
from tidewatch.operators.quality import blunt_rule
from tidewatch.operators.ranking import fixed_sample, metrics_at_budget
from tidewatch.operators.refjoin import cross_border
from tidewatch.operators.windows import with_recent_count, with_recent_members
from tidewatch.operators.skew import HeavyKeys
from tidewatch.operators.signals import with_pair_state
from tidewatch.session import pinned
from tidewatch.sources.files import read_parquet

# Gate and cap of a training run, and its sampling seed.
MIN_POSITIVES, SAMPLE_CAP, SAMPLE_SEED = 20, 1_000_000, 42

# Training rows of one task; every round of boosting reads all of them several times.
ROWS_PER_TASK = 50_000

VECTOR = "_features"

REGISTRY = T.StructType([
    T.StructField("version", T.StringType()), T.StructField("role", T.StringType()),
    T.StructField("path", T.StringType()), T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("n_train", T.LongType()), T.StructField("pos", T.LongType()),
    T.StructField("trained_at_ms", T.LongType()), T.StructField("seq", T.LongType()),
])


def snapshot_features(audit: DataFrame, features: Sequence[str] = MODEL_FEATURES) -> DataFrame:
    return audit.select("transaction_id", *[json_number(F.col("feature_snapshot_json"), f).alias(f)
                                            for f in features])


def training_set(audit: DataFrame, labels: DataFrame, at: Column, maturation_ms: int = 0,
                 cap: int | None = None, features: Sequence[str] = MODEL_FEATURES) -> DataFrame:
    """Feature snapshots with the outcome of their matured label; never more than `cap` rows."""
    matured = latest_matured(labels, at, maturation_ms)
    joined = (audit.select("transaction_id", "feature_snapshot_json").join(matured, "transaction_id")
              .withColumn("y", F.when(F.col("label") == FRAUD, 1).otherwise(0)))
    if cap is not None:
        joined = fixed_sample(joined, "transaction_id", cap, SAMPLE_SEED)
    numbers = [json_number(F.col("feature_snapshot_json"), f).alias(f) for f in features]
    return joined.select("transaction_id", *numbers, "y")


def offline_training_set(txns: DataFrame, payees: DataFrame, lists: DataFrame,
                         heavy: HeavyKeys = HeavyKeys()) -> DataFrame:
    """Weakly labelled rows with features exact to the millisecond over the raw history."""
    rows = with_recent_count(txns, ["customer_id"], 3_600_000, "customer_txn_count_1h", heavy)
    rows = with_recent_members(rows, "receiver_account", "customer_id", 86_400_000,
                               "bene_distinct_senders_24h", heavy)
    rows = with_pair_state(rows, heavy)
    bad = lists.filter(F.col("list_name").isin("bl_accounts", "bl_devices")).select("list_name", "member").distinct()
    accounts = bad.filter(F.col("list_name") == "bl_accounts").select(
        F.col("member").alias("receiver_account"), F.lit(True).alias("_bad_account"))
    devices = bad.filter(F.col("list_name") == "bl_devices").select(
        F.col("member").alias("device_fingerprint"), F.lit(True).alias("_bad_device"))
    rows = (rows.join(payees.dropDuplicates(["receiver_account"]), "receiver_account", "left")
            .join(accounts, "receiver_account", "left").join(devices, "device_fingerprint", "left"))
    fraud = (F.coalesce("is_mule_pattern", F.lit(False)) | F.col("_bad_account").isNotNull()
             | F.col("_bad_device").isNotNull() | (F.col("customer_txn_count_1h") > 5))
    return rows.select(
        "transaction_id", "amount_base", F.hour("ts").cast("double").alias("local_hour"),
        F.col("customer_txn_count_1h").cast("double").alias("customer_txn_count_1h"),
        F.col("bene_distinct_senders_24h").cast("double").alias("bene_distinct_senders_24h"),
        F.col("pair_txn_count_90d").cast("double").alias("pair_txn_count_90d"),
        cross_border(F.col("beneficiary_country"), F.col("customer_portfolio_country")).alias("cross_border"),
        fraud.cast("int").alias("y"))


def standard_stats(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and population deviation per feature; a variance of 1e-12 or less counts as 1."""
    wide = rows.agg(*[F.avg(f).alias(f"{f}_mean") for f in features],
                    *[F.stddev_pop(f).alias(f"{f}_std") for f in features])
    entries = F.array(*[F.struct(
        F.lit(f).alias("feature"), F.col(f"{f}_mean").alias("mean"),
        F.when(F.col(f"{f}_std") * F.col(f"{f}_std") > 1e-12, F.col(f"{f}_std")).otherwise(1.0).alias("std"))
        for f in features])
    return wide.select(F.inline(entries))


def with_class_weights(rows: DataFrame, label: str = "y") -> DataFrame:
    """Weights that give both classes the same total."""
    counts = rows.agg(F.count("*").alias("n"), F.sum(F.col(label)).alias("pos")).first()
    n, pos = counts.n or 0, counts.pos or 0
    return rows.withColumn("weight", F.when(F.col(label) == 1, n / (2.0 * max(pos, 1)))
                           .otherwise(n / (2.0 * max(n - pos, 1))))


def train_linear(rows: DataFrame, features: Sequence[str], version: str, label: str = "y") -> LinearModel:
    """Balanced logistic regression on standardised features."""
    stats = {r.feature: r for r in standard_stats(rows, features).collect()}
    scaled = with_class_weights(rows, label).select(
        F.col(label).cast("double").alias(label), "weight",
        *[((F.col(f) - stats[f]["mean"]) / stats[f]["std"]).alias(f) for f in features])
    packed = VectorAssembler(inputCols=list(features), outputCol=VECTOR).transform(scaled)
    fitted = LogisticRegression(featuresCol=VECTOR, labelCol=label, weightCol="weight", standardization=False,
                                maxIter=200, tol=1e-8).fit(packed)
    return LinearModel(version, tuple(features), tuple(stats[f]["mean"] for f in features),
                       tuple(stats[f]["std"] for f in features),
                       tuple(float(w) for w in fitted.coefficients), float(fitted.intercept))


def dealt(rows: DataFrame) -> DataFrame:
    """Many rows spread over the cores, however few files they were read from; few rows stay as they are."""
    parts = min(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // ROWS_PER_TASK)
    return rows.repartition(parts) if parts > 1 else rows


def train_trees(rows: DataFrame, features: Sequence[str] = MODEL_FEATURES, label: str = "y", seed: int = 0,
                trees: int = 200, depth: int = 5, rate: float = 0.1) -> PipelineModel:
    """Balanced boosted trees. The training rows are written once, since every round reads them."""
    ready = pinned(dealt(with_class_weights(rows, label).select(
        *[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias(label), "weight")))
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol=VECTOR),
        GBTClassifier(featuresCol=VECTOR, labelCol=label, weightCol="weight", maxIter=trees, stepSize=rate,
                      maxDepth=depth, seed=seed)]).fit(ready)


def with_probability(model: PipelineModel, rows: DataFrame, name: str = "score") -> DataFrame:
    ready = rows.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0))
                              for f in model.stages[0].getInputCols()})
    scored = model.transform(ready).withColumn(name, vector_to_array("probability")[1])
    return scored.drop(VECTOR, "rawPrediction", "probability", "prediction")


# --- registry ------------------------------------------------------------------------------------

def registry(spark: SparkSession, path: str) -> DataFrame:
    """The latest entry of each version."""
    rows = read_parquet(spark, path, REGISTRY)
    newest = F.max_by(F.struct(*[c for c in REGISTRY.fieldNames() if c != "version"]), "seq").alias("r")
    return rows.groupBy("version").agg(newest).select("version", "r.*")


def register(spark: SparkSession, path: str, version: str, role: str, model_path: str,
             features: Sequence[str], n_train: int, pos: int, trained_at_ms: int) -> None:
    """Adds an entry after its model is saved, so a reader never meets a model that is not there."""
    _append(spark, path, [(version, role, model_path, list(features), n_train, pos, trained_at_ms)])


def _append(spark: SparkSession, path: str, entries: list[tuple]) -> None:
    """All entries in one file of one write, so a reader sees all of them or none. Their numbers are this writer's alone."""
    last = registry(spark, path).agg(F.max("seq")).first()[0] or 0
    rows = []
    for e in entries:
        last = claimed(spark, f"{path.rstrip('/')}-numbers", last + 1)
        rows.append((*e, last))
    # Two writers that append to one folder share its temporary one, which the first to end removes.
    own = f"{path.rstrip('/')}-entries/{last}"
    spark.createDataFrame(rows, REGISTRY).coalesce(1).write.parquet(own)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(target)
    for part in store.globStatus(jvm.org.apache.hadoop.fs.Path(f"{own}/part-*")):
        if not store.rename(part.getPath(), jvm.org.apache.hadoop.fs.Path(target, part.getPath().getName())):
            raise OSError(f"could not add entry {last} to {path}")


def claimed(spark: SparkSession, folder: str, least: int) -> int:
    """The smallest free number from `least` on, taken by creating its file, which fails for all writers but one."""
    jvm, number = spark.sparkContext._jvm, least
    target = jvm.org.apache.hadoop.fs.Path(folder)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(target)
    while True:
        own = jvm.org.apache.hadoop.fs.Path(target, str(number))
        try:
            if store.getScheme() == "file":         # Hadoop looks before it creates there; the system call does both at once
                open(own.toUri().getPath(), "x").close()
            else:
                store.create(own, False).close()
            return number
        except (FileExistsError, Py4JJavaError) as problem:
            if isinstance(problem, Py4JJavaError) and not store.exists(own):
                raise
            number += 1


def promote(spark: SparkSession, path: str, version: str) -> None:
    """Makes `version` the champion and retires the one before, in one write: there is a champion at any time."""
    now = registry(spark, path).filter((F.col("role") == "champion") | (F.col("version") == version)).collect()
    if version not in [r.version for r in now]:
        raise ValueError(f"{version} is not registered")
    _append(spark, path, [(r.version, "champion" if r.version == version else "retired", r.path, list(r.features), r.n_train,
                           r.pos, r.trained_at_ms) for r in now])


def active_model(spark: SparkSession, path: str, role: str = "champion"):
    """(version, model) of the newest entry in a role, or None."""
    r = registry(spark, path).filter(F.col("role") == role).orderBy(F.desc("seq")).limit(1).collect()
    return (r[0].version, PipelineModel.load(r[0].path)) if r else None


@dataclass(frozen=True)
class TreeScorer:
    """A registered tree model in the form that decide(), score() and the scoring stream take."""

    version: str
    model: PipelineModel

    def with_probability(self, rows: DataFrame, name: str) -> DataFrame:
        return with_probability(self.model, rows, name)


def active_scorer(spark: SparkSession, path: str, role: str = "champion") -> TreeScorer | None:
    """The newest model of a role, ready for scoring; read it again at every batch to follow promotions."""
    found = active_model(spark, path, role)
    return TreeScorer(*found) if found else None


def save_linear(spark: SparkSession, model: LinearModel, path: str) -> None:
    spark.createDataFrame([(json.dumps(model.__dict__),)], "value string").coalesce(1).write.text(path)


def load_linear(spark: SparkSession, path: str) -> LinearModel:
    fields = json.loads(spark.read.text(path).first().value)
    return LinearModel(**{k: tuple(v) if isinstance(v, list) else v for k, v in fields.items()})


def retrain(spark: SparkSession, audit: DataFrame, labels: DataFrame, models: str, registry_path: str,
            version: str, at_ms: int, maturation_ms: int = 0, min_positives: int = MIN_POSITIVES,
            cap: int | None = SAMPLE_CAP, **training) -> dict:
    """One training run; skipped while there are too few confirmed fraud cases."""
    rows = pinned(training_set(audit, labels, F.lit(at_ms), maturation_ms, cap))
    size = rows.agg(F.count("*").alias("n"), F.sum("y").alias("pos")).first()
    n, pos = size.n, size.pos or 0
    if pos < min_positives:
        return {"skipped": True, "n": n, "pos": pos}
    model = train_trees(rows, **training)
    model.write().overwrite().save(f"{models}/{version}")
    register(spark, registry_path, version, "challenger", f"{models}/{version}", MODEL_FEATURES, n, pos, at_ms)
    return {"skipped": False, "n": n, "pos": pos, "version": version}


# --- learning curve --------------------------------------------------------------------------------

def rounds_upto(rows: DataFrame, last: int, with_warmup: bool = True) -> DataFrame:
    """Training rows through a round; round 0 is the warm-up."""
    return rows.filter((F.col("round") <= last) & (F.col("round") >= (0 if with_warmup else 1)))


def learning_curve(train: DataFrame, holdout: DataFrame, rounds: int, budget: float = 0.02, seed: int = 0,
                   with_warmup: bool = True, features: Sequence[str] = MODEL_FEATURES, **training) -> DataFrame:
    """Quality on one holdout per round, with the warm-up champion (round 0) and the blunt rule (-1)."""
    spark = train.sparkSession
    found = []
    for r in range(0, rounds + 1):
        rows = rounds_upto(train, r, with_warmup or r == 0)
        model = train_trees(rows.withColumnRenamed("label", "y"), features, seed=seed, **training)
        # every tree is asked once for each row; the metrics read the scores more than once
        scored = pinned(with_probability(model, holdout).select("score", *[c for c in ("label", "amount_base") if c in holdout.columns]))
        m = metrics_at_budget(scored, budget).first().asDict()
        fraud = rows.agg(F.sum("label")).first()[0]
        found.append((r, "champion" if r == 0 else "challenger", m["recall"], m["precision"], m["fpr"],
                      m["pr_auc"], m["roc_auc"], m["gbp_caught"], m["gbp_false_decline"], int(fraud or 0)))
    b = blunt_rule(holdout).first()
    found.append((-1, "blunt", b.recall, b.precision, b.fpr, None, None, b.gbp_caught, b.gbp_false_decline, None))
    return spark.createDataFrame(found, "round int, series string, recall double, precision double, fpr double, "
                                 "pr_auc double, roc_auc double, gbp_caught double, gbp_false_decline double, "
                                 "n_fraud long")
