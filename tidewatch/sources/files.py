"""JSON and Parquet readers for master data, requests, events and the audit table."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidewatch import schemas
from tidewatch.functions.times import utc_date
from tidewatch.functions.values import to_base


def json_array(spark: SparkSession, path: str, schema) -> DataFrame:
    """Files that each hold one JSON array; master data only, since such a file cannot be split."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def customers(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, schemas.CUSTOMER)


def payees(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, schemas.PAYEE).withColumnRenamed("country", "beneficiary_country")


def tpps(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, schemas.TPP)


def member_lists(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A document of string arrays as rows (list_name, member, valid_from)."""
    doc = json_array(spark, path, T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in names]))
    entries = F.array(*[F.struct(F.lit(n).alias("list_name"), F.col(n).alias("members")) for n in names])
    return (doc.select(F.inline(entries)).select("list_name", F.explode("members").alias("member"))
            .withColumn("valid_from", F.lit(None).cast("timestamp")))


def ip_networks(spark: SparkSession, path: str) -> DataFrame:
    doc = json_array(spark, path, "prefixes map<string, string>")
    return doc.select(F.explode("prefixes").alias("ip_prefix", "country"))


def proxy_addresses(spark: SparkSession, path: str) -> DataFrame:
    return member_lists(spark, path, ["proxy_ips"])


def as_transactions(requests: DataFrame) -> DataFrame:
    """Request columns as transaction columns."""
    return requests.withColumnRenamed("timestamp", "ts").withColumns({
        "ms": F.unix_millis("ts"), "amount_base": to_base(F.col("amount"), F.col("currency")),
        "declined": F.lit(0), "event_kind": F.lit("payment")})


def transactions(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited JSON requests; blank lines are skipped by the reader."""
    return as_transactions(spark.read.schema(schemas.REQUEST).json(path))


def sample_requests(spark: SparkSession, path: str) -> DataFrame:
    doc = json_array(spark, path, schemas.SAMPLE)
    return as_transactions(doc.select("label", "expected_decision", "request.*"))


def decode_events(body: DataFrame, column: str = "value") -> DataFrame:
    """Event text to the audit record. The record may sit under `v` as text or be the body itself."""
    inner = F.get_json_object(column, "$.v")
    record = F.from_json(F.coalesce(inner, F.col(column)), schemas.SCORED)
    flat = body.select(record.alias("r")).select("r.*")
    return with_partition_date(flat.withColumn(
        "rules_fired", F.coalesce("rules_fired", F.array().cast("array<string>"))))


def with_partition_date(records: DataFrame) -> DataFrame:
    date = F.date_format(utc_date(F.col("timestamp_epoch_ms")), "yyyy-MM-dd")
    return records.withColumn("dt", F.coalesce(date, F.lit("unknown")))


def audit_record(scored: DataFrame, snapshot: list[str]) -> DataFrame:
    """Scored rows as audit records; the snapshot is exactly what the decision saw."""
    return with_partition_date(scored.select(
        "transaction_id", "customer_id", "receiver_account", "decision", "model_version", "final_score",
        "model_score", "amount", "amount_base", "currency", "customer_portfolio_country",
        F.col("ms").alias("timestamp_epoch_ms"), "device_fingerprint", "tpp_name_ud", "rules_fired",
        F.to_json(F.struct(*snapshot)).alias("feature_snapshot_json")))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at `path`, on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(
        jvm.org.apache.hadoop.fs.Path(posixpath.join(path, "*")))
    return found is not None and len(found) > 0


def read_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table with a fixed schema; a table nobody has written yet is empty, not an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def audit_table(spark: SparkSession, path: str) -> DataFrame:
    return read_parquet(spark, path, schemas.AUDIT).select(*schemas.AUDIT.fieldNames())


def label_table(spark: SparkSession, path: str) -> DataFrame:
    return read_parquet(spark, path, schemas.LABEL)


def simulated(spark: SparkSession, path: str) -> DataFrame:
    """Simulated rounds with the features, ids, kind and round of each row."""
    return read_parquet(spark, path, schemas.SIMULATED).select(*schemas.SIMULATED.fieldNames())
