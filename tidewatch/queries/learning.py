"""Labels, training sets, evaluation at a budget, confusion counters and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import labels as lab, quality, ranking, refjoin
from tidewatch.operators.rules import linear_probability
from tidewatch.plans import learning as learn
from tidewatch.queries.common import LISTS, PROFILES, SCORED, prior, txn_sql
from tidewatch.operators.signals import heavy_keys
from tidewatch.session import pinned, scratch
from tidewatch.sources.files import label_table
from tidewatch.sources.sinks import write_labels
from tidewatch.sources.tables import event_transactions, listed, payee_profiles, scored_events

QUERIES, ORACLE = {}, {}
NOW = 1_706_000_000_000          # in the events' last week
MATURES = 7 * 86_400_000


def register(name, run, sql=None):
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


# --- labels --------------------------------------------------------------------------------------

def raw_labels(spark, folder):
    """Labels of the events, some twice with a change of mind, from trusted and other sources."""
    e = scored_events(spark, folder)
    n = F.col("transaction_id").cast("bigint")
    source = (F.when(n % 4 == 0, "chargeback").when(n % 4 == 1, "manual_review").when(n % 4 == 2, "simulation")
              .otherwise("tip_line"))
    first = e.select("transaction_id", F.when(F.col("label") == 1, lab.FRAUD).when(n % 11 == 0, "disputed")
                     .otherwise(lab.LEGIT).alias("label"), source.alias("source"),
                     F.when(n % 13 != 0, F.col("ms") + 3_600_000).alias("labeled_at_ms"),
                     F.col("ms").alias("txn_ts_ms"), "receiver_account", "device_fingerprint")
    second = (first.filter(n % 5 == 0)
              .withColumns({"label": F.when(F.col("label") == lab.FRAUD, lab.LEGIT).otherwise(lab.FRAUD),
                            "labeled_at_ms": F.col("txn_ts_ms") + 7_200_000}))
    return lab.label_records(first.unionByName(second), F.lit(NOW))


RAW_LABELS = f"""{SCORED},
one AS (SELECT transaction_id, CAST(transaction_id AS BIGINT) AS n, CASE WHEN label = 1 THEN 'confirmed_fraud'
    WHEN CAST(transaction_id AS BIGINT) % 11 = 0 THEN 'disputed' ELSE 'confirmed_legit' END AS label,
    list_extract(['chargeback','manual_review','simulation','tip_line'],
      CAST(CAST(transaction_id AS BIGINT) % 4 + 1 AS INTEGER)) AS source,
    CASE WHEN CAST(transaction_id AS BIGINT) % 13 <> 0 THEN ms + 3600000 ELSE {NOW} END AS labeled_at_ms,
    ms AS txn_ts_ms, receiver_account, device_fingerprint FROM ev),
labels_all AS MATERIALIZED (SELECT * FROM one UNION ALL
  SELECT transaction_id, n, CASE WHEN label = 'confirmed_fraud' THEN 'confirmed_legit' ELSE 'confirmed_fraud' END,
    source, txn_ts_ms + 7200000, txn_ts_ms, receiver_account, device_fingerprint FROM one WHERE n % 5 = 0)"""
MATURED = f"""matured AS (SELECT * FROM labels_all WHERE (label = 'confirmed_fraud' AND labeled_at_ms <= {NOW})
    OR (label = 'confirmed_legit' AND txn_ts_ms + {MATURES} <= {NOW})),
latest AS (SELECT transaction_id, arg_max(label, (labeled_at_ms, label)) AS label FROM matured GROUP BY 1)"""

register("label_records", lambda spark, folder: raw_labels(spark, folder), f"""
WITH {RAW_LABELS} SELECT transaction_id, label, source, labeled_at_ms, txn_ts_ms, receiver_account,
  device_fingerprint FROM labels_all""")


def labels_round_trip(spark, folder):
    """Appended in two batches and read back with the fixed schema; an unwritten table reads as empty."""
    path = scratch(spark, "labels")
    empty = label_table(spark, path)
    whole = raw_labels(spark, folder)
    is_fraud = F.col("label") == lab.FRAUD
    write_labels(whole.filter(is_fraud), path)
    write_labels(whole.filter(~is_fraud), path)
    both = label_table(spark, path).unionByName(empty)
    return both.groupBy("label", "source").agg(F.count("*").alias("n"), F.max("labeled_at_ms").alias("latest"))


register("label_append_and_read", labels_round_trip, f"""
WITH {RAW_LABELS} SELECT label, source, count(*) AS n, max(labeled_at_ms) AS latest FROM labels_all GROUP BY 1, 2""")

register("matured_labels", lambda spark, folder: raw_labels(spark, folder)
         .filter(lab.is_matured(F.lit(NOW), MATURES)).select("transaction_id", "label", "labeled_at_ms"), f"""
WITH {RAW_LABELS}, {MATURED} SELECT transaction_id, label, labeled_at_ms FROM matured""")

register("latest_matured_label", lambda spark, folder: lab.latest_matured(
    raw_labels(spark, folder), F.lit(NOW), MATURES), f"""
WITH {RAW_LABELS}, {MATURED} SELECT * FROM latest""")

CANDIDATES = """cand AS (SELECT list_name, member, count(*) AS evidence, min(labeled_at_ms) AS since_ms FROM (
    SELECT 'bl_accounts' AS list_name, receiver_account AS member, labeled_at_ms FROM labels_all
      WHERE label = 'confirmed_fraud' AND source <> 'tip_line'
    UNION ALL SELECT 'bl_devices', device_fingerprint, labeled_at_ms FROM labels_all
      WHERE label = 'confirmed_fraud' AND source <> 'tip_line') WHERE member IS NOT NULL GROUP BY 1, 2)"""
register("block_candidates", lambda spark, folder: lab.block_candidates(raw_labels(spark, folder)),
         f"WITH {RAW_LABELS}, {CANDIDATES} SELECT * FROM cand")

register("strongest_block_entries", lambda spark, folder: lab.strongest(
    lab.block_candidates(raw_labels(spark, folder)), 20).select("list_name", "member", "evidence"), f"""
WITH {RAW_LABELS}, {CANDIDATES} SELECT list_name, member, evidence FROM cand
QUALIFY row_number() OVER (PARTITION BY list_name ORDER BY evidence DESC, member) <= 20""")

register("new_block_entries", lambda spark, folder: refjoin.new_entries(
    lab.block_candidates(raw_labels(spark, folder)), listed(spark, folder)).select("list_name", "member"), f"""
WITH {RAW_LABELS}, {CANDIDATES}, {LISTS}
SELECT list_name, member FROM cand c WHERE NOT EXISTS
  (SELECT 1 FROM entries e WHERE e.list_name = c.list_name AND e.member = c.member)""")

register("weak_label_sample", lambda spark, folder: lab.weak_labels(
    scored_events(spark, folder), seed=3, is_fraud=F.col("label") == 1).select("transaction_id", "label", "source"), f"""
WITH {SCORED}, d AS (SELECT *, CAST('0x' || substr(md5(transaction_id || ':3'), 1, 8) AS BIGINT)
  / 4294967296.0::DOUBLE AS draw FROM ev)
SELECT transaction_id, CASE WHEN label = 1 THEN 'confirmed_fraud' ELSE 'confirmed_legit' END AS label,
  CASE WHEN label = 1 THEN 'chargeback' ELSE 'manual_review' END AS source
FROM d WHERE draw < CASE WHEN label = 1 THEN 0.85 ELSE 0.05 END""")

# --- training sets -------------------------------------------------------------------------------

FEATURES = ("amount_base", "local_hour", "dormancy_days", "new_payee", "missing")


def snapshots(spark, folder):
    """Audit records whose snapshots hold numbers, number texts, booleans, other texts and gaps."""
    t = event_transactions(spark, folder)
    n = F.col("transaction_id").cast("bigint")
    return t.select("transaction_id", "customer_id", F.to_json(F.struct(
        F.round("amount", 2).alias("amount_base"), F.hour("ts").cast("string").alias("local_hour"),
        F.when(n % 3 == 0, "abc").when(n % 3 == 1, "2.5").alias("dormancy_days"),
        (n % 2 == 0).alias("new_payee"))).alias("feature_snapshot_json"))


_VECTOR = """round(t.amount, 2) AS amount_base, CAST(hour(t.ts) AS DOUBLE) AS local_hour,
  CASE WHEN CAST(t.transaction_id AS BIGINT) % 3 = 1 THEN 2.5::DOUBLE ELSE 0.0::DOUBLE END AS dormancy_days,
  0.0::DOUBLE AS new_payee, 0.0::DOUBLE AS missing"""
register("snapshot_to_features", lambda spark, folder: learn.snapshot_features(snapshots(spark, folder), FEATURES),
         f"WITH {txn_sql()} SELECT t.transaction_id, {_VECTOR} FROM txn t")

register("training_set", lambda spark, folder: learn.training_set(
    snapshots(spark, folder), raw_labels(spark, folder), F.lit(NOW), MATURES, features=FEATURES)
    .withColumn("y", F.col("y").cast("bigint")), f"""
WITH {txn_sql()}, {RAW_LABELS}, {MATURED}
SELECT t.transaction_id, {_VECTOR}, CAST(l.label = 'confirmed_fraud' AS BIGINT) AS y
FROM txn t JOIN latest l USING (transaction_id)""")

register("capped_training_set", lambda spark, folder: learn.training_set(
    snapshots(spark, folder), raw_labels(spark, folder), F.lit(NOW), MATURES, cap=100, features=FEATURES)
    .select("transaction_id", F.col("y").cast("bigint").alias("y")), f"""
WITH {RAW_LABELS}, {MATURED}
SELECT transaction_id, CAST(label = 'confirmed_fraud' AS BIGINT) AS y FROM latest
ORDER BY md5(transaction_id || ':42') LIMIT 100""")

register("fixed_size_sample", lambda spark, folder: ranking.fixed_sample(
    scored_events(spark, folder).select("transaction_id", "ms"), "transaction_id", 777, small=50), f"""
WITH {SCORED} SELECT transaction_id, ms FROM ev ORDER BY md5(transaction_id || ':42') LIMIT 777""")


def offline_set(spark, folder):
    t = event_transactions(spark, folder)
    rows = learn.offline_training_set(t, payee_profiles(spark, folder), listed(spark, folder), heavy_keys(t))
    return rows.withColumns({"amount_base": F.round("amount_base", 6), "y": F.col("y").cast("bigint")})


register("offline_training_set", offline_set, f"""
WITH {txn_sql()}, {PROFILES}, {LISTS},
f AS (SELECT t.*, (SELECT count(*) FROM txn p WHERE p.customer_id = t.customer_id AND {prior()}
      AND p.ms >= t.ms - 3600000) AS c1,
    (SELECT count(DISTINCT p.customer_id) FROM txn p WHERE p.receiver_account = t.receiver_account AND {prior()}
      AND p.ms >= t.ms - 86400000) AS c24,
    (SELECT count(*) FROM txn p WHERE p.customer_id = t.customer_id AND p.receiver_account = t.receiver_account
      AND {prior()}) AS pairs FROM txn t)
SELECT t.transaction_id, round(t.amount_base, 6) AS amount_base, CAST(hour(t.ts) AS DOUBLE) AS local_hour,
  CAST(c1 AS DOUBLE) AS customer_txn_count_1h, CAST(c24 AS DOUBLE) AS bene_distinct_senders_24h,
  CAST(pairs AS DOUBLE) AS pair_txn_count_90d,
  CASE WHEN b.beneficiary_country IS NOT NULL AND b.beneficiary_country <> t.customer_portfolio_country
    THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cross_border,
  CAST(coalesce(b.is_mule_pattern, false) OR c1 > 5
    OR EXISTS (SELECT 1 FROM entries e WHERE e.list_name = 'bl_accounts' AND e.member = t.receiver_account)
    OR EXISTS (SELECT 1 FROM entries e WHERE e.list_name = 'bl_devices' AND e.member = t.device_fingerprint)
    AS BIGINT) AS y
FROM f t LEFT JOIN payees b ON b.receiver_account = t.receiver_account""")

register("standardisation", lambda spark, folder: learn.standard_stats(
    scored_events(spark, folder).withColumn("flat", F.lit(3.0)), ["amount_base", "score", "flat"]).select(
    "feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")), f"""
WITH {SCORED}
SELECT 'amount_base' AS feature, round(avg(amount_base), 6) AS mean, round(stddev_pop(amount_base), 6) AS std FROM ev
UNION ALL SELECT 'score', round(avg(score), 6), round(stddev_pop(score), 6) FROM ev
UNION ALL SELECT 'flat', 3.0, 1.0""")

register("rounds_upto", lambda spark, folder: learn.rounds_upto(scored_events(spark, folder), 4, False)
         .select("transaction_id", F.col("round").cast("bigint").alias("round")),
         f"WITH {SCORED} SELECT transaction_id, CAST(round AS BIGINT) AS round FROM ev WHERE round BETWEEN 1 AND 4")

# --- evaluation ----------------------------------------------------------------------------------

RANKED = """
g AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM ev GROUP BY 1),
c AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS pos_below, coalesce(sum(neg) OVER w, 0) AS neg_below,
    sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g
  WINDOW w AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT sum(pos * (neg_below + neg / 2.0::DOUBLE)) / (max(p) * max(n)) AS roc_auc,
    sum(pos * ((p - pos_below) / CAST(p - pos_below + n - neg_below AS DOUBLE))) / max(p) AS pr_auc FROM c)"""

register("ranking_quality", lambda spark, folder: ranking.ranking_quality(scored_events(spark, folder)).select(
    F.round("roc_auc", 8).alias("roc_auc"), F.round("pr_auc", 8).alias("pr_auc"), "positives", "negatives"), f"""
WITH {SCORED}, {RANKED}
SELECT round(roc_auc, 8) AS roc_auc, round(pr_auc, 8) AS pr_auc, (SELECT CAST(sum(label) AS BIGINT) FROM ev) AS positives,
  (SELECT count(*) - CAST(sum(label) AS BIGINT) FROM ev) AS negatives FROM q""")


def budget_metrics(spark, folder):
    m = ranking.metrics_at_budget(scored_events(spark, folder).withColumn("score", F.col("amount_base") % 61), 0.02)
    return m.select(*[F.round(c, 6).alias(c) for c in (
        "recall", "precision", "fpr", "pr_auc", "roc_auc", "gbp_caught", "gbp_false_decline", "threshold")], "flagged")


register("metrics_at_budget", budget_metrics, f"""
WITH {SCORED.replace('ev AS MATERIALIZED', 'e0 AS')},
ev AS MATERIALIZED (SELECT * EXCLUDE (score), amount_base % 61 AS score FROM e0), {RANKED},
t AS (SELECT quantile_cont(score, 0.98) AS threshold FROM ev),
k AS (SELECT count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp,
    count(*) FILTER (score < threshold AND label = 1) AS fn, count(*) FILTER (score < threshold AND label = 0) AS tn,
    sum(amount_base) FILTER (score >= threshold AND label = 1) AS caught,
    sum(amount_base) FILTER (score >= threshold AND label = 0) AS lost, max(threshold) AS threshold FROM ev, t)
SELECT round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp), 6) AS precision, round(fp / (fp + tn), 6) AS fpr,
  round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc, round(coalesce(caught, 0), 6) AS gbp_caught,
  round(lost, 6) AS gbp_false_decline, round(threshold, 6) AS threshold, tp + fp AS flagged FROM k, q""")

register("top_share_by_score", lambda spark, folder: ranking.top_share(scored_events(spark, folder), 0.1)
         .select("transaction_id", "score"), f"""
WITH {SCORED} SELECT transaction_id, score FROM ev WHERE score >= (SELECT quantile_cont(score, 0.9) FROM ev)""")

register("total_order_rank", lambda spark, folder: ranking.ranks(
    scored_events(spark, folder).select("transaction_id", "score"), ["score", "transaction_id"]), f"""
WITH {SCORED} SELECT transaction_id, score, row_number() OVER (ORDER BY score, transaction_id) AS rank FROM ev""")

register("score_threshold", lambda spark, folder: scored_events(spark, folder).select(
    "transaction_id", quality.decision_at(F.col("score"), 0.8).alias("decision")), f"""
WITH {SCORED} SELECT transaction_id, CASE WHEN score >= 0.8 THEN 'decline' ELSE 'approve' END AS decision FROM ev""")


def decided(spark, folder):
    e = scored_events(spark, folder)
    return refjoin.per_version(e, {
        "rules-v0": F.when(F.col("device_distinct_customers") > 2, "decline").otherwise("review"),
        "fb-model": quality.decision_at(F.col("score"), 0.8)})


DECIDED = f"""{SCORED},
dec AS (SELECT *, 'rules-v0' AS model_version,
    CASE WHEN device_distinct_customers > 2 THEN 'decline' ELSE 'review' END AS decision FROM ev
  UNION ALL SELECT *, 'fb-model', CASE WHEN score >= 0.8 THEN 'decline' ELSE 'approve' END FROM ev)"""


def _cells() -> str:
    def n(d, y):
        return f"count(*) FILTER (decision {d} 'decline' AND label = {y})"
    return (f"{n('=', 1)} AS tp, {n('=', 0)} AS fp, {n('<>', 1)} AS fn, {n('<>', 0)} AS tn, "
            "round(coalesce(sum(amount_base) FILTER (decision = 'decline' AND label = 1), 0), 4) AS gbp_caught, "
            "round(coalesce(sum(amount_base) FILTER (decision = 'decline' AND label = 0), 0), 4) AS gbp_false_decline")


RATES = """CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0 END AS recall,
  CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0 END AS precision,
  CASE WHEN fp + tn > 0 THEN round(fp / (fp + tn), 6) ELSE 0 END AS fpr"""


def _pretty(df, *keys):
    names = [c for c in df.columns if c not in keys]
    types = dict(df.dtypes)
    return df.select(*keys, *[F.round(c, 6 if c in ("recall", "precision", "fpr") else 4).alias(c)
                              if types[c] == "double" else F.col(c) for c in names])


register("confusion_by_version", lambda spark, folder: _pretty(quality.with_rates(
    quality.confusion(decided(spark, folder), ["model_version"])), "model_version"), f"""
WITH {DECIDED}, k AS (SELECT model_version, {_cells()} FROM dec GROUP BY 1) SELECT *, {RATES} FROM k""")

register("confusion_counters_2s", lambda spark, folder: _pretty(quality.counters(decided(spark, folder)),
                                                                "model_version", "bucket"), f"""
WITH {DECIDED} SELECT model_version, ms // 2000 AS bucket, {_cells()} FROM dec GROUP BY 1, 2""")

register("rolling_confusion_20s", lambda spark, folder: _pretty(quality.rolling(quality.counters(decided(
    spark, folder))), "model_version", "bucket"), f"""
WITH {DECIDED},
x AS (SELECT *, unnest(generate_series(ms // 2000, ms // 2000 + 9)) AS bucket FROM dec),
k AS (SELECT model_version, bucket, {_cells()} FROM x GROUP BY 1, 2) SELECT *, {RATES} FROM k""")


def metrics_frame(spark, folder):
    d = decided(spark, folder)
    at = d.agg(F.max("ms")).first()[0]
    out = quality.frame(quality.counters(d, 60_000), d, "rules-v0", "fb-model", F.lit(at), at - 5, 60_000, 86_400_000)
    return out.select(
        "ts", "window_sec", "feedback_ts", "active", "champion_version", "challenger_version", "instances", "tps",
        *[F.round(f"{s}_{r}", 6).alias(f"{s}_{r}") for s in ("champion", "challenger")
          for r in ("recall", "precision", "fpr")],
        F.round("gbp_caught", 4).alias("gbp_caught"), F.round("gbp_false_decline", 4).alias("gbp_false_decline"))


register("metrics_frame", metrics_frame, f"""
WITH {DECIDED}, edge AS (SELECT max(ms) AS ts FROM ev),
k AS (SELECT model_version, {_cells()} FROM dec, edge WHERE ms // 60000 > ts // 60000 - 1440 GROUP BY 1),
r AS (SELECT *, {RATES} FROM k)
SELECT ts, CAST(86400 AS BIGINT) AS window_sec, ts - 5 AS feedback_ts, true AS active, 'rules-v0' AS champion_version,
  'fb-model' AS challenger_version, (SELECT count(DISTINCT producer) FROM ev) AS instances,
  round((a.tp + a.fp + a.fn + a.tn + b.tp + b.fp + b.fn + b.tn) / 86400.0::DOUBLE, 1) AS tps,
  a.recall AS champion_recall, a.precision AS champion_precision, a.fpr AS champion_fpr,
  b.recall AS challenger_recall, b.precision AS challenger_precision, b.fpr AS challenger_fpr,
  b.gbp_caught, b.gbp_false_decline
FROM edge, r a, r b WHERE a.model_version = 'rules-v0' AND b.model_version = 'fb-model'""")

register("blunt_rule", lambda spark, folder: _pretty(quality.blunt_rule(scored_events(spark, folder))), f"""
WITH {SCORED}, dec AS (SELECT *, CASE WHEN device_distinct_customers > 2 THEN 'decline' ELSE 'approve' END AS decision
  FROM ev), k AS (SELECT {_cells()} FROM dec)
SELECT {RATES}, gbp_caught, gbp_false_decline, tp + fp AS flagged FROM k""")

register("decision_label_join", lambda spark, folder: decided(spark, folder).drop("label").join(
    lab.latest_matured(raw_labels(spark, folder), F.lit(NOW), MATURES), "transaction_id").groupBy(
    "model_version", quality.cell(F.col("decision"), (F.col("label") == lab.FRAUD).cast("int")).alias("cell")).agg(
    F.count("*").alias("n")), f"""
WITH {RAW_LABELS}, {MATURED},
dec AS (SELECT transaction_id, 'rules-v0' AS model_version, device_distinct_customers > 2 AS d FROM ev
  UNION ALL SELECT transaction_id, 'fb-model', score >= 0.8 FROM ev)
SELECT model_version, CASE WHEN d AND l.label = 'confirmed_fraud' THEN 'tp' WHEN d THEN 'fp'
  WHEN l.label = 'confirmed_fraud' THEN 'fn' ELSE 'tn' END AS cell, count(*) AS n
FROM dec JOIN latest l USING (transaction_id) GROUP BY 1, 2""")


def data_checks(spark, folder):
    e = scored_events(spark, folder).withColumns({
        "kind": F.when(F.col("label") == 1, "fraud").when(F.col("round") == 3, "lookalike").otherwise("legit"),
        "flat": F.lit(1.0)})
    out = quality.expectations(e, ["amount_base", "score", "flat"])
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


register("dataset_expectations", data_checks, f"""
WITH {SCORED},
st AS (SELECT avg(amount_base) AS ma, stddev_pop(amount_base) AS sa, avg(score) AS ms_, stddev_pop(score) AS ss FROM ev),
j AS (SELECT label, (amount_base - ma) / sa + (score - ms_) / ss AS joint, device_distinct_customers AS blunt, round
  FROM ev, st),
a AS (SELECT joint, blunt, label, rank() OVER (ORDER BY joint) + (count(*) OVER (PARTITION BY joint) - 1) / 2.0 AS rj,
    rank() OVER (ORDER BY blunt) + (count(*) OVER (PARTITION BY blunt) - 1) / 2.0 AS rb FROM j),
u AS (SELECT sum(label) AS p, count(*) - sum(label) AS n, sum(rj) FILTER (label = 1) AS sj, sum(rb) FILTER (label = 1) AS sb
  FROM a),
k AS (SELECT avg(CAST(label AS DOUBLE)) AS fraud_rate,
    count(*) FILTER (blunt > 2 AND label = 1) / count(*) FILTER (blunt > 2) AS blunt_rule_precision,
    count(*) FILTER (blunt > 2 AND label = 1) / count(*) FILTER (label = 1) AS blunt_rule_recall,
    count(*) FILTER (label = 0 AND round = 3) / count(*) FILTER (label = 0) AS lookalike_frac_of_legit FROM j),
v AS (SELECT k.*, (sj - p * (p + 1) / 2.0) / (p * n) AS joint_auc, (sb - p * (p + 1) / 2.0) / (p * n) AS blunt_only_auc
  FROM k, u),
b AS (SELECT *, fraud_rate BETWEEN 0.003 AND 0.03 AS imbalance_realistic, joint_auc BETWEEN 0.8 AND 0.985 AS joint_learnable,
  joint_auc - blunt_only_auc > 0.08 AS joint_beats_blunt, blunt_rule_precision < 0.5 AS blunt_rule_imprecise,
  blunt_rule_recall < 0.85 AS blunt_rule_incomplete, lookalike_frac_of_legit > 0.02 AS lookalikes_exist FROM v)
SELECT round(fraud_rate, 6) AS fraud_rate, round(blunt_rule_precision, 6) AS blunt_rule_precision,
  round(blunt_rule_recall, 6) AS blunt_rule_recall, round(lookalike_frac_of_legit, 6) AS lookalike_frac_of_legit,
  round(joint_auc, 6) AS joint_auc, round(blunt_only_auc, 6) AS blunt_only_auc, imbalance_realistic, joint_learnable,
  joint_beats_blunt, blunt_rule_imprecise, blunt_rule_incomplete, lookalikes_exist, imbalance_realistic AND joint_learnable
  AND joint_beats_blunt AND blunt_rule_imprecise AND blunt_rule_incomplete AND lookalikes_exist AS ok FROM b""")

# --- models (no SQL form) ------------------------------------------------------------------------

MODEL_INPUTS = ("amount_base", "score", "device_distinct_customers")


def with_numbers(df):
    return df.withColumns({c: F.col(c).cast("double") for c in MODEL_INPUTS})


def logistic_scores(spark, folder):
    e = with_numbers(scored_events(spark, folder))
    model = learn.train_linear(e, MODEL_INPUTS, "logreg-events", "label")
    return e.select("transaction_id", linear_probability(model).alias("probability"))


register("logistic_training_and_score", logistic_scores)


def tree_round(spark, folder):
    """Retrain from snapshots and labels, register, promote, and score with the champion read back."""
    at = NOW
    audit, labels = snapshots(spark, folder), raw_labels(spark, folder)
    models, reg = scratch(spark, "models"), scratch(spark, "registry")
    rows = pinned(learn.training_set(audit, labels, F.lit(at), MATURES, features=FEATURES))
    size = rows.agg(F.count("*").alias("n"), F.sum("y").alias("pos")).first()
    model = learn.train_trees(rows, FEATURES, trees=5, depth=3)
    model.write().overwrite().save(f"{models}/m1")
    learn.register(spark, reg, "m1", "challenger", f"{models}/m1", FEATURES, size.n, size.pos, at)
    learn.promote(spark, reg, "m1")
    version, champion = learn.active_model(spark, reg)
    return (learn.with_probability(champion, rows).withColumn("version", F.lit(version))
            .select("transaction_id", "score", "version"))


register("boosted_tree_retrain_and_promote", tree_round)


def curve(spark, folder):
    e = with_numbers(scored_events(spark, folder))
    holdout = e.filter(F.col("round") >= 4)
    return learn.learning_curve(e.filter(F.col("round") < 4), holdout, 3, 0.1, features=MODEL_INPUTS, trees=5, depth=2)


register("learning_curve", curve)
