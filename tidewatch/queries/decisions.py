"""Rules, bands, the blended decision and the full scoring plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.config import LINEAR_MODEL, RULES, Config
from tidewatch.operators import aggregates as agg
from tidewatch.operators.rules import band, linear_probability
from tidewatch.operators.signals import heavy_keys
from tidewatch.plans.scoring import Reference, decide, degrade, score
from tidewatch.queries import basics, history
from tidewatch.queries.common import SCORED, txn_sql
from tidewatch.sources.files import audit_record, audit_table, decode_events
from tidewatch.sources.sinks import write_audit
from tidewatch.session import scratch
from tidewatch.sources.tables import (customer_profiles, event_transactions, ip_countries, listed, payee_profiles,
                                      scored_events)

QUERIES, ORACLE = {}, {}


def register(name, run, sql=None):
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


def reference(spark, folder) -> Reference:
    return Reference(customer_profiles(spark, folder), payee_profiles(spark, folder),
                     ip_countries(spark, folder), listed(spark, folder))


def scored(spark, folder, model=LINEAR_MODEL):
    txns = event_transactions(spark, folder)
    return score(txns, reference(spark, folder), Config(), model, heavy_keys(txns))


# --- the rule conditions once more, as plain SQL over a feature table ------------------------------

CONDITIONS = {
    "R001_blacklisted_beneficiary": "bl_account", "R002_blacklisted_device": "bl_device",
    "R003_vip_low_amount_fast_track": "vip_customer AND amount_base < 500",
    "R004_velocity_burst": "customer_txn_count_1h > 5", "R005_mule_fan_in": "bene_distinct_senders_24h > 10",
    "R006_new_payee_high_amount": "pair_txn_count_90d = 0 AND amount_base > 1000",
    "R007_cross_border_off_hours": "customer_portfolio_country IS DISTINCT FROM beneficiary_country "
                                   "AND local_hour BETWEEN 0 AND 4",
    "R008_watchlist_customer": "watchlist", "R009_device_sharing": "device_distinct_customers > 2",
    "R010_ip_geo_anomaly": "ip_country IS DISTINCT FROM customer_portfolio_country OR ip_proxy",
    "R011_new_account_high_amount": "account_age_days < 30 AND amount_base > 1000",
    "R012_repeat_declines_90d": "customer_declines_90d >= 3",
    "R013_beneficiary_fanout_90d": "customer_distinct_bene_90d > 15",
    "R014_repeat_declines_24h": "customer_declines_24h >= 3",
    "R015_beneficiary_fanout_24h": "customer_distinct_bene_24h > 8",
    "R016_mule_fan_in_90d": "bene_distinct_senders_90d > 30",
    "R017_velocity_burst_5m": "customer_txn_rate_5m > 5", "R018_amount_anomaly_90d": "amount_zscore_90d > 3",
    "R019_velocity_spike_vs_baseline": "velocity_ratio_1h > 8",
    "R020_sustained_elevation": "velocity_elevated_hours >= 4", "R021_offhour_activity": "hod_share_now < 0.01",
    "R022_machine_cadence": "interarrival_cv < 0.15", "R023_amount_bustout": "amount_trend > 0.15",
    "R024_dormant_reactivation": "dormancy_days > 60", "R025_device_surge": "device_surge > 5",
    "R026_bene_inbound_surge": "bene_surge > 5",
}
_FIRED = "concat_ws(',', " + ", ".join(
    f"CASE WHEN coalesce({c}, false) THEN '{name}' END" for name, c in CONDITIONS.items()) + ")"
_SOFT = " + ".join(f"CASE WHEN coalesce({CONDITIONS[r.rule_id]}, false) THEN {r.weight}::DOUBLE ELSE 0 END"
                   for r in RULES if r.type == "soft")
_Z = f"{LINEAR_MODEL.intercept!r}::DOUBLE" + "".join(
    f" + ({w!r}::DOUBLE) * ((coalesce({n}, 0) - ({m!r}::DOUBLE)) / ({s!r}::DOUBLE))"
    for n, m, s, w in zip(LINEAR_MODEL.feature_order, LINEAR_MODEL.means, LINEAR_MODEL.stds, LINEAR_MODEL.weights))


def decided_sql(features: str, model: bool, degraded: str = "false") -> str:
    p = f"1.0::DOUBLE / (1.0::DOUBLE + exp(-({_Z})))" if model else "CAST(NULL AS DOUBLE)"
    version = LINEAR_MODEL.version if model else "rules-v1"
    return f"""
ruled AS (SELECT *, {_FIRED} AS rules_fired, coalesce(bl_account, false) OR coalesce(bl_device, false) AS hard_block,
    coalesce(vip_customer AND amount_base < 500, false) AS hard_allow, {_SOFT} AS soft_score,
    {degraded} AS degraded, {p} AS p FROM {features}),
blended AS (SELECT *, CASE WHEN hard_block OR hard_allow OR degraded THEN NULL ELSE p END AS model_score,
    CASE WHEN hard_block THEN 1.0 WHEN hard_allow THEN 0.0 WHEN degraded THEN 0.5
      ELSE greatest(least(1.0, soft_score), coalesce(p, 0)) END AS final_score FROM ruled),
decided AS (SELECT *, CASE WHEN hard_block THEN 'decline' WHEN hard_allow THEN 'approve' WHEN degraded THEN 'review'
      WHEN final_score >= 0.7 THEN 'decline' WHEN final_score >= 0.3 THEN 'review' ELSE 'approve' END AS decision,
    CASE WHEN NOT hard_block AND NOT hard_allow AND degraded THEN '{version}-degraded' ELSE '{version}' END
      AS model_version FROM blended)"""


OUT = ["transaction_id", "decision", "model_version"]
OUT_SQL = """transaction_id, decision, model_version, round(final_score, 6) AS final_score,
  round(model_score, 6) AS model_score, rules_fired"""


def outcome(df):
    return df.select(*OUT, F.round("final_score", 6).alias("final_score"),
                     F.round("model_score", 6).alias("model_score"),
                     F.concat_ws(",", "rules_fired").alias("rules_fired"))


def made_features(t):
    """A wide spread of feature values from each transaction's own fields, to reach every rule."""
    n = F.col("transaction_id").cast("bigint")

    def mod(k, div=1):
        return F.floor(n / div) % k
    return t.select(
        "transaction_id", (F.col("amount_base") * 12).alias("amount_base"), "customer_portfolio_country",
        F.when(mod(4) != 0, F.lit("GB")).alias("beneficiary_country"), F.hour("ts").alias("local_hour"),
        F.when(mod(3) != 0, F.lit("US")).otherwise(F.col("customer_portfolio_country")).alias("ip_country"),
        (mod(17) == 0).alias("ip_proxy"), (mod(23) == 0).alias("vip_customer"), (mod(29) == 0).alias("watchlist"),
        (mod(41) == 0).alias("bl_account"), (mod(43) == 0).alias("bl_device"),
        F.when(mod(7) != 0, mod(90)).alias("account_age_days"),
        mod(9).alias("customer_txn_count_1h"), mod(13, 3).alias("bene_distinct_senders_24h"),
        mod(3, 5).alias("pair_txn_count_90d"), mod(4, 7).alias("device_distinct_customers"),
        mod(5, 11).alias("customer_declines_90d"), mod(20, 2).alias("customer_distinct_bene_90d"),
        mod(6, 13).alias("customer_declines_24h"), mod(11, 4).alias("customer_distinct_bene_24h"),
        mod(40, 6).alias("bene_distinct_senders_90d"), mod(8, 17).alias("customer_txn_rate_5m"),
        (mod(50, 19) / 10).alias("amount_zscore_90d"), (mod(100, 23) / 10).alias("velocity_ratio_1h"),
        mod(6, 29).alias("velocity_elevated_hours"), (mod(100, 31) / 100).alias("hod_share_now"),
        (mod(90, 37) / 100).alias("interarrival_cv"), (mod(40, 41) / 100).alias("amount_trend"),
        (mod(80, 43) * 1.0).alias("dormancy_days"), (mod(70, 47) / 10).alias("device_surge"),
        (mod(70, 53) / 10).alias("bene_surge"), (mod(2) * 1.0).alias("cross_border"),
        (mod(37) != 0).alias("feature_ok"))


def _m(k, div=1):
    return f"((n // {div}) % {k})"


MADE_SQL = f"""
src AS (SELECT *, CAST(transaction_id AS BIGINT) AS n FROM txn),
made AS (SELECT transaction_id, amount_base * 12 AS amount_base, customer_portfolio_country,
  CASE WHEN {_m(4)} <> 0 THEN 'GB' END AS beneficiary_country, hour(ts) AS local_hour,
  CASE WHEN {_m(3)} <> 0 THEN 'US' ELSE customer_portfolio_country END AS ip_country,
  {_m(17)} = 0 AS ip_proxy, {_m(23)} = 0 AS vip_customer, {_m(29)} = 0 AS watchlist, {_m(41)} = 0 AS bl_account,
  {_m(43)} = 0 AS bl_device, CASE WHEN {_m(7)} <> 0 THEN {_m(90)} END AS account_age_days,
  {_m(9)} AS customer_txn_count_1h, {_m(13, 3)} AS bene_distinct_senders_24h, {_m(3, 5)} AS pair_txn_count_90d,
  {_m(4, 7)} AS device_distinct_customers, {_m(5, 11)} AS customer_declines_90d,
  {_m(20, 2)} AS customer_distinct_bene_90d, {_m(6, 13)} AS customer_declines_24h,
  {_m(11, 4)} AS customer_distinct_bene_24h, {_m(40, 6)} AS bene_distinct_senders_90d,
  {_m(8, 17)} AS customer_txn_rate_5m, {_m(50, 19)} / 10.0::DOUBLE AS amount_zscore_90d,
  {_m(100, 23)} / 10.0::DOUBLE AS velocity_ratio_1h, {_m(6, 29)} AS velocity_elevated_hours,
  {_m(100, 31)} / 100.0::DOUBLE AS hod_share_now, {_m(90, 37)} / 100.0::DOUBLE AS interarrival_cv,
  {_m(40, 41)} / 100.0::DOUBLE AS amount_trend, {_m(80, 43)} * 1.0::DOUBLE AS dormancy_days,
  {_m(70, 47)} / 10.0::DOUBLE AS device_surge, {_m(70, 53)} / 10.0::DOUBLE AS bene_surge,
  {_m(2)} * 1.0::DOUBLE AS cross_border, {_m(37)} <> 0 AS feature_ok FROM src)"""

register("rules_and_decision", lambda spark, folder: outcome(decide(made_features(event_transactions(spark, folder)))),
         f"WITH {txn_sql()}, {MADE_SQL}, {decided_sql('made', False)} SELECT {OUT_SQL} FROM decided")
register("model_blend", lambda spark, folder: outcome(decide(
    made_features(event_transactions(spark, folder)), model=LINEAR_MODEL)),
    f"WITH {txn_sql()}, {MADE_SQL}, {decided_sql('made', True)} SELECT {OUT_SQL} FROM decided")


def degraded_routing(spark, folder):
    rows = made_features(event_transactions(spark, folder))
    signal_ok = F.col("dormancy_days") < 70
    rows = degrade(rows, Config(), F.col("feature_ok"), signal_ok)
    return outcome(decide(rows, feature_ok=F.col("feature_ok"))).join(
        rows.select("transaction_id", "signal_degraded"), "transaction_id")


_PLAIN = ["amount_base", "beneficiary_country", "local_hour", "account_age_days", "ip_country", "ip_proxy",
          "vip_customer", "watchlist", "bl_account", "bl_device", "device_distinct_customers",
          "customer_txn_count_1h", "bene_distinct_senders_24h", "pair_txn_count_90d"]
_SIGNALS = {"customer_declines_24h": "0", "customer_distinct_bene_24h": "0", "customer_declines_90d": "0",
            "customer_distinct_bene_90d": "0", "bene_distinct_senders_90d": "0", "amount_zscore_90d": "0.0",
            "customer_txn_rate_5m": "0", "velocity_ratio_1h": "0.0", "velocity_elevated_hours": "0",
            "hod_share_now": "1.0", "interarrival_cv": "999.0", "amount_trend": "0.0", "dormancy_days": "0.0",
            "device_surge": "0.0", "bene_surge": "0.0"}
register("degraded_routing", degraded_routing, f"""
WITH {txn_sql()}, {MADE_SQL},
worn AS (SELECT transaction_id, customer_portfolio_country, feature_ok, dormancy_days >= 70 AS signal_degraded,
  {', '.join(f'CASE WHEN feature_ok THEN {c} END AS {c}' for c in _PLAIN)},
  {', '.join(f'CASE WHEN dormancy_days < 70 THEN {c} ELSE {v} END AS {c}' for c, v in _SIGNALS.items())} FROM made),
{decided_sql('worn', False, 'NOT feature_ok')} SELECT {OUT_SQL}, signal_degraded FROM decided""")

register("linear_model_score", lambda spark, folder: made_features(event_transactions(spark, folder)).select(
    "transaction_id", F.round(linear_probability(LINEAR_MODEL), 8).alias("model_score")), f"""
WITH {txn_sql()}, {MADE_SQL}
SELECT transaction_id, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-({_Z}))), 8) AS model_score FROM made""")

register("score_bands", lambda spark, folder: scored_events(spark, folder).select(
    "transaction_id", band(F.col("score")).alias("band")), f"""
WITH {SCORED}
SELECT transaction_id, CASE WHEN score >= 0.7 THEN 'decline' WHEN score >= 0.3 THEN 'review' ELSE 'approve' END AS band
FROM ev""")

# --- the full plan -------------------------------------------------------------------------------


def _piece(name: str, *swaps: tuple[str, str]) -> str:
    source = basics.ORACLE.get(name) or history.ORACLE[name]
    for fold in (dict(customers=history.BUSY), dict(devices=history.SHARED)):
        source = source.replace(txn_sql(**fold), txn_sql())
    for old, new in swaps:
        source = source.replace(old, new)
    return f"({source})"


PIECES = [
    _piece("customer_txn_count_1h"), _piece("payee_distinct_senders"), _piece("customer_distinct_payees"),
    _piece("device_distinct_customers"), _piece("pair_state"), _piece("customer_declines"),
    _piece("amount_zscore_90d"), _piece("txn_rates"), _piece("velocity_baseline"),
    _piece("amount_trend", ("n >= 3", "n >= 4")), _piece("dormancy_days"), _piece("interarrival_cv"),
    _piece("device_surge"), _piece("payee_surge", ("filled >= 2", "filled >= 12")),
    _piece("reference_fields"), _piece("dated_membership_flags"),
]
FULL_SQL = f"""features AS (SELECT * FROM (SELECT transaction_id, amount_base, customer_portfolio_country,
    hour(ts) AS local_hour FROM txn) {' '.join(f'JOIN {p} USING (transaction_id)' for p in PIECES)}),
{decided_sql('features', True)}"""

register("score_events", lambda spark, folder: outcome(scored(spark, folder)),
         f"WITH {txn_sql()}, {FULL_SQL} SELECT {OUT_SQL} FROM decided")

register("decision_mix", lambda spark, folder: agg.decision_mix(scored(spark, folder)), f"""
WITH {txn_sql()}, {FULL_SQL}
SELECT count(*) AS total, count(*) FILTER (decision = 'approve') AS approve, count(*) FILTER (decision = 'review') AS review,
  count(*) FILTER (decision = 'decline') AS decline, count(*) FILTER (degraded) AS degraded,
  count(*) FILTER (decision = 'approve') AS pass, count(*) FILTER (decision <> 'approve') AS fail FROM decided""")


def fired_counts(spark, folder):
    return agg.rule_counts(decide(made_features(event_transactions(spark, folder))))


register("rule_fire_counts", fired_counts, f"""
WITH {txn_sql()}, {MADE_SQL}, {decided_sql('made', False)},
x AS (SELECT unnest(string_split(rules_fired, ',')) AS rule_id FROM decided)
SELECT rule_id, count(*) AS fired FROM x WHERE rule_id <> '' GROUP BY 1""")


def sample_scoreboard(spark, folder):
    t = event_transactions(spark, folder)
    done = decide(made_features(t))
    expected = t.select("transaction_id", F.when(F.col("declined") == 1, "decline").otherwise("review")
                        .alias("expected_decision"))
    return agg.scoreboard(done, expected)


register("expected_decision_scoreboard", sample_scoreboard, f"""
WITH {txn_sql()}, {MADE_SQL}, {decided_sql('made', False)}
SELECT count(*) AS total, count(*) FILTER (d.decision = CASE WHEN t.declined = 1 THEN 'decline' ELSE 'review' END) AS passed
FROM txn t JOIN decided d USING (transaction_id)""")

# --- audit records -------------------------------------------------------------------------------

SNAPSHOT = ["velocity_ratio_1h", "customer_txn_rate_5m", "dormancy_days", "ip_proxy", "beneficiary_country"]


def audited(spark, folder):
    t = event_transactions(spark, folder)
    rows = decide(made_features(t).drop("amount_base", "customer_portfolio_country")
                  .join(t, "transaction_id"))
    return audit_record(rows, SNAPSHOT)


def emitted(spark, folder):
    return audited(spark, folder).select("transaction_id", "timestamp_epoch_ms", "dt", "decision",
                                         F.get_json_object("feature_snapshot_json", "$.dormancy_days")
                                         .cast("double").alias("dormancy_days"),
                                         F.get_json_object("feature_snapshot_json", "$.beneficiary_country")
                                         .alias("beneficiary_country"))


_AUDIT_SQL = f"""
WITH {txn_sql()}, {MADE_SQL},
plain AS (SELECT m.* EXCLUDE (amount_base), t.amount_base FROM made m JOIN txn t USING (transaction_id)),
{decided_sql('plain', False)}"""
register("emit_scored_transactions", emitted, f"""{_AUDIT_SQL}
SELECT d.transaction_id, t.ms AS timestamp_epoch_ms, strftime(t.ts, '%Y-%m-%d') AS dt, d.decision, d.dormancy_days,
  d.beneficiary_country FROM decided d JOIN txn t USING (transaction_id)""")


def audit_round_trip(spark, folder):
    """Written by day, read back with the partition and two columns only."""
    path = scratch(spark, "audit")
    write_audit(audited(spark, folder), path)
    return (audit_table(spark, path).filter(F.col("dt").between("2024-01-10", "2024-01-12"))
            .select("transaction_id", "decision", "dt"))


register("audit_write_and_pruned_read", audit_round_trip, f"""{_AUDIT_SQL}
SELECT d.transaction_id, d.decision, strftime(t.ts, '%Y-%m-%d') AS dt FROM decided d JOIN txn t USING (transaction_id)
WHERE t.ts >= TIMESTAMP '2024-01-10' AND t.ts < TIMESTAMP '2024-01-13'""")


def event_decode(spark, folder):
    """Half of the bodies are wrapped under `v`, some lack the time or the fired rules."""
    t = event_transactions(spark, folder)
    n = F.col("transaction_id").cast("bigint")
    record = F.to_json(F.struct(
        "transaction_id", "customer_id", "amount", F.when(n % 7 != 0, F.col("ms")).alias("timestamp_epoch_ms"),
        F.when(n % 3 != 0, F.array(F.lit("R1"), F.lit("R2"))).alias("rules_fired")))
    body = t.select(F.when(n % 2 == 0, record).otherwise(F.to_json(F.struct(record.alias("v")))).alias("value"))
    out = decode_events(body)
    return out.select("transaction_id", "customer_id", "amount", "dt", "decision",
                      F.size("rules_fired").cast("bigint").alias("fired"))


register("event_decode", event_decode, f"""
WITH {txn_sql()}
SELECT transaction_id, customer_id, amount, CASE WHEN CAST(transaction_id AS BIGINT) % 7 <> 0
  THEN strftime(ts, '%Y-%m-%d') ELSE 'unknown' END AS dt, CAST(NULL AS VARCHAR) AS decision,
  CASE WHEN CAST(transaction_id AS BIGINT) % 3 <> 0 THEN 2 ELSE 0 END AS fired FROM txn""")
