"""Windows, metrics, rules, score bands and the linear model as data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class WindowDef:
    """Look-back from `start_sec` to `end_sec` (both <= 0) in buckets of `resolution` (1h or 1d)."""

    window_id: str
    start_sec: int
    end_sec: int
    resolution: str
    tier: str = "hot"
    retention_sec: int | None = None

    @property
    def unit(self) -> str:
        return {"1h": "hour", "1d": "day"}[self.resolution]


@dataclass(frozen=True)
class MetricDef:
    metric_id: str
    entity: tuple[str, ...]
    type: str
    window_id: str
    agg: str | None = None
    field: str | None = None
    event_type: str | None = None
    sub_window_sec: int | None = None
    position: int | None = None


@dataclass(frozen=True)
class RuleDef:
    rule_id: str
    type: str
    condition: str
    weight: float | None = None


@dataclass(frozen=True)
class Bands:
    review: float = 0.30
    decline: float = 0.70


@dataclass(frozen=True)
class LinearModel:
    version: str
    feature_order: tuple[str, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float


# The standard windows.
WINDOWS = (
    WindowDef("last_24h", -86_400, 0, "1h", "hot", 93_600),
    WindowDef("aged_24h_90d", -7_776_000, -86_400, "1d", "warm", 8_208_000),
)

# The standard metrics.
METRICS = (
    MetricDef("time_since_last_failed_logon_24h_hrs", ("customer_id",), "time_since_last_event",
              "last_24h", event_type="failed_logon"),
    MetricDef("customerid_stddev_sendertransactionamo_1d", ("customer_id",), "streaming_aggregate",
              "last_24h", agg="stddev", field="amount_base"),
    MetricDef("c_snd_3rd_lst_pymt_dt_1h_rt", ("customer_id",), "positional", "last_24h",
              field="payment_ts", position=2, sub_window_sec=3600),
    MetricDef("customer_txn_count_1h", ("customer_id",), "streaming_aggregate", "last_24h",
              agg="count", field="amount_base", sub_window_sec=3600),
    MetricDef("bene_distinct_senders_24h", ("receiver_account",), "streaming_aggregate", "last_24h",
              agg="distinct_count", field="customer_id"),
    MetricDef("pair_txn_count_90d", ("customer_id", "receiver_account"), "streaming_aggregate",
              "aged_24h_90d", agg="count", field="amount_base"),
)

# The standard rules; conditions are Spark SQL over feature columns.
RULES = (
    RuleDef("R001_blacklisted_beneficiary", "hard_block", "bl_account"),
    RuleDef("R002_blacklisted_device", "hard_block", "bl_device"),
    RuleDef("R003_vip_low_amount_fast_track", "hard_allow", "vip_customer AND amount_base < 500"),
    RuleDef("R004_velocity_burst", "soft", "customer_txn_count_1h > 5", 0.40),
    RuleDef("R005_mule_fan_in", "soft", "bene_distinct_senders_24h > 10", 0.50),
    RuleDef("R006_new_payee_high_amount", "soft", "pair_txn_count_90d <=> 0 AND amount_base > 1000", 0.35),
    RuleDef("R007_cross_border_off_hours", "soft",
            "NOT (customer_portfolio_country <=> beneficiary_country) AND local_hour IN (0, 1, 2, 3, 4)", 0.30),
    RuleDef("R008_watchlist_customer", "soft", "watchlist", 0.30),
    RuleDef("R009_device_sharing", "soft", "device_distinct_customers > 2", 0.30),
    RuleDef("R010_ip_geo_anomaly", "soft", "NOT (ip_country <=> customer_portfolio_country) OR ip_proxy", 0.30),
    RuleDef("R011_new_account_high_amount", "soft", "account_age_days < 30 AND amount_base > 1000", 0.30),
    RuleDef("R012_repeat_declines_90d", "soft", "customer_declines_90d >= 3", 0.40),
    RuleDef("R013_beneficiary_fanout_90d", "soft", "customer_distinct_bene_90d > 15", 0.35),
    RuleDef("R014_repeat_declines_24h", "soft", "customer_declines_24h >= 3", 0.45),
    RuleDef("R015_beneficiary_fanout_24h", "soft", "customer_distinct_bene_24h > 8", 0.35),
    RuleDef("R016_mule_fan_in_90d", "soft", "bene_distinct_senders_90d > 30", 0.40),
    RuleDef("R017_velocity_burst_5m", "soft", "customer_txn_rate_5m > 5", 0.40),
    RuleDef("R018_amount_anomaly_90d", "soft", "amount_zscore_90d > 3", 0.40),
    RuleDef("R019_velocity_spike_vs_baseline", "soft", "velocity_ratio_1h > 8", 0.45),
    RuleDef("R020_sustained_elevation", "soft", "velocity_elevated_hours >= 4", 0.40),
    RuleDef("R021_offhour_activity", "soft", "hod_share_now < 0.01", 0.30),
    RuleDef("R022_machine_cadence", "soft", "interarrival_cv < 0.15", 0.40),
    RuleDef("R023_amount_bustout", "soft", "amount_trend > 0.15", 0.45),
    RuleDef("R024_dormant_reactivation", "soft", "dormancy_days > 60", 0.35),
    RuleDef("R025_device_surge", "soft", "device_surge > 5", 0.40),
    RuleDef("R026_bene_inbound_surge", "soft", "bene_surge > 5", 0.40),
)

# The bundled linear model.
LINEAR_MODEL = LinearModel(
    version="logreg-v1",
    feature_order=("amount_base", "local_hour", "customer_txn_count_1h", "bene_distinct_senders_24h",
                   "pair_txn_count_90d", "cross_border"),
    means=(115.17860995850621, 11.607883817427386, 0.0975103734439834, 2.4315352697095434,
           0.33195020746887965, 0.7614107883817427),
    stds=(59.42293587693021, 6.9686449568204765, 0.6607191675417946, 1.7945518424236422,
          0.8889454412508699, 0.4262210690681958),
    weights=(-0.49832670327208795, 0.24956346566000928, 0.7199922271842664, 0.5371470271945138,
             -0.6429751416314831, 0.1179456736866678),
    intercept=-0.309546655268392,
)

# Model features in contract order.
MODEL_FEATURES = (
    "velocity_ratio_1h", "customer_txn_rate_5m", "customer_declines_90d", "customer_distinct_bene_90d",
    "bene_distinct_senders_90d", "amount_zscore_90d", "device_distinct_customers", "dormancy_days",
    "device_surge", "bene_surge", "new_payee", "amount_base", "local_hour", "account_age_days",
)
RULES_VERSION = "rules-v1"


@dataclass(frozen=True)
class Config:
    windows: tuple[WindowDef, ...] = WINDOWS
    metrics: tuple[MetricDef, ...] = METRICS
    rules: tuple[RuleDef, ...] = RULES
    bands: Bands = Bands()

    def window(self, window_id: str) -> WindowDef:
        return next(w for w in self.windows if w.window_id == window_id)


def entity_columns(text: str) -> tuple[str, ...]:
    """`customer_id` or `[customer_id, receiver_account]` as column names."""
    return tuple(part.strip() for part in text.strip("[]").split(","))


def read_config(spark: SparkSession, windows: str | None = None, metrics: str | None = None,
                rules: str | None = None, bands: str | None = None) -> Config:
    """Config documents (JSON arrays); what has no path keeps its standard value.

    Config is a few dozen rows by nature and shapes the plan, so it is read while the plan is built.
    """
    def rows(path: str, schema: str):
        return spark.read.schema(schema).option("multiLine", True).json(path).collect()

    made = {}
    if windows:
        made["windows"] = tuple(
            WindowDef(r.window_id, r.lookback_start_offset_sec, r.lookback_end_offset_sec,
                      r.bucket_resolution, r.tier, r.retention_sec)
            for r in rows(windows, "window_id string, lookback_start_offset_sec long, "
                          "lookback_end_offset_sec long, bucket_resolution string, tier string, "
                          "retention_sec long"))
    if metrics:
        made["metrics"] = tuple(
            MetricDef(r.metric_id, entity_columns(r.entity), r.type, r.window_id, r.agg, r.field,
                      r.event_type, r.sub_window_sec, r.position)
            for r in rows(metrics, "metric_id string, entity string, type string, agg string, field string, "
                          "event_type string, window_id string, sub_window_sec int, position int"))
    if rules:
        made["rules"] = tuple(
            RuleDef(r.rule_id, r.type, r.condition, r.weight)
            for r in rows(rules, "rule_id string, type string, condition string, weight double"))
    if bands:
        found = rows(bands, "review double, decline double")
        if found:
            made["bands"] = Bands(
                Bands.review if found[0].review is None else found[0].review,
                Bands.decline if found[0].decline is None else found[0].decline)
    return Config(**made)
