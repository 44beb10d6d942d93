"""Heavy keys spread over lanes give the same answers as whole keys."""

import random

import pytest
from pyspark.sql import Window, functions as F

from tidewatch.config import LINEAR_MODEL, Config, MetricDef
from tidewatch.operators import ranking, signals
from tidewatch.operators.metrics import key_sets, with_metrics
from tidewatch.operators.signals import KEY_SETS, Guards
from tidewatch.operators.skew import HeavyKeys, SkewPolicy, find_heavy, into_lanes, lend, running
from tidewatch.operators.windows import (replay_decisions, with_idle_count, with_idle_members, with_recent_count,
                                         with_recent_members)
from tidewatch.plans.scoring import with_history
from tidewatch.queries import basics  # noqa: F401  (imports must not need a session)

TINY = SkewPolicy(min_rows=40, sample=1.0, lanes=7)


@pytest.fixture(scope="module")
def txns(spark):
    """A third of all rows belongs to one customer, payee and device; many share one instant."""
    draw = random.Random(5)
    rows = []
    for i in range(1200):
        hot = draw.random() < 0.34
        ms = 1_704_067_200_000 + draw.randrange(0, 40 * 24) * 900_000 + draw.choice([0, 0, 0, 1, 61_000])
        rows.append((f"t{i:05d}", ms, "hot" if hot else f"c{draw.randrange(9)}",
                     "mule" if draw.random() < 0.34 else (None if draw.random() < 0.05 else f"p{draw.randrange(30)}"),
                     "farm" if draw.random() < 0.34 else f"d{draw.randrange(5)}",
                     round(draw.uniform(1, 900), 2), int(draw.random() < 0.2), draw.choice(["payment", "error"])))
    df = spark.createDataFrame(rows, "transaction_id string, ms long, customer_id string, receiver_account string, "
                               "device_fingerprint string, amount_base double, declined int, event_kind string")
    return df.withColumns({"ts": F.timestamp_millis("ms"), "tpp_name_ud": F.lit("x"),
                           "customer_portfolio_country": F.lit("GB")}).cache()


@pytest.fixture(scope="module")
def heavy(txns):
    found = find_heavy(txns, *KEY_SETS, policy=TINY)
    assert all(found.of(k) for k in KEY_SETS)
    return found


def table(df):
    def plain(v):
        return round(v, 6) if isinstance(v, float) else v
    names = sorted(df.columns)
    return sorted((tuple((n, plain(r[n])) for n in names) for r in df.collect()), key=str)


def test_small_data_has_no_heavy_keys(txns):
    assert not any(find_heavy(txns, *KEY_SETS).of(k) for k in KEY_SETS)


def test_running_matches_a_plain_window(txns, heavy):
    order = ["ms", "transaction_id"]
    lanes = into_lanes(txns, ["customer_id"], order, heavy)
    assert lanes.wide.select("_lane").distinct().count() > 3
    got = running(lanes, ["customer_id"], order, {
        "s": ("sum", F.col("amount_base")), "lo": ("min", F.col("amount_base")), "hi": ("max", F.col("ms"))}).done()
    w = Window.partitionBy("customer_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    want = txns.withColumns({"s": F.sum("amount_base").over(w), "lo": F.min("amount_base").over(w),
                             "hi": F.max("ms").over(w)})
    assert table(got) == table(want)


@pytest.mark.parametrize("k", [1, 3, 200])
def test_lend_gives_every_lane_its_predecessors(txns, heavy, k):
    order = ["ms", "transaction_id"]
    lanes = lend(into_lanes(txns, ["customer_id"], order, heavy), ["customer_id"], order, k)

    def back(df, by):
        w = Window.partitionBy(*by, "customer_id").orderBy(*order)
        return df.withColumn("back", F.lag("ms", k).over(w)).filter(~F.col("_borrowed"))

    got = lanes.map(back).done().select("transaction_id", "back")
    plain = Window.partitionBy("customer_id").orderBy(*order)
    assert table(got) == table(txns.select("transaction_id", F.lag("ms", k).over(plain).alias("back")))


def test_whole_history_is_the_same_on_lanes(txns, heavy):
    guards = Guards(baseline_hours=3, surge_buckets=2, trend_weeks=2, gap_events=3)
    config = Config()
    spread = with_history(txns, config, heavy, guards)
    whole = with_history(txns, config, HeavyKeys(), guards)
    assert table(spread) == table(whole)


def test_metrics_windows_and_gaps_are_the_same_on_lanes(txns, heavy):
    def build(h):
        rows = with_metrics(txns, txns, Config(), h)
        rows = with_recent_count(rows, ["customer_id"], 3_600_000, "recent", h)
        rows = with_recent_members(rows, "receiver_account", "customer_id", 86_400_000, "senders", h)
        rows = with_idle_count(rows, ["customer_id"], 7_200_000, "idle", F.col("declined") == 1, h)
        return with_idle_members(rows, "customer_id", "receiver_account", 3_600_000, "met", h)
    assert table(build(heavy)) == table(build(HeavyKeys()))


def test_metrics_of_a_single_busy_entity_are_the_same_on_lanes(txns):
    metrics = tuple(MetricDef(f"m_{agg}_{i}", entity, "streaming_aggregate", "last_24h", agg=agg, field=field)
                    for i, (entity, agg, field) in enumerate([
                        (("tpp_name_ud",), "sum", "amount_base"), (("customer_portfolio_country",), "count", "amount_base"),
                        (("tpp_name_ud",), "distinct_count", "customer_id"),
                        (("receiver_account", "customer_portfolio_country"), "stddev", "amount_base")]))
    config = Config(metrics=metrics)
    heavy = find_heavy(txns, *KEY_SETS, *key_sets(config), policy=TINY)
    assert heavy.of(("tpp_name_ud",)) and heavy.of(("customer_id", "tpp_name_ud"))
    assert table(with_metrics(txns, txns, config, heavy)) == table(with_metrics(txns, txns, config))


def test_exact_windows_match_brute_force(txns):
    rows = with_recent_count(txns, ["customer_id"], 3_600_000, "recent")
    rows = with_recent_members(rows, "receiver_account", "customer_id", 86_400_000, "senders").collect()
    order = sorted(rows, key=lambda r: (r.ms, r.transaction_id))
    for i, t in enumerate(order):
        before = order[:i]
        assert t.recent == sum(p.customer_id == t.customer_id and t.ms - p.ms <= 3_600_000 for p in before)
        if t.receiver_account is not None:
            assert t.senders == len({p.customer_id for p in before if p.receiver_account == t.receiver_account
                                     and t.ms - p.ms <= 86_400_000})


def test_decision_feedback_matches_a_sequential_fold(txns, heavy):
    rows = txns.withColumns({"base_score": (F.col("amount_base") % 10) / 10, "hard_block": F.col("amount_base") > 880,
                             "hard_allow": F.col("amount_base") < 20})
    for h in (HeavyKeys(), heavy):
        got = {r.transaction_id: (r.decision, r.customer_declines_24h, r.customer_declines_90d)
               for r in replay_decisions(rows, heavy=h).collect()}
        past: dict = {}
        for r in sorted(rows.collect(), key=lambda r: (r.ms, r.transaction_id)):
            mine = past.setdefault(r.customer_id, [])
            hour = r.ms // 3_600_000
            day = sum(m // 3_600_000 >= hour - 24 for m in mine)
            quarter = len(mine)     # all rows lie within four calendar months
            score = r.base_score + (0.40 if quarter >= 3 else 0.0) + (0.45 if day >= 3 else 0.0)
            decision = ("decline" if r.hard_block else "approve" if r.hard_allow else
                        "decline" if min(1.0, score) >= 0.7 else "review" if score >= 0.3 else "approve")
            assert got[r.transaction_id] == (decision, day, quarter), r
            if decision == "decline":
                mine.append(r.ms)


def test_ranks_and_quantiles_use_all_rows(spark):
    df = spark.range(1000).select((F.col("id") % 97).cast("double").alias("score"),
                                  (F.col("id") % 3 == 0).cast("int").alias("label"), F.lit(1.0).alias("amount_base"))
    groups = ranking.score_groups(df, policy=SkewPolicy(lanes=5))
    for share in (0.0, 0.25, 0.5, 0.98, 1.0):
        want = df.agg(F.percentile("score", F.lit(share))).first()[0]
        assert ranking.quantile(groups, share) == pytest.approx(want)


def test_fixed_sample_is_exact_and_repeatable(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    for n in (0, 1, 999, 5000, 6000):
        a = ranking.fixed_sample(df, "k", n, small=20)
        assert a.count() == min(n, 5000)
        assert a.exceptAll(ranking.fixed_sample(df, "k", n, small=1)).count() == 0


def test_model_reads_registered_features():
    assert len(LINEAR_MODEL.feature_order) == len(LINEAR_MODEL.weights)
    assert signals.SAFE_DEFAULTS["interarrival_cv"] == 999.0
