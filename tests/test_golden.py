"""Sample requests with known decisions, and signal scenarios with known values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch import schemas
from tidewatch.config import Config
from tidewatch.operators.aggregates import scoreboard
from tidewatch.operators.metrics import with_metrics
from tidewatch.operators.signals import DEVICE, DEVICE_USERS, amount_measures, with_device_sightings
from tidewatch.operators.history import attach
from tidewatch.plans.scoring import Reference, decide, score, with_history, with_reference
from tidewatch.sources.files import as_transactions

NOON = dt.datetime(2026, 8, 10, 12, 0)

# Customers of the samples (country, account opened).
CUSTOMERS = {
    "cust_005": ("US", "2023-09-11"), "cust_012": ("DE", "2025-03-02"), "cust_020": ("US", "2023-12-09"),
    "cust_022": ("GB", "2024-01-13"), "cust_030": ("DE", "2024-07-25"), "cust_035": ("US", "2022-12-09"),
    "cust_038": ("SG", "2025-11-18"), "cust_046": ("GB", "2019-05-10"), "cust_049": ("BR", "2025-09-20"),
}
# Payee countries.
PAYEES = {"bene_002": "US", "bene_003": "US", "bene_004": "DE", "bene_005": "SG", "bene_006": "GB", "bene_009": "BR",
          "bene_015": "DE", "bene_017": "US", "bene_018": "DE", "bene_020": "GB"}
# Network countries and list members.
NETWORKS = {"51.1": "US", "51.2": "GB", "51.3": "DE", "51.4": "SG", "51.5": "BR"}
LISTS = [("bl_accounts", "bene_020"), ("bl_devices", "device_099"), ("vip_customers", "cust_046"),
         ("vip_customers", "cust_047"), ("vip_customers", "cust_048"), ("watchlist", "cust_049"),
         ("watchlist", "cust_050"), ("proxy_ips", "51.9.13.7")]
# Customer, payee, device, amount, hour and minute, expected decision, rule that must fire.
REQUESTS = [
    ("cust_005", "bene_003", "device_005", 65.0, (12, 0), "approve", None),
    ("cust_046", "bene_002", "device_046", 40.0, (12, 0), "approve", "R003_vip_low_amount_fast_track"),
    ("cust_038", "bene_020", "device_038", 250.0, (12, 0), "decline", "R001_blacklisted_beneficiary"),
    ("cust_035", "bene_004", "device_099", 90.0, (12, 0), "decline", "R002_blacklisted_device"),
    ("cust_012", "bene_005", "device_012", 45.0, (12, 0), "review", "R004_velocity_burst"),
    ("cust_020", "bene_018", "device_020", 95.0, (12, 0), "review", "R005_mule_fan_in"),
    ("cust_020", "bene_015", "device_020", 4800.0, (12, 0), "review", "R006_new_payee_high_amount"),
    ("cust_030", "bene_017", "device_030", 4800.0, (12, 0), "approve", None),
    ("cust_030", "bene_017", "device_030", 2200.0, (3, 14), "review", "R007_cross_border_off_hours"),
    ("cust_049", "bene_006", "device_049", 150.0, (12, 0), "review", "R008_watchlist_customer"),
    ("cust_022", "bene_009", "device_022", 120.0, (12, 0), "approve", None),
]
PREFIX = {country: prefix for prefix, country in NETWORKS.items()}


def txn(name, when, customer, payee, device, amount):
    country = CUSTOMERS.get(customer, ("US", None))[0]
    return (name, when, customer, country, payee, "tpp_Alpha", device, f"{PREFIX[country]}.0.7", float(amount), "GBP")


def backfill():
    """History around the samples: a burst, a fan-in, a known payee and a shared device."""
    rows = [txn(f"burst{i}", NOON - dt.timedelta(minutes=42 - 1.4 * i), "cust_012", "bene_005", "device_012", 30 + i)
            for i in range(9)]
    rows += [txn(f"fan{i}", NOON - dt.timedelta(hours=2 + 18 * i / 14), f"cust_{i + 1:03d}", "bene_018",
                 f"device_{i + 1:03d}", 60) for i in range(14)]
    rows += [txn(f"known{d}", NOON - dt.timedelta(days=d), "cust_030", "bene_017", "device_030", 4000)
             for d in (30, 45, 60)]
    rows += [txn(f"shared{c}", NOON - dt.timedelta(days=3, minutes=i), c, "bene_003", "device_shared_01", 20)
             for i, c in enumerate(("cust_010", "cust_027", "cust_033"))]
    return rows


def frame(spark, rows):
    return as_transactions(spark.createDataFrame(rows, schemas.REQUEST))


@pytest.fixture(scope="module")
def ref(spark):
    return Reference(
        spark.createDataFrame([(c, v[1]) for c, v in CUSTOMERS.items()], "customer_id string, account_open_date string")
        .withColumn("account_open_date", F.to_date("account_open_date")),
        spark.createDataFrame(list(PAYEES.items()), "receiver_account string, beneficiary_country string"),
        spark.createDataFrame(list(NETWORKS.items()), "ip_prefix string, country string"),
        spark.createDataFrame(LISTS, "list_name string, member string").withColumn("valid_from", F.lit(None).cast("timestamp")))


@pytest.fixture(scope="module")
def judged(spark, ref):
    """Each request scored alone against the history, on metrics and rules without the behavioural signals."""
    asked = [txn(f"req_{i + 1:03d}", NOON.replace(hour=r[4][0], minute=r[4][1]), *r[:4]) for i, r in enumerate(REQUESTS)]
    everything = []
    for r in asked:     # requests do not see each other
        everything += [(f"{r[0]}/{h[0]}" if h is not r else r[0], h[1], f"{r[0]}/{h[2]}", h[3], f"{r[0]}/{h[4]}", h[5],
                        f"{r[0]}/{h[6]}", *h[7:]) for h in [*backfill(), r]]
    txns = frame(spark, everything)
    rows = with_metrics(txns, txns, Config())
    rows = attach(with_device_sightings(rows), txns, DEVICE, amount_measures()[:1], (), (DEVICE_USERS,))
    rows = rows.filter(~F.col("transaction_id").contains("/"))
    rows = rows.withColumns({c: F.substring_index(c, "/", -1) for c in
                             ("customer_id", "receiver_account", "device_fingerprint")})
    return decide(with_reference(rows, ref)).cache()


def test_sample_requests_get_their_decision(spark, judged):
    got = {r.transaction_id: r for r in judged.collect()}
    for i, (_, _, _, _, _, decision, rule) in enumerate(REQUESTS):
        row = got[f"req_{i + 1:03d}"]
        assert row.decision == decision, (row.transaction_id, row.rules_fired)
        if rule:
            assert rule in row.rules_fired
    expected = spark.createDataFrame([(f"req_{i + 1:03d}", r[5]) for i, r in enumerate(REQUESTS)],
                                     "transaction_id string, expected_decision string")
    assert scoreboard(judged, expected).first().asDict() == {"total": 11, "passed": 11}


def test_known_feature_values(judged):
    got = {r.transaction_id: r for r in judged.collect()}
    assert got["req_005"].customer_txn_count_1h == 9
    assert got["req_006"].bene_distinct_senders_24h == 14
    assert got["req_008"].pair_txn_count_90d == 3 and got["req_007"].pair_txn_count_90d == 0
    assert got["req_008"].amount_base == 4800.0 and got["req_009"].local_hour == 3
    assert got["req_001"].time_since_last_failed_logon_24h_hrs is None
    assert got["req_005"].customerid_stddev_sendertransactionamo_1d > 0


def test_shared_device(spark):
    txns = frame(spark, [*backfill(), txn("next", NOON, "cust_010", "bene_003", "device_shared_01", 5)])
    rows = attach(with_device_sightings(txns), txns, DEVICE, amount_measures()[:1], (), (DEVICE_USERS,))
    assert rows.filter("transaction_id = 'next'").first().device_distinct_customers == 3


def test_signal_scenarios(spark, ref):
    at = dt.datetime(2026, 8, 17, 12, 3)
    rows = []
    rows += [("d", i, at - dt.timedelta(days=10 + i), "cust_005", "bene_003", "dev_a", 1) for i in range(4)]
    rows += [("f", i, at - dt.timedelta(days=20, minutes=i), "cust_020", f"fan_{i:02d}", "dev_b", 0) for i in range(16)]
    rows += [("z", 0, at - dt.timedelta(days=90), "cust_022", "bene_009", "dev_c", 0)]
    rows += [("s", i, dt.datetime(2026, 8, 17, 12, 0) - dt.timedelta(minutes=10 * (13 - i)), f"s{i}", "bene_surge", "dev_s", 0)
             for i in range(13)]
    rows += [("c", i, dt.datetime(2026, 8, 17, 12, 0, 1 + i), f"c{i}", "bene_surge", "dev_s", 0) for i in range(20)]
    asks = [("ask", 0, at, "cust_005", "bene_003", "dev_a", 0), ("ask", 1, at, "cust_020", "bene_015", "dev_b", 0),
            ("ask", 2, at, "cust_022", "bene_009", "dev_c", 0), ("ask", 3, at, "s99", "bene_surge", "dev_s", 0),
            ("ask", 4, at, "cust_030", "bene_017", "dev_x", 0)]
    df = frame(spark, [txn(f"{k}{i}", when, c, p, d, 50) for k, i, when, c, p, d, _ in rows + asks])
    declined = [f"{k}{i}" for k, i, *_, x in rows if x]
    df = df.withColumn("declined", F.col("transaction_id").isin(*declined).cast("int"))
    got = {r.transaction_id: r for r in score(df, ref).filter(F.col("transaction_id").startswith("ask")).collect()}
    assert got["ask0"].customer_declines_90d == 4 and "R012_repeat_declines_90d" in got["ask0"].rules_fired
    assert got["ask1"].customer_distinct_bene_90d == 16 and "R013_beneficiary_fanout_90d" in got["ask1"].rules_fired
    assert got["ask2"].dormancy_days == pytest.approx(90) and "R024_dormant_reactivation" in got["ask2"].rules_fired
    for name, rule in (("device_surge", "R025_device_surge"), ("bene_surge", "R026_bene_inbound_surge")):
        assert got["ask3"][name] == pytest.approx(20 / (33 / 14)) and rule in got["ask3"].rules_fired
    assert got["ask4"].decision == "approve" and got["ask4"].rules_fired == []


def test_history_of_an_unknown_customer_is_safe(spark):
    row = with_history(frame(spark, [txn("only", NOON, "cust_099", "bene_003", "dev", 10)])).first()
    assert (row.customer_declines_24h, row.hod_share_now, row.interarrival_cv, row.amount_trend) == (0, 1.0, 999.0, 0.0)
    assert row.new_payee == 1.0 and row.dormancy_days == 0.0 and row.customer_txn_count_1h == 0
