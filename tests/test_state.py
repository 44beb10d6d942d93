"""State between micro-batches: kept tables, scoring from them, retries, sessions, live counters, registry numbers."""

import json
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidewatch.config import LINEAR_MODEL, METRICS, Config, MetricDef
from tidewatch.operators.ranking import newest_rows, unscored
from tidewatch.operators.windows import with_recent_count
from tidewatch.plans import learning
from tidewatch.plans.scoring import Reference, score
from tidewatch.session import scratch
from tidewatch.sources.files import as_transactions, audit_table
from tidewatch.sources.kept import KeptTable, finished
from tidewatch.sources.sinks import AuditSink
from tidewatch.streaming import jobs
from tidewatch.streaming.state import EntityState

DAY = 86_400_000


def test_kept_table_is_the_sum_of_its_batches(spark):
    rng = random.Random(3)
    schema = {"a": "string", "b": "string", "n": "long", "low": "long", "high": "long"}
    table = KeptTable(scratch(spark, "kept"), schema, ("a", "b"), {"n": "sum", "low": "min", "high": "max"}, ("a",), 4, 3)
    every, batches = [], []
    for number in range(11):
        rows = [(rng.choice([*"pqr", None]), rng.choice([*"xy", None]), rng.choice([1, 2, None]), rng.randrange(99), rng.randrange(99)) for _ in range(12)]
        rows = list({r[:2]: r for r in rows}.values())          # one row for each key of a batch
        batches.append(rows)
        for _ in range(1 + number % 2):                         # every other batch is repeated
            table.add(spark.createDataFrame(rows, ", ".join(f"{k} {t}" for k, t in schema.items())), number)
            table.fold(spark, number)
        every = [r for b in batches for r in b]
        assert len(finished(spark, f"{table.path}/batch")) <= 8 and len(finished(spark, f"{table.path}/base")) <= 2

    def plain(rows):
        out = {}
        for a, b, n, low, high in rows:
            m, lo, hi = out.get((a, b), (None, 99, -1))
            out[a, b] = (m if n is None else n + (m or 0), min(lo, low), max(hi, high))
        return out
    def read(**which):
        return {(r.a, r.b): (r.n, r.low, r.high) for r in table.rows(spark, **which).collect()}
    assert read() == plain(every)
    assert read(before=10) == plain([r for b in batches[:10] for r in b])
    touched = spark.createDataFrame([("p",), (None,)], "a string")
    assert read(touched=touched) == plain([r for r in every if r[0] in ("p", None)])
    assert table.fold(spark, 11, lambda rows: rows.filter("high > 50"), now=True)
    assert set(read()) == {k for k, v in plain(every).items() if v[2] > 50}
    assert KeptTable(scratch(spark, "none"), schema, ("a", "b"), place=("a",)).rows(spark, touched=touched).collect() == []


def test_newest_version_before_and_after_folding(spark):
    table = KeptTable(scratch(spark, "newest"), {"k": "string", "v": "long", "w": "long"}, ("k",), every=2)
    for number in range(6):
        table.add(spark.createDataFrame([("a", number, None), (f"k{number}", number, 1)], "k string, v long, w long"), number)
        before = {tuple(r) for r in jobs.newest(spark, table.path, ["k"]).collect()}
        table.fold(spark, number + 1, now=True)
        assert before == {tuple(r) for r in jobs.newest(spark, table.path, ["k"]).collect()}
        assert ("a", number, None) in before and len(before) == number + 2


def requests(spark, days=200, count=160, seed=5):
    """Few customers over a time that is longer than any window, a third of the rows on one of them, some without entities."""
    rng = random.Random(seed)
    rows = []
    for k in range(count):
        ms = 1_700_000_000_000 + int(days * DAY * k / count) + rng.randrange(0, 5) * 60_000
        who = rng.choice(["hot", "hot", "c1", "c2", "c3", None])
        rows.append((f"t{k:04d}", ms, who, "GB", rng.choice(["p1", "p2", "p3", None]), rng.choice(["web", "app"]), rng.choice(["d1", "d2", None]),
                     f"51.{rng.randrange(1, 4)}.0.1", float(rng.randrange(1, 900)), "GBP"))
    df = spark.createDataFrame(rows, "transaction_id string, ms long, customer_id string, customer_portfolio_country string, receiver_account string, "
                                     "tpp_name_ud string, device_fingerprint string, ip_address string, amount double, currency string")
    return as_transactions(df.withColumn("timestamp", F.timestamp_millis("ms"))).withColumn(
        "declined", (F.crc32("transaction_id") % 4 == 0).cast("int"))


def reference(spark):
    return Reference(
        spark.createDataFrame([("hot", "2023-01-01"), ("c1", "2023-11-01")], "customer_id string, d string").selectExpr("customer_id", "to_date(d) AS account_open_date", "'normal' AS risk_segment"),
        spark.createDataFrame([("p1", "US", False), ("p2", "GB", True)], "receiver_account string, beneficiary_country string, is_mule_pattern boolean"),
        spark.createDataFrame([("51.1", "US"), ("51.2", "GB")], "ip_prefix string, country string"),
        spark.createDataFrame([("vip_customers", "c1"), ("bl_devices", "d2")], "list_name string, member string").withColumn("valid_from", F.lit(None).cast("timestamp")))


MORE = (MetricDef("tpp_n", ("tpp_name_ud",), "streaming_aggregate", "last_24h", agg="count", field="amount_base"),
        MetricDef("country_mean_90d", ("customer_portfolio_country",), "streaming_aggregate", "aged_24h_90d", agg="mean", field="amount_base"),
        MetricDef("tpp_people", ("tpp_name_ud",), "streaming_aggregate", "last_24h", agg="distinct_count", field="customer_id"))


def shown(value):
    return float(f"{value:.9g}") if isinstance(value, float) else value


def test_scoring_from_kept_state(spark):
    """Every feature and decision is that of one plan over the whole history; repeated batches and retries change nothing."""
    txns, ref, config = requests(spark).persist(), reference(spark), Config(metrics=(*METRICS, *MORE))
    whole = score(txns, ref, config, LINEAR_MODEL)
    names = [c for c in whole.columns if c not in ("ts", "rules_fired")]
    want = {r.transaction_id: [shown(r[c]) for c in names] + [r.rules_fired] for r in whole.collect()}
    path = scratch(spark, "audit")
    edges = [txns.agg(F.min("ms")).first()[0] + d * DAY for d in (0, 60, 150, 201)]
    got = {}
    for number, (low, high) in enumerate(zip(edges, edges[1:])):
        batch = txns.filter((F.col("ms") >= low) & (F.col("ms") < high))
        if number == 2:      # ten transactions of the first batch are asked again, with other amounts
            batch = batch.unionByName(txns.filter(F.col("ms") < edges[1]).orderBy("ms").limit(10).withColumn("amount_base", F.lit(9e9)))
        for _ in range(2 if number == 1 else 1):
            state = EntityState(f"{path}-state", config, parts=3, every=1)
            records, retried = jobs.score_batch(batch, number, state, jobs.memo_table(f"{path}-memo", 3, 1), ref, config, LINEAR_MODEL, True)
            AuditSink(path).write(records, number)
        snapshots = audit_table(spark, path).filter(F.col("timestamp_epoch_ms").between(low, high - 1)).collect()
        got.update({r.transaction_id: r for r in snapshots})
        assert retried.count() == (10 if number == 2 else 0)
    assert audit_table(spark, path).count() == txns.count() == len(want)        # no row is lost, none is there twice
    place, wrong = {c: i for i, c in enumerate(names)}, []
    for key, row in sorted(got.items()):
        expected, snapshot = want[key], json.loads(row.feature_snapshot_json)
        pairs = [("rules_fired", row.rules_fired, expected[-1])]
        pairs += [(c, shown(row[c]), expected[place[c]]) for c in ("decision", "model_version", "final_score")]
        pairs += [(c, shown(v), expected[place[c]]) for c, v in snapshot.items() if c in place and not c.endswith("_rt")]
        wrong += [(key, c, a, b) for c, a, b in pairs if a != (pytest.approx(b, rel=1e-6, abs=1e-9) if isinstance(b, float) else b)]
    assert not wrong, wrong[:20]
    old = {r.transaction_id: r for r in retried.collect()}
    for key, row in old.items():
        assert (row.decision, row.rules_fired, row.feature_snapshot_json) == (got[key].decision, [], "{}")
        assert shown(row.final_score) == shown(got[key].final_score) and row.amount_base == 9e9
    # buckets older than every window are one row for each entity
    state.fold(txns.filter(F.col("ms") >= edges[2]), 3, now=True)
    ticks = state.bucket_kept(state.entities[("customer_id",)]).rows(spark)
    assert ticks.filter("_tick > 0").agg(F.min("_tick")).first()[0] >= (edges[2] - state.days * DAY) // 300_000
    assert ticks.filter("_tick = 0").count() == ticks.filter("_tick = 0").select("customer_id").distinct().count() > 0


def test_sessions_merge_parts(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(0, 200_000)) for _ in range(500)] + [("edge", 0), ("edge", 1000), ("edge", 1999)]
    gap = 1000
    table = jobs.session_table(scratch(spark, "sessions"), ["customer_id"])
    for number in range(4):                                     # rows of any time in any batch
        table.add(jobs.session_parts(spark.createDataFrame(rows[number::4], "customer_id string, ms long"), ["customer_id"], gap), number)
        table.fold(spark, number, now=True)
    got = sorted(map(str, (tuple(r) for r in jobs.sessions(table.rows(spark), ["customer_id"], gap, 500).collect())))
    want = []
    for who in {r[0] for r in rows}:
        run = []
        for ms in [*sorted(m for w, m in rows if w == who), None]:
            if run and (ms is None or ms - run[-1] >= gap):
                want.append((who, run[0], run[-1] + gap, len(run), run[-1] + gap > max(m for _, m in rows) - 500))
                run = []
            run.append(ms)
    assert got == sorted(map(str, want))


def test_live_metrics_over_batches(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b"]), rng.choice(["decline", "approve"]), rng.randrange(2), 1000 * k + rng.randrange(900), 2.0, f"w{k % 5}") for k in range(200)]
    live = jobs.LiveMetrics(scratch(spark, "live"), 2000, 30_000)
    for number in range(20):
        part = rows[number * 10:number * 10 + 10]
        df = spark.createDataFrame(part, "model_version string, decision string, label int, ms long, amount_base double, producer string")
        for _ in range(1 + number % 2):
            live.add(df, number)
        if number % 6 == 5:
            at = max(r[3] for r in part)
            frame = live.frame(spark, "a", "b", at, upto=number).first()
            inside = [r for r in rows if at // 2000 - 15 < r[3] // 2000 <= at // 2000 and r[3] <= at]
            assert frame.champion_tp == sum(r[0] == "a" and r[1] == "decline" and r[2] == 1 for r in inside)
            assert frame.challenger_fn == sum(r[0] == "b" and r[1] == "approve" and r[2] == 1 for r in inside)
            assert frame.instances == len({r[5] for r in inside})


def test_late_labels_are_caught_up(spark):
    t = F.timestamp_millis("ms")
    decisions = spark.createDataFrame([("x", "v", "decline", 0, 1.0), ("x", "w", "approve", 0, 1.0), ("y", "v", "decline", 0, 1.0)],
                                      "transaction_id string, model_version string, decision string, ms long, amount_base double").withColumn("ts", t)
    labels = spark.createDataFrame([("x", "confirmed_legit", 10), ("x", "confirmed_fraud", 100 * DAY), ("z", "confirmed_fraud", 5)],
                                   "transaction_id string, label string, labeled_at_ms long")
    early = decisions.join(labels.filter("labeled_at_ms = 10"), "transaction_id").select(
        *decisions.columns, F.lit(0).alias("label"), F.timestamp_millis("labeled_at_ms").alias("labeled_at"))
    late = jobs.caught_up(decisions, labels, early)
    assert sorted((r.transaction_id, r.model_version, r.label) for r in late.collect()) == [("x", "v", 1), ("x", "w", 1)]
    now = jobs.current_labels(early.unionByName(late)).collect()
    assert sorted((r.transaction_id, r.model_version, r.label) for r in now) == [("x", "v", 1), ("x", "w", 1)]
    assert jobs.caught_up(decisions, labels, early.unionByName(late)).count() == 0


def test_registry_numbers_are_taken_once(spark):
    path = scratch(spark, "registry")
    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(lambda _: learning.claimed(spark, f"{path}-numbers", 1), range(24)))
    assert sorted(numbers) == list(range(1, 25))
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda v: learning.register(spark, path, v, "challenger", f"/{v}", ["x"], 1, 1, 1), ("a", "b")))
    rows = learning.registry(spark, path).collect()
    assert {r.version for r in rows} == {"a", "b"} and len({r.seq for r in rows}) == 2


@pytest.mark.parametrize("size", [0, 1, 40, 123, 400, 999])
def test_newest_rows(spark, size):
    rng = random.Random(size)
    rows = [(f"t{k:03d}", rng.choice([None, rng.randrange(-DAY, 3 * DAY), 2 * DAY + rng.randrange(3)])) for k in range(400)]
    got = sorted(r.transaction_id for r in newest_rows(spark.createDataFrame(rows, "transaction_id string, ms long"), size).collect())
    assert got == sorted(r[0] for r in sorted(rows, key=lambda r: (-(r[1] if r[1] is not None else -(1 << 62)), r[0]))[:size])


def test_null_keys_count_nothing(spark):
    rows = spark.createDataFrame([("a", None, 1), ("b", None, 2), ("c", None, 3), ("d", "k", 4), ("e", "k", 5)], "transaction_id string, customer_id string, ms long")
    got = with_recent_count(rows, ["customer_id"], 1000, "n").collect()
    assert {r.transaction_id: r.n for r in got} == {"a": 0, "b": 0, "c": 0, "d": 0, "e": 1}


def test_unscored_rows_are_counted(spark):
    rows = spark.createDataFrame([(0.5, 1), (None, 1), (None, 0), (None, 0)], "score double, label int")
    assert tuple(unscored(rows).first()) == (3, 1)
