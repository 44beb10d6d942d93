"""Readers, writers, labels, evaluation, registry and streaming helpers."""

import json

import pytest
from pyspark.sql import functions as F

from tidewatch import schemas
from tidewatch.config import Bands, RuleDef, read_config
from tidewatch.operators import labels as lab, quality, ranking, refjoin
from tidewatch.operators.rules import with_decision, with_rules
from tidewatch.plans import learning as learn
from tidewatch.sources import files
from tidewatch.sources.sinks import write_audit, write_labels
from tidewatch.streaming.jobs import LastGood


def put(path, text):
    path.write_text(text if isinstance(text, str) else json.dumps(text))
    return str(path)


def test_master_data_lists_and_networks(spark, tmp_path):
    customers = files.customers(spark, put(tmp_path / "c.json", [
        {"customer_id": "a", "customer_portfolio_country": "GB", "account_open_date": "2020-01-02", "risk_segment": "vip",
         "typical_amount_range_usd": [1, 2]}]))
    assert customers.first().account_open_date.isoformat() == "2020-01-02"
    payees = files.payees(spark, put(tmp_path / "p.json", [{"receiver_account": "b", "country": "US", "is_mule_pattern": True}]))
    assert payees.first().beneficiary_country == "US"
    assert files.tpps(spark, put(tmp_path / "t.json", [{"tpp_name_ud": "t", "typical_country": "SG"}])).count() == 1
    lists = files.member_lists(spark, put(tmp_path / "l.json", {"bl_accounts": ["x", "y"], "bl_devices": []}),
                               ["bl_accounts", "bl_devices"])
    assert sorted((r.list_name, r.member) for r in lists.collect()) == [("bl_accounts", "x"), ("bl_accounts", "y")]
    geo = put(tmp_path / "g.json", {"prefixes": {"51.1": "US"}, "proxy_ips": ["51.9.13.7"]})
    assert files.ip_networks(spark, geo).first().asDict() == {"ip_prefix": "51.1", "country": "US"}
    assert files.proxy_addresses(spark, geo).first().member == "51.9.13.7"


def test_transactions_and_samples(spark, tmp_path):
    line = json.dumps({"transaction_id": "t1", "timestamp": "2026-08-10T14:00:00+02:00", "amount": 10.0, "currency": "usd"})
    rows = files.transactions(spark, put(tmp_path / "t.jsonl", f"{line}\n\n{line}\n")).collect()
    assert len(rows) == 2 and rows[0].ms == 1_786_363_200_000 and rows[0].amount_base == pytest.approx(7.9)
    sample = files.sample_requests(spark, put(tmp_path / "s.json", [
        {"label": "x", "expected_decision": "approve", "request": {"transaction_id": "r1", "customer_id": "c"}}]))
    row = sample.first()
    assert (row.label, row.expected_decision, row.transaction_id, row.amount_base) == ("x", "approve", "r1", 0.0)


def test_config_documents(spark, tmp_path):
    config = read_config(
        spark,
        windows=put(tmp_path / "w.json", [{"window_id": "w", "lookback_start_offset_sec": -60, "lookback_end_offset_sec": 0,
                                           "bucket_resolution": "1h", "tier": "hot", "retention_sec": 5}]),
        metrics=put(tmp_path / "m.json", [{"metric_id": "m", "entity": "[customer_id, receiver_account]",
                                           "type": "streaming_aggregate", "agg": "count", "window_id": "w"}]),
        rules=put(tmp_path / "r.json", [{"rule_id": "r", "type": "soft", "condition": "x > 1", "weight": 0.2}]),
        bands=put(tmp_path / "b.json", [{"review": 0.5}]))
    assert config.window("w").unit == "hour" and config.metrics[0].entity == ("customer_id", "receiver_account")
    assert config.bands == Bands(0.5, 0.70) and config.rules[0].weight == 0.2
    assert read_config(spark).bands == Bands(0.30, 0.70)


def test_rules_that_fail_do_not_fire(spark):
    rules = [RuleDef("bad_column", "soft", "nope > 1", 0.9), RuleDef("bad_text", "soft", "x >", 0.9),
             RuleDef("unknown", "odd", "x > 0", 0.9), RuleDef("null_weight", "soft", "x > 0", None),
             RuleDef("null_side", "soft", "y > 0", 0.9), RuleDef("differs", "soft", "NOT (y <=> 1)", 0.35),
             RuleDef("again", "soft", "x = 1", 0.35)]
    row = with_decision(with_rules(spark.createDataFrame([(1, None)], "x int, y int"), rules)).first()
    assert row.rules_fired == ["null_weight", "differs", "again"]
    assert row.decision == "decline" and row.final_score == pytest.approx(0.7)


def test_precedence_of_decisions(spark):
    df = spark.createDataFrame([(True, True, 0.0, True), (False, True, 0.9, True), (False, False, 0.9, True),
                                (False, False, 1.4, False), (False, False, 0.1, False)],
                               "hard_block boolean, hard_allow boolean, soft_score double, bad boolean")
    rows = with_decision(df, Bands(), F.lit(0.4), "m1", F.col("bad")).collect()
    assert [(r.decision, r.final_score, r.model_version, r.model_score) for r in rows] == [
        ("decline", 1.0, "m1", None), ("approve", 0.0, "m1", None), ("review", 0.5, "m1-degraded", None),
        ("decline", 1.0, "m1", 0.4), ("review", 0.4, "m1", 0.4)]


def audit_rows(spark, n):
    return spark.range(n).select(
        F.format_string("t%04d", "id").alias("transaction_id"), *[F.lit("x").alias(c) for c in (
            "customer_id", "receiver_account", "decision", "model_version", "currency", "customer_portfolio_country",
            "device_fingerprint", "tpp_name_ud")],
        *[F.lit(1.0).alias(c) for c in ("final_score", "model_score", "amount", "amount_base")],
        F.lit(1_786_363_200_000).alias("timestamp_epoch_ms"), F.array(F.lit("R1")).alias("rules_fired"),
        F.format_string('{"velocity_ratio_1h": %d, "new_payee": 1.0}', (F.col("id") < 60).cast("int") * 9)
         .alias("feature_snapshot_json"))


def label_rows(spark, n, now):
    frauds = F.col("id") < 60
    return spark.range(n).select(
        F.format_string("t%04d", "id").alias("transaction_id"),
        F.when(frauds, lab.FRAUD).otherwise(lab.LEGIT).alias("label"), F.lit("chargeback").alias("source"),
        F.lit(now - 10).alias("labeled_at_ms"), F.lit(now - 20).alias("txn_ts_ms"))


def test_training_join_maturity_and_cap(spark, tmp_path):
    now = 1_786_400_000_000
    write_audit(files.with_partition_date(audit_rows(spark, 200)), str(tmp_path / "audit"))
    write_labels(lab.label_records(label_rows(spark, 200, now)), str(tmp_path / "labels"))
    audit, labels = files.audit_table(spark, str(tmp_path / "audit")), files.label_table(spark, str(tmp_path / "labels"))
    assert [d.name for d in (tmp_path / "audit").iterdir() if d.name.startswith("dt=")] == ["dt=2026-08-10"]
    whole = learn.training_set(audit, labels, F.lit(now))
    assert whole.count() == 200 and whole.agg(F.sum("y")).first()[0] == 60
    assert len(whole.columns) == 16
    assert learn.training_set(audit, labels, F.lit(now), maturation_ms=1000).count() == 60
    assert learn.training_set(audit, labels, F.lit(now), cap=50).count() == 50
    nothing = files.audit_table(spark, str(tmp_path / "none"))
    assert nothing.count() == 0 and learn.training_set(nothing, labels, F.lit(now)).count() == 0

    reg, models = str(tmp_path / "registry"), str(tmp_path / "models")
    assert learn.retrain(spark, audit, labels, models, reg, "m0", now, min_positives=61)["skipped"]
    assert learn.active_model(spark, reg) is None
    done = learn.retrain(spark, audit, labels, models, reg, "m1", now, trees=3, depth=2)
    assert done == {"skipped": False, "n": 200, "pos": 60, "version": "m1"}
    learn.promote(spark, reg, "m1")
    version, model = learn.active_model(spark, reg)
    scored = learn.with_probability(model, whole)
    assert version == "m1" and scored.filter((F.col("score") >= 0.5) == (F.col("y") == 1)).count() == 200


def test_linear_model_round_trip(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 40).cast("double").alias("x"), F.lit(2.0).alias("flat"),
                                   (F.col("id") % 40 >= 30).cast("int").alias("y"))
    model = learn.train_linear(rows, ["x", "flat"], "v")
    learn.save_linear(spark, model, str(tmp_path / "m"))
    again = learn.load_linear(spark, str(tmp_path / "m"))
    assert again == model and model.stds[1] == 1.0 and model.weights[0] > 0


def test_budget_metrics_and_rates(spark):
    def scored(scores, labels):
        return spark.createDataFrame([(s, y, 1.0) for s, y in zip(scores, labels)],
                                     "score double, label int, amount_base double")
    scores = [0.9, 0.8, 0.1, 0.2, 0.3, 0.4, 0.05, 0.15, 0.25, 0.35]
    best = ranking.metrics_at_budget(scored(scores, [1, 1] + [0] * 8), 0.2).first()
    assert (best.recall, best.precision, best.fpr, best.roc_auc, best.pr_auc) == (1.0, 1.0, 0.0, 1.0, 1.0)
    mixed = ranking.metrics_at_budget(scored(scores, [1, 0, 1] + [0] * 7), 0.2).first()
    assert (mixed.recall, mixed.precision, mixed.fpr) == (0.5, 0.5, 0.125)
    cells = quality.with_rates(spark.createDataFrame([(80, 20, 20, 880), (0, 0, 0, 0)], "tp int, fp int, fn int, tn int"))
    a, b = cells.collect()
    assert (a.recall, a.precision, round(a.fpr, 4)) == (0.8, 0.8, 0.0222) and (b.recall, b.precision, b.fpr) == (0, 0, 0)


def test_block_targets_come_from_trusted_fraud_only(spark):
    rows = [("a", lab.FRAUD, "chargeback", 1, 1, "p1", "d1"), ("b", lab.FRAUD, "rumour", 1, 1, "p2", "d2"),
            ("c", lab.LEGIT, "chargeback", 1, 1, "p3", "d3"), ("d", lab.FRAUD, "simulation", 1, 1, None, "d1")]
    found = lab.block_candidates(spark.createDataFrame(rows, schemas.LABEL))
    assert sorted((r.list_name, r.member, r.evidence) for r in found.collect()) == [
        ("bl_accounts", "p1", 1), ("bl_devices", "d1", 2)]
    many = spark.range(1200).select(F.lit("bl_accounts").alias("list_name"), F.format_string("p%04d", "id").alias("member"),
                                    (F.col("id") % 3).alias("evidence"))
    kept = lab.strongest(many)
    assert kept.count() == 500 and kept.filter("evidence = 2").count() == 400
    listed = many.filter("member < 'p0100'").select("list_name", "member")
    assert refjoin.new_entries(many, listed).count() == 1100


def test_fraud_entities(spark):
    rows = spark.createDataFrame([("mule_1", "d"), ("p", "farm_2"), ("p", "d"), (None, None)], "p string, d string")
    got = [r[0] for r in rows.select(lab.is_fraud_entity(F.col("p"), F.col("d"))).collect()]
    assert got == [True, True, False, False]


def test_last_good_value_survives_a_failed_read():
    answers = iter([1, RuntimeError("down"), 3])

    def read():
        value = next(answers)
        if isinstance(value, Exception):
            raise value
        return value
    latest = LastGood(read)
    assert [latest(), latest()] == [1, 1] and latest.error is not None
    assert latest() == 3 and latest.error is None


def test_sketches_stay_close_to_exact_counts(spark):
    from tidewatch.operators.aggregates import member_sketches, sketch_window
    rows = spark.range(60_000).select((F.col("id") % 3).alias("e"), (F.col("id") % 20_000).alias("m"),
                                      (F.lit(1_704_067_200_000) + (F.col("id") % 60) * 86_400_000).alias("ms"))
    got = sketch_window(member_sketches(rows, "e", "m"), "e").filter(f"month = {2024 * 12 + 1}")
    exact = {r.e: r.n for r in rows.groupBy("e").agg(F.count_distinct("m").alias("n")).collect()}
    for r in got.collect():
        assert abs(r.members - exact[r.e]) / exact[r.e] < 0.03
