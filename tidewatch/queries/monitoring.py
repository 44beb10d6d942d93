"""Monitoring queries over decided and scored sample transactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import monitor
from tidewatch.plans.scoring import decide
from tidewatch.queries.common import SCORED, txn_sql
from tidewatch.queries.decisions import MADE_SQL, decided_sql, made_features
from tidewatch.sources.tables import event_transactions, scored_events

QUERIES, ORACLE = {}, {}


def register(name, run, sql):
    QUERIES[name], ORACLE[name] = run, sql


def decided(spark, folder):
    return decide(made_features(event_transactions(spark, folder)))


DECIDED_SQL = f"WITH {txn_sql()}, {MADE_SQL}, {decided_sql('made', False)}"


def precision(spark, folder):
    """Outcomes are known of purchases and errors only."""
    t = event_transactions(spark, folder)
    known = F.when(F.col("event_kind").isin("purchase", "error"), (F.col("event_kind") == "error").cast("int"))
    return monitor.rule_precision(decide(made_features(t)), t.select("transaction_id", known.alias("label")))


register("rule_precision", precision, f"""{DECIDED_SQL},
x AS (SELECT transaction_id, unnest(string_split(rules_fired, ',')) AS rule_id FROM decided)
SELECT rule_id, count(*) AS fired, count(*) FILTER (event_kind IN ('purchase', 'error')) AS labelled,
  count(*) FILTER (event_kind = 'error') AS fraud,
  avg(CASE event_kind WHEN 'error' THEN 1.0::DOUBLE WHEN 'purchase' THEN 0.0::DOUBLE END) AS precision
FROM x JOIN txn USING (transaction_id) WHERE rule_id <> '' GROUP BY 1""")

_BINS = range(monitor.BINS)
register("score_drift", lambda spark, folder: monitor.score_drift(scored_events(spark, folder)), f"""
WITH {SCORED}, c AS (SELECT ms // 86400000 AS day, count(score) AS rows, count(*) - count(score) AS without_score,
  {', '.join(f'count(*) FILTER (least({monitor.BINS - 1}, floor(score * {monitor.BINS})) = {k}) AS n{k}' for k in _BINS)}
  FROM ev GROUP BY 1)
SELECT a.day, a.rows, a.without_score, {' + '.join(
    f'((a.n{k} + 0.5::DOUBLE) / (a.rows + 5.0::DOUBLE) - (b.n{k} + 0.5::DOUBLE) / (b.rows + 5.0::DOUBLE))'
    f' * ln(((a.n{k} + 0.5::DOUBLE) / (a.rows + 5.0::DOUBLE)) / ((b.n{k} + 0.5::DOUBLE) / (b.rows + 5.0::DOUBLE)))' for k in _BINS)} AS psi
FROM c a LEFT JOIN c b ON b.day = a.day - 1""")

register("decision_rates", lambda spark, folder: monitor.decision_rates(decided(spark, folder), "customer_portfolio_country"), f"""
{DECIDED_SQL}
SELECT customer_portfolio_country AS segment, grouping(customer_portfolio_country) AS whole, count(*) AS total,
  count(*) FILTER (decision = 'approve') AS approve, count(*) FILTER (decision = 'review') AS review,
  count(*) FILTER (decision = 'decline') AS decline, avg(CAST(decision = 'decline' AS INTEGER)) AS decline_rate
FROM decided GROUP BY ROLLUP (customer_portfolio_country)""")

register("exploration_slice", lambda spark, folder: monitor.explore(decided(spark, folder), 1 / 16, seed=5)
         .select("transaction_id", "decision", "explored"), f"""
{DECIDED_SQL}, x AS (SELECT *, decision = 'decline' AND substr(md5('5:' || transaction_id), 1, 8) < '10000000' AS explored FROM decided)
SELECT transaction_id, CASE WHEN explored THEN 'approve' ELSE decision END AS decision, explored FROM x""")

register("threshold_costs", lambda spark, folder: monitor.threshold_costs(scored_events(spark, folder), 25.0, ["producer"]), f"""
WITH {SCORED}, good AS (SELECT *, CAST(least(99, floor(score * 100)) AS INTEGER) AS part FROM ev
  WHERE score IS NOT NULL AND label IS NOT NULL),
steps AS (SELECT DISTINCT producer, part FROM good),
swept AS (SELECT s.producer, s.part / 100.0::DOUBLE AS threshold, count(*) FILTER (g.part >= s.part) AS declines,
    count(*) FILTER (g.part >= s.part AND label = 0) AS false_declines,
    coalesce(sum(amount_base) FILTER (g.part < s.part AND label = 1), 0) AS missed
  FROM steps s JOIN good g ON g.producer = s.producer GROUP BY s.producer, s.part)
SELECT *, missed + 25 * false_declines AS cost,
  row_number() OVER (PARTITION BY producer ORDER BY missed + 25 * false_declines, threshold DESC) = 1 AS best FROM swept""")
