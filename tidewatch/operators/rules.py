"""Rules as data, score bands and the final decision."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.config import RULES, RULES_VERSION, Bands, LinearModel, RuleDef
from tidewatch.functions.values import sigmoid
from tidewatch.operators.refjoin import any_of


LOG = logging.getLogger(__name__)


def fires(blank: DataFrame, rule: RuleDef) -> Column:
    """The rule as a boolean that is never null; a condition that does not resolve never fires."""
    try:
        blank.select(F.expr(rule.condition).cast("boolean"))
    except (AnalysisException, ParseException) as problem:
        LOG.warning("rule %s does not resolve and never fires: %s", rule.rule_id, problem)
        return F.lit(False)
    return F.coalesce(F.expr(rule.condition).cast("boolean"), F.lit(False))


def with_rules(rows: DataFrame, rules: Sequence[RuleDef] = RULES) -> DataFrame:
    """Adds `rules_fired`, `hard_block`, `hard_allow` and `soft_score`.

    Conditions are bound with ANSI mode off: a division by zero or a text that is no number gives null in its row, and a
    null condition does not fire. The other rules of the row, and the job, go on.
    """
    conf, mode = rows.sparkSession.conf, "spark.sql.ansi.enabled"
    strict = conf.get(mode)
    known = [r for r in rules if r.type in ("hard_block", "hard_allow", "soft")]
    blank = rows.sparkSession.createDataFrame([], rows.schema)
    conf.set(mode, "false")
    try:
        flags = {f"_rule_{i}": fires(blank, r) for i, r in enumerate(known)}
        rows = rows.withColumns(flags)
    finally:
        conf.set(mode, strict)
    hit = {r.rule_id: F.col(name) for r, name in zip(known, flags)}
    soft = F.lit(0.0)
    for r in known:
        if r.type == "soft":
            soft = soft + F.when(hit[r.rule_id], float(r.weight or 0.0)).otherwise(0.0)
    names = [F.when(hit[r.rule_id], F.lit(r.rule_id)) for r in known]
    fired = F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")
    return rows.withColumns({
        "rules_fired": fired,
        "hard_block": any_of([hit[r.rule_id] for r in known if r.type == "hard_block"]),
        "hard_allow": any_of([hit[r.rule_id] for r in known if r.type == "hard_allow"]),
        "soft_score": soft}).drop(*flags)


def band(score: Column, bands: Bands = Bands()) -> Column:
    return (F.when(score >= bands.decline, "decline").when(score >= bands.review, "review")
            .otherwise("approve"))


def linear_probability(model: LinearModel) -> Column:
    """Standardised linear score through a sigmoid; a missing value counts as 0."""
    z = F.lit(model.intercept)
    for name, mean, std, weight in zip(model.feature_order, model.means, model.stds, model.weights):
        raw = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        z = z + F.lit(weight) * ((raw - F.lit(mean)) / F.lit(std if std != 0.0 else 1.0))
    return sigmoid(z)


def with_decision(rows: DataFrame, bands: Bands = Bands(), probability: Column | None = None,
                  version: str | None = None, degraded: Column | None = None) -> DataFrame:
    """Block, then allow, then degraded, then the larger of rule score and model probability."""
    active = version or RULES_VERSION
    block, allow = F.col("hard_block"), F.col("hard_allow")
    broken = F.lit(False) if degraded is None else F.coalesce(degraded, F.lit(False))
    no_score = F.lit(None).cast("double")
    model_score = no_score if probability is None else F.when(~block & ~allow & ~broken, probability)
    rows = rows.withColumns({"degraded": broken, "model_score": model_score})
    blended = F.greatest(F.least(F.lit(1.0), F.col("soft_score")), F.coalesce("model_score", F.lit(0.0)))
    rows = rows.withColumn("final_score", F.when(block, 1.0).when(allow, 0.0).when(broken, 0.5)
                           .otherwise(blended))
    return rows.withColumns({
        "decision": F.when(block, "decline").when(allow, "approve").when(broken, "review")
                     .otherwise(band(F.col("final_score"), bands)),
        "model_version": F.when(~block & ~allow & broken, f"{active}-degraded").otherwise(active)})
