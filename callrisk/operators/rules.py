"""Scores, bands and decision rules (SC-1..17) as column expressions.

Two score polarities exist and are kept apart (trap T1):
``safety_score`` = (1 - p) * 100, high = safe (batch);
``danger_score`` = p * 100 or the rule score, high = risky (live path).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.bands import (BATCH_SAFETY, MOBILE_DANGER, MOBILE_LEVEL, REALTIME_DANGER,
                               REALTIME_LEVEL, ROUTING, WIDGET_DANGER, BandSpec, band)


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def safety_score(p) -> F.Column:
    """SC-1: (1 - P(default)) * 100."""
    return (F.lit(1.0) - _c(p)) * 100.0


def danger_score(p, digits: int = 2) -> F.Column:
    """SC-3: P(default) * 100, rounded half-even."""
    return F.bround(_c(p) * 100.0, digits)


def rule_score(customer_sentiment="customer_sentiment", balance="account_balance",
               risk_factors="risk_factors") -> F.Column:
    """SC-4: 50; +20 if sentiment < -0.5 else +10 if < 0; +15 if balance < 5000,
    -10 if > 30000; +5 per recorded risk factor; clamped to 0..100.  Missing
    sentiment / balance count as 0, a missing factor list as empty."""
    s = F.coalesce(_c(customer_sentiment).cast("double"), F.lit(0.0))
    b = F.coalesce(_c(balance).cast("double"), F.lit(0.0))
    n = F.coalesce(F.size(_c(risk_factors)), F.lit(0)) if risk_factors is not None else F.lit(0)
    score = (F.lit(S.RULE_BASE)
             + F.when(s < S.RULE_SENTIMENT_VERY_NEG, S.RULE_VERY_NEG_POINTS)
               .when(s < S.RULE_SENTIMENT_NEG, S.RULE_NEG_POINTS).otherwise(0.0)
             + F.when(b < S.RULE_LOW_BALANCE, S.RULE_LOW_BALANCE_POINTS)
               .when(b > S.RULE_HIGH_BALANCE, S.RULE_HIGH_BALANCE_POINTS).otherwise(0.0)
             + F.greatest(n, F.lit(0)).cast("double") * S.RULE_POINTS_PER_FACTOR)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def safety_band(score) -> F.Column:          # SC-2
    return band(score, BATCH_SAFETY)


def realtime_band(score) -> F.Column:        # SC-5
    return band(score, REALTIME_DANGER)


def mobile_band(score) -> F.Column:          # SC-6
    return band(score, MOBILE_DANGER)


def widget_band(score, spec: BandSpec | None = None) -> F.Column:   # SC-7
    return band(score, spec or WIDGET_DANGER)


def sentiment_label(x) -> F.Column:
    """SC-13: > 0.3 Positive, < -0.3 Negative, else Neutral."""
    v = _c(x)
    pos, neu, neg = S.SENTIMENT_LABELS
    return F.when(v.isNull(), F.lit(None).cast("string")) \
        .when(v > 0.3, pos).when(v < -0.3, neg).otherwise(neu)


def agent_recommendations(score, customer_sentiment="customer_sentiment") -> F.Column:
    """SC-9: three texts per band plus one when the customer sounds unhappy."""
    level = band(score, REALTIME_LEVEL)
    texts = F.when(level == "high", F.array(*[F.lit(t) for t in S.AGENT_RECOMMENDATIONS["high"]])) \
        .when(level == "medium", F.array(*[F.lit(t) for t in S.AGENT_RECOMMENDATIONS["medium"]])) \
        .otherwise(F.array(*[F.lit(t) for t in S.AGENT_RECOMMENDATIONS["low"]]))
    s = F.coalesce(_c(customer_sentiment).cast("double"), F.lit(0.0))
    extra = F.when(s < S.UNHAPPY_SENTIMENT, F.array(F.lit(S.AGENT_UNHAPPY_RECOMMENDATION))) \
        .otherwise(F.array().cast("array<string>"))
    return F.concat(texts, extra)


def mobile_recommendations(df: DataFrame, score: str = "risk_score") -> DataFrame:
    """SC-10: five texts per mobile band plus the priority class, as a join to a
    three-row dimension (broadcast: its size is fixed by the band table)."""
    spark = df.sparkSession
    dim = spark.createDataFrame(
        [(lvl, S.MOBILE_RECOMMENDATIONS[lvl], S.MOBILE_PRIORITY[lvl]) for lvl in ("high", "medium", "low")],
        "level string, recommendations array<string>, priority_class string")
    return (df.withColumn("_level", band(score, MOBILE_LEVEL))
            .join(F.broadcast(dim), F.col("_level") == dim.level, "left")
            .drop("_level", "level"))


def risk_factors(customer_sentiment="customer_sentiment", balance="account_balance",
                 recorded="risk_factors") -> F.Column:
    """SC-11: negative sentiment, low balance, more than two recorded factors."""
    s = F.coalesce(_c(customer_sentiment).cast("double"), F.lit(0.0))
    b = F.coalesce(_c(balance).cast("double"), F.lit(0.0))
    n = F.coalesce(F.size(_c(recorded)), F.lit(0))
    return F.filter(F.array(
        F.when(s < S.UNHAPPY_SENTIMENT, F.lit(S.RISK_FACTOR_NEGATIVE_SENTIMENT)),
        F.when(b < S.RULE_LOW_BALANCE, F.lit(S.RISK_FACTOR_LOW_BALANCE)),
        F.when(n > S.MANY_PAST_FACTORS, F.lit(S.RISK_FACTOR_MANY_PAST)),
    ), lambda x: x.isNotNull())


def model_confidence(p) -> F.Column:
    """SC-12 (model path): round(max(p, 1 - p), 3) half-even."""
    return F.bround(F.greatest(_c(p), 1 - _c(p)), 3)


def routing(score) -> F.Column:
    """SC-8: strict > 70 high flow (transfer), > 40 medium attributes, else low."""
    flow = band(score, ROUTING)
    attrs = F.when(flow == S.ROUTE_HIGH_FLOW,
                   F.create_map().cast("map<string,string>")) \
        .when(flow == S.ROUTE_MEDIUM_FLOW,
              F.create_map(F.lit("risk_level"), F.lit("medium"), F.lit("escalation_required"), F.lit("false"))) \
        .otherwise(F.create_map(F.lit("risk_level"), F.lit("low"), F.lit("upsell_opportunity"), F.lit("true")))
    return F.struct(flow.alias("flow"),
                    (flow == S.ROUTE_HIGH_FLOW).alias("transfer"),
                    attrs.alias("attributes"),
                    F.when(flow != S.ROUTE_HIGH_FLOW, F.lit(S.ROUTE_STANDARD_MESSAGE)).alias("message"),
                    (flow != S.ROUTE_HIGH_FLOW).alias("to_queue"))


def score_live(df: DataFrame, at=None) -> DataFrame:
    """SC-16: assemble the live result record for each (call snapshot x customer)
    row: rule score, band, confidence, recommendations, factors, timestamp.
    A row without a customer gets an error text instead of an exception."""
    score = rule_score()
    ts = at if at is not None else F.col("ts")
    ok = F.col("customer_id").isNotNull()
    outputs = ("risk_score", "risk_category", "confidence", "recommendations", "factors", "error", "scored_at")
    keep = [c for c in df.columns if c not in outputs]
    return df.select(
        *keep,
        F.when(ok, F.bround(score, 2)).alias("risk_score"),
        F.when(ok, realtime_band(score)).alias("risk_category"),
        F.when(ok, F.lit(S.RULE_CONFIDENCE)).alias("confidence"),
        F.when(ok, agent_recommendations(score)).alias("recommendations"),
        F.when(ok, risk_factors()).alias("factors"),
        F.when(~ok, F.lit("customer not found")).alias("error"),
        ts.alias("scored_at"),
    )
