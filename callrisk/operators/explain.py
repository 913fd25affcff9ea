"""Per-row explanations (EXP-1..6) as column expressions and aggregates.

The live rule score is additive, so its attribution is exact: base 50 plus
one contribution per input (sentiment, balance, recorded factors) plus the
clamp to 0..100.  Model attributions (``linear_attributions``) use the exact
linear form coef * (x - mean) of a logistic model on standardised features.
Top-N reasons are built with higher-order array functions inside the row,
so no explode / shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S

RULE_FEATURES = ("customer_sentiment", "account_balance", "risk_factors")


def rule_contributions(df: DataFrame, sentiment: str = "customer_sentiment", balance: str = "account_balance",
                       factors: str = "n_risk_factors") -> DataFrame:
    """EXP-1 (rule model): base value, one contribution per input, clamp adjustment.
    base + sum(contributions) + clamp = score, exactly."""
    s = F.coalesce(F.col(sentiment).cast("double"), F.lit(0.0))
    b = F.coalesce(F.col(balance).cast("double"), F.lit(0.0))
    n = F.coalesce(F.col(factors), F.lit(0)).cast("double")
    c_s = (F.when(s < S.RULE_SENTIMENT_VERY_NEG, S.RULE_VERY_NEG_POINTS)
           .when(s < S.RULE_SENTIMENT_NEG, S.RULE_NEG_POINTS).otherwise(0.0))
    c_b = (F.when(b < S.RULE_LOW_BALANCE, S.RULE_LOW_BALANCE_POINTS)
           .when(b > S.RULE_HIGH_BALANCE, S.RULE_HIGH_BALANCE_POINTS).otherwise(0.0))
    c_f = F.greatest(n, F.lit(0.0)) * S.RULE_POINTS_PER_FACTOR
    raw = F.lit(S.RULE_BASE) + c_s + c_b + c_f
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))
    return df.select("*", F.lit(S.RULE_BASE).alias("base_value"), c_s.alias("c_customer_sentiment"),
                     c_b.alias("c_account_balance"), c_f.alias("c_risk_factors"),
                     (clamped - raw).alias("clamp_adjustment"))


def contributions_array(features, prefix: str = "c_", values: dict | None = None) -> F.Column:
    """array<struct<feature, value, contribution>> from contribution columns."""
    values = values or {}
    return F.array(*[F.struct(F.lit(f).alias("feature"),
                              (values[f] if f in values else F.lit(None)).cast("double").alias("value"),
                              F.col(f"{prefix}{f}").cast("double").alias("contribution"))
                     for f in features])


def _by_abs_desc(a, b):
    ka, kb = F.abs(a["contribution"]), F.abs(b["contribution"])
    return (F.when(ka > kb, -1).when(ka < kb, 1)
            .when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0))


def _by_signed_desc(a, b):
    ka, kb = a["contribution"], b["contribution"]
    return (F.when(ka > kb, -1).when(ka < kb, 1)
            .when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0))


def top_reasons(contribs: F.Column, n: int = 3) -> F.Column:
    """EXP-3: the ``n`` largest |contribution| (ties by name) as
    ``"f (increases risk)"`` / ``"f (decreases risk)"`` joined with ', '."""
    top = F.slice(F.array_sort(contribs, _by_abs_desc), 1, n)
    txt = F.transform(top, lambda e: F.concat(e["feature"], F.when(e["contribution"] > 0, F.lit(" (increases risk)"))
                                              .otherwise(F.lit(" (decreases risk)"))))
    return F.array_join(txt, ", ")


def top_reasons_signed(contribs: F.Column, n: int = 3) -> F.Column:
    """EXP-4 (legacy): the ``n`` largest signed contributions, names only."""
    top = F.slice(F.array_sort(contribs, _by_signed_desc), 1, n)
    return F.array_join(F.transform(top, lambda e: e["feature"]), ", ")


def explanation_detail(df: DataFrame, key: str, contribs: str = "contribs") -> DataFrame:
    """EXP-5: long form (key, rank, feature, value, contribution, impact), ranked by |contribution|."""
    ranked = df.select(key, F.posexplode(F.array_sort(F.col(contribs), _by_abs_desc)).alias("pos", "e"))
    return ranked.select(key, (F.col("pos") + 1).alias("rank"), F.col("e.feature").alias("feature"),
                         F.col("e.value").alias("value"), F.col("e.contribution").alias("contribution"),
                         F.when(F.col("e.contribution") > 0, "Increases Risk").otherwise("Decreases Risk")
                         .alias("impact"))


def attribution_summary(detail: DataFrame) -> DataFrame:
    """EXP-6: mean |contribution| per feature (table behind the summary plot)."""
    return detail.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))


def importance_reasons(names: list[str]) -> F.Column:
    """EXP-2 fallback: the same global top features for every row, as text."""
    return F.lit(", ".join(f"{n} (important feature)" for n in names))
