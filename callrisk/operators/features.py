"""Feature engineering (FE-A, FE-B, FE-C, FE-D): column expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.scalar import nz
from .clean import first_column_containing


def _has(df, *cols):
    return all(c in df.columns for c in cols)


def call_features_plus_one(df: DataFrame) -> DataFrame:
    """Variant A: denominators get +1; positivity = pos / (pos + neg + 1)."""
    c = F.col
    new = {}
    if _has(df, "agent_talktime", "customer_talktime"):
        new["agent_customer_talktime_ratio"] = c("agent_talktime") / (c("customer_talktime") + 1)
    if _has(df, "agent_sentiment_score", "customer_sentiment_score"):
        new["sentiment_difference"] = c("agent_sentiment_score") - c("customer_sentiment_score")
        new["avg_sentiment"] = (c("agent_sentiment_score") + c("customer_sentiment_score")) / 2
    if _has(df, "agent_total_sentence", "customer_total_sentence"):
        total = c("agent_total_sentence") + c("customer_total_sentence")
        new["total_sentences"] = total
        new["agent_sentence_ratio"] = c("agent_total_sentence") / (total + 1)
    if _has(df, "total_conversation_duration", "total_talktime"):
        new["silence_ratio"] = 1 - c("total_talktime") / (c("total_conversation_duration") + 1)
    for side in ("agent", "customer"):
        pos = first_column_containing(df, f"{side}_positive")
        neg = first_column_containing(df, f"{side}_negative")
        if pos and neg:
            new[f"{side}_positivity_ratio"] = c(pos) / (c(pos) + c(neg) + 1)
    return df.withColumns(new) if new else df


def call_features_nonzero(df: DataFrame) -> DataFrame:
    """Variant B: zero denominators replaced (0.001 for talk time, 1 otherwise);
    positivity = positive / total sentences."""
    c = F.col
    new = {}
    if _has(df, "agent_talktime", "customer_talktime"):
        new["agent_customer_talktime_ratio"] = c("agent_talktime") / nz("customer_talktime", 0.001)
    if _has(df, "agent_sentiment_score", "customer_sentiment_score"):
        new["sentiment_difference"] = c("agent_sentiment_score") - c("customer_sentiment_score")
        new["avg_sentiment"] = (c("agent_sentiment_score") + c("customer_sentiment_score")) / 2
    if _has(df, "agent_total_sentence", "customer_total_sentence"):
        total = c("agent_total_sentence") + c("customer_total_sentence")
        new["total_sentences"] = total
        new["agent_sentence_ratio"] = c("agent_total_sentence") / nz(total, 1)
    if _has(df, "total_conversation_duration", "total_talktime"):
        new["silence_ratio"] = 1 - c("total_talktime") / nz("total_conversation_duration", 1)
    for side in ("agent", "customer"):
        if _has(df, f"{side}_positive_sentence", f"{side}_total_sentence"):
            new[f"{side}_positivity_ratio"] = (c(f"{side}_positive_sentence")
                                               / nz(f"{side}_total_sentence", 1))
    return df.withColumns(new) if new else df


def _right_closed_bins(x, edges) -> F.Column:
    """(e0,e1] -> 1.0, (e1,e2] -> 2.0, ...; outside -> null."""
    expr = None
    for i in range(1, len(edges)):
        cond = (x > F.lit(float(edges[i - 1]))) & (x <= F.lit(float(edges[i])))
        expr = F.when(cond, F.lit(float(i))) if expr is None else expr.when(cond, F.lit(float(i)))
    return expr


def profile_features(df: DataFrame) -> DataFrame:
    """Debt-to-income, monthly burden, right-closed age and credit bands."""
    c = F.col
    new = {}
    if _has(df, "annual_income", "loan_amount"):
        new["debt_to_income"] = c("loan_amount") / (c("annual_income") + 1)
    if _has(df, "monthly_income", "loan_amount"):
        new["monthly_burden"] = c("loan_amount") / (c("monthly_income") * 12 + 1)
    if "age" in df.columns:
        new["age_band"] = _right_closed_bins(c("age"), S.AGE_BINS)
    if "credit_score" in df.columns:
        new["credit_band"] = _right_closed_bins(c("credit_score"), S.CREDIT_BINS)
    return df.withColumns(new) if new else df


def _opt(df: DataFrame, name: str, default) -> F.Column:
    """A live input field with the original's default when absent or null."""
    if name in df.columns:
        return F.coalesce(F.col(name).cast("double"), F.lit(float(default)))
    return F.lit(float(default))


def realtime_vector(df: DataFrame, out: str = "features") -> DataFrame:
    """FE-D1: 10 live features padded with zeros to 25 (array<double>)."""
    d = S.REALTIME_DEFAULTS
    vals = [
        _opt(df, "agent_sentiment", d[0]), _opt(df, "customer_sentiment", d[1]),
        _opt(df, "call_duration", d[2]), _opt(df, "agent_talk_ratio", d[3]),
        _opt(df, "silence_ratio", d[4]),
        _opt(df, "account_balance", 0.0), _opt(df, "previous_calls", 0),
        _opt(df, "satisfaction_score", S.SATISFACTION_DEFAULT),
        _opt(df, "payment_count", 0),
        F.coalesce(F.size("risk_factors"), F.lit(0)).cast("double") if "risk_factors" in df.columns
        else F.lit(0.0),
    ]
    pad = [F.lit(0.0)] * (S.REALTIME_VECTOR_SIZE - len(vals))
    return df.withColumn(out, F.slice(F.array(*vals, *pad), 1, S.REALTIME_VECTOR_SIZE))


def production_vector(df: DataFrame, out: str = "features") -> DataFrame:
    """FE-D2: 5 call features, balance, previous calls, number of historical calls (default 0)."""
    vals = [_opt(df, c, 0.0) for c in
            ("agent_sentiment", "customer_sentiment", "call_duration", "agent_talk_ratio", "silence_ratio",
             "account_balance", "previous_calls", "history_count")]
    return df.withColumn(out, F.array(*vals))
