"""Subscriber churn: from a raw upload to tiers, revenue at risk and the call list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ledgerlens.operators import churn, clean, learning
from ledgerlens.operators.boosting import BoostedModel
from ledgerlens.sources.tables import normalize_headers, validate_schema

# Model inputs after identifiers are dropped, and extra columns of the call list.
MODEL_FEATURES = (
    "account_length", "international_plan", "voice_mail_plan", "total_day_minutes", "total_day_charge",
    "total_eve_minutes", "total_eve_charge", "total_night_minutes", "total_night_charge",
    "total_intl_minutes", "total_intl_charge", "number_customer_service_calls",
)
CALL_COLUMNS = ("international_plan", "number_customer_service_calls", "total_day_minutes", "voice_mail_plan")


def prepare_subscribers(raw: DataFrame, label: str = "churn") -> DataFrame:
    """Normal headers, yes/no flags as 1/0 and no identifying columns."""
    df = clean.map_binary(normalize_headers(raw), ["international_plan", "voice_mail_plan", label])
    return clean.drop_identifiers(df)


def train_churn_model(prepared: DataFrame, label: str = "churn", trees: int = learning.TREES) -> BoostedModel:
    return learning.boosted_classifier(prepared, MODEL_FEATURES, label, trees=trees)


def warn(
    raw: DataFrame, model: BoostedModel, key: str = "customer_id", high: float = 70, medium: float = 40,
    order_by: Sequence[str] = (), closed: str = "left",
) -> DataFrame:
    """Probability in percent, risk tier and monthly value for every uploaded subscriber.

    Without a key column identifiers are generated in ``order_by`` order.
    """
    df = clean.map_binary(normalize_headers(raw), ["international_plan", "voice_mail_plan"])
    validate_schema(df, MODEL_FEATURES)
    if key not in df.columns:
        df = clean.id_generator(df, order_by or df.columns, start=0, alias=key)
    scored = learning.positive_probability(model.transform(df), "score")
    tiered = churn.churn_risk_tiers(churn.predict_probability(scored), high=high, medium=medium, closed=closed)
    return churn.monthly_value(tiered)
