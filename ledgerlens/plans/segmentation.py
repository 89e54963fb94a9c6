"""Raw transactions to segmented customers, without any model."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerlens.operators import clean, rfm, wholesale
from ledgerlens.session import materialize


def segment_customers(raw: DataFrame, wholesale_k: float = 3.0) -> DataFrame:
    """Clean, separate bulk buyers, score and segment.

    Two tables are written on the way: the cleaned transactions, which three
    passes read, and the unscored customers, which are ranked twice.
    """
    tx = materialize(clean.clean_transactions(raw))
    base = materialize(rfm.rfm_table(wholesale.detect_wholesale(tx, wholesale_k)))
    return rfm.segment_quintile(rfm.rfm_score_quintile(base))
