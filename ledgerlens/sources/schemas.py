"""Declared schemas of the logical inputs (no inference at read time)."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _D, _I, _L = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()
_TS = T.TimestampType()

TRANSACTIONS = _struct(
    customer_id=_D, invoice=_S, stock_code=_S, description=_S, quantity=_D, invoice_ts=_TS, price=_D,
)
TRANSACTION_COLUMNS = ("customer_id", "invoice", "stock_code", "description", "quantity", "invoice_ts", "price")

ORDERS = _struct(
    order_id=_S, customer_id=_S, order_status=_S, order_purchase_timestamp=_S,
    order_delivered_customer_date=_S, order_estimated_delivery_date=_S,
)
ORDER_ITEMS = _struct(order_id=_S, order_item_id=_I, price=_D)
ORDER_CUSTOMERS = _struct(customer_id=_S, customer_unique_id=_S, customer_state=_S)
PAYMENTS = _struct(order_id=_S, payment_value=_D)

SUBSCRIBERS = _struct(
    state=_S, area_code=_S, phone_number=_S, account_length=_I, international_plan=_S, voice_mail_plan=_S,
    total_day_minutes=_D, total_day_charge=_D, total_eve_minutes=_D, total_eve_charge=_D,
    total_night_minutes=_D, total_night_charge=_D, total_intl_minutes=_D, total_intl_charge=_D,
    number_customer_service_calls=_I, churn=_S,
)

CUSTOMER_TABLE = _struct(
    customer_id=_S, frequency=_L, monetary=_D, total_spend=_D, n_orders=_L, recency=_L,
    r_score=_I, f_score=_I, m_score=_I, rfm_score=_I, segment=_S, km_cluster=_I, km_label=_S,
    clv_90d=_D, clv_12m=_D, clv_12m_profit=_D, prob_alive=_D, predicted_purchases_90d=_D,
    pred_spend=_D, pred_prob=_D, pred_clv_90d=_D,
)
