"""Column lists and allowed values of the outbox tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Column names in table order, with Spark types.
OUTBOX = {
    "id": "bigint",
    "group_id": "string",
    "message_id": "string",
    "message": "string",
    "exchange_name": "string",
    "exchange_type": "string",
    "app_id": "string",
    "http_method": "string",
    "http_uri": "string",
    "custom_headers": "string",
    "reply_to": "string",
    "reply_to_http_method": "string",
    "reply_to_http_uri": "string",
    "transaction_id": "string",
    "correlation_id": "string",
    "destination_response_status": "int",
    "created_at": "timestamp",
}
METADATA = {"id": "bigint", "message_id": "string", "created_at": "timestamp"}
LEGACY = {
    "id": "bigint",
    "message_id": "string",
    "relayed": "boolean",
    "relayed_at": "timestamp",
    "exchange_name": "string",
    "message": "string",
    "created_at": "timestamp",
    "updated_at": "timestamp",
    "inbound_message_id": "string",
    "exchange_type": "string",
    "app_id": "string",
    "correlation_id": "string",
    "group_id": "string",
    "http_method": "string",
    "http_uri": "string",
    "reply_to": "string",
    "reply_to_http_method": "string",
    "reply_to_http_uri": "string",
    "txn_id": "string",
    "routing_key": "string",
    "context": "string",
    "destination_response_status": "int",
    "relay_error": "string",
    "retries": "int",
    "custom_headers": "string",
}

CONTROL_STATUS = ("NEW", "PROCESSING", "FAILED", "DONE")
SIDELINED_STATUS = ("SIDELINED", "UNSIDELINED", "PROCESSING")
SKIPPED_STATUS = ("NEW", "PROCESSING")
REASONS = ("GROUP_SIDELINED", "GROUP_SEQ_MAINTENANCE", "HTTP_ERROR", "RELAYER_ERROR")
READ_MODES = ("DEFAULT", "SEQUENCE_READER", "OUTBOUND_READER")


def read_mode(name: str | None) -> str:
    """A known read mode by name; an unknown one is DEFAULT."""
    return name if name in READ_MODES else "DEFAULT"


def conform(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The given columns in order; those that df lacks are null. Present columns keep their type."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()])
