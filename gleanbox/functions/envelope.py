"""The request that delivers a message: address, method, headers and defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def request_uri(server: str, exchange_type: Column, exchange_name: Column, http_uri: Column | None = None) -> Column:
    """A custom relay's own address (empty is an error: null here), else the exchange's."""
    if http_uri is not None:
        return F.when(F.coalesce(F.trim(http_uri), F.lit("")) != "", http_uri)
    return F.concat(F.lit(server), exchange_type, F.lit("s/"), exchange_name, F.lit("/messages"))


def request_method(http_method: Column) -> Column:
    return F.coalesce(http_method, F.lit("POST"))


def request_headers(defaults: Column, custom_headers: Column) -> Column:
    """Default headers, overlaid by the JSON object of custom ones; null and {} change nothing."""
    own = F.coalesce(F.from_json(custom_headers, "map<string,string>"), F.create_map().cast("map<string,string>"))
    names = F.map_keys(own)
    return F.map_concat(F.map_filter(defaults, lambda k, _: ~F.array_contains(names, k)), own)


def topic_headers(exchange_type: Column, exchange_name: Column, payload: Column) -> tuple[Column, Column]:
    """(X_EVENT_NAME, X_TOPIC_NAME) of messages to a topic; null for others and for bad JSON."""
    is_topic = F.lower(exchange_type) == "topic"
    good = F.try_parse_json(payload).isNotNull() & payload.isNotNull()
    return F.when(is_topic & good, F.get_json_object(payload, "$.event")), F.when(is_topic & good, exchange_name)


def default_group(group_id: Column, message_id: Column) -> Column:
    return F.coalesce(F.upper(group_id), message_id)


def transaction_id(message_id: Column) -> Column:
    return F.concat(F.lit("TXN-"), message_id)


def business_id(*key: Column) -> Column:
    """A message id made from what identifies the message, so a repeated run makes the same one."""
    return F.sha2(F.concat_ws("\x1f", *key), 256)


def reply_url(url: Column, fallback: Column, message_id: Column, name: str = "messageIdQueryParam") -> Column:
    """The reply address with the message id; '&' joins it only where the address has one already."""
    url = F.coalesce(url, fallback)
    return F.concat(url, F.when(F.contains(url, F.lit("&")), F.lit("&")).otherwise(F.lit("?")), F.lit(f"{name}="), message_id)
