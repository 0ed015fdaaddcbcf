"""Schemas of the engine's tables."""

PACKETS = "capture STRING, packet_ordinal BIGINT, batch_id BIGINT, ts_us BIGINT, data BINARY"
MESSAGE_KEYS = "capture STRING, packet_ordinal BIGINT, batch_id BIGINT, ts_us BIGINT, is_response BOOLEAN, client_ip BINARY, client_port INT, resolver_ip BINARY"
QUESTION = "ARRAY<STRUCT<name: STRING, qtype: INT>>"
IDENTITY = ("id", "name", "client_ip", "client_port", "qtype", "resolver_ip")
EVENT_ORDER = ("batch_id", "ts_us", "packet_ordinal", "record_ordinal")
EVENTS = (
    "batch_id BIGINT, ts_us BIGINT, packet_ordinal BIGINT, record_ordinal INT, is_query BOOLEAN, id INT, name STRING, qtype INT, "
    "client_ip BINARY, client_port INT, resolver_ip BINARY, rcode INT, rcode_ctx STRING"
)
RECORD_COLUMNS = ("request_timestamp", "response_timestamp", "source_ip", "source_port", "id", "name", "query_type", "response_code")
#: Packets per batch: the unit of ordering and of failure.
BATCH_PACKETS = 65_536
DNS_PORT = 53
