"""Schemas of what is stored. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

IDENTITY = "struct<name:string,key:string>"

#: A message with its metadata; the payload stays opaque.
ENVELOPE = (
    "struct<message_id:string,causation_id:string,correlation_id:string,"
    f"source_application:{IDENTITY},source_handler:{IDENTITY},"
    "created_at:timestamp,description:string,media_type:string,data:binary>"
)

#: One append to an event stream: a batch that is stored as a whole.
STREAM_RECORD = (
    f"stream_id string, pos bigint, stream_offset_before bigint, stream_offset_after bigint, events array<{ENVELOPE}>"
)

#: A tagged union: ``op`` names the one struct that is not null.
COMMAND_RECORD = (
    "handler_key string, pos bigint, op string, "
    f"command_accepted struct<command:{ENVELOPE}>, "
    f"command_handled struct<command_id:string,events:array<{ENVELOPE}>,event_stream_id:string,offset_hint:bigint>, "
    "events_appended_to_stream struct<command_id:string,event_stream_id:string,event_offset:bigint>"
)

REGISTRATION = "node struct<id:string,addresses:array<string>>, expires_at timestamp"


def struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)  # noqa: SLF001
