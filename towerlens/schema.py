"""Schemas of the raw export, the cleaned alarms and the history table."""

from __future__ import annotations

from pyspark.sql import types as T

# The 44 columns of a raw export, in file order.
RAW_COLUMNS = (
    "alarm_type", "severity", "occurred_on", "cleared_on", "alarm_id", "mo_name",
    "comment", "alarm_name", "location_information", "additional_information",
    "alarm_duration", "alarm_source", "acknowledged_by", "acknowledged_on",
    "acknowledgement_status", "associated_alarm_group_id", "auto_clear", "bbu_name",
    "clearance_status", "clearance_type", "cleared_by", "common_alarm_identifier",
    "dev_root_csn", "equipment_alarm_serial_number", "external_resource_id",
    "link_name", "link_type", "log_serial_number", "maintenance_region",
    "maintenance_status", "ne_address", "ne_type", "object_type",
    "operation_impact_flag", "rru_name", "received_on", "request_id", "subnet",
    "toggling_times", "trouble_ticket_id", "type", "user_label", "enodeb_id",
    "gnodeb_id",
)
# Normalised headers of exports that differ from the list above.
EXPORT_VARIANTS = ("occurred_on_nt", "occurred_on_st", "cleared_on_nt", "event_time", "name", "ne_name")

RAW_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in RAW_COLUMNS])

# Candidate columns in order of preference.
TIME_CANDIDATES = ("occurred_on_nt", "occurred_on", "event_time", "occurred_on_st")
NAME_CANDIDATES = ("name", "alarm_name")
SITE_CANDIDATES = (
    "alarm_source", "mo_name", "bbu_name", "ne_name",
    "location_information", "enodeb_id", "gnodeb_id",
)

HISTORY_SCHEMA = T.StructType([
    T.StructField("site_id", T.StringType()),
    T.StructField("node_identifier", T.StringType()),
    T.StructField("event_time", T.TimestampType()),
    T.StructField("alarm_name", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("duration_minutes", T.DoubleType()),
    T.StructField("file_source", T.StringType()),
    T.StructField("ingestion_time", T.TimestampType()),
    T.StructField("event_date", T.DateType()),
])

# Identifier and target columns that never feed a model.
IDENTIFIER_COLUMNS = (
    "site_id", "node_identifier", "enodeb_id", "gnodeb_id", "window_timestamp",
    "alarm_id", "mo_name", "location_information", "primary_entity",
)
TARGET_COLUMNS = (
    "target_outage_next_2h", "target_cell_unavailable_2h", "target_cell_outage_2h",
    "target_cell_fault_2h", "target_service_unavailable_2h",
)
