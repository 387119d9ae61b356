"""Explicit schemas; nothing is inferred."""

TASKS = (
    "id STRING, title STRING, title_folded STRING, notes STRING, due_date DATE, due_minute_of_day INT, "
    "reminder_enabled BOOLEAN, reminder_lead_minutes INT, reminder_at_local TIMESTAMP_NTZ, notification_id INT, "
    "completed BOOLEAN, completed_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP, source STRING, "
    "source_transcript STRING, capture_id STRING, sort_order INT"
)
SETTINGS = "key STRING, value STRING, updated_at TIMESTAMP"
USAGE_DAYS = "day DATE, capture_count INT, task_count INT"
CORPUS = "now STRING, cases ARRAY<STRUCT<id: STRING, profile: STRING, note: STRING, tasks: ARRAY<STRUCT<title: STRING, date: STRING, time: STRING>>>>"
