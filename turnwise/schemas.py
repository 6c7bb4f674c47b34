"""Declared schemas. Unknown input fields are ignored, missing ones become null."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, LONG, DOUBLE, FLAG = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


def rows(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(struct(**fields))


# Field names and types of one call document.
LINK = struct(id=TEXT, _href=TEXT)
CALL_FIELDS = {
    "id": TEXT,
    "duration": LONG,
    "is_api": FLAG,
    "platform": TEXT,
    "media_type": TEXT,
    "organization_id": TEXT,
    "title": TEXT,
    "started_recording_at": LONG,
    "language_code": TEXT,
    "user_guid": TEXT,
    "owner_id": TEXT,
    "created_at": TEXT,
    "updated_at": TEXT,
    "event_end_date": TEXT,
    "event_start_date": TEXT,
    "call_id": TEXT,
    "account": LINK,
    "person": LINK,
    "transcription": LINK,
    "transcription_artifact": LINK,
    "transcription_sentences": LINK,
    "recording": LINK,
}
MENTIONS = rows(recording_attendee_id=TEXT, index_start=LONG, index_end=LONG, start_time=DOUBLE)
CATEGORIES = rows(category=TEXT, mentions_count=LONG, summary=TEXT, mentions=MENTIONS)
ATTENDEES = rows(
    id=TEXT,
    user_guid=TEXT,
    full_name=TEXT,
    email=TEXT,
    phone_number=TEXT,
    auto_generated=FLAG,
    is_internal=FLAG,
    percent_talk_time=DOUBLE,
    talk_time=LONG,
    external_id=TEXT,
)
SENTENCES = rows(
    id=TEXT,
    start_time=DOUBLE,
    end_time=DOUBLE,
    order_number=LONG,
    recording_attendee_id=TEXT,
    text=TEXT,
    conversation=LINK,
)
CALL_DATA = struct(
    **CALL_FIELDS,
    key_moments=struct(status=TEXT, items=rows(name=TEXT, categories=CATEGORIES)),
    summary=struct(id=TEXT, text=TEXT, status=TEXT, created_at=TEXT),
    action_items=struct(
        status=TEXT,
        items=rows(
            id=TEXT, original_text=TEXT, edited_text=TEXT, created_at=TEXT, updated_at=TEXT
        ),
    ),
    meddpicc=struct(categories=T.ArrayType(TEXT)),
    attendees=ATTENDEES,
    invitees=T.ArrayType(TEXT),
)
CALL = struct(
    conversation=struct(**CALL_FIELDS),
    extensiveConversation=struct(data=CALL_DATA),
    sentences=SENTENCES,
)

# The 18 keys of one assessed participant and their types.
PARTICIPANT_TEXT_LISTS = [
    "celebrations",
    "communication",
    "customer_focus",
    "impact_assessment",
    "manager_actions",
    "performance_metrics",
    "platform_expertise",
    "recommendations",
    "sales_skills",
    "strengths",
]
PARTICIPANT_TEXTS = [
    "email_id",
    "engagement_level",
    "meeting_summary_from_my_perspective",
    "meeting_summary_from_their_perspective",
    "name",
    "role",
    "sales_impact",
]
PARTICIPANT_INTEGERS = ["performance_score"]
PARTICIPANT_KEYS = sorted(PARTICIPANT_TEXT_LISTS + PARTICIPANT_TEXTS + PARTICIPANT_INTEGERS)


def _participant_type(name: str) -> T.DataType:
    if name in PARTICIPANT_TEXT_LISTS:
        return T.ArrayType(TEXT)
    return LONG if name in PARTICIPANT_INTEGERS else TEXT


PARTICIPANT = struct(**{key: _participant_type(key) for key in PARTICIPANT_KEYS})
ASSESSMENT = struct(participants=T.ArrayType(PARTICIPANT))

MESSAGES = rows(role=TEXT, content=TEXT)

EMBEDDED = struct(
    id=TEXT, conversation_id=TEXT, content=TEXT, name=TEXT, embedding=T.ArrayType(T.FloatType())
)
