"""Column types of the logical input tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_S, _B, _TS = T.StringType(), T.BooleanType(), T.TimestampNTZType()

USER_FACTS = _schema(
    external_id=_S,
    first_seen=_TS,
    profile_role=_S,
    last_presented=_TS,
    currently_premium=_B,
    currently_on_trial=_B,
    account_type=_S,
)
USER_FACTS_NESTED = _schema(
    external_id=_S,
    first_seen=_TS,
    last_presented=_TS,
    profile=_schema(role=_S),
    primary_account_details=_schema(
        currently_premium=_B, currently_on_trial=_B, account_type=_S
    ),
)
STUDENT_RESPONDED = _schema(teacher=_S, student=_S, presentation=_S, timestamp=_TS)
STUDENT_RESPONSES = _schema(
    teacher=_S, student=_S, presentation=_S, slide=_S, app=_S, timestamp=_TS
)
SLIDE_PRESENTED = _schema(
    user_id=_S, presentation_id=_S, slide_id=_S, slide_type=_S, timestamp=_TS
)
LAUNCH_PRESENTATION = _schema(user_id=_S, timestamp=_TS, account_status=_S)
PRESENTER_BUTTON_CLICKED = _schema(user_id=_S, button=_S, timestamp=_TS)
APP_EVENTS = _schema(user_id=_S, event=_S, timestamp=_TS)
EVENT_DICTIONARY = _schema(category=_S, event=_S)
EXCLUDED_USERS = _schema(hashed_coach_id=_S)

TABLES = {
    "user_facts": USER_FACTS,
    "student_responded": STUDENT_RESPONDED,
    "student_responses": STUDENT_RESPONSES,
    "slide_presented": SLIDE_PRESENTED,
    "launch_presentation": LAUNCH_PRESENTATION,
    "presenter_button_clicked": PRESENTER_BUTTON_CLICKED,
    "app_events": APP_EVENTS,
    "event_dictionary": EVENT_DICTIONARY,
    "excluded_users": EXCLUDED_USERS,
}
