from .text import (
    read_labels,
    read_predictions,
    read_sms,
    read_voice,
    read_wa,
    test_roster,
    write_submission,
    write_tab_text,
)
from .unions import union_pseudo_labels, union_rounds

__all__ = [
    "read_voice",
    "read_sms",
    "read_wa",
    "read_labels",
    "read_predictions",
    "test_roster",
    "write_submission",
    "write_tab_text",
    "union_rounds",
    "union_pseudo_labels",
]
