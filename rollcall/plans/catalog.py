"""All registered queries."""

from rollcall.plans import q_attendance, q_models, q_tables, q_transitions  # noqa: F401
from rollcall.plans.registry import ORACLES, QUERIES, ROWS  # noqa: F401
