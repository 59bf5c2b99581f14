"""Imports every plan module so that their queries are registered."""

from .registry import ORACLES, QUERIES  # noqa: F401
from . import answer_plans, calendar_plans, evaluation_plans, retrieval_plans, source_plans, state_plans, stream_plans, text_plans, usage_plans  # noqa: F401
