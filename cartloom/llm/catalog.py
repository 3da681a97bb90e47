"""Imports every operator's queries, so that they are registered."""

from cartloom.llm import decontaminate, exact_dedup, langid, mixing, near_dedup, scoring, sharding  # noqa: F401
from cartloom.llm import importance, quality, secrets, token_counts, toxicity, variants  # noqa: F401
from cartloom.llm.registry import ORACLES, QUERIES  # noqa: F401
