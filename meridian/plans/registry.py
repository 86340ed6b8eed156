"""All queries by name, with their SQL where SQL can express them."""

from __future__ import annotations

from meridian.plans import q_plans, q_presence, q_scalar, q_sets, q_space, q_steps  # noqa: F401  they register themselves
from meridian.plans.base import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "sched_center"
