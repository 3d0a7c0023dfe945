"""Registered queries, each with its SQL twin where SQL can express it."""

from popshift.plans import events, monitoring, preparation, reports, search, segments, trends  # noqa: F401
from popshift.plans.registry import QUERIES, SQL  # noqa: F401
