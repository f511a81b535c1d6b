"""All registered queries. Importing this module fills the registry."""

from tallywind.plans import core, cycle_queries, insight_queries, stream_queries  # noqa: F401
from tallywind.plans.registry import ORACLES, QUERIES  # noqa: F401
