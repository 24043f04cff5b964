"""All registered queries; importing the plan modules fills the registry."""

from voxelloom.plans import corpus_plans, io_plans, mapping, measure, scoring, splitting, statistics, volume  # noqa: F401
from voxelloom.plans.registry import ORACLE, QUERIES  # noqa: F401
