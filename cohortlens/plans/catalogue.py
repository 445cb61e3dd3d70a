"""All registered queries: importing this module fills the registry."""

from cohortlens.plans import catalogue_data, catalogue_model, catalogue_profile, catalogue_report  # noqa: F401
from cohortlens.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
