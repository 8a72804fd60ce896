"""Patient-cohort analytics on Spark DataFrames.

``sources``    clinical event tables, concept-set definitions, staged tables
``functions``  column expressions: dates, suppression of small cells
``operators``  concept sets, event selection, distributions and counts
``plans``      the five reports, built from the operators
"""

from cohortspan.plans.reports import REPORTS, CohortSpec
from cohortspan.sources.cdm import Cdm

__all__ = ["Cdm", "CohortSpec", "REPORTS"]
