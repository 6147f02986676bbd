"""Connectors against postcode references to a new version of the findings register."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from .. import constants as K
from ..operators.pressure import cp_reference
from ..operators.quality import build_findings, flagged, merge_findings, with_areas, with_verdict
from ..operators.spatial import nearest_join
from ..sources.tables import require_nonempty

_PLACE = ["site_name", "postcode", "latitude", "longitude"]


def judge_points(connectors: DataFrame, references: DataFrame, allowlist: DataFrame,
                 radius_m: float = K.NEAREST_RADIUS_M) -> DataFrame:
    """Every charge point with its areas and verdict."""
    require_nonempty(allowlist, "allowlist of postcode areas")
    placed = nearest_join(cp_reference(connectors, _PLACE), references, radius_m)
    named = placed.withColumnRenamed("nearest_postcode", "coord_postcode")
    return with_verdict(with_areas(named), allowlist)


def run_postcode_check(connectors: DataFrame, references: DataFrame, allowlist: DataFrame,
                       register: DataFrame, now: Column, check: str = K.POSTCODE_CHECK,
                       radius_m: float = K.NEAREST_RADIUS_M) -> DataFrame:
    """The complete register after this run."""
    judged = judge_points(connectors, references, allowlist, radius_m)
    return merge_findings(register, build_findings(flagged(judged), check), now, check)
