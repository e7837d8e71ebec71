"""Date checks on registered assets, written as a SQL rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rulewatch.functions.values import DAY_FIRST, YEAR_FIRST
from rulewatch.rules.registry import rule, sql_rule

DUE_BEFORE_REGISTRY = """
    WITH parsed AS (
      SELECT AssetId, TypeAssetId, StatusAssetId, RegistryDttm, DueDt,
             try_cast(regexp_replace(cast(RegistryDttm AS string), :day_first, :year_first) AS date) AS registry_date,
             try_cast(regexp_replace(cast(DueDt AS string), :day_first, :year_first) AS date) AS due_date
      FROM {asset}
    )
    SELECT AssetId,
           TypeAssetId,
           coalesce(TypeAssetName, cast(TypeAssetId AS string)) AS TypeAssetName,
           StatusAssetId,
           RegistryDttm AS Registry_orig,
           DueDt AS Due_orig,
           registry_date AS RegistryDate_parsed,
           due_date AS DueDate_parsed,
           datediff(due_date, registry_date) AS Days_Due_minus_Registry,
           :moment AS moment
    FROM parsed LEFT JOIN {asset_type} USING (TypeAssetId)
    WHERE due_date < registry_date
      AND CASE WHEN :new_stock THEN registry_date > :cutoff ELSE registry_date <= :cutoff END
"""


def _due_before_registry(tables, cutoff, types: tuple[int, ...], new_stock: bool, moment: str) -> DataFrame:
    return sql_rule(
        tables["asset"].sparkSession,
        DUE_BEFORE_REGISTRY,
        {
            "asset": tables["asset"].where(F.col("TypeAssetId").isin(*types)),
            "asset_type": tables["asset_type"].select("TypeAssetId", "TypeAssetName"),
        },
        {
            "day_first": DAY_FIRST,
            "year_first": YEAR_FIRST,
            "moment": moment,
            "new_stock": new_stock,
            "cutoff": cutoff,
        },
    )


@rule("due_before_registry_new", ("asset", "asset_type"))
def due_before_registry_new(tables, as_of, cutoff, moment: str = "AFTER") -> DataFrame:
    """Notes of types 1 and 39 registered after the cut-off and due before that."""
    return _due_before_registry(tables, cutoff, (1, 39), True, moment)


@rule("due_before_registry_old", ("asset", "asset_type"))
def due_before_registry_old(tables, as_of, cutoff, moment: str = "UNTIL") -> DataFrame:
    """The same, registered up to the cut-off."""
    return _due_before_registry(tables, cutoff, (1, 39), False, moment)


@rule("due_before_registry_new_type2", ("asset", "asset_type"))
def due_before_registry_new_type2(tables, as_of, cutoff, moment: str = "AFTER") -> DataFrame:
    """Notes of type 2 registered after the cut-off."""
    return _due_before_registry(tables, cutoff, (2,), True, moment)


@rule("due_before_registry_old_type2", ("asset", "asset_type"))
def due_before_registry_old_type2(tables, as_of, cutoff, moment: str = "UNTIL") -> DataFrame:
    """Notes of type 2 registered up to the cut-off."""
    return _due_before_registry(tables, cutoff, (2,), False, moment)
