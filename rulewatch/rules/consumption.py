"""Unusual peaks in paid look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rulewatch.functions.calendar import business_friday, day, is_weekday
from rulewatch.rules.registry import rule


def weekly_volume(tables) -> DataFrame:
    """Look-ups and their price per client and business week, cached ones left out.

    ``contract_price`` names the paid contracts and the price of one look-up.  Prices are
    decimals, so their sum does not depend on how rows arrive.
    """
    prices = tables["contract_price"].select("DataContractId", F.col("UnitPriceAmt").cast("decimal(18,6)").alias("_price"))
    look_ups = tables["external_search"].where(F.col("UrlParsedName") != "cache")
    return (
        tables["assessment"]
        .where(is_weekday(F.col("CreatedAtDttm")) & F.col("ClientCd").isNotNull())
        .select("AssessmentId", "ClientCd", business_friday(F.col("CreatedAtDttm")).alias("Week"))
        .join(look_ups.select("AssessmentId", "DataContractId").join(prices, "DataContractId"), "AssessmentId")
        .groupBy("ClientCd", "Week")
        .agg(
            F.sum("_price").cast("double").alias("AssessmentTotalValueAmt"),
            F.count(F.lit(1)).alias("AssessmentTotalQty"),
        )
    )


@rule("consumption_peak", ("assessment", "external_search", "contract_price"))
def consumption_peak(
    tables, as_of, rise: float = 0.25, minimum: float = 25_000.0
) -> DataFrame:
    """Clients whose week is a quarter above their best earlier week, and large.

    Only the week of ``as_of`` is judged, so its peak before is a conditional
    maximum: no window over a client's weeks.  A first week has no earlier peak
    and never alerts.
    """
    this_week = business_friday(day(as_of))
    value, week = F.col("AssessmentTotalValueAmt"), F.col("Week")
    clients = (
        weekly_volume(tables)
        .where(week <= this_week)
        .groupBy("ClientCd")
        .agg(
            F.max(F.when(week < this_week, value)).alias("peak"),
            F.max(F.when(week == this_week, value)).alias("AssessmentTotalValueAmt"),
            F.max(F.when(week == this_week, F.col("AssessmentTotalQty"))).alias("AssessmentTotalQty"),
        )
    )
    grown = F.try_divide(value - F.col("peak"), F.col("peak")) >= rise
    return clients.where(grown & (value >= minimum)).select(
        "ClientCd", this_week.alias("CreatedAtDttm"), "AssessmentTotalValueAmt", "AssessmentTotalQty"
    )
