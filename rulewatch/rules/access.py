"""Checks on application users and their sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rulewatch.functions.calendar import in_last_month
from rulewatch.operators.grouping import count_values, values_of
from rulewatch.operators.joins import lookup_join
from rulewatch.rules.registry import rule

USER = ["UserId", "EmailAddressTxt", "UserName"]


@rule("sso_bypass", ("user", "user_company", "company"))
def sso_bypass(tables, as_of, domain: str, marker: str) -> DataFrame:
    """Active internal users linked to no internal company, with the ones they have.

    ``domain`` is a pattern of internal e-mail addresses, ``marker`` a part of the
    internal companies' names.  The names are the rows of :func:`sso_bypass_companies`.
    """
    companies = _companies(tables, domain)
    has_internal = F.bool_or(F.lower("CorporateName").contains(marker.lower()))
    return count_values(
        companies, USER, "CorporateName", "CompanyCount", having=~F.coalesce(has_internal, F.lit(False))
    )


def sso_bypass_companies(tables, as_of, domain: str, marker: str) -> DataFrame:
    """The companies of the users that :func:`sso_bypass` finds, one row each."""
    return values_of(_companies(tables, domain), sso_bypass(tables, as_of, domain, marker), ["UserId"], "CorporateName")


def _companies(tables, domain: str) -> DataFrame:
    """Active internal users with the names of their companies; NULL if they have none."""
    users = (
        tables["user"]
        .where((F.col("StatusId") == 1) & F.lower("EmailAddressTxt").rlike(domain))
        .groupBy("UserId")
        .agg(F.min("EmailAddressTxt").alias("EmailAddressTxt"), F.min("UserName").alias("UserName"))
    )
    links = tables["user_company"].select("UserId", "CompanyId").distinct()
    companies = tables["company"].select("CompanyId", "CorporateName")
    return lookup_join(users.join(links, "UserId", "left"), companies, ["CompanyId"])


@rule("many_ips", ("historic", "user"))
def many_ips(tables, as_of, max_ips: int = 3) -> DataFrame:
    """User days of last month with more than ``max_ips`` addresses.

    The user id is read from the log text.  The addresses are the rows of
    :func:`many_ips_addresses`.
    """
    found = count_values(
        _seen(tables, as_of), ["UserId", "Date"], "CreatedByIpCd", "DistinctIPCount",
        having=F.count("CreatedByIpCd") > max_ips,
    )
    mails = (
        tables["user"]
        .where(F.col("EmailAddressTxt").isNotNull())
        .select(F.col("UserId").cast("string").alias("UserId"), "EmailAddressTxt")
        .distinct()
    )
    return found.join(mails, "UserId").select("EmailAddressTxt", "UserId", "Date", "DistinctIPCount")


def many_ips_addresses(tables, as_of, max_ips: int = 3) -> DataFrame:
    """The addresses of the user days that :func:`many_ips` finds, one row each."""
    return values_of(_seen(tables, as_of), many_ips(tables, as_of, max_ips), ["UserId", "Date"], "CreatedByIpCd")


def _seen(tables, as_of) -> DataFrame:
    """User, day and address of last month's log entries that have all three."""
    user_id = F.trim(F.regexp_extract("DescriptionTxt", r"user/participant id:\s*([^\]]+)\]", 1))
    return (
        tables["historic"]
        .where(in_last_month("CreatedAtDttm", as_of))
        .select(
            F.nullif(user_id, F.lit("")).alias("UserId"),
            "CreatedByIpCd",
            F.to_date("CreatedAtDttm").alias("Date"),
        )
        .na.drop(subset=["UserId", "CreatedByIpCd", "Date"])
    )
