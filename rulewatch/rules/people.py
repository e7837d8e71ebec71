"""Checks on employees."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rulewatch.functions.calendar import day
from rulewatch.operators.joins import lookup_join, without
from rulewatch.rules.participants import active_participants
from rulewatch.rules.registry import rule


@rule(
    "employee_partners",
    ("employee", "associate", "public_company", "establishment", "participant", "partner_exception"),
)
def employee_partners(tables, as_of, own_document: str) -> DataFrame:
    """Employees whose name is a partner's of a company with active participants.

    Names are compared in upper case.  One row per employee, partner entry,
    establishment and participant, as the chain of matches gives them; pairs in
    ``partner_exception`` and the house's own document are left out.  Input and result columns are fixed
    values.
    """
    partners = tables["employee"].select(
        "CorporateEmail", F.upper("EmployeeName").alias("AssociateName"), "DepartmentName", "ManagementClassName", "HireDate"
    ).join(
        tables["associate"].select(
            F.upper("AssociateName").alias("AssociateName"), "AssociateQualificationCd", "AssociateDocumentCd", "RootDocumentCd"
        ),
        "AssociateName",
    )
    people = active_participants(tables).select(
        "ParticipantId",
        F.col("DocumentNumberCd").alias("DocumentCd"),
        F.upper("ParticipantName").alias("ParticipantName"),
        "CreatedAtDttm",
        "CreatedById",
    )
    # Few employees are partners: their roots cut the registry down before it meets
    # the participants.
    sites = (
        tables["establishment"]
        .select("RootDocumentCd", "DocumentCd")
        .where(F.col("DocumentCd").cast("string") != own_document)
    )
    companies = tables["public_company"].select("RootDocumentCd", "CompanyName")
    named_sites = lookup_join(partners.join(sites, "RootDocumentCd"), companies, ["RootDocumentCd"])
    found = named_sites.join(people, "DocumentCd")
    known = tables["partner_exception"].select(
        F.upper("AssociateName").alias("AssociateName"), F.upper("ParticipantName").alias("ParticipantName")
    )
    return without(found, known, ["AssociateName", "ParticipantName"])


@rule("overdue_training", ("hr_employee", "training"))
def overdue_training(tables, as_of, hired_since: str, grace_days: int = 30) -> DataFrame:
    """Employees past the grace period with an open, or no, mandatory training; columns are fixed values."""
    employees = (
        tables["hr_employee"]
        .where(F.col("AdmissionDate") >= F.to_date(F.lit(hired_since)))
        .withColumn("DateDifference", F.datediff(day(as_of), "AdmissionDate"))
        .where(F.col("DateDifference") >= grace_days)
        .select(
            F.lower("CorporateEmail").alias("Email"), "Name", "AdmissionDate", "DepartmentName", "DateDifference"
        )
    )
    return (
        employees.join(tables["training"], "Email", "left")
        .where(F.col("CompletionDate").isNull())
        .select(
            "Email", "Name", "AdmissionDate", "DepartmentName", "ModuleName",
            "StartDate", "CompletionDate", "Status", "DateDifference",
        )
    )
