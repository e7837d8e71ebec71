"""Registration checks on participants."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rulewatch.functions.calendar import day, in_last_month
from rulewatch.operators.grouping import count_values, first_per_key, values_of
from rulewatch.operators.joins import in_any_list, lookup_join, without
from rulewatch.rules.registry import rule

FUNDS = ("fi_registration", "fund_registration")


def active_participants(tables) -> DataFrame:
    return tables["participant"].where(F.col("StatusId").cast("string") == "1")


def not_a_fund(df: DataFrame, tables, fi_column: str = "CvmCd") -> DataFrame:
    """Rows whose document is in neither fund registry.

    A registry row counts only if its own identifier is filled.
    """
    for name, filled in (("fi_registration", fi_column), ("fund_registration", "FundRegistrationId")):
        registered = tables[name].where(F.col(filled).isNotNull())
        df = without(df, registered.select(F.col("FundDocumentCd").alias("DocumentNumberCd")), "DocumentNumberCd")
    return df


def _new_with_company(tables, as_of, fi_column: str = "CvmCd") -> DataFrame:
    """Last month's active participants that are no funds, with their company's start."""
    new = active_participants(tables).where(in_last_month("CreatedAtDttm", as_of))
    company = tables["establishment"].select(
        F.col("DocumentCd").alias("DocumentNumberCd"), "ActivityStartDt"
    )
    # An age filter follows, which no participant without a company passes.
    return not_a_fund(new, tables, fi_column).join(company, "DocumentNumberCd")


@rule("young_participants", ("participant", "establishment", *FUNDS))
def young_participants(tables, as_of, max_days: int = 365) -> DataFrame:
    """New participants whose company is at most ``max_days`` old at ``as_of``."""
    return (
        _new_with_company(tables, as_of)
        .withColumn("DaysDifference", F.datediff(day(as_of), "ActivityStartDt"))
        .where(F.col("DaysDifference") <= max_days)
        .select(
            "DocumentNumberCd",
            "ParticipantId",
            "ParticipantName",
            F.col("ActivityStartDt").alias("CompanyActivityStartDt"),
            F.col("CreatedAtDttm").alias("ParticipantCreatedAt"),
            "DaysDifference",
        )
    )


def _joined_near_start(tables, as_of, max_days: int, fi_column: str) -> DataFrame:
    return (
        _new_with_company(tables, as_of, fi_column)
        .withColumn("DaysDifference", F.datediff("CreatedAtDttm", "ActivityStartDt"))
        .where(F.col("DaysDifference") <= max_days)
        .select(
            "DocumentNumberCd",
            "ParticipantId",
            "ParticipantName",
            # Always NULL: rows with either identifier are left out above.
            F.lit(None).cast("string").alias("FiCvmCd" if fi_column == "CvmCd" else fi_column),
            F.lit(None).cast("string").alias("FundRegistrationId"),
            "ActivityStartDt",
            "CreatedAtDttm",
            "DaysDifference",
        )
    )


@rule("joined_near_start", ("participant", "establishment", *FUNDS))
def joined_near_start(tables, as_of, max_days: int = 30) -> DataFrame:
    """New participants that joined within ``max_days`` of their company's start.

    Joining before the start (a negative difference) counts too.
    """
    return _joined_near_start(tables, as_of, max_days, "CvmCd")


@rule("joined_near_start_v2", ("participant", "establishment", *FUNDS))
def joined_near_start_v2(tables, as_of, max_days: int = 30) -> DataFrame:
    """The same age test, with funds known by their registered name."""
    return _joined_near_start(tables, as_of, max_days, "FundSocialName")


@rule("wrong_fund_nature", ("participant", "participant_nature", "nature", *FUNDS))
def wrong_fund_nature(tables, as_of, fund_nature: str = "FIDC") -> DataFrame:
    """Active participants of the fund nature that no fund registry knows."""
    nature = tables["nature"].where(F.col("DescriptionDesc") == fund_nature)
    links = tables["participant_nature"].where(F.col("StatusId") == 1)
    of_nature = lookup_join(
        links.select("ParticipantId", "NatureOperationId"),
        nature.select("NatureOperationId", "DescriptionDesc"),
        ["NatureOperationId"],
        "inner",
    )
    return (
        not_a_fund(active_participants(tables), tables)
        .join(of_nature, "ParticipantId")
        .select(
            "DocumentNumberCd",
            "ParticipantId",
            "ParticipantName",
            "NatureOperationId",
            "DescriptionDesc",
            "CreatedAtDttm",
            F.lit(None).cast("string").alias("FiCvmCd"),
            F.lit(None).cast("string").alias("FundRegistrationId"),
        )
    )


@rule("duplicate_documents", ("participant",))
def duplicate_documents(tables, as_of) -> DataFrame:
    """Documents shared by more than one active participant."""
    return (
        active_participants(tables)
        .select("DocumentNumberCd", "ParticipantId")
        .distinct()
        .groupBy("DocumentNumberCd")
        .agg(F.count("ParticipantId").alias("CountParticipantId"))
        .where(F.col("CountParticipantId") > 1)
    )


# Each list with its result column, its document column and what its label is made of.
SANCTION_LISTS = (
    ("ceis", "CEISIncidence", "SanctionedCpfOrCnpjCd", ("SanctionCodeCd", "SanctionCategoryDesc")),
    ("cepim", "CEPIMIncidence", "EntityCnpjCd", ("AgreementNum", "GrantingAgencyDesc")),
    ("cnep", "CNEPIncidence", "SanctionedCpfOrCnpjCd", ("SanctionCodeCd", "SanctionCategoryDesc")),
    ("leniency", "LeniencyIncidence", "SanctionedCompanyCnpjCd", ("ProcessNum", "SanctioningOfficeDesc")),
)


@rule("sanctions", ("participant", "ceis", "cepim", "cnep", "leniency"))
def sanctions(tables, as_of) -> DataFrame:
    """Active participants on any of four sanction lists, one row per document."""
    people = active_participants(tables).select(
        "ParticipantId", "DocumentNumberCd", "ParticipantName", "StatusId"
    )
    lists = {
        label: (
            tables[name].select(
                F.col(document).alias("DocumentNumberCd"), F.concat_ws("-", *parts).alias(label)
            ),
            label,
        )
        for name, label, document, parts in SANCTION_LISTS
    }
    hits = in_any_list(people, "DocumentNumberCd", lists)
    return first_per_key(hits, ["DocumentNumberCd"], ["ParticipantId"])


@rule("unmatched_document", ("participant", "establishment"))
def unmatched_document(tables, as_of) -> DataFrame:
    """Active participants whose document no establishment has."""
    known = tables["establishment"].where(F.col("RootDocumentCd").isNotNull())
    return without(
        active_participants(tables),
        known.select(F.col("DocumentCd").alias("DocumentNumberCd")),
        "DocumentNumberCd",
    ).select(
        "DocumentNumberCd",
        "ParticipantId",
        "ParticipantName",
        "DocumentTypeId",
        "CreatedAtDttm",
        "CreatedById",
        F.lit(None).cast("string").alias("RootDocumentCd"),
    )


@rule(
    "inactive_registration",
    ("participant", "establishment", "status_reason", "participant_nature", "nature"),
)
def inactive_registration(tables, as_of, active_code: str = "00") -> DataFrame:
    """Active participants whose registration status is not the active one.

    Their natures of operation are counted; the names are the rows of
    :func:`inactive_registration_natures`.
    """
    people = active_participants(tables).select(
        "ParticipantId", "DocumentNumberCd", "ParticipantName", "StatusId"
    )
    inactive = (
        tables["establishment"]
        .where(F.col("RegistrationStatusReasonCd") != active_code)
        .select(
            F.col("DocumentCd").alias("DocumentNumberCd"),
            "RegistrationStatusReasonCd",
            "RegistrationStatusDt",
        )
    )
    reasons = tables["status_reason"].select("RegistrationStatusReasonCd", "RegistrationStatusReasonDesc")
    found = lookup_join(people.join(inactive, "DocumentNumberCd"), reasons, ["RegistrationStatusReasonCd"])
    counts = count_values(_natures(tables), ["ParticipantId"], "DescriptionDesc", "NatureCount")
    return found.join(counts, "ParticipantId", "left").select(
        "ParticipantId",
        "DocumentNumberCd",
        "ParticipantName",
        "StatusId",
        "RegistrationStatusDt",
        F.coalesce("NatureCount", F.lit(0)).alias("NatureCount"),
        "RegistrationStatusReasonCd",
        "RegistrationStatusReasonDesc",
    )


def inactive_registration_natures(tables, as_of, active_code: str = "00") -> DataFrame:
    """The natures of the participants that :func:`inactive_registration` finds, one row each."""
    found = inactive_registration(tables, as_of, active_code)
    return values_of(_natures(tables), found, ["ParticipantId"], "DescriptionDesc")


def _natures(tables) -> DataFrame:
    """Participants by their active natures of operation."""
    natures = tables["nature"].where(F.col("StatusCd") == "1").select("NatureOperationId", "DescriptionDesc")
    links = tables["participant_nature"].select("ParticipantId", "NatureOperationId")
    return lookup_join(links, natures, ["NatureOperationId"], "inner")


@rule("invalid_email", ("participant",))
def invalid_email(tables, as_of, marker: str) -> DataFrame:
    """Active participants with no e-mail, or one that contains the marker."""
    return (
        active_participants(tables)
        .where(F.col("EmailName").contains(marker) | F.col("EmailName").isNull())
        .select("ParticipantId", "DocumentNumberCd", "ParticipantName", "EmailName", "CreatedAtDttm", "CreatedById")
    )


# Digit runs no real number has (fixed values).
FAKE_DIGITS = "12345|00000|11111|22222|33333|44444|55555|66666|77777|88888|99999"


@rule("invalid_phone", ("participant",))
def invalid_phone(tables, as_of, min_length: int = 8) -> DataFrame:
    """Active participants with a missing, short or made-up phone number."""
    phone = F.col("Phone1Num")
    invalid = phone.isNull() | (F.length(phone) < min_length) | phone.rlike(FAKE_DIGITS)
    return active_participants(tables).where(invalid)
