"""Finding sets: fingerprints, false positives, counts.

A finding table holds the rows that rules returned.  ``keys`` name the rule and
the run a row belongs to; all other columns are the finding itself.  Everything
here treats all rules and all runs in one plan.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, functions as F

from rulewatch.functions.hashing import fp_row_hash, row_hash
from rulewatch.operators.joins import lookup_join

# The fingerprint reads a SHA-256 in 4 slices of 14 hex digits and sums their halves.
# Sums are decimals of 38 digits, so no number of findings overflows them.
SLICES, SLICE_DIGITS, HALF_BITS = 4, 14, 28
SUM = "decimal(38,0)"

CRITERIA = "array<struct<column:string,value:string>>"
WHOLE_ROW = "#row"  # stands for "the hash of the whole row" among criteria columns


def with_row_hash(findings: DataFrame, keys: list[str], name: str = "row_hash") -> DataFrame:
    return findings.withColumn(name, row_hash([c for c in findings.columns if c not in keys]))


def _halves(column: str) -> dict[str, Column]:
    """The halves of every slice of a hash, as numbers."""
    halves = {}
    for i in range(SLICES):
        digits = F.substring(column, 1 + i * SLICE_DIGITS, SLICE_DIGITS)
        number = F.conv(digits, 16, 10).cast("bigint")
        halves[f"_high{i}"] = F.shiftright(number, HALF_BITS)
        halves[f"_low{i}"] = number.bitwiseAND(F.lit((1 << HALF_BITS) - 1))
    return halves


def fingerprint(
    hashed: DataFrame, keys: list[str], copies: Column | None = None, **more: Column
) -> DataFrame:
    """Row count and order-free fingerprint per key, from rows with a ``row_hash``.

    Equal multisets of rows have equal fingerprints.  Sums combine before the
    shuffle, so a rule with a huge finding set costs one small row per task.
    224 bits of the row hashes take part; unlike SHA-256 over the sorted rows it
    does not resist someone who builds rows in order to collide.  ``copies`` says
    how many findings a row stands for; ``more`` adds aggregates of the same pass.
    """
    copies = F.lit(1).cast("bigint") if copies is None else copies
    halves = _halves("row_hash")
    sums = hashed.groupBy(*keys).agg(
        F.sum(copies).alias("row_count"),
        *[column.alias(name) for name, column in more.items()],
        *[F.sum((half * copies).cast(SUM)).cast(SUM).alias(name) for name, half in halves.items()],
    )
    return sums.select(
        *keys,
        "row_count",
        *more,
        F.sha2(F.concat_ws(":", "row_count", *halves), 256).alias("incident_hash"),
    )


def set_sums(row_hash: str = "_row_hash", flag: str = "_is_false_positive") -> dict[str, Column]:
    """What a job that writes flagged findings must sum for their counts and fingerprint."""
    sums = {name: F.sum(half.cast(SUM)).cast(SUM) for name, half in _halves(row_hash).items()}
    return {"row_count": F.count(F.lit(1)), "clean_count": F.count_if(~F.col(flag)), **sums}


SUMS_DDL = "row_count long, clean_count long, " + ", ".join(f"_{half}{i} {SUM}" for i in range(SLICES) for half in ("high", "low"))


def summed_hash() -> Column:
    """The fingerprint from a row of such sums; NULL for a set without findings."""
    return F.when(F.col("row_count") > 0, F.sha2(F.concat_ws(":", "row_count", *_halves("row_count")), 256))


def set_hash(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Count and fingerprint of each finding set."""
    return fingerprint(with_row_hash(findings, keys).select(*keys, "row_hash"), keys)


def fp_lookup(false_positives: DataFrame) -> DataFrame:
    """Active false positives as lookup rows ``(test_name, names, wanted) -> fp``.

    ``names`` are the criteria columns in name order and ``wanted`` their values.
    Criteria that are missing, empty or unreadable fall back to the row hash; without
    one the wanted hash is NULL, which no row has.  Of several with the same criteria
    the first marked one is kept.
    """
    is_list = F.ltrim("match_criteria").startswith("[")  # a single object is not a list of criteria
    parsed = F.when(is_list, F.from_json("match_criteria", CRITERIA))
    active = false_positives.where(F.col("active")).withColumn("_c", F.array_sort(parsed))
    has_criteria = F.coalesce(F.size("_c"), F.lit(0)) > 0
    names = F.when(has_criteria, F.transform("_c", lambda c: F.coalesce(c["column"], F.lit(""))))
    values = F.when(has_criteria, F.transform("_c", lambda c: F.coalesce(c["value"], F.lit(""))))
    rows = active.select(
        "test_name",
        F.coalesce(names, F.array(F.lit(WHOLE_ROW))).alias("names"),
        F.coalesce(values, F.array(F.nullif(F.col("row_hash"), F.lit("")))).alias("wanted"),
        F.struct("marked_at", "fp_id", "note", "marked_by").alias("fp"),
    )
    return rows.groupBy("test_name", "names", "wanted").agg(F.min("fp").alias("fp"))


def _with_matches(
    contents: DataFrame, false_positives: DataFrame, columns: list[str], how: str, rule: str | None = None
) -> DataFrame:
    """``contents`` joined to the false positives they match, as ``fp``.

    ``contents`` has ``test_name``, ``fp_hash`` and the finding's ``columns``.  A row
    comes once per set of criteria columns its rule uses, not once per false
    positive.  Criteria on a column the rule does not return never match.
    """
    lookup = fp_lookup(false_positives)
    # The sets of one to three columns that the false positives of a rule use, and
    # where their values stand among a row's cells.
    cell_names = F.array(*[F.lit(c) for c in columns], F.lit(WHOLE_ROW))
    shapes = (
        lookup.select("test_name", "names")
        .distinct()
        .withColumn("_places", F.transform("names", lambda n: F.array_position(cell_names, n).cast("int")))
        .where(F.forall("_places", lambda p: p > 0))
    )
    contents = contents.withColumnRenamed("cells", "_cells")
    if rule is None:
        asked = contents.join(shapes, "test_name", how)
    else:  # a handful of column sets: with one rule there is no key to join them by
        known = shapes.agg(F.collect_list(F.struct("names", "_places"))).scalar()
        asked = contents.select("*", F.inline(known))
        lookup = lookup.drop("test_name")
    asked = (
        asked
        .withColumn("wanted", F.transform("_places", lambda p: F.element_at("_cells", p)))
        .drop("_cells", "_places")
    )
    return lookup_join(asked, lookup, [c for c in ("test_name", "names", "wanted") if c in lookup.columns], how)


def _cells(columns: list[str]) -> Column:
    """A finding as text, cell by cell, with the hash of the whole row at the end."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]
    return F.array(*cells, F.col("fp_hash"))


def fp_matches(
    findings: DataFrame, false_positives: DataFrame, keys: list[str], rule: str | None = None
) -> DataFrame:
    """First matching false positive per distinct finding content.

    Gives ``(test_name, fp_hash, fp)``, or ``(fp_hash, fp)`` for the findings of one ``rule``.  A finding matches when all criteria of
    any active false positive equal its values as text, NULL being ''.  Contents are
    told apart by that text, so findings may hold maps, structs and lists.
    """
    columns = [c for c in findings.columns if c not in keys]
    hashed = findings.withColumn("fp_hash", fp_row_hash(columns))
    by = ["fp_hash"] if rule is not None else ["test_name", "fp_hash"]
    contents = hashed.select(*by, _cells(columns).alias("cells")).distinct()
    hits = _with_matches(contents, false_positives, columns, "inner", rule)
    return hits.groupBy(*by).agg(F.min("fp").alias("fp"))


def flag_false_positives(
    findings: DataFrame, false_positives: DataFrame, keys: list[str], attribute: bool = False, rule: str | None = None
) -> DataFrame:
    """Findings plus ``_is_false_positive`` and, on request, who marked it and why.

    Findings name their rule in ``test_name``, unless they are all of one ``rule``.

    Findings are read twice, for the contents and for the rows: give a stored table,
    not the body of a rule.
    """
    columns = [c for c in findings.columns if c not in keys]
    if rule is not None:
        false_positives = false_positives.where(F.col("test_name") == rule)
    matches = fp_matches(findings, false_positives, keys, rule)
    by = [c for c in matches.columns if c != "fp"]
    flagged = findings.withColumn("fp_hash", fp_row_hash(columns)).join(matches, by, "left")
    extra = []
    if attribute:
        extra = [
            F.col(f"fp.{f}").alias(f"_{a}")
            for f, a in (("fp_id", "fp_id"), ("note", "fp_note"), ("marked_by", "fp_marked_by"), ("marked_at", "fp_marked_at"))
        ]
    return flagged.select(
        *findings.columns, F.col("fp").isNotNull().alias("_is_false_positive"), *extra
    )


def criteria_shapes(false_positives: DataFrame) -> dict[str, list[list[str]]]:
    """The sets of columns that each rule's active false positives ask for: a few for each rule."""
    found = fp_lookup(false_positives).select("test_name", "names").distinct().collect()
    shapes: dict[str, list[list[str]]] = {}
    for r in sorted(found, key=lambda r: (r["test_name"] or "", r["names"])):
        shapes.setdefault(r["test_name"], []).append(r["names"])
    return shapes


def flag_in_one_pass(findings: DataFrame, false_positives: DataFrame, rule: str, shapes: list[list[str]]) -> DataFrame:
    """``findings`` of one rule with ``_is_false_positive``, read once.

    One look-up for each set of criteria columns: a broadcast while Spark measures the false positives small.
    The findings' own order and columns stay; a set with an unknown column matches nothing.
    """
    columns = list(findings.columns)
    lookup = fp_lookup(false_positives.where(F.col("test_name") == rule))
    flagged, hits = findings.withColumn("_fp_hash", fp_row_hash(columns)), []
    for i, names in enumerate(shapes):
        if not set(names) <= {*columns, WHOLE_ROW}:
            continue
        cells = [F.col("_fp_hash") if n == WHOLE_ROW else F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names]
        wanted = lookup.where(F.col("names") == F.array(*map(F.lit, names))).select(F.col("wanted").alias(f"_wanted{i}")).distinct()
        flagged = flagged.withColumn(f"_cells{i}", F.array(*cells))
        flagged = flagged.join(wanted, F.col(f"_cells{i}") == F.col(f"_wanted{i}"), "left")
        hits.append(F.col(f"_wanted{i}").isNotNull())
    hit = functools.reduce(operator.or_, hits, F.lit(False))
    return flagged.select(*[F.col(f"`{c}`") for c in columns], hit.alias("_is_false_positive"))


def run_counts(findings: DataFrame, false_positives: DataFrame, keys: list[str]) -> DataFrame:
    """Raw count, clean count and fingerprint of every run, over all rules at once.

    Copies of a finding are merged first, so a group of copies costs one row per
    task before anything is shuffled, matched or hashed.
    """
    columns = [c for c in findings.columns if c not in keys]
    contents = findings.groupBy(*findings.columns).agg(F.count(F.lit(1)).alias("_copies"))
    hashed = contents.withColumn("fp_hash", fp_row_hash(columns)).withColumn("cells", _cells(columns))
    matched = _with_matches(hashed, false_positives, columns, "left")
    flagged = matched.groupBy(*findings.columns).agg(
        F.max("_copies").alias("copies"), F.bool_or(F.col("fp").isNotNull()).alias("is_fp")
    )
    clean = F.sum(F.when(F.col("is_fp"), F.lit(0)).otherwise(F.col("copies")))
    hashed = flagged.select(*keys, "copies", "is_fp", row_hash(columns).alias("row_hash"))
    return fingerprint(hashed, keys, F.col("copies"), clean_count=clean)


def count_hashed(hashed: DataFrame, keys: list[str]) -> DataFrame:
    """The same for archived rows, which carry ``row_hash`` and their stored flag."""
    return fingerprint(hashed, keys, clean_count=F.count_if(~F.col("_is_false_positive")))


def run_result(clean_count: Column, threshold: Column) -> Column:
    """FAILED only above the threshold; at it the run passes."""
    return F.when(clean_count > threshold, "FAILED").otherwise("PASSED")
