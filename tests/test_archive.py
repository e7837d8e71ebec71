"""Archives whose types change, and pages that open the newest runs only."""

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F, types as T

from rulewatch.plans import reports
from rulewatch.sources.archive import Archive, read_findings, write_findings
from rulewatch.sources.schemas import common_schema, common_type, fit, to_schema

FPS = "fp_id string, test_name string, row_hash string, match_criteria string, marked_by string, marked_at date, note string, active boolean"


@pytest.mark.parametrize("a, b, both", [
    ("int", "int", "int"), ("tinyint", "bigint", "bigint"), ("int", "decimal(5,2)", "decimal(12,2)"), ("decimal(10,4)", "decimal(12,1)", "decimal(15,4)"),
    ("bigint", "decimal(38,30)", "double"), ("bigint", "decimal(38,10)", "decimal(38,10)"), ("float", "int", "double"), ("bigint", "double", "double"), ("double", "string", "string"), ("date", "timestamp", "timestamp"),
    ("date", "int", "string"), ("boolean", "int", "string"), ("void", "date", "date"), ("array<int>", "array<string>", "array<string>"),
    ("struct<a:int>", "struct<a:bigint>", "struct<a:bigint>"), ("struct<a:int>", "struct<b:int>", "string"), ("map<string,int>", "int", "string"),
])
def test_common_types(spark, a, b, both):
    a, b, both = (to_schema(f"x {t}")["x"].dataType for t in (a, b, both))
    assert common_type(a, b).simpleString() == common_type(b, a).simpleString() == both.simpleString()


def test_common_types_hold_every_value(spark):
    """Each side, cast to the common type of all and read as text, is what it was; doubles aside."""
    values = {"int": 2**31 - 1, "bigint": 2**63 - 1, "decimal(9,3)": decimal.Decimal("123456.789"), "string": "x"}
    for a in values:
        for b in values:
            kind = common_type(*(to_schema(f"x {t}")["x"].dataType for t in (a, b)))
            for t in (a, b):
                df = spark.createDataFrame([(values[t],)], f"x {t}")
                got = df.select(F.col("x").cast(kind)).first()[0]
                assert got == values[t] or str(got) == str(values[t])


def test_fit_adds_and_casts(spark):
    schema = common_schema([to_schema("a int, B string"), to_schema("b int, c date")])
    assert schema.simpleString() == "struct<a:int,B:string,c:date>"
    assert fit(spark.createDataFrame([(1,)], "b int"), schema).first() == (None, "1", None)


def day(n, hour=6):
    return dt.datetime(2024, 1, n, hour)


def test_an_archive_whose_types_change_is_read(spark, tmp_path):
    folder = str(tmp_path)
    kinds = ["int", "int", "bigint", "decimal(12,2)", "double", "string", "string", "int"]
    for i, kind in enumerate(kinds):
        write_findings(spark.createDataFrame([(str(i),)], "n string").select(F.col("n").cast(kind), F.lit(f"run {i}").alias("extra" if i % 3 else "note")), folder, "T/1", day(i + 1))
    found = read_findings(spark, folder, "T/1")
    assert found.schema["n"].dataType == T.StringType() and found.count() == len(kinds)
    got = {r.ArchiveDate.day - 1: (r.n, r.extra or r.note) for r in found.collect()}
    assert got == {0: ("0", "run 0"), 1: ("1", "run 1"), 2: ("2", "run 2"), 3: ("3.00", "run 3"), 4: ("4.0", "run 4"), 5: ("5", "run 5"), 6: ("6", "run 6"), 7: ("7", "run 7")}
    # Runs of one type keep it, and a day is still one folder.
    archive = Archive(spark, folder, "T/1")
    assert archive.read([p for *_, p in archive.runs("2024-01-01", "2024-01-03")]).schema["n"].dataType == T.LongType()
    assert len(found.where("archive_dt = DATE '2024-01-03'").inputFiles()) >= 1
    assert found.where("archive_dt = DATE '2024-01-03'").first().n == "2"


def test_neighbouring_runs_of_one_type_stay_in_one_read(spark, tmp_path):
    for i in range(12):
        write_findings(spark.range(1).selectExpr(f"cast(id as {'int' if i < 7 else 'string'}) AS n"), str(tmp_path), "r", day(i + 1))
    archive = Archive(spark, str(tmp_path), "r")
    groups = archive._groups([p for *_, p in reversed(archive.runs())])
    assert sum(map(len, groups)) == 12 and len(groups) <= 5


@pytest.fixture(scope="module")
def long_archive(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("archive"))
    for i in range(1, 21):
        rows = spark.range(10).selectExpr(f"id + {100 * i} AS id", f"if(id % 5 = 0, 'rare {i}', 'common') AS word", "id % 4 = 0 AS _is_false_positive").coalesce(1)
        write_findings(rows, folder, "r", day(i))
    write_findings(spark.range(3).selectExpr("id + 5000 AS id", "'common' AS word", "false AS _is_false_positive").coalesce(1), folder, "r", day(20, 9))
    return folder


def marks(spark):
    return spark.createDataFrame([("F", "r", None, '[{"column":"word","value":"common"}]', "u", dt.date(2024, 1, 1), "", True)], FPS)


@pytest.mark.parametrize("limit, how, folders, more", [
    (5, {"all_dates": True}, 3, True), (13, {"all_dates": True}, 3, True), (25, {"all_dates": True}, 7, True), (34, {"all_dates": True}, 7, True),
    (500, {"all_dates": True}, 21, False), (12, {}, 2, True), (13, {}, 2, False), (3, {"date_from": "2024-01-03", "date_to": "2024-01-05"}, 1, True),
    (3, {"search": "rare"}, 3, True), (500, {"search": "RARE 7"}, 21, False), (4, {"search": "nowhere"}, 21, False),
])
def test_pages_open_only_the_newest_folders(spark, long_archive, limit, how, folders, more):
    archive, fps = Archive(spark, long_archive, "r"), marks(spark)
    want = reports.findings_view(archive.read(), fps, "r", ["id"], limit=limit, **how)
    got, limited = reports.findings_page(archive, fps, "r", ["id"], limit=limit, **how)
    show = lambda df: [(r.id, r.word, r.ArchiveDate, r._is_false_positive) for r in df.collect()]
    assert sorted(show(got)) == sorted(show(want)) and limited == more
    total = reports.in_view(archive.read(), **how).count()
    assert limited == (total > limit)
    summary = reports.page_summary(got, limited).first()
    assert tuple(summary) == tuple(reports.view_summary(want, reports.in_view(archive.read(), **how)).first())
    runs = reports.runs_in_scope(archive, how.get("search"), how.get("date_from"), how.get("date_to"), "all_dates" in how)
    opened, _ = archive.newest(limit, reports.wanted_rows(how.get("search")), runs)
    assert len(opened) == folders
    assert len(got.inputFiles()) <= len(opened)


def test_a_page_of_nothing(spark, tmp_path):
    write_findings(spark.range(0).selectExpr("id", "'x' AS word"), str(tmp_path), "r", day(1))
    got, limited = reports.findings_page(Archive(spark, str(tmp_path), "r"), marks(spark), "r", ["id"], limit=5)
    assert got.count() == 0 and not limited


def test_the_search_index_changes_no_result(spark, long_archive):
    archive, fps = Archive(spark, long_archive, "r"), marks(spark)
    texts = ["rare 7", "RARE 1", "are 1_", "ra%e 12", "705", "9 common", "e", "zz", " % ", "common", "nowhere at all", "r\\_re"]
    plain = {t: sorted(r.id for r in reports.in_view(archive.read(), t).collect()) for t in texts}
    archive.index()
    archive.index()  # nothing is left to do
    assert archive.indexed().count() == len(archive.files())
    for text, want in plain.items():
        got, more = reports.findings_page(archive, fps, "r", ["id"], text, limit=1000)
        assert sorted(r.id for r in got.collect()) == want and not more, text
    # Only files that may hold the text are opened.
    assert len(archive.matching("2003")) == 1 and len(archive.matching("nowhere at all")) == 0
    assert len(archive.matching("rare 7")) == 20  # what touches a space may lie between two values
    assert len(archive.matching("705")) <= 2 and len(archive.matching("e")) == len(archive.files())
    got, _ = reports.findings_page(archive, fps, "r", ["id"], "2003", limit=1000)
    assert len(got.inputFiles()) == 1


def test_files_written_after_the_index_are_searched(spark, tmp_path):
    folder = str(tmp_path)
    write_findings(spark.createDataFrame([("old words", 1)], "a string, n int"), folder, "r", day(1))
    archive = Archive(spark, folder, "r")
    archive.index()
    write_findings(spark.createDataFrame([("new words", 2)], "a string, n int"), folder, "r", day(1))  # the run is repeated
    write_findings(spark.createDataFrame([("other", "2.5")], "a string, n string"), folder, "r", day(2))
    fps = marks(spark)
    ids = lambda text: sorted(r.a for r in reports.findings_page(archive, fps, "r", ["a"], text, limit=9)[0].collect())
    assert ids("old words") == [] and ids("new words") == ["new words"] and ids("2.5") == ["other"]
    archive.index()
    assert ids("old words") == [] and ids("new words") == ["new words"] and ids("2.5") == ["other"] and ids("words") == ["new words"]
