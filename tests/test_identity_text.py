import uuid

from pyspark.sql import functions as F

from opsweave.functions import identity as ID
from opsweave.functions import text as T


def test_uuid5_equals_python(spark):
    names = ["", "a", "run:1:x", "naïve-名前", "x" * 300]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.u for r in df.select("n", ID.uuid5(ID.INCIDENT_NAMESPACE, F.col("n")).alias("u")).collect()}
    assert got == {n: str(uuid.uuid5(ID.INCIDENT_NAMESPACE, n)) for n in names}


def test_joined_keeps_empty_parts(spark):
    row = spark.range(1).select(ID.joined(F.lit("a"), F.lit(None).cast("string"), F.lit("b")).alias("s")).first()
    assert row.s == "a||b"


def test_iso_utc(spark):
    df = spark.sql("select timestamp'2024-01-01 00:00:00' a, timestamp'2024-01-01 00:00:00.5' b")
    row = df.select(ID.iso_utc(F.col("a")).alias("a"), ID.iso_utc(F.col("b")).alias("b")).first()
    assert (row.a, row.b) == ("2024-01-01T00:00:00+00:00", "2024-01-01T00:00:00.500000+00:00")


def test_message_hygiene(spark):
    cases = {
        "plain\n  text": "plain text",
        "Traceback (most recent)": "Operation failed",
        "the api-key leaked": "Operation failed",
        "see /etc/passwd": "Operation failed",
        "C:\\temp\\x": "Operation failed",
        "at 0x7fab": "Operation failed",
        "<Foo object>": "Operation failed",
        '{"a": 1}': "Operation failed",
        "y" * 600: "y" * 497 + "...",
        "  ": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "m string")
    got = {r.m: r.s for r in df.select("m", T.sanitise_message(F.col("m")).alias("s")).collect()}
    assert got == cases


def test_config_scan(spark):
    docs = ['{"a":{"Password":"x"}}', '{"a":["Bearer abc"]}', '{"a":1}', '{"x":{"my_f1_score_value":1}}', '{"note":"predictions"}', '{"p\\u0061ssword":1}']
    df = spark.createDataFrame(list(enumerate(docs)), "i int, d string")
    rows = df.select("i", T.secret_in_json(F.col("d")).alias("s"), T.measured_key_in_json(F.col("d")).alias("m")).orderBy("i").collect()
    assert [r.s for r in rows] == [True, True, False, False, False, True]
    assert [r.m for r in rows] == [False, False, False, True, False, False]


def test_uuid_forms(spark):
    plain = "123E4567-e89b-12d3-a456-426614174000"
    forms = [plain, "{" + plain + "}", "urn:uuid:" + plain, plain.replace("-", ""), plain[:-1], plain.replace("-", "", 1), "{" + plain, "x" + plain]
    df = spark.createDataFrame([(f,) for f in forms], "t string")
    rows = df.select(ID.is_uuid(F.col("t")).alias("ok"), ID.canonical_uuid(F.col("t")).alias("c")).collect()
    assert [r.ok for r in rows] == [True] * 4 + [False] * 4
    assert {r.c for r in rows[:4]} == {plain.lower()}
