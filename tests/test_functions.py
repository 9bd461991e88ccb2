"""Column functions on small tables of cases."""

from pyspark.sql import functions as F

from tidemark.functions import canonical_url, digest, normalize_identifier, record_id, snake_case, strict_boolean, strict_date, strict_decimal, strict_integer, strict_number, strict_timestamp


def each(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("x")).collect()
    return [r["x"] for r in sorted(rows)]


def test_canonical_url(spark):
    cases = {
        "HTTPS://WWW.Example.COM:443/reports/Result/?Study=ABC#overview": "https://example.com/reports/Result?Study=ABC",
        "http://example.com": "http://example.com/",
        "http://example.com:80/": "http://example.com/",
        "http://example.com:8080/a/": "http://example.com:8080/a",
        "http://User@Example.com/A": "http://User@example.com/A",
        "ftp://Example.com/a": "ftp://Example.com/a",
        "not a url": "not a url",
    }
    assert each(spark, list(cases), canonical_url) == list(cases.values())


def test_normalize_identifier(spark):
    norm = lambda n: lambda v: normalize_identifier(F.lit(n), v)
    assert each(spark, ["https://doi.org/10.1/AbC", "DOI: 10.1/x", " "], norm("doi")) == ["10.1/abc", "10.1/x", None]
    assert each(spark, ["bsyn rymu-x"], norm("inchikey")) == ["BSYNRYMU-X"]
    assert each(spark, ["CAS: 50-78-2"], norm("cas")) == ["50-78-2"]
    assert each(spark, [" As Is "], norm("other")) == ["As Is"]


def test_strict_conversions(spark):
    assert each(spark, ["1", "+7", "1.0", "9223372036854775807", "9223372036854775808", "x"], strict_integer) == [1, 7, None, 9223372036854775807, None, None]
    assert [str(x) if x is not None else None for x in each(spark, ["12345678901234.567", "1.2345", "1.500", "2"], strict_decimal)] == ["12345678901234.567", None, "1.500", "2.000"]
    assert each(spark, ["1e3", "-0", "1e-400", "1e999", "nan", ".5"], strict_number) == [1000.0, 0.0, None, None, None, 0.5]
    assert each(spark, ["TRUE", "0", "yes"], strict_boolean) == [True, False, None]
    assert [str(x) for x in each(spark, ["2024-02-29", "2023-02-29", "2024-1-1"], strict_date)] == ["2024-02-29", "None", "None"]
    assert [str(x) for x in each(spark, ["2024-01-02T03:04:05Z", "2024-01-02 03:04:05.25", "2024-01-02T03:04:05+02:00", "2024-01-02", "2024-13-02"], strict_timestamp)] == [
        "2024-01-02 03:04:05", "2024-01-02 03:04:05.250000", "2024-01-02 01:04:05", "2024-01-02 00:00:00", "None",
    ]


def test_digests_and_ids_tell_content_apart(spark):
    rows = spark.createDataFrame([("a", None), ("a", ""), (None, "a"), ("a", None)], "x string, y string")
    found = [r[0] for r in rows.select(digest(F.col("x"), F.col("y"))).collect()]
    assert len(set(found)) == 3 and found[0] == found[3]
    ids = [r[0] for r in spark.range(200).select(record_id("thing", F.col("id"))).collect()]
    assert len(set(ids)) == 200 and all(len(i) == 30 and set(i[4:]) <= set("0123456789ABCDEFGHJKMNPQRSTVWXYZ") for i in ids)
    assert snake_case("ClaimEvidence Table") == "claim_evidence_table"
