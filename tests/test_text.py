import re
import unicodedata
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from fieldweave.functions import text

NAMES = {
    "customerId": "customer_id", "HTTPServerID": "http_server_id", " user-name.first ": "user_name_first", "Ａｍｏｕｎｔ": "amount", "__a__b__": "a_b", "orderDate2Ship": "order_date2_ship",
    "a b": "a_b", "": "", " _.- ": "", "ABCdef": "ab_cdef", "naïveÉcole": "naïveécole", "x\x1cy": "x_y", "ﬁeldName": "field_name",
}


def reference(name):
    s = unicodedata.normalize("NFKC", name).strip()
    s = re.sub(r"(?<=[A-Z])(?=[A-Z][a-z])", "_", s)
    s = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", s).lower()
    return re.sub(r"_+", "_", re.sub(r"[-.\s]+", "_", s)).strip("_")


def test_normalization(spark):
    df = spark.createDataFrame([(k, v, "other") for k, v in NAMES.items()] + [(None, None, "other")], "raw string, want string, normalized string").drop("normalized")
    got = text.with_normalized(df, {"raw": "n"}).collect()
    assert {r.raw: r.n for r in got if r.raw is not None} == NAMES == {k: reference(k) for k in NAMES}
    assert [r.n for r in got if r.raw is None] == [None]
    again = text.with_normalized(spark.createDataFrame([(v,) for v in NAMES.values()], "raw string"), {"raw": "n"})
    assert all(r.raw == r.n for r in again.collect())


def test_markers_and_labels(spark):
    rows = [(" True ", True, True), ("1", True, None), ("yes", True, None), ("FALSE", False, False), ("0", False, None), ("no", False, None), ("", None, None), ("maybe", None, None)]
    df = spark.createDataFrame(rows, "x string, raw boolean, strict boolean")
    assert all(r.raw == r.a and r.strict == r.b for r in df.select("*", text.synthetic_marker(F.col("x")).alias("a"), text.strict_boolean(F.col("x")).alias("b")).collect())
    assert spark.createDataFrame([("\t direct\n",)], "x string").select(text.label(F.col("x"))).first()[0] == "DIRECT"


def test_ratio_is_ordered_and_knows_junk(spark):
    long = "ab" * 150
    rows = [("tide", "diet"), ("diet", "tide"), ("abc", "abc"), ("", ""), (long, long[1:]), (None, "a")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", text.sequence_ratio("a", "b").alias("r"), text.sequence_ratio_junk("a", "b").alias("j")).collect()
    for r in got[:-1]:
        assert r.r == SequenceMatcher(None, r.a, r.b, autojunk=False).ratio() and r.j == SequenceMatcher(None, r.a, r.b).ratio()
    assert got[0].r == 0.25 and got[1].r == 0.5 and got[4].r != got[4].j and got[5].r is None


def test_abbreviations(spark):
    rows = [
        ("cust_id", "customer_id", True), ("customer_id", "cust_id", True), ("cid", "customer_internal_date", True), ("ci", "customer_id", True), ("amount", "amount", False), ("c_id", "customer_id", False),
        ("id", "id", False), ("xq_id", "customer_id", False), ("a", "b", False), ("cus_nm", "customer_name", True), ("x", "x_y", False), ("aab", "aba", False), ("nm", "name", True),
    ]
    df = spark.createDataFrame(rows, "a string, b string, want boolean").select("*", text.possible_abbreviation(F.col("a"), F.col("b")).alias("got"))
    assert [(r.a, r.b) for r in df.collect() if r.got != r.want] == []


def test_functions_are_known_to_sql(spark):
    text.register(spark)
    assert spark.sql("SELECT sequence_ratio('tide', 'diet') AS r, compatibility_form('ﬁ') AS c").first().asDict() == {"r": 0.25, "c": "fi"}
