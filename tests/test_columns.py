from datetime import date

from pyspark.sql import functions as F

from daymark.functions import (
    bucket_label,
    date_list,
    digits,
    first_non_null,
    flag_label,
    group_key,
    key_family,
    list_len,
    money,
    norm_id,
    num,
    read_flag,
    safe_div,
    status_in,
    streak_of,
    to_binary,
    to_day,
)

INF = float("inf")


def values(spark, cells, expr, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_ids(spark):
    got = values(spark, ["12", "12.0", " 7 ", "12.5", "abc", "", None, "9007199254740993"], norm_id("c"))
    assert got == ["12", "12", "7", None, None, None, None, "9007199254740993"]
    assert values(spark, [12.0, 12.5, None], norm_id("c"), "double") == ["12", None, None]


def test_days(spark):
    got = values(spark, ["2024-02-29 23:59:59.5", "2024-03-01", "yesterday", "", None], to_day("c"))
    assert got == [date(2024, 2, 29), date(2024, 3, 1), None, None, None]


def test_list_length(spark):
    got = values(spark, ["[1, 2]", "[]", "bad", None, "['a', 'b, c', 'd']", "[None, 1]", "7"], list_len("c"))
    assert got == [2, 0, 0, 0, 3, 2, 0]


def test_date_lists_and_streaks(spark):
    texts = [
        "['2024-01-31', '2024-02-01', '2024-02-02', '2024-02-02']",  # across a month end, a repeat
        "['2024-01-05', '2024-01-01', '2024-01-02']",  # unordered with a gap
        "[]",
        "oops",
        "['2024-01-01', 'not a day']",
    ]
    assert [len(v) for v in values(spark, texts, date_list("c"))] == [3, 3, 0, 0, 1]
    assert values(spark, texts, streak_of(date_list("c"))) == [3, 2, 0, 0, 1]


def test_numbers(spark):
    cells = ["1.5", "x", None, "NaN", "Infinity", "-2"]
    assert values(spark, cells, num("c")) == [1.5, 0, 0, 0, 0, -2]
    assert values(spark, cells, num("c", None)) == [1.5, None, None, None, None, -2]


def test_binary(spark):
    assert values(spark, ["1", "TRUE", " yes ", "paid", "no", "0", None], to_binary("c", "string")) == [1, 1, 1, 1, 0, 0, 0]
    assert values(spark, [2.0, 0.0, -1.0, None], to_binary("c", "double"), "double") == [1, 0, 0, 0]
    assert values(spark, [True, False, None], to_binary("c", "boolean"), "boolean") == [1, 0, 0]


def test_division(spark):
    df = spark.createDataFrame([(1, 2), (3, 0), (None, 4), (5, None), (9, 3)], "n int, d int")
    got = df.select(safe_div("n", "d"), safe_div("n", "d", clip=(0, 1))).collect()
    assert [r[0] for r in got] == [0.5, 0, 0, 0, 3]
    assert [r[1] for r in got] == [0.5, 0, 0, 0, 1]


def test_text_amounts(spark):
    assert values(spark, ["heart.777", "none", None, "a1b22"], digits("c")) == [777, None, None, 1]
    assert values(spark, ["1,234.5", "KRW 10", None], money("c")) == [1234.5, None, None]
    assert values(spark, ["KRW -1,234.5", "", None], money("c", strip_all=True)) == [-1234.5, None, None]


def test_status(spark):
    cells = ["A", "a", "accepted", "C", "P", None]
    assert values(spark, cells, status_in("c", ["A"])) == [True, False, False, False, False, False]
    assert values(spark, cells, status_in("c", ["C"], "upper")) == [False, False, False, True, False, False]
    assert values(spark, cells, status_in("c", ["accepted", "accept", "a", "c"], "lower")) == [True, True, True, True, False, False]


def test_keys_and_flags(spark):
    df = spark.createDataFrame([("1", "2", 0, None), ("1", None, 1, 3)], "a string, b string, x int, y int")
    got = df.select(
        group_key("a", "b"), read_flag("x", "y"), first_non_null("b", "a"), flag_label(F.col("x") > 0, "yes", "no")
    ).collect()
    assert [tuple(r) for r in got] == [("1|2", False, "2", "no"), (None, True, "1", "yes")]
    fam = key_family("c", {"start": ["open", "both"], "done": ["end", "both"]})
    assert values(spark, ["open", "end", "both", "other", None], fam) == ["start", "done", "start", None, None]


def test_buckets_are_right_closed(spark):
    label = bucket_label("c", [-0.1, 0, 3, 10, 50, INF], ["0", "1-3", "4-10", "11-50", "51+"])
    cells = [0.0, 1.0, 3.0, 4.0, 10.0, 11.0, 50.0, 51.0, -1.0, None]
    assert values(spark, cells, label, "double") == ["0", "1-3", "1-3", "4-10", "4-10", "11-50", "11-50", "51+", None, None]
    days = bucket_label("c", [0, 1, 2, INF], ["1", "2", "3+"], include_lowest=True)
    assert values(spark, [0.0, 1.0, 2.0, 3.0], days, "double") == ["1", "1", "2", "3+"]
