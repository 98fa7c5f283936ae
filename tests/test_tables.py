from daymark.operators.metrics import exposure_metrics
from daymark.operators.tables import dedup, dedup_rare


def test_rare_repeats_are_removed_like_any(spark, rows):
    df = spark.sql(
        "select * from values ('a', 2, 'x'), ('a', 1, 'y'), ('b', 1, 'z'), (null, 3, 'u'), (null, 2, 'v'), ('c', null, 'w'), ('c', null, 'w') t(id, at, v)"
    )
    assert rows(dedup_rare(df, ["id"], ["at"])) == rows(dedup(df, ["id"], ["at"]))
    assert dedup_rare(df, ["id"], ["at"]).columns == df.columns
    once = df.where("id = 'b'")
    assert rows(dedup_rare(once, ["id"], ["at"])) == [("b", 1, "z")]


def test_rows_without_repeats_are_not_moved(spark):
    df = spark.range(100).selectExpr("cast(id as string) as id", "id as at", "'v' as v")
    plan = dedup_rare(df, ["id"], ["at"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan, plan


def test_exposures_outside_the_windows_are_not_looked_up(spark):
    users = spark.sql("select * from values (1L, date'2024-01-01'), (2L, date'2024-01-01') t(user_id, signup_date)")
    shown = spark.sql(
        "select * from values (1L, 'p', date'2024-01-02'), (1L, 'p', date'2024-01-02'), (1L, 'q', date'2024-01-03'), (1L, 'r', date'2024-03-01'), "
        "(3L, 'p', date'2024-01-02'), (null, 'p', date'2024-01-02'), (1L, 's', null) t(user_id, item_id, day)"
    )
    looked = spark.sql("select * from values ('p', 'k'), ('q', 'k') t(item_id, question_id)")
    out = exposure_metrics(shown, users, looked, {"d0_7": (0, 7)})
    assert {r["user_id"]: (r["exposure_count_d0_7"], r["exposure_unique_questions_d0_7"], r["exposure_days_d0_7"]) for r in out.collect()} == {1: (3, 1, 2), 2: (0, 0, 0)}
