"""The runs on small source files with the expected headers."""

import csv
import re
from datetime import date, timedelta

import numpy as np
import pytest

from daymark.plans import d3_models, sender_axis, three_axis
from daymark.plans import sources as src
from daymark.sources import SourceContractError, read_mart, read_source, reload_output, write_output

START = date(2024, 3, 1)
N = 160


def at(n):
    return (START + timedelta(days=int(n))).isoformat() + " 10:00:00"


def make_tables(seed=11):
    rng = np.random.default_rng(seed)
    users = [["id", "created_at", "friend_id_list", "group_id", "pending_votes", "extra"]]
    for i in range(N):
        friends = list(range(int(rng.integers(2, 40))))
        users.append([i, at(i % 3), str(friends), f"{i % 4}.0" if i % 9 else "", int(rng.integers(0, 100)), "x"])
    users.append([5, at(9), "[]", 1, 0, "repeat of user 5"])
    users.append(["bad", at(0), "[]", 1, 0, "no id"])
    groups = [["id", "grade", "class_num", "school_id"]] + [[g, 1 + g % 2, g, 77] for g in range(4)]
    props = [["user_id", "class", "grade", "school_id"]] + [[i, 9, 1, 77] for i in range(0, N, 9)]
    records = [["id", "status", "created_at", "chosen_user_id", "question_id", "user_id", "has_read", "answer_updated_at", "opened_times"]]
    for r in range(1500):
        sender = 3 if r % 3 == 0 else int(rng.integers(0, 60))  # one sender holds a third
        off = int(rng.integers(0, 35))
        records.append([
            r, "C" if r % 2 else "p", at(off), int(rng.integers(0, N)), int(rng.integers(0, 25)), sender,
            int(rng.integers(0, 2)), at(off + 1) if r % 4 == 0 else "", int(rng.integers(0, 3)),
        ])
    records.append(records[1])
    friends = [["id", "status", "created_at", "updated_at", "receive_user_id", "send_user_id"]]
    points = [["id", "delta_point", "created_at", "user_id"]]
    for r in range(400):
        off = int(rng.integers(0, 30))
        friends.append([r, ["A", "P", "accepted"][r % 3], at(off), at(off + 2), int(rng.integers(0, N)), int(rng.integers(0, N))])
        points.append([r, int(rng.integers(-50, 50)), at(off), int(rng.integers(0, N))])
    pay = [["id", "productId", "created_at", "user_id"]]
    pay += [[r, f"heart.{50 + r % 3}", at(rng.integers(0, 35)), int(rng.integers(0, N))] for r in range(120)]
    attendance = [["user_id", "attendance_date_list"]]
    attendance += [[int(rng.integers(0, N)), at(rng.integers(0, 32))[:10]] for _ in range(1200)]
    sessions = [["session_id", "user_id"]] + [[f"s{i}", i] for i in range(N)] + [["s1", 99]]
    keys = ["click_question_open", "complete_question", "skip_question", "other"]
    log = [["event_id", "event_datetime", "event_key", "session_id"]]
    log += [[e, at(rng.integers(0, 12)), keys[int(rng.integers(0, 4))], f"s{int(rng.integers(0, N + 5))}"] for e in range(900)]
    shown = [["id", "created_at", "question_piece_id", "user_id"]]
    shown += [[e, at(rng.integers(0, 12)), int(rng.integers(0, 50)), int(rng.integers(0, N))] for e in range(1000)]
    piece = [["id", "question_id"]] + [[i, i // 2] for i in range(40)]
    return {
        "users": users, "groups": groups, "user_properties": props, "attendance": attendance, "payment": pay,
        "question_record": records, "friend_request": friends, "point_history": points, "session_map": sessions,
        "session_events": log, "candidate_exposure": shown, "question_piece": piece,
    }


@pytest.fixture(scope="module")
def tables():
    return make_tables()


@pytest.fixture(scope="module")
def frames(spark, tables, tmp_path_factory):
    root = tmp_path_factory.mktemp("sources")
    paths = {}
    for name, rows in tables.items():
        paths[name] = str(root / f"{name}.csv")
        with open(paths[name], "w", encoding="utf-8-sig", newline="") as f:
            csv.writer(f).writerows(rows)
    return src.read_sources(spark, paths)


@pytest.fixture(scope="module")
def mart(frames):
    from daymark.session import settle

    return settle(three_axis.build_mart(frames))


def test_population(frames, rows):
    pop = src.users_population(frames["users"], frames["groups"], frames["user_properties"]).cache()
    assert pop.count() == N
    first = pop.where("user_id = '5'").first()
    assert first["signup_date"] == START + timedelta(days=2)  # the earlier of the two rows
    assert pop.where("user_id = '9'").first()["class_key"] == "77|1|9"  # no group: from properties
    funnel = dict(rows(src.population_funnel(pop)))
    assert funnel["all_users"] == N and 0 < funnel["home_entry_population"] < N


def broadcast_keys(df):
    """First keys of the joins that send one side whole to every task."""
    return set(re.findall(r"BroadcastHashJoin \[(?:cast\()?(\w+)#", df._jdf.queryExecution().sparkPlan().toString()))


def test_no_frame_with_a_row_per_user_is_broadcast(spark, frames, sf_dir):
    from daymark.catalog.runs import source_frames

    many = {"user_id", "session_id", "question_piece_id", "c_custkey", "o_custkey", "l_orderkey"}
    for df in (
        src.users_population(frames["users"], frames["groups"], frames["user_properties"]),
        three_axis.build_mart(frames),
        source_frames(spark, sf_dir)["users"],
    ):
        assert "Join" in df._jdf.queryExecution().sparkPlan().toString()
        assert not broadcast_keys(df) & many


def test_contract_names_what_is_missing(spark, frames):
    from daymark.sources import check_sources

    with pytest.raises(SourceContractError, match=r"payment missing \[productId\]"):
        check_sources(spark, {"payment": frames["payment"].drop("productId")}, {"payment": src.REQUIRED["payment"]})


def offsets(tables, name, who, when, ident=True):
    """(user, day, row) once per id, days after signup."""
    head, seen, out = tables[name][0], set(), []
    for r in tables[name][1:]:
        row = dict(zip(head, r))
        if ident and row["id"] in seen:
            continue
        seen.add(row.get("id"))
        day = (date.fromisoformat(str(row[when])[:10]) - START).days - int(row[who]) % 3
        out.append((int(row[who]), day, row))
    return out


def test_mart_against_plain_python(tables, mart):
    got = {int(r["user_id"]): r for r in mart.collect()}
    assert len(got) == N
    sent = offsets(tables, "question_record", "user_id", "created_at")
    received = offsets(tables, "question_record", "chosen_user_id", "created_at")
    paid = offsets(tables, "payment", "user_id", "created_at")
    came = offsets(tables, "attendance", "user_id", "attendance_date_list", ident=False)
    shown = offsets(tables, "candidate_exposure", "user_id", "created_at")
    used = offsets(tables, "point_history", "user_id", "created_at")
    for u in range(N):
        r = got[u]
        s = [(d, x) for w, d, x in sent if w == u and 0 <= d <= 7]
        assert r["sent_vote_count_d0_7"] == len(s)
        assert r["sent_vote_active_days_d0_7"] == len({d for d, _ in s})
        assert r["sent_vote_distinct_chosen_users_d0_7"] == len({x["chosen_user_id"] for _, x in s})
        assert r["sent_vote_distinct_questions_d0_7"] == len({x["question_id"] for _, x in s})
        done = sum(x["status"].upper() == "C" for _, x in s)
        assert r["sent_vote_complete_rate_d0_7"] == pytest.approx(done / len(s) if s else 0)
        g = [(d, x) for w, d, x in received if w == u and 0 <= d <= 7]
        read = sum(x["has_read"] > 0 or x["opened_times"] > 0 for _, x in g)
        assert (r["received_vote_count_d0_7"], r["received_vote_read_count_d0_7"]) == (len(g), read)
        assert r["early_received_score_d0_7"] == (8 - min(d for d, _ in g) if g else 0)
        p = [x for w, d, x in paid if w == u and 0 <= d <= 28]
        assert r["payment_count_d0_28"] == len(p)
        assert r["payment_amount_d0_28"] == sum(int(x["productId"].split(".")[1]) for x in p)
        days = {d for w, d, _ in came if w == u and 1 <= d <= 28}
        assert r["attendance_days_d1_28"] == len(days) and r["retention_d1_28"] == bool(days)
        e = [x for w, d, x in shown if w == u and 0 <= d <= 7]
        questions = {x["question_piece_id"] // 2 if x["question_piece_id"] < 40 else x["question_piece_id"] for x in e}
        assert (r["candidate_exposure_count_d0_7"], r["candidate_unique_question_count_d0_7"]) == (len(e), len(questions))
        if g:
            first = min(d for d, _ in g)
            after = {d for w, d, _ in came if w == u and first <= d <= 28}
            assert r["attendance_days_after_received_vote_d0_28"] == len(after)
            spend = {d for w, d, x in used if w == u and first <= d <= 28 and x["delta_point"] < 0}
            assert r["point_use_after_received_vote_count_d0_28"] == len(spend)
        else:
            assert r["attendance_after_received_vote_yn_d0_28"] is False


def test_mart_invariants(mart):
    bad = mart.where(
        "active_days_d8_28 > active_days_d0_28 or active_days_d0_28 > 29 or received_vote_read_count_d0_7 > received_vote_count_d0_7"
        " or same_class_active_ratio_d0_7 not between 0 and 1 or candidate_to_recv_rate_d0_7 not between 0 and 1"
    )
    assert bad.isEmpty()
    assert mart.select("user_id").distinct().count() == mart.count()


def test_three_axis_tables(mart):
    out = three_axis.run(mart, ks=range(2, 5), seeds=(1,), compare_ks=(2, 3, 4), min_share=0.01)
    home = mart.where("home_entry_population").count()
    outcome = out["outcome"].collect()
    assert sum(r["user_count"] for r in outcome) == home
    assert sum(r["cluster_share_pct"] for r in outcome) == pytest.approx(100)
    assert out["k_metrics"].where("selected_k").count() == 1
    assert len({r["cluster_label"] for r in out["mapping"].collect()}) == len(outcome)
    seg = out["segments_friend_count_bucket"].groupBy("friend_count_bucket").sum("cluster_share_within_segment_pct").collect()
    assert all(r[1] == pytest.approx(100) for r in seg)
    assert out["pca"].count() == home
    assert sum(n.startswith("k") and n.endswith("_outcome") for n in out) == 2  # the two ks that were not chosen
    assert out["interpretation"].count() == len(outcome) and out["top_friend_count_bucket"].count() >= 1


def test_sender_tables(mart):
    out = sender_axis.run(mart, ks=range(2, 4), seeds=(1,))
    assert out["bounds_removed"].isEmpty()
    groups = {r["sender_group"]: r for r in out["groups"].collect()}
    assert set(groups) == set(sender_axis.GROUPS)
    assert groups[sender_axis.GROUPS[1]]["interpretation"] == "base group"
    assert groups[sender_axis.GROUPS[1]]["sent_vote_count_d0_7_sender_mean"] == 0
    assert out["intensity"].count() == 5
    assert out["k_metrics"].where("selected_k").count() == 1 and out["cluster_outcome"].count() >= 2
    rates = {r["metric"]: r["value"] for r in three_axis.window_rates(mart).collect()}
    assert rates["d0"] <= rates["d0_3"] <= rates["d0_28"]


def test_grids_report_runs(spark, sf_dir):
    from daymark.catalog.days import event_d3_mart

    mart = event_d3_mart(spark, sf_dir)
    assert d3_models.consistency(mart).where("severity = 'error' and violations > 0").isEmpty()
    runs = d3_models.basic_grid(mart, rounds=1).metrics  # every requested fit has a row, fitted or not
    assert len(runs) == 40 and len({(m["target_name"], m["population"], m["feature_set"], m["model_type"]) for m in runs}) == 40
    assert all(m.get("error") or m.get("mae") is not None or m.get("roc_auc") is not None for m in runs)


def test_outputs_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([("1", 2.5), ("2", None)], "user_id string, v double")
    assert rows(reload_output(spark, write_output(df, str(tmp_path / "p")))) == rows(df)
    back = read_source(spark, write_output(df, str(tmp_path / "c"), fmt="csv"), "v double, user_id bigint", fmt="csv")
    assert rows(back, "user_id", "v") == [(1, 2.5), (2, None)]
    assert read_mart(spark, str(tmp_path / "p")).schema["user_id"].dataType.typeName() == "string"


def test_runs_without_users_give_empty_tables_and_the_reason(spark, sf_dir):
    from daymark.catalog.runs import source_frames
    from daymark.plans import sender_axis, three_axis
    from daymark.session import settle

    mart = settle(three_axis.build_mart(source_frames(spark, sf_dir)).where("false"))
    for run, tables in ((three_axis.run, ("users", "mapping", "outcome", "pca", "k_metrics")), (sender_axis.run, ("users", "mapping", "cluster_outcome", "k_metrics"))):
        out = run(mart)
        assert "too few" in out["reason"].first()["reason"]
        for name in tables:
            assert out[name].isEmpty() and len(out[name].columns) > 1, name
