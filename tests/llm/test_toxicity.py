import math
import random
import zlib

import numpy as np

from daymark.llm import toxicity

INSULTS, GROUPS = ["vilk", "dreg", "snub"], ["norfen", "suthen", "westen"]


def made(n, seed=4):
    """Label 1 only where an insult and a group stand in one text; either alone is fine."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeilmnorst") for _ in range(5)) for _ in range(300)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(30)]
        kind = rng.randrange(4)
        if kind in (0, 2):
            text.insert(rng.randrange(30), rng.choice(INSULTS).upper() + "!")
        if kind in (1, 2):
            text.insert(rng.randrange(30), rng.choice(GROUPS))
        rows.append((i, " ".join(text), int(kind == 2)))
    return rows


def auc(pairs):
    ones, zeros = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


def test_pairs_of_terms_are_learned(spark):
    rows = made(2400)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    truth = {i: y for i, _, y in rows}
    got = [r for r in toxicity.toxicity(docs, labels).collect()]
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert auc([(r["score"], truth[r["doc_id"]]) for r in held]) > 0.95
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) > 0.93 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def pair_only(n, seed=4):
    """Label 1 where both markers or neither stand in a text: neither tells anything alone."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeilmnorst") for _ in range(5)) for _ in range(300)]
    rows = []
    for i in range(n):
        text, a, b = [rng.choice(words) for _ in range(30)], rng.randrange(2), rng.randrange(2)
        rows.append((i, " ".join(text + ["vilk"] * a + ["norfen"] * b), int(a == b)))
    return rows


def test_a_label_made_only_of_a_pair_is_learned(spark):
    rows = pair_only(2400)
    truth = {i: y for i, _, y in rows}
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    held = toxicity.toxicity(docs, labels).where("held_out").collect()
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) > 0.97 * len(held)


def test_no_pairs_from_chance():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 300, 30)) for _ in range(2000)]
    machine = toxicity.Machine(rows, rng.integers(0, 2, 2000)).fit()
    assert not machine.vectors.any() and (machine.weights != 0).sum() <= 6


def test_score_is_the_machine_of_the_model_table(spark):
    rows = made(1200)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(9000, None), (9001, "")], "doc_id long, text string")
    model = toxicity.ToxicityModel().fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    table = {r["feature"]: (r["weight"], r["vector"]) for r in model.model.collect()}
    assert any(any(v) for _, v in table.values())
    found = {r[0]: r[1] for r in docs.select("doc_id", toxicity.features(docs["text"])).collect()}
    for r in model.score(docs).collect():
        known = [table[f] for f in found[r["doc_id"]] if f in table]
        value = table[-1][0] + sum(w for w, _ in known)
        value += sum(sum(x * y for x, y in zip(a, b, strict=True)) for k, (_, a) in enumerate(known) for _, b in known[:k])
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-30, min(30, value))))) < 1e-9


def test_held_out_labels_do_not_matter(spark):
    rows = made(800)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    told = [(i, y) for i, _, y in rows]
    lied = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in told]
    scores = [
        {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect()}
        for x in (told, lied)
    ]
    assert scores[0] == scores[1]


def test_given_labels(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.toxicity(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    assert auc([(r["score"], r["toxic"]) for r in got]) > 0.9
    assert sum(r["predicted"] == r["toxic"] for r in got) > 0.96 * len(got)


def test_terms(spark):
    df = spark.createDataFrame([("Idiot, idiot! Déjà-vu 42",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(toxicity.terms(df["t"])).collect()] == [["idiot", "déjà", "vu", "42"], [], []]


def test_odd_rows_and_nothing_to_learn(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, None), (None, 0), (4, 7)], "doc_id long, toxic int")
    for some, want in ((labels.where("toxic = 1"), 1.0), (labels.where("false"), 0.0), (labels, 1.0)):
        got = toxicity.toxicity(odd_docs, some).collect()
        assert len(got) == odd_docs.count() and {r["score"] for r in got} == {want}
    assert toxicity.toxicity(no_docs, labels).count() == 0
    rows = made(400)
    told = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.ToxicityModel().fit(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), told)
    scored = model.score(odd_docs).collect()
    assert len(scored) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert not any(r["held_out"] for r in scored if r["doc_id"] is None)
    assert model.model.where("feature = -1").count() == 1
