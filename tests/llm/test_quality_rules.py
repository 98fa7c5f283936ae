import re
from collections import Counter

from daymark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    marked = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines, earlier, dups = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dups += line in earlier
            earlier.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(marked)


def test_counts_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.judge(docs).collect():
        want = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_count_text_on_odd_texts():
    for text in ("", " ", "a b c d e a b c d e", "x x x x x x x x", "é ß \x1c q", "l\n\n \nl\nl \n", "a b c d e f a b c d e g b c d e f"):
        assert quality.count_text(text)[:5] == brute(text)
    assert quality.count_text(None) == (0,) * 7


def test_sketch_is_mergeable_and_close(spark):
    import random

    rng = random.Random(5)
    values = [int(rng.paretovariate(1.1) * 40) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "v long").selectExpr("v", f"{quality.bucket('v')} AS code")
    for v, low in {(r["v"], r["low"]) for r in df.selectExpr("v", f"{quality.bucket_low('code')} AS low").collect()}:
        assert low <= v <= low * 33 / 32 + (1 if v > 63 else 0)
    counts = df.groupBy("code").count().collect()
    assert sum(r["count"] for r in counts) == len(values)
    order = [r["code"] for r in df.orderBy("v").select("code").collect()]
    assert order == sorted(order)


def test_thresholds_follow_the_group(spark):
    plain = "every day we write plain lines of text and talk about many things that come to mind number{0} and so on"
    marked = "| every | day | we | list | plain | items | of | text | and | more | number{0} |"
    junk = "### $$$ %%% &&& *** ### $$$ %%% &&& *** words{0} ### $$$ %%% &&& ***"
    rows = [(i, plain.format(i), "en", "prose") for i in range(300)] + [(1000 + i, marked.format(i), "en", "tables") for i in range(300)]
    rows += [(5000 + i, junk.format(i), "en", "prose") for i in range(9)] + [(6000, marked.format("x"), "en", "prose")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    assert kept == {r[0] for r in rows if r[0] < 5000}
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == kept


def test_agrees_with_labels(spark):
    d = "/root/testdata/sf0.01"
    got = quality.judge(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    cells = Counter((r["quality"], r["kept"]) for r in got.where("NOT base_failed").collect())
    assert cells[1, True] >= 0.98 * (cells[1, True] + cells[1, False])
    assert cells[0, False] >= 0.9 * (cells[0, True] + cells[0, False])


def test_odd_rows(odd_docs, no_docs):
    got = quality.judge(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r["base_failed"] and not r["kept"] for r in got if r["doc_id"] in (4, 5, 6))
    kept = quality.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if r["kept"])
    assert quality.judge(no_docs).count() == 0 and quality.keep_good(no_docs).count() == 0
