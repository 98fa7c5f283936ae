import re
from collections import Counter, defaultdict

from daymark.llm import quotes

MARK = re.compile(r"^[ \t>]*>")


def parts(text):
    """(level, normalised passage) of lines and paragraphs."""
    out, run, run_level = [], [], None

    def end():
        if len(run) > 1:
            out.append((run_level, " ".join(run)))

    for line in (text or "").split("\n"):
        mark = MARK.match(line)
        level = mark[0].count(">") if mark else 0
        body = re.sub(r"\s+", " ", line[mark.end() if mark else 0 :].lower()).strip(" ")
        if not body or level != run_level:
            end()
            run, run_level = [], level if body else None
        if body:
            run.append(body)
            out.append((level, body))
    end()
    return out


def brute(rows):
    """(conv, turn) -> (reply_to, root, depth, position); turns are unique here."""
    convs = defaultdict(dict)
    for conv, turn, _, text in rows:
        convs[conv][turn] = text
    found = {}
    for conv, turns in convs.items():
        origin = {}
        for turn in sorted(turns):
            for level, body in parts(turns[turn]):
                if level == 0:
                    origin.setdefault(body, turn)
        reply = {}
        for turn, text in turns.items():
            votes = Counter()
            for level, body in parts(text):
                if level and origin.get(body, turn) < turn:
                    votes[level, origin[body]] += len(body)
            if votes:
                level = min(v[0] for v in votes)
                reply[turn] = max((n, o) for (lv, o), n in votes.items() if lv == level)[1]
        chain = {}
        for turn in sorted(turns):
            root, depth = chain[reply[turn]] if turn in reply else (turn, -1)
            chain[turn] = (root, depth + 1)
        for at, turn in enumerate(sorted(turns, key=lambda t: (chain[t][0], t))):
            found[conv, turn] = (reply.get(turn), *chain[turn], at)
    return found


TALK = [
    (1, 0, "user", "How do I sort a list?\nIt has numbers.\n\nThanks in advance"),
    (1, 1, "user", "What is a closure?"),
    (1, 2, "assistant", "On Monday someone wrote:\n> How do I  SORT a list?\n> It has numbers.\n\nUse sorted."),
    (1, 3, "user", ">> How do I sort a list?\n> Use sorted.\nThat works, but\nhow fast is it?"),
    (1, 4, "assistant", "> What is a closure?\nA function with its scope."),
    (1, 5, "user", "> that works, but how fast is it?\nNobody asked me."),
    (1, 6, "user", "> never written by anyone here\nok"),
    (2, 0, "user", "How do I sort a list?"),
    (2, 1, "user", "> Use sorted.\nfrom another conversation"),
    (2, 2, "user", " > > How do I sort a list?\n"),
]


def read(df):
    return {(r["conv_id"], r["turn"]): (r["reply_to"], r["root_turn"], r["depth"], r["position"]) for r in df.collect()}


def test_talk(spark):
    df = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")
    got = quotes.thread(df)
    assert read(got) == brute(TALK)
    own = {(r["conv_id"], r["turn"]): r["text"] for r in got.collect()}
    assert own[1, 2].strip() == "Use sorted." and own[1, 3] == "That works, but\nhow fast is it?" and own[1, 0] == TALK[0][3]
    assert read(got)[1, 3][:3] == (2, 0, 2)


def test_sql_agrees_on_quotes(spark, tmp_path):
    import duckdb
    from check_oracle import compare

    from daymark.llm.catalog import QUOTE_SQL

    df = spark.createDataFrame(TALK + [(3, 0, "user", None), (3, None, "user", "> x\ny")], "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "talk"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/talk/*.parquet')")
    assert compare(quotes.thread(df), con, QUOTE_SQL) == ""


def test_long_chain_and_one_large_conversation(spark):
    rows = [(7, i, "user", f"> line {i - 1} of the talk\nline {i} of the talk" if i else "line 0 of the talk") for i in range(150)]
    rows += [(7, 1000 + i, "user", "> ok\n> line 3 of the talk\nok") for i in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert read(quotes.thread(df)) == brute(rows)


def test_given_conversations(spark, sf_dir):
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in talk.select("conv_id", "turn", "role", "text").collect()]
    got = quotes.thread(talk)
    assert read(got) == brute(rows)
    assert Counter((r["conv_id"], r["turn"], r["text"]) for r in got.collect()) == Counter((c, t, x) for c, t, _, x in rows)


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", "first words", "x", 1), (1, 0, "user", "first words", "x", 1), (1, 0, "user", "other words", None, 1),
        (1, 1, None, "> first words\nyes", None, 1), (1, None, "user", "> first words\nno", None, 1), (None, 3, "user", None, None, 1),
        (None, 4, "user", "", None, 1), (None, None, None, None, None, 1), (2, 0, "user", "> " * 3000 + "deep\n" + "word " * 50000, None, 1),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, root string, level int")
    got = quotes.thread(df).collect()
    assert len(got) == len(rows)
    reply = next(r for r in got if r["conv_id"] == 1 and r["turn"] == 1)
    assert (reply["reply_to"], reply["depth"], reply["text"]) == (0, 1, "yes")
    assert next(r for r in got if r["conv_id"] == 1 and r["turn"] is None)["reply_to"] is None
    assert next(r for r in got if r["conv_id"] == 2)["n_quoted_lines"] == 1
    assert quotes.thread(df.where("false")).count() == 0


def test_plan_has_no_python(spark):
    df = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")
    assert not re.search("Python|Pandas|Arrow", quotes.thread(df)._jdf.queryExecution().executedPlan().toString())


def test_repeated_rows_link_as_one(spark, tmp_path):
    import duckdb
    from check_oracle import compare

    from daymark.llm.catalog import QUOTE_SQL

    rows = [TALK[0]] * 3 + [TALK[2]] * 4 + [TALK[3], TALK[4], TALK[1]] + [TALK[5]] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "talk"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/talk/*.parquet')")
    got = quotes.thread(df)
    assert [r["n_linked"] for r in got.where("turn = 2").collect()] == [3] * 4  # two lines and their paragraph
    assert compare(got, con, QUOTE_SQL) == ""
