import hashlib
import random

import duckdb

from tessel.llm import chat

HARD = ["", "\\", "###", "####", "#" * 9, "</turn>", "<</turn", "a\\", "\\### Assistant: </turn> ok", "### user: x</turn>\n### assistant: y</turn>\n", "a\nb ### ", "\\" * 5 + "###", "##\\####<", "é\U0001f600 </turn>\n", "x" * 300_000 + "###", "#\\" * 20_000]


def test_every_turn_parses_to_its_source():
    rng = random.Random(1)
    texts = HARD + ["".join(rng.choice(["#", "##", "\\", "<", "</turn>", "/turn>", "\n", ": ", "a", "### user: "]) for _ in range(rng.randrange(12))) for _ in range(20_000)]
    for text in texts:
        for role in ("user", "assistant", "", "a: b\n#<\\"):
            rendered, start, end, step = chat.render(role, text)
            assert chat.parse(rendered) == (role, text, start, end, len(rendered)) and chat.unescaped(rendered[start:end]) == text


def test_escapes_no_more_than_needed():
    steps = {text: chat.render("user", text)[3] for text in ("plain", "a ### b", "a\\b", "\\###", "####")}
    assert steps == {"plain": 0, "a ### b": 1, "a\\b": 2, "\\###": 2, "####": 3}


def test_pieces_read_as_the_whole():
    rng = random.Random(2)
    source = [(rng.choice(["user", "assistant", "system"]), rng.choice(HARD[:-2])) for _ in range(60)]
    whole = "".join(chat.render(r, t)[0] for r, t in source)
    one, many = chat.Reader(), chat.Reader()
    one.feed(whole)
    while whole:
        n = rng.randrange(1, 40)
        many.feed(whole[:n])
        whole = whole[n:]
    assert one.row() == many.row() == expected(source)


def expected(turns):
    said = "".join(t for r, t in turns if r == "assistant")
    text = "".join(f"{r}\n{t}\n" for r, t in turns)
    return len(turns), hashlib.sha256(text.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), sum(len(chat.render(r, t)[0]) for r, t in turns)


def test_tables(spark):
    rows = [(1, 1, "assistant", "late", "x"), (1, 0, "user", "early", "y"), (1, None, "system", None, "z"), (2, 0, None, "no role", None), (None, 0, "user", "no conversation", None), (3, 0, "assistant", "same", "a"), (3, 0, "assistant", "same", "a"), (3, 0, "assistant", "also", "a")]
    rows += [(4, k, ("user", "assistant")[k % 2], t, "b") for k, t in enumerate(HARD)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string").repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(chat.turns(df)).collect()}
    want = {1: [("system", ""), ("user", "early"), ("assistant", "late")], 2: [("", "no role")], None: [("user", "no conversation")], 3: [("assistant", "also"), ("assistant", "same"), ("assistant", "same")], 4: [r[2:4] for r in rows[8:]]}
    assert got == {k: expected(v) for k, v in want.items()}
    assert chat.read_back(chat.turns(df.limit(0))).count() == 0


def test_query_equals_its_sql(spark, tmp_path):
    rows = [(c, k, ("user", "assistant", "system", "a:#")[(c + k) % 4], HARD[(7 * c + k) % len(HARD)]) for c in range(20) for k in range(c % 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = chat.op12_chat_formatting(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({chat.SQL})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
