from pyspark.sql import functions as F

from custos.llm import chat
from custos.llm.oracles import ORACLE_SQL
from custos.llm.queries import QUERIES
from tests.llm.conftest import SF001

SCHEMA = "conv_id long, turn int, role string, text string, part string, bucket int, said int, lines string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 2, "l") for r in rows], SCHEMA)


def run(df, **kw):
    return chat.perspectives(df, df["conv_id"], df["turn"], df["role"], df["text"], **kw)


def test_whole_table_against_sql(spark, duck):
    got = QUERIES["op2_perspective_chat"](spark, SF001)
    wanted = duck.sql(ORACLE_SQL["op2_perspective_chat"])
    assert got.columns == wanted.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, wanted.fetchall()))


def test_every_participant_is_the_assistant_once(spark):
    df = frame(spark, [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi Bob"), (1, 2, "bob", "Hi <|im_end|> Ann"), (1, 3, "cid", None)])
    rows = {r["perspective"]: r for r in run(df).collect()}
    assert sorted(rows) == ["ann", "bob", "cid"]
    assert rows["bob"]["text"] == ("<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>user name=ann\nHi Bob<|im_end|>\n"
                                   "<|im_start|>assistant\nHi <| im_end|> Ann<|im_end|>\n<|im_start|>user name=cid\n<|im_end|>\n")
    for name, own in (("ann", "Hi Bob<|im_end|>"), ("bob", "Hi <| im_end|> Ann<|im_end|>"), ("cid", "<|im_end|>")):
        r = rows[name]
        assert [r["text"][s["start"]:s["end"]] for s in r["spans"]] == [own]


def test_parts_together_are_the_dialogue(spark):
    said = [(1, t, "ab"[t % 2], f"m{t}") for t in range(150)]
    rows = run(frame(spark, said)).filter("perspective = 'a'").orderBy("part").collect()
    assert [r["n_messages"] for r in rows] == [64, 64, 22]
    text = "".join(r["text"] for r in rows)
    assert [text.index(f"\nm{t}<") for t in range(150)] == sorted(text.index(f"\nm{t}<") for t in range(150))


def test_a_crowded_part_is_cut_by_one_rule(spark):
    said = [(1, 0, "a", "start")] + [(1, 1, "b", f"m{i:03}") for i in range(100)] + [(1, 2, "a", "end")]
    rows = run(frame(spark, said), most=10).filter("perspective = 'a'").orderBy("piece").collect()
    assert [r["n_messages"] for r in rows] == [10] * 10 + [2] and [r["piece"] for r in rows] == list(range(11))
    text = "".join(r["text"] for r in rows)
    order = ["start", *(f"m{i:03}" for i in range(100)), "end"]
    assert [text.index(f"\n{m}<") for m in order] == sorted(text.index(f"\n{m}<") for m in order)


def test_crowded_parts_and_null_turns_against_sql(spark):
    """More than 256 messages in a part, messages without a turn, role or text, and a hot conversation without an id."""
    import duckdb
    import pandas as pd

    said = [(1, t % 3, "ab"[t % 2], f"m{t}") for t in range(600)] + [(1, None, "a", f"n{t}") for t in range(5)]
    said += [(None, t, "abc"[t % 3], f"x{t}") for t in range(400)] + [(None, t % 70, "d", "same <|im_end|>") for t in range(400)]
    said += [(2, 0, None, None), (2, 0, "a", None), (2, 0, "a", ""), (2, None, None, "lost"), (3, 0, "system", "s"), (1, 1, "a", "m1")]
    got = run(frame(spark, said))
    mask = F.array_join(F.transform("spans", lambda s: F.concat(s["start"], F.lit("-"), s["end"])), ",")
    got = got.withColumn("mask", mask).drop("spans")
    con = duckdb.connect()
    con.register("raw", pd.DataFrame(said, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.execute("CREATE VIEW conversations AS SELECT * FROM raw")
    cursor = con.execute(ORACLE_SQL["op2_perspective_chat"])
    assert [d[0] for d in cursor.description] == got.columns
    want = sorted(map(str, cursor.fetchall()))
    assert sorted(map(str, map(tuple, got.collect()))) == want and len(want) > 20


def test_odd_rows(spark):
    said = [(1, 0, "a", "x"), (1, 0, "a", "x"), (1, None, "b", "lost"), (1, 1, None, "who"), (None, 0, "a", "n"), (None, 1, "b", "m"),
            (2, 0, "system", "only"), (3, 0, None, "only")]
    rows = run(frame(spark, said)).collect()
    assert {(r["conv_id"], r["perspective"]) for r in rows} == {(1, "a"), (1, "b"), (None, "a"), (None, "b")}
    one = next(r for r in rows if r["conv_id"] == 1 and r["perspective"] == "a" and r["part"] == 0)
    assert one["text"] == "<|im_start|>assistant\nx<|im_end|>\n<|im_start|>user\nwho<|im_end|>\n"
    alone = [r for r in rows if r["part"] is None]
    assert sorted((r["perspective"], r["n_own"]) for r in alone) == [("a", 0), ("b", 1)]
    assert run(frame(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    df = frame(spark, [(1, 0, "a", "x")])
    text = run(df)._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text


def test_long_texts_stay_whole(spark):
    df = frame(spark, [(1, 0, "a", "x" * 300_000), (1, 1, "b", "y")])
    assert run(df).agg(F.max(F.length("text"))).first()[0] > 300_000
