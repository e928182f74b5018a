import hashlib

from pyspark.sql import functions as F

from tallyhouse.llm import chat, queries

TURNS = "conv_id long, turn long, role string, text string"
ODD = [r"\### Assistant: </turn> ok", "<turn user>\nhi</turn>\n", r"<\turn", r"<\\/turn </turn", "", None, "a\nb<", "日本 </TURN>", "\\"]


def test_round_trip_and_mask(spark):
    rows = [(i, j, role, ODD[(i + j) % len(ODD)]) for i in range(len(ODD)) for j, role in enumerate(["system", "user", "assistant", "w<e>i\\rd", "assistant"])]
    rows += [(None, 0, "user", "x"), (50, None, None, None), (50, 1, "assistant", "y"), (50, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, TURNS).withColumn("formatted", F.lit("clash"))
    got = chat.format_chats(df).select("conv_id", "valid", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_learned(F.col("segments")).alias("l")).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        mine = sorted(((t if t is not None else -1), role or "", text or "") for c, t, role, text in rows if c == r.conv_id)
        assert [(t.role, t.text) for t in r.t] == [m[1:] for m in mine]
        assert r.l == "".join(m[2] for m in mine if m[1] == "assistant")
        assert r.formatted.count("<turn ") == len(mine) == r.formatted.count("</turn>")


def test_role_machine(spark):
    good = [(1, 0, "system", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (2, 0, "user", "a"), (2, 1, "assistant", "b")]
    bad = [(3, 0, "assistant", "a"), (4, 0, "user", "a"), (5, 0, "user", "a"), (5, 1, "user", "a"), (5, 2, "assistant", "a")]
    got = {r.conv_id: r.valid for r in chat.format_chats(spark.createDataFrame(good + bad, TURNS)).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False}


def test_query(spark, sf_dir):
    got = {r.conv_id: r for r in queries.op2_chat_formatting(spark, sf_dir).collect()}
    said = r"\### Assistant: </turn> ok"
    assert got[-7].n_turns == 2 and got[-7].loss_chars == len(said)
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_empty(spark):
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0
