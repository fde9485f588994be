import random

from pyspark.sql import functions as F

from loamtext.llm import chat


def read(df, **kw):
    out = chat.read_back(chat.format_conversations(df, **kw))
    return {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out.collect()}, {r.conv_id: r.formatted for r in out.collect()}


def test_round_trip_of_odd_texts(spark):
    r = random.Random(4)
    alphabet = ["\\", "<", "l", "|", "<|turn|>", "<|and|>", "<|end|>", "<|text|>", "\n", "é", "😀", "", "\\l", " "]
    rows = [(c, t, r.choice(["user", "assistant", "<|end|>", ""]), "".join(r.choices(alphabet, k=r.randrange(8)))) for c in range(30) for t in range(r.randrange(1, 40))]
    r.shuffle(rows)
    want = {}
    for c, _, role, text in sorted(rows):
        want.setdefault(c, []).append((role, text))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for block in (1, 4, 256):
        assert read(df, block=block)[0] == want


def test_adjacent_roles_are_merged(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    for block in (1, 2, 256):
        assert read(df, block=block)[1] == {1: "<|turn|>user<|text|>a<|and|>b<|end|><|turn|>assistant<|text|>c<|end|>"}


def test_nulls_ties_and_repeats(spark):
    rows = [(None, 0, "user", "x"), (2, None, None, None), (2, 5, "b", "y"), (2, 5, "a", "z"), (2, 5, "a", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit(1)).withColumn("cid", F.lit("c"))
    assert read(df)[0] == {None: [("user", "x")], 2: [("", ""), ("a", "z"), ("a", "z"), ("b", "y")]}
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_long_conversation(spark):
    df = spark.range(5000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    assert read(df)[0][1] == [("user" if k % 3 == 0 else "assistant", str(k)) for k in range(5000)]


def test_against_sql(compare, small):
    compare("op10_chat_formatting", small)
