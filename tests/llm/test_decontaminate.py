import random
import re

from pyspark.sql import functions as F

from loamtext.llm import decontaminate as dc


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window=8):
    out = []
    for doc_id, text in docs:
        w, hit, held = words(text), set(), set()
        for item_id, t in items:
            b = words(t)
            n = min(window, len(b))
            for s in range(len(b) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == b[s : s + n]:
                        hit.update(range(p, p + n))
                        held.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(held), sorted(held), len(held) >= 2))
    return sorted(out, key=repr)


def run(docs, items):
    out = dc.contamination(docs, items).select("doc_id", "n_words", "n_hit", "n_items", "item_ids", "contaminated")
    return sorted((tuple(r[:4]) + (list(r[4]), r[5]) for r in out.collect()), key=repr)


def items_of(spark):
    return spark.createDataFrame(
        [(1, "a b a b a b a b a b"), (2, "One"), (3, "two three"), (4, ""), (5, None), (10, "a a a a a a a a"), (11, "alpha beta gamma delta epsilon zeta eta theta iota"), (12, "a a a a a a a a")],
        "item_id long, text string",
    )


def test_random_texts_equal_brute_force(spark, monkeypatch):
    r = random.Random(6)
    items = items_of(spark)
    docs = [(k, " ".join(r.choice(["a", "b", "A", "c", "one", "two", "three,", "É"]) for _ in range(r.randrange(60)))) for k in range(60)]
    docs += [(100, "alpha beta gamma delta epsilon zeta eta theta iota"), (101, "a " * 30), (7, docs[7][1]), (None, "one two three"), (200, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, [tuple(x) for x in items.collect()])
    assert run(df, items) == want
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(dc, "BROADCAST_BYTES", 0)
    assert run(df, items) == want


def test_odd_rows_and_empty_tables(spark, odd, odd_rows, none):
    items = items_of(spark)
    assert run(odd, items) == brute([r[:2] for r in odd_rows], [tuple(x) for x in items.collect()])
    assert dc.contamination(none, items).count() == 0
    assert run(odd, items.limit(0)) == brute([r[:2] for r in odd_rows], [])


def test_proximity(spark):
    items = spark.createDataFrame([(1, "red green blue"), (2, "solo")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "blue x x red x green"), (2, "red green x x x x x x blue"), (3, "solo red"), (4, "green red")], "doc_id long, text string")
    found = dc.windows_of(items)
    index = dc.build_index(docs, found)
    near = dc.proximity_matches(index, found, 5).join(index.select("k1", "k2", "id").distinct(), ["k1", "k2"]).join(found.items, "wid")
    assert {(r.id, r["item"]) for r in near.collect()} == {(1, 1), (3, 2)}


def test_plan_has_no_python(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    plan = df.select(F.size(dc.words(F.col("text"))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_against_sql(compare, small):
    compare("op2_decontamination", small)
