from collections import Counter

from loamtext.llm import sharding


def test_every_row_once_and_shards_even(spark, odd, odd_rows):
    for shards in (1, 3, 16, 40):
        out = sharding.shuffled(odd, shards, bucket_bytes=2000).collect()
        assert sorted((tuple(r[:12]) for r in out), key=repr) == sorted(odd_rows, key=repr)
        by = Counter(r.shard for r in out)
        counts = [by.get(s, 0) for s in range(shards)]
        assert max(counts) - min(counts) <= 1
        for s in range(shards):
            assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))


def test_order_is_mixed(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "repeat('x', 20) as text")
    out = sorted((r.shard, r.slot, r.doc_id) for r in sharding.shuffled(df, 4, bucket_bytes=20_000).collect())
    ids = [x[2] for x in out]
    assert sum(b == a + 1 for a, b in zip(ids, ids[1:])) < 40
    # each quarter of the ids is spread over all shards
    spread = Counter((s, i // 1000) for s, _, i in out)
    assert min(spread.values()) > 150 and len(spread) == 16


def test_empty_table(none):
    assert sharding.shuffled(none, 16).count() == 0


def test_files_hold_slots_in_order(spark, tmp_path):
    df = spark.range(300).selectExpr("id as doc_id", "cast(id as string) as text")
    sharding.write_shards(df, 3, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.doc_id for r in back.collect()) == list(range(300))
    assert {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2}


def test_carried_columns_may_have_any_name_and_type(spark):
    df = spark.sql("select id as doc_id, 'x' as text, id % 3 as shard, id as SLOT, map('a', id) as m, id as _key, id as _bucket from range(50)")
    out = sharding.shuffled(df, 4)
    assert out.columns == ["doc_id", "text", "shard_in", "SLOT_in", "m", "_key", "_bucket", "shard", "slot"]
    rows = out.collect()
    assert sorted((r.doc_id, r.shard_in, r.SLOT_in, r.m["a"], r["_key"], r["_bucket"]) for r in rows) == [(k, k % 3, k, k, k, k) for k in range(50)]


def test_the_order_follows_the_seed(spark):
    df = spark.range(500).selectExpr("id as doc_id", "'x' as text")
    place = lambda seed: sorted((r.shard, r.slot, r.doc_id) for r in sharding.shuffled(df, 4, seed=seed).collect())
    assert place(1) == place(1) != place(2)


def test_each_task_has_one_bucket(spark):
    df = spark.range(3000).selectExpr("id as _in_0", "'x' as _in_1")
    buckets = sharding.shuffled_buckets(df, 12)
    assert [r.n for r in buckets.groupBy("_bucket").count().withColumnRenamed("count", "n").collect() if r.n < 100] == []
    assert buckets.select("_bucket").distinct().count() == 12
    assert len(buckets.inputFiles()) == 12


def test_columns_of_the_query(spark, small):
    import zlib

    from loamtext.llm import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    out = queries.op8_sharding(spark, small).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    by = Counter(r.shard for r in out)
    assert set(by) == set(range(16)) and max(by.values()) - min(by.values()) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(by[s])) for s in by)
