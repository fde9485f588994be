import hashlib

import public_tokenizers
import pytest

import corpus_pipeline
from loamtext.llm import pieces


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents, labels and benchmark with planted cases."""
    import random

    r = random.Random(12)
    say = lambda n: " ".join("".join(r.choices("abcdefghijklmnop", k=r.randrange(3, 8))) for _ in range(n))
    item = [say(20), say(20)]
    docs = [(k, say(80)) for k in range(150)]
    docs += [(200 + k, say(40) + " vile nasty " + say(20) + " vile " + say(5)) for k in range(40)]
    docs += [(300, docs[3][1]), (301, docs[3][1]), (302, docs[4][1])]
    docs += [(400, say(20) + " " + item[0] + " " + say(10) + " " + item[1]), (401, say(30) + " " + item[0])]
    docs += [(500, None), (501, ""), (None, say(50)), (150, say(60)), (150, say(60))]
    docs += [docs[5], docs[5]]
    footer = "\nthis footer stands under every page"
    docs += [(600 + k, say(60) + footer) for k in range(4)]
    path = tmp_path_factory.mktemp("planted")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(200 <= i < 240)) for i, _ in docs if i is not None and i < 300], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs


def test_each_stage_takes_effect(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, path), f"test_{name}")
        seen[name] = docs.collect()
        if name != "sentencepiece":
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = {k: [r.doc_id for r in v] for k, v in seen.items()}
    assert sorted(ids["toxicity"], key=repr) == sorted((i for i, _ in rows if i is None or not 200 <= i < 240), key=repr)
    assert sorted(ids["line_dedup"], key=repr) == sorted(ids["toxicity"], key=repr)
    texts = {r.doc_id: r.text for r in seen["line_dedup"]}
    assert "footer" in texts[600] and not any("footer" in texts[600 + k] for k in (1, 2, 3))
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"] if r.text is not None)
    once = ids["simhash"]
    assert once.count(3) == once.count(4) == once.count(5) == 1 and not {300, 301, 302} & set(once)
    assert once.count(150) == 2 and None in once and (500 in once) + (501 in once) == 1
    assert set(once) - set(ids["decontamination"]) == {400, 401}
    sp = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    last = {(r.doc_id, r.ids_sha256) for r in seen["sentencepiece"]}
    assert last == {(r.doc_id, hashlib.sha256(",".join(map(str, sp.encode(r.text or ""))).encode()).hexdigest()) for r in seen["decontamination"]}


def test_edited_copies_go(spark):
    import random

    r = random.Random(5)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randrange(3, 8))) for _ in range(300)]
    rows = [(k, " ".join("edited" if k and p in (40 * k, 290 - k) else x for p, x in enumerate(words)), "en", "s", 0) for k in range(6)]
    grams = [{tuple(w[a : a + 5]) for a in range(len(w) - 4)} for w in (t.split() for _, t, *_ in rows)]
    assert all(len(g & grams[0]) >= 0.8 * len(g | grams[0]) for g in grams)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [x.doc_id for x in corpus_pipeline.simhash_stage(spark, docs, "").collect()] == [0]


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100


def test_odd_rows_and_empty_tables(spark, odd, none, tmp_path):
    for name, docs in (("odd", odd), ("none", none)):
        path = f"{tmp_path}/{name}"
        docs.write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(7, 1, 0), (8, None, 1), (None, 0, 1)] if name == "odd" else [], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        spark.createDataFrame([(1, None), (None, "a b"), (2, "one two three four five six seven eight")] if name == "odd" else [], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        out = corpus_pipeline.run(spark, path).collect()
        if name == "none":
            assert out == []
            continue
        ids = [r.doc_id for r in out]
        # the row with a window of item 2 is gone, and one of the rows with fingerprint zero, of each group of copies, stays
        assert 6 not in ids and ids.count(0) == 1 and not {1, 2, 3, 8} & set(ids)
        assert ids.count(7) == 1 and {4, 5, 9, 10} <= set(ids)


def test_a_stage_leaves_only_its_result(spark, folder):
    from loamtext.llm import common

    before = common.n_written()
    corpus_pipeline.run(spark, folder[0])
    assert common.n_written() == before + 1
