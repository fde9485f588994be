"""Readers and sinks over hand-written files."""

import json

import pytest
from pyspark.sql import functions as F

from loamtext.operators import minutes
from loamtext.sources import corpora


def subject(start, end, **more):
    return {"subject_id": "s", "theme": "t", "topics": ["a"], "text": "x", "start": start, "end": end, **more}


def test_minutes(spark, tmp_path):
    one = {"municipalities": [{"minutes": [
        {"minute_id": "m1", "full_text": "first\nof two lines", "agenda_items": [{"item_title": "A", "subjects": [subject(0, 3), subject(4, 9)]}, {"item_title": "B", "subjects": [subject(None, None)]}]},
        {"minute_id": "", "full_text": "no id"},
        {"full_text": "no id either"},
        {"minute_id": "m2", "full_text": None, "agenda_items": []},
    ]}]}
    two = {"municipalities": [{"municipality": "Porto", "minutes": [{"minute_id": "m1", "full_text": "old"}, {"minute_id": "m3", "full_text": "x"}, {"minute_id": "m3", "full_text": "last wins"}]}]}
    (tmp_path / "São João.json").write_text(json.dumps(one))
    (tmp_path / "A town.json").write_text(json.dumps(two))
    (tmp_path / "notes.txt").write_text("not read")
    df = corpora.read_minutes(spark, str(tmp_path))
    rows = {r.doc_id: r for r in df.collect()}
    assert {k: (r.municipality, r.full_text) for k, r in rows.items()} == {"m1": ("São João", "first\nof two lines"), "m2": ("São João", ""), "m3": ("Porto", "last wins")}
    flat = minutes.flatten_subjects(df).orderBy("doc_id", "item_no", "idx").collect()
    assert [(r.doc_id, r.item_no, r.idx, r.start, r.end, r.theme, list(r.topics)) for r in flat] == [("m1", 0, 0, 0, 3, "t", ["a"]), ("m1", 0, 1, 4, 9, "t", ["a"]), ("m1", 1, 0, None, None, "t", ["a"])]


def test_splits(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"train_files": ["a.json", "b.json.json", "a.json"], "val_files": [], "test_files": ["c"]}))
    splits = corpora.read_splits(spark, str(tmp_path / "s.json"))
    assert [tuple(r) for r in splits.orderBy("split", "ord").collect()] == [("test", 0, "c"), ("train", 0, "a"), ("train", 1, "b"), ("train", 2, "a")]
    docs = spark.createDataFrame([("b", "Porto"), ("a", "porto"), ("c", None)], "doc_id string, municipality string")
    assert [r.doc_id for r in corpora.split_documents(docs, splits, "train").collect()] == ["a", "b"]
    assert [r.doc_id for r in corpora.split_documents(docs, splits, "train", "PORTO").collect()] == ["a", "b"]
    for split, town in (("val", None), ("test", "porto"), ("other", None)):
        with pytest.raises(ValueError):
            corpora.split_documents(docs, splits, split, town)


@pytest.fixture
def articles(tmp_path):
    files = {
        "Foo Bar": "line one\nline two\n\nline four",
        "sub/Ünï+cödé 100%": "über\r\nzwei",
        "sub/deep/Foo Bar": "the last path wins\nof one name",
        "_private": "an underscore\nis no dot",
        "sub/_x": "nested",
        ".hidden": "no",
        "empty": "",
        "a.json": "{}",
        "b.PY": "no",
        "c.txt": "no",
        "d.md": "no",
        "e.cfg": "no",
        "f.ini": "no",
        "v1.2": "a dot in the name",
        ".x.md": "no",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    return tmp_path


def test_articles_are_read_whole(spark, articles):
    df = corpora.read_articles(spark, str(articles))
    got = {r.doc_id: r.text for r in df.collect()}
    assert got == {"Foo Bar": "the last path wins\nof one name", "Ünï+cödé 100%": "über\r\nzwei", "_private": "an underscore\nis no dot", "_x": "nested", "v1.2": "a dot in the name"}
    path = df.where("doc_id like 'Ün%'").first().path
    assert path.endswith(f"{articles}/sub/Ünï+cödé 100%")


def test_one_article(spark, articles):
    for name in ("Foo Bar", "_private"):
        rows = corpora.read_articles(spark, str(articles / name)).collect()
        assert [(r.doc_id, r.text) for r in rows] == [(name, (articles / name).read_text())]


def test_corpus_view(spark, articles):
    docs = corpora.read_articles(spark, str(articles))
    view = corpora.Corpus(docs, ("v1.2", "Foo Bar", "unknown"))
    assert [r.doc_id for r in view.ids().collect()] == ["Foo Bar", "v1.2"] and len(view) == 2
    assert "_x" in view and "unknown" not in view and view.get("_x").first().text == "nested"
    assert view.get("unknown").isEmpty()
    assert len(corpora.Corpus(docs)) == 5 and len(corpora.Corpus(docs, ())) == 0


def test_results(spark, tmp_path):
    item = {"item_id": 1, "item_title": "A", "start": 0, "end": 5, "text": "abcde", "subjects": [{"theme": "t", "start": 0, "end": 2}]}
    (tmp_path / "São 1.v2.json").write_text(json.dumps({"agenda_items": [item]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"agenda_items": [], "error": "empty text"}))
    rows = {r.doc_id: r for r in corpora.read_result(spark, str(tmp_path)).collect()}
    assert set(rows) == {"São 1.v2", "b"} and rows["b"].error == "empty text"
    got = rows["São 1.v2"].agenda_items[0]
    assert (got.item_title, got.start, got.end, got.subjects[0].theme, got.subjects[0].topics) == ("A", 0, 5, "t", None)


def test_batch_requests_and_answers(spark, tmp_path):
    requests = spark.createDataFrame([("r1", 'say "x"', '{"type": "array"}'), ("r2", "plain", None)], "request_id string, prompt string, schema string")
    corpora.write_requests(requests, str(tmp_path / "out"), "small", temperature=0.5, max_tokens=7)
    lines = [json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()]
    by = {x["custom_id"]: x["request"] for x in lines}
    assert by["r1"]["model"] == "models/small" and by["r1"]["contents"] == [{"role": "user", "parts": [{"text": 'say "x"'}]}]
    assert by["r1"]["generation_config"] == {"temperature": 0.5, "max_output_tokens": 7, "response_mime_type": "application/json", "response_json_schema": '{"type": "array"}'}
    assert "response_mime_type" not in by["r2"]["generation_config"]
    corpora.write_requests(requests, str(tmp_path / "tuned"), "tunedModels/x")
    assert all(json.loads(x)["request"]["model"] == "tunedModels/x" for p in (tmp_path / "tuned").glob("*.json") for x in p.read_text().splitlines())
    with pytest.raises(ValueError):
        corpora.write_requests(requests.limit(0), str(tmp_path / "none"), "small")
    (tmp_path / "answers.jsonl").write_text('{"custom_id": "r1", "response": "[]"}\n\nnot json\n{"response": "no id"}\n{"custom_id": "r2", "error": "late"}\n')
    got = {tuple(r) for r in corpora.read_answers(spark, str(tmp_path / "answers.jsonl")).collect()}
    assert got == {("r1", "[]", None), ("r2", None, "late")}


def test_first_documents(spark):
    docs = spark.range(5).select(F.col("id").alias("doc_id"))
    assert [r.doc_id for r in corpora.first_documents(docs, 2).collect()] == [0, 1] and corpora.first_documents(docs).count() == 5
