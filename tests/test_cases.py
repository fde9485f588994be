"""Golden edge cases of FIXTURES.md: sentences, prompts, answers, repair, scores."""

import json

import pytest
from pyspark.sql import functions as F

from loamtext.operators import evaluate, parsing, segments, sentences
from loamtext.plans import pipelines, prompts

SPAN = "doc_id string, idx int, start int, end int"
THEMED = SPAN + ", theme string, topics array<string>"


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


def test_blank_texts_have_no_sentences(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t "), (4, "One. Two"), (5, "- \n1.\n*")], "doc_id int, text string")
    got = [(r.doc_id, r.sent_num, r.text, r.start, r.end) for r in sentences.split_sentences(docs).orderBy("doc_id", "sent_num").collect()]
    assert got[:2] == [(4, 1, "One.", 0, 4), (4, 2, "Two", 5, 8)] and {x[0] for x in got} == {4, 5}
    assert sentences.split_sentences(docs.limit(0)).count() == 0
    assert sentences.prompt_lines(sentences.split_sentences(docs)).count() == 2


def test_section_prompt(spark):
    ask = lambda parent, **kw: one(spark, prompts.sections_prompt(F.lit('S1: "x"'), F.lit(3), parent, **kw))
    root, below = ask(F.lit("")), ask(F.lit("History"))
    assert root == ask(F.lit(None).cast("string")) and "article. Divide it into its main sections" in root
    assert "section 'History'" in below and "empty array" in below
    assert root.endswith('S1 to S3. Answer with one JSON array and nothing else.\n\nS1: "x"')
    assert root.startswith("Example answer") and not ask(F.lit(""), few_shot=False).startswith("Example answer")


def test_subject_prompt(spark):
    ask = lambda town, **kw: one(spark, prompts.subjects_prompt(F.lit("L"), F.lit("Roads"), F.lit(town), **kw))
    plain = ask("Lisboa")
    assert "belongs to no subject" in plain and "item 'Roads'" in plain and "1. start_id" in plain and "2. end_id" in plain and "theme" not in plain
    assert "belongs to the first subject" in ask("Câmara do PORTO") and "belongs to no subject" in ask(None)
    both = ask("x", theme=True, topics=("Água", "b"))
    assert "1. theme" in both and "2. topics" in both and "4. end_id" in both and "Categories:\n- Água\n- b\n" in both
    assert '"topics": ["Água"]' in both and '"theme"' in both
    assert "1. topics" in ask("x", topics=("a",)) and "Example" not in ask("x", few_shot=False)


def test_schemas():
    item = json.loads(prompts.ITEM_SCHEMA)["items"]
    assert list(item["properties"]) == item["required"] == ["item_title", "start_id", "end_id"]
    for theme in (False, True):
        for topics in (False, True):
            fields = json.loads(prompts.subject_schema(theme, topics))["items"]
            want = ["theme"] * theme + ["topics"] * topics + ["start_id", "end_id"]
            assert list(fields["properties"]) == fields["required"] == want
    assert json.loads(prompts.subject_schema(topics=True))["items"]["properties"]["topics"] == {"type": "array", "items": {"type": "string"}}


A = {"start_id": "S1", "end_id": "S2"}
J = json.dumps([A])


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("[]", "items", 0),
        (None, "items", None),
        ("", "items", None),
        ("{}", "items", 1),
        ('[{"a":1}] see [1]', "items", None),
        ('[{"start_id": "S1",}]', "items", None),
        ('[{"start_id": NaN}]', "items", 1),
        (J, "sections", 1),
        (f"```json\n{J}\n```", "items", 1),
        (f"```\n\n{J}\n  ```  after ```\n[]\n```", "items", 1),
        (f"text ```json {J}``` text", "items", 1),
        (f"before {J} after", "items", 1),
        (f"{json.dumps(A)}\n{json.dumps(A)}\nmore", "items", 2),
        (f'{{"items": {J}}}', "items", 1),
        (f'so: {{"items": {J}}} done', "items", 1),
        (f'{{"sections": {J}}}', "sections", 1),
        (f'{{"agenda_items": {J}}}', "sections", 1),
        (f'{{"other": 1, "agenda_items": {J}}} trailing', "sections", 1),
        (f'"items" said, "items" : {J}', "sections", 1),
        (f'{{"sections": {J}}}', "items", 1),  # no wrapper of this kind: the outermost brackets
        ('{"sections": 5}', "sections", 1),
        (f'{{"subjects": {J}}}', "subjects", 1),
        (f'see {{"subjects": {J}}}', "subjects", 1),
        ('{"subjects": []}', "subjects", 0),
        ("[1, 2]", "items", 0),
    ],
)
def test_answers(text, kind, found):
    got = parsing.parse(text, kind)
    assert (None if got is None else len(got)) == found


def test_rows_of_an_answer():
    row = parsing.parse('[{"section_title": 5, "topics": "x", "theme": null, "start_id": 3}]')[0]
    assert row == {"item_title": "5", "theme": None, "topics": None, "topics_is_list": False, "start_id": "3", "end_id": None}
    assert parsing.parse('[{"item_title": "a", "section_title": "b", "topics": ["x", 1]}]')[0] | {} == {
        "item_title": "a", "theme": None, "topics": ["x", "1"], "topics_is_list": True, "start_id": None, "end_id": None}


def test_subjects_are_validated(spark):
    answers = [
        {"theme": "t", "topics": ["a"], "start_id": "S1", "end_id": "S2"},
        {"topics": "a", "start_id": "S2", "end_id": "S3"},
        {"theme": "t", "start_id": "S5", "end_id": "S4"},
        {"theme": "t", "topics": [], "start_id": "S9", "end_id": "Sx"},
        {"theme": "t", "topics": []},
    ]
    told = spark.createDataFrame([("d", 0, 11, 15, json.dumps(answers)), ("d", 1, 1, 9, json.dumps([answers[0]]))], "doc_id string, item_no int, first_num int, last_num int, response string")
    rows = segments.rebase(parsing.parsed_items(parsing.parse_responses(told, "subjects"), "doc_id", "item_no", "first_num", "last_num"), "first_num")
    got = {(r.item_no, r.idx, r.error) for r in segments.validate_subjects(rows, "first_num", "last_num", theme=True, topics=True).collect()}
    assert got == {
        (0, 0, "overlaps the next"), (0, 1, "missing theme"), (0, 1, "topics not a list"),
        (0, 2, "missing topics"), (0, 2, "topics not a list"), (0, 2, "start_id after end_id"),
        (0, 3, "start_id out of range"), (0, 3, "bad end_id"), (0, 4, "bad start_id"), (0, 4, "bad end_id"),
    }
    plain = {(r.item_no, r.idx, r.error) for r in segments.validate_subjects(rows, "first_num", "last_num").collect()}
    assert plain == {x for x in got if "theme" not in x[2] and "topics" not in x[2]}


def test_correction_rounds(spark):
    requests = spark.createDataFrame([("good", "p", None), ("once", "p", None), ("twice", "p", None), ("never", "p", None)], "request_id string, prompt string, schema string")
    asked = []

    def ask(r):
        rows = r.collect()
        asked.append(sorted(x.request_id for x in rows))
        assert len(asked) == 1 or all(x.prompt.startswith("This answer is not a JSON array") for x in rows)
        n = len(asked) - 1
        whole = lambda i: i.startswith("good") or i.startswith("once") and n >= 1 or i.startswith("twice") and n >= 2
        return spark.createDataFrame([(x.request_id, J if whole(x.request_id) else "sorry") for x in rows], "request_id string, response string")

    out = {r.request_id: r["items"] is not None for r in pipelines.asked_and_corrected(requests, ask, "items", 2).collect()}
    assert out == {"good": True, "once": True, "twice": True, "never": False}
    assert asked == [["good", "never", "once", "twice"], ["never#1", "once#1", "twice#1"], ["never#2", "twice#2"]]


def test_subject_annotations(spark):
    docs = spark.createDataFrame([("d", "One. Two. Three.")], "doc_id string, text string")
    sents = sentences.split_sentences(docs)
    subjects = spark.createDataFrame([("d", 0, 0, 1, 1, None, None), ("d", 0, 1, 2, 2, "t", ["a"]), ("d", 0, 2, 2, 9, "unknown", None), ("d", 0, 3, None, 1, "none", None)], "doc_id string, item_no int, idx int, start_num int, end_num int, theme string, topics array<string>")
    view = lambda df: {r.idx: (r.text, r.theme, list(r.topics)) for r in df.collect()}
    assert view(segments.annotate_subjects(subjects, sents, docs)) == {0: ("One.", "", []), 1: ("Two.", "t", ["a"])}
    assert view(segments.annotate_subjects(subjects, sents, docs, offset=1)) == {0: ("Two.", "", []), 1: ("Three.", "t", ["a"])}


def test_many_chunks_do_not_overflow(spark):
    rows = spark.createDataFrame([("d", 30_000, 0, 100, 1, 2, "b"), ("d", 2, 150_000, 1, 1, 1, "a"), ("d", 30_000, 1, 100, None, 2, "gone")], "doc_id string, chunk_no int, idx int, first_num int, start_num int, end_num int, title string")
    out = pipelines.merge_chunk_items(rows, pipelines.Config()).orderBy("idx").collect()
    assert [(r.idx, r.start_num, r.end_num, r.title) for r in out] == [(0, 1, 1, "a"), (1, 100, 101, "b")]


def test_config():
    config = pipelines.Config()
    echo = config.as_dict()
    assert (echo["few_shot"], echo["attempts"], echo["fix_gaps"], echo["max_depth"], echo["min_sentences"], echo["chunk_size"], echo["chunk_overlap"]) == (True, 5, True, 5, 3, 150, 30)
    echo["attempts"] = 99  # a copy
    assert config.attempts == 5 and config.temperature == 0.1 and config.max_tokens == 4096
    for bad in ({"chunk_overlap": 150}, {"max_depth": -1}, {"min_sentences": 0}, {"gap_threshold": -1}, {"attempts": 0}):
        with pytest.raises(ValueError):
            pipelines.Config(**bad)


def test_errors_are_rows(spark):
    docs = spark.createDataFrame([("a", "One. Two. Three."), ("b", " "), ("c", None)], "doc_id string, text string")
    silent = lambda r: r.select("request_id", F.lit("no answer").alias("response"))
    out = {r.doc_id: (r.agenda_items, r.error) for r in pipelines.segment_minutes(docs, silent)["result"].collect()}
    assert out == {"a": ([], "unreadable answer"), "b": ([], "empty text"), "c": ([], "empty text")}
    tree = {r.doc_id: (len(r.agenda_items), r.tree_depth, r.error) for r in pipelines.segment_articles(docs, silent)["result"].collect()}
    assert tree == {"a": (1, 0, None), "b": (0, 0, "empty text"), "c": (0, 0, "empty text")}
    pipelines.release()
    assert pipelines._cached == []


def spans(spark, rows, schema=SPAN):
    return spark.createDataFrame(rows, schema)


def test_units_are_sentences_where_given_else_characters(spark):
    pred, gt = spans(spark, [("d", 0, 0, 10), ("d", 1, 11, 20)]), spans(spark, [("d", 0, 0, 16), ("d", 1, 17, 20)])
    sents = spark.createDataFrame([("d", 1, 0), ("d", 2, 11), ("d", 3, 17)], "doc_id string, sent_num int, start int")
    by_sentence, by_character = evaluate.evaluate_level(pred, gt, sents).first(), evaluate.evaluate_level(pred, gt).first()
    assert by_sentence.true_positives == 2 and by_character.true_positives == 0
    assert by_sentence.avg_iou == by_character.avg_iou == pytest.approx((10 / 16 + max(5 / 20, 3 / 9)) / 2)


def test_segmentation_metrics_of_one_document(spark):
    # ten units; true borders 3 and 6, predicted 3 and 7
    gt, pred = spans(spark, [("d", 0, 0, 3), ("d", 1, 3, 6), ("d", 2, 6, 10)]), spans(spark, [("d", 0, 0, 3), ("d", 1, 3, 7), ("d", 2, 7, 10)])
    r = evaluate.segmentation_metrics(pred, gt).first()
    # k = 2 and eight windows (i, i + 2]; those at i = 4 and i = 6 hold one of 6 and 7
    assert (r.pk, r.windowdiff) == (2 / 8, 2 / 8)
    # one match, one near miss
    assert (r.boundary_similarity, r.bed_precision, r.bed_recall, r.bed_fmeasure) == (0.75, 0.75, 0.75, 0.75)
    gone = evaluate.segmentation_metrics(pred, spans(spark, [("e", 0, 0, 4)])).orderBy("doc_id").collect()
    assert [(x.doc_id, x.pk, x.windowdiff, x.boundary_similarity, x.bed_fmeasure) for x in gone] == [("d", 1.0, 1.0, 0.0, 0.0), ("e", 1.0, 1.0, 0.0, 0.0)]
    assert evaluate.segmentation_metrics(spans(spark, [("z", 0, 0, 0)]), spans(spark, [("z", 0, 0, 0)])).first().pk == 1.0


def plain_windows(ref, hyp):
    edges = lambda m: {sum(m[:i]) for i in range(1, len(m))}
    n, rb, hb = sum(ref), edges(ref), edges(hyp)
    k = max(2, int(n / len(ref) / 2 + 0.5))
    pairs = [(sum(i < b <= i + k for b in rb), sum(i < b <= i + k for b in hb)) for i in range(n - k)]
    if not pairs:
        return 1.0, 1.0
    return sum((a == 0) != (b == 0) for a, b in pairs) / len(pairs), sum(a != b for a, b in pairs) / len(pairs)


def plain_edits(ref, hyp):
    edges = lambda m: {sum(m[:i]) for i in range(1, len(m))}
    rb, hb = edges(ref), edges(hyp)
    used = []
    for x in sorted(rb - hb):
        free = [y for y in sorted(hb - rb) if abs(x - y) == 1 and y not in used]
        used += free[:1]
    return len(rb & hb), len(used), len(rb ^ hb) - 2 * len(used)


def test_windows_and_edits_equal_a_walk_over_all_units(spark):
    import random

    r = random.Random(9)

    def cut(n):
        edges = [0, *sorted(r.sample(range(1, n), r.randrange(n))), n]
        return [b - a for a, b in zip(edges, edges[1:])]

    cases = [(k, cut(n), cut(n)) for k in range(200) for n in [r.randrange(1, 60)]]
    cases += [(1000, [5], [5]), (1001, [1], [1]), (1002, [100_000, 100_000], [99_999, 100_001])]
    both = spark.createDataFrame(cases, "doc_id int, ref array<int>, hyp array<int>")
    got = {x.doc_id: (x.pk, x.windowdiff) for x in evaluate.window_metrics(both).collect()}
    edits = {x.doc_id: (x.matches, x.near, x.additions) for x in evaluate.border_edits(both).collect()}
    assert set(got) == set(edits) == {c[0] for c in cases}
    for k, ref, hyp in cases:
        assert got[k] == pytest.approx(plain_windows(ref, hyp)) and edits[k] == plain_edits(ref, hyp)


def test_greedy_matches(spark):
    # ties go to the lower index; a true segment serves once
    gt = spans(spark, [("d", 0, 8, 18), ("d", 1, 12, 22), ("d", 2, 40, 50)])
    pred = spans(spark, [("d", 0, 10, 20), ("d", 1, 10, 20), ("d", 2, 10, 20), ("d", 3, 43, 50)])
    assert {(r.p, r.g) for r in evaluate.match_boundaries(pred, gt).collect()} == {(0, 0), (1, 1)}
    half = evaluate.match_by_iou(spans(spark, [("d", 0, 0, 10)]), spans(spark, [("d", 0, 0, 5)]))
    assert [(r.p, r.g) for r in half.collect()] == [(0, 0)]


def test_themes_and_topics(spark):
    pred = spans(spark, [("d", 0, 0, 10, " Road works ", ["a", "b", "a"]), ("d", 1, 10, 20, None, None), ("e", 0, 0, 5, "x", ["a"])], THEMED)
    gt = spans(spark, [("d", 0, 0, 10, "WORKS", ["b", "c"]), ("d", 1, 10, 20, "y", ["z"])], THEMED)
    got = evaluate.theme_accuracy(pred, gt).collect()
    assert [(r.doc_id, r.matched, r.agreeing, r.theme_accuracy) for r in got] == [("d", 2, 2, 1.0)]  # the empty theme is in every other
    r = evaluate.topic_scores(pred, gt).first()
    assert (r.topic_precision, r.topic_recall) == (1 / 2, 1 / 3) and r.topic_f1 == pytest.approx(0.4)


def test_theme_similarity_takes_a_scorer(spark):
    pred = spans(spark, [("d", 0, 0, 10, "ab", None), ("d", 1, 10, 20, " \n", None), ("e", 0, 0, 5, "x", None)], THEMED)
    gt = spans(spark, [("d", 0, 0, 10, "abcd", None), ("d", 1, 10, 20, None, None), ("e", 0, 50, 60, "x", None)], THEMED)

    def scorer(a, b):
        assert all(x == " " or x.strip() for x in [*a, *b])
        return [len(x) for x in a], [len(x) for x in b], [float(x == y) for x, y in zip(a, b)]

    got = [tuple(r) for r in evaluate.theme_similarity(pred, gt, scorer).collect()]
    assert got == [("d", 1.5, 2.5, 0.5)]


def result(*items):
    return {"agenda_items": [{"item_id": k + 1, "item_title": "t", "start": a, "end": b, "text": "", "subjects": s} for k, (a, b, s) in enumerate(items)]}


def sub(a, b, theme="t", **more):
    return {"start": a, "end": b, "theme": theme, **more}


def test_evaluation_of_files(spark, tmp_path, capsys):
    pred = result((0, 10, [sub(0, 5, topics=["a"]), sub(5, 10)]), (10, 20, []))
    gt = result((0, 11, [sub(0, 5, topics=["a", "b"])]), (11, 20, [sub(11, 20)]))
    for name, data in (("pred", pred), ("gt", gt)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "doc 1.json").write_text(json.dumps(data))
        (tmp_path / name / "empty.json").write_text(json.dumps(result() if name == "pred" else gt))
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
    alone = evaluate.evaluate_files(spark, str(tmp_path / "pred.json"), str(tmp_path / "gt.json"), verbose=False)["overall"].collect()
    assert [(r.pred_items, r.gt_items, r.pred_subjects, r.gt_subjects) for r in alone] == [(2, 2, 2, 2)]
    for paths in ((tmp_path / "pred", tmp_path / "gt"),):
        levels = evaluate.evaluate_files(spark, *map(str, paths))
        items, subjects = levels["agenda_items"].collect(), levels["subjects"].collect()
        assert len(items) == len(subjects) == 1 and items[0].doc_id == subjects[0].doc_id
        r = items[0]
        assert (r.stage, r.num_predicted, r.num_ground_truth, r.true_positives) == ("agenda_items", 2, 2, 2)
        s = subjects[0]
        assert (s.stage, s.num_predicted, s.num_ground_truth, s.true_positives, s.theme_accuracy) == ("subjects", 2, 2, 1, 1.0)
        assert (s.topic_precision, s.topic_recall) == (1.0, 0.5)
        total = {r.doc_id: r for r in levels["overall"].collect()}[r.doc_id]
        assert (total.pred_items, total.gt_items, total.pred_subjects, total.gt_subjects, total.avg_subjects_pred, total.avg_subjects_gt) == (2, 2, 2, 2, 1.0, 1.0)
        said = capsys.readouterr().out
        assert "agenda_items of" in said and "boundary_precision: 1.0000" in said and "overall of" in said
    assert {r.doc_id: (r.pred_items, r.gt_items, r.avg_subjects_pred) for r in evaluate.evaluate_files(spark, str(tmp_path / "pred"), str(tmp_path / "gt"), verbose=False)["overall"].collect()}["empty"] == (0, 2, 0.0)
    assert capsys.readouterr().out == ""


def test_topics_count_only_where_first_subjects_have_them(spark, tmp_path):
    for name, topics in (("p", {}), ("g", {"topics": ["a"]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(result((0, 10, [sub(0, 10, **topics)]))))
    s = evaluate.evaluate_files(spark, str(tmp_path / "p.json"), str(tmp_path / "g.json"), verbose=False)["subjects"].first()
    assert s.theme_accuracy == 1.0 and s.topic_f1 is None and s.true_positives == 1
