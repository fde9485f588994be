"""What the steps of the flows and scores deal between tasks: texts seldom, offsets alone where no text is read."""

import re

import pytest

from loamtext.operators import chunks, minutes, segments, sentences
from loamtext.plans import catalogue, pipelines, views


def exchanges(df):
    """The columns of each exchange of the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    formatted = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    dealt = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", formatted)
    assert len(dealt) == len(re.findall(r"Exchange (?:hash|range|Round|single)", plan, re.I))
    return [{c.split("#")[0] for c in d.split(", ")} for d in dealt]


@pytest.fixture
def docs(spark):
    rows = [(1, 'One. "Two" here!\n\nThree? Four. Five. Six. '), (2, "- \n1.\n*"), (3, " \n"), (4, None), (5, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_whole_documents_are_asked_for_without_an_exchange(docs):
    requests = pipelines.item_requests(docs, pipelines.Config())
    assert exchanges(requests) == []
    got = {r.doc_id: r.prompt for r in requests.collect()}
    assert set(got) == {1, 2} and got[1].endswith('S1: "One."\nS2: "\\"Two\\" here!"\nS3: "Three?"\nS4: "Four."\nS5: "Five."\nS6: "Six."')
    assert got == {r.doc_id: r.prompt for r in pipelines.item_requests(sentences.split_sentences(docs), pipelines.Config()).collect()}


def test_lines_of_chunks_deal_a_text_once_and_number_as_the_rows_do(spark, docs):
    cut = spark.createDataFrame([(1, "a", 1, 3), (1, "b", 3, 9), (1, "c", 5, 4), (1, "d", 7, 9), (1, "e", 0, 2), (3, "f", 1, 2)], "doc_id long, chunk_no string, first_num int, last_num int")
    lines = chunks.chunk_lines(docs, cut)
    assert sum("text" in d for d in exchanges(lines)) <= 1
    rows = {}
    for r in chunks.chunk_sentences(sentences.split_sentences(docs), cut.where("first_num <= last_num")).orderBy("sent_num").collect():
        rows.setdefault(r.chunk_no, []).append(f'S{r.rel_num}: "' + r.text.replace('"', '\\"') + '"')
    assert {r.chunk_no: (r.n, r.lines) for r in lines.collect()} == {k: (len(v), "\n".join(v)) for k, v in rows.items()}
    assert set(rows) == {"a", "b", "e"}


def test_offsets_and_blocks_deal_no_text(spark, small):
    for df in (views.sentences(spark, small).drop("text"), views.pred(spark, small), views.truth(spark, small).drop("line")):
        dealt = exchanges(df)
        assert dealt and not any(d & {"text", "raw", "line", "body"} for d in dealt)


def test_spans_are_placed_as_by_joins(spark, docs):
    items = spark.createDataFrame([(1, 0, 1, 2), (1, 1, 3, 6), (1, 2, 6, 7), (1, 3, 0, 1), (1, 4, 4, 2), (3, 0, 1, 1)], "doc_id long, idx int, start_num int, end_num int")
    sents = sentences.split_sentences(docs)
    shown = lambda df: sorted((r.doc_id, r.idx, r.start, r.end, r.text) for r in df.collect())
    got = shown(segments.with_text(segments.place(items, sentences.spans(sents)), docs))
    assert got == shown(segments.annotate(items, sents, docs)) and [x[1] for x in got] == [0, 1, 4]


def test_titles_are_searched_one_row_a_document(spark):
    docs = spark.createDataFrame([(1, "aXa é𝄞aX aX"), (2, None), (3, "")], "doc_id long, text string")
    asked = [(1, 0, "aX", 11), (1, 1, "aX", 9), (1, 2, "aX", 1), (1, 3, "", 5), (1, 4, None, 5), (1, 5, "aX", -3), (1, 6, "𝄞a", 99), (1, 7, "aX", None), (2, 0, "a", 3), (3, 0, "a", 3)]
    titles = spark.createDataFrame(asked, "doc_id long, idx int, title string, before int")
    got = {(r.doc_id, r.idx): r.pos for r in minutes.last_places(titles, docs).collect()}
    assert got == {(1, 0): 9, (1, 1): 6, (1, 2): None, (1, 3): None, (1, 4): None, (1, 5): None, (1, 6): 5, (1, 7): None, (2, 0): None, (3, 0): None}


def test_a_title_is_not_joined_to_a_copy_of_its_text(spark, small):
    plan = catalogue.QUERIES["q_title_last"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"reverse\(", plan)


@pytest.mark.parametrize("name", ["q_minutes_flow", "q_articles_flow"])
def test_flows_equal_their_sql_where_texts_are_blank(spark, compare, tmp_path, name):
    rows = [(1, "A. B. C. D. E. F. G.", "x"), (2, "", "x"), (3, None, "y"), (4, " \n\t", None), (5, "A. B.", None), (6, "\x1e \x1e", "x"), (7, "\x1e.", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    compare(name, str(tmp_path))
