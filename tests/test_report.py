"""The report covers every scored document and rounds as Python does."""

from loamtext.operators import evaluate
from loamtext.plans import catalogue


def test_ties_are_rounded_as_in_python(spark):
    values = [1 / 32, 3 / 32, 3 / 160, 1 / 160, 1 / 3, 0.0, 1.0]
    df = spark.createDataFrame(list(enumerate(values)), "doc_id long, p double")
    assert {r.doc_id: r.line for r in evaluate.report(df, ["p"]).collect()} == {k: f"p: {v:.4f}" for k, v in enumerate(values)}


def test_every_scored_document_has_a_line(spark, small):
    lines = catalogue.QUERIES["q_report"](spark, small)
    assert lines.count() == catalogue._scores(spark, small).count() > 0
