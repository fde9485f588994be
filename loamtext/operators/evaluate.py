"""Scores of predicted segments against true ones.

Tables: ``pred`` and ``gt`` with ``doc_id, idx, start, end`` (half-open characters, or
sentence indices).  Joins between the two sides are keyed by document and by the place
of the segments, so they make the pairs that overlap or nearly match and no others.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamtext.functions import f1, iou, ratio

Keep = Callable[[DataFrame], DataFrame]

TOLERANCE = 2
IOU_THRESHOLD = 0.5
#: Width of the place buckets of the overlap join.
BUCKET = 2048


def as_of(points: DataFrame, starts: DataFrame, *keys: str) -> DataFrame:
    """``points`` with ``value`` of the last start at or before ``pos``; null before the first.

    Backward as-of join as one sorted pass per document: starts and points are merged
    and the last start's value is carried forward.
    """
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    left = starts.select("doc_id", "pos", "value", F.lit(0).alias("kind"), *(F.lit(None).cast(kinds[k]).alias(k) for k in keys))
    right = points.select("doc_id", "pos", F.lit(None).cast(dict(starts.dtypes)["value"]).alias("value"), F.lit(1).alias("kind"), *keys)
    w = Window.partitionBy("doc_id").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    carried = left.union(right).withColumn("value", F.last("value", ignorenulls=True).over(w))
    return carried.where("kind = 1").select("doc_id", "pos", *keys, "value")


def to_sentence_units(segments: DataFrame, sentences: DataFrame) -> DataFrame:
    """Character spans to 0-based sentence indices: the last sentence that starts at or
    before each end, from 0, end not before start.  Without sentences spans stay."""
    ends = segments.select("doc_id", "idx", F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("start").alias("pos")), F.struct(F.lit(1).alias("e"), F.col("end").alias("pos")))).alias("x"))
    points = ends.select("doc_id", "idx", "x.e", "x.pos")
    starts = sentences.select("doc_id", F.col("start").alias("pos"), (F.col("sent_num") - 1).alias("value"))
    found = as_of(points, starts, "idx", "e").withColumn("value", F.coalesce("value", F.lit(0)))
    some = sentences.select("doc_id").distinct().withColumn("has", F.lit(True))
    wide = found.groupBy("doc_id", "idx").agg(
        F.max(F.when(F.col("e") == 0, F.col("value"))).alias("s"),
        F.max(F.when(F.col("e") == 1, F.col("value"))).alias("t"),
        F.max(F.when(F.col("e") == 0, F.col("pos"))).alias("raw_s"),
        F.max(F.when(F.col("e") == 1, F.col("pos"))).alias("raw_t"),
    )
    known = F.col("has").isNotNull()
    return wide.join(some, "doc_id", "left").select(
        "doc_id",
        "idx",
        F.when(known, F.col("s")).otherwise(F.col("raw_s")).alias("start"),
        F.when(known, F.greatest("s", "t")).otherwise(F.col("raw_t")).alias("end"),
    )


def sentence_starts_from_lengths(sentences: DataFrame) -> DataFrame:
    """Sentences placed as if one character stood between neighbours (``start`` replaced)."""
    w = Window.partitionBy("doc_id").orderBy("sent_num")
    n = F.char_length("text") + 1
    return sentences.withColumn("start", (F.sum(n).over(w) - n).cast("int"))


def _greedy(pairs: DataFrame) -> DataFrame:
    """``doc_id, p, g``: in order of p, each takes the cheapest g still free (least g on ties).

    The choice of one depends on all before it: one pass over a document's candidates, which
    the joins before have cut down to a few for each p.
    """
    listed = pairs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("p", "cost", "g"))).alias("l"))
    numbers = lambda name: F.transform("l", lambda x: x[name].cast("int"))

    @F.pandas_udf("array<boolean>")
    def takes(ps: pd.Series, gs: pd.Series) -> pd.Series:
        def walk(p_row, g_row) -> list[bool]:
            used: set[int] = set()
            last, out = None, []
            for p, g in zip(p_row.tolist(), g_row.tolist()):
                free = p != last and g not in used
                if free:
                    last = p
                    used.add(g)
                out.append(free)
            return out

        return pd.Series([walk(a, b) for a, b in zip(ps, gs)], dtype=object)

    taken = listed.select("doc_id", numbers("p").alias("p"), numbers("g").alias("g")).withColumn("t", takes("p", "g"))
    rows = taken.select("doc_id", F.explode(F.arrays_zip("p", "g", "t")).alias("m"))
    return rows.where("m.t").select("doc_id", "m.p", "m.g")


def match_boundaries(pred: DataFrame, gt: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """``doc_id, p, g``: greedy one-to-one matches whose ends both differ by at most ``tolerance``."""
    near = pred.select("doc_id", F.col("idx").alias("p"), F.col("start").alias("ps"), F.col("end").alias("pe"), F.explode(F.sequence(F.col("start") - tolerance, F.col("start") + tolerance)).alias("gs"))
    other = gt.select("doc_id", F.col("idx").alias("g"), F.col("start").alias("gs"), F.col("end").alias("ge"))
    cost = F.abs(F.col("ps") - F.col("gs")) + F.abs(F.col("pe") - F.col("ge"))
    pairs = near.join(other, ["doc_id", "gs"]).where(F.abs(F.col("pe") - F.col("ge")) <= tolerance)
    return _greedy(pairs.select("doc_id", "p", "g", cost.cast("double").alias("cost")))


def overlapping(pred: DataFrame, gt: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, p, g, iou`` of the pairs that share a character: an interval join.

    Both sides are listed in the buckets that they touch; a pair is kept in the first
    bucket that both touch.
    """

    def placed(df: DataFrame, name: str) -> DataFrame:
        some = df.where(F.col("end") > F.col("start"))
        return some.select(
            "doc_id",
            F.col("idx").alias(name),
            F.col("start").alias(f"{name}s"),
            F.col("end").alias(f"{name}e"),
            F.expr(f"start div {bucket}").alias(f"{name}b"),
            F.explode(F.sequence(F.expr(f"start div {bucket}"), F.expr(f"(end - 1) div {bucket}"))).alias("b"),
        )

    pairs = placed(pred, "p").join(placed(gt, "g"), ["doc_id", "b"])
    pairs = pairs.where((F.col("b") == F.greatest("pb", "gb")) & (F.col("ps") < F.col("ge")) & (F.col("gs") < F.col("pe")))
    return pairs.select("doc_id", "p", "g", iou(F.col("ps"), F.col("pe"), F.col("gs"), F.col("ge")).alias("iou"))


def best_iou(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """``doc_id, p, iou``: for each prediction its best true segment (which may serve many)."""
    best = overlapping(pred, gt).groupBy("doc_id", "p").agg(F.max("iou").alias("iou"))
    return pred.select("doc_id", F.col("idx").alias("p")).join(best, ["doc_id", "p"], "left").fillna(0.0, ["iou"])


def match_by_iou(pred: DataFrame, gt: DataFrame, threshold: float = IOU_THRESHOLD) -> DataFrame:
    """``doc_id, p, g``: greedy one-to-one matches by best overlap of at least ``threshold``."""
    pairs = overlapping(pred, gt).where(F.col("iou") >= threshold)
    return _greedy(pairs.select("doc_id", "p", "g", (-F.col("iou")).alias("cost")))


def counts(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """``doc_id, num_predicted, num_ground_truth`` of the documents on either side."""
    both = pred.select("doc_id", F.lit(1).alias("p"), F.lit(0).alias("g")).union(gt.select("doc_id", F.lit(0), F.lit(1)))
    return both.groupBy("doc_id").agg(F.sum("p").alias("num_predicted"), F.sum("g").alias("num_ground_truth"))


def precision_recall(matches: DataFrame, sizes: DataFrame) -> DataFrame:
    """True and false positives, false negatives, precision, recall and F1 per document."""
    tp = matches.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tp"))
    joined = sizes.join(tp, "doc_id", "left").fillna(0, ["tp"])
    precision, recall = ratio(F.col("tp"), F.col("num_predicted")), ratio(F.col("tp"), F.col("num_ground_truth"))
    return joined.select(
        "doc_id",
        "num_predicted",
        "num_ground_truth",
        F.col("tp").alias("true_positives"),
        (F.col("num_predicted") - F.col("tp")).alias("false_positives"),
        (F.col("num_ground_truth") - F.col("tp")).alias("false_negatives"),
        precision.alias("boundary_precision"),
        recall.alias("boundary_recall"),
        f1(precision, recall).alias("boundary_f1"),
    )


def masses(segments: DataFrame, totals: DataFrame) -> DataFrame:
    """``doc_id, masses``: lengths of gaps and segments in order up to ``total`` (``totals``: doc_id, total)."""
    w = Window.partitionBy("doc_id").orderBy("start", "idx")
    before = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = segments.select("doc_id", "start", "idx", "end", before.alias("at"))
    pair = F.array(F.greatest(F.col("start") - F.col("at"), F.lit(0)), F.greatest(F.col("end") - F.greatest("start", "at"), F.lit(0)))
    listed = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "idx", pair.alias("m")))).alias("l"), F.max("end").alias("last"))
    joined = totals.join(listed, "doc_id", "left")
    inner = F.coalesce(F.flatten(F.transform("l", lambda x: x.m)), F.array().cast("array<int>"))
    tail = F.array((F.col("total") - F.greatest(F.coalesce("last", F.lit(0)), F.lit(0))).cast("int"))
    return joined.select("doc_id", F.filter(F.concat(inner, tail), lambda m: m > 0).alias("masses"))


def aligned(ref: Column, hyp: Column) -> tuple[Column, Column]:
    """Both mass arrays with the shorter total padded on its last mass."""
    total = lambda m: F.aggregate(m, F.lit(0), lambda a, x: a + x)

    def pad(m: Column, by: Column) -> Column:
        n = F.size(m)
        return F.when((by > 0) & (n > 0), F.transform(m, lambda x, i: F.when(i == n - 1, x + by).otherwise(x))).otherwise(m)

    return pad(ref, total(hyp) - total(ref)), pad(hyp, total(ref) - total(hyp))


def _border_rows(both: DataFrame) -> DataFrame:
    """``doc_id, total, n_ref, n_hyp, side, pos``: the inner borders of both mass arrays (side 0: ref, 1: hyp).

    Every document has a row; ``pos`` is null where a side has no inner border.
    """
    sizes = both.select("doc_id", "ref", "hyp", F.size("ref").alias("n_ref"), F.size("hyp").alias("n_hyp"))
    sided = lambda name, side: F.transform(name, lambda m, i: F.struct(F.lit(side).alias("side"), i.alias("i"), m.alias("m")))
    rows = sizes.select("doc_id", "n_ref", "n_hyp", F.explode_outer(F.concat(sided("ref", 0), sided("hyp", 1))).alias("x")).select("doc_id", "n_ref", "n_hyp", "x.*")
    by_side = Window.partitionBy("doc_id", "side").orderBy("i")
    total = F.sum("m").over(Window.partitionBy("doc_id", "side"))
    last = F.col("i") + 1 == F.when(F.col("side") == 0, F.col("n_ref")).otherwise(F.col("n_hyp"))
    return rows.select("doc_id", total.alias("total"), "n_ref", "n_hyp", "side", F.when(~last, F.sum("m").over(by_side)).alias("pos"))


def window_metrics(both: DataFrame) -> DataFrame:
    """``pk`` and ``windowdiff`` from ``doc_id, ref, hyp`` (masses of equal total).

    Windows of k = half the mean true mass, at least 2; 1.0 where no window fits.  The
    number of borders in a window changes only where the window meets or leaves a border,
    so the windows between two such places are counted at once: the rows are borders, not
    units, and all steps are dealt by document.
    """
    k = F.greatest(F.lit(2), F.round(F.col("total") / F.col("n_ref") / 2).cast("long"))
    base = _border_rows(both).withColumn("n", F.when((F.col("n_ref") > 0) & (F.col("n_hyp") > 0), F.greatest(F.col("total") - k, F.lit(0))).otherwise(0))
    one = F.when(F.col("pos").isNull(), 0).otherwise(1)
    step = lambda at, d: F.struct(at.cast("long").alias("at"), (F.when(F.col("side") == 0, one).otherwise(0) * d).alias("r"), (F.when(F.col("side") == 1, one).otherwise(0) * d).alias("h"))
    steps = F.array(step(F.lit(0), 0), step(F.greatest(F.coalesce(F.col("pos") - k, F.lit(0)), F.lit(0)), 1), step(F.coalesce("pos", F.lit(0)), -1))
    places = base.select("doc_id", "n", F.explode(steps).alias("s")).select("doc_id", "n", "s.*").where("at < n or at = 0")
    by_place = Window.partitionBy("doc_id").orderBy("at")
    counted = places.select(
        "doc_id",
        "n",
        F.sum("r").over(by_place).alias("r"),  # peers included: the count behind all steps at this place
        F.sum("h").over(by_place).alias("h"),
        (F.least(F.coalesce(F.lead("at").over(by_place), F.col("n")), F.col("n")) - F.col("at")).alias("windows"),
    )
    errors = lambda wrong: F.sum(F.when(wrong, F.col("windows")).otherwise(0))
    sums = counted.groupBy("doc_id").agg(
        errors((F.col("r") == 0) != (F.col("h") == 0)).alias("pk_errors"), errors(F.col("r") != F.col("h")).alias("wd_errors"), F.max("n").alias("windows")
    )
    part = lambda c: F.when(F.col("windows") > 0, F.col(c) / F.col("windows")).otherwise(F.lit(1.0))
    return sums.select("doc_id", part("pk_errors").alias("pk"), part("wd_errors").alias("windowdiff"))


def near_pairs(labels: Column) -> Column:
    """Pairs of neighbours in a run of adjacent borders, ``r`` (true) and ``h`` (predicted).

    In order, each ``r`` takes the ``h`` before it if that is free, else the one behind it, so
    all that matters is the border before: 1 a free ``h``, 2 an ``r`` that has none yet.
    """
    start = F.struct(F.lit(0).alias("pairs"), F.lit(0).alias("open"))

    def add(acc: Column, label: Column) -> Column:
        mine, other = F.when(label == "h", 1).otherwise(2), F.when(label == "h", 2).otherwise(1)
        met = acc["open"] == other
        return F.struct((acc["pairs"] + F.when(met, 1).otherwise(0)).alias("pairs"), F.when(met, 0).otherwise(mine).alias("open"))

    return F.aggregate(labels, start, add, lambda acc: acc["pairs"])


def border_edits(both: DataFrame, near_weight: float = 0.5) -> DataFrame:
    """Boundary edit distance with near misses one unit apart, from ``doc_id, ref, hyp``.

    Columns: ``matches, near, additions`` (all other borders of either side),
    ``similarity`` and precision, recall and F of the border confusion, in which a near
    miss counts ``near_weight`` as a match.  The rows are borders; all steps are dealt by document.
    """
    places = _border_rows(both).groupBy("doc_id", "pos").agg(F.max(F.when(F.col("side") == 0, 1).otherwise(0)).alias("r"), F.max(F.when(F.col("side") == 1, 1).otherwise(0)).alias("h"))
    label = F.when(F.col("pos").isNull(), "none").when((F.col("r") == 1) & (F.col("h") == 1), "both").when(F.col("r") == 1, "r").otherwise("h")
    by_place = Window.partitionBy("doc_id").orderBy("pos")
    marked = places.select("doc_id", "pos", label.alias("label"))
    alone = F.col("label").isin("r", "h")
    follows = alone & F.coalesce((F.lag("pos").over(by_place) == F.col("pos") - 1) & F.lag(alone).over(by_place), F.lit(False))
    runs = marked.withColumn("opens", F.when(follows, 0).otherwise(1)).withColumn("run", F.sum("opens").over(by_place))
    listed = runs.groupBy("doc_id", "run").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x.label).alias("l"))
    of = lambda name: F.size(F.filter("l", lambda x: x == name))
    edits = listed.select("doc_id", of("both").alias("both"), of("r").alias("r"), of("h").alias("h"), near_pairs(F.filter("l", lambda x: x.isin("r", "h"))).alias("near"))
    sums = edits.groupBy("doc_id").agg(*(F.sum(c).cast("int").alias(n) for c, n in (("both", "matches"), ("near", "near"), ("r", "r"), ("h", "h"))))
    sums = sums.select("doc_id", "matches", "near", (F.col("r") - F.col("near")).alias("missed"), (F.col("h") - F.col("near")).alias("extra"))
    additions = F.col("missed") + F.col("extra")
    every = additions + F.col("near") + F.col("matches")
    similarity = F.when(every > 0, 1 - (additions + near_weight * F.col("near")) / every).otherwise(F.lit(1.0))
    good = F.col("matches") + near_weight * F.col("near")
    precision = ratio(good, F.col("matches") + F.col("near") + F.col("extra"))
    recall = ratio(good, F.col("matches") + F.col("near") + F.col("missed"))
    return sums.select(
        "doc_id",
        "matches",
        "near",
        additions.alias("additions"),
        similarity.alias("boundary_similarity"),
        precision.alias("bed_precision"),
        recall.alias("bed_recall"),
        f1(precision, recall).alias("bed_fmeasure"),
    )


def mass_pairs(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """``doc_id, ref, hyp``: aligned masses of the documents that both sides have."""
    ends = pred.groupBy("doc_id").agg(F.max("end").alias("pe")).join(gt.groupBy("doc_id").agg(F.max("end").alias("ge")), "doc_id")
    totals = ends.select("doc_id", F.greatest("pe", "ge", F.lit(0)).alias("total")).where("total > 0")
    two = masses(gt, totals).withColumnRenamed("masses", "ref").join(masses(pred, totals).withColumnRenamed("masses", "hyp"), "doc_id")
    ref, hyp = aligned(F.col("ref"), F.col("hyp"))
    return two.select("doc_id", ref.alias("ref"), hyp.alias("hyp"))


def segmentation_metrics(pred: DataFrame, gt: DataFrame, keep: Keep = lambda df: df) -> DataFrame:
    """Window and border-edit metrics per document; 0 and 1.0 where they are undefined.

    ``keep`` may cut the lineage of what is read twice (a checkpoint or a cached table).
    """
    both = keep(mass_pairs(pred, gt))
    docs = counts(pred, gt).select("doc_id")
    out = docs.join(window_metrics(both), "doc_id", "left").join(border_edits(both).drop("matches", "near", "additions"), "doc_id", "left")
    return out.fillna(1.0, ["pk", "windowdiff"]).fillna(0.0, ["boundary_similarity", "bed_precision", "bed_recall", "bed_fmeasure"])


def _clean_theme(c: str) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"^\s+|\s+$", "")


def matched_pairs(pred: DataFrame, gt: DataFrame, **columns: Column) -> DataFrame:
    """``doc_id, p, g`` of the matched pairs, and ``<name>_p``, ``<name>_g`` for each of ``columns``."""
    side = lambda df, key: df.select("doc_id", F.col("idx").alias(key), *(c.alias(f"{name}_{key}") for name, c in columns.items()))
    return match_by_iou(pred, gt).join(side(pred, "p"), ["doc_id", "p"]).join(side(gt, "g"), ["doc_id", "g"])


def theme_accuracy(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """``doc_id, matched, agreeing, theme_accuracy`` over the matched pairs.

    Themes agree if one contains the other, lower-cased and stripped.
    """
    pairs = matched_pairs(pred, gt, theme=_clean_theme("theme"))
    agree = F.col("theme_p").contains(F.col("theme_g")) | F.col("theme_g").contains(F.col("theme_p"))
    found = pairs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("matched"), F.sum(F.when(agree, 1).otherwise(0)).alias("agreeing"))
    out = counts(pred, gt).where("num_predicted > 0 and num_ground_truth > 0").select("doc_id").join(found, "doc_id", "left").fillna(0, ["matched", "agreeing"])
    return out.withColumn("theme_accuracy", ratio(F.col("agreeing"), F.col("matched")))


def theme_similarity(pred: DataFrame, gt: DataFrame, scorer: Callable[[list[str], list[str]], tuple]) -> DataFrame:
    """``doc_id, theme_bertscore_precision, _recall, _f1``: means over the matched pairs.

    ``scorer`` gives precision, recall and F1 for each pair of two lists of themes, as the
    scorers of neural similarity do; it runs on the executors, batch by batch.  A blank
    theme is given as one space.  Documents without matched pairs have no row.
    """
    theme = F.coalesce("theme", F.lit(""))
    pairs = matched_pairs(pred, gt, theme=F.when(theme.rlike(r"\S"), theme).otherwise(" "))
    kinds = "precision double, recall double, f1 double"

    @F.pandas_udf(kinds)
    def scored(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        columns = scorer(a.tolist(), b.tolist())
        return pd.DataFrame({n: [float(x) for x in c] for n, c in zip(("precision", "recall", "f1"), columns)})

    rows = pairs.select("doc_id", scored("theme_p", "theme_g").alias("s"))
    return rows.groupBy("doc_id").agg(*(F.avg(f"s.{n}").alias(f"theme_bertscore_{n}") for n in ("precision", "recall", "f1")))


def topic_scores(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """Micro precision, recall and F1 of the topic sets over the matched pairs."""
    pairs = matched_pairs(pred, gt, topics=F.array_distinct(F.coalesce("topics", F.array().cast("array<string>"))))
    sums = pairs.groupBy("doc_id").agg(
        F.sum(F.size(F.array_intersect("topics_p", "topics_g"))).alias("shared"), F.sum(F.size("topics_p")).alias("n_pred"), F.sum(F.size("topics_g")).alias("n_gt")
    )
    out = counts(pred, gt).where("num_predicted > 0 and num_ground_truth > 0").select("doc_id").join(sums, "doc_id", "left").fillna(0, ["shared", "n_pred", "n_gt"])
    precision, recall = ratio(F.col("shared"), F.col("n_pred")), ratio(F.col("shared"), F.col("n_gt"))
    return out.select("doc_id", precision.alias("topic_precision"), recall.alias("topic_recall"), f1(precision, recall).alias("topic_f1"))


def evaluate_level(pred: DataFrame, gt: DataFrame, sentences: DataFrame | None = None, tolerance: int = TOLERANCE, stage: str = "agenda_items", keep: Keep = lambda df: df) -> DataFrame:
    """All boundary metrics of one level, for documents with segments on either side.

    Matching is in sentence units where sentences are given, overlap in characters.
    ``keep`` may cut the lineage of what is read several times.
    """
    if sentences is not None:
        unit_pred, unit_gt = keep(to_sentence_units(pred, sentences)), keep(to_sentence_units(gt, sentences))
    else:
        unit_pred, unit_gt = pred, gt
    out = precision_recall(match_boundaries(unit_pred, unit_gt, tolerance), counts(pred, gt))
    some = gt.select("doc_id").distinct()
    mean = best_iou(pred, gt).groupBy("doc_id").agg(F.avg("iou").alias("avg_iou")).join(some, "doc_id", "left_semi")
    return out.join(mean, "doc_id", "left").join(segmentation_metrics(unit_pred, unit_gt, keep), "doc_id", "left").withColumn("stage", F.lit(stage))


def evaluate_subjects(pred: DataFrame, gt: DataFrame, sentences: DataFrame | None = None, tolerance: int = TOLERANCE, topics: bool = True) -> DataFrame:
    out = evaluate_level(pred, gt, sentences, tolerance, "subjects")
    out = out.join(theme_accuracy(pred, gt).select("doc_id", "theme_accuracy"), "doc_id", "left")
    return out.join(topic_scores(pred, gt), "doc_id", "left") if topics else out


def overall(pred_items: DataFrame, gt_items: DataFrame, pred_subjects: DataFrame, gt_subjects: DataFrame) -> DataFrame:
    """Totals and mean subjects per item of each document."""
    names = {"pred_items": pred_items, "gt_items": gt_items, "pred_subjects": pred_subjects, "gt_subjects": gt_subjects}
    parts = [df.select("doc_id", *(F.lit(int(n == m)).alias(n) for n in names)) for m, df in names.items()]
    every = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).groupBy("doc_id").agg(*(F.sum(n).alias(n) for n in names))
    return every.withColumns({"avg_subjects_pred": ratio(F.col("pred_subjects"), F.col("pred_items")), "avg_subjects_gt": ratio(F.col("gt_subjects"), F.col("gt_items"))})


def nested_items(result: DataFrame) -> DataFrame:
    """``doc_id, idx, start, end`` of the items of nested results (``doc_id, agenda_items``)."""
    return result.select("doc_id", F.posexplode("agenda_items").alias("idx", "i")).select("doc_id", "idx", "i.start", "i.end")


def nested_subjects(result: DataFrame) -> DataFrame:
    """``doc_id, idx, start, end, theme, topics`` of the subjects of all items, in order."""
    subjects = F.flatten(F.transform("agenda_items", lambda i: F.coalesce(i.subjects, F.array().cast(dict(result.select(F.col("agenda_items")[0]["subjects"].alias("s")).dtypes)["s"]))))
    rows = result.select("doc_id", F.posexplode(subjects).alias("idx", "s"))
    return rows.select("doc_id", "idx", "s.start", "s.end", "s.theme", "s.topics")


def evaluate_hierarchical(pred: DataFrame, gt: DataFrame, sentences: DataFrame | None = None, tolerance: int = TOLERANCE) -> dict[str, DataFrame]:
    """Both levels of nested results and their totals: ``agenda_items``, ``subjects``, ``overall``.

    A level is scored for the documents that have segments of it on both sides.  Topics
    count only where the first subject of either side has a list of them.
    """
    levels = {}
    sides = {"agenda_items": (nested_items(pred), nested_items(gt)), "subjects": (nested_subjects(pred), nested_subjects(gt))}
    for name, (p, g) in sides.items():
        p, g = p.join(g.select("doc_id").distinct(), "doc_id", "left_semi"), g.join(p.select("doc_id").distinct(), "doc_id", "left_semi")
        if name == "agenda_items":
            levels[name] = evaluate_level(p, g, sentences, tolerance)
            continue
        out = evaluate_subjects(p, g, sentences, tolerance)
        first = lambda df, c: df.where("idx = 0").select("doc_id", F.col("topics").isNotNull().alias(c))
        known = first(p, "in_p").join(first(g, "in_g"), "doc_id")
        gated = out.join(known, "doc_id")
        topics = {c: F.when(F.col("in_p") & F.col("in_g"), F.col(c)) for c in ("topic_precision", "topic_recall", "topic_f1")}
        levels[name] = gated.withColumns(topics).drop("in_p", "in_g")
    both = pred.select("doc_id").union(gt.select("doc_id")).distinct()
    totals = overall(sides["agenda_items"][0], sides["agenda_items"][1], sides["subjects"][0], sides["subjects"][1])
    levels["overall"] = both.join(totals, "doc_id", "left").fillna(0)
    return levels


def evaluate_files(spark: SparkSession, pred_path: str, gt_path: str, tolerance: int = TOLERANCE, verbose: bool = True) -> dict[str, DataFrame]:
    """:func:`evaluate_hierarchical` of result files, without sentences: units are characters.

    Files of two folders are matched by their stems; two single files are matched whatever
    their names.  With ``verbose`` the driver prints the report of each document.
    """
    from loamtext.sources.corpora import read_result

    pred, gt = read_result(spark, pred_path), read_result(spark, gt_path)
    if pred_path.endswith(".json") and gt_path.endswith(".json"):
        gt = gt.withColumn("doc_id", F.lit(pred.first()["doc_id"]))
    levels = evaluate_hierarchical(pred, gt, None, tolerance)
    if verbose:
        for name, df in levels.items():
            for r in report(df, [c for c, kind in df.dtypes if c != "doc_id" and kind != "string"]).orderBy("doc_id").toLocalIterator():
                print(f"{name} of {r.doc_id}: {r.line}")
    return levels


def corpus_summary(metrics: DataFrame, *groups: str) -> DataFrame:
    """Macro means and micro precision/recall over a ``rollup`` of the given columns."""
    tp, n, m = F.sum("true_positives"), F.sum("num_predicted"), F.sum("num_ground_truth")
    return metrics.rollup(*groups).agg(
        F.count(F.lit(1)).alias("documents"),
        tp.alias("true_positives"),
        ratio(tp, n).alias("micro_precision"),
        ratio(tp, m).alias("micro_recall"),
        F.avg("boundary_f1").alias("macro_f1"),
    )


def report(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """``doc_id, line``: the metrics as text with four decimals.

    Python rounds the exact binary value (1/32 is 0.0312), Java's formats the shortest decimal.
    """

    @F.pandas_udf("string")
    def four(values: pd.Series) -> pd.Series:
        return values.map(lambda x: "null" if x != x else f"{x:.4f}")

    parts = [F.concat(F.lit(f"{c}: "), four(F.col(c).cast("double"))) for c in columns]
    return metrics.select("doc_id", F.concat_ws(", ", *parts).alias("line"))
