"""Overlap candidates between two polygon layers and one-to-one matching.

Greedy matching is a sequence: take the best pair left, drop its two members, repeat.  The same result
comes from rounds in which every pair that is best for both its members is taken at once, because no
later choice can affect such a pair.  A round is aggregations and joins, so a member with very many
candidates is combined before the shuffle.  A few rounds settle nearly all pairs; what is left is cut into
components of the candidate graph, and each small one is solved whole in one task, so that a long chain of
candidates costs no round per link.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from groundcheck.functions import geometry
from groundcheck.lineage import cut_lineage
from groundcheck.operators.components import contract
from groundcheck.operators.gridjoin import grid_pairs
from groundcheck.operators.polygons import pair_measures

#: Rounds before components are looked for, and again after as many.
ROUNDS = 3
#: Candidates of a component that one task solves; larger ones go on in rounds.
SMALL = 20_000


def iou_candidates(
    predictions: DataFrame, references: DataFrame, threshold: float, large: bool | None = None,
) -> DataFrame:
    """``a_ord, b_ord, a_id, b_id, iou`` of pairs reaching ``threshold`` (and above 0)."""

    def sides(df: DataFrame, side: str) -> DataFrame:
        return df.select(
            F.col("ord").alias(f"{side}_ord"), F.col("feature_id").alias(f"{side}_id"),
            geometry.area(F.col("edges")).alias(f"{side}_area"))

    m = pair_measures(grid_pairs(predictions, references), predictions, references, large)
    m = m.filter(F.col("area") > 0).join(sides(predictions, "a"), "a_ord").join(
        sides(references, "b"), "b_ord")
    union = F.col("a_area") + F.col("b_area") - F.col("area")
    iou = F.when(union > 0, F.col("area") / union).otherwise(0.0)
    return m.withColumn("iou", iou).filter(F.col("iou") >= threshold).select(
        "a_ord", "b_ord", "a_id", "b_id", "iou")


def _solved(small: DataFrame, a: str, b: str, order: list[tuple[str, bool]]) -> DataFrame:
    """The greedy choice inside components of a bounded size; ``order`` is the sequence of candidates."""
    names = [c for c in small.columns if c != "_label"]

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([c for c, _ in order], ascending=[up for _, up in order], kind="stable")
        used_a, used_b, kept = set(), set(), []
        for i, (x, y) in enumerate(zip(pdf[a], pdf[b])):
            if x not in used_a and y not in used_b:
                used_a.add(x)
                used_b.add(y)
                kept.append(i)
        return pdf.iloc[kept][names]

    return small.groupBy("_label").applyInPandas(greedy, small.drop("_label").schema)


def _one_to_one(
    candidates: DataFrame, a: str, b: str, rank_a: Column, rank_b: Column, order: list[tuple[str, bool]],
) -> DataFrame:
    """Mutual first choices in rounds; after ``ROUNDS`` of them small components are solved whole.

    ``rank_a``/``rank_b`` order the candidates of one member, ``order`` all candidates; all three say the same.
    """
    names = candidates.columns
    left = cut_lineage(candidates)
    taken = [left.limit(0)]
    turn = 0
    while not left.isEmpty():
        if turn and turn % ROUNDS == 0:
            ends = {side: F.concat(F.lit(side), F.col(c).cast("string")) for side, c in (("a", a), ("b", b))}
            labels = contract(left.select(ends["a"].alias("src"), ends["b"].alias("dst")))
            marked = left.withColumn("node", ends["a"]).join(
                labels.withColumnRenamed("label", "_label"), "node").drop("node")
            sizes = marked.groupBy("_label").agg(F.count(F.lit(1)).alias("_n"))
            sized = cut_lineage(marked.join(sizes, "_label"))
            taken.append(cut_lineage(_solved(sized.filter(F.col("_n") <= SMALL).drop("_n"), a, b, order).select(*names)))
            left = cut_lineage(sized.filter(F.col("_n") > SMALL).select(*names))
            if left.isEmpty():
                break
        first_a = left.groupBy(a).agg(F.min_by(F.col(b), rank_a).alias("_choice"))
        first_b = left.groupBy(b).agg(F.min_by(F.col(a), rank_b).alias("_back"))
        agreed = first_a.join(first_b, F.col("_choice") == F.col(b)).filter(
            F.col("_back") == F.col(a)).select(a, b)
        won = cut_lineage(left.join(agreed, [a, b]).select(*names))
        taken.append(won)
        left = cut_lineage(
            left.join(won.select(a), a, "left_anti").join(won.select(b), b, "left_anti").select(*names))
        turn += 1
    return reduce(DataFrame.unionByName, taken)


def match_best_first(candidates: DataFrame, a: str = "a_id", b: str = "b_id") -> DataFrame:
    """Greedy by descending overlap; equal overlaps go by prediction, then reference."""
    rank = F.struct(-F.col("iou"), F.col(a), F.col(b))
    return _one_to_one(candidates, a, b, rank, rank, [("iou", False), (a, True), (b, True)])


def match_in_order(candidates: DataFrame) -> DataFrame:
    """Predictions in list order, each taking its best free reference (the first at ties)."""
    return _one_to_one(
        candidates.filter(F.col("iou") > 0), "a_ord", "b_ord",
        F.struct(-F.col("iou"), F.col("b_ord")), F.struct(F.col("a_ord")),
        [("a_ord", True), ("iou", False), ("b_ord", True)])


def unmatched(layer: DataFrame, matched_ids: DataFrame) -> DataFrame:
    """Features of a layer that no pair used; ``matched_ids`` has ``feature_id``."""
    return layer.join(matched_ids, "feature_id", "left_anti")


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def scores(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; 0 wherever a denominator is 0."""
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return precision, recall, _ratio(2 * precision * recall, precision + recall)


def match_metrics(
    matched: DataFrame, predictions: DataFrame, references: DataFrame, threshold: float,
) -> DataFrame:
    """One row of counts and rates; without references every prediction counts as false."""
    counts = matched.agg(F.count(F.lit(1)).alias("tp")).join(
        predictions.agg(F.count(F.lit(1)).alias("n_pred"))).join(
        references.agg(F.count(F.lit(1)).alias("n_ref")))
    tp, fp, fn = F.col("tp"), F.col("n_pred") - F.col("tp"), F.col("n_ref") - F.col("tp")
    precision, recall, f1 = scores(tp, fp, fn)
    return counts.select(
        F.bround(precision, 4).alias("precision"), F.bround(recall, 4).alias("recall"),
        F.bround(f1, 4).alias("f1_score"), tp.alias("true_positives"), fp.alias("false_positives"),
        fn.alias("false_negatives"),
        F.when(F.col("n_ref") > 0, F.col("n_ref")).alias("total_ground_truth"),
        F.when(F.col("n_ref") > 0, F.col("n_pred")).alias("total_predictions"),
        F.lit(float(threshold)).alias("iou_threshold"))
