"""Evaluation aggregates. Rank metrics aggregate by score first; running sums over the scores are taken by ranges, so that
no task holds all scores of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.ranking import wide_running_sums


def accuracy(preds: DataFrame, keys: list[str]) -> DataFrame:
    """M01. Share of pred = y in each group."""
    return preds.groupBy(*keys).agg(F.avg((F.col("pred") == F.col("y")).cast("double")).alias("accuracy"))


def f1(preds: DataFrame) -> DataFrame:
    """M02. Macro F1 over the labels seen on either side, and micro F1."""
    cells = preds.groupBy("y", "pred").agg(F.count(F.lit(1)).alias("n"))
    side = lambda c: cells.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias(f"n_{c}"), F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)).alias(f"tp_{c}"))
    per = side("y").join(side("pred"), "label", "full").select(
        "label", (2 * F.coalesce("tp_y", F.lit(0)) / (F.coalesce("n_y", F.lit(0)) + F.coalesce("n_pred", F.lit(0)))).alias("f"), F.coalesce("tp_y", F.lit(0)).alias("tp"), F.coalesce("n_y", F.lit(0)).alias("n")
    )
    return per.agg(F.avg("f").alias("macro_f1"), (F.sum("tp") / F.sum("n")).alias("micro_f1"))


def _by_score(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.where("y is not null and score is not null").groupBy(*keys, "score").agg(
        F.sum("y").cast("double").alias("pos"), F.sum(1 - F.col("y")).cast("double").alias("neg")
    )


def roc_auc(scored: DataFrame, keys: list[str]) -> DataFrame:
    """M03. Tie-averaged AUC of each group; null where a class is missing."""
    counted = wide_running_sums(_by_score(scored, keys), keys, [F.col("score")], {"upto": "neg"})
    p, n = F.sum("pos"), F.sum("neg")
    return counted.groupBy(*keys).agg(
        F.when((p > 0) & (n > 0), F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2)) / (p * n)).alias("auc")
    )


def average_precision(scored: DataFrame, keys: list[str]) -> DataFrame:
    """M04. Sum over falling distinct scores of the gained recall times the precision; null where a class is missing."""
    counted = wide_running_sums(_by_score(scored, keys), keys, [F.desc("score")], {"tp": "pos", "fp": "neg"})
    p = F.sum("pos")
    return counted.groupBy(*keys).agg(
        F.when((p > 0) & (F.sum("neg") > 0), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / p).alias("ap")
    )


def multitask(scored: DataFrame, task: str = "task") -> DataFrame:
    """M05. Mean AUC and AP over the tasks that have both classes among their labelled rows."""
    both = roc_auc(scored, [task]).join(average_precision(scored, [task]), task)
    return both.where("auc is not null").agg(F.avg("auc").alias("auc"), F.avg("ap").alias("ap"), F.count(F.lit(1)).alias("tasks"))


def hits_at_k(scored: DataFrame, ks: list[int], keys: list[str]) -> DataFrame:
    """M06. Share of positives strictly above the k-th best negative; 1 with fewer than k negatives."""
    one = [F.lit(1).alias("_all")] if not keys else []
    counted = _by_score(scored, keys).select("*", *one)
    keys = keys or ["_all"]
    counted = wide_running_sums(counted, keys, [F.desc("score")], {"negs": "neg"})
    hit = [F.sum(F.when(F.col("negs") < k, F.col("pos")).otherwise(0.0)) for k in ks]
    out = counted.groupBy(*keys).agg(*[
        F.when(F.sum("neg") < k, 1.0).otherwise(h / F.sum("pos")).alias(f"hits_{k}") for k, h in zip(ks, hit, strict=True)
    ])
    return out.drop("_all")


def mrr(scored: DataFrame, group: str) -> DataFrame:
    """M07. Mean reciprocal rank of each group's positive among its negatives, ties at the middle rank."""
    own = scored.where("y = 1").select(group, F.col("score").alias("_p"))
    ranks = own.join(scored.where("y = 0").select(group, "score"), group, "left").groupBy(group, "_p").agg(
        F.coalesce(F.sum((F.col("score") > F.col("_p")).cast("double")), F.lit(0.0)).alias("better"),
        F.coalesce(F.sum((F.col("score") >= F.col("_p")).cast("double")), F.lit(0.0)).alias("even"),
    )
    return ranks.agg(F.avg(1 / ((F.col("better") + F.col("even")) / 2 + 1)).alias("mrr"), F.count(F.lit(1)).alias("n"))


def task_ranks(scored: DataFrame, task: str, order: list[Column], ks=(1, 5, 10)) -> DataFrame:
    """M08. Hits and MRR of each task's first positive in the ranking of its candidates."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(task).orderBy(*order)))
    best = ranked.where("y = 1").groupBy(task).agg(F.min("rank").alias("rank"))
    return best.agg(*[F.avg((F.col("rank") <= k).cast("double")).alias(f"hits_{k}") for k in ks], F.avg(1 / F.col("rank")).alias("mrr"))


def match_label(text: Column, labels: list[str]) -> Column:
    """M09. Number of the first label that the text contains, else of the one with the least edit distance."""
    arr = F.array(*[F.lit(x.lower()) for x in labels])
    inside = F.array_position(F.transform(arr, lambda x: F.contains(text, x)), True)
    edits = F.transform(F.array(*[F.lit(x) for x in labels]), lambda x: F.levenshtein(text, x))
    return F.when(inside > 0, inside - 1).otherwise(F.array_position(edits, F.array_min(edits)) - 1).cast("int")


def most_frequent_label(text: Column, labels: list[str]) -> Column:
    """M09. Number of the label that occurs most often (overlaps counted), the first on ties; -1 if none occurs."""
    def times(label: str) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - len(label) + 1, F.lit(1)))
        return F.size(F.filter(starts, lambda i: F.substring(text, i, F.lit(len(label))) == label))

    n = F.array(*[times(x) for x in labels])
    return F.when(F.array_max(n) > 0, F.array_position(n, F.array_max(n)) - 1).otherwise(-1).cast("int")


def answer_accuracy(answers: DataFrame, labels: list[str]) -> DataFrame:
    """M10. Share of answers equal to the truth, and of those whose nearest label is the truth."""
    low = F.array(*[F.lit(x) for x in labels])
    edits = F.transform(low, lambda x: F.levenshtein(F.lower(F.trim("text")), F.lower(x)))
    near = F.element_at(low, F.array_position(edits, F.array_min(edits)).cast("int"))
    return answers.agg(
        F.avg((F.lower(F.trim("text")) == F.lower("gt")).cast("double")).alias("strict"), F.avg((near == F.col("gt")).cast("double")).alias("nearest")
    )


def yes_no_accuracy(answers: DataFrame) -> DataFrame:
    """M10. An answer is yes if it begins so, no if it begins so, else wrong."""
    said = F.when(F.lower("text").startswith("yes"), 1).when(F.lower("text").startswith("no"), 0).otherwise(-1)
    return answers.agg(F.avg((said == F.col("y")).cast("double")).alias("accuracy"))


def agreement(preds: DataFrame) -> DataFrame:
    """M11. Rows where both, one or none of two models are right, with their smallest and largest id."""
    return preds.groupBy((F.col("a") == F.col("y")).alias("a_ok"), (F.col("b") == F.col("y")).alias("b_ok")).agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agree")
    )


def confidence_bins(ranked: DataFrame, total: Column, bins: int, keys: list[str] | None = None) -> DataFrame:
    """M12. Rows ranked by confidence (rn from 1, in each of ``keys``) in chunks of ceil(n / bins); accuracy of two models."""
    width = F.ceil(total / bins)
    return ranked.groupBy(*(keys or []), F.floor((F.col("rn") - 1) / width).alias("bin")).agg(
        F.avg((F.col("a") == F.col("y")).cast("double")).alias("acc_a"), F.avg((F.col("b") == F.col("y")).cast("double")).alias("acc_b")
    )


def choice_stats(preds: DataFrame, valid: list[str]) -> DataFrame:
    """M13. Rate of valid choices, accuracy, accuracy among the valid."""
    ok, hit = F.col("pred").isin(valid), (F.col("pred") == F.col("y")).cast("double")
    rate, acc = F.avg(ok.cast("double")), F.avg(hit)
    return preds.agg(rate.alias("valid_rate"), acc.alias("accuracy"), F.when(rate > 0, acc / rate).otherwise(0.0).alias("accuracy_in_valid"))


def choice_distribution(preds: DataFrame, valid: list[str]) -> DataFrame:
    """M13. Share of each choice among the valid ones."""
    n = preds.where(F.col("pred").isin(valid)).groupBy("pred").agg(F.count(F.lit(1)).alias("n"))
    return n.select("pred", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def run_summary(runs: DataFrame) -> DataFrame:
    """M14. Mean and deviation of valid and test for each configuration; ``best`` marks the best mean of valid."""
    per = runs.groupBy("config").agg(*[f(c).alias(f"{c}_{n}") for c in ("val", "test") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    return per.withColumn("best", F.row_number().over(Window.orderBy(F.desc("val_mean"), "config")) == 1)


def best_epoch(runs: DataFrame) -> DataFrame:
    """M14. Test value at each run's best epoch by valid, the earliest on ties."""
    return runs.groupBy("run").agg(F.max_by("test", F.struct("val", -F.col("epoch"))).alias("test"), F.max("val").alias("val"))


def anova(groups: DataFrame) -> DataFrame:
    """M15. One-way F and its degrees of freedom from (g, v)."""
    per = groups.groupBy("g").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    grand = F.sum(F.col("n") * F.col("m")).over(Window.partitionBy()) / F.sum("n").over(Window.partitionBy())
    parts = per.withColumn("grand", grand).agg(
        F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2).alias("between"), F.sum(F.col("n") * F.col("s")).alias("within"),
        (F.count(F.lit(1)) - 1).alias("df_between"), (F.sum("n") - F.count(F.lit(1))).alias("df_within"),
    )
    return parts.select((F.col("between") / F.col("df_between") / (F.col("within") / F.col("df_within"))).alias("f"), "df_between", "df_within")


def _contingency(labels: DataFrame) -> DataFrame:
    n = labels.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return n.withColumns({"na": F.sum("n").over(Window.partitionBy("a")), "nb": F.sum("n").over(Window.partitionBy("b")), "all": F.sum("n").over(Window.partitionBy())})


def nmi(labels: DataFrame) -> DataFrame:
    """M16. Mutual information over the mean of the entropies; 1 if both labelings are constant."""
    c = _contingency(labels)
    share = lambda x: F.col(x) / F.col("all")
    mutual = F.sum(share("n") * F.log(F.col("n") * F.col("all") / (F.col("na") * F.col("nb"))))
    ha, hb = -F.sum(share("n") * F.log(share("na"))), -F.sum(share("n") * F.log(share("nb")))
    return c.agg(mutual.alias("m"), ha.alias("ha"), hb.alias("hb")).select(
        F.when((F.col("ha") + F.col("hb")) > 0, 2 * F.col("m") / (F.col("ha") + F.col("hb"))).otherwise(1.0).alias("nmi")
    )


def community_f1(labels: DataFrame) -> DataFrame:
    """M17. Best F of each found (a) and each true (b) set, averaged on both sides."""
    c = _contingency(labels).withColumn("f", 2 * F.col("n") / (F.col("na") + F.col("nb")))
    side = lambda k: c.groupBy(k).agg(F.max("f").alias("f")).agg(F.avg("f").alias(f"f_{k}"))
    return side("a").crossJoin(side("b")).select(((F.col("f_a") + F.col("f_b")) / 2).alias("f"), "f_a", "f_b")


def minmax_scale(values: DataFrame, group: str, value: str) -> DataFrame:
    """M18. Values scaled to 0..1 inside each group; 0 where all are equal."""
    w = Window.partitionBy(group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return values.withColumn("scaled", F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.0))


def mae(preds: DataFrame) -> DataFrame:
    """M19."""
    return preds.agg(F.avg(F.abs(F.col("pred") - F.col("y"))).alias("mae"))


def ranked_answer(answers: DataFrame, labels: list[str]) -> DataFrame:
    """M20. (id, label, miss): the first item of a bracketed list in the answer as an exact or the nearest label; without
    a list the first label that the answer contains. ``miss`` marks all but exact ones."""
    clean = F.regexp_replace(F.regexp_replace(F.lower("text"), r"[._]", " "), r"\\", "")
    item = F.regexp_extract("_c", r"\[\s*['\"]([^'\"]*)['\"]", 1)
    arr = F.array(*[F.lit(x.lower()) for x in labels])
    edits = F.transform(arr, lambda x: F.levenshtein(F.col("_i"), x))
    inside = F.array_position(F.transform(arr, lambda x: F.contains(F.col("_c"), x)), True)
    exact = F.array_position(arr, F.col("_i"))
    listed = F.col("_c").rlike(r"\[\s*['\"][^'\"]*['\"]")
    return answers.withColumn("_c", clean).withColumn("_i", item).select(
        "id",
        F.when(listed & (exact > 0), exact - 1).when(listed, F.array_position(edits, F.array_min(edits)) - 1).when(inside > 0, inside - 1).cast("int").alias("label"),
        (~(listed & (exact > 0))).alias("miss"),
    )
