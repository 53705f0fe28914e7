"""Splits and label preparation. Random choices are md5 orders of (seed, key), so splits can be repeated anywhere."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.columns import unused
from loomgraph.functions.ranking import first_rows, global_rank, group_rank, md5_bucket, md5_key, md5_rank, seeded_rank, wide_group_rank, wide_md5_rank, wide_running_sums
from loomgraph.functions.storage import discard, stash


def _cut(ranked: DataFrame, n: int, ratios: tuple[float, float], names=("train", "valid", "test")) -> DataFrame:
    """``split`` by rank: the first int(n * r) rows, the next, the rest."""
    a, b = int(n * ratios[0]), int(n * ratios[0]) + int(n * ratios[1])
    return ranked.withColumn("split", F.when(F.col("rn") <= a, names[0]).when(F.col("rn") <= b, names[1]).otherwise(names[2])).drop("rn")


def ratio_split(rows: DataFrame, ratios: tuple[float, float, float], seed=0, key: str = "id") -> DataFrame:
    """P01, P06, P21. Random split by ratios that sum to 1; the remainder is test."""
    if abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("ratios must sum to 1")
    return _cut(seeded_rank(rows, seed, key), rows.count(), ratios[:2])


def all_train(rows: DataFrame) -> DataFrame:
    """P01. Every row is train."""
    return rows.withColumn("split", F.lit("train"))


def per_class_split(rows: DataFrame, per_class: int, n_valid: int, n_test: int, seed=0, key: str = "id") -> DataFrame:
    """P02. In random order the first ``per_class`` rows of each class are train, then valid until full, then test
    (-1: all the rest); rows beyond are dropped."""
    ranked = wide_md5_rank(rows, seed, key, ["label"], "own")
    rest = seeded_rank(ranked.where(F.col("own") > per_class), seed, key)
    tagged = rest.withColumn("split", F.when(F.col("rn") <= n_valid, "valid").when((F.lit(n_test) < 0) | (F.col("rn") <= n_valid + n_test), "test"))
    train = ranked.where(F.col("own") <= per_class).withColumn("split", F.lit("train"))
    return train.unionByName(tagged.drop("rn").where("split is not null")).drop("own")


def kfold(rows: DataFrame, k: int, seed=0, key: str = "id") -> DataFrame:
    """P03. ``fold`` 0..k-1, stratified by label."""
    return wide_md5_rank(rows, seed, key, ["label"]).withColumn("fold", (F.col("rn") - 1) % k).drop("rn")


def fold_splits(folded: DataFrame, k: int) -> DataFrame:
    """P03. Per round i: fold i test, the next valid, the others train."""
    rounds = folded.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("round"))
    return rounds.withColumn("split", F.when(F.col("fold") == F.col("round"), "test").when(F.col("fold") == (F.col("round") + 1) % k, "valid").otherwise("train"))


def class_holdout(rows: DataFrame, class_splits: DataFrame) -> DataFrame:
    """P04. Each row takes the split of its class."""
    return rows.join(class_splits, "label")


def class_index(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """P05. (keys, label, ids sorted)."""
    return rows.groupBy(*(keys or []), "label").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def link_split(pairs: DataFrame, ratios: tuple[float, float, float], seed=0) -> DataFrame:
    """P07. (stage, role, src, dst): supervision edges of each stage; message edges are the train pairs, for test the
    valid ones too. Pairs are undirected, once each."""
    tagged = ratio_split(pairs.withColumn("_k", F.concat_ws("-", "src", "dst")), ratios, seed, "_k").drop("_k")
    messages = tagged.where("split = 'train'").select(F.explode(F.array(F.lit("train"), F.lit("valid"), F.lit("test"))).alias("stage"), "src", "dst").unionByName(
        tagged.where("split = 'valid'").select(F.lit("test").alias("stage"), "src", "dst")
    )
    return tagged.select(F.col("split").alias("stage"), F.lit("supervision").alias("role"), "src", "dst").unionByName(messages.select("stage", F.lit("message").alias("role"), "src", "dst"))


def time_split(rows: DataFrame, ratios: tuple[float, float], time: str = "year", key: str = "id") -> DataFrame:
    """P08. By time, then key: the leading share is train, the next valid, the rest test."""
    return _cut(global_rank(rows, [F.col(time), F.col(key)]), rows.count(), ratios)


def nested_subsample(rows: DataFrame, ratios: tuple[float, float, float], keep: dict[str, float], seed=0, key: str = "id") -> DataFrame:
    """P09. A ratio split of which each part keeps a random share (rounded down)."""
    tagged = ratio_split(rows, ratios, seed, key)
    tagged = stash(tagged, "tagged")
    sizes = {r["split"]: r["n"] for r in tagged.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}  # three at most
    most = F.element_at(F.create_map(*[F.lit(x) for part, share in keep.items() for x in (part, int(sizes.get(part, 0) * share))]), F.col("split"))
    return wide_md5_rank(tagged, f"{seed}-keep", key, ["split"]).where(F.col("rn") <= most).drop("rn")


def mask_to_split(rows: DataFrame, masks: dict[str, str], key: str = "id") -> DataFrame:
    """P10. (seed, id, split) from boolean arrays, one entry for each seed, by split name."""
    parts = [rows.select(F.posexplode(c).alias("seed", "on"), F.col(key), F.lit(name).alias("split")).where("on").drop("on") for name, c in masks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def split_to_mask(splits: DataFrame, rows: DataFrame, name: str, key: str = "id") -> DataFrame:
    """P10. (id, mask): whether the row is in the split."""
    hit = splits.where(F.col("split") == name).select(key, F.lit(True).alias("_on"))
    return rows.select(key).join(hit, key, "left").select(key, F.coalesce("_on", F.lit(False)).alias("mask"))


def ordered_split_ids(parts: dict[str, DataFrame], order: list) -> DataFrame:
    """P11. Rows of all parts with a running id, part after part."""
    out, base = None, 0
    for name, df in parts.items():
        one = global_rank(df, order).withColumn("row_id", F.col("rn") - 1 + base).withColumn("split", F.lit(name)).drop("rn")
        base += df.count()
        out = one if out is None else out.unionByName(one)
    return out


def low_rate_split(rows: DataFrame, per_class: int, limits: dict[str, int], seed=0, key: str = "id") -> DataFrame:
    """P12. ``per_class`` train rows of each class; valid and test cut to their limits."""
    train = wide_md5_rank(rows.where("split = 'train'"), seed, key, ["label"]).where(F.col("rn") <= per_class)
    rest = wide_md5_rank(rows.where("split <> 'train'"), seed, key, ["split"])
    cap = F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("split"))
    return train.unionByName(rest.where(F.col("rn") <= cap)).drop("rn")


def polarity_classes(rows: DataFrame) -> DataFrame:
    """P13. (class, id): class = task + tasks * (y = 1) for each labelled task."""
    return rows.select("id", F.size("y").alias("_t"), F.posexplode("y").alias("task", "v")).where("v is not null").select(
        (F.col("task") + F.col("_t") * (F.col("v") == 1).cast("int")).alias("class"), "id"
    )


def stratified_subset(rows: DataFrame, sizes: dict[str, int], seed=0, key: str = "id") -> DataFrame:
    """P14. For each split in turn the next rows of each label from those that are left."""
    ranked, low, parts = wide_md5_rank(rows, seed, key, ["label"]), 0, None
    for name, n in sizes.items():
        one = ranked.where((F.col("rn") > low) & (F.col("rn") <= low + n)).withColumn("split", F.lit(name))
        parts, low = one if parts is None else parts.unionByName(one), low + n
    return parts.drop("rn")


def hub_few_shot(rows: DataFrame, shots: int, seed=0, key: str = "id") -> DataFrame:
    """P15. Of the train rows the ``shots`` of highest degree in each class are train; the others are halved by class
    into valid and test."""
    ranked = wide_group_rank(rows, ["label"], [F.desc("degree"), F.col(key)], "_hub")
    rest = wide_md5_rank(ranked.where(F.col("_hub") > shots), seed, key, ["label"])
    halves = rest.withColumn("split", F.when(F.col("rn") % 2 == 1, "valid").otherwise("test")).drop("rn")
    return ranked.where(F.col("_hub") <= shots).withColumn("split", F.lit("train")).unionByName(halves).drop("_hub")


def _sizes(rows: DataFrame, group: str) -> DataFrame:
    return rows.groupBy(F.col(group).cast("string").alias("g")).agg(F.count(F.lit(1)).alias("n"))


def _by_group(rows: DataFrame, group: str, packed: DataFrame) -> DataFrame:
    g, = unused(rows.columns, "g")
    return rows.join(packed.withColumnRenamed("g", g), F.col(group).cast("string") == F.col(g)).drop(g)


def group_greedy_split(rows: DataFrame, group: str, ratios: tuple[float, float]) -> DataFrame:
    """P16. Whole groups, largest first: train while they fit, else valid, else test.

    Groups of one size come together, and once one does not fit, none of its size does; so what is folded is one row for
    each distinct size, with the number of groups of that size that each part takes. N rows have fewer than sqrt(2 N) sizes."""
    sizes = stash(_sizes(rows, group), "groups")
    total = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    most, both = math.floor(total * ratios[0]), math.floor(total * (ratios[0] + ratios[1]))
    train = valid = 0
    cut = []
    for n, count in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("n")).toLocalIterator():
        a = max(0, min(count, (most - train) // n))
        train += a * n
        b = max(0, min(count - a, (both - train - valid) // n))
        valid += b * n
        cut.append((n, a, a + b))
    told = sizes.sparkSession.createDataFrame(cut, "n long, _a long, _b long")
    ranked = wide_group_rank(sizes, ["n"], [F.col("g")]).join(told, "n")
    split = F.when(F.col("rn") <= F.col("_a"), "train").when(F.col("rn") <= F.col("_b"), "valid").otherwise("test")
    return _by_group(rows, group, ranked.select("g", split.alias("split")))


def _fill(ranked: DataFrame, room: int) -> Column:
    """Whether the fold over (rn, n) takes a row: it does when the row fits what is left of ``room``.

    Each round sums what may still fit from its place on, finds the first row that does not fit, takes all before it and goes on
    behind it with what is small enough for the rest. A row that does not fit is larger than the rest, so rounds are few: as many as
    distinct sizes at most, and about a logarithm in a random order."""
    taken, at = F.lit(False), 0
    while True:
        here = stash(ranked.where((F.col("rn") > at) & (F.col("n") <= room)).select("rn", "n"), "fitting")
        sums = wide_running_sums(here, [], [F.col("rn")], {"upto": "n"})
        miss = sums.where(F.col("upto") > room).agg(F.min(F.struct("rn", (F.col("upto") - F.col("n")).alias("before"))).alias("m")).first()["m"]
        mine = (F.col("rn") > at) & (F.col("n") <= room)
        discard(here)
        if miss is None:
            return taken | mine
        taken = taken | (mine & (F.col("rn") < miss["rn"]))
        at, room = miss["rn"], room - miss["before"]


def group_random_split(rows: DataFrame, group: str, ratios: tuple[float, float, float], seed=0) -> DataFrame:
    """P17. Groups in random order: valid while they fit, else test, else train. What valid takes does not depend on test,
    so the two are filled one after the other, each in few rounds over the groups."""
    sizes = stash(_sizes(rows, group), "groups")
    total = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    ranked = stash(seeded_rank(sizes, seed, "g").select("g", "n", "rn"), "ordered")
    first = stash(ranked.withColumn("valid", _fill(ranked, int(total * ratios[1]))), "ordered")
    test = _fill(first.where(~F.col("valid")), int(total * ratios[2]))
    split = F.when(F.col("valid"), "valid").when(test, "test").otherwise("train")
    return _by_group(rows, group, first.select("g", split.alias("split")))


def nonnull_random_split(rows: DataFrame, task: int, ratios: tuple[float, float, float], null_value=None, seed=0) -> DataFrame:
    """P18. Rows whose task label is known, split by ratios."""
    y = F.col("y")[task]
    return ratio_split(rows.where(y.isNotNull() if null_value is None else y != null_value), ratios, seed)


def hash_percent_split(rows: DataFrame, train: int, valid: int, seed=0, key: str = "id") -> DataFrame:
    """P19. A number 0..99 for each row: below ``train`` train, below ``valid`` valid, else test."""
    b = md5_bucket(seed, key, buckets=100)
    return rows.withColumn("split", F.when(b < train, "train").when(b < valid, "valid").otherwise("test"))


def class_shuffle_split(rows: DataFrame, seed=0, small: int = 20) -> DataFrame:
    """P20. (label, split): shuffled classes in thirds if there are at most ``small``, else 60, 20 and 20 %."""
    c = rows.select("label").distinct().withColumn("_all", F.lit(1))
    ranked = md5_rank(c, seed, "label", ["_all"]).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("_all")))
    a = F.when(F.col("n") <= small, F.floor(F.col("n") / 3)).otherwise(F.floor(F.col("n") * 0.6))
    b = F.when(F.col("n") <= small, F.floor(F.col("n") * 2 / 3)).otherwise(F.floor(F.col("n") * 0.8))
    return ranked.select("label", F.when(F.col("rn") <= a, "train").when(F.col("rn") <= b, "valid").otherwise("test").alias("split"))


def negated_labels(rows: DataFrame, split: str, per_class: int | None = None, key: str = "id") -> DataFrame:
    """P22. ``code`` = label inside the split (and its first ``per_class`` rows of each class), else -1 - label."""
    inside, ranked = F.col("split") == split, rows
    if per_class is not None:
        ranked = wide_group_rank(rows, ["label", "split"], [F.col(key)])
        inside = inside & (F.col("rn") <= per_class)
    return ranked.withColumn("code", F.when(inside, F.col("label")).otherwise(-1 - F.col("label"))).drop("rn")


def quantile_labels(rows: DataFrame, value: str, classes: int) -> DataFrame:
    """P23. ``label``: how many inner quantile edges are not above the value; null values have none."""
    at = ", ".join(str(i / classes) for i in range(1, classes))
    edges = rows.agg(F.expr(f"percentile({value}, array({at}))").alias("_e"))
    return rows.crossJoin(F.broadcast(edges)).withColumn(
        "label", F.when(F.col(value).isNotNull(), F.size(F.filter("_e", lambda e: e <= F.col(value))))
    ).drop("_e")


def within_node_tail(tokens: DataFrame, node: str, order: list, share: float = 0.9) -> DataFrame:
    """P24. Of each node's tokens the leading share is train, the rest test; nodes of one token are dropped."""
    n = F.count(F.lit(1)).over(Window.partitionBy(node))
    ranked = group_rank(tokens, [node], order).withColumn("_n", n).where("_n >= 2")
    return ranked.withColumn("split", F.when(F.col("rn") <= F.floor(F.col("_n") * share), "train").otherwise("test")).drop("rn", "_n")


def sample_rows(rows: DataFrame, amount: float, seed=0, key: str = "id") -> DataFrame:
    """P25. A fraction below 1 or a number of rows, in seeded order."""
    n = int(rows.count() * amount) if amount < 1 else int(amount)
    return first_rows(rows, [md5_key(seed, key), F.col(key)], n)


def drop_rare_classes(rows: DataFrame, batch: int) -> DataFrame:
    """P26. Rows of classes with at least 2 * batch rows."""
    ok = rows.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 2 * batch).select("label")
    return rows.join(ok, "label", "left_semi")


def label_matrix(rows: DataFrame, tasks: list, item: str = "item", task: str = "task", value: str = "value") -> DataFrame:
    """P27. One row for each item with a column for each task: 1 for Yes, 0 for No, null without a row."""
    return rows.groupBy(item).pivot(task, tasks).agg(F.max(F.when(F.col(value) == "Yes", 1).when(F.col(value) == "No", 0)))


def recode(rows: DataFrame) -> DataFrame:
    """P28. 0 becomes -1 and null 0 in the label array."""
    return rows.withColumn("y", F.transform("y", lambda v: F.when(v.isNull(), 0).when(v == 0, -1).otherwise(v)))


def pad_union(a: DataFrame, n_a: int, b: DataFrame, n_b: int) -> DataFrame:
    """P29. Both tables with labels over all tasks: zeros on the right of the first, on the left of the second."""
    zeros = lambda k: F.array_repeat(F.lit(0), k)
    return a.select("id", F.concat("y", zeros(n_b)).alias("y")).unionByName(b.select("id", F.concat(zeros(n_a), "y").alias("y")))


def polarity_counts(rows: DataFrame) -> DataFrame:
    """P30. Positives and negatives of each task."""
    return rows.select(F.posexplode("y").alias("task", "v")).groupBy("task").agg(F.count_if(F.col("v") == 1).alias("positive"), F.count_if(F.col("v") == 0).alias("negative"))


def one_hot(label: str, n: int) -> Column:
    """P31."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == F.col(label)).cast("int"))


def reversed_binary(label: str) -> Column:
    """P31. The two-class one-hot label with its classes exchanged."""
    return F.reverse(one_hot(label, 2))


def known_labels(y: str) -> Column:
    """P31. Labels that are not null."""
    return F.filter(y, lambda v: v.isNotNull())


def label_and_complement(y: str) -> Column:
    """P31. Known labels followed by their complements."""
    return F.concat(known_labels(y), F.transform(known_labels(y), lambda v: 1 - v))


def logic_labels(rows: DataFrame, classes: int, draws: int, seed=0) -> DataFrame:
    """P32. (id, draw, a, b, either, neither): random class pairs; whether one holds the label, and whether none does."""
    d = rows.select("id", "label", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    a = md5_bucket(f"{seed}-a", "id", "draw", buckets=classes)
    b = md5_bucket(f"{seed}-b", "id", "draw", buckets=classes)
    hit = (F.col("a") == F.col("label")) | (F.col("b") == F.col("label"))
    return d.withColumns({"a": a, "b": b}).select("id", "draw", "a", "b", hit.cast("int").alias("either"), (~hit).cast("int").alias("neither"))


def length_batches(rows: DataFrame, mega: int, shards: int, seed=0, key: str = "id") -> DataFrame:
    """P33. Shuffled rows in megabatches, sorted by length in each and dealt to shards in turn, back and forth, so
    that total lengths are near."""
    m = seeded_rank(rows, seed, key).withColumn("batch", F.floor((F.col("rn") - 1) / mega)).drop("rn")
    r = group_rank(m, ["batch"], [F.desc("length"), F.col(key)], "_r").withColumn("_p", (F.col("_r") - 1) % (2 * shards))
    return r.withColumn("shard", F.when(F.col("_p") < shards, F.col("_p")).otherwise(2 * shards - 1 - F.col("_p"))).drop("_r", "_p")
