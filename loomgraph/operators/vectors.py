"""Feature propagation and vector analytics. Vectors are array<double>; sums run in the long form (id, dim, val)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.skew import join_by_count
from loomgraph.functions.storage import stash
from loomgraph.operators import reduction


def long_form(x: DataFrame, key: str = "id", vector: str = "x") -> DataFrame:
    return x.select(F.col(key).alias("id"), F.posexplode(vector).alias("dim", "val"))


def wide_form(x: DataFrame) -> DataFrame:
    return x.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "val"))), lambda d: d["val"]).alias("x"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def sym_weights(edges: DataFrame) -> DataFrame:
    """V02. (src, dst, w): 1 / sqrt of both degrees; loops are left out."""
    e = edges.where("src <> dst").select("src", "dst")
    d = e.groupBy("src").agg(F.count(F.lit(1)).cast("double").alias("d"))
    return e.join(d, "src").join(d.toDF("dst", "d2"), "dst").select("src", "dst", (1 / F.sqrt(F.col("d") * F.col("d2"))).alias("w"))


def row_weights(edges: DataFrame) -> DataFrame:
    """V02. (src, dst, w): weight over the row's sum, loops left out."""
    e = edges.where("src <> dst").select("src", "dst", F.col("weight").cast("double").alias("w"))
    sums = stash(e.groupBy("src").agg(F.sum("w").alias("t"), F.count(F.lit(1)).alias("n")), "strength")
    size = sums.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    return join_by_count(e, sums, ["src"], size["n"] or 0, largest=size["most"] or 0).select("src", "dst", (F.col("w") / F.col("t")).alias("w"))


def propagate(x: DataFrame, weights: DataFrame, rounds: int) -> DataFrame:
    """V01, V04. Long-form vectors after ``rounds`` multiplications by the weights; nodes without edges drop out."""
    for _ in range(rounds):
        x = weights.join(x.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "dim").agg(F.sum(F.col("w") * F.col("val")).alias("val"))
    return x


def hops(x: DataFrame, weights: DataFrame, rounds: int) -> DataFrame:
    """V01. (hop, id, dim, val) of every hop from 0."""
    out = x.select(F.lit(0).alias("hop"), "id", "dim", "val")
    for h in range(1, rounds + 1):
        x = propagate(x, weights, 1)
        out = out.unionByName(x.select(F.lit(h).alias("hop"), "id", "dim", "val"))
    return out


def label_choice(train: DataFrame, edges: DataFrame, rounds: int, nodes: DataFrame) -> DataFrame:
    """V05. (id, choice): the label with most train paths of ``rounds`` steps, the smallest on ties; NA without any."""
    cur = train.select("id", "label", F.lit(1).cast("long").alias("n"))
    for _ in range(rounds):
        cur = edges.select("src", "dst").join(cur.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("n").alias("n"))
    best = cur.groupBy("id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
    return nodes.select("id").join(best, "id", "left").select("id", F.coalesce(F.col("label").cast("string"), F.lit("NA")).alias("choice"))


def return_probability(edges: DataFrame, steps: int) -> DataFrame:
    """V06. (id, step, p): chance that a walk is back after each step; nodes that cannot be back have no row."""
    d = edges.groupBy("src").agg(F.count(F.lit(1)).cast("double").alias("d"))
    step = edges.select("src", "dst").join(d, "src").select(F.col("src").alias("node"), F.col("dst").alias("to"), (1 / F.col("d")).alias("w"))
    cur = step.select(F.col("node").alias("id"), F.col("to").alias("node"), F.col("w").alias("p"))
    out = None
    for s in range(1, steps + 1):
        back = cur.where("id = node").select("id", F.lit(s).alias("step"), "p")
        out = back if out is None else out.unionByName(back)
        if s < steps:
            cur = cur.join(step, "node").groupBy("id", F.col("to").alias("node")).agg(F.sum(F.col("p") * F.col("w")).alias("p"))
    return out


def segment_pool(x: DataFrame, groups: DataFrame, how: str) -> DataFrame:
    """V07. (g, dim, val): sum, avg or max of the vectors in each group."""
    return x.join(groups, "id").groupBy("g", "dim").agg(F.expr(f"{how}(val)").alias("val"))


def tfidf(docs: DataFrame, text: str = "text") -> DataFrame:
    """V08. (id, term, weight): tf * (ln((1 + n) / (1 + df)) + 1), L2-normalised in each document."""
    words = docs.select("id", F.explode(F.split(F.lower(F.trim(text)), r"\s+")).alias("term")).where("term <> ''")
    tf = words.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    w = tf.join(df, "term").crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    return w.select("id", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))).alias("weight"))


def cosine_top_k(x: DataFrame, k: int, block_rows: int = 32_768) -> DataFrame:
    """V09. (id, other, sim, rank): the k most similar others with positive cosine. All pairs are compared, dealt as
    block pairs of about ``block_rows`` rows each: each row goes to one block on the left and to all on the right. The
    best of each block pair are taken before the others are met."""
    sims = reduction.block_top_k(x, k, block_rows).withColumn("sim", F.round("sim", 9))
    w = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    return sims.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pair_cosine(links: DataFrame, x: DataFrame) -> DataFrame:
    """V11. (src, dst, cosine) of each link."""
    a, b = x.select(F.col("id").alias("src"), F.col("x").alias("_a")), x.select(F.col("id").alias("dst"), F.col("x").alias("_b"))
    return links.join(a, "src").join(b, "dst").select("src", "dst", (dot("_a", "_b") / (norm("_a") * norm("_b"))).alias("cosine"))


def centroids(x: DataFrame) -> DataFrame:
    """V13. (label, dim, val, n): mean vector and size of each class, from long-form vectors with a label."""
    return x.groupBy("label", "dim").agg(F.avg("val").alias("val"), F.count(F.lit(1)).alias("n"))


def distance_to_centre(x: DataFrame) -> DataFrame:
    """V13. (id, label, d2): squared distance of each row to its class's mean."""
    c = centroids(x).select("label", "dim", F.col("val").alias("c"))
    return x.join(c, ["label", "dim"]).groupBy("id", "label").agg(F.sum((F.col("val") - F.col("c")) ** 2).alias("d2"))


def nearest_class(x: DataFrame, classes: DataFrame) -> DataFrame:
    """V12. (id, pred): the class vector with the largest dot product, the smallest label on ties; classes are few."""
    scored = x.crossJoin(F.broadcast(classes.select("label", F.col("x").alias("c")))).withColumn("s", F.round(dot("x", "c"), 9))
    return scored.groupBy("id").agg(F.max_by("label", F.struct("s", -F.col("label"))).alias("pred"))


def standardise(x: DataFrame, train: Column) -> DataFrame:
    """V16. Long-form z-scores by the mean and deviation of the train rows; constant dimensions are dropped."""
    fit = x.where(train).groupBy("dim").agg(F.avg("val").alias("m"), F.stddev_pop("val").alias("s")).where("s > 0")
    return x.join(fit, "dim").select("id", "dim", ((F.col("val") - F.col("m")) / F.col("s")).alias("val"))


def row_normalise(x: DataFrame) -> DataFrame:
    """V16. Values over their row's sum; 0 for a sum of 0."""
    total = F.sum("val").over(Window.partitionBy("id"))
    return x.withColumn("val", F.when(total != 0, F.col("val") / total).otherwise(0.0))


def softmax(x) -> Column:
    """V17."""
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    total = F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    return F.transform(e, lambda v: v / total)


def entropy_confidence(rows: DataFrame, logits: str = "x") -> DataFrame:
    """V17. (id, entropy, spread): entropy of the softmax and (n * e^H - 1) / (n - 1)."""
    p = rows.withColumn("_p", softmax(F.col(logits)))
    h = -F.aggregate("_p", F.lit(0.0), lambda s, v: s + F.when(v > 0, v * F.log(v)).otherwise(0.0))
    n = F.size(logits)
    return p.withColumn("entropy", h).select("id", "entropy", ((n * F.exp("entropy") - 1) / (n - 1)).alias("spread"))


def balance_weights(tokens: DataFrame) -> DataFrame:
    """V18. (node, token, pos, weight): 1 over the token's count in the node, over the node's sum."""
    inv = 1 / F.count(F.lit(1)).over(Window.partitionBy("node", "token"))
    w = tokens.withColumn("_w", inv)
    return w.withColumn("weight", F.col("_w") / F.sum("_w").over(Window.partitionBy("node"))).drop("_w")


def sign_features(x: DataFrame, edges: DataFrame, nodes: DataFrame, copies: int, legacy: bool = False) -> DataFrame:
    """V03. (copy, id, dim, val): x and its products with the normalised adjacency with self loops, powers 1 to
    ``copies``; no copies give the first product only. ``legacy`` repeats the first product instead of the powers."""
    loops = edges.where("src <> dst").select("src", "dst").unionByName(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    d = loops.groupBy("src").agg(F.count(F.lit(1)).cast("double").alias("d"))
    w = loops.join(d, "src").join(d.toDF("dst", "d2"), "dst").select("src", "dst", (1 / F.sqrt(F.col("d") * F.col("d2"))).alias("w"))
    if not copies:
        return propagate(x, w, 1).withColumn("copy", F.lit(1))
    out = x.withColumn("copy", F.lit(0))
    cur = x
    for c in range(1, copies + 1):
        cur = propagate(x if legacy else cur, w, 1)
        out = out.unionByName(cur.withColumn("copy", F.lit(c)))
    return out


def smoothed_similarity(x: DataFrame, weights: DataFrame, rounds: int, pairs: DataFrame) -> DataFrame:
    """V10. (src, dst, cosine) of the pairs after smoothing."""
    return pair_cosine(pairs, wide_form(propagate(x, weights, rounds)))


def kmeans_clusters(x: DataFrame, k: int, seed: int = 0, rounds: int = 20) -> DataFrame:
    """V14. (id, cluster) by Lloyd iterations of Spark ML."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = x.select("id", array_to_vector("x").alias("features"))
    return KMeans(k=k, seed=seed, maxIter=rounds).fit(v).transform(v).select("id", F.col("prediction").alias("cluster"))


def set_similarity(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """V15. Average over all pairs of two vector sets: cosine, dot, negative euclidean distance or mmd. Cosine and dot
    averages are dot products of mean vectors; the others meet the pairs in blocks."""
    if how in ("euclidean", "mmd"):
        return (reduction.mmd if how == "mmd" else reduction.mean_distance)(a, b)
    scale = lambda t: t.select("id", F.transform("x", lambda v: v / norm("x")).alias("x")) if how == "cosine" else t.select("id", "x")
    mean = lambda t, n: long_form(scale(t)).groupBy("dim").agg(F.avg("val").alias(n))
    return mean(a, "m").join(mean(b, "n"), "dim").agg(F.sum(F.col("m") * F.col("n")).alias("similarity"))


def linear_probe(train: DataFrame, rows: DataFrame, rounds: int = 50) -> DataFrame:
    """V19. (id, label, pred): multinomial logistic regression on frozen vectors."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    prep = lambda t: t.select("id", F.col("label").cast("double").alias("label"), array_to_vector("x").alias("features"))
    model = LogisticRegression(maxIter=rounds, regParam=1e-3).fit(prep(train))
    return model.transform(prep(rows)).select("id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("pred"))


def random_vectors(rows: DataFrame, width: int, seed=0, key: str = "id") -> DataFrame:
    """V20. (id, dim, val): standard normal values by Box and Muller from the md5 of (seed, id, dim)."""
    from loomgraph.functions.ranking import md5_key

    d = rows.select(F.col(key).alias("id"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("dim"))
    h = md5_key(seed, "id", "dim")
    u = lambda at: (F.conv(F.substring(h, at, 8), 16, 10).cast("double") + 1) / float((1 << 32) + 1)
    return d.withColumn("val", F.sqrt(-2 * F.log(u(1))) * F.cos(u(9) * 6.283185307179586))
