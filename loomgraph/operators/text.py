"""Text assembly, enrichment joins and string functions. Nulls propagate through concatenation unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.ranking import group_rank, md5_key


def template(pattern: str, **cols: Column) -> Column:
    """T01. ``pattern`` with {names} replaced by columns; null if any of them is."""
    parts, rest = [], pattern
    while rest:
        before, _, rest = rest.partition("{")
        parts.append(F.lit(before))
        if rest:
            name, _, rest = rest.partition("}")
            parts.append(cols[name].cast("string"))
    return F.concat(*parts)


def id_text_join(ids: DataFrame, texts: DataFrame, key: str, required: str) -> DataFrame:
    """T02. Left join of texts by id; rows without the required column go."""
    return ids.join(texts, key, "left").where(F.col(required).isNotNull())


def block_records(lines: DataFrame, names: list[str], line: str = "line_no", value: str = "value") -> DataFrame:
    """T03. Blocks of as many lines as there are names become one row each."""
    n = len(names)
    picked = [F.max(F.when(F.col(line) % n == i, F.col(value))).alias(name) for i, name in enumerate(names)]
    return lines.groupBy(F.floor(F.col(line) / n).alias("record")).agg(*picked)


def label_texts(labels: DataFrame, descriptions: DataFrame, key: str) -> DataFrame:
    """T04. Labels with the description of their key; labels without one go."""
    return labels.join(descriptions, key)


def logic_labels(classes: DataFrame) -> DataFrame:
    """T05. (position, text): all ordered pairs as "either a or b", then as "not a and not b". Classes are few."""
    n = classes.count()
    a, b = classes.select(F.col("idx").alias("i"), F.col("text").alias("x")), classes.select(F.col("idx").alias("j"), F.col("text").alias("y"))
    pairs = a.crossJoin(b).withColumn("p", F.col("i") * n + F.col("j"))
    return pairs.select("p", F.concat(F.lit("either "), "x", F.lit(" or "), "y").alias("text")).unionByName(
        pairs.select((F.col("p") + n * n).alias("p"), F.concat(F.lit("not "), "x", F.lit(" and not "), "y").alias("text"))
    ).withColumnRenamed("p", "position")


def entity_text(name: Column, alternatives: Column, description: Column) -> Column:
    """T06. Names, alternatives and description in one text; None without a description."""
    full = F.concat(F.lit("entity names: "), name, F.lit(", entity alternatives: "), F.array_join(alternatives, ", "), F.lit(". entity descriptions:"), description)
    return F.when(description.isNotNull(), full).otherwise("None")


def join_tokens(tokens: Column) -> Column:
    """T07. Tokens in lower case with single spaces, trimmed."""
    return F.lower(F.trim(F.array_join(tokens, " ")))


def truncate_words(text: Column, n: int) -> Column:
    """T08. The first ``n`` words between white space."""
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, n), " ")


def text_dictionary(rows: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """T09. ((text_id, text), rows with text_id instead of the text); ids follow the order of texts."""
    from loomgraph.operators.edges import dense_ids

    d = dense_ids(rows.where(F.col(text).isNotNull()), text).withColumnRenamed("id", "text_id")
    return d, rows.join(d, text, "left").drop(text)


def fill_text(text: Column) -> Column:
    """T10."""
    return F.coalesce(text, F.lit(""))


def merge_text(rows: DataFrame, extra: DataFrame, key: str, name: str) -> DataFrame:
    """T11. Rows with a further text by id, null where there is none."""
    return rows.join(extra.select(key, F.col("text").alias(name)), key, "left")


def augment(text: Column, knowledge: Column, how: str) -> Column:
    """T12. The values of the dictionary inside ``knowledge`` put into the text: ``back`` appends each, ``inplace`` puts
    the last one behind its key's first occurrence, ``separate`` returns them alone. What is no dictionary is appended
    as it is."""
    raw = F.regexp_extract(knowledge, r"(?s)(\{.*?\})", 1)
    d = F.from_json(F.when(raw != "", raw), "map<string,string>", {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})
    ok = F.coalesce(F.size(d) > 0, F.lit(False))
    values = F.map_values(d)
    fallback = F.when(raw != "", raw).otherwise(knowledge)
    if how == "separate":
        return F.when(ok, F.array_join(F.transform(values, lambda v: F.concat(F.lit(" "), v, F.lit(";"))), "")).otherwise(fallback)
    if how == "back":
        return F.when(ok, F.concat(text, F.array_join(F.transform(values, lambda v: F.concat(F.lit(" "), v, F.lit(" "))), ""))).otherwise(F.concat(text, fallback))
    last, value = F.element_at(F.map_keys(d), -1), F.element_at(values, -1)
    end = F.instr(text, last) + F.length(last) - 1
    return F.when(ok, F.concat(text.substr(F.lit(1), end), F.lit(" ("), value, F.lit(") "), text.substr(end + 1, F.length(text)))).otherwise(F.concat(text, fallback))


def until_brace(text: Column) -> Column:
    """T12. The text up to its last closing brace; all of it without one."""
    return F.when(F.contains(text, F.lit("}")), F.regexp_extract(text, r"(?s)^(.*\})", 1)).otherwise(text)


def first_seen_names(rows: DataFrame, order: str) -> DataFrame:
    """T13. (label, name, pos): each label with the name and position of its first row."""
    return rows.groupBy("label").agg(F.min_by("name", order).alias("name"), F.min(order).alias("pos"))


def choice_codes(labels: DataFrame, alphabetical: bool = True) -> DataFrame:
    """T14. (label, label_id, choice): labels re-indexed in order, with letters if there are at most 26."""
    w = Window.orderBy("label")  # one row for each class
    ranked = labels.select("label").distinct().withColumn("label_id", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    letter = F.chr(F.lit(65) + F.col("label_id"))
    code = F.concat(F.lit("<c"), F.col("label_id"), F.lit(">"))
    return ranked.select("label", "label_id", F.when((F.col("_n") <= 26) & F.lit(alphabetical), letter).otherwise(code).alias("choice"))


def polarity_texts(tasks: DataFrame, n: int, tail: int = 41) -> DataFrame:
    """T15. (idx, text): for each task an effective and, n later, a not effective sentence, without the tail."""
    body = F.substring("text", F.lit(1), F.greatest(F.length("text") - tail, F.lit(0)))
    return tasks.select("idx", F.concat(F.lit("The molecule is effective to the following assay. "), body).alias("text")).unionByName(
        tasks.select((F.col("idx") + n).alias("idx"), F.concat(F.lit("The molecule is not effective to the following assay. "), body).alias("text"))
    )


def alias_labels(rows: DataFrame, aliases: DataFrame, label: str) -> DataFrame:
    """T16. The display name of each label; the label itself where there is none."""
    return rows.join(aliases.select(F.col("raw").alias(label), F.col("name").alias("_n")), label, "left").withColumn("name", F.coalesce("_n", F.col(label))).drop("_n")


def subject_name(label: Column) -> Column:
    """T16. ``arxiv cs xx`` becomes ``arxiv cs.XX``; others stay."""
    return F.when(label.rlike(r"^arxiv cs \w+$"), F.concat(F.lit("arxiv cs."), F.upper(F.regexp_extract(label, r"(\w+)$", 1)))).otherwise(label)


def word_histogram(rows: DataFrame, text: str, bins: int = 20) -> DataFrame:
    """T18. (bin, n) of word counts in equal bins from the least to the largest; empty bins are left out."""
    c = rows.select(F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+"))).alias("w"))
    ends = c.agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    b = F.least(F.floor((F.col("w") - F.col("lo")) * bins / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))), F.lit(bins - 1))
    return c.crossJoin(F.broadcast(ends)).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def chat_example(category: str, labels: list[str], truth: Column) -> Column:
    """T19. A question and its answer as two turns."""
    ask = f"Given a node-centered graph: <graph>, each node represents a {category}, we need to classify the center node into {len(labels)} classes: {', '.join(labels)}, please tell me which class the center node belongs to?"
    turn = lambda who, what: F.struct(F.lit(who).alias("from"), what.alias("value"))
    return F.array(turn("human", F.lit(ask)), turn("gpt", truth))


def demo_prompts(queries: DataFrame, pool: DataFrame, k: int, seed=0) -> DataFrame:
    """T20. (id, prompt): k seeded demonstrations of each class, then the query text. One block for all queries is made
    from the classes, which are few."""
    demos = group_rank(pool, ["label"], [md5_key(seed, "id"), F.col("id")]).where(F.col("rn") <= k)
    shown = demos.select("label", "rn", F.concat(F.lit("Paper:\n"), "text", F.lit("\nLabel: "), "label", F.lit("\n")).alias("t"))
    block = shown.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", "rn", "t"))), lambda x: x["t"]), "").alias("block"))
    return queries.crossJoin(F.broadcast(block)).select("id", F.concat("block", F.lit("Paper:\n"), "text", F.lit("\nLabel: ")).alias("prompt"))


def instruction_record(samples: DataFrame) -> DataFrame:
    """T21. (id, record): node list and conversation of each sample as one JSON text."""
    return samples.select("id", F.to_json(F.struct("id", F.col("nodes").alias("graph"), F.col("conversation"))).alias("record"))


def tree_prompt(rows: DataFrame, root: str) -> DataFrame:
    """T22. (root, prompt): texts grouped by two levels (outer, inner) into nested elements, in order."""
    leaf = rows.groupBy(root, "outer", "inner").agg(F.array_join(F.sort_array(F.collect_list("text")), "; ").alias("t"))
    inner = leaf.groupBy(root, "outer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("inner", "t"))), lambda x: F.concat(F.lit("<"), x["inner"], F.lit(">"), x["t"], F.lit("</"), x["inner"], F.lit(">"))), "").alias("t"))
    full = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("outer", "t"))), lambda x: F.concat(F.lit("<"), x["outer"], F.lit(">"), x["t"], F.lit("</"), x["outer"], F.lit(">"))), "")
    return inner.groupBy(root).agg(F.concat(F.lit("<information>"), full, F.lit("</information>")).alias("prompt"))


def masked_labels(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """T23. (id, labels): the labels of each node's neighbours in id order, NA unless they are train."""
    seen = nodes.select(F.col("id").alias("node"), F.when(F.col("split") == "train", F.col("label").cast("string")).otherwise("NA").alias("l"))
    return pairs.join(seen, "node").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "l"))), lambda x: x["l"]).alias("labels"))


def resume(rows: DataFrame, answered: DataFrame, start: int, end: int, key: str = "id") -> DataFrame:
    """T24. Rows [start, end) in key order that are not answered yet."""
    from loomgraph.functions.ranking import global_rank

    return global_rank(rows, [F.col(key)]).where((F.col("rn") > start) & (F.col("rn") <= end)).drop("rn").join(answered, key, "left_anti")
