"""Groups, folds, holdouts and samplers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.ordered import numbered, placed
from quillmark.sources.connectors import scratch


def _written(rows: DataFrame, name: str) -> DataFrame:
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def connected(edges: DataFrame) -> DataFrame:
    """(a, root) over an edge list (a, b) of two kinds of nodes: least label by
    repeated minimum on either side, written to the shared folder each round."""
    labels = _written(edges.groupBy("a").agg(F.min("a").alias("root")), "labels")
    while True:
        by_b = edges.join(labels, "a").groupBy("b").agg(F.min("root").alias("root"))
        new = edges.join(by_b, "b").groupBy("a").agg(F.min("root").alias("new"))
        # one jump along the roots halves long chains
        jump = labels.select(F.col("a").alias("new"), F.col("root").alias("next"))
        stepped = labels.join(new, "a").join(jump, "new", "left").select("a", F.least("root", "new", F.coalesce("next", "new")).alias("root"), F.col("root").alias("old"))
        stepped = _written(stepped, "labels")
        changed = stepped.filter("root <> old").limit(1).count()
        labels = stepped.select("a", "root")
        if not changed:
            return labels


def source_groups(samples: DataFrame) -> DataFrame:
    """(sample_id, label, group_id): human texts group by source, raw ones by
    topic, rewritten ones with their original; groups that share an exactly
    equal stripped text are one."""
    topic = F.concat(F.lit("ai_topic_"), F.col("lang"))
    parents = samples.filter("label = 'ai_raw'").select(F.col("sample_id").alias("original_id"), topic.alias("parent"))
    unknown = F.concat(F.lit("ai_topic_unknown_"), F.col("sample_id"))
    prelim = samples.join(parents, "original_id", "left").select(
        "sample_id", "label",
        F.when(F.col("label") == "human", F.concat(F.lit("human_doc_file_"), F.col("source"))).when(F.col("label") == "ai_raw", topic).otherwise(F.coalesce("parent", unknown)).alias("a"),
        F.md5(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).alias("b"),
    )
    prelim = _written(prelim, "groups")
    roots = connected(prelim.select("a", "b").distinct())
    return prelim.join(roots, "a").select("sample_id", "label", F.col("root").alias("group_id"))


def topic_numbers(samples: DataFrame, prompt: str, order: str) -> DataFrame:
    """(prompt, topic): topics numbered as their prompts first appear."""
    first = samples.groupBy(prompt).agg(F.min(order).alias("first"))
    return first.select(prompt, F.format_string("ai_topic_%02d", F.dense_rank().over(Window.orderBy("first")) - 1).alias("topic"))  # a row for each prompt


def hash_order(*columns: str, seed: int = 42) -> Column:
    return F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in columns), F.lit(str(seed))))


def grouped_folds(rows: DataFrame, group: str, label: str, k: int = 5) -> DataFrame:
    """``rows`` with a fold, whole groups in one.

    Groups with equal label counts are alike: each fold gets as many of them
    as every other, and those left over are placed one by one where the label
    shares of the folds stay closest; the most uneven counts come first.  Only
    the distinct label counts, not the groups, reach the driver; which of
    equal groups goes where follows from their numbers in order of name."""
    import numpy as np

    names = sorted((r[0] for r in rows.select(label).distinct().collect()), key=str)  # a row for each label
    sizes = rows.groupBy(group).agg(F.array(*(F.count_if(F.col(label).eqNullSafe(n)) for n in names)).alias("_sizes"))
    alike = sizes.groupBy("_sizes").agg(F.count("*").alias("m")).toPandas()
    alike = sorted(zip(map(tuple, alike["_sizes"]), map(int, alike["m"]), strict=True), key=lambda x: (-np.std(x[0]), x[0]))
    whole = np.maximum(sum((np.array(v, float) * m for v, m in alike), np.zeros(len(names))), 1)
    held, ends = np.zeros((k, len(names))), []
    for v, m in alike:
        each = np.full(k, m // k)
        held += m // k * np.array(v, float)
        for _ in range(m % k):
            best = min(range(k), key=lambda f: (np.std((held + np.eye(k)[f][:, None] * v) / whole, axis=0).mean().round(12), held[f].sum(), f))
            held[best] += v
            each[best] += 1
        ends.append((list(v), [int(x) for x in np.cumsum(each)]))
    spark = rows.sparkSession
    table = spark.createDataFrame(ends, "_sizes array<long>, _ends array<long>")
    folds = placed(sizes, ["_sizes"], group, name="_n").join(table, "_sizes").select(group, F.size(F.filter("_ends", lambda e: e <= F.col("_n"))).alias("fold"))
    return rows.join(folds, group)


def stratified_folds(rows: DataFrame, key: str, label: str, k: int = 5) -> DataFrame:
    """Folds of equal label shares, in hash order."""
    hashed = rows.withColumn("_h", hash_order(key))
    return placed(hashed, [label], "_h", key, name="_at").withColumn("fold", (F.col("_at") % k).cast("int")).drop("_h", "_at")


def capped(rows: DataFrame, by: list[str], key: str, most: Column | int, seed: int = 42) -> DataFrame:
    """At most ``most`` rows of each group, in hash order, never more than
    there are."""
    hashed = rows.withColumn("_h", hash_order(key, seed=seed))
    return placed(hashed, by, "_h", key, name="_at").filter(F.col("_at") < most).drop("_h", "_at")


def balanced(rows: DataFrame, label: str, key: str) -> DataFrame:
    least = rows.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("_least"))
    return capped(rows.crossJoin(F.broadcast(least)), [label], key, F.col("_least")).drop("_least")  # one row


def generator_balanced(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Machine texts capped by (label, generator); human ones untouched."""
    machine = capped(rows.filter("label <> 'human'"), ["label", "generator"], key, most)
    return rows.filter("label = 'human'").unionByName(machine)


def human_split(rows: DataFrame, key: str, share: float = 0.2) -> DataFrame:
    """Human rows with ``test``: the first ``share`` in hash order."""
    human = rows.filter("label = 'human'")
    cut = human.agg(F.floor(F.count("*") * share).alias("_cut"))
    order = human.select(key, hash_order(key).alias("_h"))
    limit = order.crossJoin(F.broadcast(cut))  # one row
    return human.join(numbered(limit, "_h", key).select(key, (F.col("n") < F.col("_cut")).alias("test")), key)


def leave_one_out(rows: DataFrame, generator: str, test_human: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) without and with one generator; test takes the human
    rows of ``test_human``, train the others."""
    people = rows.filter("label = 'human'")
    other = rows.filter("label <> 'human'")
    names = test_human.select(key)
    train = other.filter(F.col("generator") != generator).unionByName(people.join(names, key, "left_anti").select(*rows.columns))
    return train, other.filter(F.col("generator") == generator).unionByName(people.join(names, key, "left_semi").select(*rows.columns))


def quotas(rows: DataFrame, source: str, key: str, total: int) -> DataFrame:
    """ceil(total / sources) rows of each source at most."""
    n = rows.select(source).distinct().agg(F.count("*").alias("_n"))
    return capped(rows.crossJoin(F.broadcast(n)), [source], key, F.ceil(F.lit(total) / F.col("_n"))).drop("_n")  # one row
