"""Secret scan: candidates by form, then a random forest that removes false positives.

All work is DataFrame expressions and MLlib; nothing runs in Python on the executors.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import hash_key
from tallyframe.session import cut_lineage

SPACE = "[\\x20\\x09-\\x0D]+"
MIN_LENGTH = 12
RUN = f"[A-Za-z0-9+/_.@-]{{{MIN_LENGTH},}}"
VALUE = RUN + "={0,2}(?![A-Za-z0-9+/_.@-])"
APART = "&,;?|{}\\[\\]"  # between the pairs of a query string, of JSON and of chained assignments
DICTIONARY_COUNT = 5  # occurrences that make a word a dictionary word
TRAINING_ROWS = 20_000  # labelled findings that the forest is fitted on, at most: the smallest by hash
TREES, DEPTH = 30, 6
THRESHOLD = 0.5

# Words beside a secret, and words beside other random-looking values.
SECRET_WORDS = "(?i)(token|secret|passw|pwd|api.?key|access.?key|credential|auth|bearer|private.?key)"
PLAIN_WORDS = "(?i)(sha1|sha256|md5|checksum|commit|uuid|isbn|doi|phone|card|account|invoice|version|build)"
EXAMPLE_WORDS = "(?i)(example|sample|dummy|placeholder|changeme|your.?|xxxx|test)"

FEATURES = (
    "length",
    "digits",
    "uppers",
    "lowers",
    "marks",
    "distinct",
    "switches",
    "surprise",
    "coverage",
    "slashes",
    "dots",
    "has_at",
    "path_example",
    "near_assignment",
    "near_secret",
    "near_plain",
    "near_example",
)


def find_candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """A row per value: key, path, at (number of the word from 0), run (number of the value in the word from 0), value,
    and what surrounds it. The values are all runs of 12 or more letters, digits and ``+/_.@-`` in a word.

    ``lead`` is what precedes a value in its word, back to the run before the last and no further than its own pair of
    a query string, of JSON or of chained assignments; ``word`` is lead, value and what follows likewise. The two words
    before and the one after count for values whose pair begins or ends with the word, and are empty for others."""
    words = F.split(F.col("__text"), SPACE)
    held = docs.select(
        F.col(f"`{key}`").alias("__id"),
        F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")).alias("path"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"),
    ).filter(F.col("__text").rlike(RUN))
    held = held.select("__id", "path", words.alias("w"))
    places = F.filter(
        F.sequence(F.lit(0), F.size("w") - 1),
        lambda i: (F.length(F.get("w", i)) >= MIN_LENGTH) & F.get("w", i).rlike(RUN),
    )
    near = lambda i, d: F.coalesce(F.get("w", i + d), F.lit(""))
    found = held.select(
        "__id",
        "path",
        F.explode(
            F.transform(
                places,
                lambda i: F.struct(
                    i.alias("at"),
                    near(i, 0).alias("whole"),
                    near(i, -2).alias("before2"),
                    near(i, -1).alias("before"),
                    near(i, 1).alias("after"),
                ),
            )
        ).alias("p"),
    ).select("__id", "path", "p.*")
    values = F.regexp_extract_all("whole", F.lit(VALUE), F.lit(0))
    found = found.select("*", values.alias("values"), F.split("whole", VALUE, -1).alias("gaps"))
    # Each value with the run before it and the gaps around both, taken before rows are made of them.
    around = F.transform(
        "values",
        lambda value, i: F.struct(
            i.alias("run"),
            value.alias("value"),
            F.concat(
                F.coalesce(F.get("gaps", i - 1), F.lit("")), F.coalesce(F.get("values", i - 1), F.lit("")), F.get("gaps", i)
            ).alias("to"),
            F.get("gaps", i + 1).alias("on"),
            (i + 1 == F.size("values")).alias("last"),
        ),
    )
    found = found.select("__id", "path", "at", "before2", "before", "after", F.explode(around).alias("v")).select(
        "__id", "path", "at", "before2", "before", "after", "v.*"
    )
    apart = f"[{APART}]"
    opens = (F.col("run") <= 1) & ~F.col("to").rlike(apart)
    ends = F.col("last") & ~F.col("on").rlike(apart)
    lead = F.regexp_extract("to", f"[^{APART}]*$", 0)
    return found.select(
        "__id",
        "path",
        "at",
        "run",
        "value",
        lead.alias("lead"),
        F.concat(lead, F.col("value"), F.regexp_extract("on", f"^[^{APART}]*", 0)).alias("word"),
        *[F.when(opens, F.col(c)).otherwise("").alias(c) for c in ("before2", "before")],
        F.when(ends, F.col("after")).otherwise("").alias("after"),
    )


def dictionary(docs: DataFrame, text: str = "text", least: int = DICTIONARY_COUNT) -> DataFrame:
    """Lower-case words of three letters or more that all texts together have ``least`` times."""
    words = docs.select(F.explode(F.split(F.lower(F.col(f"`{text}`")), "[^\\p{L}]+")).alias("word"))
    counts = words.filter(F.length("word") >= 3).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= least).select("word")


def _class(character: Column) -> Column:
    low = F.lower(character)
    return F.when(low.rlike("[a-z]"), low).when(low.rlike("[0-9]"), F.lit("0")).otherwise(F.lit("."))


def _pairs(df: DataFrame, column: str) -> DataFrame:
    """Adjacent characters of a column, by class: 28 classes, so 784 pairs at most."""
    at = F.sequence(F.lit(1), F.length(column) - 1)
    each = df.filter(F.length(column) > 1).withColumn("i", F.explode(at))
    character = lambda d: F.substring(F.col(column), F.col("i") + d, F.lit(1))
    return each.withColumn("x", _class(character(0))).withColumn("y", _class(character(1))).drop("i")


def value_features(values: DataFrame, words: DataFrame) -> DataFrame:
    """Per distinct value what its own characters say. ``words`` teaches transitions and is the dictionary."""
    seen = _pairs(words, "word").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    totals = seen.groupBy("x").agg(F.sum("n").alias("total"))
    # Pairs never seen in a word, of 28 classes, count one.
    learnt = cut_lineage(
        seen.join(totals, "x").select("x", "y", (-F.ln((F.col("n") + 1) / (F.col("total") + 28))).alias("bits"))
    )
    surprise = (
        _pairs(values, "value")
        .join(learnt, ["x", "y"], "left")
        .groupBy("value")
        .agg(F.avg(F.coalesce("bits", F.lit(8.0))).alias("surprise"))
    )
    runs = values.select(
        "value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word")
    )
    known = (
        runs.select("word").distinct().join(words, "word", "left_semi").withColumn("hit", F.lit(1))
    )
    covered = runs.join(known, "word").groupBy("value").agg(F.sum(F.length("word")).alias("covered"))
    n = F.length("value")
    share = lambda pattern: F.regexp_count("value", F.lit(pattern)) / n
    switch = "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])"
    return (
        values.join(surprise, "value", "left")
        .join(covered, "value", "left")
        .select(
            "value",
            n.cast("double").alias("length"),
            share("[0-9]").alias("digits"),
            share("[A-Z]").alias("uppers"),
            share("[a-z]").alias("lowers"),
            share("[^A-Za-z0-9]").alias("marks"),
            (F.size(F.array_distinct(F.split("value", ""))) / n).alias("distinct"),
            share(switch).alias("switches"),
            F.coalesce("surprise", F.lit(8.0)).alias("surprise"),
            (F.coalesce("covered", F.lit(0)) / n).alias("coverage"),
            F.regexp_count("value", F.lit("/")).cast("double").alias("slashes"),
            F.regexp_count("value", F.lit("\\.")).cast("double").alias("dots"),
            F.col("value").contains("@").cast("double").alias("has_at"),
        )
    )


def with_features(candidates: DataFrame, words: DataFrame) -> DataFrame:
    values = value_features(cut_lineage(candidates.select("value").distinct()), words)
    around = F.concat_ws(" ", "before2", "before", "word", "after")
    near = lambda column, pattern: column.rlike(pattern).cast("double")
    return candidates.join(values, "value").withColumns(
        {
            "path_example": near(F.col("path"), EXAMPLE_WORDS),
            "near_assignment": near(F.concat("before", F.lit(" "), "word"), "[=:]"),
            "near_secret": near(around, SECRET_WORDS),
            "near_plain": near(around, PLAIN_WORDS),
            "near_example": near(F.concat_ws(" ", "before2", "before", "value"), EXAMPLE_WORDS),
        }
    )


def rule_label() -> Column:
    """A label where the context leaves no doubt: 1 for a value assigned to a secret's name, 0 for plain
    numbers, addresses and example values and for other values that are dictionary words, NULL elsewhere."""
    assigned = F.concat_ws(" ", "before2", "before", "lead").rlike(
        "(?i)(token|secret|passw\\w*|pwd|api.?key|access.?key)\\W{0,3}\\s*[=:]"
    )
    plain = F.col("value").rlike("^[0-9.+/_-]+$") | F.col("value").rlike("@[a-z0-9-]+\\.[a-z]") | (F.col("near_example") > 0)
    common = F.col("coverage") >= 1
    return F.when(plain, 0).when(assigned & F.col("value").rlike("[A-Za-z]"), 1).when(common, 0)


def fit_forest(labelled: DataFrame, rows: int = TRAINING_ROWS, seed: int = 7) -> PipelineModel | None:
    """A forest fitted on at most ``rows`` labelled findings, those with the smallest hash of value and place.
    Nothing if one of the labels is missing."""
    order = hash_key(F.lit("findings"), F.col("value"), F.col("__id"), F.col("at"), F.col("run"))
    sample = labelled.filter("label IS NOT NULL").withColumn("__order", order)
    sample = cut_lineage(sample.orderBy("__order", "value", "at", "run").limit(rows).coalesce(1).drop("__order"))
    if sample.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="__features")
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="__features", probabilityCol="__probability", rawPredictionCol="__raw",
        predictionCol="__prediction", numTrees=TREES, maxDepth=DEPTH, seed=seed,
    )
    return PipelineModel([vectors, forest.fit(vectors.transform(sample.withColumn("label", F.col("label").cast("double"))))])


def scan_secrets(
    docs: DataFrame,
    labelled: DataFrame | None = None,
    key: str = "doc_id",
    text: str = "text",
    path: str = "source",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """A row per candidate: key, at, run, value, score and is_secret.

    ``labelled`` has findings with features (``with_features``) and a label of 0 or 1; without it the findings of
    ``docs`` whose context is clear are the labelled ones. The score is the forest's probability of a
    secret, and a candidate is one from ``threshold`` on. If there are no findings of both labels, the score is
    NULL and every candidate stays. Missing and empty texts have no candidates; a missing path counts as
    an empty one; repeated rows give repeated results; other columns are ignored.
    """
    words = cut_lineage(dictionary(docs, text))
    found = cut_lineage(with_features(cut_lineage(find_candidates(docs, key, text, path)), words))
    model = fit_forest(labelled if labelled is not None else found.withColumn("label", rule_label()))
    if model is None:
        scored = found.withColumn("score", F.lit(None).cast("double")).withColumn("is_secret", F.lit(True))
    else:
        scored = model.transform(found).withColumn("score", F.round(F.element_at(vector_to_array("__probability"), 2), 6))
        scored = scored.withColumn("is_secret", F.col("score") >= threshold)
    return scored.select(
        F.col("__id").alias(key), F.col("at").cast("bigint").alias("at"), F.col("run").cast("bigint").alias("run"), "value", "score", "is_secret"
    )
