"""Score quality, and training and scoring on the labelled documents."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from tallyframe.operators import coding, encode, ordered, sampling
from tallyframe.plans import boosting, features, model, train
from tallyframe.registry.bindings import SUBJECT, with_bound
from tallyframe.registry.core import Tables, query, rounded
from tallyframe.registry.recipes import PLAN_TABLES, wide
from tallyframe.session import cut_lineage

# A formula score: exact in both engines, with many ties.
BY_LENGTH = "CAST(n_chars AS DOUBLE) / (n_chars + 2000) AS score"
SCORED = f"SELECT doc_id, quality, {BY_LENGTH} FROM labels JOIN documents USING (doc_id)"


def _scored(t):
    return t.labels.join(t.documents, "doc_id").selectExpr("doc_id", "quality", BY_LENGTH)


@query(
    "auc",
    f"""WITH scored AS ({SCORED}),
    runs AS (SELECT score, COUNT(CASE WHEN quality = 1 THEN 1 END) AS pos,
             COUNT(CASE WHEN quality = 0 THEN 1 END) AS neg FROM scored GROUP BY score),
    placed AS (SELECT pos, neg, CAST(SUM(neg) OVER (ORDER BY score) - neg AS DOUBLE) AS below FROM runs)
    SELECT SUM(pos * (below + neg / 2)) / (SUM(pos) * SUM(neg)) AS auc, CAST(SUM(pos) AS BIGINT) AS n_pos,
    CAST(SUM(neg) AS BIGINT) AS n_neg FROM placed""",
)
def _(t):
    return model.auc(_scored(t), "quality", "score")


@query(
    "roc_thresholds",
    f"""WITH scored AS ({SCORED}) SELECT threshold,
    CAST(COUNT(CASE WHEN quality = 1 AND score >= threshold THEN 1 END) AS DOUBLE)
        / COUNT(CASE WHEN quality = 1 THEN 1 END) AS sensitivity,
    CAST(COUNT(CASE WHEN quality = 0 AND score < threshold THEN 1 END) AS DOUBLE)
        / COUNT(CASE WHEN quality = 0 THEN 1 END) AS specificity
    FROM scored, (SELECT CAST(i AS DOUBLE) / 10 AS threshold FROM range(1, 10) r(i)) GROUP BY threshold""",
)
def _(t):
    return model.roc_thresholds(_scored(t), "quality", "score")


@query(
    "score_intervals",
    f"SELECT quality AS label, CAST({' + '.join(f'(score >= {i} / 10.0::DOUBLE)::INT' for i in range(1, 10))} AS INT)"
    f" AS interval, COUNT(*) AS n FROM ({SCORED}) GROUP BY 1, 2",
)
def _(t):
    return model.score_intervals(_scored(t), "quality", "score")


@query("roc_threshold_ci")
def _(t):
    out = model.roc_threshold_ci(_scored(t), "quality", "score")
    return rounded(out, [c for c in out.columns if c != "threshold"], 9)


@query(
    "roc_threshold_ci_checks",
    "SELECT CAST(i AS DOUBLE) / 10 AS threshold, TRUE AS is_ordered, TRUE AS holds_estimate FROM range(1, 10) r(i)",
)
def _(t):
    """Intervals around the point estimates: in order, and medians within two standard errors."""
    scored = _scored(t)
    ci = model.roc_threshold_ci(scored, "quality", "score")
    sizes = scored.agg(*[F.count(F.when(F.col("quality") == c, 1)).alias(f"n{c}") for c in (1, 0)])
    both = ci.join(model.roc_thresholds(scored, "quality", "score"), "threshold").join(F.broadcast(sizes))
    ordered_ = F.lit(True)
    near = F.lit(True)
    for m, name, n in (("se", "sensitivity", "n1"), ("sp", "specificity", "n0")):
        low, mid, high = (F.col(f"{m}_{x}") for x in ("low", "median", "high"))
        p = F.col(name)
        ordered_ = ordered_ & (low <= mid) & (mid <= high)
        near = near & (F.abs(mid - p) <= 2 * F.sqrt(p * (1 - p) / F.col(n)) + 1e-9)
    return both.select("threshold", ordered_.alias("is_ordered"), near.alias("holds_estimate"))


# ---- training on the feature table

ROUNDS = 15  # of the registered trainings; the presets allow thousands


@query(
    "model_path_checks",
    with_bound(
        "subject",
        **PLAN_TABLES,
        sizes="SELECT CAST(SUM(CASE WHEN split = 'train' THEN copies END) AS BIGINT) AS n_train,"
        " CAST(SUM(CASE WHEN split = 'validation' THEN copies END) AS BIGINT) AS n_validation,"
        " CAST(SUM(CASE WHEN split = 'test' THEN copies END) AS BIGINT) AS n_test FROM plan",
        then="SELECT n_train, n_validation, n_test, n_validation + n_test AS n_scored, n_validation + n_test AS n_ids,"
        " TRUE AS scores_in_range, TRUE AS ranks_gapless, TRUE AS gains_sum_to_one, TRUE AS has_metric FROM sizes",
    ),
)
def _(t):
    """The whole path on the derived table, and what must hold for any fit."""
    derived = features.derive_features(wide(t))
    keys = t.subject.select("SK_ID_CURR", "TARGET")
    done = train.train(derived, "SK_ID_CURR", "TARGET", boosting.SHALLOW.with_rounds(ROUNDS), keys)
    count = lambda part: F.count(F.when(F.col("split") == part, 1))
    sizes = done.rows.agg(*[count(p).alias(f"n_{p}") for p in ("train", "validation", "test")])
    found = done.scores.agg(
        F.count("score").alias("n_scored"),
        F.count_distinct("SK_ID_CURR").alias("n_ids"),
        F.every((F.col("score") >= 0) & (F.col("score") <= 1)).alias("scores_in_range"),
    )
    ranks = done.importance().agg(
        ((F.min("rank") == 1) & (F.max("rank") == F.count_distinct("rank"))).alias("ranks_gapless"),
        (F.abs(F.sum("importance") - 1) < 1e-6).alias("gains_sum_to_one"),
    )
    # One row each.
    return sizes.join(F.broadcast(found)).join(F.broadcast(ranks)).withColumn("has_metric", F.lit(done.metric is not None))


# ---- training on documents

FEATURES = {
    "n_chars": "n_chars",
    "n_words": "size(split(text, ' '))",
    "n_lines": "size(split(text, '\\n'))",
    "n_digits": "length(regexp_replace(text, '[^0-9]', ''))",
    "n_upper": "length(regexp_replace(text, '[^A-Z]', ''))",
    "n_marks": "length(regexp_replace(text, '[^.,;:!?]', ''))",
}


def _documents(t):
    """Per document its features, label (NULL = to be scored) and split."""
    docs = t.documents.selectExpr(
        "doc_id", "lang", "source", *[f"{e} AS {n}" for n, e in FEATURES.items()]
    )
    rows = encode.one_hot_named(docs, ["lang", "source"]).join(
        t.labels.select("doc_id", "quality"), "doc_id", "left"
    )
    return sampling.three_way_split(rows, "doc_id", "quality", keys=t.labels)


@cache
def _trained_once(spark, folder, settings):
    """One fit per session, folder and settings, whichever queries ask for it."""
    t = Tables(spark, folder)
    rows = _documents(t)
    names = model.feature_names(rows, "doc_id", "quality")
    cuts = boosting.find_cuts(rows.filter(F.col("split") == "train"), names)
    # Training makes many passes: over the written features, not over the texts.
    frame = cut_lineage(boosting.bin_rows(rows, "doc_id", "quality", names, cuts, keep=["split"]))
    known = frame.withColumn("is_validation", F.col("split") == "validation")
    return boosting.fit(known, names, cuts, settings, "is_validation"), frame


def _trained(t, settings):
    return _trained_once(t.spark, t.folder, settings.with_rounds(ROUNDS))


@query("train_score")
def _(t):
    fitted, frame = _trained(t, boosting.DEEP)
    return fitted.score(frame).select("doc_id", "split", "score")


@query("train_score_alt")
def _(t):
    fitted, frame = _trained(t, boosting.SHALLOW)
    return fitted.score(frame).select("doc_id", "split", "score")


@query(
    "train_score_checks",
    "SELECT doc_id, quality IS NULL AS is_test, TRUE AS in_range FROM documents LEFT JOIN labels USING (doc_id)",
)
def _(t):
    """Every document has a score, and those without a label are the test part."""
    fitted, frame = _trained(t, boosting.DEEP)
    in_range = (F.col("score") > 0) & (F.col("score") < 1)
    return fitted.score(frame).select("doc_id", (F.col("split") == "test").alias("is_test"), in_range.alias("in_range"))


@query("importance")
def _(t):
    fitted, _ = _trained(t, boosting.SHALLOW)
    return ordered.top_k(fitted.importance(t.spark), ["rank"], 30)


@query(
    "importance_checks",
    "SELECT TRUE AS frequencies_match, TRUE AS covers_match, TRUE AS gains_match, TRUE AS rows_add_up, TRUE AS leaves_bounded",
)
def _(t):
    """Shares of gain, cover and frequency against the table of all nodes, whose rows and covers must add up."""
    fitted, _ = _trained(t, boosting.SHALLOW)
    nodes, shares = fitted.nodes(t.spark), fitted.importance(t.spark)
    splits = nodes.filter(F.col("feature").isNotNull())
    total = splits.agg(F.sum("gain").alias("g"), F.sum("cover").alias("c"), F.count(F.lit(1)).alias("n"))
    own = splits.groupBy("feature").agg(F.sum("gain").alias("g1"), F.sum("cover").alias("c1"), F.count(F.lit(1)).alias("n1"))
    # A row per feature, and one of totals.
    both = shares.join(own, "feature", "left").join(F.broadcast(total)).na.fill(0, ["g1", "c1", "n1"])
    near = lambda a, b: F.every(F.abs(F.col(a) - b) < 1e-9)
    shares_fit = both.agg(
        near("frequency", F.col("n1") / F.col("n")).alias("frequencies_match"),
        near("cover", F.col("c1") / F.col("c")).alias("covers_match"),
        near("importance", F.col("g1") / F.col("g")).alias("gains_match"),
    )
    child = lambda side: nodes.select("tree", F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("rows", "cover")])
    family = splits.join(child("left"), ["tree", "left"]).join(child("right"), ["tree", "right"])
    adds_up = (F.col("rows") == F.col("left_rows") + F.col("right_rows")) & (
        F.abs(F.col("cover") - F.col("left_cover") - F.col("right_cover")) < 1e-6
    )
    leaves = nodes.filter(F.col("feature").isNull()).groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    bounded = leaves.agg((F.max("n") <= boosting.SHALLOW.leaves).alias("leaves_bounded"))
    # One row each.
    return shares_fit.join(F.broadcast(family.agg(F.every(adds_up).alias("rows_add_up")))).join(F.broadcast(bounded))


@query("submission")
def _(t):
    fitted, frame = _trained(t, boosting.SHALLOW)
    unlabelled = frame.filter(F.col("split") == "test")
    return model.submission(fitted.score(unlabelled), "doc_id")


@query(
    "submission_checks",
    "SELECT doc_id, TRUE AS in_range FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL",
)
def _(t):
    """The submission has one score per unlabelled document."""
    fitted, frame = _trained(t, boosting.SHALLOW)
    sent = model.submission(fitted.score(frame.filter(F.col("split") == "test")), "doc_id")
    return sent.select("doc_id", ((F.col("TARGET") > 0) & (F.col("TARGET") < 1)).alias("in_range"))


# ---- what a training is made of, on the subject table

TEXTS = ["NAME_CONTRACT_TYPE", "CODE_GENDER", "NAME_TYPE_SUITE", "NAME_INCOME_TYPE", "NAME_EDUCATION_TYPE",
         "NAME_FAMILY_STATUS", "NAME_HOUSING_TYPE", "OCCUPATION_TYPE", "FONDKAPREMONT_MODE", "FLAG_OWN_REALTY"]
CODES = "SELECT v, row_number() OVER (ORDER BY v) AS code FROM (SELECT DISTINCT {c} AS v FROM subject WHERE {c} IS NOT NULL AND CODED)"
# Codes come from some of the subjects, so that others have values that were never seen.
CODED_ROWS = "DAYS_BIRTH < -8000 AND NAME_HOUSING_TYPE <> '7'"
CODE_TABLES = {f"codes_{c}": CODES.format(c=c).replace("CODED", CODED_ROWS) for c in TEXTS}
CODED = (
    "SELECT "
    + ", ".join(
        f"CASE WHEN {c} IS NULL THEN NULL ELSE COALESCE((SELECT code FROM codes_{c} WHERE v = {c}), 0) END AS {c}" if c in TEXTS else c
        for c in SUBJECT
    )
    + " FROM subject"
)


@query("coded_matrix", with_bound("subject", **CODE_TABLES, then=CODED))
def _(t):
    return coding.apply_codes(t.subject, coding.code_table(t.subject.filter(CODED_ROWS), TEXTS), TEXTS)


FIRST_FEATURES = ["AMT_ANNUITY", "AMT_GOODS_PRICE", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "FLAG_EMAIL"]
FIRST = boosting.DEEP


def _first_split_sql() -> str:
    """Gains of all cuts of all features, both ways for missing values, as sums over the rows."""
    s = FIRST
    cells = " UNION ALL ".join(
        f"SELECT {i} AS i, '{c}' AS feature, CAST({c} AS DOUBLE) AS x, 0.5 - TARGET AS g FROM subject WHERE TARGET IS NOT NULL"
        for i, c in enumerate(FIRST_FEATURES)
    )
    part = "{0} * {0} / ({1} + " + f"{s.reg_lambda}::DOUBLE)"
    return with_bound(
        "subject",
        cells=cells,
        sums="SELECT i, feature, x, CAST(SUM(g) AS DOUBLE) AS g, COUNT(*) AS n FROM cells GROUP BY ALL",
        whole="SELECT i, CAST(SUM(g) AS DOUBLE) AS g, CAST(SUM(n) AS BIGINT) AS n,"
        " COALESCE(CAST(SUM(CASE WHEN x IS NULL THEN g END) AS DOUBLE), 0) AS mg,"
        " COALESCE(CAST(SUM(CASE WHEN x IS NULL THEN n END) AS BIGINT), 0) AS mn FROM sums GROUP BY i",
        below="SELECT i, feature, x, CAST(SUM(g) OVER upto AS DOUBLE) AS lg, CAST(SUM(n) OVER upto AS BIGINT) AS ln,"
        " x = MAX(x) OVER (PARTITION BY i) AS is_last FROM sums WHERE x IS NOT NULL WINDOW upto AS (PARTITION BY i ORDER BY x)",
        sides="SELECT i, feature, x, m AS missing_left, lg + CASE WHEN m THEN mg ELSE 0 END AS lg, ln + CASE WHEN m THEN mn ELSE 0 END AS ln,"
        " g, n FROM below JOIN whole USING (i), (VALUES (FALSE), (TRUE)) t(m) WHERE NOT is_last",
        gains=f"SELECT *, n - ln AS rn, {part.format('lg', '(ln / 4.0::DOUBLE)')} + {part.format('(g - lg)', '((n - ln) / 4.0::DOUBLE)')}"
        f" - {part.format('g', '(n / 4.0::DOUBLE)')} AS gain FROM sides"
        f" WHERE ln / 4.0::DOUBLE >= {s.min_child_weight} AND (n - ln) / 4.0::DOUBLE >= {s.min_child_weight}",
        then="SELECT feature, x AS threshold, missing_left, round(gain, 9) AS gain, n / 4.0::DOUBLE AS cover, ln AS n_left, rn AS n_right"
        " FROM gains ORDER BY gains.gain DESC, missing_left, i, x LIMIT 1",
    )


@query("boost_first_split", _first_split_sql())
def _(t):
    """The first split of a one-round fit on all labelled subjects: one bin per value, all rows and features drawn."""
    names = FIRST_FEATURES
    known = t.subject.filter(F.col("TARGET").isNotNull())
    cuts = boosting.find_cuts(known, names)
    rows = boosting.bin_rows(known, "SK_ID_CURR", "TARGET", names, cuts)
    settings = boosting.replace(FIRST, rounds=1, depth=1, row_share=1.0, column_share=1.0)
    nodes = boosting.fit(rows, names, cuts, settings).nodes(t.spark)
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("rows").alias(f"n_{c}"))
    return (
        nodes.filter("node = 0 AND feature IS NOT NULL")
        .join(side("left"), "left")
        .join(side("right"), "right")
        .select("feature", "threshold", "missing_left", F.round("gain", 9).alias("gain"), "cover", "n_left", "n_right")
    )
