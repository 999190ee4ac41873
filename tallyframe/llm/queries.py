"""The operators bound to the given tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import (
    centroids,
    decontaminate,
    jaccard,
    licenses,
    lm_score,
    mixing,
    quality,
    repeats,
    secrets,
    sharding,
    spelling,
    token_files,
    warc,
)
from tallyframe.sources.readers import read_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# ---- 1 benchmark decontamination


@query("op1_decontaminate")
def _(spark, folder):
    hits = decontaminate.decontaminate(
        read_parquet(spark, folder, "documents"), read_parquet(spark, folder, "benchmark")
    )
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "n_near_items",
    )


def _words_sql(table: str, key: str) -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT {key} AS id, regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"


# Near matches have no practical SQL; all other columns of operator 1 do.
@query(
    "exact_matches",
    f"""WITH items AS ({_words_sql("benchmark", "CAST(item_id AS VARCHAR)")}),
    g AS (SELECT DISTINCT id AS item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
        SELECT id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 8, 2))) AS i
        FROM items WHERE len(w) > 0)),
    d AS ({_words_sql("documents", "doc_id")}),
    dg AS (SELECT id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
        SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
    hits AS (SELECT DISTINCT id, i, n, item FROM dg JOIN g USING (n, g)),
    hit_words AS (SELECT id, COUNT(DISTINCT i + k) AS n_hit FROM hits, range(0, 10) r(k) WHERE k < n GROUP BY id),
    hit_items AS (SELECT id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT id, item FROM hits) GROUP BY id)
    SELECT d.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
        coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit_words USING (id) LEFT JOIN hit_items USING (id)""",
)
def _(spark, folder):
    return QUERIES["op1_decontaminate"](spark, folder).drop("n_near_items")


# ---- 2 WARC


@query("op2_warc")
def _(spark, folder):
    return warc.archive_round_trip(read_parquet(spark, folder, "pages"))


# ---- 3 mixing

MIX_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
           md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
    FROM documents),
s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           list_value(3, 1, 2)[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
    FROM d GROUP BY source),
r AS (
    SELECT 0 AS step, source, source_size, w, FALSE AS is_full, CAST(0 AS DOUBLE) AS target FROM s
    UNION ALL
    SELECT step + 1, source, source_size, w, t >= 2.0 * source_size, t FROM (
        SELECT *, w * (1.5 * sum(source_size) OVER () - coalesce(sum(CASE WHEN is_full THEN 2.0 * source_size END) OVER (), 0))
               / CAST(sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () AS DOUBLE) AS t
        FROM r WHERE step < 64)
    WHERE t IS NOT NULL),
q AS (
    SELECT source, source_size, CASE WHEN is_full THEN 2.0 * source_size ELSE target END AS target
    FROM r WHERE step = (SELECT max(step) FROM r)),
p AS (
    SELECT doc_id, size, source, CAST(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS before
    FROM d)
SELECT doc_id, size, p.source, source_size, CAST(target AS DOUBLE) AS target,
       CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) * size
       + greatest(0, least(size, CAST(floor(target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END
         * source_size) AS BIGINT) - before)) AS taken
FROM p JOIN q ON p.source IS NOT DISTINCT FROM q.source"""


@query("op3_source_mix", MIX_SQL)
def _(spark, folder):
    return mixing.mix(read_parquet(spark, folder, "documents"))


# ---- 4 n-gram Jaccard join


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT id, array_to_string(w[i:i + 3], ' ') AS g FROM (
    SELECT id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT id, COUNT(*) AS n FROM s GROUP BY id),
shared AS (SELECT a.id AS x, b.id AS y, COUNT(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN n p ON p.id = x JOIN n q ON q.id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x AS id, x AS r FROM ways UNION SELECT reach.id, ways.y FROM reach JOIN ways ON reach.r = ways.x),
least_of AS (SELECT id, MIN(r) AS c FROM reach GROUP BY id)
SELECT w.id AS doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, w.id) AS component_id
FROM w LEFT JOIN n USING (id) LEFT JOIN least_of USING (id)"""


@query("op4_jaccard_join", JACCARD_SQL)
def _(spark, folder):
    return jaccard.link_documents(read_parquet(spark, folder, "documents"))


# ---- 5 secret scan


@query("op5_secret_scan")
def _(spark, folder):
    return secrets.scan_secrets(read_parquet(spark, folder, "documents"))


# ---- 6 quality rules


SPACE_SQL = "[\\x20\\x09-\\x0D]"
LEDGER_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
repeated AS (SELECT doc_id, COUNT(DISTINCT i + k) AS n FROM again, range(0, 8) r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) - COUNT(DISTINCT l) AS n_dup_lines
    FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
    WHERE regexp_replace(l, '{SPACE_SQL}', '', 'g') <> '' GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '{SPACE_SQL}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_doubled_words,
    len(list_filter(w, lambda x: ends_with(x, '!!'))) AS n_bang_words
    FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)),
f AS (SELECT *, CAST({' + '.join(f'CASE WHEN {r.failed} THEN {1 << r.bit} ELSE 0 END' for r in quality.RULES)} AS BIGINT)
    AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    failures & {quality.BASE.mask()} <> 0 AS base_failed, failures & {quality.STRICT.mask() | quality.BASE.mask()} = 0 AS kept, failures
FROM f"""


@query("op6_quality_ledger", LEDGER_SQL)
def _(spark, folder):
    entries = quality.ledger(read_parquet(spark, folder, "documents"))
    base = quality.rejected(quality.BASE)
    return entries.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & ~quality.rejected(quality.STRICT)).alias("kept"),
        "failures",
    )


ABLATION_SQL = (
    f"WITH ledger AS ({LEDGER_SQL}), m(version, rule, bit, mask) AS (VALUES "
    + ", ".join(
        f"('{p.version}', '{r.name}', CAST({1 << r.bit} AS BIGINT), CAST({p.mask()} AS BIGINT))"
        for p in quality.POLICIES
        for r in quality.RULES
        if r.name in p.rules
    )
    + ") SELECT version, rule, COUNT(CASE WHEN failures & bit <> 0 THEN 1 END) AS n_failed,"
    " COUNT(CASE WHEN failures & mask = bit THEN 1 END) AS n_only_this, COUNT(CASE WHEN failures & mask = 0 THEN 1 END) AS n_kept,"
    " COUNT(CASE WHEN failures & mask IN (0, bit) THEN 1 END) AS n_kept_without FROM ledger, m GROUP BY ALL"
)


@query("quality_ablation", ABLATION_SQL)
def _(spark, folder):
    return quality.ablate(quality.ledger(read_parquet(spark, folder, "documents")))


# ---- 7 repeats


@query("op7_run_length_repeats")
def _(spark, folder):
    return repeats.find_repeats(read_parquet(spark, folder, "documents")).drop("spans")


# ---- 8 sharding

SHARDS = 8


def _shard_sql(n: int) -> str:
    scores = ", ".join(
        f"1.0 / -ln((CAST(('0x' || substr(md5('shard:' || id || ':{i}'), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)"
        for i in range(n)
    )
    return f"CAST(list_position(l{n}, list_max(l{n})) - 1 AS INTEGER)", f"[{scores}] AS l{n}"


# ``text_crc32`` has no SQL in DuckDB, so it and the order inside a shard are tested by brute force.
@query("op8_rendezvous_shards")
def _(spark, folder):
    docs = read_parquet(spark, folder, "documents")
    return sharding.assign_shards(docs, [1.0] * SHARDS)


(_EIGHT, _LIST8), (_NINE, _LIST9) = _shard_sql(SHARDS), _shard_sql(SHARDS + 1)


@query(
    "shard_assignment",
    f"""WITH d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS id,
        CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size FROM documents),
    s AS (SELECT doc_id, size, {_LIST8}, {_LIST9} FROM d)
    SELECT doc_id, size, 'key' AS law, {_EIGHT} AS shard, {_NINE} AS grown_shard FROM s""",
)
def _(spark, folder):
    docs = read_parquet(spark, folder, "documents")
    return sharding.assign_shards(docs, [1.0] * SHARDS).drop("slot", "text_crc32")


# ---- 9 license scan


@query("op9_license_scan")
def _(spark, folder):
    found = licenses.scan_licenses(read_parquet(spark, folder, "documents"))
    exact = F.expr("filter(found, x -> x.missing + x.added = 0)")
    return found.select(
        "doc_id",
        "n_blocks",
        F.size("found").cast("bigint").alias("n_confirmed"),
        F.size(exact).cast("bigint").alias("n_exact"),
        F.concat_ws(",", "licenses").alias("licenses"),
    )


# ---- 10 language-model score


@query("op10_cross_entropy_difference")
def _(spark, folder):
    return lm_score.cross_entropy_difference(
        read_parquet(spark, folder, "documents"), read_parquet(spark, folder, "labels")
    )


# ---- 11 spelling variants


@query("op11_spelling_variants")
def _(spark, folder):
    return spelling.spelling_variants(read_parquet(spark, folder, "documents"), drop_every=31)


# ---- 12 token ids in files


@query("op12_token_files")
def _(spark, folder):
    import public_tokenizers

    return token_files.token_round_trip(read_parquet(spark, folder, "documents"), public_tokenizers.path(token_files.TOKENIZER))


# ---- 13 centroid clustering


def _clusters_sql(k: int = centroids.CENTROIDS, rounds: int = centroids.ROUNDS) -> str:
    usable = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64"
    parts = [
        f"""v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE {usable})""",
        f"""c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v FROM
            (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM v ORDER BY h, v LIMIT {k}))""",
    ]
    gap = "list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - {c}.v[i]) * (v.v[i] - {c}.v[i])))"
    for r in range(rounds + 1):
        d = gap.format(c=f"c{r}")
        parts.append(
            f"""a{r} AS (SELECT vec_id, v, c, d FROM (SELECT v.vec_id, v.v, c{r}.c, CAST({d} AS BIGINT) AS d,
            row_number() OVER (PARTITION BY v.rowid ORDER BY {d}, c{r}.c) AS place
            FROM (SELECT *, row_number() OVER () AS rowid FROM v) v, c{r}) WHERE place = 1)"""
        )
        if r < rounds:
            parts.append(
                f"""m{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
                SELECT c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY c, i)
                GROUP BY c)"""
            )
            parts.append(f"c{r + 1} AS (SELECT c{r}.c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))")
    last = f"c{rounds}"
    return f"""WITH {", ".join(parts)}
    SELECT vec_id, a{rounds}.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.c) AS BIGINT) AS cluster_inertia,
        CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string({last}.v, ',')) AS centroid_sha256
    FROM a{rounds} JOIN {last} ON a{rounds}.c = {last}.c"""


@query("op13_centroids", _clusters_sql())
def _(spark, folder):
    return centroids.cluster_vectors(read_parquet(spark, folder, "embeddings"))
