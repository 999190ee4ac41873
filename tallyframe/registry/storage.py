"""Sources and sinks: tables derived from the given ones, written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyframe.registry.bindings import with_bound
from tallyframe.registry.core import query
from tallyframe.session import ensure_checkpoint_dir
from tallyframe.sources import readers, sinks, zipped
from tallyframe.sources.schemas import TABLES

def _folder(t, name: str) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def _in_file_order(df, table: str):
    """Declared columns first, as the declared schema has them, so that files have one header."""
    return df.select(*[c for c in TABLES[table].names if c in df.columns])


def _declared_sql(name: str, table: str, bound) -> str:
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}
    types = {f.name: kinds[f.dataType.simpleString()] for f in TABLES[table]}
    return with_bound(name, then="SELECT " + ", ".join(f"CAST({c} AS {types[c]}) AS {c}" for c in bound if c in types) + f" FROM {name}")


def _register() -> None:
    from tallyframe.registry import bindings

    for name, table, source in (
        ("zip_source", "monthly_status", bindings.MONTHLY_STATUS),
        ("zip_source_stored", "pos_snapshots", bindings.POS_SNAPSHOTS),
    ):

        def zip_query(t, name=name, table=table):
            folder = _folder(t, name)
            stored = name.endswith("stored")
            zipped.write_zipped_csv(_in_file_order(t.bound(table), table), folder, compress=not stored).count()
            return zipped.read_zipped_csv(t.spark, folder, table, splitBytes=100_000)

        query(name, _declared_sql(table, table, source))(zip_query)

    def csv_query(t):
        folder = _folder(t, "csv")
        _in_file_order(t.bound("external_loans"), "external_loans").write.csv(folder, header=True, nullValue="NA")
        return readers.read_csv(t.spark, folder, "external_loans")

    query("csv_source", _declared_sql("external_loans", "external_loans", bindings.EXTERNAL_LOANS))(csv_query)


_register()


@query(
    "dictionary_source",
    "SELECT p_brand AS \"Table\", 'COL_' || p_partkey AS \"Row\", p_name || ', \"' || p_type || '\"' || chr(10) || 'size ' || p_size"
    ' AS "Description" FROM part',
)
def _(t):
    """A data dictionary whose descriptions hold delimiters, quotes and line breaks."""
    folder = _folder(t, "dictionary")
    t.part.select(
        F.col("p_brand").alias("Table"),
        F.concat(F.lit("COL_"), F.col("p_partkey")).alias("Row"),
        F.concat("p_name", F.lit(', "'), "p_type", F.lit('"\nsize '), "p_size").alias("Description"),
    ).write.csv(folder, header=True, escape='"', quoteAll=True)
    return readers.read_dictionary(t.spark, folder)


@query(
    "score_sink",
    "SELECT doc_id AS SK_ID_CURR, CAST(n_chars AS DOUBLE) / (n_chars + 2000) AS TARGET FROM documents",
)
def _(t):
    scores = t.documents.selectExpr("doc_id AS SK_ID_CURR", "CAST(n_chars AS DOUBLE) / (n_chars + 2000) AS TARGET")
    path = sinks.write_scores(scores, _folder(t, "scores"), 0.78912)
    return t.spark.read.schema("SK_ID_CURR bigint, TARGET double").csv(path, header=True, enforceSchema=False)


@query(
    "profile_sink",
    "SELECT variable_name AS variable, level, n FROM (SELECT 'returnflag' AS variable_name, l_returnflag AS level, COUNT(*) AS n"
    " FROM lineitem GROUP BY 2 UNION ALL SELECT 'linestatus', l_linestatus, COUNT(*) FROM lineitem GROUP BY 2)",
)
def _(t):
    """Profiles written into a folder per variable."""
    of = lambda c, v: t.lineitem.groupBy(F.col(c).alias("level")).agg(F.count(F.lit(1)).alias("n")).withColumn("variable", F.lit(v))
    folder = _folder(t, "profiles")
    sinks.write_profiles(of("l_returnflag", "returnflag").unionByName(of("l_linestatus", "linestatus")), folder)
    return t.spark.read.parquet(folder).select("variable", "level", "n")
