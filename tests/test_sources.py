"""Readers and sinks: write-read round trips."""

import gzip

import pytest

from tallyframe.operators import encode
from tallyframe.session import cut_lineage, ensure_checkpoint_dir
from tallyframe.sources import readers, schemas, sinks


def test_csv_with_declared_and_further_columns(spark, tmp_path):
    path = tmp_path / "bureau_balance.csv.gz"
    with gzip.open(path, "wt") as f:
        f.write("STATUS,SK_ID_BUREAU,EXTRA_NUM,MONTHS_BALANCE,EXTRA_TEXT\nC,1,5,-1,a\n0,2,,-3,\nNA,3,1.5,,b\n")
    df = readers.read_csv(spark, str(path), "monthly_status")
    assert dict(df.dtypes) == {
        "STATUS": "string",
        "SK_ID_BUREAU": "bigint",
        "EXTRA_NUM": "string",
        "MONTHS_BALANCE": "int",
        "EXTRA_TEXT": "string",
    }
    got = [tuple(r) for r in df.orderBy("SK_ID_BUREAU").collect()]
    assert got[0] == ("C", 1, "5", -1, "a")
    inferred = readers.read_csv(spark, str(path), "monthly_status", infer=True)
    assert dict(inferred.dtypes)["EXTRA_NUM"] == "double"
    assert [r.EXTRA_NUM for r in inferred.orderBy("SK_ID_BUREAU").collect()] == [5.0, None, 1.5]
    assert got[1][2] is None
    assert got[2][0] is None and got[2][3] is None


def test_csv_loses_nothing(spark, tmp_path):
    """Text after many numbers, numbers after many gaps, large ids, fractions of days, several files."""
    folder = tmp_path / "loans"
    folder.mkdir()
    big = 2**53
    lines = [(i, big + i, i if i < 1400 else f"t{i}", "" if i < 1400 else i / 2, "-153.0") for i in range(1500)]
    for k in range(3):
        body = "\n".join(",".join(map(str, x)) for x in lines[k::3])
        (folder / f"part{k}.csv").write_text("SK_ID_CURR,BIG,LATE_TEXT,LATE_NUMBER,DAYS_CREDIT_ENDDATE\n" + body + "\n")
    for infer in (False, True):
        df = readers.read_csv(spark, str(folder), "external_loans", infer=infer)
        rows = {r.SK_ID_CURR: r for r in df.collect()}
        assert len({r.BIG for r in rows.values()}) == 1500
        assert all(str(r.LATE_TEXT) == str(lines[i][2]) for i, r in rows.items())
        assert sum(r.LATE_NUMBER is None for r in rows.values()) == 1400
        assert float(rows[1499].LATE_NUMBER) == 749.5
        assert {r.DAYS_CREDIT_ENDDATE for r in rows.values()} == {-153.0}
    assert dict(df.dtypes)["BIG"] == "bigint"


def test_csv_misfits_are_errors_or_counted(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("SK_ID_BUREAU,MONTHS_BALANCE,STATUS\n1,-1,C\n2,-1.5,C\n3,x,C\n4,-2,0\n")
    with pytest.raises(Exception):
        readers.read_csv(spark, str(path), "monthly_status").collect()
    df = readers.read_csv(spark, str(path), "monthly_status", misfits="bad")
    assert readers.count_misfits(df, "bad") == 2
    assert {r.bad for r in df.collect()} == {None, "2,-1.5,C", "3,x,C"}


def test_csv_headers_must_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text("SK_ID_BUREAU,MONTHS_BALANCE,STATUS\n1,-1,C\n")
    (tmp_path / "b.csv").write_text("SK_ID_BUREAU,STATUS,MONTHS_BALANCE\n1,C,-1\n")
    with pytest.raises(Exception):
        readers.read_csv(spark, str(tmp_path), "monthly_status").collect()


def test_schemas_cover_the_recipes():
    assert set(schemas.SUBJECT_CATEGORIES) <= set(schemas.TABLES["subject_train"].names)
    assert "TARGET" not in schemas.TABLES["subject_test"].names
    assert set(schemas.CARD_MEASURES) <= set(schemas.TABLES["card_snapshots"].names)
    assert len(schemas.CARD_MEASURES) == 18


def test_dictionary(spark, tmp_path):
    path = tmp_path / "dict.csv"
    path.write_text('Table,Row,Description\nbureau.csv,A,"one, two"\nPOS.csv,A,three\nPOS.csv,B,"say ""x"""\n')
    d = readers.read_dictionary(spark, str(path))
    assert [r[0] for r in readers.dictionary_lookup(d, "bureau", "A").collect()] == ["one, two"]
    assert readers.dictionary_lookup(d, "^POS").count() == 2
    assert [r[0] for r in readers.dictionary_lookup(d, row="B").collect()] == ['say "x"']


def test_scores_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.25), (2, 0.75)], "SK_ID_CURR int, TARGET double")
    path = sinks.write_scores(df, str(tmp_path), 0.78914159)
    assert path.endswith("scores_0.7891.csv")
    back = spark.read.csv(path, header=True, inferSchema=True)
    assert sorted(map(tuple, back.collect())) == [(1, 0.25), (2, 0.75)]


def test_profile_sink_has_a_folder_per_variable(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "variable string, value double")
    sinks.write_profiles(df, str(tmp_path / "EDA"))
    assert sorted(p.name for p in (tmp_path / "EDA").glob("variable=*")) == ["variable=a", "variable=b"]
    assert spark.read.parquet(str(tmp_path / "EDA")).count() == 3


def test_feature_sink_and_lineage_cut(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "id * 2 AS x")
    assert sinks.write_features(df, str(tmp_path / "wide")).count() == 10
    cut = cut_lineage(df)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, df.collect()))
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    assert f"{folder}/tallyframe-" in cut.inputFiles()[0]


def test_level_spec_can_be_stored(spark, tmp_path):
    spec = encode.resolve_levels(spark.createDataFrame([("a",), (None,)], "c string"), ["c"])
    (tmp_path / "spec.json").write_text(spec.to_json())
    assert encode.LevelSpec.from_json((tmp_path / "spec.json").read_text()) == spec
