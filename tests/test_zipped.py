"""Zipped delimited tables: round trips, byte ranges, damage."""

import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.sources import zipped


def make(path, how=zipfile.ZIP_DEFLATED, **texts):
    with zipfile.ZipFile(path, "w", how) as z:
        for name, text in texts.items():
            z.writestr(f"inner/{name}.csv", text)
    return str(path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def table(spark):
    text = lambda i: None if i % 3 == 0 else "" if i % 5 == 0 else f't,{i}"q NA'
    data = [(i, "NA" if i == 7 else text(i), i / 7 if i % 4 else None) for i in range(500)]
    return spark.createDataFrame(data, "id bigint, t string, x double")


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(spark, table, tmp_path, compress):
    files = zipped.write_zipped_csv(table.repartition(3), str(tmp_path), compress=compress)
    assert files.agg({"n_rows": "sum"}).first()[0] == 500
    back = zipped.read_zipped_csv(spark, str(tmp_path), schema=table.schema, splitBytes=300)
    assert back.rdd.getNumPartitions() == 3 if compress else back.rdd.getNumPartitions() > 20
    assert rows(back) == rows(table)
    few = zipped.read_zipped_csv(spark, str(tmp_path), schema=table.select("x", "id").schema)
    assert rows(few) == rows(table.select("x", "id"))
    assert zipped.write_zipped_csv(table.filter("id < 0"), str(tmp_path / "none")).count() == 0


def test_declared_types_and_members(spark, tmp_path):
    head = "STATUS,SK_ID_BUREAU,EXTRA,MONTHS_BALANCE\n"
    make(tmp_path / "b.zip", one="﻿" + head + "C,1,5,-1\n0,2,,-3\n", two=head + 'NA,3,"",\n', empty="")
    (tmp_path / "deep").mkdir()
    make(tmp_path / "deep" / "c.zip", three=head)
    df = zipped.read_zipped_csv(spark, str(tmp_path), "monthly_status")
    assert dict(df.dtypes) == {"STATUS": "string", "SK_ID_BUREAU": "bigint", "EXTRA": "string", "MONTHS_BALANCE": "int"}
    assert rows(df) == [("0", 2, None, -3), ("C", 1, "5", -1), (None, 3, "", None)]
    assert rows(zipped.read_zipped_csv(spark, str(tmp_path / "b.zip"), "monthly_status")) == rows(df)


def test_line_breaks_in_fields(spark, tmp_path):
    path = make(tmp_path / "a.zip", zipfile.ZIP_STORED, one='id;t\n1;"a\nb"\n2;c\n')
    df = zipped.read_zipped_csv(spark, path, multiLine="true", delimiter=";", splitBytes=4)
    assert rows(df) == [("1", "a\nb"), ("2", "c")]


def test_damage_and_misfits_fail(spark, tmp_path):
    body = "id,t\n" + "".join(f"{i},text{i}\n" for i in range(2000))
    path = make(tmp_path / "a.zip", one=body)
    data = bytearray(open(path, "rb").read())
    data[200] ^= 0xFF
    open(path, "wb").write(data)
    with pytest.raises(Exception):
        zipped.read_zipped_csv(spark, path).collect()
    stored = make(tmp_path / "s.zip", zipfile.ZIP_STORED, one=body)
    data = bytearray(open(stored, "rb").read())
    data[data.index(b"text100")] ^= 1
    open(stored, "wb").write(data)
    with pytest.raises(Exception, match="CRC"):
        zipped.read_zipped_csv(spark, stored).collect()
    for bad in ("id,t\n1,a\n2\n", "id,t\n1,a\nx,b\n"):
        with pytest.raises(Exception):
            zipped.read_zipped_csv(spark, make(tmp_path / "m.zip", one=bad), schema="id bigint, t string").collect()
    two = make(tmp_path / "h.zip", one="id,t\n1,a\n", two="t,id\na,1\n")
    with pytest.raises(Exception, match="columns"):
        zipped.read_zipped_csv(spark, two).collect()
    with pytest.raises(Exception, match="no column"):
        zipped.read_zipped_csv(spark, two, schema="other string").collect()
    with pytest.raises(Exception, match="no zip archive"):
        (tmp_path / "none").mkdir()
        zipped.read_zipped_csv(spark, str(tmp_path / "none")).collect()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", max_size=9), max_size=12), st.booleans(), st.integers(1, 30))
def test_ranges_own_every_line_once(tmp_path_factory, lines, ends, split):
    body = "\n".join(lines) + ("\n" if ends else "")
    path = tmp_path_factory.mktemp("r") / "a.zip"
    make(path, zipfile.ZIP_STORED, one=body)
    got = b""
    for m in zipped.members(str(path), split):
        with zipped._open(str(path)) as file:
            if m.begin < 0:
                assert len(body) <= split
                got = body.encode()
            else:
                own = zipped._Range(file, m.begin, m.size, m.start, m.stop)
                got += b"".join(iter(lambda: own.read(7), b""))
    assert got == body.encode()
