"""Locators by index: the rows of the plain operator, from the splits that the small table names and no others."""

import random
from pathlib import Path

import pytest

from bitweave.operators import locator_index
from bitweave.operators.locator import LocatorError, locate
from bitweave.operators.locator_index import locate_by_index, needed_splits, write_index

ORDER = {"cvs": ("c",), "au": ("c", "a"), "nu": ("c", "a", "n")}
FLAGS = {"vcl": "v", "idr": "i"}
URIS = ["nu1.au0-3.cvs1-2", "au3-9", "au1.cvs0-3", "nu3-.au.cvs-2", "~nu1-2.au-1.cvs2", "~~nu0.~~~cvs2-", "vcl0-1.au2.cvs1-6", "idr.cvs3", "nu5-17", "~vcl0.cvs2", "idr0.au", "cvs4", "~au2-.cvs1-3", "nu", "nu99999"]


@pytest.fixture(scope="module", params=[(1, 7, 5), (2, 1000, 64), (3, 1, 16)])
def indexed(spark, tmp_path_factory, request):
    seed, split_rows, span = request.param
    rnd = random.Random(seed)
    rows = [(c * 10, a, n, rnd.random() < 0.6, rnd.random() < 0.2) for c in range(rnd.randrange(4, 7)) for a in range(rnd.randrange(1, 6)) for n in range(rnd.randrange(1, 6))]
    rows += rows[3:5] + [(None, 0, 0, True, None), (20, None, 4, None, True)]  # repeated rows, nulls
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "c long, a long, n long, v boolean, i boolean")
    at = str(tmp_path_factory.mktemp("index"))
    write_index(df, "nal", ORDER, at, FLAGS, split_rows, span)
    return df, at, split_rows


@pytest.mark.parametrize("uri", URIS)
def test_same_rows_as_the_plain_operator(spark, indexed, uri):
    df, at, _ = indexed
    known = df.where("c is not null and a is not null")  # the plain operator joins by value, so nulls find nothing there
    if not known.count() == df.count():
        at = f"{at}-known"
        if not Path(at).exists():
            write_index(known, "nal", ORDER, at, FLAGS, indexed[2], 32)
    key = lambda r: (r["c"], r["a"], r["n"], r["v"], r["i"], r["uri"])
    got = locate_by_index(spark, at, uri, "nal")
    assert got.columns == [*df.columns, "uri"]
    assert sorted(map(key, got.collect())) == sorted(map(key, locate(known, uri, "nal", ORDER, FLAGS).collect()))


def test_elements_with_null_names_are_counted(spark, indexed):
    df, at, _ = indexed
    assert locate_by_index(spark, at, "nu", "nal").count() == df.count()
    assert {r["uri"] for r in locate_by_index(spark, at, "cvs0", "nal").where("c is null").collect()} == {"cvs0"}


def test_other_splits_are_not_read(spark, indexed):
    df, at, split_rows = indexed
    uri = "nu1.au0.cvs2"
    want = sorted(map(str, locate_by_index(spark, at, uri, "nal").collect()))
    assert "dynamicpruning" in locate_by_index(spark, at, uri, "nal")._jdf.queryExecution().toString().lower()
    needed = {r["_split"] for r in needed_splits(spark, at, uri, "nal").collect()}
    folders = {int(p.name.partition("=")[2]): p for p in Path(at, "elements").glob("_split=*")}
    assert needed <= set(folders) and (split_rows > 100 or len(needed) < len(folders))
    kept = {}
    for split, folder in folders.items():
        if split not in needed:
            for file in folder.glob("*.parquet"):
                kept[file] = file.read_bytes()
                file.write_bytes(b"not a table")
                file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    try:
        assert sorted(map(str, locate_by_index(spark, at, uri, "nal").collect())) == want  # the other files can't even be opened
    finally:
        for file, data in kept.items():
            file.write_bytes(data)


def test_levels_and_orders_that_an_index_lacks(spark, indexed, tmp_path):
    df, at, _ = indexed
    with pytest.raises(LocatorError):
        locate_by_index(spark, at, "seimsg0.nu1", "nal")
    with pytest.raises(LocatorError):
        needed_splits(spark, at, "sps0", "nal")
    with pytest.raises(ValueError):
        write_index(df, "nal", {"cvs": ("c",), "au": ("a",)}, str(tmp_path / "x"))


def test_an_empty_stream(spark, tmp_path):
    empty = spark.createDataFrame([], "c long, a long, n long, v boolean, i boolean")
    write_index(empty, "nal", ORDER, str(tmp_path), FLAGS)
    assert needed_splits(spark, str(tmp_path), "nu0", "nal").count() == 0
    assert locate_by_index(spark, str(tmp_path), "nu0.au", "nal").count() == 0


def test_folders_are_bounded(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(locator_index, "FOLDERS", 3)
    rows = spark.createDataFrame([(c, a, k) for c in range(6) for a in range(3) for k in range(4)], "c long, a long, k long")
    at, order = str(tmp_path / "index"), {"cvs": ("c",), "au": ("c", "a"), "nu": ("c", "a", "k")}
    write_index(rows, "nal", order, at, None, 5)
    assert len([x for x in os.listdir(f"{at}/elements") if x.startswith("_part=")]) == 3 and spark.read.parquet(f"{at}/splits").count() == 15
    got = locate_by_index(spark, at, "nu1.au2.cvs3-4", "nal").collect()
    assert sorted((x.c, x.a, x.k) for x in got) == [(3, 2, 1), (4, 2, 1)]
