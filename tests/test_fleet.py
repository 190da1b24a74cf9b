"""The fleet operators: every query with SQL against DuckDB at sf0.001, and parsers on small texts."""

import os

import duckdb
import pytest

from fleetweave.functions.values import glob_regex
from fleetweave.plans import catalogue
from fleetweave.sources import readers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    spell = lambda v: "NULL" if v is None else repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(columns), sorted(tuple(spell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_duckdb(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert _rows(df.columns, df.collect()) == _rows(columns, want.fetchall())


def test_jaccard_of_whole_parts(spark):
    got = catalogue.QUERIES["jaccard_part_pairs"](spark, "/root/testdata/sf0.01").collect()
    assert len({r.jaccard for r in got}) > 1 and all(r.jaccard < 1 for r in got)


def test_globs():
    import re

    for glob, path, same in (("a.*.c", "a.b.c", True), ("a.*.c", "a.b.b.c", False), ("a.**", "a", True), ("a.**", "a.b.c", True), ("**.c", "c", True), ("**.c", "a.b.c", True), ("a.**", "ab", False)):
        assert bool(re.search(glob_regex(glob), path)) is same, (glob, path)


def test_parsers():
    assert readers.xml_pairs("<a x='1'><b>2</b><b>3</b></a>") == [("a.@x", "1"), ("a.b[0]", "2"), ("a.b[1]", "3")]
    assert readers.xml_pairs("<a") == readers.xml_pairs("<!DOCTYPE a><a/>") == []
    assert readers.config_pairs("a b\n c\n no d e\nend\nf") == [("a", "b"), ("a.b.c", "true"), ("a.b.d", "false")]
