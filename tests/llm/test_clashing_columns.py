"""Stages leave the columns of their input alone, whatever these are called."""

import pytest
from pyspark.sql import functions as F

from courtlens.llm import op2_toxicity as tox
from courtlens.llm import op3_host_rules as rules
from courtlens.llm import op9_simhash as sim
from courtlens.llm import op10_line_dedup as lines
from courtlens.llm.common import read, unused

NAMES = ["__k", "__n", "__cut", "__m", "__places", "__host", "__score", "__fp", "__id", "k", "t", "h", "n", "host", "score",
         "failed_host", "fp", "row_id", "one", "places", "cut", "n_cut", "n_deleted", "base_failed", "fingerprint", "component_id"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return read(spark, sf, "documents").withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in NAMES})


def checked(out, docs, left=()):
    assert out.columns == docs.columns
    for r in out.select("doc_id", *[c for c in NAMES if c not in left]).collect():
        assert all(r[c] == f"{c}{r.doc_id}" for c in NAMES if c not in left)
    return sorted(r.doc_id for r in out.select("doc_id").collect())


def test_unused_names(spark):
    d = spark.createDataFrame([(1, 2, 3)], "fp int, _fp int, Score int")
    assert unused(d, "fp", "fp", "score", "x") == ["__fp", "___fp", "_score", "x"]


def test_stages_keep_all_columns(spark, sf, docs):
    plain, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    assert checked(tox.keep(docs, labels), docs) == ids(tox.keep(plain, labels))
    assert checked(rules.keep(docs), docs) == ids(rules.keep(plain))
    assert checked(sim.keep_one(docs), docs) == ids(sim.keep_one(plain))
    got = lines.dedup_lines(docs, deleted="n_deleted", length="n_chars")
    assert checked(got, docs, ("n_deleted",)) == ids(plain)
    want = lines.dedup_lines(plain, deleted="n_deleted", length="n_chars")
    rows = lambda d: sorted(map(tuple, d.select("doc_id", "text", "n_chars", "n_deleted").collect()))
    assert rows(got) == rows(want) and want.columns == [*plain.columns, "n_deleted"]
