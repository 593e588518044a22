"""Rows keep their names when the table is read with other splits halfway through an operator."""

import os
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from parcelspark.llm import mixing, neardup, packing, substrings
from parcelspark.llm.common import with_row_names

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@contextmanager
def split_size(spark, size):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, size)
    try:
        yield
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.read.parquet(f"{SF_DIR}/documents.parquet").repartition(7, "doc_id").write.parquet(folder)
    return spark.read.parquet(folder)


def test_names_stay_with_their_rows(spark, docs):
    named = with_row_names(docs, "row_id")
    seen = []
    for size in ("1k", "200k", "128m"):
        with split_size(spark, size):
            seen.append({r["row_id"]: r["doc_id"] for r in named.select("row_id", "doc_id").collect()})
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == docs.count()
    # Derived columns and filters change nothing, and any other frame is written first.
    part = with_row_names(docs.where("doc_id % 3 = 0").withColumn("row_id", F.lit("x")), "name").collect()
    assert part and all(seen[0][r["name"]] == r["doc_id"] and r["row_id"] == "x" for r in part)
    other = with_row_names(spark.range(50).repartition(4), "name")
    assert sorted(other.collect()) == sorted(other.collect()) and other.select("name").distinct().count() == 50


@pytest.mark.parametrize(
    "operator",
    [
        lambda docs: neardup.classes(docs).select("doc_id", "class_id", "class_size"),
        lambda docs: neardup.without_near_duplicates(docs).select("doc_id", "text"),
        lambda docs: substrings.keep_first(docs).select("doc_id", "n_removed", F.xxhash64("kept")),
        lambda docs: mixing.mixed_documents(docs, block_words=500).select("doc_id", "text"),
        lambda docs: packing.packed_texts(docs, capacity=300).drop("row_id", "bin_id", "position", "bin_words"),
    ],
)
def test_other_splits_between_scans(spark, docs, operator):
    expected = sorted(map(repr, operator(docs).collect()))
    with split_size(spark, "1k"):
        begun = operator(docs)
    with split_size(spark, "128m"):
        assert sorted(map(repr, begun.collect())) == expected
    begun = operator(docs)
    with split_size(spark, "1k"):
        assert sorted(map(repr, begun.collect())) == expected


def test_texts_are_exchanged_alike(spark, tmp_path):
    """No filter on row names stands below one of the joins only, so both share the exchange of the texts."""
    from parcelspark.llm import substrings

    spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    kept = substrings.keep_first(spark.read.parquet(str(tmp_path / "docs")))
    assert "isnotnull((shiftleft" not in kept._jdf.queryExecution().optimizedPlan().toString()
