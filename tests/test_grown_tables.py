"""Queries over tables of their own: longer keys, repeated rows and odd texts than the given ones have."""

import os

import pytest

import __spark_entry__
from tests.compare import TABLES, oracle_rows, spark_rows


@pytest.fixture
def tables(spark, sf_dir, tmp_path):
    """A folder of the given tables, one of which is another frame."""

    def make(**others):
        for t in TABLES:
            if t not in others:
                os.symlink(f"{sf_dir}/{t}.parquet", tmp_path / f"{t}.parquet")
        for t, df in others.items():
            df.toPandas().to_parquet(tmp_path / f"{t}.parquet")
        return str(tmp_path)

    return make


def same(spark, folder, name):
    got, expected = spark_rows(__spark_entry__.queries()[name](spark, folder)), oracle_rows(__spark_entry__.oracle_sql()[name], folder)
    assert got == expected and got[1]


def test_overlay_changes_of_repeated_and_null_rows(spark, sf_dir, tables):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").limit(40)
    nulls = customer.selectExpr("c_custkey + 100 AS c_custkey", "c_name", "c_nationkey", "c_acctbal", "CAST(NULL AS STRING) AS c_mktsegment")
    folder = tables(customer=customer.union(customer).union(nulls))
    same(spark, folder, "overlay_diff")
    plan = __spark_entry__.queries()["overlay_diff"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # customers of one nation and segment don't meet each other


def test_numbers_of_more_than_six_digits(spark, sf_dir, tables):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").limit(30)
    more = [part.withColumn("p_partkey", part["p_partkey"] + n) for n in (999_990, 123_456_789)]
    same(spark, tables(part=part.union(more[0]).union(more[1])), "numbered_lexicon")


def test_titles_with_references(spark, tables):
    titles = ["a &amp; b", "cut at &amp", "token = &quot;5aa2&quot;", "&lt;&amp;lt;", "", "&#65;&eacute &nosuch;"]
    rows = [(i, f"u{i}", f'<!DOCTYPE html>\n<html lang="de"><head>\n<meta charset="utf-8"><title>{t}</title></head><body><a href="/x">&amp;</a></body></html>') for i, t in enumerate(titles)]
    rows.append((90, "u", "<p>no title, no language</p>"))
    same(spark, tables(pages=spark.createDataFrame(rows, "page_id bigint, url string, html string")), "html_pages")


@pytest.mark.parametrize("name", ["nested_senses", "parsed_entries", "lexicon_page_blocks"])
def test_entries_of_one_file_are_dealt_over_the_cores(spark, sf_dir, name):
    assert __spark_entry__.queries()[name](spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_long_catalog_lists_go_on_over_pages(spark, sf_dir, monkeypatch):
    from lectern.plans import reader_queries

    monkeypatch.setattr(reader_queries, "_PAGE", 3)
    read = []
    monkeypatch.setattr(reader_queries.E, "catalog_results", lambda files, f=reader_queries.E.catalog_results: read.append(files.count()) or f(files))
    same(spark, sf_dir, "catalog_pages")
    assert read[0] > 25  # more files than nations
