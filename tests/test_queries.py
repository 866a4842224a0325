import os

import pytest
from compare import assert_same, connection

from textsieve.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLES:
        assert_same(df, catalog.ORACLES[name], con)
    else:
        df.collect()


@pytest.mark.parametrize("name", ["dedup_lines_refs", "ai_line_filter", "paragraphs", "reorder_context", "template_mine"])
def test_partitions_do_not_matter(spark, name):
    def rows(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return sorted(map(str, catalog.QUERIES[name](spark, SF).collect()))

    try:
        assert rows("1") == rows("8")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_entry_without_the_corpus_package():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(catalog.QUERIES) <= names
    assert os.path.isdir("textsieve/llm") or not any(n.startswith("op") for n in names)
