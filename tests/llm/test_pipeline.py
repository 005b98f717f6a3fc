"""The pipeline's stages, one by one and together."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from rollcall.llm.decontaminate import find_leaks
from rollcall.llm.repetition import repetition
from rollcall.llm.simhash import near_groups
from rollcall.llm.toxicity import toxicity
from test_tokens import check_pack

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, docs):
    """The documents after each stage, the first as they are."""
    out = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_keep_columns_and_rows(tables, docs):
    for before, after in zip(tables, tables[1:]):
        assert after.columns == docs.columns and ids(after) <= ids(before)
        assert after.join(before, after.columns, "left_anti").count() == 0


def test_stages_agree_with_their_operators(spark, tables, table):
    a, b, c, d, e = tables
    assert ids(b) == ids(toxicity(a, table("labels")).filter("predicted = 0"))
    assert ids(c) == ids(repetition(b).filter("kept"))
    groups = near_groups(c)
    assert ids(d) == ids(groups.filter("doc_id = component_id"))
    assert ids(e) == ids(d) - ids(find_leaks(d, table("benchmark")))


def test_run_packs_what_is_left(spark, tables):
    check_pack(corpus_pipeline.run(spark, SF), tables[-1].select("doc_id", "text").collect())


def test_stages_take_odd_rows(spark, odd, none):
    for df, rows in ((odd, None), (none, 0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            n = out.count()
            assert rows is None or n == rows
            if "text" in out.columns:
                assert out.columns == df.columns
    names = ["_toxicity", "_rule_kept", "_near_version", "_kept_id", "_leaked"]
    clash = odd.select("*", *[F.lit(n).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clash, SF)
        assert out.columns == clash.columns and all(r[n] == n for r in out.select(*names).collect() for n in names)
