"""All numbered queries, and the pipeline of the repository's top."""

import corpus_pipeline
from rollcall.llm import queries  # noqa: F401
from rollcall.llm.registry import ORACLES, QUERIES, query


@query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    """Documents cleaned stage by stage and packed."""
    return corpus_pipeline.run(spark, sf_dir)
