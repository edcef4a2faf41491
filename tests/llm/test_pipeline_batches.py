"""Every stage of the pipeline sends few whole texts at once to Python."""

import contextlib

import corpus_pipeline

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_stages_bound_the_batches_of_texts(spark):
    before = spark.conf.get(KEY)
    try:
        for _, stage in corpus_pipeline.STAGES:
            for rows, want in ((10_000, corpus_pipeline.TEXTS), (-1, corpus_pipeline.TEXTS), (100, 100)):
                spark.conf.set(KEY, rows)
                with contextlib.suppress(Exception):  # there are no documents
                    stage(spark, None, "")
                assert int(spark.conf.get(KEY)) == want
    finally:
        spark.conf.set(KEY, before)
