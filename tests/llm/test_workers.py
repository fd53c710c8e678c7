"""Python workers of the pipeline keep no memory that a batch took."""

import pyarrow as pa

import corpus_pipeline
from phenospark.llm import common


def test_stages_start_lean_workers(spark):
    env, before = spark.sparkContext.environment, dict(spark.sparkContext.environment)
    try:
        for _, stage in corpus_pipeline.STAGES:
            assert stage.__wrapped__.__name__ == stage.__name__
        env["MALLOC_ARENA_MAX"] = "3"  # the session's own
        common.lean_workers(spark)

        def run(batches):
            import os

            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([",".join(f"{k}={os.environ.get(k)}" for k in sorted(common.WORKER_ENV))] * b.num_rows), pa.array([pa.default_memory_pool().backend_name] * b.num_rows)], ["env", "pool"])

        got = spark.range(1).mapInArrow(run, "env string, pool string").first()
        assert got.pool == "system" and "MALLOC_ARENA_MAX=3" in got.env and "MALLOC_MMAP_THRESHOLD_=1048576" in got.env
    finally:
        env.clear()
        env.update(before)
