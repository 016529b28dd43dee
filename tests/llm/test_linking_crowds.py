import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from glintloom.llm import common, linking, near_duplicates


def test_finer_keys_are_made_only_where_pairs_are_left_to_test(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base, seen = int(rng.integers(1 << 62)), set()
    while len(seen) < 300:  # near copies of one text, and strangers
        seen.add(base ^ sum(1 << int(b) for b in rng.choice(62, 2, replace=False)))
    sigs = [*seen, *rng.integers(0, 1 << 62, 50).tolist()]
    nodes = spark.createDataFrame([(k, s) for k, s in enumerate(sigs)], "id long, sig long")
    cut, made = [], []

    def refine(key, sig):
        cut.append(1)
        return near_duplicates.finer_keys(key, sig)

    real = linking.materialise
    monkeypatch.setattr(linking, "materialise", lambda df: made.append(out := real(df)) or out)
    found = linking.bucket_components(near_duplicates.variants(nodes), linking.within(4), refine=refine).collect()
    assert {r.node: r.component for r in found} == {k: 0 for k in range(300)}
    # the buckets of the group lie in one component: no finer key, and no pair, is made for them
    assert not cut
    odd = [t for t in made if "tests" in t.columns]
    assert odd and all(t.isEmpty() for t in odd)


def test_texts_go_to_python_in_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    before = spark.conf.get(common._BATCH)
    rows = spark.range(5000, numPartitions=1).select(F.col("id").alias("n"))
    assert max(r.n for r in common.materialise(rows.mapInArrow(sizes, "n long")).collect()) <= 1000
    assert spark.conf.get(common._BATCH) == before
