from glintloom.llm import near_duplicates


def test_near_dedup_stage_takes_candidates_by_simhash(spark, monkeypatch):
    import corpus_pipeline

    seen, variants = [], near_duplicates.variants
    monkeypatch.setattr(near_duplicates, "variants", lambda nodes: seen.append(sorted(r.sig for r in nodes.collect())) or variants(nodes))
    words = ["w%d" % k for k in range(400)]
    texts = [" ".join(words), " ".join([*words[:-1], "x"]), "another text altogether, of seven words", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2, 3]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    assert seen == [sorted(signed(near_duplicates.simhash(t)) for t in texts)]
