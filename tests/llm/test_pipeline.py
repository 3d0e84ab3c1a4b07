"""The pipeline against its operators' brute-force versions, stage by stage."""

from collections import Counter

import corpus_pipeline
from tarnfield.llm import quality_rules
from tests.llm.test_operators import WORDS, brute_components, brute_fingerprint, brute_pii, brute_stats, library_ids, lower


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    given = {r.doc_id: r.text for r in docs.collect()}
    good = corpus_pipeline.quality(spark, docs, sf)
    assert good.columns == columns
    kept = {r.doc_id: r.text for r in good.collect()}
    verdict = {r.doc_id: r.kept for r in quality_rules.judge(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert set(kept) == {d for d, t in given.items() if verdict[d]} and all(brute_stats(t)[0] >= 10 for t in kept.values())

    single = corpus_pipeline.near_dedup(spark, good, sf)
    ids = list(kept)
    groups = brute_components([brute_fingerprint(kept[d]) for d in ids], ids)
    left = {r.doc_id: r.text for r in single.collect()}
    assert single.columns == columns and set(left) == set(groups)

    clean = corpus_pipeline.decontamination(spark, single, sf)
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = WORDS.findall(lower(r.text))
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    want = {d for d, t in left.items() if not any(tuple(w[i : i + 10]) in windows for w in [WORDS.findall(lower(t))] for i in range(len(w)))}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == want

    masked = corpus_pipeline.personal_data(spark, clean, sf)
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert masked.columns == columns and set(texts) == want and not any(brute_pii(t) for t in texts.values())
    assert all(texts[d] == left[d] for d in want if not brute_pii(left[d]))

    packed = corpus_pipeline.pack(spark, masked, sf).collect()
    sums = Counter()
    for r in packed:
        sums[r.doc_id] += r.length
    assert sums == Counter({d: len(library_ids(t)) for d, t in texts.items()})
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == Counter(r.doc_id for r in packed)
