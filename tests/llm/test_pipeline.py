"""Each stage of the pipeline against a brute-force version, on its own input."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as pipeline  # noqa: E402
from opsloom.llm.neighbours import quality_scores  # noqa: E402
from opsloom.llm.suite import oracle_sql, queries  # noqa: E402
from opsloom.session import cut_lineage  # noqa: E402

from brute_windows import best_windows  # noqa: E402
from test_text_dedup import brute_jaccard, brute_windows  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    of = dict(pipeline.STAGES)
    assert len(of) == 5

    good = cut_lineage(of["quality classifier"](spark, docs, SF))
    assert good.columns == docs.columns
    want = {r.doc_id for r in quality_scores(docs, labels).filter("predicted = 1").collect()}
    assert {r.doc_id for r in good.collect()} == want

    single = cut_lineage(of["n-gram Jaccard join"](spark, good, SF))
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert {r.doc_id for r in single.collect()} == {d for d, (_, c) in brute_jaccard(rows, 5, 80).items() if c == d}
    assert single.columns == docs.columns

    passages = cut_lineage(of["substring dedup"](spark, single, SF))
    rows = {r.doc_id: r.text for r in single.collect()}
    found = {d: (n, gone, text) for d, (n, gone, text) in brute_windows(list(rows.items()), 50).items() if gone < n or not n}
    got = {r.doc_id: r for r in passages.collect()}
    assert passages.columns == docs.columns and set(got) == set(found)
    assert all(got[d].text == (text if gone else rows[d]) and got[d].n_chars == len(got[d].text or "") for d, (_, gone, text) in found.items())

    clean = cut_lineage(of["benchmark decontamination"](spark, passages, SF))
    kept = {r.doc_id for r in clean.collect()}
    found = best_windows([(d, r.text) for d, r in got.items()], [(r.item_id, r.text) for r in benchmark.collect()])
    gone = {d for (d, _), similarity in found.items() if similarity >= 0.8}
    assert gone and kept == set(got) - gone

    tokens = of["BPE encoding and decoding"](spark, clean, SF).collect()
    assert {r.doc_id for r in tokens} == kept
    assert {r.doc_id for r in pipeline.run(spark, SF).select("doc_id").collect()} == kept


def test_stages_take_odd_rows(spark, frame, odd_rows):
    docs = frame(odd_rows)
    for name, stage in pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            found = stage(spark, given, SF)
            rows = found.collect()
            assert name == pipeline.STAGES[-1][0] or found.columns == docs.columns
            assert bool(rows) == (given is docs)
    ids = lambda df: {r.doc_id for r in df.collect()}
    kept = ids(pipeline.near_duplicates(spark, docs, SF))
    assert {None, 1, 2, 3, 4, 8}.issubset(kept) and 5 not in kept
    kept = ids(pipeline.repeated_passages(spark, docs, SF))
    assert {None, 1, 2, 3, 8}.issubset(kept) and pipeline.decontamination(spark, docs, SF).count() == len(odd_rows)


def test_registered_queries():
    numbers = [int(name[2:].split("_")[0]) for name in queries()]
    assert sorted(numbers) == list(range(1, 14)) and set(oracle_sql()) <= set(queries())
