"""The corpus pipeline against a brute-force version, and its stages on odd and empty tables."""

from collections import Counter
from math import log

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from aerolith.llm import mixing, piece_sampling, toxicity
from aerolith.llm.queries import table, tokenizer_file
from tests.llm.test_documents import SCHEMA, brute_components, odd_rows

DATA = "/root/testdata/sf0.001"


def brute_pipeline(spark, rows):
    """Pairs (doc_id, text) that the last stage gets, each as often as it is taken."""
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    model = toxicity.fit(docs, labels)
    clean = []
    for d, t, s in rows:
        held = toxicity.features(t)
        if sum(w * (1 + log(held[f])) for f, w in model.weights.items() if held[f]) < model.cuts[0]:
            clean.append((d, t, s))
    largest = {}
    for d, t, _ in clean:
        largest[t] = max(d, largest.get(t, d))
    kept = [r for r in clean if largest[r[1]] == r[0]]
    heads = {d for d, _, c in brute_components(kept, 5, 80) if c == d}
    kept = [r for r in kept if r[0] in heads]
    with duckdb.connect() as con:
        documents = pd.DataFrame(kept, columns=["doc_id", "text", "source"])  # noqa: F841
        copies = {d: n for d, n in con.execute(f"SELECT doc_id, copies FROM ({mixing.SQL})").fetchall()}
    return Counter({(d, t): copies[d] for d, t, _ in kept if copies[d]})


def test_pipeline_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"] or "", r["source"]) for r in table(spark, DATA, "documents").collect()]
    wanted = brute_pipeline(spark, rows)
    assert 0 < len(wanted) < len(rows)
    path = tokenizer_file("piece_bpe_32k.model")
    out = corpus_pipeline.run(spark, DATA).collect()
    text = dict((d, t) for d, t, _ in rows)
    for r in out:
        assert piece_sampling.decode(np.array(r["piece_ids"], dtype=np.int64), path) == text[r["doc_id"]] if text[r["doc_id"]] else not r["piece_ids"]
    assert Counter((r["doc_id"], text[r["doc_id"]]) for r in out) == wanted


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_and_empty_tables(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    odd = spark.createDataFrame(odd_rows(), SCHEMA).withColumn("copies", F.lit(1))
    for docs in (odd, odd.union(odd), odd.limit(0)):
        out = stage(spark, docs, DATA)
        rows = out.collect()
        assert k == 4 or out.columns == docs.columns
        assert (len(rows) > 0) == (docs.count() > 0)
        if name == "toxicity":
            assert len(rows) == docs.count()
        if name == "exact dedup":
            assert set(Counter(r["text"] or "" for r in rows).values()) <= {1}


def test_the_join_of_the_pipeline_repeats_no_member(spark):
    from aerolith.llm import ngram_join

    rows = [(1, d, n, 0, 180 * n // 80 - n, d) for d, n in enumerate(range(20, 120))]
    named = spark.createDataFrame(rows, "s long, doc_id long, n int, i int, most int, label long")
    left, small, large = ngram_join.remaining(named, 80)
    assert left.count() == small.count() == large.count() == len(rows)
    wanted = sorted((y[1], x[1]) for y in rows for x in rows if y[1] < x[1] and x[2] <= y[4])
    assert sorted(map(tuple, ngram_join.pairs_of_rest(small, large, 80).collect())) == wanted
