"""The corpus pipeline stage by stage; each is held against its own input."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from foliometer.llm import quality
from foliometer.llm.common import prepare

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, tmp_path):
    docs = prepare(spark).read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    inputs, counts = [docs], []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, inputs[-1], FOLDER)
        assert number == 4 or out.columns == columns
        out.write.parquet(f"{tmp_path}/{number}")
        inputs.append(spark.read.parquet(f"{tmp_path}/{number}"))
        counts.append(Counter(r.doc_id for r in inputs[-1].select("doc_id").collect()))
    start, judged, lines, near, mixed, packed = inputs
    assert set(counts[0]) == {r.doc_id for r in quality.quality(start).filter("kept").collect()}
    before = {r.doc_id: r.text.split("\n") for r in judged.collect()}
    for row in lines.collect():
        left = iter(before[row.doc_id])
        assert all(line in left for line in row.text.split("\n"))
    assert set(counts[2]) <= set(counts[1]) and max(counts[2].values()) == 1
    words = {r.doc_id: len(WORD.findall(r.text)) for r in near.collect()}
    taken = sum(words[doc] * n for doc, n in counts[3].items())
    n_sources = near.select("source").distinct().count()
    assert max(counts[3].values()) <= 2
    assert abs(taken - 1.5 * sum(words.values())) <= n_sources * max(words.values())
    assert Counter(r.doc_id for r in packed.filter("piece = 0").collect()) == counts[3]
    fill = Counter()
    for row in packed.collect():
        fill[row.sequence_id] += row.length
    assert max(fill.values()) <= 2048
