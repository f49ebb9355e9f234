"""Hashes of windows by doubling, and texts that meet their removed lines without a sort."""

from __future__ import annotations

import numpy as np
import pytest

from foliometer.llm import near_lines
from foliometer.llm.common import STEP, mixed, prepare


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 7, 8, 11])
def test_windows_are_polynomials(size):
    lines = ["ab" * 9, "x" * size, "äöü\U0001f600abcdefgh", "zyxwvutsrqponm"[: size + 3]]
    sums = [
        sum(ord(c) * pow(int(STEP), size - 1 - k, 2**64) for k, c in enumerate(line[i : i + size])) % 2**64
        for line in lines for i in range(len(line) - size + 1)
    ]
    codes = np.array([ord(c) for c in "".join(lines)], np.uint64)
    assert set(sums) <= set(near_lines.polynomials(codes, size).tolist())
    hashes, counts = near_lines.wide_hashes(lines, size)
    assert counts.tolist() == [len(line) - size + 1 for line in lines]
    assert hashes.tolist() == mixed(np.array(sums, np.uint64)).tolist()


def test_texts_are_not_sorted_and_keep_their_bytes(spark, tmp_path):
    prepare(spark)
    copy = "a line of some length, written twice"
    texts = [f"{copy}\nä\r\n\n{copy}", None, "", "\n", f"\U0001f600 alone\n {copy.upper()}\t\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    rows = near_lines.dedup_lines(docs, near_lines.EVERY_LINE)
    found = {row.doc_id: (row.text, row.n_lines, row.n_removed) for row in rows.collect()}
    assert found == {
        0: (f"{copy}\nä\r\n", 4, 1),
        1: (None, 0, 0),
        2: ("", 1, 0),
        3: ("\n", 2, 0),
        4: ("\U0001f600 alone\n", 3, 1),
    }
    assert "ShuffledHashJoin" in rows._jdf.queryExecution().toString()
