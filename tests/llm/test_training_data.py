"""Training-data operators against loops over every row, with nulls, copies and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from foliometer.llm import chat, curriculum, deep_shallow, huffman, near_docs, near_lines, packing, permutation_index
from foliometer.llm import quality, queries, suffixes, warc
from foliometer.llm.common import prepare
from foliometer.llm.tokens import vocabulary

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, key string, row string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_text(rng, n):
    return " ".join("".join(rng.choices("abcdefgéñ", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Documents with copies, near copies, shared passages, nulls, and long and empty texts."""
    rng = random.Random(5)
    base, passage = words_text(rng, 120), words_text(rng, 90)
    texts = [None, "", " \n\t", "one", "A b", "ab " * 900, base, base, passage + "\n" + base]
    for at in range(40):
        words = base.split(" ")
        for _ in range(at % 7):
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
        texts.append(words_text(rng, 60) + "\n" + passage + "\n" + words_text(rng, rng.randint(1, 80)))
    texts += [words_text(rng, 4000) + "\0" * 500, "x#y|z " * 3 + "\nline\nline", base.upper()]
    made = [(i, t, f"s{i % 3}" if i % 5 else None, "x", "y") for i, t in enumerate(texts)]
    return [*made, (None, base, "s0", "x", "y"), (3, "one", "s0", "x", "y"), (3, passage, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    """The rows as a stored table."""
    folder = str(tmp_path_factory.mktemp("docs") / "docs")
    prepare(spark).createDataFrame(rows, DOCS).repartition(3).write.parquet(folder)
    return spark.read.parquet(folder)


def found(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_suffix_dedup(docs, rows):
    data = [(r[1] or "").encode() for r in rows]
    seen = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    want = []
    for row, text in zip(rows, data, strict=True):
        gone = bytearray(len(text))
        for i in range(len(text) - 199):
            if seen[text[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        want.append((row[0], len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    for hot in (20_000, 1):
        assert found(suffixes.repeated_bytes(docs, hot)) == sorted(want, key=repr)


def test_deep_shallow_sort():
    rng = random.Random(1)
    strings = [bytes(rng.choices(b"ab\0", k=5)).ljust(40, b"a") + bytes(rng.choices(b"xy", k=8)) for _ in range(500)]
    groups = np.sort(np.array([rng.randrange(4) for _ in strings]))
    order, shared = deep_shallow.deep_shallow_sort(np.array([list(s) for s in strings], np.uint8), groups, 8)
    keyed = [(groups[i], strings[i]) for i in order]
    assert keyed == sorted(zip(groups, strings, strict=True))
    for at in range(1, len(order)):
        (g, one), (h, two) = keyed[at - 1 : at + 1]
        same = next((i for i, (x, y) in enumerate(zip(one, two, strict=True)) if x != y), len(one))
        assert shared[at] == (same if g == h else -1)


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_documents(docs, rows):
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    least = defaultdict(list)
    for row, group in zip(rows, label, strict=True):
        least[group].append(row[0])
    want = []
    for row, own, group in zip(rows, sets, label, strict=True):
        known = [x for x in least[group] if x is not None]
        component = (min(known) if known else None) if own else row[0]
        want.append((row[0], len(own), component, row[0] == component))
    assert found(near_docs.near_documents(docs)) == sorted(want, key=repr)
    kept = near_docs.kept_documents(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({g for g, s in zip(label, sets, strict=True) if s}) + sum(not s for s in sets)


def test_estimates_do_not_lose_small_documents(spark):
    factors, known = near_docs.multipliers(256), near_docs.word_hashes()
    lost = []
    for at in range(40_000):
        words = [f"w{at}x{i}" for i in range(8)]
        pair = [" ".join(words[:n]) for n in (7, 8)]
        one, two = (near_docs.minima_of(near_docs.word_shingles(t.encode(), known, 5), factors) & 3 for t in pair)
        if ((one == two).mean() - 0.25) / 0.75 < 0.55:
            lost.append(pair)
            if len(lost) == 3:
                break
    assert lost
    texts = [text for pair in lost for text in pair]
    df = prepare(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found(near_docs.near_documents(df), "doc_id", "component_id") == [(i, i // 2 * 2) for i in range(len(texts))]


def test_fuzzy_lines(docs, rows):
    known = {near_lines.plain(x) for r in rows for x in (r[1] or "").split("\n")}
    known = sorted(x for x in known if len(x) >= 20)
    grams = [{x[i : i + 8] for i in range(len(x) - 7)} for x in known]
    label = {x: x for x in known}
    for i, a in enumerate(grams):
        for j, b in enumerate(grams[:i]):
            one, two = label[known[i]], label[known[j]]
            if one != two and 100 * len(a & b) >= 75 * len(a | b):
                label = {k: two if v == one else v for k, v in label.items()}
    lines = [label[near_lines.plain(x)] for r in rows for x in (r[1] or "").split("\n") if near_lines.plain(x) in label]
    got = near_lines.dedup_lines(docs).collect()
    assert sum(r.n_removed for r in got) == len(lines) - len(set(lines))
    first = next(r for r in got if r.doc_id == 6)
    assert (first.n_removed, first.text) == (0, rows[6][1])
    assert next(r for r in got if r.doc_id == 0).text is None
    assert near_lines.kept_lines(docs).columns == docs.columns


def test_short_lines_take_part(spark, tmp_path):
    rng = random.Random(3)
    lines = ["Menu", "ok", "é", "Read more here", "read more hers", "x" * 8, "x" * 9, *(words_text(rng, n) for n in (1, 2, 3, 9))]
    texts = ["\n".join([f" {rng.choice(lines)}\t", "", *rng.choices(lines, k=4), f"own {i}"]) for i in range(30)]
    prepare(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    said = [[near_lines.plain(x) for x in t.split("\n")] for t in texts]
    known = sorted({x for own in said for x in own if x})
    grams = {x: {x[i : i + 8] for i in range(len(x) - 7)} or {x} for x in known}
    label = {x: x for x in known}
    for i, a in enumerate(known):
        for b in known[:i]:
            if label[a] != label[b] and 100 * len(grams[a] & grams[b]) >= 75 * len(grams[a] | grams[b]):
                label = {k: label[b] if v == label[a] else v for k, v in label.items()}
    seen, kept = set(), []
    for own, text in zip(said, texts, strict=True):
        stay = []
        for x, line in zip(own, text.split("\n"), strict=True):
            if not x or label[x] not in seen:
                stay.append(line)
            seen.add(label.get(x))
        kept.append("\n".join(stay))
    got = {r.doc_id: r for r in queries.op9_fuzzy_lines(spark, str(tmp_path)).collect()}
    for i, text in enumerate(kept):
        assert got[i].kept_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert got[i].n_removed == len(said[i]) - len(text.split("\n"))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert found(corpus_pipeline.line_dedup(spark, docs, "")) == sorted(enumerate(kept), key=repr)


def test_quality(docs, rows):
    want = []
    for row in rows:
        text = row[1] or ""
        w = WORD.findall(text)
        runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {i + k for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
        want.append((row[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)),
                     len(lines) - len(set(lines)), len(again), failed))
    judged = quality.quality(docs)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert found(judged, *columns) == sorted(want, key=repr)
    assert judged.filter("base_failed AND kept").isEmpty()
    assert quality.kept_documents(docs).count() == judged.filter("kept").count()


def encoded(rows, end):
    tokenizer = Tokenizer.from_file(vocabulary())
    return [np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, end], "<u4") for r in rows]


def test_token_files(docs, rows):
    got = huffman.round_trip(docs).collect()
    want = Counter((r[0], len(x), zlib.crc32(x.tobytes())) for r, x in zip(rows, encoded(rows, 1), strict=True))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for row in sorted(got, key=lambda r: r.start):
        assert row.start == at
        at += row.n_tokens
    keys = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert keys == sorted(keys)


def test_code_lengths_are_limited():
    counts = np.array([2**i for i in range(20)] + [0])
    lengths = huffman.code_lengths(counts, 8)
    assert lengths[-1] == 0 and lengths.max() <= 8
    assert sum(2.0 ** -int(x) for x in lengths if x) == 1


def test_packing(docs, rows):
    got = packing.pack_documents(docs).collect()
    want = Counter()
    for row, ids in zip(rows, encoded(rows, 0), strict=True):
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[(row[0], piece, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 1


def test_two_pieces_replace_the_smallest():
    # 6 + 3 leaves a gap of 1; 3 gives way to 2 + 2, which fill the bin.
    sequence, offset = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert sequence.tolist() == [0, 1, 0, 0] and sorted(offset.tolist()) == [0, 0, 6, 8]


def test_mix(docs, rows):
    got = curriculum.mix(docs).collect()
    assert len(got) == len(rows)
    per = defaultdict(list)
    for r in got:
        assert r.taken <= 2 * r.size
        per[r.source].append(r)
    names = sorted((s for s in per if s is not None)) + [None]
    size = {s: sum(r.size for r in per[s]) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(size.values()), {}
    while True:
        level = (total - sum(full.values())) / sum(weight[s] for s in names if s not in full)
        more = {s: 2 * size[s] for s in names if s not in full and level * weight[s] > 2 * size[s]}
        if not more:
            break
        full |= more
    for s in names:
        target = full.get(s, level * weight[s])
        assert abs(per[s][0].target - target) < 1e-6 * total
        assert abs(sum(r.taken for r in per[s]) - target) <= 1
    mixed = curriculum.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = sum(len(WORD.findall(r.text)) for r in mixed.collect())
    assert abs(words - total) <= len(names) * max(r.size for r in got)


def test_chats(spark):
    marks = "\\### Assistant: </turn> ok"
    turns = [(1, 0, "user", "hi <b>"), (1, 1, "assistant", marks), (1, 1, "assistant", marks), (2, 0, None, None),
             (None, 5, "assistant", "é" * 700), (3, 1, "assistant", "")]
    df = prepare(spark).createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    by = defaultdict(list)
    for conv, _, role, text in turns:
        by[conv].append((role or "", text or ""))
    assert set(got) == set(by)
    for conv, said in by.items():
        own = "".join(t for r, t in said if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in said)
        assert got[conv].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(own), hashlib.sha256(own.encode()).hexdigest())


def test_fold_applies_edits_and_regenerations(spark):
    events = [(1, "m", 3, 0, "regenerate", "assistant", None), (1, "m", 1, 0, "delta", "assistant", "a"),
              (1, "m", 4, 0, "delta", None, "new"), (1, "n", 2, 0, "delta", "user", "x"), (1, "n", 5, 0, "edit", None, "y")]
    df = prepare(spark).createDataFrame(events, "conv_id long, message string, seq long, part int, kind string, role string, text string")
    assert found(chat.fold(df)) == [(1, "m", 1, "assistant", "new"), (1, "n", 2, "user", "y")]


def test_warc(spark):
    big = "<p>" + "é" * 60
    pages = [(1, "http://a/ b\r\nx", big), (0, None, big), (2, "u", None), (3, "u", "s"), (4, "u", "s"), (5, "u", big)]
    df = prepare(spark).createDataFrame(pages, "page_id long, url string, html string")
    records, index = warc.archive(df)
    got = {int(r.page_id): (r.payload_bytes, r.record_type, r.refers_to) for r in records.collect()}
    assert got == {0: (123, "response", None), 1: (123, "revisit", "0"), 5: (123, "revisit", "0"),
                   2: (0, "response", None), 3: (1, "response", None), 4: (1, "response", None)}
    assert index.count() == 6


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    vectors += [(400, None), (420, [0.0] * 8), (440, [float("nan")] * 8), (460, vectors[3][1]), (480, vectors[3][1])]
    df = prepare(spark).createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in permutation_index.search(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    good = {i: np.array(v) for i, v in vectors if i not in (400, 420, 440)}
    hits = 0
    asked = [i for i in good if i % 20 == 0]
    assert set(got) == set(asked)
    for q in asked:
        best = sorted((i for i in good if i != q), key=lambda i: (-float(good[i] @ good[q]), i))[:20]
        hits += len(set(best) & set(got[q]))
    assert hits >= 0.9 * 20 * len(asked)


def test_neighbours_of_shards_far_above_the_floor(spark):
    rng = np.random.default_rng(2)
    every = rng.normal(size=(4000, 48))
    every /= np.linalg.norm(every, axis=1, keepdims=True)
    df = prepare(spark).createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in permutation_index.search(df, permutation_index.Settings(least=40, shard_rows=2000)).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 4000, 20):
        scores = every @ every[q]
        scores[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-scores)[:20].tolist()))
    assert hits >= 0.9 * 20 * 200


def test_empty_tables(spark):
    none = prepare(spark).createDataFrame([], DOCS)
    for run in (suffixes.repeated_bytes, near_docs.near_documents, near_lines.dedup_lines, quality.quality,
                huffman.round_trip, packing.pack_documents, curriculum.mix):
        assert run(none).count() == 0, run
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).isEmpty()
    assert permutation_index.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).isEmpty()
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string"))[0].isEmpty()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    database = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    expected = database.execute(queries.ORACLE[name])
    columns = [c[0] for c in expected.description]
    result = queries.QUERIES[name](spark, FOLDER)
    assert sorted(columns) == sorted(result.columns)
    assert found(result, *columns) == sorted(expected.fetchall(), key=repr)
