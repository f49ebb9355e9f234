"""One query per operator over its whole test table, and SQL where it can say the same.

Queries derive their fixed columns from the operators' own results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, curriculum, huffman, merkle, near_docs, near_lines, packing, permutation_index
from . import quality, suffixes, threshold_search, warc
from .common import prepare

ESCAPED_CONVERSATION = -7
ESCAPED_TEXT = "\\### Assistant: </turn> ok"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one that holds the template's own markers."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(
        [(ESCAPED_CONVERSATION, n, role, ESCAPED_TEXT) for n, role in enumerate(("user", "assistant"))],
        turns.schema,
    )
    return chat.format_chats(turns.unionByName(added))


def op2_bbit_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_docs.near_documents(table(spark, folder, "documents"))


def op3_permutation_index(spark: SparkSession, folder: str) -> DataFrame:
    return permutation_index.search(table(spark, folder, "embeddings"))


def op4_compression_bands(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"))


def op5_huffman_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return huffman.round_trip(table(spark, folder, "documents"))


def op6_curriculum_mix(spark: SparkSession, folder: str) -> DataFrame:
    return curriculum.mix(table(spark, folder, "documents"))


def op7_warc_bundles(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    kind = pages.schema["page_id"].dataType
    records, _ = warc.archive(pages)
    return records.select(
        F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind),
    )


def op8_best_two_fit(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def op9_fuzzy_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines and removed lines of every document, and a digest of the text that stays."""
    rows = near_lines.dedup_lines(table(spark, folder, "documents"), near_lines.EVERY_LINE)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return rows.select("doc_id", "n_lines", "n_removed", digest.alias("kept_sha256"))


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.repeated_bytes(table(spark, folder, "documents"))


def op11_debruijn_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op12_time_forward_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(table(spark, folder, "documents"))


def op13_uniform_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return threshold_search.top_scores(table(spark, folder, "embeddings"))


OP1_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), turns AS (
    SELECT *, length(role || text)
        + length(regexp_replace(role || text, '[^\\<>]', '', 'g'))
        + length('<turn ></turn>') + 1 AS chars
    FROM rows
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

OP2_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE
        WHEN w IS NULL OR len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
        END AS s
    FROM words
), sizes AS (
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM sets
), items AS (
    SELECT doc_id, unnest(s) AS shingle FROM sets
), shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
    FROM items AS a JOIN items AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
    GROUP BY x, y
), pairs AS (
    SELECT x, y FROM shared JOIN sizes AS p ON p.doc_id = x JOIN sizes AS q ON q.doc_id = y
    WHERE 100 * n >= 75 * (p.n_shingles + q.n_shingles - n)
), links AS (
    SELECT x, y FROM pairs UNION SELECT y, x FROM pairs
), reached AS (
    SELECT doc_id AS node, doc_id AS other FROM sizes
    UNION
    SELECT reached.node, links.y FROM reached JOIN links ON reached.other = links.x
), groups AS (
    SELECT node, min(other) AS component_id FROM reached GROUP BY node
)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept
FROM sizes JOIN groups ON doc_id = node
"""

OP7_SQL = """
WITH rows AS (
    SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), marked AS (
    SELECT *, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first FROM rows
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM marked
"""

OP11_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), words AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
    SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang
), grams AS (
    SELECT lang, s AS size, array_to_string(w[i:i + s - 1], ' ') AS phrase
    FROM words, range(1, 6) AS sizes(s), unnest(range(1, len(w) - s + 2)) AS starts(i)
), found AS (
    SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY lang, size, phrase HAVING count(*) >= 100
), kept AS (
    SELECT * FROM found AS g WHERE size > 1 AND NOT EXISTS (
        SELECT 1 FROM found AS h WHERE h.lang = g.lang AND h.size > g.size AND 100 * h.f >= 100 * g.f
            AND contains(' ' || h.phrase || ' ', ' ' || g.phrase || ' '))
), cuts AS (
    SELECT lang, phrase, f AS a, k, string_split(phrase, ' ') AS w
    FROM kept, unnest(range(1, size)) AS places(k)
), scored AS (
    SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r, n,
        CAST((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
    FROM cuts AS c JOIN totals USING (lang)
    JOIN found AS l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ')
    JOIN found AS r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ')
), cut AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM cut
)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
FROM ranked WHERE rank <= 2000
"""

OP12_SQL = r"""
WITH RECURSIVE numbered AS (
    SELECT *, row_number() OVER () AS row FROM documents
), parts AS (
    SELECT row, doc_id, source, text,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
        || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
        list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT) AS bytes
    FROM numbered
), crcs AS (
    SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda crc, byte:
        list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y:
            xor(x // 2, (x % 2) * 3988292384)))) AS crc
    FROM parts
), leaves AS (
    SELECT row, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        sha256(head || CASE WHEN crc % 5 = 0 THEN coalesce(strlen(lowered) || ':' || lowered, '-')
            ELSE coalesce(strlen(text) || ':' || text, '-') END) AS shown
    FROM crcs
), sources AS (
    SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) AS tree FROM (SELECT DISTINCT source FROM leaves)
), placed AS (
    SELECT l.*, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
    FROM leaves AS l JOIN sources AS s ON l.source IS NOT DISTINCT FROM s.source
), nodes AS (
    SELECT tree, 0 AS lvl, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM placed
    UNION ALL
    SELECT tree, any_value(lvl) + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 15) // 16)
    FROM nodes WHERE n > 1 GROUP BY tree, pos // 16
), subroots AS (
    SELECT tree, digest AS subroot, lvl AS depth FROM nodes WHERE n = 1
), tops AS (
    SELECT 0 AS lvl, tree - 1 AS pos, subroot AS digest, count(*) OVER () AS n FROM subroots
    UNION ALL
    SELECT any_value(lvl) + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 15) // 16)
    FROM tops WHERE n > 1 GROUP BY pos // 16
), every AS (
    SELECT tree, lvl, pos, digest FROM nodes WHERE n > 1
    UNION ALL SELECT 0, lvl, pos, digest FROM tops WHERE n > 1
), sides AS (
    SELECT a.tree, a.lvl, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
        coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
    FROM every AS a JOIN every AS b ON a.tree = b.tree AND a.lvl = b.lvl AND a.pos // 16 = b.pos // 16
    GROUP BY a.tree, a.lvl, a.pos
), steps AS (
    SELECT tree, pos, tree AS walk, 0 AS lvl, pos AS place, '' AS proof, shown AS folded, row FROM placed
    UNION ALL
    SELECT s.tree, s.pos, CASE WHEN d.tree IS NULL THEN 0 ELSE s.walk END,
        CASE WHEN d.tree IS NULL THEN 0 ELSE s.lvl + 1 END, CASE WHEN d.tree IS NULL THEN s.tree - 1 ELSE s.place // 16 END,
        s.proof || coalesce(d.before || d.after, ''),
        CASE WHEN d.tree IS NULL THEN s.folded ELSE sha256(d.before || s.folded || d.after) END, s.row
    FROM steps AS s LEFT JOIN sides AS d ON d.tree = s.walk AND d.lvl = s.lvl AND d.pos = s.place
    WHERE d.tree IS NOT NULL OR s.walk > 0
), done AS (
    SELECT row, proof, folded FROM steps WHERE walk = 0
    QUALIFY row_number() OVER (PARTITION BY row ORDER BY lvl DESC) = 1
)
SELECT doc_id, leaf, subroot, (SELECT digest FROM tops WHERE n = 1) AS root, sha256(proof) AS proof_sha256,
    folded AS folded_root, folded = (SELECT digest FROM tops WHERE n = 1) AS verified
FROM placed JOIN subroots USING (tree) JOIN done USING (row)
"""

OP13_SQL = """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM vectors AS q JOIN vectors AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

QUERIES = {
    run.__name__: run
    for run in (
        op1_chat_formatting,
        op2_bbit_minhash,
        op3_permutation_index,
        op4_compression_bands,
        op5_huffman_tokens,
        op6_curriculum_mix,
        op7_warc_bundles,
        op8_best_two_fit,
        op9_fuzzy_lines,
        op10_suffix_dedup,
        op11_debruijn_collocations,
        op12_time_forward_merkle,
        op13_uniform_threshold,
    )
}
# The others need zstandard ratios, a tokenizer, a hashed order, an approximate search or
# joins that are too slow in SQL; they are tested against loops over every row.
ORACLE = {
    "op1_chat_formatting": OP1_SQL,
    "op2_bbit_minhash": OP2_SQL,
    "op7_warc_bundles": OP7_SQL,
    "op11_debruijn_collocations": OP11_SQL,
    "op12_time_forward_merkle": OP12_SQL,
    "op13_uniform_threshold": OP13_SQL,
}
