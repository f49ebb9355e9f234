"""Document operators (D1-D16, L1-L3) and U1 over the documents table cut into pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions.languages import WORD
from ..functions.udfs import nfkc, similarity
from ..operators import batchmap, compare, documents, language, marks, redact
from .registry import query

NOW = "2024-01-31 14:05:59"
LENGTHS = "SELECT doc_id, count(*) AS n_pages FROM doc_pages GROUP BY doc_id"


@query(
    "D1_page_counts",
    "doc_id:i n_pages:i error:s",
    "doc_pages",
    """SELECT d.doc_id, count(p.doc_id) AS n_pages,
    CASE WHEN count(p.doc_id) = 0 THEN 'no_pages' END AS error
    FROM documents d LEFT JOIN doc_pages p USING (doc_id)
    GROUP BY d.doc_id""",
)
def _page_counts(t):
    return documents.page_counts(t.raw("documents"), t.doc_pages)


_MERGE_PLAN = """SELECT doc_id % 100 AS out_doc, doc_id * 10 AS input_pos, doc_id FROM documents
    UNION ALL SELECT doc_id % 100, doc_id * 10 + 5, doc_id FROM documents WHERE doc_id % 7 = 0"""


def _merge_plan(t):
    docs = t.raw("documents").select("doc_id")
    out = (F.col("doc_id") % 100).alias("out_doc")
    again = docs.filter("doc_id % 7 = 0").select(
        out, (F.col("doc_id") * 10 + 5).alias("input_pos"), "doc_id"
    )
    return docs.select(out, (F.col("doc_id") * 10).alias("input_pos"), "doc_id").union(again)


_MERGED = f"""SELECT out_doc, input_pos, doc_id, page_no, row_number() OVER (
    PARTITION BY out_doc ORDER BY input_pos, page_no) AS out_page, sha256(text) AS digest
    FROM ({_MERGE_PLAN}) JOIN doc_pages USING (doc_id)"""
for _name in ("D2_merge", "N6_merged_page_numbers"):
    query(
        _name, "out_doc:i input_pos:i doc_id:i page_no:i out_page:i digest:s", "doc_pages", _MERGED
    )(
        lambda t: documents.merge_documents(t.doc_pages, _merge_plan(t)).withColumn(
            "digest", F.sha2("text", 256)
        )
    )


@query(
    "D3_split",
    "doc_id:i part:i label:s output_name:s out_page:i page_no:i digest:s",
    "doc_pages",
    f"""SELECT doc_id, part, label, concat('Report ', doc_id, '.v2-pages-', label, '.pdf')
      AS output_name, out_page, page_no, sha256(text) AS digest FROM (
    SELECT doc_id, page_no AS part, CAST(page_no AS VARCHAR) AS label, 1 AS out_page, page_no, text
      FROM doc_pages WHERE doc_id % 2 = 1
    UNION ALL SELECT doc_id, 1, '1-2', page_no, page_no, text FROM doc_pages
      JOIN ({LENGTHS}) USING (doc_id) WHERE doc_id % 2 = 0 AND n_pages >= 2 AND page_no <= 2
    UNION ALL SELECT doc_id, 2, '2_1', 3 - page_no, page_no, text FROM doc_pages
      JOIN ({LENGTHS}) USING (doc_id) WHERE doc_id % 2 = 0 AND n_pages >= 2 AND page_no <= 2)""",
)
def _split(t):
    specs = t.raw("documents").select(
        "doc_id",
        F.concat(F.lit("Report "), F.col("doc_id").cast("string"), F.lit(".v2.pdf")).alias("name"),
        F.array(F.lit("1-2"), F.lit("2,1")).alias("ranges"),
        (F.col("doc_id") % 2 == 1).alias("every_page"),
    )
    parts = documents.split_documents(t.doc_pages, specs)
    return parts.withColumn("digest", F.sha2("text", 256))


def _with_spec(t, spec: str):
    return t.raw("documents").select("doc_id", F.lit(spec).alias("pages"))


@query(
    "D4_delete_pages",
    "doc_id:i out_page:i page_no:i digest:s",
    "doc_pages",
    f"""SELECT doc_id, CASE WHEN page_no = 1 THEN 1 ELSE page_no - 2 END AS out_page, page_no,
    sha256(text) AS digest FROM doc_pages JOIN ({LENGTHS}) USING (doc_id)
    WHERE n_pages >= 3 AND page_no NOT IN (2, 3)""",
)
def _delete(t):
    kept = documents.delete_pages(t.doc_pages, _with_spec(t, "3,2-3,3-2,2"))
    return kept.withColumn("digest", F.sha2("text", 256))


@query(
    "D4_delete_errors",
    "doc_id:i error:s",
    "doc_pages",
    f"""SELECT doc_id, CASE n_pages WHEN 1 THEN 'out_of_range' ELSE 'all_pages' END AS error
    FROM ({LENGTHS}) WHERE n_pages <= 2""",
)
def _delete_errors(t):
    return documents.selection_errors(_with_spec(t, "1-2,2"), t.doc_pages, deleting=True)


@query(
    "D5_extract_pages",
    "doc_id:i out_page:i page_no:i digest:s",
    "doc_pages",
    f"""SELECT doc_id, out_page, page_no, sha256(text) AS digest FROM doc_pages
    JOIN ({LENGTHS}) USING (doc_id)
    JOIN (VALUES (1, 2), (2, 3), (3, 1), (4, 2)) AS s(out_page, wanted) ON page_no = wanted
    WHERE n_pages >= 3""",
)
def _extract(t):
    taken = documents.extract_pages(t.doc_pages, _with_spec(t, "2-3, 1,2"))
    return taken.withColumn("digest", F.sha2("text", 256))


def _orders(t):
    wanted = F.when(
        F.col("doc_id") % 3 < 2, F.col("total_pages") - F.col("page_no") + 1
    ).otherwise(F.lit(1))
    return t.doc_pages.select("doc_id", F.col("page_no").alias("out_page"), wanted.alias("page_no"))


@query(
    "D6_reorder_pages",
    "doc_id:i out_page:i page_no:i digest:s",
    "doc_pages",
    """SELECT doc_id, total_pages - page_no + 1 AS out_page, page_no, sha256(text) AS digest
    FROM doc_pages WHERE doc_id % 3 < 2 OR total_pages = 1""",
)
def _reorder(t):
    moved = documents.reorder_pages(t.doc_pages, _orders(t))
    return moved.withColumn("digest", F.sha2("text", 256))


@query(
    "D6_order_errors",
    "doc_id:i",
    "doc_pages",
    "SELECT DISTINCT doc_id FROM doc_pages WHERE doc_id % 3 = 2 AND total_pages > 1",
)
def _order_errors(t):
    return documents.order_errors(t.doc_pages, _orders(t))


@query(
    "D7_rotate_pages",
    "doc_id:i page_no:i rotation:i error:s",
    "doc_pages",
    """SELECT doc_id, page_no, error, CASE WHEN error IS NULL AND CASE doc_id % 4
        WHEN 1 THEN page_no <= 2 WHEN 2 THEN page_no % 2 = 1 WHEN 3 THEN page_no % 2 = 0
        ELSE true END
      THEN (page_no % 4 * 90 + (1 + doc_id % 3) * 90) % 360 ELSE page_no % 4 * 90 END AS rotation
    FROM (SELECT *, CASE WHEN doc_id % 4 = 1 AND total_pages < 2 THEN 'out_of_range' END AS error
      FROM doc_pages)""",
)
def _rotate(t):
    kind = F.col("doc_id") % 4
    specs = t.raw("documents").select(
        "doc_id",
        ((F.col("doc_id") % 3 + 1) * 90).cast("int").alias("angle"),
        F.when(kind == 1, "1-2").alias("pages"),
        F.when(kind == 2, "odd").when(kind == 3, "even").otherwise("all").alias("apply_to"),
    )
    turned = t.doc_pages.withColumn("rotation", F.col("page_no") % 4 * 90)
    return documents.rotate_pages(turned, specs)


def _pairs(t):
    return t.raw("documents").select(
        F.col("doc_id").alias("pair_id"),
        F.col("doc_id").alias("doc_a"),
        (F.col("doc_id") + 1).alias("doc_b"),
    )


@query("D8_compare_pages", "pair_id:i page_no:i ratio:f changed:b lines:s")
def _compare_pages(t):
    compared = compare.compare_pages(t.doc_pages, _pairs(t))
    return compared.withColumn("lines", F.array_join("lines", "\n"))


@query("D8_compare_documents", "pair_id:i changed_pages:i total_pages:i")
def _compare_documents(t):
    return compare.compare_documents(t.doc_pages, _pairs(t))


@query(
    "D8_settled_pages",
    "pair_id:i page_no:i settled:b",
    "doc_pages",
    """SELECT pair_id, page_no, CASE WHEN text_a = text_b THEN false
      WHEN 2.0 * least(length(text_a), length(text_b)) / (length(text_a) + length(text_b)) < 0.999
      THEN true END AS settled
    FROM (SELECT pair_id, page_no, coalesce(a.text, '') AS text_a, coalesce(b.text, '') AS text_b
      FROM (SELECT doc_id AS pair_id, page_no, text FROM doc_pages) a
      FULL JOIN (SELECT doc_id - 1 AS pair_id, page_no, text FROM doc_pages
        WHERE doc_id - 1 IN (SELECT doc_id FROM documents)) b
      USING (pair_id, page_no))""",
)
def _settled(t):
    return compare.settled_changes(t.doc_pages, _pairs(t))


@query(
    "D8_copies",
    "pair_id:i changed_pages:i total_pages:i",
    "doc_pages",
    f"SELECT doc_id AS pair_id, 0 AS changed_pages, n_pages AS total_pages FROM ({LENGTHS})",
)
def _copies(t):
    pairs = _pairs(t).withColumn("doc_b", F.col("doc_a"))
    return compare.compare_documents(t.doc_pages, pairs)


_FIRST_WORD = "lower(regexp_extract(text, '([A-Za-z]{3,})', 1))"
_TERMS = f"""SELECT doc_id, term FROM (SELECT doc_id, {_FIRST_WORD} AS term FROM documents
    UNION SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'qzx' ELSE 'er' END
    FROM documents) WHERE term <> ''"""
_HITS = f"""SELECT doc_id, term, sum((length(lower(text)) - length(replace(lower(text), term, '')))
    / length(term)) AS hits FROM ({_TERMS}) JOIN doc_pages USING (doc_id) GROUP BY doc_id, term"""


def _terms(t):
    docs = t.raw("documents")
    word = F.lower(F.regexp_extract("text", "([A-Za-z]{3,})", 1))
    kind = F.col("doc_id") % 3
    extra = F.when(kind == 0, " EN ").when(kind == 1, "qzx").otherwise("er")
    terms = F.array(
        F.struct(F.lit(0).alias("pos"), word.alias("term")),
        F.struct(F.lit(1).alias("pos"), extra.alias("term")),
        F.struct(F.lit(2).alias("pos"), word.alias("term")),
        F.struct(F.lit(3).alias("pos"), F.lit("  ").alias("term")),
    )
    lowered = docs.select("doc_id", F.explode(terms).alias("x")).select("doc_id", "x.*")
    return lowered.withColumn(
        "term", F.when(F.col("pos") == 1, F.lower("term")).otherwise(F.col("term"))
    )


@query("D9_term_hits", "doc_id:i term:s hits:i", "doc_pages", _HITS)
def _hits(t):
    return redact.term_hits(t.doc_pages, _terms(t))


@query(
    "D9_redaction_verdicts",
    "doc_id:i n_terms:i regions:i missing:s error:s",
    "doc_pages",
    f"""SELECT doc_id, n_terms, regions, missing, CASE WHEN n_missing = n_terms THEN 'none_found'
      WHEN n_missing > 0 THEN 'terms_missing' END AS error FROM (
    SELECT doc_id, count(*) AS n_terms, sum(hits) AS regions,
      coalesce(string_agg(CASE WHEN hits = 0 THEN term END, ',' ORDER BY term), '') AS missing,
      count(*) FILTER (hits = 0) AS n_missing FROM ({_HITS}) GROUP BY doc_id)""",
)
def _verdicts(t):
    found = redact.redaction_verdicts(t.doc_pages, _terms(t))
    return found.withColumn("missing", F.array_join("missing", ","))


# Spans of all terms of a page, each found from left to right, and the text between them.
_CLEAN = f"""SELECT doc_id, page_no, coalesce(string_agg(substring(text, past + 1, greatest(
      start - past, 0)), '' ORDER BY start, stop), '') AS text
    FROM (SELECT *, coalesce(max(stop) OVER (PARTITION BY doc_id, page_no ORDER BY start, stop
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past
      FROM (SELECT doc_id, page_no, text, length(text) AS start, length(text) AS stop
        FROM doc_pages
        UNION ALL SELECT doc_id, page_no, text, start, start + length(term) FROM (
          SELECT doc_id, page_no, text, term, k, n, (k - 1) * length(term) + CAST(sum(
            length(parts[k])) OVER (PARTITION BY doc_id, page_no, term ORDER BY k) AS BIGINT)
            AS start
          FROM (SELECT *, len(parts) AS n, unnest(range(1, len(parts) + 1)) AS k FROM (
            SELECT doc_id, page_no, text, term, string_split(lower(text), term) AS parts
            FROM doc_pages JOIN ({_TERMS}) USING (doc_id)))) WHERE k < n))
    WHERE doc_id NOT IN (SELECT doc_id FROM ({_HITS}) WHERE hits = 0)
    GROUP BY doc_id, page_no"""


@query("D9_redact", "doc_id:i page_no:i digest:s", "doc_pages",
       f"SELECT doc_id, page_no, sha256(text) AS digest FROM ({_CLEAN})")
def _redact(t):
    clean = redact.redact(t.doc_pages, _terms(t))
    return clean.withColumn("digest", F.sha2("text", 256))


# One row per line of a page; a line that recurs in its document is half transparent.
SPANS = """SELECT doc_id, page_no, span_no, line AS text,
    CASE WHEN length(line) % 11 = 0 THEN 45.0 ELSE 0.0 END AS rotation_deg,
    CASE WHEN count(*) OVER (PARTITION BY doc_id, line) > 1 THEN 0.5 ELSE 1.0 END AS alpha,
    10.0 + length(line) % 5 * 8 AS size_pt, 72.0 AS x0, span_no * 14.0 AS y0,
    72.0 + length(line) AS x1, span_no * 14.0 + 12 AS y1
    FROM (SELECT doc_id, page_no, parts[i] AS line, i AS span_no FROM (
      SELECT doc_id, page_no, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
        SELECT doc_id, page_no, string_split(text, chr(10)) AS parts FROM doc_pages)))"""


def _spans(t):
    lines = t.doc_pages.select(
        "doc_id", "page_no", F.posexplode(F.split("text", "\n")).alias("i", "text")
    ).withColumn("span_no", F.col("i") + 1)
    copies = lines.groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    size = F.length("text")
    top = F.col("span_no") * 14.0
    return lines.join(copies, ["doc_id", "text"], "inner").select(
        "doc_id",
        "page_no",
        "span_no",
        "text",
        F.when(size % 11 == 0, 45.0).otherwise(0.0).alias("rotation_deg"),
        F.when(F.col("copies") > 1, 0.5).otherwise(1.0).alias("alpha"),
        (size % 5 * 8 + 10.0).alias("size_pt"),
        F.lit(72.0).alias("x0"),
        top.alias("y0"),
        (size + 72.0).alias("x1"),
        (top + 12).alias("y1"),
    )


_AREAS = """SELECT doc_id, 1 AS position, CAST(doc_id % 3 + 1 AS INT) AS page_no, 60.0 AS x0,
    20.0 AS y0, CASE WHEN doc_id % 11 = 0 THEN 60.0 ELSE 200.0 END AS x1, 40.0 AS y1,
    CASE doc_id % 13 WHEN 0 THEN 'glass' ELSE 'black' END AS mode, 1.0 AS opacity FROM documents
    UNION ALL SELECT doc_id, 2, 1, 0.0, 50.0, 90.0, 60.0, 'white', 0.01 FROM documents"""
_CHECKED = f"""SELECT a.*, CASE WHEN a.page_no > n_pages THEN 'page_out_of_range'
    WHEN x1 <= x0 THEN 'degenerate' WHEN mode = 'glass' THEN 'unknown_mode' END AS error
    FROM ({_AREAS}) a JOIN ({LENGTHS}) USING (doc_id)"""


def _areas(t):
    docs = t.raw("documents")
    first = docs.select(
        "doc_id",
        F.lit(1).alias("position"),
        (F.col("doc_id") % 3 + 1).cast("int").alias("page_no"),
        F.lit(60.0).alias("x0"),
        F.lit(20.0).alias("y0"),
        F.when(F.col("doc_id") % 11 == 0, 60.0).otherwise(200.0).alias("x1"),
        F.lit(40.0).alias("y1"),
        F.when(F.col("doc_id") % 13 == 0, "glass").alias("mode"),
        F.lit(None).cast("double").alias("opacity"),
    )
    second = docs.select(
        "doc_id", F.lit(2), F.lit(1), F.lit(0.0), F.lit(50.0), F.lit(90.0), F.lit(60.0),
        F.lit("White"), F.lit(0.01),
    )
    return redact.check_areas(first.union(second), t.doc_pages)


@query(
    "D10_check_areas",
    "doc_id:i position:i mode:s opacity:f error:s",
    "doc_pages",
    f"SELECT doc_id, position, mode, greatest(0.05, opacity) AS opacity, error FROM ({_CHECKED})",
)
def _check_areas(t):
    return _areas(t)


@query(
    "D10_areas_per_page",
    "doc_id:i page_no:i areas:i",
    "doc_pages",
    f"""WITH checked AS ({_CHECKED}) SELECT doc_id, page_no, count(*) AS areas FROM checked
    WHERE doc_id NOT IN (SELECT doc_id FROM checked WHERE error IS NOT NULL) GROUP BY 1, 2""",
)
def _areas_per_page(t):
    return redact.areas_per_page(_areas(t))


@query(
    "D10_remove_in_areas",
    "doc_id:i page_no:i span_no:i",
    "doc_pages",
    f"""WITH checked AS ({_CHECKED}), spans AS ({SPANS})
    SELECT doc_id, page_no, span_no FROM spans s
    WHERE doc_id NOT IN (SELECT doc_id FROM checked WHERE error IS NOT NULL)
      AND NOT EXISTS (SELECT 1 FROM checked a WHERE a.error IS NULL AND a.doc_id = s.doc_id
        AND a.page_no = s.page_no AND s.x0 < a.x1 AND a.x0 < s.x1 AND s.y0 < a.y1
        AND a.y0 < s.y1)""",
)
def _remove_in_areas(t):
    return redact.remove_in_areas(_spans(t), _areas(t))


_TRAITS = f"""SELECT *, lower(regexp_replace(text, '[\\s\\p{{Z}}]+', '', 'g')) AS norm,
    rotation_deg > 0 AS diagonal, alpha < 0.999 AS transparent FROM ({SPANS})"""
_MARKS = f"""SELECT doc_id, norm, pages AS n_pages, most FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pages DESC, norm) AS r FROM (
      SELECT doc_id, norm, count(*) AS pages, max(n) AS most, bool_or(strong) AS strong FROM (
        SELECT doc_id, norm, page_no, count(*) AS n, bool_or((diagonal AND transparent)
          OR (diagonal AND size_pt >= 24) OR (transparent AND size_pt >= 30)) AS strong
        FROM ({_TRAITS}) WHERE length(norm) BETWEEN 2 AND 80 AND (diagonal OR transparent)
        GROUP BY 1, 2, 3) GROUP BY 1, 2)
      JOIN ({LENGTHS}) USING (doc_id)
      WHERE strong OR most >= 3 OR (n_pages >= 2 AND pages >= greatest(2, (n_pages + 1) // 2)))
    WHERE r <= 8"""


def _detected(t):
    return marks.detect_marks(_spans(t), documents.document_lengths(t.doc_pages))


@query("D11_detect_marks", "doc_id:i norm:s n_pages:i most_per_page:i", "doc_pages",
       f"SELECT doc_id, norm, n_pages, most AS most_per_page FROM ({_MARKS})")
def _detect(t):
    return _detected(t)


_PLACED = """SELECT l_orderkey AS doc_id, l_linenumber AS page_no, l_partkey % 4 AS digest,
    l_quantity * 10 AS a, CASE WHEN l_suppkey % 10 = 0 THEN l_quantity ELSE 0.0 END AS b,
    CASE WHEN l_suppkey % 10 = 0 THEN -l_quantity ELSE 0.0 END AS c, l_quantity * 12 AS d,
    l_tax * 2000 AS e, l_tax * 3000 AS f, CASE WHEN l_discount > 0.05 THEN 0.4 ELSE 1.0 END
    AS alpha, l_partkey % 50 = 0 AS has_smask FROM lineitem"""


@query(
    "D12_detect_image_marks",
    "doc_id:i digest:i n_pages:i most_per_page:i",
    "",
    f"""SELECT doc_id, digest, pages AS n_pages, most AS most_per_page FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pages DESC, digest) AS r FROM (
      SELECT doc_id, digest, count(*) AS pages, max(n) AS most, bool_or(dg) AS dg,
        bool_or(tr) AS tr, bool_or(ce) AS ce, bool_or(bg) AS bg FROM (
        SELECT doc_id, digest, page_no, count(*) AS n, bool_or(diagonal) AS dg,
          bool_or(alpha < 0.999 OR has_smask) AS tr, bool_or(ratio <= 0.9
            AND 306 BETWEEN least(e, e + a, e + c, e + a + c) AND greatest(e, e + a, e + c,
              e + a + c)
            AND 396 BETWEEN least(f, f + b, f + d, f + b + d) AND greatest(f, f + b, f + d,
              f + b + d)) AS ce, bool_or(ratio BETWEEN 0.15 AND 0.9) AS bg
        FROM (SELECT *, abs(a * d - b * c) / (612.0 * 792.0) AS ratio,
          degrees(atan2(b, a)) > 2.5 AND degrees(atan2(b, a)) < 87.5 AS diagonal FROM ({_PLACED}))
        GROUP BY 1, 2, 3) GROUP BY 1, 2)
      JOIN (SELECT l_orderkey AS doc_id, max(l_linenumber) AS total FROM lineitem GROUP BY 1)
        USING (doc_id)
      WHERE dg OR (tr AND (ce OR bg OR most >= 3))
        OR (total >= 2 AND pages >= greatest(2, (total + 1) // 2) AND ce AND bg))
    WHERE r <= 8""",
)
def _detect_images(t):
    tilted = F.col("l_suppkey") % 10 == 0
    size = F.col("l_quantity")
    line = t.raw("lineitem").withColumnsRenamed({"l_orderkey": "doc_id", "l_linenumber": "page_no"})
    placements = line.select(
        "doc_id",
        "page_no",
        (F.col("l_partkey") % 4).alias("digest"),
        (size * 10).alias("a"),
        F.when(tilted, size).otherwise(0.0).alias("b"),
        F.when(tilted, -size).otherwise(0.0).alias("c"),
        (size * 12).alias("d"),
        (F.col("l_tax") * 2000).alias("e"),
        (F.col("l_tax") * 3000).alias("f"),
        F.when(F.col("l_discount") > 0.05, 0.4).otherwise(1.0).alias("alpha"),
        (F.col("l_partkey") % 50 == 0).alias("has_smask"),
        F.lit(0.0).alias("x0"),
        F.lit(0.0).alias("y0"),
        F.lit(612.0).alias("x1"),
        F.lit(792.0).alias("y1"),
    )
    lengths = line.groupBy("doc_id").agg(F.max("page_no").alias("n_pages"))
    return marks.detect_image_marks(placements, lengths)


@query(
    "D13_removal_counts",
    "doc_id:i removed:i",
    "doc_pages",
    f"""WITH traits AS ({_TRAITS}), marks AS ({_MARKS})
    SELECT s.doc_id, count(*) FILTER ((m.norm IS NOT NULL AND (s.diagonal OR s.transparent))
      OR s.norm LIKE '%contactus%') AS removed
    FROM traits s LEFT JOIN marks m ON m.doc_id = s.doc_id AND m.norm = s.norm GROUP BY s.doc_id""",
)
def _removal_counts(t):
    return marks.removal_counts(_spans(t), _detected(t), "Contact us")


@query(
    "D13_remove_marks",
    "doc_id:i page_no:i span_no:i",
    "doc_pages",
    f"""WITH traits AS ({_TRAITS}), marks AS ({_MARKS})
    SELECT s.doc_id, s.page_no, s.span_no
    FROM traits s LEFT JOIN marks m ON m.doc_id = s.doc_id AND m.norm = s.norm
    WHERE m.norm IS NULL OR NOT (s.diagonal OR s.transparent)""",
)
def _remove_marks(t):
    return marks.remove_marks(_spans(t), _detected(t))


@query(
    "D14_stamp_pages",
    "doc_id:i page_no:i header:s footer:s",
    "doc_pages",
    """SELECT doc_id, page_no, CASE WHEN chosen THEN concat('doc', doc_id, '.pdf') END AS header,
    CASE WHEN chosen AND doc_id % 2 = 0 THEN concat('2024-01-31 ', page_no, '/', total_pages) END
      AS footer
    FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN page_no BETWEEN 2 AND 3
      ELSE page_no = total_pages END AS chosen FROM doc_pages)""",
)
def _stamp(t):
    kind = F.col("doc_id") % 3
    specs = t.raw("documents").select(
        "doc_id",
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"),
        F.lit("{filename}").alias("header_text"),
        F.when(F.col("doc_id") % 2 == 0, "{date} {page}/{total}").alias("footer_text"),
        F.when(kind == 2, "last").otherwise("all").alias("pages"),
        F.when(kind == 1, "2-3").alias("page_range"),
    )
    return documents.stamp_pages(t.doc_pages, specs, NOW)


@query(
    "D15_number_pages",
    "doc_id:i page_no:i page_label:s",
    "doc_pages",
    """SELECT doc_id, page_no, CASE WHEN NOT (doc_id % 2 = 0 AND page_no = 1) THEN
    concat('Page ', page_no + doc_id % 5, ' of ', total_pages + doc_id % 5) END AS page_label
    FROM doc_pages""",
)
def _number(t):
    specs = t.raw("documents").select(
        "doc_id",
        F.lit("Page {page} of {total}{filename}").alias("format"),
        (F.col("doc_id") % 5 + 1).cast("int").alias("start_at"),
        (F.col("doc_id") % 2 == 0).alias("skip_first"),
    )
    return documents.number_pages(t.doc_pages, specs, NOW)


@query(
    "D16_set_metadata",
    "doc_id:i title:s author:s producer:s n:i",
    "",
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN 'New' ELSE 'New' END AS title,
    CASE doc_id % 3 WHEN 2 THEN NULL ELSE source END AS author,
    CASE doc_id % 3 WHEN 2 THEN NULL ELSE 'press' END AS producer,
    CASE doc_id % 3 WHEN 2 THEN 1 ELSE 3 END AS n FROM documents""",
)
def _metadata(t):
    known = F.create_map(
        F.lit("title"), F.col("lang"), F.lit("author"), F.col("source"), F.lit("producer"),
        F.lit("press"),
    )
    docs = t.raw("documents").select("doc_id", known.alias("metadata"))
    changes = docs.filter("doc_id % 3 > 0").select(
        "doc_id",
        F.create_map(F.lit("title"), F.lit("New"), F.lit("pages"), F.lit("7")).alias("fields"),
        (F.col("doc_id") % 3 == 2).alias("clear_existing"),
    )
    meta = F.col("metadata")
    return documents.set_metadata(docs, changes).select(
        "doc_id",
        meta["title"].alias("title"),
        meta["author"].alias("author"),
        meta["producer"].alias("producer"),
        F.size("metadata").alias("n"),
    )


# ---- L: languages ---------------------------------------------------------------------------

_WORDLIST = " UNION ALL ".join(
    f"SELECT '{lang}' AS lang, {order} AS ord, unnest(string_split('{text}', ' ')) AS word"
    for order, (lang, text) in enumerate(C.STOPWORDS.items())
)
_RE2_WORD = WORD


def _guess_sql(source: str, keys: str) -> str:
    on = " AND ".join(f"q.{key} = h.{key}" for key in keys.split(", "))
    picked = ", ".join(f"q.{key}" for key in keys.split(", "))
    return f"""SELECT {picked}, q.n_words, coalesce(h.hits, 0) AS hits, CASE WHEN q.n_words >= 10
      AND h.hits >= 4 AND (h.lang = 'eng' OR h.hits >= 1.5 * coalesce(h.english, 0)) THEN h.lang
      END AS language
    FROM (SELECT {keys}, len(regexp_extract_all(text, '{_RE2_WORD}')) AS n_words FROM {source}) q
    LEFT JOIN (SELECT {keys}, hits, lang, english FROM (
      SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY hits DESC, ord) AS r,
        max(CASE WHEN lang = 'eng' THEN hits END) OVER (PARTITION BY {keys}) AS english
      FROM (SELECT {keys}, lang, ord, count(*) AS hits FROM (
          SELECT {keys}, lower(unnest(regexp_extract_all(text, '{_RE2_WORD}'))) AS word
          FROM {source}) w JOIN ({_WORDLIST}) s USING (word) GROUP BY {keys}, lang, ord))
      WHERE r = 1) h ON {on}"""


@query(
    "L1_guess_language",
    "doc_id:i n_words:i hits:i language:s",
    "",
    _guess_sql("documents", "doc_id"),
)
def _guess(t):
    return language.guess_language(t.raw("documents").select("doc_id", "text"))


_SCRIPT_VALUES = ", ".join(
    f"(regexp_replace(text, '\\p{{{name}}}', '', 'g'), '{name}', {order})"
    for order, name in enumerate(C.CHARACTER_SCRIPTS)
)
_SCRIPTED = f"""SELECT doc_id, page_no, CASE WHEN n > 0 THEN script END AS script FROM (
    SELECT doc_id, page_no, length(text) - length(x.rest) AS n, x.script, row_number() OVER (
      PARTITION BY doc_id, page_no ORDER BY length(text) - length(x.rest) DESC, x.ord) AS r
    FROM doc_pages, LATERAL (VALUES {_SCRIPT_VALUES}) AS x(rest, script, ord)) WHERE r = 1"""


@query("L2_page_scripts", "doc_id:i page_no:i script:s language:s", "doc_pages",
       f"SELECT *, NULL AS language FROM ({_SCRIPTED})")
def _scripts(t):
    return language.page_scripts(t.doc_pages)


@query(
    "L3_document_language",
    "doc_id:i language:s script:s detected:b",
    "doc_pages",
    f"""WITH sample AS (SELECT * FROM doc_pages WHERE page_no <= 2),
    guessed AS ({_guess_sql("sample", "doc_id, page_no")}),
    scripted AS (SELECT * FROM ({_SCRIPTED}) WHERE page_no <= 2),
    ranked AS (SELECT doc_id, language, count(*) AS n, min(page_no) AS f FROM guessed
      JOIN scripted USING (doc_id, page_no)
      WHERE language IS NOT NULL AND script = 'Latin' GROUP BY 1, 2),
    listed AS (SELECT doc_id, list(language ORDER BY n DESC, f) AS ls FROM ranked GROUP BY 1),
    modal AS (SELECT doc_id, script FROM (SELECT doc_id, script, row_number() OVER (
      PARTITION BY doc_id ORDER BY count(*) DESC, min(page_no)) AS r FROM scripted
      WHERE script IS NOT NULL GROUP BY 1, 2) WHERE r = 1)
    SELECT d.doc_id, CASE WHEN m.script = 'Latin' THEN array_to_string(CASE
        WHEN ls IS NULL THEN ['eng'] WHEN list_contains(ls, 'eng') THEN ls[1:4]
        ELSE list_append(ls, 'eng')[1:4] END, '+') ELSE 'eng' END AS language,
      m.script, m.script IS NOT NULL AS detected
    FROM documents d LEFT JOIN modal m USING (doc_id) LEFT JOIN listed USING (doc_id)""",
)
def _document_language(t):
    return language.document_language(t.doc_pages)


# ---- U: Python functions ----------------------------------------------------------------------


def _first_half(content: bytes, name: str, position: int) -> list[bytes]:
    """Example of a per-file function: splits a text in two, refuses some."""
    if position % 10 == 7:
        raise batchmap.FileError("PROCESSING_FAILED", f"{name} was refused")
    middle = len(content) // 2
    return [content[:middle], content[middle:]]


def _batch(t):
    files = t.raw("documents").select(
        F.floor(F.col("doc_id") / 20).cast("string").alias("job_id"),
        F.col("doc_id").cast("int").alias("position"),
        F.col("source").alias("name"),
        F.encode("text", "UTF-8").alias("content"),
    )
    return batchmap.batch_map(files, _first_half)


_BATCH_COLUMNS = "job_id:s position:i part:i size:i error_code:s message:s"
_BATCH = """SELECT CAST(doc_id // 20 AS VARCHAR) AS job_id, doc_id AS position, part,
    CASE part WHEN 0 THEN n // 2 WHEN 1 THEN n - n // 2 END AS size,
    CASE WHEN part IS NULL THEN 'PROCESSING_FAILED' END AS error_code,
    CASE WHEN part IS NULL THEN concat(source, ' was refused') END AS message
    FROM (SELECT doc_id, source, octet_length(encode(text)) AS n,
      unnest(CASE WHEN doc_id % 10 = 7 THEN [NULL] ELSE [0, 1] END) AS part FROM documents)"""


@query("U1_batch_map", _BATCH_COLUMNS, "", _BATCH)
def _batch_map(t):
    return _batch(t).withColumn("size", F.octet_length("output"))


def _batch_sql(t):
    batchmap.register_batch_function(t.spark, "first_half", _first_half)
    t.raw("documents").createOrReplaceTempView("batch_documents")
    return t.spark.sql("""SELECT *, octet_length(output) AS size FROM first_half(TABLE(
        SELECT string(floor(doc_id / 20)) AS job_id, int(doc_id) AS position, source AS name,
          encode(text, 'UTF-8') AS content FROM batch_documents))""")


query("U1_batch_function", _BATCH_COLUMNS, "", _BATCH)(_batch_sql)


@query(
    "U1_job_outcomes",
    "job_id:s status:s error_code:s outputs:i",
    "",
    """SELECT CAST(doc_id // 20 AS VARCHAR) AS job_id,
    CASE WHEN bool_or(doc_id % 10 = 7) THEN 'failed' ELSE 'completed' END AS status,
    CASE WHEN bool_or(doc_id % 10 = 7) THEN 'PROCESSING_FAILED' END AS error_code,
    2 * count(*) FILTER (doc_id % 10 <> 7) AS outputs FROM documents GROUP BY 1""",
)
def _outcomes(t):
    return batchmap.job_outcomes(_batch(t))


@query("U2_similarity", "pair_id:i page_no:i ratio:f")
def _similarity(t):
    both = compare.paired_pages(t.doc_pages, _pairs(t))
    return both.withColumn("ratio", similarity("text_a", "text_b"))


@query("U3_remove_terms", "doc_id:i page_no:i n:i", "doc_pages",
       f"SELECT doc_id, page_no, length(text) AS n FROM ({_CLEAN})")
def _remove_terms(t):
    clean = redact.redact(t.doc_pages, _terms(t))
    return clean.withColumn("n", F.length("text"))


@query("U4_nfkc", "doc_id:i n:i digest:s", "",
       """SELECT doc_id, length(text) AS n, sha256(text) AS digest FROM (
       SELECT doc_id, nfc_normalize(text) AS text FROM documents)""")  # fmt: skip
def _nfkc(t):
    return t.raw("documents").select("doc_id", nfkc("text").alias("c")).select(
        "doc_id", F.length("c").alias("n"), F.sha2("c", 256).alias("digest")
    )
