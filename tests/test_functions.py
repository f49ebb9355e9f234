"""Scalar functions against values worked out by hand."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foliometer.functions import filenames, filetypes, languages, measures, pages, text, traffic


def apply(frame, values, kind, expression):
    """Values of ``expression(column)`` for each of ``values``."""
    df = frame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [row[0] for row in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_user_agent(frame):
    agents = [
        None,
        "",
        "Mozilla/5.0 (Windows NT 10.0) Chrome/120 Safari/537 Edg/120",
        "Mozilla/5.0 (iPhone; CPU iPhone OS 17 like Mac OS X) CriOS/120 Mobile Safari",
        "Mozilla/5.0 (iPad; CPU OS 17 like Mac OS X) Version/17 Safari",
        "Mozilla/5.0 (Macintosh; Intel Mac OS X) FxiOS/1",
        "Mozilla/5.0 (Linux; Android 14; Tablet) OPR/80",
        "Dalvik/2.1 (Linux; Android 13)",
        "Windows on an iPod touch",
        "curl/8",
        "Something Safari Chromium",
    ]
    result = apply(frame, agents, "string", traffic.user_agent)
    assert [tuple(r) for r in result] == [
        ("Other", "Desktop", "Other"),
        ("Other", "Desktop", "Other"),
        ("Windows", "Desktop", "Edge"),
        ("iOS", "Mobile", "Chrome"),
        ("iOS", "Tablet", "Safari"),
        ("macOS", "Desktop", "Firefox"),
        ("Android", "Tablet", "Opera"),
        ("Android", "Tablet", "Other"),
        ("Windows", "Mobile", "Other"),
        ("Other", "Desktop", "Other"),
        ("Other", "Desktop", "Other"),
    ]


def test_country(frame):
    cases = [
        ("de-DE,de", None, "DE"),
        ("en-US;q=0.9,en", None, "US"),
        ("zh-Hant-TW", "", "TW"),
        ("fr", None, "US"),
        (None, None, "US"),
        ("de-AT", "ch", "CH"),
        (" pt-br ,pt", None, "BR"),
        ("de-", None, "US"),
    ]
    df = frame(cases, "a string, c string, e string")
    for row in df.select("e", traffic.country("a", "c").alias("got")).collect():
        assert row.got == row.e


def test_source_keeps_its_substring_rules(frame):
    cases = {
        None: "Direct",
        "": "Direct",
        "https://googleads.example": "Organic Search",
        "https://www.reddit.com/r": "Social Media",
        "https://microsoft.com": "Social Media",
        "https://github.io": "Referral",
        "https://ads.example": "Paid Ads",
        "https://example.org": "Referral",
    }
    assert apply(frame, list(cases), "string", traffic.source) == list(cases.values())


def test_explicit_source_wins(frame):
    df = frame([("Mail", "https://google.com"), ("", "https://google.com")], "s string, r string")
    got = [r[0] for r in df.select(traffic.visit_source("s", "r")).collect()]
    assert got == ["Mail", "Organic Search"]


def test_trend_labels(frame):
    moment = [datetime(2025, 1, 1, 12), datetime(2021, 1, 3), datetime(2024, 12, 31)]
    labels = {
        "weekly": ["Wk 1 (2024)", "Wk 53 (2020)", "Wk 1 (2024)"],
        "monthly": ["Jan 2025", "Jan 2021", "Dec 2024"],
        "yearly": ["2025", "2021", "2024"],
        "nonsense": ["Jan 01", "Jan 03", "Dec 31"],
    }
    for unit, expected in labels.items():
        label = lambda v, u=unit: measures.trend_label(measures.trend_bucket(v, u), u)
        assert apply(frame, moment, "timestamp", label) == expected


def test_growth_and_share(spark):
    got = spark.range(1).select(
        measures.growth_pct(F.lit(3), F.lit(0)),
        measures.growth_pct(F.lit(1), F.lit(3)),
        measures.share_pct(F.lit(1), F.lit(400)),
        measures.share_pct(F.lit(0), F.lit(0), 100.0),
    )
    assert tuple(got.first()) == (0.0, -66.7, 0.3, 100.0)


def test_human_size(frame):
    sizes = [0, 512, 1023, 1024, 1280, 1792, 1536 * 1024, 5 * 1024**3, 3 * 1024**5]
    assert apply(frame, sizes, "bigint", measures.human_size) == [
        "0 B", "512 B", "1023 B", "1.0 KB", "1.2 KB", "1.8 KB", "1.5 MB", "5.0 GB", "3072.0 TB",
    ]


NAMES = {
    "report.pdf": "report.pdf",
    "../../etc/passwd": "passwd",
    "C:\\Users\\x\\doc.pdf": "doc.pdf",
    'a<b>:c".pdf': "a_b__c_.pdf",
    "CON.pdf": "CON_.pdf",
    "con": "con_",
    "": "file",
    "...": "file",
    "dir/": "dir",
    "a" * 500 + ".pdf": "a" * 196 + ".pdf",
    "a" * 500: "a" * 200,
    "ﬁle①.pdf": "file1.pdf",
    "x." + "y" * 250: "file." + "y" * 250,
    "tab\tname.txt": "tab_name.txt",
}


def test_sanitize_filename(frame):
    assert apply(frame, list(NAMES), "string", filenames.sanitize_filename) == list(NAMES.values())


def test_extension_and_stem(frame):
    names = ["Report.PDF", "README", "some.dir/file.docx", ".bashrc", "a.tar.gz", "x.", "C:\\a.B"]
    extensions = ["pdf", "", "docx", "", "gz", "", "b"]
    assert apply(frame, names, "string", filenames.file_extension) == extensions
    stems = ["Report", "README", "file", ".bashrc", "a.tar", "x.", "C:\\a"]
    assert apply(frame, names, "string", filenames.file_stem) == stems


def test_slugify(frame):
    df = frame([("  Hello, World! ", 1), ("ÄÖ", 2)], "v string, k int")
    slugs = [r[0] for r in df.orderBy("k").select(text.slugify("v", "k")).collect()]
    assert slugs[0] == "hello-world"
    assert len(slugs[1]) == 8


def test_fingerprint_without_frame(spark):
    import hashlib

    got = spark.range(1).select(
        text.error_fingerprint(F.lit("E"), F.lit("a.py"), F.lit("f")),
        text.error_fingerprint(F.lit("E"), F.lit(None).cast("string"), F.lit(None).cast("string")),
    )
    assert tuple(got.first()) == tuple(
        hashlib.sha256(raw).hexdigest()[:32] for raw in (b"E:a.py:f", b"E:")
    )


HEADS = [
    ("a.pdf", b"junk%PDF-1.4", ("application/pdf", None)),
    ("a.pdf", b"x" * 1020 + b"%PDF-", (None, "corrupted")),
    ("a.doc", b"PK\x03\x04rest", ("application/msword", None)),
    ("a.PNG", b"\x89PNG\r\n\x1a\n", ("image/png", None)),
    ("a.jpg", b"\x89PNG\r\n\x1a\n", (None, "corrupted")),
    ("a.exe", b"MZ", (None, "unsupported")),
    ("noextension", b"%PDF-", (None, "unsupported")),
    ("a.pdf", None, (None, "corrupted")),
]


def test_sniff(frame):
    df = frame([(i, n, h) for i, (n, h, _) in enumerate(HEADS)], "i int, n string, h binary")
    got = df.orderBy("i").select(filetypes.sniff("n", "h").alias("r")).select("r.*").collect()
    assert [tuple(row) for row in got] == [expected for _, _, expected in HEADS]
    only_images = df.orderBy("i").select(filetypes.sniff("n", "h", {"png"})["error"]).collect()
    assert [row[0] for row in only_images].count("unsupported") == 7


def test_check_attachment(frame):
    cases = [
        ("image/png", b"\x89PNG\r\n\x1a\nx", None),
        ("IMAGE/JPEG; q=1", b"\xff\xd8\xffx", None),
        ("image/webp", b"RIFF0000WEBPx", None),
        ("image/webp", b"RIFF0000WAVEx", "not_an_image"),
        ("text/plain", b"x", "unsupported_type"),
        ("image/png", b"", "empty"),
        ("image/png", b"\x89PNG\r\n\x1a\n" + b"0" * 1048576, "too_large"),
        ("image/png", b"MZ", "not_an_image"),
        (None, b"x", "unsupported_type"),
    ]
    df = frame(cases, "t string, d binary, e string")
    for row in df.select("e", filetypes.check_attachment("t", "d").alias("got")).collect():
        assert row.got == row.e


def test_plan_limits(frame):
    plans = [None, "free", "PRO", "basic", "enterprise", "gold"]
    got = apply(frame, plans, "string", measures.plan_limits)
    assert [r.max_files for r in got] == [20, 20, 100, 50, 100, 20]
    assert got[0].max_total_bytes == 50 * 1024 * 1024


SELECTIONS = [
    ("1,3-5", 10, [1, 3, 4, 5], None),
    ("1,7", 3, None, "out_of_range"),
    ("a-b", 3, None, "invalid"),
    ("5-3", 9, None, "empty"),
    ("5-3,2", 9, [2], None),
    (" 2 , 2 ", 2, [2, 2], None),
    (",", 5, None, "empty"),
    ("1-", 5, None, "invalid"),
    ("1-2-3", 5, None, "invalid"),
    ("0", 5, None, "out_of_range"),
    ("1-999999999999", 5, None, "out_of_range"),
]


def test_page_selection(frame):
    df = frame([(i, s, t) for i, (s, t, _, _) in enumerate(SELECTIONS)], "i int, s string, t int")
    rows = df.orderBy("i").select(pages.select_pages("s", "t"), pages.selection_error("s", "t"))
    assert [tuple(r) for r in rows.collect()] == [(p, e) for _, _, p, e in SELECTIONS]


def test_out_of_range_pages(spark):
    df = spark.range(1).select(pages.out_of_range_pages(F.lit("0-1,7,9-8,6-7"), F.lit(5)))
    assert df.first()[0] == [0, 6, 7]


@pytest.mark.parametrize(
    ("mode", "ranges", "expected"),
    [
        ("all", None, [1, 2, 3, 4]),
        ("all", "2-3", [2, 3]),
        ("first", "2", [1]),
        ("last", None, [4]),
        ("odd", None, [1, 3]),
        ("even", None, [2, 4]),
        ("custom", "1,3-9", [1, 3, 4]),
        ("custom", "", [1, 2, 3, 4]),
    ],
)
def test_page_matches(spark, mode, ranges, expected):
    df = spark.range(1, 5).select(F.col("id").alias("page"), F.lit(4).alias("total"))
    chosen = df.filter(pages.page_matches(mode, ranges, "page", "total"))
    assert sorted(r.page for r in chosen.collect()) == expected


def test_template_replaces_in_order(spark):
    line = pages.fill_template(
        "{filename}/{page}", F.lit(3), F.lit(9), "2024-05-06 07:08:09", F.lit("{page}")
    )
    dated = pages.fill_template("{date} {time} {total}", F.lit(3), F.lit(9), "2024-05-06 07:08:09")
    assert tuple(spark.range(1).select(line, dated).first()) == ("{page}/3", "2024-05-06 07:08 9")


def test_language_list(frame):
    cases = {"eng": None, "eng+eng": "duplicate", "xyz": "unsupported",
             "eng+deu+fra+spa+ita": "too_many", "chi_sim+eng": None}
    assert apply(frame, list(cases), "string", languages.language_list_error) == list(cases.values())


def test_script(frame):
    cases = {
        "hello": "Latin", "123 ...": None, "Привет, world": "Cyrillic", "漢字かな": "Han",
        "한국어": "Hangul", "été": "Latin", "naïve “quote”": "Latin", "": None,
    }
    assert apply(frame, list(cases), "string", languages.script) == list(cases.values())


def test_compact_and_email(frame):
    assert apply(frame, ["A b\u00a0C\u2003\n\x1cd"], "string", text.compact) == ["abcd"]
    assert apply(frame, [" \tA@B.c \n"], "string", text.normal_email) == ["a@b.c"]


def test_client_ip(frame):
    df = frame([("1.2.3.4, 5.6.7.8", "9"), ("", "9"), (None, None)], "f string, p string")
    assert [r[0] for r in df.select(text.client_ip("f", "p")).collect()] == ["1.2.3.4", "9", None]


def test_progress(frame):
    assert apply(frame, [-5, 40, 140], "int", measures.clamp_progress) == [0, 40, 100]
    step = lambda v: measures.step_progress(v, F.lit(3))
    assert apply(frame, [1, 2, 3], "int", step) == [30, 60, 90]


def test_scrub_options(spark):
    options = F.create_map(F.lit("password"), F.lit("x"), F.lit("mode"), F.lit("y"))
    got = spark.range(1).select(text.scrub_options(options, ["password"])).first()[0]
    assert got == {"password": "[redacted]", "mode": "y"}
