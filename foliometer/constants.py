"""Fixed values shared by the operators.

Everything in this module is a literal the product data depends on: status
names and their order, plan ceilings, thresholds, word lists, the tool
catalogue. They are plain data, kept together and in natural order.
"""

from __future__ import annotations

# --- Fixed values: lifecycle and enumeration names ---------------------------
# Declaration order is also the sort order of the enumeration columns.
JOB_STATUSES = ("pending", "queued", "processing", "completed", "failed", "cancelled", "expired")
TERMINAL_STATUSES = ("completed", "failed", "cancelled", "expired")
EXPIRABLE_STATUSES = ("completed", "failed", "cancelled")

# --- Fixed values: feedback ---------------------------------------------------
FEEDBACK_LABELS = {
    "general": "General Feedback",
    "bug": "Bug Report",
    "feature": "Feature Request",
    "ui_ux": "UI/UX Suggestion",
    "performance": "Performance Issue",
    "other": "Other",
}
FEEDBACK_PER_DAY = 1
ATTACHMENT_MAX_BYTES = 1024 * 1024
ATTACHMENT_NAME_LENGTH = 255

# --- Fixed values: retention and limits ---------------------------------------
RETENTION_HOURS = 24
SCRATCH_MAX_AGE_MINUTES = 120
LIVE_WINDOW_MINUTES = 15
# Levels of objects that settings and their overrides may share; 60 overflow the planner's stack.
SETTINGS_DEPTH = 40
EVENT_FEED_CAP = 600
PROGRESS_CEILING = 90
ERROR_MESSAGE_LENGTH = 500
ERROR_STACK_LENGTH = 8000

# --- Fixed values: plan ceilings (files, MB per file, MB in total) -------------
PLAN_LIMITS = {
    "free": (20, 50, 50),
    "basic": (50, 500, 500),
    "pro": (100, 1024, 1024),
    "enterprise": (100, 1024, 1024),
}
DEFAULT_PLAN = "free"
MEGABYTE = 1024 * 1024

# --- Fixed values: file types (extension, media type, signature family) --------
SNIFF_BYTES = 1024
FILE_TYPES = (
    ("pdf", "application/pdf", "pdf"),
    ("doc", "application/msword", "office"),
    ("docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "office"),
    ("xls", "application/vnd.ms-excel", "office"),
    ("xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "office"),
    ("ppt", "application/vnd.ms-powerpoint", "office"),
    ("pptx", "application/vnd.openxmlformats-officedocument.presentationml.presentation", "office"),
    ("jpg", "image/jpeg", "jpeg"),
    ("jpeg", "image/jpeg", "jpeg"),
    ("png", "image/png", "png"),
)
# Leading bytes, in hexadecimal.
ZIP_SIGNATURE = "504B0304"
OLE2_SIGNATURE = "D0CF11E0A1B11AE1"
JPEG_SIGNATURE = "FFD8FF"
PNG_SIGNATURE = "89504E470D0A1A0A"
RIFF_SIGNATURE = "52494646"
WEBP_MARK = "57454250"
PDF_MARK = "%PDF-"

# --- Fixed values: file names --------------------------------------------------
FILENAME_LENGTH = 200
RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL") + tuple(
    f"{port}{number}" for port in ("COM", "LPT") for number in range(1, 10)
)

# --- Fixed values: traffic classification --------------------------------------
# (label, any of these substrings, none of these substrings); first match wins.
OS_RULES = (
    ("Windows", ("windows",), ()),
    ("macOS", ("macintosh", "mac os x"), ("ipad", "iphone")),
    ("iOS", ("macintosh", "mac os x"), ()),
    ("Android", ("android",), ()),
    ("iOS", ("iphone", "ipad", "ipod"), ()),
    ("Linux", ("linux",), ()),
)
DEVICE_RULES = (
    ("Mobile", ("mobi", "iphone", "ipod"), ()),
    ("Tablet", ("ipad", "tablet", "playbook", "kindle", "android"), ()),
)
BROWSER_RULES = (
    ("Opera", ("opera", "opr/"), ()),
    ("Edge", ("edge", "edg/"), ()),
    ("Chrome", ("chrome", "crios"), ()),
    ("Firefox", ("firefox", "fxios"), ()),
    ("Safari", ("safari",), ("chromium",)),
)
SOURCE_RULES = (
    ("Organic Search", ("google",), ()),
    ("Social Media", ("facebook", "t.co", "twitter", "instagram", "linkedin"), ()),
    ("Referral", ("github", "reddit"), ()),
    ("Paid Ads", ("ads",), ()),
)
DIRECT_SOURCE = "Direct"
OTHER_SOURCE = "Referral"
DEFAULT_COUNTRY = "US"
VISIT_LENGTHS = {
    "visitor_id": (1, 64, True),
    "session_id": (1, 64, True),
    "path": (1, 512, True),
    "referrer": (0, 512, False),
    "source": (0, 64, False),
}
RANKED_DIMENSIONS = ("path", "browser", "device", "os", "country", "source")
RANKING_SIZE = 7

# --- Fixed values: option patterns ---------------------------------------------
PAGE_SELECTION_PATTERN = r"^\s*\d+(\s*-\s*\d+)?(\s*,\s*\d+(\s*-\s*\d+)?)*\s*$"
PAGE_RANGE_PATTERN = r"^\d+(-\d+)?(,\d+(-\d+)?)*$"
COLOR_PATTERN = r"^#[0-9a-fA-F]{6}$"
AREA_MODES = ("black", "white", "color", "blur", "pixelate")

# --- Fixed values: repeated-mark thresholds -------------------------------------
OPAQUE = 0.999
DIAGONAL_TOLERANCE = 2.5
MARK_TEXT_MIN = 2
MARK_TEXT_MAX = 80
STRONG_DIAGONAL_SIZE = 24.0
STRONG_ALPHA_SIZE = 30.0
TILE_COUNT = 3
IMAGE_BIG_RATIO = 0.15
IMAGE_MAX_RATIO = 0.9
MARK_LIMIT = 8

# --- Fixed values: document comparison -------------------------------------------
UNCHANGED_RATIO = 0.999
DIFF_LINES = 20

# --- Fixed values: languages -----------------------------------------------------
LANGUAGES = (
    "eng", "ara", "chi_sim", "chi_tra", "deu", "ell", "fra", "heb", "hin", "ita", "jpn",
    "kor", "nld", "pol", "por", "rus", "spa", "tha", "tur", "urd", "vie",
)
MAX_LANGUAGES = 4
MIN_WORDS = 10
MIN_STOPWORD_HITS = 4
ENGLISH_MARGIN = 1.5
SAMPLE_PAGES = 2
# Script of a page -> language pack.
SCRIPT_LANGUAGES = {
    "Arabic": "ara",
    "Cyrillic": "rus",
    "Devanagari": "hin",
    "Greek": "ell",
    "Hebrew": "heb",
    "Thai": "tha",
    "Han": "chi_sim+chi_tra",
    "HanS": "chi_sim",
    "HanT": "chi_tra",
    "HanS_vert": "chi_sim",
    "HanT_vert": "chi_tra",
    "Japanese": "jpn",
    "Japanese_vert": "jpn",
    "Katakana": "jpn",
    "Hiragana": "jpn",
    "Hangul": "kor",
    "Hangul_vert": "kor",
}
# Script names that can be told from characters alone, in tie-break order.
CHARACTER_SCRIPTS = (
    "Latin", "Arabic", "Cyrillic", "Devanagari", "Greek", "Hebrew", "Thai", "Han",
    "Katakana", "Hiragana", "Hangul",
)
# Frequent words per Latin-script language; the order of the languages breaks ties.
STOPWORDS = {
    "eng": "the and was are this that with from have been will your which their would there",
    "deu": "der die das und ist nicht mit ein eine für auf den dem sie wir werden wurde bitte "
    "sind einen oder auch beim über",
    "fra": "les des est une dans pour que qui avec sur pas nous vous être par cette aux ont été "
    "plus votre",
    "spa": "los las una para con por del como más pero sus este esta hay muy fue entre también "
    "usted",
    "ita": "gli che per sono della delle una questo questa anche più nel alla degli come sia "
    "stato essere",
    "por": "uma para com não por dos das mais este esta são você está foi como pelo seus também",
    "nld": "het een van dat niet met voor aan zijn deze ook naar wordt worden bij als maar door "
    "onze",
    "pol": "nie się jest że jak ale przez dla tego oraz jego były został które można bardzo",
    "tur": "bir bu için ile olarak daha çok gibi olan kadar sonra ancak değil var tarafından",
    "vie": "của và các cho không được người trong những này với ngày chúng tôi",
}

# --- Fixed values: tool catalogue (slug, display name, category, MB limit) --------
TOOL_CATALOGUE = (
    ("merge", "Merge PDF", "Organize", 100),
    ("split", "Split PDF", "Organize", 100),
    ("rotate", "Rotate PDF", "Organize", 100),
    ("delete-pages", "Delete Pages", "Organize", 100),
    ("extract-pages", "Extract Pages", "Organize", 100),
    ("reorder", "Reorder Pages", "Organize", 100),
    ("compress", "Compress PDF", "Optimize", 100),
    ("compress-scanned", "Compress Scanned", "Optimize", 100),
    ("ocr", "OCR PDF", "Optimize", 50),
    ("repair", "Repair PDF", "Optimize", 100),
    ("pdf-to-word", "PDF to Word", "Convert", 100),
    ("word-to-pdf", "Word to PDF", "Convert", 100),
    ("excel-to-pdf", "Excel to PDF", "Convert", 100),
    ("ppt-to-pdf", "PowerPoint to PDF", "Convert", 100),
    ("pdf-to-jpg", "PDF to JPG", "Convert", 100),
    ("pdf-to-png", "PDF to PNG", "Convert", 100),
    ("jpg-to-pdf", "JPG to PDF", "Convert", 100),
    ("png-to-pdf", "PNG to PDF", "Convert", 100),
    ("editor", "PDF Editor", "Edit", 100),
    ("watermark", "Add Watermark", "Edit", 100),
    ("remove-watermark", "Remove Watermark", "Edit", 100),
    ("header-footer", "Header & Footer", "Edit", 100),
    ("page-numbers", "Page Numbers", "Edit", 100),
    ("metadata", "Edit Metadata", "Edit", 100),
    ("compare", "Compare PDF", "Edit", 100),
    ("fill-forms", "Fill Forms", "Edit", 100),
    ("protect", "Protect PDF", "Security", 100),
    ("unlock", "Unlock PDF", "Security", 100),
    ("redact", "Redact PDF", "Security", 100),
    ("sign", "Sign PDF", "Security", 50),
)
