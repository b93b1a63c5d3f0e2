"""Site settings: which URLs belong to the corpus and what to strip from a page.

Both classes are plain frozen values. Every field ends up as a literal inside a
Column expression, so another site is served by another instance.
"""

from __future__ import annotations

from dataclasses import dataclass

# --------------------------------------------------------------------------
# Fixed values. Results are only right when these equal the published rules.
# --------------------------------------------------------------------------
DOMAINS = ("sanfoundry.com", "www.sanfoundry.com")
SITE_PATTERN = r"(?i)^https?://(www\.)?sanfoundry\.com/.+$"

EXCLUDED_PATTERNS = (
    r".*/(best-reference-books|mcq-pdf-download).*",
    r".*/category/.*",
    r".*/tag/.*",
    r".*/author/.*",
    r".*/certification.*",
    r".*/internship.*",
    r".*/jobs.*",
    r".*/training.*",
    r".*/contests.*",
    r".*/bootcamp.*",
    r".*/programs.*",
    r".*/videos.*",
    r".*/c-programming-examples.*",
    r".*/cpp-programs.*",
    r".*/java-programming-examples.*",
    r".*/python-problems-solutions.*",
    r".*/csharp-programming-examples.*",
    r".*-algorithms-problems-programming.*",
    r".*-programming-examples-data-structures.*",
    r".*/1000-(mathematics|physics|chemistry|biology|class-\d+).*",
    r".*/quantitative-aptitude.*",
    r".*/data-interpretation.*",
    r".*/logical-reasoning.*",
    r".*/english-grammar.*",
    r".*/(civil|mechanical|chemical|metallurgical|mining|instrumentation|"
    r"agricultural|marine|mechatronics|aerospace|aeronautical|"
    r"biotechnology)-engineering.*",
)
PAGE_KEYWORDS_REJECTED = (
    "privacy-policy", "terms-of-service", "contact", "about", "login", "register",
    "wp-admin", "wp-content", "sitemap", "feed", "xmlrpc",
)
LISTING_KEYWORDS_REJECTED = (
    "privacy-policy", "terms-of-service", "contact", "about", "login", "register",
    "wp-admin", "wp-content", "sitemap",
)
PAGE_INDICATORS = (
    r".*-questions-answers.*",
    r".*-mcqs?-.*",
    r".*-mcq-.*",
    r".*-multiple-choice.*",
    r".*-objective-questions.*",
)
SUBJECT_SUFFIXES = (
    "-questions-answers",
    "-mcq-multiple-choice-questions",
    "-interview-questions",
    "-objective-questions",
)
LINK_ROOTS = (
    ("div", "class", "entry-content"),
    ("div", "class", "inside-article"),
    ("article", None, None),
    ("div", "id", "content"),
    ("main", None, None),
)
CLEAN_ROOTS = (
    ("div", "class", "entry-content"),
    ("article", None, None),
    ("main", None, None),
    ("body", None, None),
)
MAX_CRAWL_DEPTH = 3
MAX_ATTEMPTS = 3
CHALLENGE_TITLE = "Just a moment"
DEFAULT_FILE_KEY = "mcq"
BUNDLE_PREFIX = "Sanfoundry_Merged_"
BUNDLE_TIME_FORMAT = "yyyyMMdd_HHmmss"

REMOVED_TAGS = ("script", "a", "noscript", "iframe", "form")
PROTECTED_TAGS = ("br", "img")
REMOVED_IDS = ("sf-video-ads", "comments", "respond")
REMOVED_CLASSES = (
    "mobile-content",
    "desktop-content",
    "sf-nav-bottom",
    "sf-desktop-ads",
    "sf-mobile-ads",
    "sf-video-yt",
    "sf-post-footer",
    "sf-post-content-category",
    "collapseomatic",
    "advertisement",
    "social-share",
)
REMOVED_TEXT_PREFIXES = (
    "Sanfoundry Global Education",
    "To practice",
    "Participate in",
    "to get free Certificate",
    "advertisement",
    "Next steps",
    "Manish Bhojasia",
)
ATTRIBUTE_TAGS = ("img", "table", "tr", "td", "th")
LAZY_CLASS = "lazyload"
MATH_MARKER = "mathjax"
IMAGE_TYPES = ("image/jpeg", "image/png", "image/gif", "image/webp")
MAX_IMAGE_BYTES = 10 * 1024 * 1024

PAGE_STYLE = """
        * {
            font-family: Arial, Helvetica, sans-serif !important;
        }
        body {
            margin: 20px;
            line-height: 1.6;
        }
        img {
            max-width: 100%;
            height: auto;
        }
        table {
            border-collapse: collapse;
            width: 100%;
        }
        td, th {
            border: 1px solid #ddd;
            padding: 8px;
        }
    """
POLYFILL_URL = "https://polyfill.io/v3/polyfill.min.js?features=es6"
MATH_CONFIG = "MathJax.Hub.Config({CommonHTML: {scale: 200}});"
MATH_LIBRARY_URL = (
    "https://cdnjs.cloudflare.com/ajax/libs/mathjax/2.7.7/MathJax.js?config=TeX-MML-AM_CHTML"
)
# ------------------------------ end of fixed values ------------------------


@dataclass(frozen=True)
class SiteProfile:
    """What counts as a page of the corpus, and how far to follow links."""

    domains: tuple[str, ...] = DOMAINS
    site_pattern: str = SITE_PATTERN
    excluded_patterns: tuple[str, ...] = EXCLUDED_PATTERNS
    page_keywords_rejected: tuple[str, ...] = PAGE_KEYWORDS_REJECTED
    listing_keywords_rejected: tuple[str, ...] = LISTING_KEYWORDS_REJECTED
    page_indicators: tuple[str, ...] = PAGE_INDICATORS
    subject_suffixes: tuple[str, ...] = SUBJECT_SUFFIXES
    # Tried in order; an empty tuple means "take links from the whole page".
    link_roots: tuple[tuple, ...] = LINK_ROOTS
    max_depth: int = MAX_CRAWL_DEPTH


@dataclass(frozen=True)
class CleanRules:
    """What survives of a page."""

    roots: tuple[tuple, ...] = CLEAN_ROOTS
    removed_tags: tuple[str, ...] = REMOVED_TAGS
    protected_tags: tuple[str, ...] = PROTECTED_TAGS
    removed_ids: tuple[str, ...] = REMOVED_IDS
    removed_classes: tuple[str, ...] = REMOVED_CLASSES
    removed_text_prefixes: tuple[str, ...] = REMOVED_TEXT_PREFIXES
    attribute_tags: tuple[str, ...] = ATTRIBUTE_TAGS
    lazy_class: str = LAZY_CLASS
    math_marker: str = MATH_MARKER
    challenge_title: str = CHALLENGE_TITLE
    # Source of the script that reports finished math; the tag is left out when None.
    math_hook_src: str | None = None
    # Source of the compatibility script in documents with math; no tag when None.
    polyfill_url: str | None = POLYFILL_URL
    # Put between the stripped text pieces of clean_text.
    text_separator: str = ""
