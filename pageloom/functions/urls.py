"""URL functions as native Column expressions (no Python at run time).

They are total: any string, and null, gives a value instead of an error.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.text import alternation, contains_any, strip
from pageloom.profile import DEFAULT_FILE_KEY, SiteProfile

# RFC 3986 appendix B, with the scheme held to its grammar. The same text works in RE2.
# Groups: 1 scheme, 2 //netloc, 3 netloc, 4 path and params, 5 query, 6 fragment.
SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?$"
# The same grammar, one part at a time: cheaper than all groups at once.
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?((?:[^?#]*/)?[^;/?#]*)"
_EDGE = "".join(map(chr, range(0x21)))  # controls and blanks before a URL


def _printable(url: Column) -> Column:
    """Without what browsers ignore: leading controls, tabs and line ends."""
    for ignored in "\t\r\n":  # a search each, which costs a quarter of translate()
        url = F.replace(url, F.lit(ignored), F.lit(""))
    return F.ltrim(url, F.lit(_EDGE))


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(_printable(url), SPLIT, group)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_printable(url), _SCHEME, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(_printable(url), _HOST, 1)


def path(url: Column) -> Column:
    """Path without the ``;params`` of its last segment."""
    return F.regexp_extract(_printable(url), _PATH, 1)


def params(url: Column) -> Column:
    return F.regexp_extract(_part(url, 4), r";([^/]*)$", 1)


def query(url: Column) -> Column:
    return _part(url, 5)


def fragment(url: Column) -> Column:
    return _part(url, 6)


def split_url(url: Column) -> Column:
    """struct(scheme, netloc, path, params, query, fragment)."""
    return F.struct(
        scheme(url).alias("scheme"),
        netloc(url).alias("netloc"),
        path(url).alias("path"),
        params(url).alias("params"),
        query(url).alias("query"),
        fragment(url).alias("fragment"),
    )


def ensure_scheme(url: Column) -> Column:
    """Trimmed, with https:// put in front when no http scheme is there; blank -> null."""
    trimmed = strip(url)
    return (
        F.when(trimmed == "", None)
        .when(trimmed.rlike("^https?://"), trimmed)
        .otherwise(F.concat(F.lit("https://"), trimmed))
    )


def allowed_domain(url: Column, profile: SiteProfile) -> Column:
    """The whole netloc, port and user included, is on the list."""
    return F.lower(netloc(url)).isin(*profile.domains)


def normalize(url: Column) -> Column:
    """Https, no query, fragment or params, no trailing slash."""
    return normalized(netloc(url), path(url))


def normalized(netloc_: Column, path_: Column) -> Column:
    return F.rtrim(F.concat(F.lit("https://"), netloc_, path_), F.lit("/"))


def link_parts(href: Column) -> dict[str, Column]:
    """What ``join_parts`` needs of an href: link, own (its scheme) and rest (the remainder,
    without empty params, query or fragment)."""
    link = strip(href)
    clean = _printable(link)
    rest = F.regexp_replace(clean, _SCHEME, "")
    tidy = F.regexp_replace(rest, r"^([^#]*)#$", "$1")
    tidy = F.regexp_replace(tidy, r"^([^?#]*)\?(?=#|$)", "$1")
    tidy = F.regexp_replace(tidy, r"^((?:[^?#]*/)?[^;/?#]*);(?=[?#]|$)", "$1")
    return {
        "link": link,
        "own": F.lower(F.regexp_extract(clean, _SCHEME, 1)),
        "rest": F.when(rest.rlike("[;?#]"), tidy).otherwise(rest),
    }


def join_parts(link: Column, own: Column, rest: Column, base_scheme: Column, base_netloc: Column) -> Column:
    root = F.concat(base_scheme, F.lit("://"), base_netloc)
    inner = F.regexp_replace(rest, "^//", "")  # only reached when no host follows
    return (
        F.when((link == "") | link.startswith("#"), None)
        .when((own != "") & (own != base_scheme), link)
        .when(rest.rlike("^//[^/?#]"), F.concat(base_scheme, F.lit(":"), rest))
        .when(inner.rlike(r"^(?:[^;?#]*/)?\.\.?(?:[/;?#]|$)"), F.concat(root, _without_dots(inner)))
        .when(inner.rlike("^(?:[/?#]|$)"), F.concat(root, inner))
        .otherwise(F.concat(root, F.lit("/"), _single_slashes(inner)))
    )


def _path_part(rest: Column) -> Column:
    """Up to the params, query or fragment."""
    return F.regexp_extract(rest, r"^(?:[^?#]*/)?[^;/?#]*", 0)


def _tail_part(rest: Column) -> Column:
    return F.regexp_replace(rest, r"^(?:[^?#]*/)?[^;/?#]*", "")


def _single_slashes(rest: Column) -> Column:
    """Slash runs shrink only in paths without a leading slash."""
    return F.concat(F.regexp_replace(_path_part(rest), "/+", "/"), _tail_part(rest))


def _without_dots(rest: Column) -> Column:
    """Fold "." and ".." segments."""
    path_ = _path_part(rest)
    rooted = F.when(path_.startswith("/"), path_).otherwise(F.concat(F.lit("/"), F.regexp_replace(path_, "/+", "/")))
    # A final dot segment stands for the folder: it leaves an empty last segment.
    segments = F.split(F.regexp_replace(rooted, r"(/\.\.?)$", "$1/"), "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, segment: F.when(
            segment == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        ).when(segment == ".", done).otherwise(F.concat(done, F.array(segment))),
    )
    # Going above the root loses the leading empty segment; the slash comes back here.
    return F.concat(F.regexp_replace(F.array_join(kept, "/"), "^/?", "/"), _tail_part(rest))


def resolve(href: Column, page_url: Column) -> Column:
    """U4: absolute form of ``href``; relative ones hang off the host root of the page.

    Blank hrefs and bare fragments give null.
    """
    return join_parts(**link_parts(href), base_scheme=scheme(page_url), base_netloc=netloc(page_url))


def site_url(url: Column, profile: SiteProfile) -> Column:
    """An http(s) URL of the site with something after the host."""
    return url.rlike(_one_line(profile.site_pattern))


def _one_line(pattern: str) -> str:
    # Only \n ends a line, as in the engine the patterns were written for.
    return "(?d)" + pattern


def outer_path(url: Column) -> Column:
    return _trim_slashes(path(url))


def _trim_slashes(path_: Column) -> Column:
    return F.trim(path_, F.lit("/"))


def is_listing_itself(url: Column, listing: Column) -> Column:
    """U8: same path as the listing, whatever host and query say."""
    return outer_path(url) == outer_path(listing)


def excluded(url: Column, profile: SiteProfile) -> Column:
    """Case-sensitive."""
    return url.rlike(alternation(profile.excluded_patterns))


def page_keyword_rejected(url: Column, profile: SiteProfile) -> Column:
    """Substring of the whole URL, query included."""
    return contains_any(F.lower(url), profile.page_keywords_rejected)


def listing_keyword_rejected(url: Column, profile: SiteProfile) -> Column:
    """U11."""
    return contains_any(F.lower(url), profile.listing_keywords_rejected)


def page_slug(url: Column, profile: SiteProfile) -> Column:
    """The path looks like a page rather than a listing."""
    return _slug_in(path(url), profile)


def _slug_in(path_: Column, profile: SiteProfile) -> Column:
    return path_.rlike("(?i)" + alternation(profile.page_indicators))


def subject_keywords(listing: Column, profile: SiteProfile = SiteProfile()) -> Column:
    """What the listing is about, from its path."""
    slug = outer_path(listing)
    without = [F.when(slug.endswith(s), F.left(slug, F.length(slug) - len(s))) for s in profile.subject_suffixes]
    slug = F.coalesce(*without, slug)  # the first that fits is dropped
    slug = F.regexp_replace(slug, r"^\p{Nd}+-", "")
    return F.filter(F.split(F.lower(slug), "-"), lambda word: word != "")


def on_topic(url: Column, keywords: Column | list[str]) -> Column:
    """At least half of the keywords (rounded down, one at least) are in the path."""
    return _topic_in(path(url), keywords)


def _topic_in(path_: Column, keywords: Column | list[str]) -> Column:
    lowered = F.lower(path_)
    if isinstance(keywords, Column):
        hits = F.size(F.filter(keywords, lambda word: lowered.contains(F.rtrim(word, F.lit("s")))))
        needed = F.greatest(F.lit(1), F.floor(F.size(keywords) / 2))
        return (F.size(keywords) == 0) | (hits >= needed)
    if not keywords:
        return F.lit(True)
    hits = sum((lowered.contains(word.rstrip("s")).cast("int") for word in keywords), F.lit(0))
    return hits >= max(1, len(keywords) // 2)


def _may_count(url: Column, path_: Column, listing: Column, keywords: Column | list[str], profile: SiteProfile) -> Column:
    """The tests that pages and listings share."""
    return (
        site_url(url, profile)
        & _topic_in(path_, keywords)
        & ~excluded(url, profile)
        & (_trim_slashes(path_) != outer_path(listing))
    )


def _page_tests(url: Column, netloc_: Column, path_: Column, profile: SiteProfile) -> Column:
    tests = _slug_in(path_, profile) & ~page_keyword_rejected(url, profile)
    return tests & F.lower(netloc_).isin(*profile.domains) if profile.domains else tests


def is_wanted_page(
    url: Column, listing: Column, profile: SiteProfile = SiteProfile(), keywords: list[str] | None = None
) -> Column:
    """Judged on the link as found, before normalizing."""
    known = subject_keywords(listing, profile) if keywords is None else keywords
    shared = _may_count(url, path(url), listing, known, profile)
    return F.coalesce(shared & _page_tests(url, netloc(url), path(url), profile), F.lit(False))


def is_listing(
    url: Column, listing: Column, profile: SiteProfile = SiteProfile(), keywords: list[str] | None = None
) -> Column:
    """U16: an on-topic page of the site worth following."""
    known = subject_keywords(listing, profile) if keywords is None else keywords
    shared = _may_count(url, path(url), listing, known, profile)
    return F.coalesce(shared & ~listing_keyword_rejected(url, profile), F.lit(False))


def classify(
    url: Column, netloc_: Column, path_: Column, listing: Column, keywords: Column | list[str], profile: SiteProfile
) -> Column:
    """U15 before U16 on a URL whose parts are at hand: 'page', 'listing' or null."""
    return F.when(
        _may_count(url, path_, listing, keywords, profile),
        F.when(_page_tests(url, netloc_, path_, profile), "page")
        .when(~listing_keyword_rejected(url, profile), "listing"),
    )


def requested(url: Column) -> Column:
    """What a fetch of ``url`` asks for: all but the fragment, which stays with the reader."""
    return F.substring_index(url, "#", 1)


def known_seed(spark: SparkSession, seed: str, profile: SiteProfile = SiteProfile()) -> str:
    """U1 and U2 of the listing to start from; one that is blank or off the list is refused."""
    full = ensure_scheme(F.lit(seed))
    row = spark.range(1).select(full.alias("full"), allowed_domain(full, profile).alias("allowed")).first()
    if row.full is None or (profile.domains and not row.allowed):
        raise ValueError(f"not a listing of {', '.join(profile.domains) or 'any site'}: {seed!r}")
    return row.full


def keyword_list(spark: SparkSession, listing: str, profile: SiteProfile = SiteProfile()) -> list[str]:
    """U13 of one listing, as literals for the expressions of a job."""
    return spark.range(1).select(subject_keywords(F.lit(listing), profile)).first()[0]


def _uncut(norm_url: Column) -> Column:
    """Without the ";" that ``path`` would cut at."""
    return F.replace(norm_url, F.lit(";"), F.lit("_"))  # cheaper than translate()


def may_be_wanted(norm_url: Column, profile: SiteProfile) -> Column:
    """True for every normalized URL that some wanted link can lead to (and few others).

    Normalizing only cuts a URL's tail, so slug and host survive it. Lets a scan of the
    stored pages drop the rest before anything is shuffled. What follows a ";" that is left
    belongs to the path, so it must not be cut a second time.
    """
    return site_url(F.concat(norm_url, F.lit("/x")), profile) & page_slug(_uncut(norm_url), profile)


def looks_like_page(norm_url: Column, profile: SiteProfile) -> Column:
    """True for a normalized URL that a link without query and fragment, if wanted, leads to as a page."""
    return F.coalesce(_page_tests(norm_url, netloc(norm_url), path(norm_url), profile), F.lit(False))


def may_be_listing(norm_url: Column, keywords: list[str], profile: SiteProfile) -> Column:
    """The same for links to listings: host, exclusions and topic survive normalizing."""
    loose = [word.rstrip("s/").replace(";", "_") for word in keywords]
    return F.coalesce(
        site_url(F.concat(norm_url, F.lit("/x")), profile)
        & on_topic(_uncut(norm_url), loose)
        & ~listing_keyword_rejected(norm_url, profile)
        & ~excluded(norm_url, profile),
        F.lit(False),
    )


def file_key(url: Column) -> Column:
    """The segment after the host, letters, digits, "-" and "_" only."""
    segment = F.get(F.split(url, "/"), F.lit(3))
    key = F.regexp_replace(F.coalesce(segment, F.lit("")), r"[^\p{L}\p{N}_\-]", "")
    return F.when(key == "", DEFAULT_FILE_KEY).otherwise(key)
