"""URL filters: rules by host and path, then a blocked Bloom filter of listed URLs before an exact hash join.

The list is reduced to distinct canonical URLs. Each sets one bit in each of the eight 64-bit words of one
block; the blocks are a table that is broadcast, as their number is bounded whatever the length of the list.
Pages whose bits are all set go on to a join by the canonical URL itself, which removes false positives; the
others are answered without moving. A list too long for the bound fills the filter, so that more pages take
the join; no answer changes.

Defined results: a null URL or one without ``://`` has an empty host and path, no rule and no listing. Rows
with one id or one URL are judged one by one. Without listed URLs only the rules can block. Columns of the
tables that are not named are left alone.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.bind import bind
from pageloom.llm.bloom import MAX_BLOCKS, blocks_for, bloom_filter, possible
from pageloom.operators.skew import HOT_ROWS, hot_keys, salted_join
from pageloom.session import stage

# Query parameters that tell where a visitor came from, not which page is meant.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|\z)"


@dataclass(frozen=True)
class Rule:
    """Fits the host and all its subdomains where the path starts with ``path``."""

    verdict: str  # allow or block
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    return F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + F.lit(3)))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def canonical(rest: Column) -> Column:
    """One form for the addresses of one page, from what follows the scheme.

    Scheme, default ports, closing slashes, fragment and tracking parameters go; the other parameters are sorted.
    """
    host = F.regexp_replace(lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), r":(80|443)\z", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), r"/+\z", "")
    asked = F.split(F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_sort(F.filter(asked, lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def addressed(pages: DataFrame, url_col: str, keep: Sequence[Column] = ()) -> DataFrame:
    """(host, path, canonical) of every row."""
    rest = bind(pages.select(*keep, F.col(url_col).alias("url")), rest=after_scheme(F.col("url")))
    parts = {"host": F.regexp_extract("rest", "^[^/?#]*", 0), "path": F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1)}
    named = {"host": F.coalesce(lower_ascii(parts["host"]), F.lit("")), "path": F.coalesce(parts["path"], F.lit(""))}
    return bind(rest, **named, canonical=canonical(F.col("rest"))).drop("url", "rest")


def fitting(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """(rule, verdict) of the longest rule that fits, else null; of two equally long ones a longer host, then block."""
    struct = "struct<rule: string, verdict: string>"
    found = []
    for rule in sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.verdict != "block", r.name)):
        on_host = (host == rule.host) | host.endswith(f".{rule.host}")
        found.append(F.when(on_host & path.startswith(rule.path), F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))))
    return F.coalesce(*found, F.lit(None).cast(struct))


def judge(
    pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = (), id_col: str = "page_id", url_col: str = "url", listed_col: str = "url",
    max_blocks: int = MAX_BLOCKS, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(id, host, path, rule, verdict, listed): a row per page; ``listed`` whatever the rules say.

    A rule's verdict stands; where none fits, a listed page is blocked and any other allowed.
    """
    known = stage(addressed(listed, listed_col).select("canonical").filter("canonical IS NOT NULL").distinct(), "listed")
    n_blocks = blocks_for(known.count(), max_blocks)
    bloom = stage(bloom_filter(known, "canonical", n_blocks), "bloom")
    rows = addressed(pages, url_col, keep=[F.col(id_col).alias("asked_id")])
    told = bind(rows, fits=fitting(rules, F.col("host"), F.col("path")))
    asked = possible(told.select("asked_id", "host", "path", "canonical", "fits.rule", "fits.verdict"), "canonical", bloom, n_blocks)
    hits = stage(asked.filter("possible").drop("possible"), "possible-hits")
    # A URL that very many pages have is one hot key of the join; it is cut into shares.
    hits = hits.withColumn("place", F.monotonically_increasing_id())
    checked = salted_join(hits, known.withColumn("listed", F.lit(True)), "canonical", ["place"], hot_keys(hits, "canonical", hot_rows), "left")
    answered = asked.filter("NOT possible").withColumn("listed", F.lit(False))
    columns = ["asked_id", "host", "path", "rule", "verdict", F.coalesce("listed", F.lit(False)).alias("listed")]
    both = answered.select(*columns).unionByName(checked.select(*columns))
    verdict = F.coalesce("verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return both.select(F.col("asked_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "listed")
