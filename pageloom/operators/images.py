"""Join image references to accepted assets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions import dom
from pageloom.operators.skew import HOT_ROWS, hot_keys, salted_join
from pageloom.profile import CleanRules
from pageloom.session import stage
from pageloom.sources.assets import data_uri


def image_refs(pages: DataFrame, rules: CleanRules = CleanRules()) -> DataFrame:
    """(page_id, pre, img_url) for every image to embed, from pages with ``nodes``."""
    tasks = F.transform(
        F.filter("nodes", lambda n: dom.is_image_task(n, rules.lazy_class)),
        lambda n: F.struct(n["pre"].alias("pre"), dom.image_source(n).alias("img_url")),
    )
    return pages.select("page_id", F.inline(tasks))


def shown_assets(refs: DataFrame, accepted: DataFrame) -> DataFrame:
    """The assets that some page shows, staged with the hash of their content: (img_url, content_type, asset, content).

    ``accepted`` is encoded (img_url, data_uri) or, better, not yet (img_url, content_type,
    payload): then what nothing refers to is never hashed or encoded.
    """
    shown = accepted.join(refs.select("img_url").distinct(), "img_url", "left_semi")
    if "data_uri" in shown.columns:
        kind, content = F.lit(None).cast("string"), F.col("data_uri")
    else:
        kind, content = F.lower(F.coalesce("content_type", F.lit(""))), F.col("payload")
    return stage(shown.select("img_url", kind.alias("content_type"), F.sha2(content, 256).alias("asset"), content.alias("content")), "assets")


def one_per_url(shown: DataFrame) -> DataFrame:
    """(img_url, content_type, asset): of several assets with one URL the smallest type, then the smallest hash.

    Contents are neither read nor compared.
    """
    best = F.min(F.struct("content_type", "asset")).alias("best")
    return shown.groupBy("img_url").agg(best).select("img_url", "best.content_type", "best.asset")


def one_per_content(shown: DataFrame) -> DataFrame:
    """(asset, content): what several URLs share is moved and kept once."""
    return shown.select("asset", "content").dropDuplicates(["asset"])


def refs_to_assets(refs: DataFrame, shown: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Staged refs with ``content_type`` and ``asset``; refs without an accepted asset are dropped.

    An image that very many pages show makes its URL a hot key, hence the salted join.
    """
    return salted_join(refs, one_per_url(shown), "img_url", ["page_id", "pre"], hot_keys(refs, "img_url", hot_rows))


def with_uris(uses: DataFrame, shown: DataFrame, spread: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows with (content_type, asset) and a ``data_uri`` each; no two contents meet in one row."""
    joined = salted_join(uses, one_per_content(shown), "asset", spread, hot_keys(uses, "asset", hot_rows))
    encoded = dict(shown.dtypes)["content"] == "string"
    uri = F.col("content") if encoded else data_uri(F.col("content_type"), F.col("content"))
    return joined.withColumn("data_uri", uri).drop("content", "content_type", "asset")


def embed_refs(refs: DataFrame, accepted: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Refs with their ``data_uri``; refs without an accepted asset are dropped. ``refs`` should be staged."""
    shown = shown_assets(refs, accepted)
    return with_uris(refs_to_assets(refs, shown, hot_rows), shown, ["page_id", "pre"], hot_rows)


def assets_by_page(refs: DataFrame, shown: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(page_id, assets): node position -> name and type of its image; names are short, whatever the images weigh."""
    found = refs_to_assets(refs, shown, hot_rows)
    named = F.struct("pre", F.struct("asset", "content_type").alias("image"))
    return found.groupBy("page_id").agg(F.map_from_entries(F.collect_list(named)).alias("assets"))
