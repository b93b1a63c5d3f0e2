"""H1: the one Python stage. Pages in, pages with a ``nodes`` array out.

The nodes stay in one array per page, so picking the content root, the title, the
links or the images needs no shuffle. ``node_table`` unfolds them into rows.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.operators import htmltree
from pageloom.operators.htmltree import NodeColumns, number_page

# Both modules travel with the plan; executors need no copy of this package.
cloudpickle.register_pickle_by_value(htmltree)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODE_TYPE = T.StructType([
    T.StructField("pre", T.IntegerType()),
    T.StructField("last", T.IntegerType()),
    T.StructField("parent", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text", T.StringType()),
])
NODES_PER_BATCH = 50_000


def _node_arrays(columns: NodeColumns, offsets: list, valid: list) -> pa.Array:
    attrs = pa.MapArray.from_arrays(
        pa.array(columns.attr_offsets, pa.int32()),
        pa.array(columns.attr_names, pa.string()),
        pa.array(columns.attr_values, pa.string()),
    )
    nodes = pa.StructArray.from_arrays(
        [
            pa.array(columns.pre, pa.int32()),
            pa.array(columns.last, pa.int32()),
            pa.array(columns.parent, pa.int32()),
            pa.array(columns.depth, pa.int32()),
            pa.array(columns.kind, pa.string()),
            pa.array(columns.tag, pa.string()),
            attrs,
            pa.array(columns.text, pa.string()),
        ],
        names=["pre", "last", "parent", "depth", "kind", "tag", "attrs", "text"],
    )
    mask = pa.array([not ok for ok in valid])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), nodes, mask=mask)


def _parse_batches(kept: Sequence[str], html_column: str, tags: frozenset[str] | None = None):
    def emit(batch, start, stop, columns, offsets, errors):
        arrays = [batch.column(name).slice(start, stop - start) for name in kept]
        arrays.append(_node_arrays(columns, offsets, [e is None for e in errors]))
        arrays.append(pa.array([e or None for e in errors], pa.string()))
        return pa.RecordBatch.from_arrays(arrays, names=[*kept, "nodes", "parse_error"])

    def parse(batches):
        for batch in batches:
            pages = batch.column(html_column)
            start, columns, offsets, errors = 0, NodeColumns(), [0], []
            for i in range(len(pages)):
                size = len(columns)
                error = None
                html = pages[i].as_py()
                if html is None:
                    error = ""  # nothing stored: no nodes, yet not a parse failure
                else:
                    try:
                        number_page(html, columns)
                        if tags is not None:
                            columns.keep_tags(size, tags)
                    except Exception as problem:  # one bad page must not fail the task
                        columns.truncate(size)
                        error = f"{type(problem).__name__}: {problem}"
                offsets.append(len(columns))
                errors.append(error)
                if len(columns) >= NODES_PER_BATCH:
                    yield emit(batch, start, i + 1, columns, offsets, errors)
                    start, columns, offsets, errors = i + 1, NodeColumns(), [0], []
            if errors:
                yield emit(batch, start, len(pages), columns, offsets, errors)

    return parse


def parse_pages(
    pages: DataFrame, keep: Sequence[str] = ("page_id", "url"), html: str = "html", tags: frozenset[str] | None = None
) -> DataFrame:
    """Add ``nodes`` and ``parse_error``; only ``keep`` and the html go to Python.

    A page without html, or one that fails to parse, gets null nodes. Given ``tags``, only their
    elements come back, at the positions that they have among all nodes.
    """
    narrow = pages.select(*keep, html)
    schema = T.StructType(
        [narrow.schema[name] for name in keep]
        + [
            T.StructField("nodes", T.ArrayType(NODE_TYPE)),
            T.StructField("parse_error", T.StringType()),
        ]
    )
    return narrow.mapInArrow(_parse_batches(tuple(keep), html, tags), schema)


def node_table(parsed: DataFrame, *keep: str) -> DataFrame:
    """One row per node."""
    return parsed.select(*(keep or ("page_id",)), F.inline("nodes"))
