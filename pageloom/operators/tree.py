"""Which nodes of a page stay, by arithmetic over pre-order positions.

A node's subtree is the positions from its own to its last. With running counts over positions,
"how many x does the subtree hold" is one subtraction, whatever the size of the subtree, and
"inside a removed element" is a running count of removed openings less removed endings. Counts run
over all pages of an Arrow batch at once; only a few whole numbers per node come to Python.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

# This module travels with the plan; executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# What ``marks`` says of a node, one bit each, then two numbers: the kind of string that a node
# is (0 for other nodes), and the kind that counts as an element's own text.
MARKS = ("alive", "judged", "banned", "boilerplate", "blank", "link", "image", "closes")
BIT = {name: 1 << i for i, name in enumerate(MARKS)}
KIND_SHIFT, OWN_SHIFT, KIND_BITS = len(MARKS), len(MARKS) + 6, 63


def covered(chosen: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether a node is one of the chosen or lies inside one."""
    change = np.zeros(len(chosen) + 1, np.int64)
    change[:-1] += chosen
    np.subtract.at(change, last[chosen] + 1, 1)
    return np.cumsum(change[:-1]) > 0


def kept(last: np.ndarray, parent: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which nodes stay; positions count over all pages, a root's parent is negative."""
    at = np.arange(len(last))
    has = {name: (marks & bit) > 0 for name, bit in BIT.items()}
    kind, own = (marks >> KIND_SHIFT) & KIND_BITS, (marks >> OWN_SHIFT) & KIND_BITS

    def below(test: np.ndarray) -> np.ndarray:
        """How many nodes inside each node pass the test."""
        running = np.cumsum(test)
        return running[last] - running[at]

    holds_link = has["link"].copy()
    holds_link[parent[has["link"] & (parent >= 0)]] = True
    alive = has["alive"]
    leaf = alive & (below(alive) == 0)
    leaves = np.flatnonzero(leaf)
    said = np.zeros(len(last), bool)
    if len(leaves):
        # The first leaf from a node on; where it is the only one inside, it is the node's single string.
        first = leaves[np.minimum(np.cumsum(leaf) - leaf, len(leaves) - 1)]
        said = (below(leaf) + leaf == 1) & (kind[first] == own) & has["boilerplate"][first]
    unwanted = alive & has["judged"] & (has["banned"] | holds_link | said)
    alive = alive & ~covered(unwanted, last)

    string = alive & ~has["blank"]
    filled = below(alive & has["image"]) > 0
    for code in np.unique(own[has["judged"]]):
        mine = own == code
        filled[mine] |= (below(string & (kind == code)) > 0)[mine]
    return alive & ~covered(alive & has["judged"] & ~filled, last)


def written_order(alive: np.ndarray, closes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Openings (positions) and closings (-1 - position) in the order in which they are written.

    A closing follows the last node of its subtree; of several, the innermost comes first.
    """
    opened, closed = np.flatnonzero(alive), np.flatnonzero(alive & closes)
    place = np.concatenate([opened, last[closed]])
    turn = np.concatenate([np.full(len(opened), -len(alive) - 1), -closed])
    return np.concatenate([opened, -1 - closed])[np.lexsort((turn, place))]


def keep_nodes(pages: pa.Array) -> pa.Array:
    """For each page the openings and closings that stay, as positions within its root."""
    sizes = pc.fill_null(pc.list_value_length(pages), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    base = np.repeat(starts, sizes)
    last, parent, marks = (column.to_numpy(zero_copy_only=False).astype(np.int64) for column in pages.flatten().flatten())
    last, parent = last + base, np.where(parent < 0, -1, parent + base)
    alive = kept(last, parent, marks)
    order = written_order(alive, (marks & BIT["closes"]) > 0, last)
    page = np.repeat(np.arange(len(sizes)), sizes)[np.where(order < 0, -1 - order, order)] if len(order) else order
    within = np.where(order < 0, order + starts[page], order - starts[page])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(page, minlength=len(sizes)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(within.astype(np.int32)), mask=pages.is_null())


kept_order = arrow_udf(keep_nodes, T.ArrayType(T.IntegerType()))
