"""I-Match fingerprints (operator 5), with DataFrame functions only.

Terms are runs of letters and digits, lower-cased. The lexicon keeps those whose inverse document
frequency, ln(N / df) / ln(N), lies in a band. It is handed to the scan as a fixed table of TABLE bits in which
each term sets two, so its size does not depend on the corpus; a term outside the band whose two bits happen to
be set is kept too, in every text alike. A text's kept distinct terms are sorted and hashed, whole and
in SUBSETS subsets of the lexicon, which hold a half, a quarter, an eighth or a sixteenth of it, drawn by hash: large
ones tell near copies apart, small ones outlive larger edits. Likeness is the share of equal hashes. A subset without
terms hashes the text itself, so only equal texts agree there.

The next document is that of the next lower id (after the lowest: the highest); rows that repeat an id come in
the order of a hash of their text, a null id last. A text reaches its predecessor within a group of neighbouring ids;
each group also gets the first text of the next one. Null texts are empty. No documents: no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import id_and_text
from pageloom.operators.skew import number_rows
from pageloom.session import stage

BAND = (0.1, 0.45)
SUBSETS = 15
TABLE = 1 << 20
WORD = 64
# Ids of one group lie within this range, so a group has as many rows if ids are unique.
GROUP = 1024
LOWEST = -(1 << 63)


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def places(term: Column) -> tuple[Column, Column]:
    """The two bits of a term in the table."""
    return F.pmod(term, F.lit(TABLE)), F.pmod(F.shiftrightunsigned(term, 24), F.lit(TABLE))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """(term, df) of the terms in the band; a corpus of one document has no band and keeps all."""
    counts = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = docs.count()
    if n < 2:
        return counts
    idf = F.log(F.lit(float(n)) / F.col("df")) / F.log(F.lit(float(n)))
    return counts.filter(idf.between(*band))


def bit_table(kept: DataFrame) -> Column:
    """The lexicon as an array of TABLE / WORD integers: that many rows at most reach the driver."""
    bits = kept.select(F.explode(F.array(*places(F.col("term")))).alias("bit"))
    word = bits.groupBy(F.floor(F.col("bit") / WORD).alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast(bit % {WORD} as int)))").alias("word"))
    table = [0] * (TABLE // WORD)
    for row in word.toLocalIterator():
        table[row["at"]] = row["word"]
    return F.from_json(F.lit(json.dumps(table)), "array<bigint>")


def fingerprint(text: Column, kept_terms: Column) -> Column:
    """The hashes of the whole lexicon's terms and of each subset's."""

    def of(subset: Column) -> Column:
        # Four bits of a term for each subset; the number of bits that must be 0 goes from one to four.
        drawn = F.call_function("shiftleft", F.lit(1), (subset % 4 + 1).cast("int")) - 1
        mine = F.filter(kept_terms, lambda t: (subset == 0) | (F.call_function("shiftright", t, (subset * 4 - 4).cast("int")).bitwiseAND(drawn.cast("long")) == 0))
        return F.when(F.size(mine) > 0, F.xxhash64(mine)).otherwise(F.xxhash64(subset, text))

    return F.transform(F.sequence(F.lit(0), F.lit(SUBSETS)), of)


def with_fingerprint(df: DataFrame, text: str, table: Column, name: str) -> DataFrame:
    def in_table(term: Column) -> Column:
        a, b = (F.get(table, F.floor(p / WORD).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (p % WORD).cast("int"))) != 0 for p in places(term))
        return a & b

    df = df.withColumn("_terms", F.array_sort(F.filter(terms(F.col(text)), in_table)))
    return df.withColumn(name, fingerprint(F.col(text), F.col("_terms"))).drop("_terms")


def likeness(a: Column, b: Column) -> Column:
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) / F.lit(float(SUBSETS + 1))


def shown(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")), "-")


def fingerprints(docs: DataFrame, band: tuple[float, float] = BAND, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, fingerprint as an array of hashes) of every text."""
    docs = id_and_text(docs, id_col, text_col)
    return with_fingerprint(docs, "text", bit_table(lexicon(docs, band)), "fingerprint").drop("text")


def compared(docs: DataFrame, band: tuple[float, float] = BAND, id_col="doc_id", text_col="text") -> DataFrame:
    """Every text's fingerprint against its edited text's and the next document's."""
    docs = id_and_text(docs, id_col, text_col)
    table = bit_table(lexicon(docs, band))
    keyed = docs.withColumn("at", F.coalesce("doc_id", F.lit(LOWEST))).withColumn("tie", F.xxhash64("text"))
    keyed = keyed.withColumn("part", F.floor(F.col("at") / GROUP))

    # The first row of each group, also a guest at the end of the group before it, and that of the first group at the end of the last.
    heads = keyed.groupBy("part").agg(F.max(F.struct("at", "tie")).alias("head"))
    heads = number_rows(heads.select("part", "head.at", "head.tie", (-F.col("part")).alias("order")), ["order"], "rank")
    groups = heads.count()
    before = heads.select("at", "tie", F.when(F.col("rank") == 1, groups).otherwise(F.col("rank") - 1).alias("rank"))
    guests = before.join(heads.select("rank", "part"), "rank").select("at", "tie", F.col("part").alias("host"))
    guests = keyed.drop("part").join(stage(guests, "guests"), ["at", "tie"]).withColumnRenamed("host", "part")

    rows = keyed.withColumn("guest", F.lit(0)).unionByName(guests.withColumn("guest", F.lit(1)))
    rows = with_fingerprint(rows, "text", table, "own")
    order = Window.partitionBy("part").orderBy("guest", F.desc("at"), F.desc("tie"))
    rows = rows.withColumn("next", F.lead(F.struct("text", "own")).over(order)).filter("guest = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select(
        "doc_id", n.cast("long").alias("n_chars"), "own", F.col("next.own").alias("following"),
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("next.text", F.lit(1), half)).alias("edited"))
    rows = with_fingerprint(rows, "edited", table, "changed")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), shown(F.col("own")).alias("fingerprint"),
        shown(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"))
