"""Removal of repeated three-line windows.

Every run of `window` consecutive lines is hashed (128 bits); the windows that occur more than once are
found by a grouped minimum over all documents, which also gives each one's first occurrence in the order
of (doc_id, position).  Later occurrences are joined back, their covered positions merged per document,
and those lines removed.  All of it is native: the only text that moves is that of the documents, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.staging import column_or_null, staged

_DOC = ("d", "d1", "d2")


def _let(value: Column, then) -> Column:
    """then(value), with value computed once and not for each element that then() makes."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _windows(lines: Column, window: int) -> Column:
    """The hashes of all runs of `window` lines; an empty array for fewer lines."""
    last = F.size(lines) - window
    hashed = lambda i: F.struct(*(F.xxhash64(*salt, *(F.get(lines, i + k) for k in range(window))).alias(name) for name, salt in (("h1", ()), ("h2", (F.lit(7),)))))
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), hashed)).otherwise(F.array())


def remove_repeated_windows(documents: DataFrame, window: int = 3, n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """documents with `text` freed of repeated windows, and the counts n_lines and n_removed.

    Lines end at a line feed.  A window is `window` consecutive lines of a document, compared as they
    are; its first occurrence in the order of doc_id, then of position, stays, and all lines that a later
    one covers go (overlapping ones are merged), so that each distinct line stays somewhere.  Rows of
    equal doc_id and text are one document for this order and are treated alike; rows of equal doc_id and
    different text are ordered by a hash of the text; a null doc_id comes first.

    Texts are read whole: a very long one costs its task a few times its own size, and no more lines of a
    text are held than it has.  A null text stays null with n_lines 0; an empty text is one line; documents of fewer than `window`
    lines are kept.  A document of which every line goes has an empty text.  All columns are kept,
    whatever their names (the two counts replace columns of the same name); empty tables give an empty result.
    """
    names = documents.columns
    frame = documents.toDF(*(f"c{k}" for k in range(len(names))))
    text = F.col(f"c{names.index('text')}").cast("string") if "text" in names else F.lit(None).cast("string")
    doc_id = F.col(f"c{names.index('doc_id')}").cast("long") if "doc_id" in names else F.lit(None).cast("long")
    identity = frame.select("*", text.alias("text"), doc_id.alias("d"), F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(7), text).alias("d2"))

    found = identity.select(*_DOC, F.posexplode(_let(F.split("text", "\n", -1), lambda lines: _windows(lines, window))).alias("pos", "w")).select(*_DOC, "pos", "w.h1", "w.h2")
    at = F.struct(*_DOC, "pos")
    first = staged(found.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.max(at).alias("last")).filter(F.col("first") != F.col("last")).select("h1", "h2", "first"), "window-firsts")
    later = found.join(first, ["h1", "h2"]).filter(~F.struct(*_DOC, "pos").eqNullSafe(F.col("first")))
    covered = later.groupBy(*_DOC).agg(F.collect_set("pos").alias("at")).select(*(F.col(c).alias(f"k_{c}") for c in _DOC), "at")

    joined = identity.join(covered, F.col("d").eqNullSafe(F.col("k_d")) & (F.col("d1") == F.col("k_d1")) & (F.col("d2") == F.col("k_d2")), "left")
    lines = F.split("text", "\n", -1)
    gone = F.flatten(F.transform("at", lambda p: F.sequence(p, p + (window - 1))))
    kept = F.when(F.col("at").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone))
    out = joined.withColumn("kept", kept)
    left = _let(lines, lambda own: F.array_join(F.transform("kept", lambda i: F.get(own, i)), "\n"))
    cleaned = F.when(F.col("at").isNull(), F.col("text")).otherwise(left)
    total = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    removed = F.when(F.col("at").isNull(), 0).otherwise(F.size(lines) - F.size("kept")).cast("long")
    columns = [(cleaned if name == "text" else F.col(f"c{k}")).alias(name) for k, name in enumerate(names) if name not in (n_lines, n_removed)]
    return out.select(*columns, total.alias(n_lines), removed.alias(n_removed))


def line_dedup(documents: DataFrame, window: int = 3) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that is left; see remove_repeated_windows()."""
    docs = documents.select(column_or_null(documents, "doc_id", "long").alias("doc_id"), column_or_null(documents, "text", "string").alias("text"))
    return remove_repeated_windows(docs, window).select("doc_id", "n_lines", "n_removed", "text")
