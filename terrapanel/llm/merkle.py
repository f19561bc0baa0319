"""Fixity audit of archived records with Merkle trees.

Records are laid out as in an archive: by id into files of FILE_RECORDS ids, each record at the byte
offset where the ones before it in its file end.  Leaves are record hashes; the records of each RANGE
bytes of a file make an ordered range with a hash of its leaves, a file's ranges make the file's hash, FAN
files a node, and so on to one root.  A replica's records go to the primary's ranges by a table of range
bounds (file, first record, number), and make a tree of their own.  The trees are compared from the root
down; only children of differing nodes are looked at, and records are compared in differing ranges alone.
Texts are read once per replica and never move: the shuffles carry hashes.

Equal records of one id are one leaf with a count.  Files that would hold more than SPLIT_AT different
records, because ids repeat or are null, are split by the records' hashes, so that no file, range or node
gathers more than a bounded number of children in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrapanel.llm.staging import column_or_null, staged

FILE_RECORDS = 4096
RANGE = 1 << 16
FAN = 64
#: Different records in a file beyond which it is split into parts of about FILE_RECORDS.
SPLIT_AT = 4 * FILE_RECORDS
_FILE = ["slot", "sub"]


def _entries(records: DataFrame, id_column: str, uri: str, payload: str) -> DataFrame:
    """(id, leaf, size, c): the hash and length of each different record of an id, and how many there are."""
    head, body = column_or_null(records, uri, "string"), column_or_null(records, payload, "string")
    written = F.concat(F.coalesce(head, F.lit("\u0000")), F.lit("\n"), F.coalesce(body, F.lit("\u0000")))
    found = records.select(column_or_null(records, id_column, "long").alias("id"), F.sha2(written, 256).alias("leaf"), (F.octet_length(written) + 64).cast("long").alias("size"))
    return staged(found.groupBy("id", "leaf", "size").agg(F.count(F.lit(1)).alias("c")), "merkle-records")


@dataclass
class Layout:
    """How ids make files: 2**shift ids each, and (slot, bits) of the files split into 2**bits parts."""

    shift: int
    split: DataFrame

    def place(self, entries: DataFrame) -> DataFrame:
        """entries with slot, the number of their file, and sub, the number of its part.  Records without an
        id have file 0; file k of the others has 2k + 1, or -2k for a negative k."""
        prefix = F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long")
        return _with_slot(entries, self.shift).join(self.split, "slot", "left").withColumn("sub", F.when(F.col("bits").isNull(), 0).otherwise(F.call_function("shiftright", prefix, (60 - F.col("bits")).cast("int"))).cast("long")).drop("bits")


def _with_slot(entries: DataFrame, shift: int) -> DataFrame:
    file = F.shiftright("id", shift)
    return entries.withColumn("slot", F.when(F.col("id").isNull(), 0).when(file >= 0, 2 * file + 1).otherwise(-2 * file).cast("long"))


def _layout(entries: DataFrame, others: DataFrame) -> Layout:
    """Files of FILE_RECORDS ids, or of so many more as the primary's ids lie apart on average."""
    low, high, n = entries.agg(F.min("id"), F.max("id"), F.count("id")).first()
    shift = FILE_RECORDS.bit_length() - 1 + max(0, ((int(high) - int(low) + 1) // n).bit_length() - 1 if n else 0)
    shift = min(shift, 63)
    slots = _with_slot(entries.select("id"), shift).union(_with_slot(others.select("id"), shift))
    full = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > SPLIT_AT)
    bits = F.least(F.lit(59), F.ceil(F.log2(F.col("c") / FILE_RECORDS))).cast("long")
    return Layout(shift, staged(full.select("slot", bits.alias("bits")), "merkle-split"))


def _in_file(*more: str):
    return Window.partitionBy(*_FILE).orderBy("id", "leaf", *more)


def catalogue(entries: DataFrame, layout: Layout) -> DataFrame:
    """(id, leaf, size, c, slot, sub, offset, number): where each of the leading replica's records lies in
    its file, and in which range."""
    before = F.sum(F.col("size") * F.col("c")).over(_in_file().rowsBetween(Window.unboundedPreceding, -1))
    return layout.place(entries).withColumn("offset", F.coalesce(before, F.lit(0)).cast("long")).withColumn("number", F.expr(f"offset div {RANGE}"))


def range_bounds(placed: DataFrame) -> DataFrame:
    """(slot, sub, id, leaf, number): the first record of each range; its leaf is empty where the range does
    not start amid records of one id, so that a changed record stays in its range."""
    first = placed.groupBy(*_FILE, "number").agg(F.min(F.struct("id", "leaf")).alias("first")).select(*_FILE, "first.id", "first.leaf", "number")
    least = placed.groupBy(*_FILE, "id").agg(F.min("leaf").alias("least")).toDF("o_slot", "o_sub", "o_id", "least")
    same = (F.col("slot") == F.col("o_slot")) & (F.col("sub") == F.col("o_sub")) & F.col("id").eqNullSafe(F.col("o_id"))
    leaf = F.when((F.col("leaf") == F.col("least")) & F.col("id").isNotNull(), "").otherwise(F.col("leaf"))
    return first.join(least, same).select(*_FILE, "id", leaf.alias("leaf"), "number")


def ranged(entries: DataFrame, layout: Layout, bounds: DataFrame) -> DataFrame:
    """A replica's entries with the number of their range; what lies before a file's first bound, or in a
    file without bounds, is in range 0."""
    marks = bounds.select("id", "leaf", F.lit(None).cast("long").alias("size"), F.lit(0).cast("long").alias("c"), *_FILE, "number")
    own = layout.place(entries).select("id", "leaf", "size", "c", *_FILE, F.lit(None).cast("long").alias("number"))
    number = F.last("number", ignorenulls=True).over(_in_file("c").rowsBetween(Window.unboundedPreceding, 0))
    return marks.union(own).withColumn("number", F.coalesce(number, F.lit(0))).filter("c > 0")


def _digest(children: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One hash over the children of each key, in order."""
    line = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in order))
    listed = F.sort_array(F.collect_list(F.struct(*order, line.alias("line"))))
    return staged(children.groupBy(*key).agg(F.sha2(F.array_join(F.transform(listed, lambda c: c["line"]), ","), 256).alias("hash")), "merkle-level")


@dataclass
class Level:
    """Nodes (key columns, hash), and the columns of a node's parent."""

    nodes: DataFrame
    key: list[str]
    parent: list


def tree(placed: DataFrame, highest: tuple[int, int]) -> list[Level]:
    """The levels of a replica's tree: ranges, files, nodes of FAN parts of a file while files have parts,
    nodes of FAN files, the root.  `highest` are the highest slot and sub of both replicas."""
    levels = [Level(_digest(placed, [*_FILE, "number"], ["id", "leaf", "c"]), [*_FILE, "number"], [F.col(c) for c in _FILE])]
    levels.append(Level(_digest(levels[0].nodes, _FILE, ["number", "hash"]), _FILE, []))
    slot, sub = highest
    while slot or sub:
        up = [F.col("slot"), F.expr(f"sub div {FAN}").alias("sub")] if sub else [F.expr(f"slot div {FAN}").alias("slot"), F.col("sub")]
        slot, sub = (slot, sub // FAN) if sub else (slot // FAN, 0)
        levels[-1].parent = up
        below = levels[-1].nodes.select(*up, F.col("slot").alias("child_slot"), F.col("sub").alias("child_sub"), "hash")
        levels.append(Level(_digest(below, _FILE, ["child_slot", "child_sub", "hash"]), _FILE, []))
    return levels


def _highest(*tables: DataFrame) -> tuple[int, int]:
    found = [t.agg(F.max("slot"), F.max("sub")).first() for t in tables]
    return max(r[0] or 0 for r in found), max(r[1] or 0 for r in found)


def differing_ranges(left: list[Level], right: list[Level]) -> DataFrame | None:
    """(slot, sub, number) of the ranges whose hashes differ, found from the root down; None where the
    roots are equal."""
    bad = None
    for x, y in zip(reversed(left), reversed(right), strict=True):
        a, b = x.nodes, y.nodes
        if bad is not None:
            parents = bad.toDF(*(f"p_{c}" for c in bad.columns))
            up = lambda t: t.select("*", *(p.alias(f"p_{k}") for p, k in zip(x.parent, _FILE, strict=True)))  # noqa: B023, E731
            a, b = (up(t).join(parents, parents.columns, "left_semi").select(*t.columns) for t in (a, b))
        bad = staged(a.join(b.withColumnRenamed("hash", "other"), x.key, "full").filter(~F.col("hash").eqNullSafe(F.col("other"))).select(*x.key), "merkle-differing")
        if bad.isEmpty():
            return None
    return bad


def audit(primary: DataFrame, replica: DataFrame, id_column: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
    """The records in which a replica differs from the primary.

    Returns id_column, copy, status (`changed`, `missing`: not in the replica, `extra`: not in the primary),
    primary_sha256, replica_sha256, file, offset, size (of the primary's record; offset and size are null for
    extra ones).  Equal replicas, empty ones among them, give no rows.  Null uris and payloads are values of
    their own.  Repeated rows are copies of one record, which has one offset: of two copies against one, copy
    2 is missing.  A record is changed where exactly one of its id is missing and one extra; where there are
    more, and for records without an id, each is missing or extra by itself.  Other columns are ignored,
    whatever their names.  Payloads are hashed whole, however long; a longer one than RANGE is a range of its
    own.  Records of one id stand in the order of their hashes, so rows have no ties.  Any long is an id.
    """
    a, b = (_entries(t, id_column, uri, payload) for t in (primary, replica))
    layout = _layout(a, b)
    x = staged(catalogue(a, layout), "merkle-catalogue")
    y = staged(ranged(b, layout, range_bounds(x)), "merkle-ranged")
    highest = _highest(x, y)
    bad = differing_ranges(tree(x, highest), tree(y, highest))
    found = compared(x, y, bad if bad is not None else x.select(*_FILE, "number").limit(0))
    return found.select(F.col("id").alias(id_column), "copy", "status", "primary_sha256", "replica_sha256", F.shiftright("id", layout.shift).alias("file"), "offset", "size")


def compared(x: DataFrame, y: DataFrame, bad: DataFrame) -> DataFrame:
    """The differing records of the ranges in `bad`."""
    own, other = (t.join(bad, [*_FILE, "number"], "left_semi") for t in (x, y))
    none = F.lit(None).cast("long")
    both = own.select("id", "leaf", F.col("c").alias("c1"), F.lit(0).cast("long").alias("c2"), "size", "offset").union(other.select("id", "leaf", F.lit(0).cast("long"), "c", none, none))
    summed = both.groupBy("id", "leaf").agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2"), F.max("size").alias("size"), F.max("offset").alias("offset"))
    differ = staged(summed.filter("c1 <> c2"), "merkle-records-differing")
    gone, new = F.greatest(F.col("c1") - F.col("c2"), F.lit(0)), F.greatest(F.col("c2") - F.col("c1"), F.lit(0))
    each = differ.filter("id is not null").groupBy("id").agg(F.sum(gone).alias("gone"), F.sum(new).alias("new"), F.max(F.when(gone > 0, F.struct("leaf", "size", "offset"))).alias("a"), F.max(F.when(new > 0, F.col("leaf"))).alias("b"))
    changed = each.filter("gone = 1 and new = 1")
    first = changed.select("id", F.lit(1).cast("long").alias("copy"), F.lit("changed").alias("status"), F.col("a.leaf").alias("primary_sha256"), F.col("b").alias("replica_sha256"), "a.offset", "a.size")
    alone = differ.join(changed.select("id"), "id", "left_anti")
    copies = F.explode(F.sequence(F.least("c1", "c2") + 1, F.greatest("c1", "c2"))).alias("copy")
    lost = F.col("c1") > F.col("c2")
    rest = alone.select("id", copies, F.when(lost, "missing").otherwise("extra").alias("status"), F.when(lost, F.col("leaf")).alias("primary_sha256"), F.when(~lost, F.col("leaf")).alias("replica_sha256"), F.when(lost, F.col("offset")).alias("offset"), F.when(lost, F.col("size")).alias("size"))
    return first.union(rest)


def roots(records: DataFrame, id_column: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
    """The root of a replica's own tree in its own layout: one row (slot, sub, hash), none for an empty table."""
    entries = _entries(records, id_column, uri, payload)
    placed = staged(catalogue(entries, _layout(entries, entries)), "merkle-catalogue")
    return tree(placed, _highest(placed))[-1].nodes
