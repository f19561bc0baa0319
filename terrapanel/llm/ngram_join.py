"""Jaccard self-join of documents on word n-grams: a blocked sparse product of the document by n-gram
incidence with size-derived bounds.

The product runs over the columns that can decide a link.  All n-grams stand in one global order (the
common ones last, else by hash); a document of n of them enters only its first n - ceil(t n) + 1, since
two sets with a Jaccard index of at least t share one of these.  Columns are dealt to blocks that fit a
task; a block keeps the columns with two documents or more, which are few.  Linked documents are then
sought in two passes over these columns:

1. each document against one hub of each of its columns, which joins copies and near copies without
   listing all pairs of a group;
2. documents of one column that are still in different components, block by block of at most
   COLUMN_LOAD by COLUMN_LOAD documents.  A pair counts only if its sizes allow a link and if parity
   bitmaps of the two sets differ in no more bits than linked sets of these sizes can; overlap counts
   are accumulated over columns, and pairs whose count cannot reach the bound given by their sizes go.

Both passes end in a comparison of whole n-gram sets, and every filter before it is one that no linked
pair fails; only pairs inside one component may stay unlisted.  N-grams are known by 64-bit hashes of
their words, so two different ones are taken for one with a chance of 2**-64.  Sets are known by two such
hashes, 127 bits together: where the first alone is not enough to tell two sets apart, they are named
by the second.
"""

from __future__ import annotations

import operator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm import tokens
from terrapanel.llm.components import connected_components
from terrapanel.llm.staging import arrow_rows, column_or_null, record_batch, small_batches, staged

#: Buckets of the table of n-gram counts that tells common n-grams (a fixed size: 2 MB when broadcast).
COUNT_BUCKETS = 1 << 18
#: Documents in one column of a block; a column that may have more is dealt over several.
COLUMN_LOAD = 4096
#: Bits of a set's first hash, and long values of its parity bitmap.
KEY_BITS = 63
MAP_WORDS = 8
#: Entries of the incidence in one block.
BLOCK_ENTRIES = 400_000
#: Pairs of whole sets, or documents, in one batch for Python.
PAIRS_IN_BATCH = 500
#: Bits of the filter that keeps sets without a candidate pair from being moved (a fixed size: 4 MB).
FILTER_BITS = 1 << 25


def _sets(batch_texts: pa.Array, size: int):
    """(first row, row offsets, n-grams): the sorted distinct n-grams of each row, piece by piece."""
    for i, j, data, starts, ends in tokens.pieces(batch_texts):
        hashes, row = tokens.word_hashes(data, starts, ends, tokens.NOT_SPACE)
        grams, row = tokens.gram_hashes(hashes, row, j - i, size)
        at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=j - i))])
        parts = []
        for k in range(j - i):
            own = np.sort(grams[at[k] : at[k + 1]])
            parts.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
        yield i, np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.concatenate(parts) if parts else grams


def _set_keys(grams: np.ndarray, at: np.ndarray, clashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set: a 63-bit key, 0 for an empty set, and a second one that tells apart sets of
    one key.  Sets of a key in `clashes` get their key from the second hash."""
    n = np.diff(at)
    full = n > 0
    out = []
    for factor in (0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD):
        key = np.zeros(len(n), dtype=np.uint64)
        if full.any():
            key[full] = np.add.reduceat(tokens.mix(grams * np.uint64(factor)), at[:-1][full])
            key[full] = tokens.mix(key[full] + n[full].astype(np.uint64) * np.uint64(0x165667B19E3779F9))
        out.append(key)
    key, second = (out[0] >> np.uint64(64 - KEY_BITS)).astype(np.int64), out[1]
    key[full & (key == 0)] = 1
    if len(clashes):
        key = np.where(np.isin(key, clashes), (second >> np.uint64(1)).astype(np.int64), key)
        key[full & (key == 0)] = 1
    return key, second.view(np.int64)


def _bitmaps(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each set, a row of MAP_WORDS long values: bit k tells whether the n-grams whose hash gives k are
    odd in number.  Bitmaps of two sets differ in at most as many bits as n-grams are in only one of them."""
    out = np.zeros((len(at) - 1, MAP_WORDS), np.int64)
    width = 64 * MAP_WORDS
    place = (grams >> np.uint64(20)) & np.uint64(width - 1)
    for i in range(0, len(out), 2048):
        j = min(i + 2048, len(out))
        row = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
        odd = np.bincount(row * width + place[at[i] : at[j]].astype(np.int64), minlength=(j - i) * width).reshape(j - i, width) & 1
        out[i:j] = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)
    return out


def _first(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of n n-grams, in the global order, two sets at the threshold cannot both lack."""
    return n - (percent * n + 99) // 100 + 1


_MAP = [f"b{k}" for k in range(MAP_WORDS)]
_LONGS = ["doc_id", "h1", "h2", "key", "key2", "n", *_MAP]
_KEYS = pa.schema([("block", pa.int32()), *((c, pa.int64()) for c in _LONGS), ("counts", pa.binary())])
_COUNT_BLOCKS = 16


def _keys_and_counts(size: int, clashes: np.ndarray):
    def run(batches):
        total = np.zeros(COUNT_BUCKETS, dtype=np.int64)
        seen = False
        for batch in batches:
            seen = True
            for i, at, grams in _sets(batch.column(3), size):
                total += np.bincount((grams & np.uint64(COUNT_BUCKETS - 1)).astype(np.int64), minlength=COUNT_BUCKETS)
                m = len(at) - 1
                key, second = _set_keys(grams, at, clashes)
                own = {c: batch.column(k)[i : i + m] for k, c in enumerate(("doc_id", "h1", "h2"))}
                maps = dict(zip(_MAP, np.ascontiguousarray(_bitmaps(grams, at).T), strict=True))
                yield record_batch(_KEYS, block=pa.nulls(m, pa.int32()), key=key, key2=second, n=np.diff(at), counts=pa.nulls(m, pa.binary()), **own, **maps)
        if seen:
            width = COUNT_BUCKETS // _COUNT_BLOCKS
            none = dict.fromkeys(_LONGS, pa.nulls(_COUNT_BLOCKS, pa.int64()))
            yield record_batch(_KEYS, block=np.arange(_COUNT_BLOCKS, dtype=np.int32), counts=[total[k * width : (k + 1) * width].astype(np.uint32).tobytes() for k in range(_COUNT_BLOCKS)], **none)

    return run


def _sum_counts(batches):
    kept: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(counts, np.uint32).astype(np.int64)
            kept[block] = kept[block] + own if block in kept else own
    for block, counts in kept.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["block", "counts"])


def _salts(counts: np.ndarray) -> np.ndarray:
    """By bucket, over how many columns an n-gram is dealt: 0 for a bucket that is not over the usual
    spread of counts, so that none of its n-grams is common."""
    usual = counts.mean() + 8 * np.sqrt(counts.mean() + 64)
    over = np.maximum(0, counts - usual)
    return np.where(over > 0, np.minimum(1 + over // COLUMN_LOAD, 2**31 - 2), 0).astype(np.int32)


_ENTRIES = pa.schema([("gram", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("salt", pa.int32())])


def _entries(size: int, percent: int, salts, clashes: np.ndarray):
    """The first n-grams of each set, as entries of the incidence."""

    def run(batches):
        of = salts.value
        for batch in batches:
            for _, at, grams in _sets(batch.column(0), size):
                keys, n = _set_keys(grams, at, clashes)[0], np.diff(at)
                row = np.repeat(np.arange(len(n)), n)
                salt = of[(grams & np.uint64(COUNT_BUCKETS - 1)).astype(np.int64)]
                order = np.argsort(2 * row + (salt > 0), kind="stable")
                order = order[np.arange(len(grams)) - np.repeat(at[:-1], n) < _first(n, percent)[row]]
                grams, salt, row = grams[order], salt[order].astype(np.int64), row[order]
                salt = np.where(salt > 0, 1 + keys[row] % np.maximum(salt, 1), 0)
                yield record_batch(_ENTRIES, gram=grams.view(np.int64), key=keys[row], n=n[row].astype(np.int32), salt=salt.astype(np.int32))

    return run


_COLUMNS = pa.schema([("gram", pa.int64()), ("key", pa.int64()), ("n", pa.int32())])


def _shared_columns(batches):
    """Of a block's entries, without repeats, those of columns that other documents share."""
    parts = [[batch.column(k).to_numpy() for k in range(4)] for batch in batches if batch.num_rows]
    if not parts:
        return
    gram, key, n, salt = (np.concatenate([p[k] for p in parts]) for k in range(4))
    del parts
    order = np.lexsort((key, gram))
    gram, key, n, salt = gram[order], key[order], n[order], salt[order]
    new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])])
    gram, key, n, salt = gram[new], key[new], n[new], salt[new]
    same = gram[1:] == gram[:-1]
    keep = (salt > 0) | np.concatenate([[False], same]) | np.concatenate([same, [False]])
    gram, key, n = gram[keep], key[keep], n[keep]
    for i in range(0, len(gram), 100_000):
        yield record_batch(_COLUMNS, gram=gram[i : i + 100_000], key=key[i : i + 100_000], n=n[i : i + 100_000])


def _bit(key: np.ndarray) -> np.ndarray:
    return (tokens.mix(key.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


_WORDS = pa.schema([("word", pa.int64()), ("bits", pa.int64())])


def _filter_words(batches):
    for batch in batches:
        bit = _bit(batch.column(0).to_numpy())
        yield record_batch(_WORDS, word=bit >> 6, bits=(np.uint64(1) << (bit & 63).astype(np.uint64)).view(np.int64))


_ARRAYS = pa.schema([("key", pa.int64()), ("grams", pa.binary())])


def _wanted_sets(size: int, wanted, clashes: np.ndarray):
    def run(batches):
        bits, sent = wanted.value, set()
        for batch in batches:
            for _, at, grams in _sets(batch.column(0), size):
                key = _set_keys(grams, at, clashes)[0]
                bit = _bit(key)
                hit = np.flatnonzero((key != 0) & ((bits[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) > 0)).tolist()
                # One of the copies in a task is enough.
                hit = [k for k in hit if not (key[k] in sent or sent.add(key[k]))]
                if hit:
                    yield record_batch(_ARRAYS, key=key[hit], grams=[grams[at[k] : at[k + 1]].tobytes() for k in hit])

    return run


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compare(percent: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            left, right = batch.column(2), batch.column(3)
            linked = np.zeros(len(a), dtype=bool)
            for k in range(len(a)):
                x, y = np.frombuffer(left[k].as_buffer(), np.uint64), np.frombuffer(right[k].as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                linked[k] = 100 * common >= percent * (len(x) + len(y) - common)
            yield record_batch(_LINKS, a=a[linked], b=b[linked])

    return run


def _links(docs: DataFrame, pairs: DataFrame, size: int, percent: int, clashes: np.ndarray) -> DataFrame:
    """Of candidate pairs (a, b) of set keys, those whose whole sets are linked; written once."""
    spark = docs.sparkSession
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    words = keys.mapInArrow(_filter_words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    wanted = spark.sparkContext.broadcast(bits)
    # Both sides of the join read the sets of one exchange.
    arrays = docs.select("text").mapInArrow(_wanted_sets(size, wanted, clashes), "key long, grams binary").repartition("key").dropDuplicates(["key"])
    left, right = arrays.toDF("a", "x"), arrays.toDF("b", "y")
    with arrow_rows(spark, PAIRS_IN_BATCH):
        found = staged(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_compare(percent), "a long, b long").distinct(), "ngram-links")
    wanted.destroy()
    return found


def _sizes_allow(n: str, m: str, percent: int):
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _maps_allow(percent: int):
    """Linked sets of n and m n-grams differ in at most (n + m) * (1 - t) / (1 + t) of them, and so do their
    bitmaps in bits."""
    bits = reduce(operator.add, (F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in _MAP))
    return bits * (100 + percent) <= (F.col("a.n") + F.col("b.n")) * (100 - percent)


def _identified(documents: DataFrame) -> DataFrame:
    """doc_id, two hashes of the text, and the text."""
    named = documents.select(column_or_null(documents, "doc_id", "long").alias("doc_id"), column_or_null(documents, "text", "string").alias("text"))
    return named.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), "text")


def _keyed(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame, np.ndarray, np.ndarray]:
    """The key of each row's set (with n and the row's hashes), the distinct sets, the counts of n-grams by
    bucket, and the keys that name several sets."""
    clashes = np.zeros(0, np.int64)
    while True:
        ddl = ", ".join(["block int", *(f"{c} long" for c in _LONGS), "counts binary"])
        first = staged(docs.mapInArrow(_keys_and_counts(size, clashes), ddl), "ngram-keys")
        keyed = first.filter("block is null").drop("block", "counts")
        sums = [F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_same"), F.min("key2").alias("low"), F.max("key2").alias("high"), *(F.min(c).alias(c) for c in ("n", *_MAP))]
        members = staged(keyed.filter("key <> 0").groupBy("key").agg(*sums), "ngram-members")
        # About s**2 / 2**64 of s different sets: a handful for 10**10 of them.
        more = members.filter("low <> high").select("key").toArrow()["key"].to_numpy()
        if not len(more):
            break
        clashes = np.union1d(clashes, more)
    counted = first.filter("block is not null").select("block", "counts").repartition(_COUNT_BLOCKS, "block").mapInArrow(_sum_counts, "block int, counts binary")
    counts = np.zeros(COUNT_BUCKETS, dtype=np.int64)
    for row in counted.collect():  # one row for each of _COUNT_BLOCKS
        counts[row["block"] * (COUNT_BUCKETS // _COUNT_BLOCKS) :][: COUNT_BUCKETS // _COUNT_BLOCKS] = np.frombuffer(row["counts"], np.int64)
    return keyed.select("doc_id", "h1", "h2", "key", "n"), members, counts, clashes


def _blocked(rows: DataFrame, own: str, others: str) -> DataFrame:
    """rows of a column dealt to blocks of COLUMN_LOAD: each goes to its own block, once for each block of
    the other side."""
    blocks = lambda c: F.ceil(F.col(c) / COLUMN_LOAD)
    return rows.withColumn(f"{own}_block", F.pmod(F.xxhash64("key", F.lit(own)), blocks(own))).withColumn(f"{others}_block", F.explode(F.sequence(F.lit(0).cast("long"), blocks(others) - 1)))


def _open_pairs(columns: DataFrame, members: DataFrame, component: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets in different components that share enough of their first n-grams to be linked."""
    placed = columns.join(component.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    sizes = placed.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("c"))
    # In each column that still has several components, the largest meets only the others.
    mixed = sizes.groupBy("gram").agg(F.max(F.struct("c", "component")).alias("main"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    mixed = mixed.select("gram", F.col("main.component").alias("main"), "all", (F.col("all") - F.col("main.c")).alias("rest"))
    open_ = placed.join(mixed, "gram").select("gram", "key", "component", (F.col("component") == F.col("main")).alias("in_main"), "all", "rest")
    open_ = staged(open_.join(members.select("key", "n", *_MAP), "key"), "ngram-open")
    a, b = _blocked(open_.filter("not in_main"), "rest", "all").alias("a"), _blocked(open_, "all", "rest").alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("gram", "rest_block", "all_block")]
    apart = (F.col("a.component") != F.col("b.component")) & (F.col("b.in_main") | (F.col("a.key") < F.col("b.key")))
    meet = a.join(b, reduce(operator.and_, [*same, apart, _sizes_allow("a.n", "b.n", percent), _maps_allow(percent)]))
    # The sides of a pair differ from column to column, so its sizes go by key.
    size_of = lambda sign: F.expr(f"CASE WHEN a.key {sign} b.key THEN a.n ELSE b.n END")
    met = meet.groupBy(F.greatest("a.key", "b.key").alias("a"), F.least("a.key", "b.key").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.max(size_of(">")).alias("n"), F.max(size_of("<")).alias("m"))
    # What two sets may share beyond the counted columns is at most what the longer rest holds.
    rest = F.greatest(*(F.floor((F.col(k) * percent + 99) / 100) - 1 for k in ("n", "m")))
    return met.filter((F.col("c") + rest) * (100 + percent) >= (F.col("n") + F.col("m")) * percent).select("a", "b")


def _joined(component: DataFrame, more: DataFrame) -> DataFrame:
    """component (node, component) after `more` links (a, b)."""
    label = lambda df, c: df.join(component.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")), c, "left").withColumn(f"of_{c}", F.coalesce(f"of_{c}", c))
    between = label(label(more, "a"), "b")
    new = connected_components(between.select("of_a", "of_b"), "of_a", "of_b").select(F.col("node").alias("component"), F.col("component").alias("new"))
    ends = more.select(F.col("a").alias("node")).union(more.select(F.col("b").alias("node"))).distinct()
    nodes = component.select("node", "component").union(ends.join(component, "node", "left_anti").select("node", F.col("node").alias("component")))
    return nodes.join(new, "component", "left").select("node", F.coalesce("new", "component").alias("component"))


def _components_of_sets(documents: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, members, component): doc_id, hashes of the text, key of the set and n of each row; doc_id and
    n_same of each set; and (node, component) of the sets that are linked."""
    spark = documents.sparkSession
    small_batches(spark)
    docs = _identified(documents)
    keyed, members, counts, clashes = _keyed(docs, size)
    salts = spark.sparkContext.broadcast(_salts(counts))

    prefix = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    n_entries = members.agg(F.sum(prefix * F.col("n_same"))).first()[0] or 0
    blocks = max(spark.sparkContext.defaultParallelism, -(-int(n_entries) // BLOCK_ENTRIES))
    entries = docs.select("text").mapInArrow(_entries(size, percent, salts, clashes), "gram long, key long, n int, salt int")
    columns = staged(entries.repartition(blocks, "gram", "salt").mapInArrow(_shared_columns, "gram long, key long, n int"), "ngram-columns")
    salts.destroy()

    # The documents that share most columns are the hubs of their groups: near copies link to the text
    # they come from more than to each other.
    shared = columns.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    hubs = columns.join(shared, "gram").groupBy("key").agg((F.sum("c") / F.max(prefix)).alias("weight"))
    best = columns.join(hubs, "key").groupBy("gram").agg(F.max(F.struct("weight", "key", "n")).alias("p"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("gram", "p")
    star = columns.join(best, "gram").filter(F.col("key") != F.col("p.key")).filter(_sizes_allow("n", "p.n", percent))
    tried = staged(star.select(F.greatest("key", "p.key").alias("a"), F.least("key", "p.key").alias("b")).distinct(), "ngram-stars")
    component = connected_components(_links(docs, tried, size, percent, clashes), "a", "b")

    pairs = staged(_open_pairs(columns, members, component, percent).join(tried, ["a", "b"], "left_anti"), "ngram-pairs")
    if not pairs.isEmpty():
        more = _links(docs, pairs, size, percent, clashes)
        if not more.isEmpty():
            component = _joined(component, more)
    return keyed, members, component


def ngram_jaccard_components(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Each document's n-gram set size and the component it is linked into.

    documents: doc_id long, text string; other columns are ignored, whatever their names.  Words are
    runs of characters other than space, tab and line ends, A-Z lower-cased.  Two documents link when
    100 * |intersection| >= percent * |union| of their sets of `size` words.  Returns doc_id, n_shingles,
    component_id (the least doc_id that links lead to), n_same (documents with the same set).

    Nulls and texts without words: an empty set, linked with nothing, n_shingles 0.  Fewer words than
    `size`: one n-gram of them all.  Repeated rows: one result row each.  A null doc_id takes part
    through its text; its component is the least id among the documents it is linked with, null where
    none has one.  Texts are processed whole; a very long one costs memory of a few times its own size.
    Nothing depends on the order of rows, so there are no ties.  Empty tables give an empty result.
    """
    keyed, members, component = _components_of_sets(documents, size, percent)
    labelled = members.select("key", "doc_id", "n_same").join(component.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least_id = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_key = labelled.join(least_id, "component").select("key", "n_same", "component_id")
    own = F.when(F.col("key") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return keyed.join(by_key, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce("n_same", F.lit(1)).cast("long").alias("n_same"))


_NAME = ("no_id", "id", "h1", "h2")


def _name(doc_id: str):
    """What tells rows apart, in the order in which they are kept: id (null last), then hashes of the text."""
    return F.col(doc_id).isNull().alias("no_id"), F.coalesce(doc_id, F.lit(0)).alias("id")


def first_of_components(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies: of each component of linked rows exactly one, all columns kept.

    It is the row of the least doc_id, rows without an id last; of several rows of that id the one with
    the least hash of its text; of rows of equal id and text the least by all columns.  Ids need not be
    unique: a row goes for its own text's links only.  Equal texts are linked unless they have no words;
    rows without words are linked with nothing, so all of them stay.  An empty table gives an empty one.
    """
    keyed, _, component = _components_of_sets(documents, size, percent)
    placed = keyed.filter("key <> 0").join(component.select(F.col("node").alias("key"), "component"), "key", "left")
    named = placed.select(F.coalesce("component", "key").alias("component"), *_name("doc_id"), "h1", "h2").groupBy("component", *_NAME).agg(F.count(F.lit(1)).alias("c"))
    named = staged(named, "ngram-named")
    least = named.groupBy("component").agg(F.min(F.struct(*_NAME)).alias("first"), F.sum("c").alias("rows")).filter("rows > 1")
    decided = named.join(least, "component").select(*_NAME, (F.col("first") == F.struct(*_NAME)).alias("stays"), "c").filter("not stays or c > 1")
    decided = staged(decided, "ngram-decided")
    columns = documents.columns
    own = documents.select(F.struct(*columns).alias("row"), column_or_null(documents, "doc_id", "long").alias("doc_id"), column_or_null(documents, "text", "string").alias("text"))
    marked = own.select("row", *_name("doc_id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"))
    kept = marked.join(decided, list(_NAME), "left_anti").select("row")
    repeated = decided.filter("stays")
    if not repeated.isEmpty():
        kept = kept.union(marked.join(repeated.select(*_NAME), list(_NAME)).groupBy(*_NAME).agg(F.min("row").alias("row")).select("row"))
    return kept.select(*(F.col("row")[c].alias(c) for c in columns))
