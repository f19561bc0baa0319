"""Tables kept in parts, of which a merge or a rebuild rewrites only those it touches.

A table is a folder of data folders, one for each part (a hash bucket of the keys, or a year), and of small
version files that name the current data folder of every part.  A write puts new data folders beside the others
and then adds the next version file by one rename that fails if another writer was first.  Data are never changed
in place: what stops before the rename leaves the table as it was, and readers of an older version keep their
files until vacuum().
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.operators.quality import QualityError, primary_key_violations, require_empty
from terrapanel.sources import upsert as U

_PART, _REJECTED = "_part", "rejected"


class ConflictError(RuntimeError):
    """Another writer has committed since this one read the table: read again and repeat."""


class PartStore:
    """A table at `path`; see the module.  Parts are named by the text of a column."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return jvm, at, at(self.path).getFileSystem(conf), conf

    def version(self) -> dict:
        """The latest version: its number (0 before the first), schema as JSON, settings, and folders by part."""
        _, at, fs, _ = self._files()
        folder = at(f"{self.path}/_versions")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "."]
        if not numbers:
            return {"number": 0, "schema": None, "settings": {}, "parts": {}}
        return json.loads(self.spark.read.text(f"{self.path}/_versions/{max(numbers):012d}.json", wholetext=True).first()[0])

    def exists(self) -> bool:
        return self.version()["number"] > 0

    def _load(self, version: dict, parts: Iterable[str] | None) -> DataFrame:
        wanted = version["parts"] if parts is None else [p for p in parts if p in version["parts"]]
        schema = T.StructType.fromJson(version["schema"])
        folders = [f"{self.path}/{version['parts'][p]}" for p in wanted]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, parts: Iterable[str] | None = None) -> DataFrame:
        """The table, or some parts of it, as of now."""
        version = self.version()
        if not version["number"]:
            raise QualityError(f"no table has been committed at {self.path}")
        return self._load(version, parts)

    def rejected(self) -> DataFrame:
        """The rows that the last write has put aside."""
        version = self.version()
        return self._load({**version, "parts": {"aside": version["aside"]} if version.get("aside") else {}}, None)

    def commit(
        self, rows: DataFrame, part: Column, touched: Iterable[str] | None, base: dict | None = None, settings: dict | None = None,
        check: Callable[[DataFrame], None] | None = None, sort: Sequence[str] = (), aside: str | None = None, drop: Sequence[str] = (), gathered: bool = True,
    ) -> dict:
        """Replaces the `touched` parts (None: all) by rows, each put in the part of column `part` and, in a file,
        sorted by `sort`; gives the new version.  rows may have been computed from the table.

        check is given the rows as written, with their part as column `_part`, before they count: what it raises
        leaves the table as it was.  The part named `aside` is kept beside the table and is no part of it: see
        rejected().  Columns of `drop` only serve `part`.  Not gathered, tasks write what they hold, a file for each part: for
        rows of few parts that are dealt evenly as they are, so that they need not be moved.
        """
        base = base or self.version()
        folder = f"data/{base['number'] + 1:012d}-{uuid.uuid4().hex}"
        held = None if touched is None else sorted(set(touched))
        own = rows.withColumn(_PART, part.cast("string")).drop(*drop)
        rows = rows.drop(*drop)
        if held is not None:
            own = own.filter(F.col(_PART).isin(held))
        # Parts are gathered by size, so that a large one is split over tasks and small ones share some.
        own = (own.hint("rebalance", _PART) if gathered else own).sortWithinPartitions(_PART, *sort)
        own.write.option("partitionOverwriteMode", "static").partitionBy(_PART).parquet(f"{self.path}/{folder}")
        if check:
            check(self.spark.read.schema(T.StructType([*rows.schema.fields, T.StructField(_PART, T.StringType())])).parquet(f"{self.path}/{folder}"))
        _, at, fs, _ = self._files()
        names = [s.getPath().getName() for s in fs.listStatus(at(f"{self.path}/{folder}")) if s.isDirectory()]
        new = {n.removeprefix(f"{_PART}="): f"{folder}/{n}" for n in names if n.startswith(f"{_PART}=")}
        kept = {} if held is None else {p: f for p, f in base["parts"].items() if p not in set(held)}
        beside = new.pop(aside, None) if aside is not None else None
        version = {"number": base["number"] + 1, "schema": rows.schema.jsonValue(), "settings": settings or base["settings"], "parts": kept | new, "aside": beside}
        self._point(version)
        return version

    def _point(self, version: dict) -> None:
        jvm, at, fs, conf = self._files()
        new, place = (at(f"{self.path}/_versions/{n}") for n in (f".{uuid.uuid4().hex}", f"{version['number']:012d}.json"))
        out = fs.create(new)
        out.write(json.dumps(version).encode())
        out.close()
        how = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(how, 1)
        options[0] = how.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(new), fs.makeQualified(place), options)
        except Exception as error:
            if "AlreadyExists" not in str(error):
                raise
            fs.delete(new, False)
            raise ConflictError(f"{self.path}: version {version['number']} is another writer's") from error

    def vacuum(self, keep: int = 1) -> int:
        """Removes version files but the last `keep`, and data folders that none of these names: those of stopped
        writes too, so no write may be running.  Gives the number of removed folders."""
        _, at, fs, _ = self._files()
        last = self.version()["number"]
        named: set[str] = set()
        for s in fs.listStatus(at(f"{self.path}/_versions")) if last else []:
            name = s.getPath().getName()
            if name[0] == "." or int(name.removesuffix(".json")) <= last - keep:
                fs.delete(s.getPath(), False)
            else:
                version = json.loads(self.spark.read.text(s.getPath().toString(), wholetext=True).first()[0])
                named |= {*version["parts"].values(), version.get("aside")}
        gone = 0
        data = at(f"{self.path}/data")
        for write in fs.listStatus(data) if fs.exists(data) else []:
            for part in fs.listStatus(write.getPath()):
                path = f"data/{write.getPath().getName()}/{part.getPath().getName()}"
                if part.isDirectory() and path not in named:
                    fs.delete(part.getPath(), True)
                    gone += 1
            if not any(s.isDirectory() for s in fs.listStatus(write.getPath())):
                fs.delete(write.getPath(), True)
        return gone


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """The hash bucket of a row's keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def create_keyed(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], buckets: int) -> PartStore:
    """A table of rows in hash buckets of its keys, which must be unique and not null."""
    store = PartStore(spark, path)
    if store.exists():
        raise QualityError(f"there is a table at {path}")
    _touched(rows, keys, buckets)
    store.commit(rows, bucket_of(keys, buckets), None, settings={"keys": list(keys), "buckets": buckets})
    return store


def _touched(rows: DataFrame, keys: Sequence[str], buckets: int) -> list[str]:
    """The buckets of the rows' keys, at most `buckets`; raises where a key repeats or holds a null."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    each = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    found = each.agg(F.count_if(null).alias("nulls"), F.count_if(F.col("_n") > 1).alias("repeated"), F.collect_set(bucket_of(keys, buckets)).alias("touched")).first()
    if found["nulls"] or found["repeated"]:
        raise QualityError(f"keys {list(keys)}: {found['repeated']} values repeat, {found['nulls']} hold a null")
    return sorted(str(b) for b in found["touched"])


def _merge(store: PartStore, source: DataFrame, change: Callable[[DataFrame, DataFrame, Sequence[str]], DataFrame]) -> list[str]:
    """Applies a merge to the buckets that the source's keys hit, and gives their names."""
    base = store.version()
    keys, buckets = base["settings"]["keys"], base["settings"]["buckets"]
    touched = _touched(source, keys, buckets)
    if touched:
        target = store._load(base, touched)
        kept = change(target, source, keys).select(*target.columns)
        store.commit(kept, bucket_of(keys, buckets), touched, base)
    return touched


def load_resolved(store: PartStore, rows: DataFrame, master: DataFrame, key: str, part: Column, keys: Sequence[str] = (), most_dropped: float = 1.0, touched: Iterable[str] | None = None) -> dict[str, int]:
    """Writes the rows whose key the master has, puts the others aside, and gives the report of
    quality.resolution_report(): total, kept, dropped, offenders.

    One pass over rows: both kinds are written together, and what is reported and required is counted in what
    was written (most of it in the files' footers), before that becomes the table.  Raises, and leaves the table as
    it was, where more than the share most_dropped of all rows has no place or one of `keys` repeats or is null.
    """
    known = master.select(key).distinct().withColumn("_known", F.lit(True))
    placed = rows.join(known, key, "left").select(*rows.columns, F.when(F.col("_known"), part.cast("string")).otherwise(_REJECTED).alias("_where"))
    report: dict[str, int] = {}

    def check(written: DataFrame) -> None:
        counts = {r[_PART]: r["count"] for r in written.groupBy(_PART).count().collect()}  # a row for each part
        lost = written.filter(F.col(_PART) == _REJECTED)
        offenders = lost.agg(F.count_distinct(F.coalesce(F.col(key).cast("string"), F.lit("\0")))).first()[0]
        total, dropped = sum(counts.values()), counts.get(_REJECTED, 0)
        report.update(total=total, kept=total - dropped, dropped=dropped, offenders=offenders)
        if dropped > most_dropped * total:
            raise QualityError(f"{dropped} of {total} rows have a {key} that the master lacks: {offenders} different ones")
        if keys:
            require_empty(primary_key_violations(written.filter(F.col(_PART) != _REJECTED), keys), f"keys {list(keys)}")

    wanted = None if touched is None else [*touched, _REJECTED]
    store.commit(placed, F.col("_where"), wanted, check=check, aside=_REJECTED, drop=("_where",))
    return report


def merge_all(store: PartStore, source: DataFrame) -> list[str]:
    """Source rows replace rows of their keys; the others are added."""
    return _merge(store, source, U.upsert)


def merge_preserving(store: PartStore, source: DataFrame, update: Sequence[str]) -> list[str]:
    """Known keys take the `update` columns; new keys are added whole."""
    return _merge(store, source, lambda t, s, k: U.upsert_preserving(t, s, k, update))


def merge_missing(store: PartStore, source: DataFrame) -> list[str]:
    """Only rows of new keys are added."""
    return _merge(store, source, U.insert_missing)


def merge_existing(store: PartStore, source: DataFrame, update: Sequence[str]) -> list[str]:
    """Known keys take the `update` columns; nothing is added."""
    return _merge(store, source, lambda t, s, k: U.update_existing(t, s, k, update))
