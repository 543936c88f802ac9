"""Tables of a store: folders of Parquet that are partitioned by dataset and sorted by what is looked up.

Writes append; nothing is overwritten in place. Every write has a version; a log says which versions are
complete, and rows of a write that failed are never read. The table ``ids`` has the documents there are, ``stale`` those
that were replaced since, so that replacing documents costs what they cost, not what the dataset does. ``rewrite`` makes
the folder of a dataset anew beside the old one and puts it in its place by renaming, ``compact`` all of a table."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T

SCHEMAS = {
    "blobs": "dataset string, kind string, key string, type string, properties array<string>, labels array<string>, value string, content binary, version bigint, ts timestamp",
    "postings": "dataset string, way string, doc_id string, field string, term_type tinyint, term string, term_rev string, term_num decimal(38,18), labels array<string>, n bigint, version bigint",
    "counts": "dataset string, way string, field string, term_type tinyint, term string, term_rev string, term_num decimal(38,18), labels array<string>, n_docs bigint, version bigint",
    "hashes": "dataset string, field string, hash string, doc_id string, version bigint",
    "ids": "dataset string, doc_id string, version bigint",
    "stale": "dataset string, doc_id string, version bigint",
    "cache": "dataset string, cache_id string, key string, value string, ts timestamp",
}
#: Folders within a table: a reader of one kind of blobs, or of one direction of terms, opens its files alone.
PARTS = {"blobs": ["dataset", "kind"], "postings": ["dataset", "way"], "counts": ["dataset", "way"]}
#: What the rows of a table are looked up by, and what its row-range operations mean by a row.
KEYS = {"blobs": "key", "postings": "term", "counts": "term", "hashes": "hash", "ids": "doc_id", "stale": "doc_id", "cache": "key"}
#: What a family of columns is in each table.
FAMILIES = {"blobs": "kind", "postings": "field", "counts": "field", "hashes": "field", "cache": "cache_id"}
FORWARD, BACKWARD = "f", "b"


def columns_of(schema: str) -> list[tuple[str, str]]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            name, kind = schema[start:i].strip().split(" ", 1)
            out.append((name, kind))
            start = i + 1
    return out


def both_ways(rows: DataFrame) -> DataFrame:
    """Rows of terms for forward lookups, and of strings for lookups of the reversed term as well."""
    string = F.col("term_type") == T.STRING
    way = F.explode(F.when(string, F.array(F.lit(FORWARD), F.lit(BACKWARD))).otherwise(F.array(F.lit(FORWARD))))
    return rows.withColumn("way", way).withColumn("term_rev", F.when(F.col("way") == BACKWARD, F.reverse("term")))


class Tables:
    """Lifecycle of the tables of one store, for a user of a registry if one is given."""

    def __init__(self, spark: SparkSession, path: str, registry=None, user: str | None = None):
        self.spark, self.path, self.registry, self.user = spark, path.rstrip("/"), registry, user

    # permissions

    def check(self, permission: str, name: str | None = None) -> None:
        """Raise PermissionError unless the user holds a permission on a table, or on the system if none is named.
        Without a registry everything is allowed."""
        if self.registry is not None and not self.registry.has(self.user, permission, name):
            raise PermissionError(f"{self.user} lacks {permission}{f' on {name}' if name else ''}")

    # files

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _delete(self, path: str) -> None:
        fs, where = self._fs(path)
        fs.delete(where, True)

    def _move(self, path: str, to: str) -> None:
        fs, where = self._fs(path)
        if not fs.rename(where, self._fs(to)[1]):
            raise OSError(f"can't rename {path} to {to}")

    def _list(self, path: str) -> list[str]:
        fs, where = self._fs(path)
        return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []

    def size(self, path: str) -> int:
        """Bytes of a file, or of all files in a folder."""
        fs, where = self._fs(path)
        return fs.getContentSummary(where).getLength()

    def _text(self, path: str, content: str | None = None) -> str | None:
        """The content of a small file, written first if it is given."""
        fs, where = self._fs(path)
        if content is not None:
            out = fs.create(where, True)
            out.write(bytearray(content.encode()))
            out.close()
            return content
        if not fs.exists(where):
            return None
        stream = fs.open(where)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def place(self, name: str) -> str:
        return f"{self.path}/{name}"

    def beside(self, name: str) -> str:
        return f"{self.path}/_{name}_{time.time_ns()}"

    # tables

    def all(self) -> list[str]:
        return [n for n in self._list(self.path) if n[:1] not in "_."]

    def exists(self, name: str) -> bool:
        fs, where = self._fs(self.place(name))
        return fs.exists(where)

    def create(self, name: str, schema: str | None = None) -> bool:
        """An empty table; False if there is one. A schema is needed for tables other than the store's own."""
        self.check("CREATE_TABLE")
        if self.exists(name):
            return False
        kinds = schema or SCHEMAS[name]
        self.spark.createDataFrame([], kinds).write.parquet(self.place(name))
        self._set(name, schema=kinds)
        return True

    def delete(self, name: str) -> bool:
        self.check("DROP_TABLE", name)
        there = self.exists(name)
        self._delete(self.place(name))
        self._delete(f"{self.path}/_properties/{name}")
        return there

    truncate = delete

    def rename(self, name: str, to: str) -> bool:
        self.check("ALTER_TABLE", name)
        if not self.exists(name) or self.exists(to):
            return False
        own = {"schema": self._schema(name), "like": self._like(name)} | self.properties(name)
        self._move(self.place(name), self.place(to))
        self._delete(f"{self.path}/_properties/{name}")
        self._set(to, **own)
        return True

    def clone(self, name: str, to: str) -> bool:
        self.check("READ", name)
        self.check("CREATE_TABLE")
        if not self.exists(name) or self.exists(to):
            return False
        self._load(name).write.partitionBy(*self._parts(name)).parquet(self.place(to))
        self._set(to, **{"schema": self._schema(name), "like": self._like(name)} | self.properties(name))
        return True

    # properties: what a table is like, splits, options

    def properties(self, name: str) -> dict:
        return json.loads(self._text(f"{self.path}/_properties/{name}") or "{}")

    def _set(self, name: str, **values) -> None:
        self._text(f"{self.path}/_properties/{name}", json.dumps(self.properties(name) | values, sort_keys=True))

    def _like(self, name: str) -> str:
        return name if name in SCHEMAS else self.properties(name).get("like", name)

    def _schema(self, name: str) -> str:
        return SCHEMAS[name] if name in SCHEMAS else self.properties(name).get("schema") or SCHEMAS[self._like(name)]

    def _parts(self, name: str) -> list[str]:
        known = [c for c, _ in columns_of(self._schema(name))]
        parts = [c for c in PARTS.get(self._like(name), ["dataset"]) if c in known]
        return parts if len(parts) < len(known) else []

    def split(self, name: str, points: list[str]) -> None:
        """Later writes have files of their own between these rows."""
        self.check("ALTER_TABLE", name)
        self._set(name, splits=sorted({*self.splits(name), *points}))

    def splits(self, name: str) -> list[str]:
        return self.properties(name).get("splits", [])

    def bloom_filter(self, name: str, on: bool = True) -> None:
        """Later writes keep a Bloom filter of the rows with each row group."""
        self.check("ALTER_TABLE", name)
        self._set(name, bloom=on)

    def block_cache(self, name: str, on: bool = True) -> None:
        """Whether what is read of the table stays in the memory of the executors."""
        self.check("ALTER_TABLE", name)
        self._set(name, cache=on)

    def tune(self, name: str, **options) -> None:
        """Options of later writes, as Parquet and Spark name them with underscores for dots: parquet_block_size, compression."""
        self.check("ALTER_TABLE", name)
        self._set(name, options=self.properties(name).get("options", {}) | {k.replace("_", "."): str(v) for k, v in options.items()})

    def set_locality_groups(self, name: str, groups: dict[str, list[str]]) -> None:
        """Later writes keep the rows of each group of families together within their files, so that row groups of other
        families are passed over."""
        self.check("ALTER_TABLE", name)
        self._set(name, groups=groups)

    def locality_groups(self, name: str) -> dict[str, list[str]]:
        """Families that are stored together: the groups that are set, and the folders within datasets, each by its own name."""
        inner = self._parts(name)[1:]
        own = [r[0] for r in self._load(name).select(*inner).distinct().collect()] if inner and self.exists(name) else []
        return {c: [c] for c in sorted(own)} | self.properties(name).get("groups", {})

    # versions

    def begin(self) -> int:
        """A version for a write; one writer at a time."""
        known = [int(n.split(".")[0]) for n in self._list(f"{self.path}/_log")]
        version = max(known, default=0) + 1
        self._text(f"{self.path}/_log/{version:012d}.begun", "")
        return version

    def done(self, version: int) -> None:
        self._move(f"{self.path}/_log/{version:012d}.begun", f"{self.path}/_log/{version:012d}.done")

    def unfinished(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self._list(f"{self.path}/_log") if n.endswith(".begun")]

    # rows

    def _load(self, name: str, versions: bool = True) -> DataFrame:
        """All rows of complete writes, whoever asks."""
        schema = self._schema(name)
        if not self.exists(name):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(self.place(name))
        broken = self.unfinished() if versions and "version" in rows.columns else []
        return rows.where(F.col("version").isNull() | ~F.col("version").isin(broken)) if broken else rows

    def _current(self, name: str) -> DataFrame:
        """Rows without those of replaced documents."""
        rows = self._load(name)
        if not self.exists("stale") or "doc_id" not in rows.columns:
            return rows
        gone = self._load("stale").groupBy(F.col("dataset").alias("_dataset"), F.col("doc_id").alias("_doc")).agg(F.max("version").alias("_since"))
        return rows.join(gone, (F.col("dataset") == F.col("_dataset")) & (F.col("doc_id") == F.col("_doc")) & (F.col("version") < F.col("_since")), "left_anti")

    def read(self, name: str) -> DataFrame:
        self.check("READ", name)
        rows = self._current(name)
        return rows.cache() if self.properties(name).get("cache") else rows

    def append(self, name: str, rows: DataFrame, late: dict[str, Column] | None = None) -> None:
        """``late`` columns are made of the others once the rows are sorted, so that the sort doesn't hold them."""
        self.check("WRITE", name)
        self._write(name, rows, self.place(name), late)

    def _write(self, name: str, rows: DataFrame, path: str, late: dict[str, Column] | None = None) -> None:
        kinds = columns_of(self._schema(name))
        late = {c: F.lit(None) for c, _ in kinds if c not in rows.columns} | (late or {})
        early = dict(kinds).keys() - late.keys()
        sources = [F.col(f"`{c}`") for c in rows.columns if c not in early] if late else []
        parts, own = self._parts(name), self.properties(name)
        # no constants for Spark, which would not know the sort by a constant again, and sort anew with all columns
        held = lambda c, value: F.when(F.spark_partition_id() >= 0, value) if c in parts else value
        rows = rows.select(*[held(c, F.col(c).cast(k)).alias(c) for c, k in kinds if c in early], *sources)
        key = KEYS.get(self._like(name), kinds[0][0])
        order = F.when(F.col("way") == BACKWARD, F.col("term_rev")).otherwise(F.col("term")) if "way" in rows.columns else F.col(key)
        if own.get("splits"):
            place = F.lit(0)
            for point in own["splits"]:
                place = place + (F.coalesce(order, F.lit("")) > point).cast("int")
            rows = rows.repartitionById(len(own["splits"]) + 1, place)
        group = [F.coalesce(*[F.when(F.col(FAMILIES[self._like(name)]).isin(f), i) for i, f in enumerate(own["groups"].values())], F.lit(len(own["groups"])))] if own.get("groups") else []
        # sorted files: a lookup reads the row groups whose range holds the term or key
        rows = rows.sortWithinPartitions(*parts, *group, order).select(*[late.get(c, F.col(c)).cast(k).alias(c) for c, k in kinds])
        writer = rows.write.mode("append").partitionBy(*parts).options(**own.get("options", {}))
        for c in ("term", "term_rev", key) if own.get("bloom") else ():
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(path)

    def _folder(self, dataset: str) -> str:
        return "dataset=" + self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(dataset)

    def _there(self, path: str) -> bool:
        fs, where = self._fs(path)
        return fs.exists(where)

    def _swap(self, name: str, rows: DataFrame, dataset: str | None = None) -> None:
        """Put rows in the place of a table or of a dataset's part of it. If the job fails all is as it was; if the driver
        ends between the two renames, what was there is in the folder with the name ``_old``."""
        new, old = self.beside(name), self.beside(f"{name}_old")
        self._write(name, rows, new)
        if dataset is None:
            if not self._there(new):
                self.spark.createDataFrame([], self._schema(name)).write.parquet(new)
            self._move(self.place(name), old)
            self._move(new, self.place(name))
        else:
            own = self._folder(dataset)
            if self._there(f"{self.place(name)}/{own}"):
                self._move(f"{self.place(name)}/{own}", old)
            if self._there(f"{new}/{own}"):
                self._move(f"{new}/{own}", f"{self.place(name)}/{own}")
            self._delete(new)
        self._delete(old)

    # removal

    def remove_dataset(self, name: str, dataset: str) -> None:
        """Drop the folder of a dataset."""
        self.check("WRITE", name)
        self._delete(f"{self.place(name)}/{self._folder(dataset)}")

    def rewrite(self, name: str, dataset: str | None, keep: Column) -> None:
        """Keep the rows of a dataset (or of all) that meet a condition; a null condition doesn't keep a row."""
        self.check("WRITE", name)
        if not self.exists(name):
            return
        rows = self._load(name).where(F.coalesce(keep, F.lit(False)))
        if dataset is not None and self._parts(name)[:1] != ["dataset"]:
            raise ValueError(f"{name} has no datasets")
        self._swap(name, rows if dataset is None else rows.where(F.col("dataset") == dataset), dataset)

    def remove_families(self, name: str, families: list[str], dataset: str | None = None) -> None:
        """Without rows of some families: kinds of blobs, fields of terms and hashes, ids of caches."""
        family = F.col(FAMILIES[self._like(name)])
        gone = family.isin(families)
        if self._like(name) == "blobs":
            gone = gone | F.col("type").isin(families)
        self.rewrite(name, dataset, ~F.coalesce(gone, F.lit(False)))

    def _row(self, name: str) -> Column:
        return F.col(KEYS.get(self._like(name), columns_of(self._schema(name))[0][0]))

    def remove_ranges(self, name: str, ranges: list[tuple[str | None, str | None]], dataset: str | None = None) -> None:
        """Without rows in some ranges, both ends included, None for an open one."""
        row, gone = self._row(name), F.lit(False)
        for low, high in ranges:
            inside = row.isNotNull()
            inside = inside & (row >= low) if low is not None else inside
            gone = gone | (inside & (row <= high) if high is not None else inside)
        self.rewrite(name, dataset, ~F.coalesce(gone, F.lit(False)))

    def remove_cells(self, name: str, row: str | None = None, family: str | None = None, qualifier: str | None = None, dataset: str | None = None) -> None:
        """Without the rows that are as asked for; what is None is not looked at. A qualifier is a document, or a
        property of a blob."""
        if row is None and family is None and qualifier is None:
            raise ValueError("a row, family or qualifier is needed")
        gone = F.lit(True)
        if row is not None:
            gone = gone & self._row(name).eqNullSafe(row)
        if family is not None:
            own = F.col(FAMILIES[self._like(name)]).eqNullSafe(family)
            gone = gone & (own | F.col("type").eqNullSafe(family) if self._like(name) == "blobs" else own)
        if qualifier is not None:
            gone = gone & (F.col("doc_id").eqNullSafe(qualifier) if "doc_id" in self._schema(name) else F.array_contains("properties", qualifier))
        self.rewrite(name, dataset, ~F.coalesce(gone, F.lit(False)))

    def delete_rows(self, name: str, start: str | None = None, end: str | None = None, dataset: str | None = None) -> None:
        """Without rows after start up to end, the end included; None is open. Equal ends mean the row itself."""
        if start is not None and start == end and start:
            start = start[:-1] + chr(ord(start[-1]) - 1) if ord(start[-1]) else start[:-1]
        row = self._row(name)
        gone = row.isNotNull()
        gone = gone & (row > start) if start is not None else gone
        gone = gone & (row <= end) if end is not None else gone
        self.rewrite(name, dataset, ~F.coalesce(gone, F.lit(False)))
