"""Sharding by size-tiered compaction: small immutable shards, merged runs, versioned manifests.

A store is a folder: ``data/`` holds parquet shards that are never changed,
``lists/`` JSON files that list up to ``PART`` shards with their sizes and are
never changed either, ``manifest/`` one JSON file for each version that names its
lists. A list holds either open shards (up to half the target size, to be merged)
or settled ones, so a commit writes the lists that it touches and compaction reads
the open ones: neither grows with the shards that have reached their size.
``append`` writes arrivals as they come, one small
shard for each task, without a shuffle; ``append_each`` writes many arrivals in
one pass over the rows. ``compact`` sorts shards into tiers by size (each
``fan_in`` times the one below) and merges the runs of a tier with ``fan_in``
shards or more into larger files up to the target size; merging only narrows
partitions, so it doesn't shuffle either.

A version is committed in one step that fails if the version exists: a rename
that doesn't replace (a hard link on a local disk) shows the whole manifest
under its name. A writer that dies before it leaves a draft that nobody reads,
and no lock. Of two writers one has to try again, from the newer version and
without writing its shards again. The store needs a file system whose rename is
atomic, as HDFS's is. Shards of tasks that were lost or ran twice are never
listed. ``vacuum`` deletes versions before the newest ``keep`` and the shards
that only these list, so each version that is kept can be read.

Cases: nulls in any column and empty texts are kept as they are, repeated rows
too; columns are free, as a shard's schema is the arrival's, and arrivals whose
schemas differ are refused. An empty arrival commits a version with no new
shards, but keeps the schema. Rows are never split, so a row of a very long text
can make a shard larger than the target. Of several tiers that are full the
lowest is merged first, shards of one tier in the order of the manifest. The
column that ``placed`` adds is named ``shard``, with underscores if the table has
such a column. Shards settle by the target size of the store that commits them; a
larger target later doesn't open them again.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.common import unused

#: Sizes of files, and shards of a tier that are merged at once at least.
TARGET_BYTES = 128 << 20
SMALLEST_TIER_BYTES = 1 << 20
FAN_IN = 4
#: Versions that ``vacuum`` keeps, and times that a commit is tried while others commit too.
KEEP, TRIES = 10, 50
#: Shards of a list.
PART = 1000


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Shard:
    file: str
    bytes: int
    tier: int
    #: Shards that were written in its folder; 0 if that isn't known.
    of: int = 0


@dataclass(frozen=True)
class Part:
    """A list of shards, all of them open or all settled."""

    file: str
    shards: int
    open: bool


class Store:
    """A sharded table in a folder that the driver and the executors share. Only names and sizes of shards pass through the driver."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, smallest_bytes: int = SMALLEST_TIER_BYTES) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.target_bytes, self.fan_in, self.smallest_bytes = target_bytes, fan_in, smallest_bytes
        self._files = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def tier(self, size: int) -> int:
        return max(0, math.ceil(math.log(max(size, 1) / self.smallest_bytes, self.fan_in)))

    # --- manifests

    def version(self) -> int:
        """The newest version; 0 if nothing has been committed."""
        return max(self.versions(), default=0)

    def parts(self, version: int | None = None) -> tuple[list[Part], StructType | None]:
        """Lists and schema of a version, the newest if none is named."""
        version = self.version() if version is None else version
        if version == 0:
            return [], None
        said = self._load(f"manifest/{version:012d}.json")
        return [Part(*x) for x in said["parts"]], StructType.fromJson(said["schema"])

    def listed(self, parts: list[Part]) -> list[Shard]:
        return [Shard(*x) for p in parts for x in self._load(p.file)]

    def manifest(self, version: int | None = None) -> tuple[list[Shard], StructType | None]:
        """Shards and schema of a version, the newest if none is named."""
        parts, schema = self.parts(version)
        return self.listed(parts), schema

    def _load(self, name: str):
        stream = self._files.open(self._at(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _save(self, name: str, said) -> None:
        out = self._files.create(self._at(name), False)
        try:
            out.write(bytearray(json.dumps(said).encode()))
        finally:
            out.close()

    def _is_open(self, s: Shard) -> bool:
        return s.bytes <= self.target_bytes // 2

    def _lists(self, shards: list[Shard]) -> list[Part]:
        """Lists of the shards, written."""
        made = []
        for kind in (False, True):
            of = [s for s in shards if self._is_open(s) == kind]
            for k in range(0, len(of), PART):
                some = of[k : k + PART]
                made.append(Part(f"lists/{uuid.uuid4().hex}.json", len(some), kind))
                self._save(made[-1].file, [[s.file, s.bytes, s.tier, s.of] for s in some])
        return made

    def commit(self, base: int, shards: list[Part | Shard], schema: StructType) -> int:
        """Makes ``base + 1`` the newest version, of lists that stay and shards that are listed anew, or raises CommitConflict if it exists."""
        fresh = self._lists([s for s in shards if isinstance(s, Shard)])
        parts = [p for p in shards if isinstance(p, Part)] + fresh
        draft = f"manifest/.{uuid.uuid4().hex}"
        self._save(draft, {"parts": [[p.file, p.shards, p.open] for p in parts], "schema": json.loads(schema.json())})
        try:
            self._show(self._at(draft), self._at(f"manifest/{base + 1:012d}.json"))
        except Exception as error:
            if "FileAlreadyExistsException" in str(error):
                self._delete(fresh)
                raise CommitConflict(f"version {base + 1} of {self.path} exists") from None
            raise
        finally:
            self._files.delete(self._at(draft), False)
        return base + 1

    def _show(self, draft, final) -> None:
        """Gives the draft its final name in one step, which fails if that exists."""
        jvm, place = self.spark._jvm, self._files.makeQualified(final).toUri()
        if place.getScheme() == "file":  # a rename would replace
            local = lambda path: jvm.java.nio.file.Path.of(self._files.makeQualified(path).toUri())
            jvm.java.nio.file.Files.createLink(local(final), local(draft))
        else:
            none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(place, self.spark._jsc.hadoopConfiguration()).rename(draft, final, none)

    def change(self, added: list[Shard], schema: StructType, gone: frozenset[str] = frozenset()) -> int:
        """Commits the newest version with shards added and others gone; if another writer commits first, once more from its version, unless that has lost one of the shards."""
        for _ in range(TRIES):
            base = self.version()
            parts, known = self.parts(base)
            if known is not None and known.simpleString() != schema.simpleString():
                raise ValueError(f"arrivals have {schema.simpleString()}, the store {known.simpleString()}")
            stay, loose, missing = [], [], set(gone)
            for p in parts:
                found = self.listed([p]) if missing and p.open else []
                left = [s for s in found if s.file not in gone]
                if len(left) < len(found):
                    loose += left
                    missing -= {s.file for s in found}
                else:
                    stay.append(p)
            if missing:
                raise CommitConflict(f"another writer has merged shards of version {base} of {self.path}")
            # short lists take in what is listed anew of their kind, so lists stay few
            kinds = {self._is_open(s) for s in loose + added}
            short = [p for p in stay if p.open in kinds and p.shards < PART // 2]
            try:
                return self.commit(base, [p for p in stay if p not in short] + self.listed(short) + loose + added, schema)
            except CommitConflict:
                continue
        raise CommitConflict(f"others committed to {self.path} {TRIES} times")

    # --- shards

    def _in(self, folder: str) -> list[Shard]:
        found = sorted((s.getPath().getName(), s.getLen()) for s in self._files.listStatus(self._at(folder)))
        found = [(name, size) for name, size in found if name.startswith("part-")]
        return [Shard(f"{folder}/{name}", size, self.tier(size), len(found)) for name, size in found]

    def _write(self, df: DataFrame) -> list[Shard]:
        """Shards of a frame, one for each task that has rows."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return self._in(folder)

    def _refuse(self, arrivals: DataFrame) -> StructType:
        """The schema that arrivals are committed under; raises if the store has another."""
        wanted = StructType.fromJson(json.loads(arrivals.schema.json()))
        for field in wanted.fields:
            field.nullable = True
        _, schema = self.parts()
        if schema is not None and schema.simpleString() != wanted.simpleString():
            raise ValueError(f"arrivals have {wanted.simpleString()}, the store {schema.simpleString()}")
        return wanted

    def append(self, arrivals: DataFrame) -> int:
        """Adds rows as small shards and commits."""
        schema = self._refuse(arrivals)
        return self.change(self._write(arrivals), schema)

    def append_each(self, rows: DataFrame, arrival: Column, arrivals: int) -> Iterator[int]:
        """Commits the rows of each arrival (numbered from 0) in its order, written in one pass; yields the versions."""
        schema = self._refuse(rows)
        folder, (name,) = f"data/{uuid.uuid4().hex}", unused(rows.columns, "arrival")
        rows.withColumn(name, arrival).write.partitionBy(name).parquet(f"{self.path}/{folder}")
        for k in range(arrivals):
            part = f"{folder}/{name}={k}"
            yield self.change(self._in(part) if self._files.exists(self._at(part)) else [], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        shards, schema = self.manifest(version)
        if schema is None:
            raise ValueError(f"{self.path} has no version")
        return self._rows(shards, schema)

    def _rows(self, shards: list[Shard], schema: StructType) -> DataFrame:
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{x}" for x in paths(shards)))

    def plan(self, shards: list[Shard]) -> list[Shard]:
        """The run to merge next: all shards of the lowest tier that has ``fan_in`` of them below half the target."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if self._is_open(s):
                tiers.setdefault(s.tier, []).append(s)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fan_in), [])

    def compact(self) -> int:
        """Merges run after run, each into files of the target size or one smaller file, until no tier has ``fan_in`` shards; each merge is a version."""
        while True:
            base = self.version()
            parts, schema = self.parts(base)
            run = self.plan(self.listed([p for p in parts if p.open]))
            if not run:
                return base
            total = sum(s.bytes for s in run)
            # a run is rewritten once, however many tiers its files rise
            files = max(1, math.ceil(total / self.target_bytes))
            merged = self._write(self._rows(run, schema).coalesce(files))
            if len(merged) >= len(run):
                self._delete(merged)
                return base
            # a merged shard is a tier above its run, whatever its compression came to
            floor = run[0].tier + 1
            try:
                self.change([Shard(s.file, s.bytes, max(s.tier, floor), s.of) for s in merged], schema, frozenset(s.file for s in run))
            except CommitConflict:
                self._delete(merged)
                raise

    def _delete(self, files: list[Shard] | list[Part]) -> None:
        for x in files:
            self._files.delete(self._at(x.file), False)

    def versions(self) -> list[int]:
        """The versions that can be read."""
        names = (s.getPath().getName() for s in self._files.listStatus(self._at("manifest"))) if self._files.exists(self._at("manifest")) else ()
        return sorted(int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit())

    def vacuum(self, keep: int = KEEP) -> list[int]:
        """Deletes all versions but the newest ``keep`` and the shards that only those list; gives the versions deleted. A reader of a version that goes should have ended."""
        found = self.versions()
        old, kept = found[: -max(1, keep)], found[-max(1, keep) :]
        named = [{p.file: p for v in some for p in self.parts(v)[0]} for some in (old, kept)]
        lists = [p for file, p in named[0].items() if file not in named[1]]
        # every list is read once, however many versions name it
        needed = {s.file for s in self.listed([*named[1].values()])} if lists else set()
        gone = {s.file: s for s in self.listed(lists) if s.file not in needed}
        for v in old:  # the manifests first: no version lists a shard that isn't there
            self._files.delete(self._at(f"manifest/{v:012d}.json"), False)
        self._delete(lists)
        self._delete([*gone.values()])
        return old

    def placed(self) -> DataFrame:
        """The rows of the newest version with ``shard``, the file that holds each."""
        rows = self.read()
        (name,) = unused(rows.columns, "shard")
        if not self.parts()[0]:  # no shard, no file that a row could name
            return rows.withColumn(name, F.lit(""))
        return rows.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), r"(data/[0-9a-f]{32}/.+)$", 1))

    def delete_at_end(self) -> None:
        self._files.deleteOnExit(self._at(""))


def paths(shards: list[Shard]) -> list[str]:
    """What to read: a folder whose shards are all listed by its own path, so the paths passed on are few; of others the files."""
    folders: dict[str, list[Shard]] = {}
    for s in shards:
        folders.setdefault(s.file.rpartition("/")[0], []).append(s)
    return [x for folder, of in folders.items() for x in ([folder] if len(of) == of[0].of else [s.file for s in of])]


def shard(df: DataFrame, path: str, arrivals: int = 4, id_col: str = "doc_id", keep: int = KEEP, **sizes) -> Store:
    """A store of the rows, arriving in so many parts (by a hash of the id), compacted after each half of them; its newest ``keep`` versions stay."""
    store = Store(df.sparkSession, path, **sizes)
    for k, _ in enumerate(store.append_each(df, F.pmod(F.xxhash64(id_col), F.lit(arrivals)).cast("int"), arrivals)):
        if k % 2 or k == arrivals - 1:
            store.compact()
    store.vacuum(keep)
    return store
