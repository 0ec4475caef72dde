"""A table format of our own, as a Python data source: parquet files named by a manifest, filters pushed to their row groups, writes that count as a whole or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq, ge, gt, le, lt

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

MANIFEST = "_manifest.json"
COMPARED = {EqualTo: ("=", pc.equal), GreaterThan: (">", pc.greater), GreaterThanOrEqual: (">=", pc.greater_equal), LessThan: ("<", pc.less), LessThanOrEqual: ("<=", pc.less_equal)}
#: Whether a row group whose values go from a to b can hold one that compares so with x.
CAN_HOLD = {"=": lambda a, b, x: le(a, x) and ge(b, x), ">": lambda a, b, x: gt(b, x), ">=": lambda a, b, x: ge(b, x), "<": lambda a, b, x: lt(a, x), "<=": lambda a, b, x: le(a, x)}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def listed(path: str) -> list[str]:
    """The files of the committed table; none if nothing was committed."""
    store, root = opened(path)
    if store.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.NotFound:
        return []
    with store.open_input_file(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def replaced(path: str, names: list[str]) -> None:
    """A new manifest, in one step."""
    store, root = opened(path)
    with store.open_output_stream(f"{root}/{MANIFEST}.{(mark := uuid.uuid4().hex)}") as out:
        out.write(json.dumps(names).encode())
    store.move(f"{root}/{MANIFEST}.{mark}", f"{root}/{MANIFEST}")


@dataclass
class Group(InputPartition):
    file: str
    group: int


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class Parts(DataSource):
    """``path``: the table's folder, which driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "tessera_parts"

    def schema(self) -> StructType:
        names = listed(self.options["path"])
        if not names:
            raise ValueError(f"no table was committed in {self.options['path']}")
        store, root = opened(self.options["path"])
        return from_arrow_schema(pq.read_schema(f"{root}/{names[0]}", filesystem=store))

    def reader(self, schema: StructType) -> DataSourceReader:
        return PartsReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> PartsWriter:
        return PartsWriter(self.options["path"], overwrite, int(self.options.get("group_rows", 100_000)))


class PartsReader(DataSourceReader):
    """A partition for each row group whose statistics allow a row that meets the pushed filters; the rows are filtered before they leave Python."""

    def __init__(self, path: str) -> None:
        self.path, self.met = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in COMPARED and len(f.attribute) == 1 and f.value is not None:
                self.met.append((COMPARED[type(f)][0], f.attribute[0], f.value))
            elif isinstance(f, In) and len(f.attribute) == 1 and None not in f.value:
                self.met.append(("in", f.attribute[0], tuple(f.value)))
            elif isinstance(f, IsNotNull) and len(f.attribute) == 1:
                self.met.append(("known", f.attribute[0], None))
            else:
                yield f

    def possible(self, group: pq.RowGroupMetaData, names: dict[str, int]) -> bool:
        for sign, column, x in self.met:
            found = group.column(names[column]).statistics if column in names else None
            if found is None or not found.has_min_max:
                continue
            if sign in CAN_HOLD and not CAN_HOLD[sign](found.min, found.max, x):
                return False
            if sign == "in" and not any(found.min <= v <= found.max for v in x):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        store, root = opened(self.path)
        out = []
        for name in listed(self.path):
            meta = pq.read_metadata(f"{root}/{name}", filesystem=store)
            columns = {meta.schema.column(k).path: k for k in range(meta.num_columns)}
            out += [Group(name, k) for k in range(meta.num_row_groups) if self.possible(meta.row_group(k), columns)]
        return out or [Group("", -1)]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        if partition.group < 0:
            return
        store, root = opened(self.path)
        rows = pq.ParquetFile(f"{root}/{partition.file}", filesystem=store).read_row_group(partition.group)
        tests = {sign: test for sign, test in COMPARED.values()} | {"in": lambda c, x: pc.is_in(c, pa.array(x, c.type)), "known": lambda c, _: pc.is_valid(c)}
        for sign, column, x in self.met:
            rows = rows.filter(tests[sign](rows.column(column), x))
        yield from rows.to_batches()


class PartsWriter(DataSourceArrowWriter):
    """Each task writes a file of its own; only the driver's commit names them, so lost and repeated attempts leave no rows."""

    def __init__(self, path: str, overwrite: bool, group_rows: int) -> None:
        self.path, self.overwrite, self.group_rows = path, overwrite, group_rows

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        name, out, n = f"{uuid.uuid4().hex}.parquet", None, 0
        try:
            for batch in iterator:
                out = out or pq.ParquetWriter(f"{root}/{name}", batch.schema, filesystem=store, compression="zstd")
                out.write_batch(batch, row_group_size=self.group_rows)
                n += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else "", n)

    def commit(self, messages: list[Written | None]) -> None:
        names = [m.file for m in messages if m is not None and m.file]
        replaced(self.path, names if self.overwrite else [*listed(self.path), *names])

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        for m in messages:
            if m is not None and m.file:
                store.delete_file(f"{root}/{m.file}")
