"""A folder of paged JSON as a data source of Spark, for batches and streams.

A page is a file that holds one JSON document a line, each with a list of records: ``{"page": 3, "records": [{...}, ...]}``. A partition
is a page, so pages are fetched side by side and a lost executor costs one page. A stream's offset is the name of the last
page that was read: new pages get names that sort behind (what was read is never looked at again), and a query that was killed goes on
from its checkpoint. Files are listed and opened through pyarrow's file systems, so the folder may lie in any store these reach.

    spark.dataSource.register(Pages)
    spark.read.format("pages").schema("station_id long, value double").load(folder)
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def names(path: str) -> list[str]:
    """The pages of a folder in the order of their names. Hidden files and those that are still written don't count."""
    store, at = _at(path)
    found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._" and not f.base_name.endswith(".tmp"))


class Page(InputPartition):
    def __init__(self, path: str, name: str):
        self.path, self.name = path, name


def _plain(value: object, kind: pa.DataType) -> object:
    """A JSON value as the column's type holds it; null if it can't."""
    try:
        if value is None or pa.types.is_string(kind):
            return value if value is None or isinstance(value, str) else json.dumps(value)
        if pa.types.is_boolean(kind):
            return value if isinstance(value, bool) else None
        return pa.array([value]).cast(kind)[0].as_py()
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, pa.ArrowTypeError, OverflowError):
        return None


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """At once where all values are of the type, else one by one."""
    kinds = {type(v) for v in values} - {type(None)}
    fit = {bool} if pa.types.is_boolean(kind) else {int} if pa.types.is_integer(kind) else {int, float} if pa.types.is_floating(kind) else {str} if pa.types.is_string(kind) else set()
    if kinds <= fit:
        try:
            return pa.array(values, kind)
        except (pa.ArrowInvalid, OverflowError):
            pass
    return pa.array([_plain(v, kind) for v in values], kind)


class _Read:
    """Both readers: what a page's records are as rows."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.path, self.strict = options["path"], options.get("mode", "DROPMALFORMED").upper() == "FAILFAST"
        self.arrow = to_arrow_schema(schema)

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        """A batch a document. A line that isn't such a document and a record that isn't an object are left out, or an error with
        the option mode FAILFAST; a field of another type is null, an unknown one is ignored."""
        store, at = _at(self.path)
        with store.open_input_stream(f"{at.rstrip('/')}/{partition.name}") as file:
            lines = file.read().decode("utf-8", "replace").splitlines()
        for line in lines:
            try:
                records = json.loads(line)["records"]
                if not isinstance(records, list):
                    raise TypeError("records must be a list")
            except (ValueError, TypeError, KeyError):
                if self.strict and line.strip():
                    raise ValueError(f"page {partition.name} holds a line that is no document") from None
                continue
            rows = [r for r in records if isinstance(r, dict)]
            if self.strict and len(rows) < len(records):
                raise ValueError(f"page {partition.name} holds a record that is no object")
            columns = [_column([r.get(f.name) for r in rows], f.type) for f in self.arrow]
            yield pa.RecordBatch.from_arrays(columns, schema=self.arrow)


class PagesReader(_Read, DataSourceReader):
    def partitions(self) -> list[Page]:
        return [Page(self.path, n) for n in names(self.path)] or [Page(self.path, "")]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        return super().read(partition) if partition.name else iter(())


class PagesStream(_Read, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(names(self.path), default="")}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(self.path, n) for n in names(self.path) if start["after"] < n <= end["after"]]

    def commit(self, end: dict) -> None:
        pass


class Pages(DataSource):
    """The format ``pages``: the schema must be given."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        raise ValueError("give the records' schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagesReader(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PagesStream(schema, self.options)
