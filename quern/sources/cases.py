"""Evaluation cases as folders (input, expected, meta) behind ``spark.read.format("case_folders")``.

One input partition is a group of folders, so a case is read by one task without a shuffle, and a filter on the
case's identifier is applied to the names of the folders. Writing makes the same folders. Paths are those that
pyarrow's file systems know (file://, hdfs://, s3://, gs://) and every executor reaches.
"""
from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

SCHEMA = "case_id string, type string, lang string, checked boolean, input string, expected string"
#: Folders of one input partition.
GROUP = 64
#: Ending of the input's file by the type of the case.
ENDINGS = {"url": "html", "text": "txt"}


def _file_system(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class Folders(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(names)
        self.names = names


class CaseReader(DataSourceReader):
    def __init__(self, path: str, group: int):
        self.path, self.group, self.only = path, group, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("case_id",):
                self._keep({f.value})
            elif isinstance(f, In) and f.attribute == ("case_id",):
                self._keep(set(f.value))
            else:
                yield f

    def _keep(self, names: set) -> None:
        self.only = names if self.only is None else self.only & names

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs
        store, root = _file_system(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        names = sorted(f.base_name for f in found if f.type == fs.FileType.Directory and (self.only is None or f.base_name in self.only))
        return [Folders(names[i:i + self.group]) for i in range(0, len(names), self.group)] or [Folders([])]

    def read(self, partition: Folders) -> Iterator[tuple]:
        from pyarrow import fs
        store, root = _file_system(self.path)
        for name in partition.names:
            parts = {}
            for f in store.get_file_info(fs.FileSelector(f"{root}/{name}")):
                part = f.base_name.split(".", 1)[0]
                if f.type == fs.FileType.File and part in ("input", "expected", "meta"):
                    with store.open_input_stream(f.path) as s:
                        parts[part] = s.read().decode("utf-8", "replace")
            meta = _object(parts.get("meta"))
            if isinstance(meta.get("type"), str):       # a folder without its type is no case
                lang, checked = meta.get("language"), meta.get("checked")
                yield name, meta["type"], lang if isinstance(lang, str) else None, checked if isinstance(checked, bool) else None, parts.get("input"), parts.get("expected")


def _object(text: str | None) -> dict:
    try:
        found = json.loads(text or "")
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


class CaseWriter(DataSourceWriter):
    """A case that is there already is written over: a task that runs again makes the same files."""

    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, root = _file_system(self.path)
        for row in rows:
            case = dict(zip(self.names, row, strict=True))
            if not case["case_id"] or "/" in case["case_id"] or case["case_id"].startswith("."):
                raise ValueError(f"no name for a folder: {case['case_id']!r}")
            folder = f"{root}/{case['case_id']}"
            store.create_dir(folder, recursive=True)
            meta = {"type": case["type"], "language": case["lang"], "checked": case["checked"]}
            for name, text in ((f"input.{ENDINGS.get(case['type'], 'txt')}", case["input"]), ("expected.json", case["expected"]), ("meta.json", json.dumps(meta))):
                if text is not None:
                    with store.open_output_stream(f"{folder}/{name}") as s:
                        s.write(text.encode())
        return WriterCommitMessage()


class CaseFolders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "case_folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaseReader:
        return CaseReader(self.options["path"], int(self.options.get("group", GROUP)))

    def writer(self, schema, overwrite: bool) -> CaseWriter:
        return CaseWriter(self.options["path"], schema.names)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaseFolders)
