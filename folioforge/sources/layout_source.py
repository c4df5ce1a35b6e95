"""Layout blocks as a Spark data source, batch and stream:

    spark.dataSource.register(LayoutBlocks)
    spark.read.format("layout_blocks").option("path", folder).load()

Files are listed on the driver, a partition for some of them, and read and parsed in workers, through pyarrow's file systems (local, HDFS, S3, ...). Stores that only
Spark reaches are read by `readers.files` and `structure.plain_blocks` instead. Options: path; suffixes (comma-joined, txt,md); parser (module:function from bytes and
file name to dicts of page_number, text and the other columns; without it plain text in pages of lines, cut at blank lines); lines_per_page; block_sep; bytes_per_partition.

A stream reads files that come later, in order of their time and path; its offset is the last one's. A file that comes with an older time than
one that was read already is not seen; writers move whole files into the folder.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "document_id string, path string, block_pos int, page_number int, text string, font_size double, font_name string, is_bold boolean, indent double, line_spacing double"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_BREAKS = re.compile("\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
_EDGES = re.compile(r"^\s+|\s+$", re.ASCII)


def plain_blocks_of(content: bytes, lines_per_page: int = 50, block_sep: str = r"\n{2,}") -> list[dict]:
    """Blocks of a plain text: the same as structure.plain_blocks."""
    lines = _BREAKS.sub("\n", content.decode("utf-8", "replace")).split("\n")
    out = []
    for at in range(0, len(lines), lines_per_page):
        for part in re.split(block_sep, "\n".join(lines[at : at + lines_per_page])):
            if text := _EDGES.sub("", part):
                out.append({"page_number": at // lines_per_page + 1, "text": text})
    return out


@dataclass(frozen=True)
class File:
    path: str
    size: int
    mtime_ns: int


@dataclass
class Files(InputPartition):
    files: tuple[File, ...]


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Layout:
    """What batch and stream share."""

    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("layout_blocks needs the option path")
        self.path = options["path"]
        self.suffixes = tuple("." + s.strip().lower() for s in options.get("suffixes", "txt,md").split(","))
        self.parser = options.get("parser")
        self.lines_per_page, self.block_sep = int(options.get("lines_per_page", 50)), options.get("block_sep", r"\n{2,}")
        self.per_partition = int(options.get("bytes_per_partition", 64 << 20))

    def listed(self) -> list[File]:
        from pyarrow import fs

        system, root = _file_system(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
        return sorted((File(f.path, f.size or 0, f.mtime_ns or 0) for f in found if f.is_file and f.path.lower().endswith(self.suffixes)), key=lambda f: (f.mtime_ns, f.path))

    def dealt(self, files: list[File]) -> list[Files]:
        """Partitions of about so many bytes."""
        out: list[list[File]] = []
        size = 0
        for f in files:
            if not out or size + f.size > self.per_partition:
                out.append([])
                size = 0
            out[-1].append(f)
            size += f.size
        return [Files(tuple(x)) for x in out]

    def blocks(self, partition: Files) -> Iterator[tuple]:
        system, _ = _file_system(self.path)
        parse: Callable[[bytes, str], list[dict]] = lambda content, _: plain_blocks_of(content, self.lines_per_page, self.block_sep)
        if self.parser:
            module, _, name = self.parser.partition(":")
            parse = getattr(importlib.import_module(module), name)
        for f in partition.files:
            with system.open_input_stream(f.path) as stream:
                content = stream.read()
            document = hashlib.sha256(content).hexdigest()
            for pos, block in enumerate(parse(content, f.path.rsplit("/", 1)[-1])):
                yield tuple((block | {"document_id": document, "path": f.path, "block_pos": pos}).get(c) for c in _COLUMNS)


class _Reader(_Layout, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.dealt(self.listed()) or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.blocks(partition)


class _Stream(_Layout, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"mtime_ns": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self.listed()
        return {"mtime_ns": files[-1].mtime_ns, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        key = lambda o: (o["mtime_ns"], o["path"])
        return self.dealt([f for f in self.listed() if key(start) < (f.mtime_ns, f.path) <= key(end)])

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.blocks(partition)

    def commit(self, end: dict) -> None:
        json.dumps(end)  # nothing to do: offsets are values


class LayoutBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "layout_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))
