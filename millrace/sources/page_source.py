"""A data source of documents' pages: a partition for each group of files, rows of pages, and an error row for each file that can't be read.

    spark.dataSource.register(PageSource)
    rows = spark.read.format("document_pages").option("extract", "package.module:function").load("hdfs:///folder")
"""

from __future__ import annotations

import hashlib
import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, sha256 string, page_number int, page_text string, error string"
_ARROW = pa.schema([("path", pa.string()), ("sha256", pa.string()), ("page_number", pa.int32()), ("page_text", pa.string()), ("error", pa.string())])
#: Fixed value: bytes of the largest file that is read.
MAX_BYTES = 50 * 1024 * 1024


def text_pages(data: bytes) -> list[str]:
    """Of a text file the trimmed, non-empty parts between blank lines; it has to be UTF-8."""
    return [p for p in (x.strip() for x in data.decode("utf-8").split("\n\n")) if p]


def pdf_pages(data: bytes) -> list[str]:
    """By the pypdf library, where it is installed."""
    import io

    import pypdf

    return [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages]


def pages_or_error(path: str, size: int, load: Callable[[], bytes], extract: Callable[[bytes], list[str]] = pdf_pages) -> list[tuple]:
    """The rows of one file: its pages, or one row with no page and the reason. Whatever goes wrong with a file stays with that file."""
    kind, sha = path.rsplit(".", 1)[-1].lower(), None
    try:
        if kind not in ("txt", "pdf"):
            raise ValueError("unknown kind")
        if size > MAX_BYTES:
            raise ValueError("too large")
        data = load()
        sha = hashlib.sha256(data).hexdigest()
        if kind == "pdf" and not data.startswith(b"%PDF-"):
            raise ValueError("not a PDF")
        pages = text_pages(data) if kind == "txt" else extract(data)
        if not pages:
            raise ValueError("no pages")
        return [(path, sha, k, text, None) for k, text in enumerate(pages, 1)]
    except Exception as e:  # a file that can't be read, whatever a parser raises
        return [(path, sha, None, None, f"{type(e).__name__}: {e}"[:500])]


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


class PageReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.group_bytes = options["path"], int(options.get("groupBytes", 64 << 20))
        self.extract = options.get("extract")

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)

    def partitions(self) -> list[Files]:
        """Files in order of their names, in groups of `groupBytes` or one file. Only names and sizes are read here."""
        from pyarrow import fs

        system, root = self._system()
        listed = sorted((x.path, x.size or 0) for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file and not x.base_name.startswith(("_", ".")))
        groups, held = [Files([])], 0
        for file in listed:
            if groups[-1].files and held + file[1] > self.group_bytes:
                groups.append(Files([]))
                held = 0
            groups[-1].files.append(file)
            held += file[1]
        return groups

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = self._system()
        extract = pdf_pages
        if self.extract:
            module, _, name = self.extract.partition(":")
            extract = getattr(importlib.import_module(module), name)

        def content(path: str) -> bytes:
            with system.open_input_stream(path) as f:
                return f.read()

        for path, size in partition.files:  # a file at a time is held
            rows = pages_or_error(path, size, lambda path=path: content(path), extract)
            yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in rows], _ARROW)


class PageSource(DataSource):
    """Options: path, a folder, searched with its subfolders; extract, "module:function" from a PDF's bytes to its pages' texts; groupBytes."""

    @classmethod
    def name(cls) -> str:
        return "document_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)
