"""Connectors as Spark data sources: trees of files with verified blobs, and recorded pages of a code search.

    spark.dataSource.register(TreeSource)
    spark.read.format("pinloom_tree").option("path", folder).option("slug", "o/r").option("commit", sha).load()
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import stat
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pinloom.sources.blobs import SKIPPED

TREE = "slug string, commit_sha string, path string, mode string, size long, blob_sha string, content binary"
HITS = "page int, slug string, commit_sha string, path string, blob_sha string, html_url string, total_count long, incomplete boolean"


class _Folder(InputPartition):
    def __init__(self, names: tuple[str, ...]) -> None:
        self.names = names


def blob_sha(data: bytes) -> str:
    return hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest()


class TreeSource(DataSource):
    """The files below a folder that all executors see, one row for each, as git would store them: a link is its target's name, mode
    120000. The scan's own records are left out; other kinds of files are an error."""

    @classmethod
    def name(cls) -> str:
        return "pinloom_tree"

    def schema(self) -> str:
        return TREE

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


class _TreeReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.root, self.slug, self.commit = options["path"].rstrip("/"), options.get("slug", ""), options.get("commit", "")

    def partitions(self) -> list[InputPartition]:
        """One partition for each entry at the top, so that directories are read side by side."""
        return [_Folder((name,)) for name in sorted(os.listdir(self.root))] or [_Folder(())]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        todo = list(partition.names)
        while todo:
            path = todo.pop()
            full = os.path.join(self.root, path)
            kind = os.lstat(full).st_mode
            if os.path.basename(path) in SKIPPED:
                continue
            if stat.S_ISDIR(kind):
                todo += [f"{path}/{name}" for name in sorted(os.listdir(full), reverse=True)]
                continue
            if stat.S_ISLNK(kind):
                data, mode = os.readlink(full).encode(), "120000"
            elif stat.S_ISREG(kind):
                with open(full, "rb") as f:
                    data = f.read()
                mode = "100755" if kind & 0o100 else "100644"
            else:
                raise ValueError(f"neither a file nor a link: {path}")
            yield self.slug, self.commit, path, mode, len(data), blob_sha(data), data


class RecordedSearch(DataSource):
    """The hits in recorded pages of a code search, one JSON file a page in a folder. A hit counts only if the commit in its API
    address is the one in its HTML address."""

    @classmethod
    def name(cls) -> str:
        return "pinloom_search"

    def schema(self) -> str:
        return HITS

    def reader(self, schema) -> DataSourceReader:
        return _SearchReader(self.options)


class _SearchReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.root, self.pages = options["path"].rstrip("/"), int(options.get("pages", "1000000"))

    def partitions(self) -> list[InputPartition]:
        names = sorted(n for n in os.listdir(self.root) if n.endswith(".json"))[: self.pages]
        return [_Folder((name,)) for name in names] or [_Folder(())]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        for name in partition.names:
            with open(os.path.join(self.root, name), encoding="utf-8") as f:
                page = json.load(f)
            number = int(re.sub(r"\D", "", name) or 0)
            for item in page.get("items") or []:
                api = re.search(r"[?&]ref=([0-9a-f]{40})\b", item.get("url") or "")
                html = re.search(r"/blob/([0-9a-f]{40})/", item.get("html_url") or "")
                if api and html and api[1] == html[1]:
                    yield number, (item.get("repository") or {}).get("full_name"), api[1], item.get("path"), item.get("sha"), item.get("html_url"), page.get("total_count"), bool(page.get("incomplete_results"))
