"""Paged sources: files of a pull request or comparison, page by page, as a Spark data source.

    spark.dataSource.register(PagedFiles)
    spark.read.format("paged_files").option("url", "https://.../files?page={page}").option("pages", 7).load()

Pages are planned as partitions, so that tasks fetch them side by side. As a stream, the offset is the last page that was read: a
query that starts again goes on behind it. `url` may be a file's or a path, with wildcards; the folder is then one that all executors share.
"""

from __future__ import annotations

import glob
import json
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Pages that are looked for at once when a stream asks how many there are now.
AHEAD = 1000
SCHEMA = "page int, filename string, status string"


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        super().__init__(number)
        self.number = number


class Pages:
    """What batch and stream readers share. Options: url with {page}; from (1): the first page; pages: the last one, else the
    first that is missing or empty ends them; header: one line that is sent along, as `Authorization: ...`."""

    def __init__(self, options: dict) -> None:
        self.url = options["url"]
        if "{page}" not in self.url:
            raise ValueError("the option url has no {page}")
        self.first, self.last = int(options.get("from", 1)), int(options["pages"]) if "pages" in options else None
        self.header = options.get("header")

    def fetch(self, number: int) -> list[dict] | None:
        """A page's files: an array of them, or an object whose `files` may be absent; None if there is no such page."""
        url = self.url.replace("{page}", str(number))
        if url.startswith(("file:", "/")):
            found = sorted(glob.glob(urllib.request.url2pathname(url.removeprefix("file:").removeprefix("//"))))
            if not found:
                return None
            body = "".join(open(f, encoding="utf-8").read() for f in found)  # noqa: SIM115
        else:
            name, _, value = (self.header or "").partition(":")
            request = urllib.request.Request(url, headers={name.strip(): value.strip()} if name else {})
            try:
                with urllib.request.urlopen(request, timeout=60) as response:
                    body = response.read().decode("utf-8")
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    return None
                raise
        parsed = json.loads(body) if body.strip() else []
        return (parsed.get("files") or []) if isinstance(parsed, dict) else parsed

    def end(self, first: int) -> int:
        """The number behind the last page there is now."""
        if self.last is not None:
            return max(first, self.last + 1)
        number = first
        while number < first + AHEAD and self.fetch(number):
            number += 1
        return number

    def rows(self, number: int) -> Iterator[tuple]:
        for f in self.fetch(number) or []:
            yield number, f.get("filename"), f.get("status")


class _Batch(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.pages = Pages(options)

    def partitions(self) -> list[Page]:
        return [Page(n) for n in range(self.pages.first, self.pages.end(self.pages.first))]

    def read(self, partition: Page | None) -> Iterator[tuple]:
        if partition is not None:  # as it is where no partition was planned
            yield from self.pages.rows(partition.number)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.pages = Pages(options)
        self.known = self.pages.first

    def initialOffset(self) -> dict:  # noqa: N802  names of the interface
        return {"page": self.pages.first}

    def latestOffset(self) -> dict:  # noqa: N802
        self.known = self.pages.end(self.known)
        return {"page": self.known}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        self.known = max(self.known, end["page"])
        return [Page(n) for n in range(start["page"], end["page"])]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from self.pages.rows(partition.number)

    def commit(self, end: dict) -> None:
        """Pages stay where they are."""


class PagedFiles(DataSource):
    """(page, filename, status)."""

    @classmethod
    def name(cls) -> str:
        return "paged_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return _Stream(self.options)
