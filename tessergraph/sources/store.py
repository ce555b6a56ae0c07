"""Named folders in any store that Hadoop reads (file, hdfs, s3a), with item-scoped files.

Layout: <base>/<item>/{raw,processed,kg/<version>}/<file>, and <base>/<item>/metadata.json.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORIES = ("raw", "processed", "kg")


class Store:
    """Reads, writes and lists single files through Hadoop's file system; sets of files go through Spark readers."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.base, *(p for p in parts if p)]))

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    @staticmethod
    def category(name: str | None) -> str:
        """raw, processed, kg or kg/<version>; ValueError otherwise."""
        if name and name not in CATEGORIES and not re.fullmatch(r"kg/[^/\\]+", name):
            raise ValueError(f"unknown category {name!r}")
        return name or ""

    def save_file(self, item: str, name: str, data: bytes, category: str | None = None) -> str:
        path = self._path(item, self.category(category), name)
        out = self._fs(path).create(path, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        return str(path)

    def get_file(self, item: str, name: str, category: str | None = None) -> bytes:
        path = self._path(item, self.category(category), name)
        if not self._fs(path).exists(path):
            raise FileNotFoundError(str(path))
        stream = self._fs(path).open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def delete_file(self, item: str, name: str, category: str | None = None) -> bool:
        path = self._path(item, self.category(category), name)
        return bool(self._fs(path).exists(path) and self._fs(path).delete(path, False))

    def list_files(self, item: str, category: str | None = None) -> list[str]:
        """Paths of all files below, sorted, relative to the item (or its category)."""
        top = self._path(item, self.category(category))
        fs = self._fs(top)
        if not fs.exists(top):
            return []
        root, found, it = fs.makeQualified(top).toString().rstrip("/"), [], fs.listFiles(top, True)
        while it.hasNext():
            found.append(it.next().getPath().toString()[len(root) + 1 :])
        return sorted(x for x in found if not x.rsplit("/", 1)[-1].startswith((".", "_")))

    def list_directory(self, prefix: str = "") -> dict[str, list[str]]:
        """{files, directories} one level below."""
        top = self._path(prefix)
        out: dict[str, list[str]] = {"files": [], "directories": []}
        if self._fs(top).exists(top):
            for s in self._fs(top).listStatus(top):
                out["directories" if s.isDirectory() else "files"].append(s.getPath().getName())
        return {k: sorted(x for x in v if not x.startswith(".")) for k, v in out.items()}

    def versions(self, item: str) -> list[str]:
        return self.list_directory(f"{item}/kg")["directories"]

    def version(self, item: str, wanted: str | None = None) -> str:
        """The given version, or the last in the order of names."""
        have = self.versions(item)
        if not have:
            raise FileNotFoundError(f"{item} has no graph version")
        if wanted is not None and wanted not in have:
            raise ValueError(f"{item} has no version {wanted!r}")
        return wanted or max(have)

    def create_version(self, item: str, name: str) -> str:
        if not name or re.search(r"[/\\]", name):
            raise ValueError("a version name has no slashes")
        path = self._path(item, "kg", name)
        self._fs(path).mkdirs(path)
        return str(path)

    def next_version(self, item: str, stem: str = "baseline") -> str:
        numbers = [int(m[1]) for v in self.versions(item) if (m := re.fullmatch(rf"{re.escape(stem)}_(\d+)", v))]
        return f"{stem}_{max(numbers, default=0) + 1}"

    def files(self, pattern: str = "*") -> DataFrame:
        """(item_id, path, length, content) of many files, read in parallel."""
        df = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(self.base)
        rel = F.regexp_extract(F.col("path"), re.escape(self.base.split(":", 1)[-1].lstrip("/")) + "/(.*)", 1)
        return df.select(F.element_at(F.split(rel, "/"), 1).alias("item_id"), rel.alias("path"), "length", "content")

    def sections(self, item: str) -> list[str]:
        """Names of the extracted text sections, without the full text."""
        return [m[1] for f in self.list_files(item, "processed") if (m := re.fullmatch(r"text/(.+)\.txt", f)) and m[1] != "full"]

    def processed(self, item: str) -> list[str]:
        return [f for f in self.list_files(item, "processed") if f.endswith(".json") and not f.startswith("text/")]


class Registry:
    """Stores by name; the default is $TESSERGRAPH_DATA or ~/.tessergraph."""

    def __init__(self, spark: SparkSession, default: str | None = None):
        self.spark, self.stores = spark, {}
        self.default = "local"
        self.register("local", default or os.environ.get("TESSERGRAPH_DATA") or os.path.expanduser("~/.tessergraph"))

    def register(self, name: str, base: str) -> Store:
        self.stores[name] = Store(self.spark, base)
        return self.stores[name]

    def get(self, name: str | None = None) -> Store:
        if (name or self.default) not in self.stores:
            raise ValueError(f"no store named {name!r}")
        return self.stores[name or self.default]

    def set_default(self, name: str) -> None:
        self.get(name)
        self.default = name


def subgraph_file(name: str) -> str:
    return f"{name}.subgraph.json"


def subgraph_name(path: str) -> str:
    return path.rsplit("/", 1)[-1].removesuffix(".subgraph.json")
