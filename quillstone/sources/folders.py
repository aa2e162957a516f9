"""The text files below a folder as a data source whose partitions are folders, with ignore files inherited down the tree.

    spark.dataSource.register(FolderSource)
    spark.read.format("folders").option("path", root).load()

Options: path (anything that pyarrow's file systems open, seen by the driver and all executors); max_bytes; skip (comma-joined globs of
names; the default ones if unset); ignore_files (comma-joined names, the later ones weigh more); folders (how many partitions to aim at).

A name is skipped if it is hidden, whatever the rules say; a file if it is a link, empty, too large, of a skipped glob or not UTF-8.
Rules are those of git: of the lines that match a path the last one decides, deeper files before shallower ones; ! takes back; a slash
within ties a line to its file's folder; one at the end means folders only; nothing below an ignored folder comes back.  They
hold outside git repositories too.  Spark's own file readers cannot list this: they pass over names that begin with `_` or `.`."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from fnmatch import fnmatchcase

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import constants as K

SCHEMA = "relpath string, content string, size long, mtime_ms long"
IGNORE_FILES = (".gitignore", ".ignore")


@dataclass(frozen=True)
class Rule:
    """A line of an ignore file in `base` (relative to the root, '' or with a slash at its end)."""

    base: str
    pattern: str
    back: bool
    folders_only: bool

    def matches(self, relpath: str, is_folder: bool) -> bool:
        return (is_folder or not self.folders_only) and re.fullmatch(self.pattern, relpath[len(self.base) :], re.S) is not None


def _regex(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        starts = i == 0 or glob[i - 1] == "/"
        if starts and glob[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif starts and glob[i:] == "**":
            out, i = out + ".+", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (kind := re.match(r"\[([!^]?)(\]?(?:\\.|[^\]\\])*)\]", glob[i:])):
            body = re.sub(r"\[(?!:)", r"\\[", kind[2])
            out, i = out + f"(?!/)[{'^' if kind[1] else ''}{body if not body.startswith(']') else chr(92) + body}]", i + len(kind[0])
        else:
            i += c == "\\" and i + 1 < len(glob)
            out, i = out + re.escape(glob[i]), i + 1
    return out


def parse_rule(line: str, base: str) -> Rule | None:
    line = line.rstrip("\r\n")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    back, line = line.startswith("!"), line.removeprefix("!")
    only, body = line.endswith("/"), line.removesuffix("/")
    tied = "/" in body
    body = body.removeprefix("/")
    return Rule(base, ("" if tied else "(?:.*/)?") + _regex(body), back, only) if body else None


@dataclass
class Folder(InputPartition):
    """A folder to read, alone or with all below it, and the rules from above by ignore file."""

    relpath: str
    rules: dict[str, list[Rule]]
    deep: bool = True
    value: None = field(default=None, repr=False)


class FolderReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.root = options["path"]
        self.most = int(options.get("max_bytes", 1 << 20))
        self.skip = [g for g in options["skip"].split(",") if g] if "skip" in options else list(K.SKIP_GLOBS)
        self.names = [n for n in options["ignore_files"].split(",") if n] if "ignore_files" in options else list(IGNORE_FILES)
        self.aim = int(options.get("folders", 256))

    def _open(self) -> tuple[pafs.FileSystem, str]:
        where = pafs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (pafs.LocalFileSystem(), self.root)
        return where[0], where[1].rstrip("/")

    def _ignored(self, rules: dict[str, list[Rule]], relpath: str, is_folder: bool) -> bool:
        for name in reversed(self.names):
            for rule in reversed(rules.get(name, [])):
                if rule.matches(relpath, is_folder):
                    return not rule.back
        return False

    def _list(self, fs: pafs.FileSystem, root: str, at: Folder) -> tuple[list[Folder], list[tuple[str, pafs.FileInfo]]]:
        """The folders and files in a folder that are neither hidden nor ignored."""
        listed = fs.get_file_info(pafs.FileSelector(f"{root}/{at.relpath}".rstrip("/"), allow_not_found=True))
        rules = {n: list(r) for n, r in at.rules.items()}
        for info in listed:
            if info.base_name in self.names and info.type == pafs.FileType.File:
                with fs.open_input_stream(info.path) as f:
                    lines = f.read().decode("utf-8", "replace").split("\n")
                rules.setdefault(info.base_name, []).extend(r for line in lines if (r := parse_rule(line, at.relpath)))
        folders, files = [], []
        for info in sorted(listed, key=lambda i: i.base_name):
            is_folder, relpath = info.type == pafs.FileType.Directory, at.relpath + info.base_name
            if info.base_name.startswith(".") or _is_link(fs, info.path) or self._ignored(rules, relpath, is_folder):
                continue
            if is_folder:
                folders.append(Folder(relpath + "/", rules))
            elif info.type == pafs.FileType.File and 0 < info.size <= self.most and not any(fnmatchcase(info.base_name, g) for g in self.skip):
                files.append((relpath, info))
        return folders, files

    def partitions(self) -> list[Folder]:
        """The folders of the first levels, level by level until there are enough; those passed on the way are read alone."""
        fs, root = self._open()
        alone, level = [], [Folder("", {})]
        while level and len(level) < self.aim:
            below = [f for at in level for f in self._list(fs, root, at)[0]]
            alone += [Folder(at.relpath, at.rules, deep=False) for at in level]
            level = below
        return alone + level or [Folder("", {})]

    def read(self, partition: Folder) -> Iterator[tuple]:
        fs, root = self._open()
        left = [partition]
        while left:
            at = left.pop()
            folders, files = self._list(fs, root, at)
            if partition.deep:
                left += folders
            for relpath, info in files:
                try:
                    with fs.open_input_stream(info.path) as f:
                        content = f.read().decode("utf-8")
                    relpath.encode("utf-8")
                except (UnicodeError, FileNotFoundError):  # not text, or gone since it was listed
                    continue
                yield relpath, content, info.size, (info.mtime_ns or 0) // 1_000_000


def _is_link(fs: pafs.FileSystem, path: str) -> bool:
    import os

    return isinstance(fs, pafs.LocalFileSystem) and os.path.islink(path)


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def read_repo(spark: SparkSession, root: str, **options) -> DataFrame:
    """relpath, content, size, mtime_ms of the files that an index of the folder holds."""
    spark.dataSource.register(FolderSource)
    reader = spark.read.format("folders").option("path", root)
    for name, value in options.items():
        reader = reader.option(name, ",".join(value) if isinstance(value, (list, tuple)) else str(value))
    return reader.load()
