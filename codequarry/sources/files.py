"""Source trees and text tables as a ``files`` DataFrame.

Spark's own file sources skip every name that starts with ``_`` or ``.``, which
would drop each ``__init__.py``; so trees are listed and read by tasks of their own. The
driver looks at the root alone: a task lists a bounded number of entries and hands the
folders it did not reach to the next round, and the files found are read in groups of
bounded size. Large corpora should be compacted to Parquet once and read from there.
"""

from __future__ import annotations

import os
import stat
from collections import deque
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import DEFAULT_CONFIG, AnalysisConfig
from ..errors import SourceTreeError
from ..plans.checkpoints import cut, cut_counted

GROUP_BYTES = 64 * 1024 * 1024
GROUP_FILES = 4_000
#: Entries a task lists before it hands on the folders that are left, and tasks of a round.
LIST_ENTRIES = 50_000
LIST_TASKS = 4_096
#: Bytes of file bodies, about, that a task holds before it hands them on.
_BATCH_BYTES = 8 * 1024 * 1024
_BATCH_ROWS = 2_000
_LISTED = pa.schema([("file_path", pa.string()), ("length", pa.int64()), ("is_folder", pa.bool_()), ("read_error", pa.string())])
_READ = pa.schema([("file_path", pa.string()), ("rel_path", pa.string()), ("length", pa.int64()), ("body", pa.binary()),
                   ("read_error", pa.string())])


def opened(root: str):
    """(file system, folder) of a path; None stands for local files, whose links are not followed."""
    if root.startswith("file:"):
        return None, "/" + root[len("file:"):].lstrip("/")
    if "://" not in root:
        return None, os.path.abspath(root)
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def _entries(filesystem, folder: str):
    """(path, name, is folder, size) of what lies in one folder; sizes of local files are not asked for here."""
    if filesystem is None:
        with os.scandir(folder) as found:
            for entry in found:
                if entry.is_dir(follow_symlinks=False):
                    yield entry.path, entry.name, True, 0
                elif not entry.is_dir():
                    yield entry.path, entry.name, False, None
        return
    from pyarrow import fs

    for info in filesystem.get_file_info(fs.FileSelector(folder)):
        if info.type in (fs.FileType.Directory, fs.FileType.File):
            yield info.path, info.base_name, info.type == fs.FileType.Directory, info.size or 0


def _is_folder(root: str) -> bool:
    filesystem, base = opened(root)
    if filesystem is None:
        return os.path.isdir(base)
    from pyarrow import fs

    return filesystem.get_file_info(base).type == fs.FileType.Directory


def _batches(rows, schema: pa.Schema, size=lambda row: 0):
    """Arrow batches of at most ``_BATCH_ROWS`` rows and about ``_BATCH_BYTES``."""
    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if len(held) >= _BATCH_ROWS or total >= _BATCH_BYTES:
            yield batch()
            held, total = [], 0
    if held:
        yield batch()


def _local_size(path: str) -> int:
    try:
        found = os.stat(path)
    except OSError:
        return 0  # reading it will tell
    return found.st_size if stat.S_ISREG(found.st_mode) else 0


def _with_sizes(listed: DataFrame, n: int) -> DataFrame:
    """Listed files with the sizes that the listing left out, asked for by as many tasks as ``n`` files need."""
    def run(batches):
        for batch in batches:
            paths, sizes, errors = (c.to_pylist() for c in batch.columns)
            sizes = [_local_size(p) if size is None and error is None else size for p, size, error in zip(paths, sizes, errors)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), batch.column(2)], schema=batch.schema)

    return cut(listed.repartition(max(1, -(-n // LIST_ENTRIES)), "file_path").mapInArrow(run, listed.schema))


def _ddl(schema: pa.Schema):
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)


def list_tree(
    spark: SparkSession, root: str, config: AnalysisConfig = DEFAULT_CONFIG, *,
    suffix: str = ".py", entries: int = LIST_ENTRIES,
) -> DataFrame:
    """(file_path, length, read_error) of the files below a root whose name ends with ``suffix``,
    with any first letter. Excluded folders are not entered and excluded files not listed;
    a folder that cannot be listed is a row with a ``read_error``.

    Every task walks its folders breadth first, up to ``entries`` entries (a folder is
    listed whole), and the rest are rows of the next round; rounds are stored. A large local folder
    costs its task the names alone: sizes are asked for by other tasks.
    """
    if not _is_folder(root):
        raise SourceTreeError(f"no folder of source files at {root}")
    skipped, prefixes = frozenset(config.excluded_dirs), tuple(config.excluded_prefixes)

    def walk(folders):
        filesystem, _ = opened(root)
        listed = 0
        for first in folders:
            todo = deque([first])
            while todo and listed < entries:
                folder = todo.popleft()
                try:
                    for path, name, is_folder, size in _entries(filesystem, folder):
                        listed += 1
                        if is_folder:
                            if name not in skipped:
                                todo.append(path)
                        elif name.endswith(suffix) and not name.startswith(prefixes):
                            yield path, size, False, None
                except OSError as exc:
                    yield folder, None, False, f"unreadable folder: {exc}"
            yield from ((folder, None, True, None) for folder in todo)

    def run(batches):
        yield from _batches(walk(f for b in batches for f in b.column(0).to_pylist()), _LISTED)

    _, base = opened(root)
    todo, left, rounds = spark.createDataFrame([(base,)], "file_path string"), 1, []
    while left:
        placed = todo.repartition(min(left, LIST_TASKS), "file_path")
        step, left = cut_counted(placed.mapInArrow(run, _ddl(_LISTED)), F.col("is_folder"))
        rounds.append(step.where(~F.col("is_folder")).drop("is_folder"))
        todo = step.where("is_folder").select("file_path")
    listed = reduce(DataFrame.unionAll, rounds)
    if opened(root)[0] is not None:
        return listed
    return _with_sizes(listed, listed.count())


def read_files(files: DataFrame, root: str, limit: int | None = None) -> DataFrame:
    """(file_path, rel_path, length, body, read_error) of listed files, undecoded. Files above
    ``limit`` bytes are not opened and have an error, as have files that cannot be read."""
    n, size = files.agg(F.count(F.lit(1)), F.sum("length")).first()
    groups = max(1, -(-n // GROUP_FILES), -(-(size or 0) // GROUP_BYTES))

    def body_of(filesystem, path):
        if filesystem is None:
            with open(path, "rb") as stream:
                return stream.read()
        with filesystem.open_input_stream(path) as stream:
            return stream.read()

    def read(rows):
        filesystem, base = opened(root)
        for path, length, error in rows:
            body = None
            if error is None and limit is not None and length > limit:
                error = "file is larger than the limit"
            elif error is None:
                try:
                    body = body_of(filesystem, path)
                except OSError as exc:
                    error = f"unreadable: {exc}"
            yield path, path[len(base):].lstrip("/"), length, body, error

    def run(batches):
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        yield from _batches(read(rows), _READ, lambda row: len(row[3] or b""))

    placed = files.select("file_path", "length", "read_error").repartition(groups, "file_path")
    return placed.mapInArrow(run, _ddl(_READ))


def scan_tree(
    spark: SparkSession, root: str, config: AnalysisConfig = DEFAULT_CONFIG
) -> DataFrame:
    """All ``*.py`` files below a root, undecoded. What is excluded is never opened."""
    tree = read_files(list_tree(spark, root, config), root, config.max_file_bytes)
    return tree.where(~is_excluded(F.col("rel_path"), config))


def is_excluded(rel_path: Column, config: AnalysisConfig = DEFAULT_CONFIG) -> Column:
    """Some part of the relative path is an excluded folder, or the file name starts
    with an excluded prefix."""
    parts = F.split(rel_path, "/")
    hit = F.arrays_overlap(parts, F.array(*map(F.lit, config.excluded_dirs)))
    name = F.element_at(parts, -1)
    for prefix in config.excluded_prefixes:
        hit = hit | name.startswith(prefix)
    return hit


def _unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\\r\\n?", "\n")


def decode_strict(raw: DataFrame, repo: Column | str) -> tuple[DataFrame, DataFrame]:
    """(files, rejects): text of valid UTF-8 files, and the others with a reason."""
    repo = F.lit(repo) if isinstance(repo, str) else repo
    raw_text = F.col("body").cast("string")
    text = _unix_newlines(raw_text)
    readable = F.col("read_error").isNull() & F.is_valid_utf8(raw_text)
    files = raw.where(readable).select(
        repo.alias("repo"), "file_path", "rel_path", text.alias("content")
    )
    rejects = raw.where(~F.coalesce(readable, F.lit(False))).select(
        repo.alias("repo"), "file_path", "rel_path",
        F.coalesce("read_error", F.lit("not valid UTF-8")).alias("error"),
    )
    return files, rejects


def decode_lossy(raw: DataFrame, repo: Column | str, *also: str) -> DataFrame:
    """Text of every readable file; bad bytes become the replacement character."""
    repo = F.lit(repo) if isinstance(repo, str) else repo
    return raw.where(F.col("body").isNotNull()).select(
        repo.alias("repo"), "file_path", "rel_path",
        _unix_newlines(F.make_valid_utf8(F.col("body").cast("string"))).alias("content"),
        *also,
    )
