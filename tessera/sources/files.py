"""Repository files as a DataFrame, and what special files say."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..session import cut

# The instructions of interest.
INSTRUCTIONS = "FROM|RUN|COPY|ADD|WORKDIR|CMD|ENTRYPOINT"


MAX_BYTES = 4 * text.MAX_CHARS


def _open(root: str):
    return pafs.FileSystem.from_uri(root if "://" in root else os.path.abspath(root))


def read_ignore(root: str) -> list[str]:
    """Lines of the root's ignore file; none if there is no such file."""
    fs, base = _open(root)
    path = f"{base.rstrip('/')}/.gitignore"
    if fs.get_file_info(path).type != pafs.FileType.File:
        return []
    with fs.open_input_stream(path) as f:
        lines = f.read().decode("utf-8", "replace").splitlines()
    return [x.strip() for x in lines if x.strip() and not x.strip().startswith("#")]


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None, excluded: list[str] = paths.EXCLUDED, allowed: list[str] = paths.ALLOWED) -> DataFrame:
    """(file_path, file_name, file_extension, file_type, language, file_size, content) of admitted files.

    Paths are relative to ``root``; directories are pruned below it.  Tasks list
    the directories, level by level until there are enough of them to list the
    rest side by side, and the files are spread by their path before they are
    read, wherever they lie.  Files that begin with an underscore or a dot, which
    the engine's own file sources hide, are read too.  Files of more bytes than
    any admitted text has come without content; an absent root is an error.
    """
    fs, base = _open(root)
    base = base.rstrip("/")
    if fs.get_file_info(base).type != pafs.FileType.Directory:
        raise FileNotFoundError(root)
    ignore = read_ignore(root) if ignore is None else ignore
    tasks = max(2, spark.sparkContext.defaultParallelism)

    def listed(whole: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fs, _ = _open(root)
            for pdf in batches:
                todo = list(pdf.path)
                while todo:
                    found = fs.get_file_info(pafs.FileSelector(todo.pop()))
                    below = [f.path for f in found if f.type == pafs.FileType.Directory and not (f.base_name in excluded or f.base_name.startswith("."))]
                    files = [(f.path, f.size) for f in found if f.is_file]
                    if whole:
                        todo += below
                    else:
                        files += [(d, -1) for d in below]
                    yield pd.DataFrame(files, columns=["path", "size"])

        return run

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = _open(root)

        def bytes_of(path: str, size: int) -> bytes | None:
            if size > MAX_BYTES:
                return None
            with fs.open_input_stream(path) as f:
                return f.read()

        for pdf in batches:
            for a in range(0, len(pdf), 64):
                part = pdf.iloc[a : a + 64]
                yield part.assign(raw=[bytes_of(p, s) for p, s in zip(part.path, part["size"])])

    schema = "path string, size long"
    folders, files = spark.createDataFrame([(base,)], "path string"), []
    while True:
        level = cut(folders.mapInPandas(listed(False), schema))
        files.append(level.where("size >= 0"))
        folders = level.where("size < 0").select("path")
        n = folders.count()
        if not n or n >= 2 * tasks:
            break
        folders = folders.repartition(min(n, tasks))
    if n:
        files.append(folders.repartition(4 * tasks).mapInPandas(listed(True), schema))
    every = reduce(DataFrame.unionByName, files)
    p = F.col("file_path")
    chosen = every.withColumn("file_path", F.substring("path", len(base) + 2, 1 << 20)).where(~paths.pruned(p, excluded) & ~paths.ignored(p, ignore) & paths.admitted(p, allowed))
    loaded = chosen.repartition(4 * tasks, "path").mapInPandas(read, "path string, size long, file_path string, raw binary")
    return loaded.select("file_path", paths.base_name(p).alias("file_name"), paths.extension(p).alias("file_extension"), paths.file_type(p).alias("file_type"), paths.language(p).alias("language"), F.col("size").alias("file_size"), text.decode(F.col("raw")).alias("content"))


def special_kind(path: Column, content: Column) -> Column:
    name = F.lower(paths.base_name(path))
    return (
        F.when((name == "package.json") & F.is_valid_utf8(F.encode(content, "UTF-8")) & F.startswith(F.schema_of_variant(F.try_parse_json(content)), F.lit("OBJECT")), "package_json")
        .when(name.isin("requirements.txt", "requirements-dev.txt"), "requirements")
        .when(name == "pyproject.toml", "pyproject_toml")
        .when(F.startswith(name, F.lit("dockerfile")), "dockerfile")
        .otherwise("unknown")
    )


def special_lines(path: Column, content: Column) -> Column:
    """Dependencies of a requirements file, or instructions of a Dockerfile in upper case; else null."""
    kind = special_kind(path, content)
    lines = F.filter(F.transform(F.split(content, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    return F.when(kind == "requirements", lines).when(kind == "dockerfile", F.filter(F.transform(lines, F.upper), lambda x: x.rlike(f"^(?:{INSTRUCTIONS})")))


def package_field(content: Column, field: str) -> Column:
    """A field of a package.json as text; objects as JSON, null where absent or broken."""
    return F.try_variant_get(F.try_parse_json(content), f"$.{field}", "string")
