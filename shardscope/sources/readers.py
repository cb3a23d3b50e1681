"""Reading CSV trees and client tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardscope.functions.labels import label_from_path
from shardscope.functions.scalars import quoted

LABEL = "__label"
SOURCE = "__source_file"


def relative_path(path: Column, root: str) -> Column:
    """Part of a file path below ``root``. Paths of file metadata are URIs, so escapes are decoded."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_extract(decoded, "^" + LOCAL_SCHEME + re.escape(_bare(root)) + "/+(.*)$", 1)


LOCAL_SCHEME = "(?:file:)?/*"


def _bare(root: str) -> str:
    """Root without the local scheme and outer slashes; it has to be absolute."""
    if not root.startswith("/") and ":/" not in root:
        raise ValueError(f"give an absolute path or a URI, not {root}")
    return re.sub("^file:", "", root).strip("/")


def file_index(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """``rel, path, label, size_mb`` of every file below ``root``; contents are never read."""
    rel = relative_path(F.col("uri"), root)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", "length", F.col("_metadata.file_path").alias("uri"))
    )
    return files.select(
        rel.alias("rel"),
        "path",
        label_from_path(rel).alias("label"),
        F.round(F.col("length") / (1024 * 1024), 4).alias("size_mb"),
    )


def read_tree(
    spark: SparkSession,
    root: str,
    pattern: str = "*.csv",
    types: Mapping[str, str] | None = None,
    same_header_per_folder: bool = True,
) -> DataFrame:
    """All CSV files below ``root``, joined by column name, with ``__label`` and ``__source_file``.

    A single read over files with different headers would assign columns by position, so the files
    are read once per distinct header; columns a file lacks are NULL. ``types`` names column types;
    without it they are inferred, which reads the files once more. One file per folder is looked at and
    folders are listed, not files; whatever is selected, every file is read with all its columns and one with a different
    header fails the job. Where files of one folder differ, pass ``same_header_per_folder=False``: the header of every
    file is then looked at, and the table has the columns of all.
    """
    rel = relative_path(F.col("_metadata.file_path"), root)
    extra = [label_from_path(rel).alias(LABEL), rel.alias(SOURCE)]
    return _read_by_header(spark, root, pattern, types, same_header_per_folder, extra)


def _read_by_header(
    spark: SparkSession,
    root: str,
    pattern: str,
    types: Mapping[str, str] | None,
    per_folder: bool,
    extra: Sequence[Column],
    needed: str | None = None,
) -> DataFrame:
    groups = _paths_by_header(spark, root, pattern, per_folder)
    if not groups:
        raise FileNotFoundError(f"no {pattern} files below {root}")
    parts = []
    for header, paths in groups.items():
        if needed is not None and needed not in header:
            raise ValueError(f"column {needed} is missing in {paths[0]}")
        reader = spark.read.option("header", "true").option("enforceSchema", "false").option("pathGlobFilter", pattern)
        # with pruning, the check of a header would see the selected columns only
        reader = reader.option("columnPruning", "false")
        if types is None:
            reader = reader.option("inferSchema", "true")
        rows = reader.csv(paths)
        cells = [quoted(c).try_cast(types[c]).alias(c) if types and c in types else quoted(c) for c in rows.columns]
        parts.append(rows.select(*cells, *extra))
    return union_by_name(parts)


def _paths_by_header(spark: SparkSession, root: str, pattern: str, per_folder: bool) -> dict[tuple[str, ...], list[str]]:
    """Paths to read together: files, or folders, grouped by their column names.

    The file listing reads no contents; a header costs the first line of its file.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"))
    )
    if per_folder:
        chosen = files.groupBy("folder").agg(F.min("path").alias("path")).select(F.col("folder").alias("unit"), "path")
    else:
        chosen = files.select(F.col("path").alias("unit"), "path")
    units = [(r.unit, r.path) for r in chosen.orderBy("unit").collect()]

    def header(path: str) -> tuple[str, ...]:
        return tuple(spark.read.option("header", "true").csv(path).columns)

    with ThreadPoolExecutor(max_workers=8) as pool:
        headers = list(pool.map(header, [path for _, path in units]))
    groups: dict[tuple[str, ...], list[str]] = {}
    for (unit, _), names in zip(units, headers):
        groups.setdefault(names, []).append(unit)
    return groups


def union_by_name(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables; same-named columns meet, missing ones are NULL.

    Where the parts disagree on a type, the column is read as double if all are numbers, else text.
    """
    types: dict[str, set[str]] = {}
    for p in parts:
        for f in p.schema:
            types.setdefault(f.name, set()).add(f.dataType.simpleString())
    numbers = {"int", "bigint", "double", "float"}
    target = {
        c: ("bigint" if found <= {"int", "bigint"} else "double" if found <= numbers else "string")
        for c, found in types.items()
        if len(found) > 1
    }
    cast = [p.select(*[quoted(c).cast(target[c]).alias(c) if c in target else quoted(c) for c in p.columns]) for p in parts]
    out = cast[0]
    for part in cast[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_clients(
    spark: SparkSession,
    folder: str,
    pattern: str = "client_*.csv",
    label: str = LABEL,
    types: Mapping[str, str] | None = None,
    same_header_per_folder: bool = True,
) -> DataFrame:
    """All client files of a folder with ``client`` = file name without its ending.

    No file, or a table without the label column, is an error.
    """
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]+$", 1)
    return _read_by_header(spark, folder, pattern, types, same_header_per_folder, [name.alias("client")], needed=label)


def read_client(spark: SparkSession, folder: str, client: str) -> DataFrame:
    """One client's table."""
    return read_clients(spark, folder, f"{client}.csv").filter(F.col("client") == client)


def labels_only(df: DataFrame, label: str = LABEL) -> DataFrame:
    """The label column alone; other columns are pruned from the scan."""
    return df.select(quoted(label))
