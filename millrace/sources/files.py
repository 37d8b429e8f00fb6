"""Built-in file formats: text, CSV, compressed text, Parquet with indices, paths and listing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import vfs


def expand(paths: str | Sequence[str], ext: str = "", max_depth: int | None = None, follow_links: bool = True) -> list[str]:
    """Files under the given paths in sorted order: hidden files and folders are skipped, names must
    end in ``ext``; ``max_depth`` bounds the folders below a path."""
    out: list[str] = []
    for path in [paths] if isinstance(paths, str) else paths:
        if vfs.isfile(path):
            out.append(path)
        elif not vfs.isdir(path):
            raise FileNotFoundError(path)
        else:
            out += [p for p in vfs.walk(path, max_depth, follow_links) if p.endswith(ext)]
    return out


def read_text(spark: SparkSession, paths: str | Sequence[str], ext: str = "", recursive: bool = True) -> DataFrame:
    """``value``: lines of all files below the paths. Gzip and bzip2 go by their suffix (bzip2 files
    are split, gzip files are not)."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    if ext:
        reader = reader.option("pathGlobFilter", f"*{ext}")
    return reader.text([paths] if isinstance(paths, str) else list(paths))


def read_gzip_tolerant(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Gzip text in which what follows a corrupt block is dropped."""
    return spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).text([paths] if isinstance(paths, str) else list(paths))


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str, sep: str = ",", header: bool = False) -> DataFrame:
    return spark.read.option("sep", sep).option("header", header).schema(schema).csv(path)


def from_csv(df: DataFrame, column: str, schema: str, sep: str = ",") -> DataFrame:
    """Fields of a CSV text column."""
    return df.select(F.from_csv(column, schema, {"sep": sep}).alias("x")).select("x.*")


def infer_delimited(spark: SparkSession, path: str) -> DataFrame:
    """Columns f0, f1, …, all text, split at the separator guessed from the first row."""
    from millrace.sql.engine import guess_separator

    sep = guess_separator(spark, path)
    row = spark.read.option("recursiveFileLookup", True).text(path).head()
    n = len(row[0].split(sep)) if row else 1
    return spark.read.option("recursiveFileLookup", True).option("sep", sep).schema(", ".join(f"f{i} string" for i in range(n))).csv(path)


def write_text(df: DataFrame, path: str, column: str | None = None, overwrite: bool = True, compress: bool = False) -> list[str]:
    """One text column as lines; returns the files (of a local path)."""
    lines = df.select(F.col(column or df.columns[0]).cast("string"))
    writer = lines.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.option("compression", "gzip") if compress else writer).text(path)
    return written_files(path)


def write_text_by_key(df: DataFrame, path: str, key: str, column: str, overwrite: bool = True, compress: bool = False) -> list[str]:
    """Lines in a folder for each key (``key=<value>/``)."""
    writer = df.select(key, F.col(column).cast("string").alias(column)).write.partitionBy(key).mode("overwrite" if overwrite else "errorifexists")
    (writer.option("compression", "gzip") if compress else writer).text(path)
    return written_files(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", overwrite: bool = True, compress: bool = False, single: bool = False) -> list[str]:
    frame = df.coalesce(1) if single else df
    writer = frame.write.option("sep", sep).mode("overwrite" if overwrite else "errorifexists")
    (writer.option("compression", "gzip") if compress else writer).csv(path)
    return written_files(path)


def written_files(path: str) -> list[str]:
    """Names of what was written, where Python can list the path."""
    at = vfs.local(path)
    return expand(at) if not vfs.is_remote(at) and vfs.isdir(at) else []


# --- indexed columnar files ---


def write_columnar(df: DataFrame, path: str, fields: Sequence[str] | None = None, indices: Sequence[str] = (), partitions: int | None = None) -> None:
    """Parquet with bloom filters on ``indices``. The path must not exist; names must be distinct."""
    frame = df.toDF(*fields) if fields else df
    if len(set(frame.columns)) != len(frame.columns):
        raise ValueError("a field name is given twice")
    if missing := [i for i in indices if i not in frame.columns]:
        raise ValueError(f"no such field to index: {', '.join(missing)}")
    writer = (frame.repartition(partitions) if partitions else frame).write.mode("errorifexists")
    for i in indices:
        writer = writer.option(f"parquet.bloom.filter.enabled#{i}", True)
    writer.parquet(path)


def read_columnar(spark: SparkSession, path: str | Sequence[str], fields: Sequence[str] | None = None) -> DataFrame:
    """Chosen fields in the chosen order; only those columns are read. An unknown field is an error."""
    frame = spark.read.parquet(*([path] if isinstance(path, str) else path))
    if fields is None:
        return frame
    if missing := [f for f in fields if f not in frame.columns]:
        raise ValueError(f"no such field: {', '.join(missing)}")
    return frame.select(*fields)


def filter_by_index(df: DataFrame, **conditions) -> DataFrame:
    """Rows that meet all conditions; a list means any of its values, a Column is a predicate, and a
    function gets the Column and returns one. Row groups are pruned by statistics and bloom filters."""
    for field, wanted in conditions.items():
        if field not in df.columns:
            raise ValueError(f"no such field: {field}")
        if isinstance(wanted, Column):
            df = df.filter(wanted)
        elif callable(wanted):
            df = df.filter(wanted(F.col(field)))
        elif isinstance(wanted, (list, tuple, set)):
            df = df.filter(F.col(field).isin(list(wanted)))
        else:
            df = df.filter(F.col(field) == wanted)
    return df


def collect_map(df: DataFrame, key: str, value: str) -> dict:
    """A driver-side dict; the last of repeated keys stays. For results known to be small."""
    return {r[0]: r[1] for r in df.select(key, value).toLocalIterator()}


def rows(df: DataFrame) -> Iterator:
    """Rows, a partition at a time."""
    return df.toLocalIterator()
