"""Reading and writing files with explicit schemas and checks."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import casts


def header(spark: SparkSession, path: str, sep: str = ";", encoding: str = "UTF-8") -> list[str]:
    """Column names of one delimited file, without a byte order mark."""
    line = spark.read.option("encoding", encoding).text(path).limit(1).collect()
    return [c.strip().strip('"') for c in line[0][0].lstrip("﻿").split(sep)] if line else []


def check_headers(spark: SparkSession, paths: list[str], expected: list[str], **options) -> None:
    """Raises if a file's header differs from the expected one."""
    wrong = {p: h for p in paths if (h := header(spark, p, **options)) != expected}
    if wrong:
        raise ValueError(f"headers differ from {expected}: {wrong}")


def read_delimited(spark: SparkSession, paths: str | list[str], schema: T.StructType, sep: str = ";", columns: list[str] | None = None, fallback: str = "ISO-8859-1") -> DataFrame:
    """Delimited files as one frame with the file's name in ``source_file``; only the asked columns are parsed.

    Text that isn't UTF-8 gives replacement characters; then the files are read in the fallback encoding.
    """
    read = lambda encoding: spark.read.schema(schema).option("header", True).option("sep", sep).option("encoding", encoding).option("mode", "FAILFAST").option("enforceSchema", True).csv(paths)
    out = read("UTF-8")
    texts = [f.name for f in schema if isinstance(f.dataType, T.StringType)]
    if texts and out.where(F.concat_ws("", *texts).contains("�")).limit(1).count():
        out = read(fallback)
    return out.select(*(columns or schema.names), F.col("_metadata.file_name").alias("source_file"))


def union_checked(frames: list[DataFrame]) -> DataFrame:
    """Union of frames whose schemas must be equal."""
    first = frames[0]
    for f in frames[1:]:
        if f.schema.simpleString() != first.schema.simpleString():
            raise ValueError(f"schemas differ: {f.schema.simpleString()} and {first.schema.simpleString()}")
    out = first
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def land(df: DataFrame, path: str, keep: Column, by: str) -> DataFrame:
    """Filtered rows landed as Parquet by a partition column: only values of ``by`` that are not there yet, which are
    written without touching the others. A null is landed as Hive's default partition; land it with its own value to be safe."""
    spark = df.sparkSession
    have = partitions(spark, path, by)
    fresh = df.where(keep)
    if have:
        fresh = fresh.where(F.coalesce(~F.col(by).cast("string").isin(have), F.lit(True)))
    fresh.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession, path: str, by: str) -> list[str]:
    """The values of a partition column that a folder holds, by their folders' names."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    names = (s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())
    return sorted(unescape(n.split("=", 1)[1]) for n in names if n.startswith(f"{by}="))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


#: A stage is a folder of versions; this file in it names the one that readers take.
POINTER = "_current"


def _plain(fs):
    """A local file system without its checksum files, which a rename would not replace together with the file."""
    return fs.getRaw() if fs.getScheme() == "file" else fs


def _pointed(spark: SparkSession, stage: str) -> str | None:
    """The folder of a stage's current version; None where the stage has no pointer."""
    fs, p = _fs(spark, f"{stage}/{POINTER}")
    fs = _plain(fs)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return f"{stage}/{bytes(stream.readAllBytes()).decode()}"
    finally:
        stream.close()


def read_stage(spark: SparkSession, parquet: str, csv: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """A stage's current version (or a plain Parquet folder), else its CSV with an explicit schema, else an error that names both."""
    version = _pointed(spark, parquet)
    if version or exists(spark, parquet):
        return spark.read.parquet(version or parquet)
    if csv and exists(spark, csv):
        if schema is None:
            raise ValueError("a CSV stage needs a schema")
        return spark.read.schema(schema).option("header", True).csv(csv)
    raise FileNotFoundError(f"neither {parquet} nor {csv} is there")


def versions(spark: SparkSession, stage: str) -> list[tuple[int, str]]:
    """When the versions of a stage were written (milliseconds) and their names, oldest first."""
    fs, p = _fs(spark, stage)
    return sorted((s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().startswith("v-"))


def write_stage(df: DataFrame, parquet: str, csv: str | None = None, keep: int = 2, grace: float = 3600.0) -> None:
    """A new version beside the current one, then one rename of the pointer file that replaces it.

    A reader finds the old version or the new one, whole, at any moment; a crash leaves the old one current. The last
    ``keep`` versions stay, and for readers that are still on them all that were current in the last ``grace`` seconds.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{parquet}/{name}")
    fs, _ = _fs(spark, parquet)
    plain = _plain(fs)
    draft, pointer = path(f"{parquet}/.{name}"), path(f"{parquet}/{POINTER}")
    out = plain.create(draft, True)
    out.write(bytearray(name.encode()))
    out.close()
    if plain is not fs:
        plain.rename(draft, pointer)  # the system's own rename, which replaces a file in one step
    else:
        kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        overwrite = spark.sparkContext._gateway.new_array(kinds, 1)
        overwrite[0] = kinds.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(draft), fs.makeQualified(pointer), overwrite)
    there = versions(spark, parquet)
    replaced = [t for t, _ in there][1:]  # when the next version was written
    for (_, old), since in list(zip(there, replaced, strict=False))[: max(0, len(there) - keep)]:
        if old != name and since <= (time.time() - grace) * 1000:
            fs.delete(path(f"{parquet}/{old}"), True)
    if csv:
        spark.read.parquet(f"{parquet}/{name}").write.mode("overwrite").option("header", True).csv(csv)


def _unreadable(f: DataFrame, columns: list[T.StructField], examples: int = 5) -> dict[str, list[str]]:
    """For each column up to ``examples`` values that are there and don't cast to its type: one pass over the file."""
    lost = lambda c: F.when((F.trim(c.name) != "") & casts.cast_or_null(F.col(c.name), c.dataType.simpleString()).isNull(), F.col(c.name))
    texts = [c for c in columns if not isinstance(c.dataType, T.StringType)]
    if not texts:
        return {}
    found = f.select(F.inline(F.array(*(F.struct(F.lit(c.name).alias("c"), lost(c).alias("v")) for c in texts)))).where("v is not null").limit(examples).collect()
    out: dict[str, list[str]] = {}
    for r in found:
        out.setdefault(r["c"], []).append(r["v"])
    return out


def read_yearly(spark: SparkSession, paths: list[str] | dict[int, str], schema: T.StructType, box: dict[str, tuple[float, float]] | None = None, keep: Column | None = None, year: str = "year") -> DataFrame:
    """Yearly files whose columns carry the year (``B23BTOT`` becomes ``BBTOT``), as one frame of ``schema`` and the year.

    The year is the last four digits in a file's name (or given); the separator is that of the header; columns are read as
    text and cast strictly by ``schema``, so types never drift between years; ``box`` keeps ranges of columns.
    """
    by_year = paths if isinstance(paths, dict) else {int(re.findall(r"\d{4}", p.rsplit("/", 1)[-1])[-1]): p for p in paths}
    frames = []
    for y, path in sorted(by_year.items()):
        line = spark.read.text(path).limit(1).collect()[0][0]
        sep = ";" if line.count(";") >= line.count(",") else ","
        names = [c.strip().strip('"') for c in line.lstrip("﻿").split(sep)]
        mark = f"{y % 100:02d}"
        plain = [c[0] + c[3:] if len(c) > 3 and c[0].isalpha() and c[1:3] == mark else c for c in names]
        f = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in plain])).option("header", True).option("sep", sep).csv(path)
        known = [c for c in schema if c.name in plain]
        bad = {c: r for c, r in _unreadable(f, known).items() if r}
        if bad:
            raise ValueError(f"{path}: values that don't cast: {bad}")
        f = casts.conform(f.select(*(casts.cast_or_null(F.col(c.name), c.dataType.simpleString()).alias(c.name) for c in known)), schema)
        for c, (low, high) in (box or {}).items():
            f = f.where(F.col(c).between(low, high))
        frames.append((f.where(keep) if keep is not None else f).withColumn(year, F.lit(y)))
    return union_checked(frames)


def cleaned_series(raw: DataFrame, names: dict[str, str], time: str, station: str) -> tuple[DataFrame, DataFrame]:
    """(clean, report): parameters renamed, columns without a value dropped, doubled times an error; missing shares as rows."""
    out = raw.withColumnsRenamed(names)
    if out.groupBy(station, time).count().where("count > 1").limit(1).count():
        raise ValueError("a station has a time twice")
    values = [c for c in out.columns if c not in (station, time)]
    seen = out.agg(F.count(F.lit(1)).alias("_rows"), *(F.count(c).alias(c) for c in values)).first()
    kept = [c for c in values if seen[c]]
    report = out.sparkSession.createDataFrame([(c, seen["_rows"], seen["_rows"] - seen[c], c in kept) for c in values], "column string, rows long, missing long, kept boolean")
    return out.select(station, time, *kept), report


def only_known(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """``df`` if all its codes are known; raises with examples else."""
    lost = df.join(F.broadcast(codes), column, "left_anti").select(column).distinct().limit(5).collect()
    if lost:
        raise ValueError(f"unknown codes in {column}: {[r[0] for r in lost]}")
    return df


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal dimension; its days follow from calendar functions."""
    return spark.createDataFrame(rows, schema)


def final_table(df: DataFrame, drop: list[str], order: list[str]) -> DataFrame:
    """Columns dropped and ordered (others follow by name), booleans as tiny integers."""
    left = [c for c in df.columns if c not in drop]
    missing = [c for c in order if c not in left]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    flags = {f.name for f in df.schema if isinstance(f.dataType, T.BooleanType)}
    names = [*order, *sorted(set(left) - set(order))]
    return df.select(*(F.col(c).cast("tinyint").alias(c) if c in flags else F.col(c) for c in names))


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)
