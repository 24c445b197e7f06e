"""Readers and conforming steps.

CSV input is read by Spark's CSV source.  Files are grouped by encoding and
by header, so each group is one distributed read (no per-row driver work);
the per-file loop only touches file names and header lines.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import parse_timestamp
from . import schema as S

ENCODINGS = ("utf-8", "iso-8859-1")   # Spark CSV charset names; latin-1 decodes any byte


def list_files(spark: SparkSession, root: str, pattern: str = "*.csv", depth: int = 1,
               with_length: bool = False):
    """File paths under ``root`` and ``depth`` levels of subfolders, through the
    Hadoop FileSystem glob (any cluster filesystem; unlike Spark's file
    index it also lists zero-length files).  Only names are read."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = {}
    for d in range(depth + 1):
        g = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{'*/' * d}{pattern}")
        fs = g.getFileSystem(conf)
        for st in fs.globStatus(g) or []:
            if st.isFile():
                out[st.getPath().toString()] = st.getLen()
    return sorted(out.items()) if with_length else sorted(out)


def file_heads(spark: SparkSession, paths: Sequence[str]) -> dict[str, tuple[int, str | None, bytes]]:
    """Per file its length, encoding and first line that is not blank: one job
    for any number of files, one row a file comes back.

    Lines keep their bytes as they are and no UTF-8 character holds a line end,
    so a file is valid UTF-8 if its lines are (large files are read in splits);
    any other is read as latin-1, which decodes any byte.  A file without a
    line has no encoding."""
    if not paths:
        return {}
    head = (F.col("_metadata.file_block_start") == 0) & (F.length(F.trim("value")) > 0)
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"), F.is_valid_utf8("value").alias("valid"),
        F.when(head, F.col("value").cast("binary")).alias("line"), F.when(head, F.monotonically_increasing_id()).alias("at"))
    found = lines.groupBy("path").agg(F.max("length").alias("length"), F.bool_and("valid").alias("valid"), F.min_by("line", "at").alias("line"))
    seen = {r["path"]: (r["length"], ENCODINGS[0] if r["valid"] else ENCODINGS[1], bytes(r["line"] or b"")) for r in found.collect()}
    return {p: seen.get(_qualify(spark, p), seen.get(p, (0, None, b""))) for p in paths}


def detect_encodings(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Per file: size and whether its bytes are valid UTF-8; others are
    read as latin-1; zero-length files have no encoding."""
    rows = [(p, length, encoding) for p, (length, encoding, _) in file_heads(spark, paths).items()]
    return spark.createDataFrame(rows, "path string, length long, encoding string")


def _qualify(spark: SparkSession, p: str) -> str:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(p)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(path).toString()


def read_csv(spark: SparkSession, paths: str | Sequence[str], encoding: str = "utf-8",
             schema: T.StructType | None = None) -> DataFrame:
    """Header CSV read (all columns as strings unless a schema is given)."""
    r = spark.read.option("header", True).option("encoding", encoding).option("mode", "PERMISSIVE")
    if schema is not None:
        r = r.schema(schema)
    return r.csv(list(paths) if not isinstance(paths, str) else paths)


def read_csv_encoding(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """CSV files read with the encoding each one needs; error when a
    file is empty."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    enc = detect_encodings(spark, paths).collect()      # one row per file
    empty = [r["path"] for r in enc if r["encoding"] is None]
    if empty:
        raise ValueError(f"empty or unreadable CSV: {empty}")
    groups: dict[str, list[str]] = {}
    for r in enc:
        groups.setdefault(r["encoding"], []).append(r["path"])
    out = None
    for e, ps in sorted(groups.items()):
        df = read_csv(spark, ps, e)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def map_columns(df: DataFrame, aliases: Mapping[str, str] = S.RAW_ALIASES) -> DataFrame:
    """Rename raw headers to canonical names; when several columns map
    to one name, the first (in column order) wins and the rest are dropped."""
    out, seen = [], set()
    for c in df.columns:
        name = aliases.get(c.strip(), c.strip())
        if name in seen:
            continue
        seen.add(name)
        out.append(F.col(f"`{c}`").alias(name))
    return df.select(*out)


def resolve_dates(df: DataFrame, candidates: Sequence[str] = S.DATE_CANDIDATES,
                  target: str = "order_date") -> DataFrame:
    """The first date candidate present becomes ``target``, parsed by
    ``parse_timestamp`` (ISO and the listed other forms; bad values -> null);
    rows without a date dropped."""
    return parsed_dates(df, candidates, target).where(F.col(target).isNotNull())


def parsed_dates(df: DataFrame, candidates: Sequence[str] = S.DATE_CANDIDATES,
                 target: str = "order_date") -> DataFrame:
    """A04 before its filter: rows with bad dates still there, ``target`` null."""
    found = next((c for c in candidates if c in df.columns), None)
    if found is None:
        raise ValueError("no date column among candidates")
    src = F.col(found)
    text = isinstance(df.schema[found].dataType, T.StringType)
    return df.withColumn(target, parse_timestamp(src) if text else src.cast("timestamp"))


def conform_schema(df: DataFrame, columns: Sequence[str] = S.CANONICAL_COLUMNS,
                   keep: Sequence[str] = ()) -> DataFrame:
    """Add missing canonical columns with typed defaults (0.0 / False /
    'None' / a copy of another column), derive date parts, select in order."""
    add = {}
    for c in columns:
        if c in df.columns:
            continue
        if c in S.ZERO_DEFAULT:
            add[c] = F.lit(0.0)
        elif c in S.FALSE_DEFAULT:
            add[c] = F.lit(False)
        elif c == "forecast_date":
            add[c] = F.col("order_date")
        elif c == "location":
            add[c] = F.col("city") if "city" in df.columns else F.lit("Unknown")
        else:
            add[c] = F.lit("None")
    x = df.withColumns(add)
    d = F.col("order_date")
    x = x.withColumns({"order_year": F.coalesce(F.year(d), F.lit(0)),
                       "order_month": F.coalesce(F.month(d), F.lit(0)),
                       "order_day": F.coalesce(F.dayofmonth(d), F.lit(0)),
                       "order_day_of_week": F.coalesce(F.weekday(d), F.lit(0))})
    return x.select(*[F.col(f"`{c}`") for c in columns], *[c for c in keep if c in df.columns])


def read_folder_union(spark: SparkSession, root: str, aliases: Mapping[str, str] = S.RAW_ALIASES,
                      depth: int = 1) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Every CSV of a folder and one level of subfolders, conformed and
    concatenated by name.  Files are grouped by (encoding, header line), both
    from one job over all files, so each group is one read; a file that fails
    (no date column, all dates bad) is skipped and reported as (path, reason)."""
    groups: dict[tuple, list[str]] = {}
    skipped = []
    for p, (_length, encoding, header) in file_heads(spark, list_files(spark, root, depth=depth)).items():
        if encoding is None:
            skipped.append((p, "empty file"))
        else:
            groups.setdefault((encoding, header), []).append(p)
    out = None
    for (e, _h), ps in sorted(groups.items()):
        raw = read_csv(spark, ps, e).withColumn("source_file", F.col("_metadata.file_path"))
        try:
            dated = parsed_dates(map_columns(raw))
        except ValueError as err:
            skipped += [(p, str(err)) for p in ps]
            continue
        good = {r["source_file"] for r in dated.groupBy("source_file").agg(F.count("order_date").alias("n"))
                .where("n > 0").select("source_file").collect()}     # one row per file
        bad = [p for p in ps if _qualify(spark, p) not in good and p not in good]
        skipped += [(p, "no row with a valid date") for p in bad]
        if len(bad) == len(ps):
            continue
        x = conform_schema(dated.where(F.col("order_date").isNotNull()), keep=["source_file"])
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    if out is None:
        raise RuntimeError("no CSV loaded successfully")
    return out, skipped


def load_reference_tables(spark: SparkSession, root: str, names: Sequence[str] = S.REFERENCE_TABLES,
                          cleaned_suffix: str = "_clean") -> dict[str, DataFrame]:
    """Dimension tables by name; the cleaned copy ``{name}_clean.csv`` is
    preferred, the raw ``{name}.csv`` is the fallback.  Header blanks are
    stripped and every column with 'date' in its name is parsed."""
    files = set(list_files(spark, root, depth=0))
    out = {}
    for n in names:
        for cand in (f"{n}{cleaned_suffix}.csv", f"{n}.csv"):
            hit = [p for p in files if p.endswith("/" + cand)]
            if hit:
                df = read_csv_encoding(spark, hit)
                df = df.select(*[F.col(f"`{c}`").alias(c.strip()) for c in df.columns])
                df = df.withColumns({c: parse_timestamp(F.col(c)) for c in df.columns
                                     if "date" in c.lower() and isinstance(df.schema[c].dataType, T.StringType)})
                out[n] = df
                break
    return out


def load_demand_history(df: DataFrame, ids: Sequence[str] = ("order_id", "sku_id", "customer"),
                        ds: str = "order_date") -> DataFrame:
    """Ids typed as strings, the date parsed (bad -> null), rows
    without a valid date dropped."""
    x = df.withColumns({c: F.col(c).cast("string") for c in ids if c in df.columns})
    if isinstance(x.schema[ds].dataType, T.StringType):
        x = x.withColumn(ds, F.to_date(parse_timestamp(F.col(ds))))
    return x.where(F.col(ds).isNotNull())


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """All rows when there are at most n, else a repeatable pseudo-random
    n: rows ordered by md5(key || seed) -- top-k, no shuffle of all rows."""
    h = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed))))
    return df.withColumn("_h", h).orderBy("_h").limit(n).drop("_h")
