"""File sources: CoNLL blocks, text directories, delimited text, parallel
line-aligned files, graph records and split-partitioned datasets.

Order matters for corpora, so every scan that yields a sequence attaches an
explicit ordinal. It comes from the order that the scan already has: rows are
counted per file split, and only those counts are ordered and summed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.operators.ordinal import global_ordinal
from tessera.session import pinned

GRAPH_SCHEMA = "graph_id long, text string, edges array<struct<u:bigint,v:bigint>>"


MAX_BROADCAST_SPLITS = 2_000_000  # about 40 bytes each


def _with_file_order(df: DataFrame) -> DataFrame:
    """File path, split start and a per-partition increasing id: the read order of a text scan."""
    return df.select(F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("_start"), "value",
                     F.monotonically_increasing_id().alias("_mid"))


def _file_key(path: str = "file") -> list:
    """Sort keys of a file: its folder, the number in a ``part-N`` name, the path."""
    return [F.regexp_extract(path, r"^(.*)/[^/]*$", 1),
            F.coalesce(F.expr(f"try_cast(regexp_extract({path}, '/part-([0-9]+)[^/]*$', 1) AS BIGINT)"), F.lit(-1)), F.col(path)]


def number_rows(raw: DataFrame, name: str, per_file: bool) -> DataFrame:
    """Position of every row of a text scan, per file or over all files, without moving the rows.

    ``raw`` has ``file, _start, _mid`` (:func:`_with_file_order`). A scan already yields a split's rows in
    order, so only (file, split) counts are aggregated: one narrow row per split. Their running sums
    come back by a broadcast, as a split table of up to ``MAX_BROADCAST_SPLITS`` rows is small, or by
    an ordinary join beyond. The counts are written once; a row of a split that was not counted (files
    cut in another way by the second scan, as executors came or went) fails the query.
    """
    split = F.xxhash64("file", "_start")
    stats = raw.groupBy("file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    stats = pinned(stats.withColumn("_s", F.xxhash64("file", "_start")), "split-counts")
    if per_file:
        w = Window.partitionBy("file").orderBy("_start")
    else:
        stats = stats.withColumns(dict(zip(("_k1", "_k2", "_k3"), _file_key())))
        w = Window.orderBy("_k1", "_k2", "_k3", "_start")
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stats.select("_s", (before - F.col("_first")).alias("_off"))
    small = stats.count() <= MAX_BROADCAST_SPLITS
    found = F.coalesce("_off", F.raise_error(F.lit("the files were split differently when they were counted")).cast("long"))
    return raw.withColumn("_s", split).join(F.broadcast(offsets) if small else offsets, "_s", "left") \
        .select(*[c for c in raw.columns if c not in ("_start", "_mid")], (found + F.col("_mid")).alias(name))


def blocks_of(raw: DataFrame, keep_empty: bool = False, per_file: bool = True) -> DataFrame:
    """Numbered block rows from a scan with a blank-line separator."""
    block = F.regexp_replace(F.col("value"), "\r\n", "\n")
    out = number_rows(raw, "block_no", per_file).select("file", "block_no", block.alias("block"), (~block.endswith("\n")).alias("closed"))
    return out if keep_empty else out.where(F.regexp_replace(F.col("block"), "\n", "") != "")


def scan_blocks(spark: SparkSession, paths, newline: str = "lf", keep_empty: bool = False, per_file: bool = True) -> DataFrame:
    """CoNLL-family files -> one row per blank-line separated block, in file order.

    Output ``(file, block_no, block, closed)``: ``block_no`` is 0-based per
    file, or with ``per_file=False`` over all files in the order of :func:`scan_lines`, empty blocks counted; ``closed`` is false for an unfinished last block (it still ends in
    a newline because no blank line followed). ``newline='crlf'`` reads
    Windows files (blocks separated by CRLF CRLF). Two blank lines in a row
    make an empty sentence, which ``keep_empty`` keeps.
    """
    sep = "\r\n\r\n" if newline == "crlf" else "\n\n"
    return blocks_of(_with_file_order(spark.read.option("lineSep", sep).text(paths)), keep_empty, per_file)


def scan_lines(spark: SparkSession, paths, per_file: bool = False) -> DataFrame:
    """Text files -> ``(file, line_no, text)``.

    ``line_no`` is 0-based over the whole dataset (files by folder and ``part-N``
    number, so a directory of ordered part files reads as one sequence), or per file.
    """
    raw = _with_file_order(spark.read.text(paths)).withColumnRenamed("value", "text")
    return number_rows(raw, "line_no", per_file).select("file", "line_no", "text")


COPY_BYTES, COPY_PARTS = 32 << 20, 64  # of a task that copies small files, about


def _few_tasks(files: DataFrame, raw: DataFrame) -> DataFrame:
    """``raw`` in fewer partitions where the files are small: Spark plans a task for every few of them, and each would write a file of its own."""
    parts, size = files.rdd.getNumPartitions(), files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    n = max(int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // COPY_BYTES), -(-parts // COPY_PARTS))
    return raw.coalesce(n) if n < parts else raw


def scan_text_dir(spark: SparkSession, directory: str, suffix: str = ".txt",
                  first_n: int | None = None, recursive: bool = False) -> DataFrame:
    """Directory of documents (one per file) -> ``(path, ordinal, text)``.

    Files are ordered by path (the source used unspecified directory order),
    then optionally cut to the first ``first_n``. With ``recursive`` the folders below are read too,
    and listed by tasks. Every file is opened once, as many small files cost more to open than to
    copy, and a task copies many of them; only the paths are sorted, the copied texts stay where they are unless the path table is
    too large to broadcast.
    """
    files = spark.read.option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", recursive).text(directory, wholetext=True)
    raw = _few_tasks(files, files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))
    raw = pinned(raw, "text-dir")
    o = global_ordinal(raw.select("path"), ["path"], (), "ordinal")
    if first_n is not None:
        o = o.where(F.col("ordinal") < first_n)
    return raw.join(o, "path").select("path", "text", "ordinal")


# how the line ends of a field are written, so that a record is one line and files stay splittable
_ESCAPES = [("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")]


def escape_lines(df: DataFrame) -> DataFrame:
    r"""String columns with backslash, line feed and carriage return written as ``\\``, ``\n``, ``\r``, empty strings as ``\e``."""
    cols = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    out = {}
    for c in cols:
        x = F.col(f"`{c}`")
        for raw, esc in _ESCAPES:
            x = F.replace(x, F.lit(raw), F.lit(esc))
        # an empty field would come back as null
        out[c] = F.when(F.col(f"`{c}`") == "", F.lit("\\e")).otherwise(x)
    return df.withColumns(out) if out else df


def unescape_lines(df: DataFrame) -> DataFrame:
    """Undo :func:`escape_lines`. A read line holds no line ends, so they mark the three cases until the last step."""
    out = {}
    for f in df.schema.fields:
        if f.dataType.typeName() == "string":
            x = F.col(f"`{f.name}`")
            for esc, mark in (("\\\\", "\n"), ("\\n", "\r"), ("\\r", "\\")):
                x = F.replace(x, F.lit(esc), F.lit(mark))
            out[f.name] = F.when(F.col(f"`{f.name}`") == "\\e", F.lit("")).otherwise(F.translate(x, "\n\r\\", "\\\n\r"))
    return df.withColumns(out) if out else df


def scan_delimited(spark: SparkSession, path, schema: str, sep: str = ",", header: bool = True,
                   quote: str | None = '"', escaped: bool = False) -> DataFrame:
    """CSV / TSV with an explicit schema, one record per line (so files are split over tasks).

    ``quote=''`` for hand-written TSV that never quotes. A quote inside a quoted field is doubled.
    ``escaped`` reads what :func:`tessera.sources.sinks.write_delimited` writes: line ends inside
    fields come back.
    """
    r = spark.read.schema(schema).option("header", header).option("sep", sep).option("multiLine", False).option("escape", '"')
    if quote is not None:
        r = r.option("quote", quote if quote else "\u0000")
    out = r.csv(path)
    return unescape_lines(out) if escaped else out


def scan_parallel(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Line-aligned files (line i is the same sentence in each) -> ``(line_no, <lang>...)``; unequal lengths fail."""
    from tessera.operators.align import parallel_align
    return parallel_align({lang: scan_lines(spark, p) for lang, p in paths.items()})


def scan_graphs(spark: SparkSession, path, fmt: str = "json") -> DataFrame:
    """Graph records ``(graph_id, text, edges array<struct<u,v>>)`` with an explicit schema."""
    return spark.read.schema(GRAPH_SCHEMA).format(fmt).load(path)


def graphs_from_conllu(tokens: DataFrame, sent_key=("file", "block_no")) -> DataFrame:
    """Dependency edges (head, id) of parsed CoNLL-U tokens; the root edge (head 0) excluded."""
    t = tokens.where((F.col("head") > 0) & F.col("id").rlike(r"^\d+$"))
    return t.select(*sent_key, F.col("head").alias("u"), F.col("id").cast("int").alias("v"))


def scan_partitioned_split(spark: SparkSession, root: str, lang: str | None = None,
                           split: str | None = None) -> DataFrame:
    """Dataset laid out as ``lang=/split=`` Parquet; filters prune partitions."""
    df = spark.read.parquet(root)
    if lang is not None:
        df = df.where(F.col("lang") == lang)
    if split is not None:
        df = df.where(F.col("split") == split)
    return df
