"""Finding lines, in batch and as a stream of new files; plain sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas as S

LINE_LIMIT = 65536
REQUIRED = ("level", "check", "player", "session", "event", "message")


def parse_findings(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Finding columns, the line itself as ``json`` and ``error``; unknown levels are kept.

    Columns of ``lines`` named in ``keep`` come first, so that no line has to be found again by its text.
    Spark's JSON reader keeps the last of duplicate keys, so these are not refused here.
    """
    f = F.from_json(column, S._fields(S.FINDING_DDL + ", _corrupt string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    df = lines.withColumn("f", F.when(F.octet_length(column) <= LINE_LIMIT, f))
    missing = F.lit(False)
    for name in REQUIRED:
        missing = missing | F.col(f"f.{name}").isNull()
    error = (F.when(F.octet_length(column) > LINE_LIMIT, "line_too_long").when(F.col("f._corrupt").isNotNull() | ~F.trim(column).startswith("{"), "not_an_object")
             .when(missing, "missing_field"))
    names = [x.name for x in S._fields(S.FINDING_DDL)]
    return df.select(*keep, F.col(column).alias("json"), *[F.col(f"f.{n}").alias(n) for n in names], error.alias("error"))


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    return parse_findings(spark.read.text(path))


def stream_findings(spark: SparkSession, path: str, delay: str = "10 minutes") -> DataFrame:
    """New finding files as a stream, each finding once within the watermark."""
    from ..operators.admission import dedup_findings

    parsed = parse_findings(spark.readStream.text(path)).filter("error IS NULL")
    return dedup_findings(parsed.withColumn("ts", F.timestamp_millis(F.col("epoch_ms").cast("long"))).withWatermark("ts", delay))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Parquet, JSON lines or CSV; NaN and infinity are refused in JSON because readers differ on them."""
    if fmt == "json":
        for name, kind in df.dtypes:
            if kind == "double":
                df = df.withColumn(name, F.when(F.isnan(name) | (F.abs(F.col(name)) == float("inf")), F.raise_error(F.lit(f"nonfinite {name}")).cast("double")).otherwise(F.col(name)))
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    {"parquet": writer.parquet, "json": writer.json, "csv": lambda p: writer.option("header", "true").csv(p)}[fmt](path)


def export_windows(windows: DataFrame, sheet: DataFrame, path: str) -> DataFrame:
    """Write the windows of approved recordings as JSON lines and return the export's counts.

    ``sheet`` is the checked review sheet (``admission.apply_review_sheet``); windows carry ``trial``.
    """
    from ..operators.admission import export_report

    good = sheet.filter("error IS NULL").select(F.col("trial_id").alias("trial"), F.col("verified_label").alias("label"), "verification")
    out = windows.join(good, "trial")
    write_table(out, path, "json")
    return export_report(windows.sparkSession.read.schema(out.schema).json(path), sheet)


def read_review_sheet(spark: SparkSession, path: str) -> DataFrame:
    """CSV review sheet with its fixed columns."""
    return spark.read.schema("trial_id string, approved string, verified_label string, verification string, evidence string, notes string").csv(path, header=True)


def report_table(df: DataFrame, title: str, limit: int = 1000) -> str:
    """Markdown of a small aggregate (at most ``limit`` rows, checked)."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("a report shows aggregates only")
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]) + "\n"
