"""Readers and writers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskspark.functions.schema import cast_by_suffix, nan_to_null
from riskspark.operators.metrics import valid_predictions
from riskspark.operators.tables import one_per_key, prepare_child

PREDICTIONS = "case_id BIGINT, WEEK_NUM INT, target STRING, y_prob STRING"


def read_table(spark: SparkSession, path: str, depth: int | None = None, order: list[str] | None = None) -> DataFrame:
    """One Parquet table: cast, filled, with rules, and aggregated to one row a case for depths 1 and 2."""
    return prepare_child(nan_to_null(spark.read.parquet(path)), order, depth)


def read_tables(spark: SparkSession, pattern: str, depth: int | None = None, order: list[str] | None = None, key: str = "case_id") -> DataFrame:
    """The union of all files that match a pattern, then one row a key: the first by the other columns' order."""
    made = read_table(spark, pattern, depth, order)
    return made if depth in (1, 2) else one_per_key(made, key, [c for c in made.columns if c != key])


def read_typed(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return cast_by_suffix(spark.read.parquet(path), strict)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a given schema; nothing is inferred."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_predictions(spark: SparkSession, path: str, schema: str = PREDICTIONS, strict: bool = True) -> DataFrame:
    """Predictions with numbers coerced and incomplete rows left out. Strict ones need WEEK_NUM; others clip the score
    to [0, 1] and keep the optional columns that are there."""
    raw = read_csv(spark, path, schema)
    keep = ["WEEK_NUM"] if strict else [c for c in raw.columns if c not in ("target", "y_prob")]
    return valid_predictions(raw, keep, clip_scores=not strict)


def write_parquet(df: DataFrame, path: str, codec: str = "zstd", dictionary: bool = True, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").option("compression", codec).option("parquet.enable.dictionary", str(dictionary).lower())
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv(df: DataFrame, path: str, significant: int | None = None) -> None:
    """CSV with a header; `significant` rounds doubles to so many significant digits."""
    from pyspark.sql import functions as F

    if significant:
        df = df.select(*[F.format_string(f"%.{significant}g", F.col(f"`{n}`")).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])
    df.write.mode("overwrite").option("header", True).csv(path)


def write_excel(df: DataFrame, path: str, most: int = 100_000) -> None:
    """A report table as one sheet of an .xlsx file on the driver's disk; raises beyond `most` rows."""
    import zipfile
    from xml.sax.saxutils import escape

    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write CSV or Parquet")

    def cell(v: object) -> str:
        if v is None or v != v:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    sheet = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [df.columns, *rows])
    office, package = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
    main, kind = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    link = lambda to, what: f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/{what}" Target="{to}"/></Relationships>'
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": link("xl/workbook.xml", "officeDocument"),
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": link("worksheets/sheet1.xml", "worksheet"),
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{text}')


def write_text(spark: SparkSession, lines: list[str], path: str) -> None:
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def cached_lines(spark: SparkSession, path: str, make: Callable[[], list[str]]) -> list[str]:
    """The lines stored at path, made and stored first if there are none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        write_text(spark, make(), path)
    return [r.value for r in spark.read.text(path).collect()]
