"""CSV and workbook scans, and their exports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SheetError
from ..functions.text import MISSING_TOKENS
from .office import column_name, read_workbook

ORDER_COLUMN = "_order"
LISTED_SHEETS = 20  # names an error message spells out; it says how many more there are


CORRUPT = "_corrupt_line"


def _reader(spark: SparkSession, multiline: bool):
    return (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("enforceSchema", False)  # files whose header differs from the first one are an error, never bound by place
    )


def files_with_quoted_breaks(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """The files that have a line with an odd number of quotes: a cell goes on in the next line."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), (quotes % 2 == 1).alias("odd"))
    return [r["file"] for r in odd.filter("odd").select("file").distinct().collect()]


def scan_csv(
    spark: SparkSession, path: str | Sequence[str], *, multiline: bool | None = False, with_order: bool = False, with_errors: bool = False
) -> DataFrame:
    """CSV with a header row, every column a string, empty-value spellings as NULL.

    ``with_order`` adds ``_order`` (file, split start, row within split), the file order that
    keep-first needs. ``multiline`` allows line breaks inside quotes and makes a file one split; None first looks through
    the lines for files that need it, and reads only those that way. A row with fewer cells than the header is filled up.
    One with more ends the job, or, ``with_errors``, has NULL cells and an ``_error``.
    """
    paths = [path] if isinstance(path, str) else list(path)
    broken = files_with_quoted_breaks(spark, paths) if multiline is None else []
    names = _reader(spark, bool(broken) or bool(multiline)).csv(paths).columns
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in names), T.StructField(CORRUPT, T.StringType())])

    def read(several: bool) -> DataFrame:
        return _reader(spark, several).schema(schema).option("columnNameOfCorruptRecord", CORRUPT).csv(paths)

    df = read(bool(multiline))
    if broken:
        mine = F.col("_metadata.file_path").isin(broken)
        df = _cells(read(False).filter(~mine), names, with_order).unionByName(_cells(read(True).filter(mine), names, with_order))
    else:
        df = _cells(df, names, with_order)
    kept = [*names, *([ORDER_COLUMN] if with_order else [])]
    found = F.col("_found")
    error = F.when(found > len(names), F.concat(F.lit("a row has "), found.cast("string"), F.lit(f" cells under a header of {len(names)}")))
    if with_errors:
        cells = [F.when(error.isNull(), F.col(f"`{c}`")).alias(c) for c in names]
        return df.select(*cells, *kept[len(names):], error.alias("_error"))
    first = F.when(error.isNull(), F.col(f"`{names[0]}`")).otherwise(F.raise_error(error)).alias(names[0])
    return df.select(first, *(F.col(f"`{c}`") for c in kept[1:]))


def _cells(df: DataFrame, names: Sequence[str], with_order: bool) -> DataFrame:
    """Cells with missing ones as NULL, how many an odd row has, and the order."""
    outside = F.regexp_replace(CORRUPT, '"[^"]*"', "")
    found = F.when(F.col(CORRUPT).isNotNull(), F.length(outside) - F.length(F.replace(outside, F.lit(","), F.lit(""))) + 1)
    cleaned = [F.when(~F.col(f"`{c}`").isin(MISSING_TOKENS), F.col(f"`{c}`")).alias(c) for c in names]
    if with_order:
        place = F.struct(
            F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
        )
        cleaned.append(place.alias(ORDER_COLUMN))
    return df.select(*cleaned, F.coalesce(found, F.lit(0)).alias("_found"))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV export: header, no index, one part file per task."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


WORKBOOK_SCHEMA = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("sheet", T.StringType()),
        T.StructField("row_no", T.IntegerType()),
        T.StructField("cells", T.MapType(T.StringType(), T.StringType())),
        T.StructField("kinds", T.MapType(T.StringType(), T.StringType())),
        T.StructField("error", T.StringType()),
    ]
)


def scan_workbooks(files: DataFrame, batch_rows: int = 5000) -> DataFrame:
    """All sheets of ``(file, content)`` workbooks as one long table, a row per sheet row.

    ``cells`` maps header to text, ``kinds`` to number / text / bool / date. The header itself is
    a row without ``row_no``, so a sheet without data rows exists too. A damaged workbook is one
    row with ``error``. Rows leave in batches, so a long sheet is never held whole as rows.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"]):
                rows: list[tuple] = []
                try:
                    for sheet, row_no, cells, kinds in read_workbook(content):
                        rows.append((file, sheet, row_no, cells, kinds, None))
                        if len(rows) == batch_rows:
                            yield pd.DataFrame(rows, columns=WORKBOOK_SCHEMA.names)
                            rows = []
                except Exception as exc:  # any damage is this file's, not the job's
                    rows.append((file, None, None, None, None, f"{type(exc).__name__}: {exc}"))
                if rows:
                    yield pd.DataFrame(rows, columns=WORKBOOK_SCHEMA.names)

    return files.select("file", "content").mapInPandas(scan, WORKBOOK_SCHEMA)


def choose_sheet(workbook: DataFrame, sheet: str | None = None) -> DataFrame:
    """Rows of the named sheet, or of the only one; anything else is an error naming the choices."""
    sheets = workbook.filter("sheet is not null").select("sheet").distinct()
    chosen = F.col("sheet") == sheet
    if sheet is not None and not workbook.filter(chosen).isEmpty():
        return workbook.filter(chosen)
    names = [r["sheet"] for r in sheets.orderBy("sheet").limit(LISTED_SHEETS).collect()]
    if sheet is None and len(names) == 1:
        return workbook.filter(F.col("sheet") == names[0])
    rest = sheets.count() - len(names)
    listed = ", ".join(map(repr, names)) + (f" and {rest} more" if rest else "")
    if sheet is not None:
        raise SheetError(f"There is no sheet {sheet!r} here, only: {listed or 'none at all'}")
    raise SheetError(f"Name one of the sheets: {listed or 'there is none'}")


def sheet_table(rows: DataFrame) -> DataFrame:
    """One sheet, of one workbook or of several, as a typed table ``(file, row_no, <header columns>)``.

    The columns are those of all the header rows, in the order of their first places; a workbook without one has NULL.

    A column of numbers becomes BIGINT or DOUBLE, of dates TIMESTAMP_NTZ, of booleans BOOLEAN;
    mixed columns stay text. One aggregate over all columns finds the types.
    """
    heads = rows.filter("row_no is null").select(F.posexplode(F.map_keys("cells"))).groupBy("col").agg(F.min("pos").alias("pos"))
    names = [r["col"] for r in heads.orderBy("pos", "col").collect()]
    if not names:
        return rows.filter("row_no is not null").select("file", "row_no")

    def cell(name: str):
        return F.element_at("cells", F.lit(name))

    def kind(name: str):
        return F.element_at("kinds", F.lit(name))

    facts = rows.filter("row_no is not null").agg(
        *[F.collect_set(kind(n)).alias(f"k{i}") for i, n in enumerate(names)],
        *[F.bool_and(cell(n).rlike(r"^-?\d{1,18}$")).alias(f"w{i}") for i, n in enumerate(names)],
        *[F.bool_or(cell(n).isNull()).alias(f"m{i}") for i, n in enumerate(names)],
    ).first()
    columns = []
    rows = rows.filter("row_no is not null")
    for i, name in enumerate(names):
        kinds = set(facts[f"k{i}"])
        if kinds == {"number"}:
            dtype = "bigint" if facts[f"w{i}"] and not facts[f"m{i}"] else "double"
        else:
            dtype = {frozenset(["date"]): "timestamp_ntz", frozenset(["bool"]): "boolean"}.get(frozenset(kinds), "string")
        columns.append((cell(name) if dtype == "string" else cell(name).try_cast(dtype)).alias(name))
    return rows.select("file", "row_no", *columns)


def export_workbooks(df: DataFrame, row_no: str, columns: Sequence[str], rows_per_book: int = 100_000) -> DataFrame:
    """``(file, content)`` workbooks of ``rows_per_book`` consecutive rows each, one sheet ``Sheet1``.

    A workbook is built whole by one task, so its row count is bounded (the format ends at
    about a million rows); a larger table becomes more workbooks.
    """
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    book = F.floor(F.col(row_no) / rows_per_book).cast("bigint")
    source = df.select(book.alias("_book"), F.col(row_no).alias("_row"), *[F.col(c).cast("string") for c in columns])

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_row")
        content = write_workbook(columns, rows[list(columns)].itertuples(index=False), numeric)
        return pd.DataFrame({"file": [f"part-{rows['_book'].iloc[0]}.xlsx"], "content": [content]})

    return source.groupBy("_book").applyInPandas(build, "file string, content binary")


def write_workbook(columns: Sequence[str], rows, numeric: set[str]) -> bytes:
    """The bytes of a one-sheet workbook with inline strings."""

    def cell(ref: str, name: str, value) -> str:
        if value is None:
            return ""
        if name in numeric:
            return f'<c r="{ref}"><v>{value}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'

    refs = [column_name(i) for i in range(len(columns))]
    lines = ["".join(cell(f"{r}1", "", c) for r, c in zip(refs, columns))]
    for n, row in enumerate(rows, start=2):
        lines.append("".join(cell(f"{r}{n}", c, v) for r, c, v in zip(refs, columns, row)))
    body = "".join(f'<row r="{n}">{line}</row>' for n, line in enumerate(lines, start=1))
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rels = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types">'
        '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>'
        f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships">'
        f'<Relationship Id="rId1" Type="{rels}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rels}"><sheets>'
        f'<sheet name={quoteattr("Sheet1")} sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships">'
        f'<Relationship Id="rId1" Type="{rels}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()
