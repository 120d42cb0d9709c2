"""Workbooks as rows: cells, merged ranges and anchored objects of all files are one relation, and what they make is found by SQL operators.

A task only takes a file's XML apart. Blocks are islands of rows between gaps (a window over the
rows of a sheet), merged ranges that show a value keep their rows together, a block's columns are
those that hold a value in it, formulas are a filter. A sheet has at most 1,048,576 rows and 16,384
columns, by its format, which bounds its window and its blocks.

Defined results: a row counts if a cell of it has a value or a formula, or if a merged range whose
first cell has a value covers it; a block without a value is none; a block without a value beside
its first column has no header and no rows; hidden sheets and files that can't be read are
omissions; a formula without a stored value is both a formula and an omission.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import extract

FILE = ("root_id", "relative_path", "author", "file_hash")
SHEET = (*FILE, "sheet_no", "sheet")
#: kind is cell, merged (row and col to row_end), object (at row and col), hidden or failed (text is the reason).
PARTS = "root_id string, relative_path string, author string, file_hash string, kind string, sheet_no int, sheet string, row int, col int, row_end int, value string, formula string, image_ref string, text string"
_NAMES = [c.split()[0] for c in PARTS.split(", ")]


def parts_of(content: bytes) -> Iterator[dict]:
    """The parts of one workbook, as its XML has them."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        for number, (name, member, hidden, grid, merged) in enumerate(extract._sheets(book)):
            here = {"sheet_no": number, "sheet": name}
            if hidden:
                yield here | {"kind": "hidden"}
                continue
            yield from (here | {"kind": "cell", "row": r, "col": c, "value": value, "formula": formula} for (r, c), (value, formula) in grid.items())
            yield from (here | {"kind": "merged", "row": top, "col": left, "row_end": bottom} for top, left, bottom, _ in merged)
            for cell, reference, ranges in extract._anchored(book, member):
                letters = cell.rstrip("0123456789")
                yield here | {"kind": "object", "row": int(cell[len(letters) :]), "col": extract.column_number(letters), "image_ref": reference, "text": ranges}


def parts(files: DataFrame) -> DataFrame:
    """`PARTS` of files (root_id, relative_path, author, file_hash, content); one that can't be read gives one row of kind failed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for f in frame.itertuples():
                base = {n: getattr(f, n) for n in FILE}
                try:
                    found = [base | part for part in parts_of(bytes(f.content))]
                except Exception as e:  # one bad file must not end the run
                    found = [base | {"kind": "failed", "text": f"{type(e).__name__}: {e}"[:500]}]
                yield pd.DataFrame([{n: x.get(n) for n in _NAMES} for x in found], columns=_NAMES).astype({n: "Int32" for n in ("sheet_no", "row", "col", "row_end")})

    return files.select(*FILE, "content").mapInPandas(run, PARTS)


def cell_name(row: Column, col: Column) -> Column:
    """A1 and so on: columns in letters of base 26 without a zero."""
    letter = lambda n: F.char(F.lit(65) + F.pmod(n - 1, F.lit(26)))
    above = F.floor((col - 1) / 26)
    top = F.floor((above - 1) / 26)
    return F.concat(F.when(col > 702, letter(top)).otherwise(""), F.when(col > 26, letter(above)).otherwise(""), letter(col), row.cast("string"))


def islands(rows: DataFrame, keys: tuple[str, ...], row: str = "row") -> DataFrame:
    """The rows with `island`: the same number for rows of a key that follow each other without a gap."""
    by = Window.partitionBy(*keys).orderBy(row)
    return rows.withColumn("island", F.col(row) - F.row_number().over(by))


def blocks(found: DataFrame, keys: tuple[str, ...] = SHEET) -> DataFrame:
    """keys, first_row, first_col, last_row, last_col, label, header_row, rows of every block of parts (kind, row, col, row_end, value, formula and the keys)."""
    cells = found.where("kind = 'cell'")
    used = cells.where("value IS NOT NULL OR formula IS NOT NULL").select(*keys, "row")
    shown = found.where("kind = 'merged'").select(*keys, "row", "col", "row_end").join(cells.where("value IS NOT NULL").select(*keys, "row", "col"), [*keys, "row", "col"], "left_semi")
    spans = shown.select(*keys, F.explode(F.sequence("row", "row_end")).alias("row"))
    lined = islands(used.unionByName(spans).distinct(), keys)
    extent = lined.groupBy(*keys, "island").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"))
    valued = cells.where("value IS NOT NULL").select(*keys, "row", "col", "value").join(lined, [*keys, "row"])
    columns = valued.groupBy(*keys, "island").agg(F.array_sort(F.collect_set("col")).alias("cols"))
    lines = valued.groupBy(*keys, "island", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("by_col"), F.max("col").alias("rightmost"))
    lines = lines.join(columns, [*keys, "island"])
    line = F.transform("cols", lambda c: F.coalesce(F.try_element_at("by_col", c), F.lit("")))
    beside = F.when(F.col("rightmost") > F.get("cols", 0), F.col("row"))
    lines = lines.select(*keys, "island", "row", "cols", beside.alias("beside"), line.alias("line"))
    whole = lines.groupBy(*keys, "island").agg(F.first("cols").alias("cols"), F.min("beside").alias("header"), F.array_sort(F.collect_list(F.struct("row", "line"))).alias("lines"))
    whole = whole.join(extent, [*keys, "island"])
    at = lambda keep: F.transform(F.filter("lines", keep), lambda x: x["line"])
    none = F.array().cast("array<string>")
    return whole.select(
        *keys, "first_row", F.get("cols", 0).alias("first_col"), "last_row", F.element_at("cols", -1).alias("last_col"), F.coalesce(F.get(F.get(at(lambda x: x["row"] == F.col("first_row")), 0), 0), F.lit("")).alias("label"),
        F.coalesce(F.get(at(lambda x: x["row"] == F.col("header")), 0), none).alias("header_row"), F.coalesce(at(lambda x: x["row"] > F.col("header")), F.array().cast("array<array<string>>")).alias("rows"),
    )


def formulas(found: DataFrame, keys: tuple[str, ...] = SHEET) -> DataFrame:
    """keys, row, col, formula, value of every formula; the value is what the file stores, or null."""
    return found.where("kind = 'cell' AND formula IS NOT NULL").select(*keys, "row", "col", "formula", "value")


def extracted(files: DataFrame) -> DataFrame:
    """The segments and omissions of workbooks, as `extract.extract` has them: blocks, formulas, pictures and charts, sheet by sheet."""
    found = parts(files)
    place = lambda cells: F.to_json(F.struct("sheet", cells.alias("cell_range")))
    one = cell_name(F.col("row"), F.col("col"))
    where = F.concat("sheet", F.lit("!"), one)
    made = blocks(found)
    span = F.concat_ws(":", cell_name(F.col("first_row"), F.col("first_col")), cell_name(F.col("last_row"), F.col("last_col")))
    nothing = F.lit(None).cast("string")
    all_blocks = made.select(*SHEET, F.lit(0).alias("turn"), F.col("first_row").alias("row"), F.col("first_col").alias("col"), F.lit("block").alias("kind"), place(span).alias("place"), nothing.alias("text"), nothing.alias("image_ref"), "label", "header_row", "rows")
    said = F.concat(where, F.lit(": ="), "formula", F.coalesce(F.concat(F.lit(" -> "), "value"), F.lit("")))

    def bare(frame: DataFrame, turn: int, kind: str, text: Column, image: Column) -> DataFrame:
        lists = (F.lit(None).cast("array<string>").alias("header_row"), F.lit(None).cast("array<array<string>>").alias("rows"))
        return frame.select(*SHEET, F.lit(turn).alias("turn"), "row", "col", F.lit(kind).alias("kind"), place(one).alias("place"), text.alias("text"), image.alias("image_ref"), nothing.alias("label"), *lists)

    out = all_blocks.unionByName(bare(formulas(found), 1, "formula", said, nothing)).unionByName(bare(found.where("kind = 'object'"), 2, "image", F.col("text"), F.col("image_ref")))
    by = Window.partitionBy(*FILE).orderBy("sheet_no", "turn", "row", "col", "image_ref", "text")
    segments = out.withColumn("seg_no", F.row_number().over(by) - 1)
    reason = F.when(F.col("kind") == "failed", F.col("text")).when(F.col("kind") == "hidden", F.concat(F.lit("sheet "), "sheet", F.lit(" is hidden"))).otherwise(F.concat(where, F.lit(" has a formula without a stored value")))
    category = F.when(F.col("kind") == "failed", "failed").when(F.col("kind") == "hidden", "hidden_sheet").otherwise("value_unavailable")
    missing = found.where("kind IN ('failed', 'hidden') OR (kind = 'cell' AND formula IS NOT NULL AND value IS NULL)").select(*FILE, category.alias("omission"), reason.alias("reason"))
    known = {"locator_type": F.lit("sheet"), "locator_json": F.col("place")}
    shape = extract.EXTRACTED
    as_segment = segments.select(*(known.get(f.name, F.col(f.name) if f.name in segments.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape))
    as_omission = missing.select(*((F.col(f.name) if f.name in missing.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape))
    return as_segment.unionByName(as_omission)
