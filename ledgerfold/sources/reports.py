"""Reports as lines: text tables with columns of one width, CSV, JSON. Lines are numbered from 1; the header is line 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text


def text_table(rows: DataFrame, columns: dict[str, Column], order: list[str], gap: int = 2) -> DataFrame:
    """(line_no, line): each column as wide as its widest text or heading, and gap spaces between columns.

    A report is one ordered text, for people to read: rows are few, and are put in order in one task.
    """
    names = list(columns)
    cells = rows.select(F.row_number().over(W.orderBy(*order)).alias("line_no"), *[F.coalesce(c.cast("string"), F.lit("")).alias(f"c{i}") for i, c in enumerate(columns.values())])
    widths = cells.agg(*[F.greatest(F.max(F.length(f"c{i}")), F.lit(len(n))).alias(f"w{i}") for i, n in enumerate(names)])
    head = widths.select(F.lit(0).alias("line_no"), *[F.lit(n).alias(f"c{i}") for i, n in enumerate(names)], *widths.columns)
    body = cells.join(F.broadcast(widths)).select("line_no", *[f"c{i}" for i in range(len(names))], *widths.columns)
    padded = [F.rpad(F.col(f"c{i}"), F.col(f"w{i}") + gap, F.lit(" ")) for i in range(len(names) - 1)]
    line = F.concat(*padded, F.col(f"c{len(names) - 1}"))
    return head.unionByName(body).where("line_no > 0 OR w0 IS NOT NULL").select("line_no", F.rtrim(line).alias("line"))


def segment_list(headers: DataFrame, order: list[str]) -> DataFrame:
    """The text table of current headers, with their status."""
    return text_table(
        headers,
        {
            "ID": F.lpad(F.col("segment_id").cast("string"), 8, "0"), "STATUS": F.col("status"), "SIZE": text.with_commas(F.col("write_offset")), "ENTRIES": text.with_commas(F.col("entry_count")),
            "FIRST_INDEX": text.with_commas(F.col("first_log_index")), "LAST_MODIFIED": text.time_text(F.col("last_modified_at").cast("timestamp")),
        },
        order,
    )


def labelled(row: DataFrame, fields: dict[str, Column], width: int = 19) -> DataFrame:
    """(line_no, line) of one row's fields, each behind its label."""
    lines = F.array(*[F.concat(F.rpad(F.lit(f"{k}:"), width, " "), F.coalesce(v.cast("string"), F.lit(""))) for k, v in fields.items()])
    return row.select(F.posexplode(lines).alias("at", "line")).select((F.col("at") + 1).alias("line_no"), "line")


def csv_lines(rows: DataFrame, columns: list[str], header: bool = False) -> DataFrame:
    """(line): the rows as CSV; numbers with decimals have two of them."""
    kinds = dict(rows.dtypes)
    cell = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.2f", c)) if kinds[c] in ("double", "float") else F.col(c).cast("string")
    quoted = lambda x: F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    out = rows.select(F.concat_ws(",", *[F.coalesce(quoted(cell(c)), F.lit("")) for c in columns]).alias("line"))
    return rows.sparkSession.createDataFrame([(",".join(columns),)], "line string").unionByName(out) if header else out


def json_lines(rows: DataFrame) -> DataFrame:
    """(line): the rows as JSON; null fields are left out."""
    return rows.select(F.to_json(F.struct("*")).alias("line"))


def appended_csv(rows: DataFrame, columns: list[str], path: str) -> None:
    """Add the rows as CSV to what is at path."""
    csv_lines(rows, columns).write.mode("append").text(path)
