"""Daily form indexes: fixed-width text listing every filing of a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Form type, company, CIK, date and file name, in columns 1, 13, 75, 87 and 99.
INDEX_LINE = r"^(.{12})(.{62})(\d+)\s+(\d{4}-?\d{2}-?\d{2})\s+(\S+)\s*$"
# The same fields separated by runs of blanks, for lists laid out more narrowly.
SPACED_LINE = r"^(\S+(?: \S+)*)\s{2,}(\S.*?)\s{2,}(\d+)\s+(\d{4}-?\d{2}-?\d{2})\s+(\S+)\s*$"


def read_form_index(spark: SparkSession, path: str) -> DataFrame:
    """All entries; ``unparsed_lines`` has what fits neither layout, such as headings."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return parse_form_index(lines)


def parse_form_index(lines: DataFrame) -> DataFrame:
    """Entries by column position, however long the company's name; by blanks where the columns differ."""
    placed = F.col("value").rlike(INDEX_LINE)
    part = lambda i: F.when(placed, F.regexp_extract("value", INDEX_LINE, i)).otherwise(
        F.regexp_extract("value", SPACED_LINE, i)
    )
    entries = lines.filter(placed | F.col("value").rlike(SPACED_LINE)).select(
        F.trim(part(1)).alias("form_type"),
        F.trim(part(2)).alias("company"),
        part(3).cast("long").cast("string").alias("cik"),
        F.try_to_date(F.replace(part(4), F.lit("-"), F.lit("")), "yyyyMMdd").alias("filing_date"),
        part(5).alias("file_name"),
    )
    return entries.withColumn(
        "accession", F.regexp_extract("file_name", r"([^/]+?)(?:\.txt)?$", 1)
    )


def unparsed_lines(lines: DataFrame) -> DataFrame:
    """Lines that are no entry in either layout, to be kept and looked at."""
    fits = F.col("value").rlike(INDEX_LINE) | F.col("value").rlike(SPACED_LINE)
    return lines.filter(~F.coalesce(fits, F.lit(False)))


def filings_since(index: DataFrame, last_quarter_end, form_type: str = "4") -> DataFrame:
    """Entries of one form filed after the last published quarter."""
    return index.filter(
        (F.col("form_type") == form_type) & (F.col("filing_date") > F.lit(last_quarter_end))
    )
