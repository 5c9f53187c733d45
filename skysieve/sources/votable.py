"""VOTable text: rows by field name, and the service's status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysieve.functions.sky import finite
from skysieve.functions.text import sexagesimal


def read_votables(spark: SparkSession, path: str) -> DataFrame:
    """(file, xml): whole files without the default name space, so that XPath names match."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r'\sxmlns(:\w+)?="[^"]*"', "").alias("xml"))


def status(xml: Column) -> Column:
    """OK, EMPTY or ERROR. An error that says no object was found is EMPTY; any other error wins over OK."""
    errors = F.xpath(xml, F.lit("//INFO[@name='QUERY_STATUS' and @value='ERROR']/text()"))
    flagged = F.xpath_int(xml, F.lit("count(//INFO[@name='QUERY_STATUS' and @value='ERROR'])")) > 0
    said = F.lower(F.array_join(errors, " "))
    return F.when(flagged & said.rlike("no .*object.* found|no object"), "EMPTY").when(flagged, "ERROR").otherwise("OK")


def rows(tables: DataFrame, names: Sequence[str]) -> DataFrame:
    """(file, row, one text column a name): cells by the position of the field with that ID or name; absent: null.

    Positions are found once a file, below the generator: what stands beside it would parse the file again for each row.
    """
    fields = F.xpath("xml", F.lit("//TABLE[1]/FIELD/@ID | //TABLE[1]/FIELD[not(@ID)]/@name"))
    labels = F.xpath("xml", F.lit("//TABLE[1]/FIELD/@name"))
    at = F.array(*[F.greatest(F.array_position("ids", n), F.array_position("labels", n)).cast("int") for n in names])
    files = tables.select("file", "xml", fields.alias("ids"), labels.alias("labels")).select("file", "xml", at.alias("at"))
    each = files.select("file", "at", F.posexplode(F.expr("split(xml, '<TR>')")).alias("row", "tr")).where("row > 0")
    cells = F.expr(r"regexp_extract_all(tr, '<TD[^>]*?(?:/>|>([^<]*)</TD>)', 1)")
    pick = lambda k: F.when(F.col("at")[k] > 0, F.nullif(F.trim(F.try_element_at("cells", F.col("at")[k])), F.lit("")))
    return each.withColumn("cells", cells).select("file", "row", *[pick(k).alias(n) for k, n in enumerate(names)])


def positions(found: DataFrame, decimal: tuple[str, str] = ("_raj2000", "_decj2000"), sexa: tuple[str, str] = ("RA", "DEC")) -> DataFrame:
    """`found` with ra, dec: decimal columns, else sexagesimal hours and degrees; rows out of range are dropped."""
    ra = F.coalesce(F.col(decimal[0]).try_cast("double"), sexagesimal(sexa[0], True))
    dec = F.coalesce(F.col(decimal[1]).try_cast("double"), sexagesimal(sexa[1], False))
    placed = found.withColumn("ra", ra).withColumn("dec", dec)
    return placed.where(finite("ra", "dec") & F.col("ra").between(0, 360) & F.col("dec").between(-90, 90))


def write_uploads(positions: DataFrame, path: str, size: int = 20_000, key: str = "row_id") -> None:
    """One VOTable a chunk of `size` rows in order of the id, below path/chunk=<number from 1>: the id as up to 24 ASCII
    characters, ra and dec as doubles.

    Each chunk is put together by the task that writes it, from `size` rows at most; files appear when all tasks are done, and a
    task that fails or is repeated leaves none behind. Rows without a finite position aren't written.
    """
    from skysieve.sources.tables import numbered

    rows = positions.where(finite("ra", "dec")).select(F.col(key).cast("string").alias("k"), F.col("ra").cast("double").alias("ra"), F.col("dec").cast("double").alias("dec"))
    name = F.regexp_replace(F.coalesce("k", F.lit("")), r"[^\x20-\x7E]", "?").substr(1, 24)
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        name = F.replace(name, F.lit(sign), F.lit(entity))
    cells = F.concat(F.lit("<TR><TD>"), name, F.lit("</TD><TD>"), F.col("ra").cast("string"), F.lit("</TD><TD>"), F.col("dec").cast("string"), F.lit("</TD></TR>\n"))
    chunks = numbered(rows, "k", size).groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("k", "ra", "dec", cells.alias("tr")))).alias("rows"))  # `size` rows a chunk
    fields = f'<FIELD name="{key}" datatype="char" arraysize="24"/><FIELD name="ra" datatype="double" unit="deg"/><FIELD name="dec" datatype="double" unit="deg"/>'
    text = F.concat(F.lit(f'<?xml version="1.0"?>\n<VOTABLE version="1.3"><RESOURCE><TABLE>{fields}<DATA><TABLEDATA>\n'), F.array_join("rows.tr", ""), F.lit("</TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>"))
    chunks.select("chunk", text.alias("value")).write.partitionBy("chunk").text(path)
