r"""Fill-in-middle transformation by DuckDB inside mapInArrow: each Arrow batch is a table of one SQL statement.

A text is cut into tokens (`[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+`, left to right over code points), two
places are drawn from a hash of the id, and prefix, suffix and middle are put in the order of the form: plain, the text as it is;
psm, `<P>`prefix`<S>`suffix`<M>`middle; spm, `<S>`suffix`<P>`prefix`<M>`middle. SQL does all of it (regexp_extract_all,
list_slice, array_to_string, sha256) over whole batches; no Python runs for a row. Each batch also takes its outputs apart again by form
and sentinels, and the digest of what that gives is returned beside the output's.

Memory is bounded by the batch (common.BATCH_ROWS and BATCH_BYTES, one long text at least); DuckDB runs on one thread, in memory, without a
folder of its own. A task that is run again gives the same rows.

Defined cases: a null or empty text is plain and its output empty; a text that holds a sentinel is plain; a null id draws as an empty
string does; repeated rows are each transformed, alike; other columns pass unchanged whatever their names; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from skysieve.llm.common import table

SEED, RATE, SPM = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Columns that a row gets.
FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def statement(seed: int = SEED, rate: int = RATE, spm: int = SPM) -> str:
    """SQL over the table `batch` (i, id, text): one row of FIELDS a row, in order of i. `rate` is the share in per cent
    that is transformed, `spm` the share of those in the form spm."""
    return f"""
WITH tokens AS (
  SELECT i, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS w, sha256('{seed}:' || coalesce(id, '')) AS h FROM batch),
drawn AS (
  SELECT i, text, w, len(w) AS n, [CAST('0x' || substr(h, 8 * k + 1, 8) AS UBIGINT) FOR k IN [0, 1, 2, 3]] AS h FROM tokens),
cuts AS (
  SELECT i, text, w, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h[3] % 100 >= {rate} THEN 'plain'
              WHEN h[4] % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT i, text, n, form,
         CASE WHEN form <> 'plain' THEN coalesce(array_to_string(list_slice(w, 1, a), ''), '') END AS p,
         CASE WHEN form <> 'plain' THEN coalesce(array_to_string(list_slice(w, a + 1, b), ''), '') END AS m,
         CASE WHEN form <> 'plain' THEN coalesce(array_to_string(list_slice(w, b + 1, n), ''), '') END AS s FROM cuts),
made AS (
  SELECT i, n, form, length(p) AS prefix_chars, length(m) AS middle_chars,
         CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
                   ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END AS output FROM parts),
apart AS (
  SELECT *, CASE form WHEN 'psm' THEN string_split(output, '{SUFFIX}') WHEN 'spm' THEN string_split(output, '{PREFIX}') END AS halves FROM made),
back AS (
  SELECT *, substr(halves[1], {len(PREFIX) + 1}) AS head, string_split(halves[2], '{MIDDLE}') AS tail FROM apart)
SELECT CAST(n AS BIGINT) AS n, form, CAST(prefix_chars AS BIGINT) AS prefix_chars, CAST(middle_chars AS BIGINT) AS middle_chars, output,
       sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN head || tail[2] || tail[1] ELSE tail[1] || tail[2] || head END) AS restored_sha256
FROM back ORDER BY i
"""


def infilled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM, output: bool = True) -> DataFrame:
    """Columns `row` (all of docs) and `fim`, a struct of FIELDS; without `output` the new texts stay in the tasks."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sql, schema = statement(seed, rate, spm), StructType([rows.schema["row"], StructField("fim", DataType.fromDDL(FIELDS))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as con:
            for batch in batches:
                if not batch.num_rows:
                    continue
                con.register("batch", pa.table({"i": pa.array(range(batch.num_rows), pa.int64()), "id": batch.column(1), "text": batch.column(2)}))
                made = con.sql(sql).to_arrow_table()
                con.unregister("batch")
                columns = {c: made.column(c).combine_chunks() for c in made.column_names}
                if not output:
                    columns["output"] = pa.nulls(batch.num_rows, pa.string())
                fields = [columns[x.split(" ")[0]].cast(pa.string() if x.endswith("string") else pa.int64()) for x in FIELDS.split(", ")]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.StructArray.from_arrays(fields, [x.split(" ")[0] for x in FIELDS.split(", ")])], ["row", "fim"])

    return rows.mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """`docs`, all columns, with `text_col` in its new form; a null text stays null."""
    done = infilled(docs, id_col, text_col, seed, rate, spm)
    text = F.when(F.col(f"row.`{text_col}`").isNotNull(), F.col("fim.output"))
    return done.select(*[(text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def restored(texts: DataFrame, text_col: str = "text", form_col: str = "form") -> DataFrame:
    """`texts` with `text_col` put back from its form; a plain text stays."""
    t, form = F.col(f"`{text_col}`"), F.col(f"`{form_col}`")
    halves = F.split(t, F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX)), 2)
    head, tail = F.substring(halves[0], len(PREFIX) + 1, 1 << 30), F.split(F.get(halves, 1), MIDDLE, 2)
    text = F.when(form == "psm", F.concat(head, F.get(tail, 1), F.get(tail, 0))).when(form == "spm", F.concat(F.get(tail, 0), F.get(tail, 1), head)).otherwise(t)
    return texts.select(*[(text if c == text_col else F.col(f"`{c}`")).alias(c) for c in texts.columns])


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = infilled(table(spark, sf_dir, "documents", "doc_id", "text"), output=False)
    return done.select("row.doc_id", *[f"fim.{x.split(' ')[0]}" for x in FIELDS.split(", ") if not x.startswith("output ")])


#: By character counts and substrings of the text; what is restored is the text.
ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('{SEED}:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
u AS (SELECT doc_id, x, list_transform(regexp_extract_all(x, '{TOKEN}'), lambda w: length(w)) AS l,
             CAST(concat('0x', h[1:8]) AS BIGINT) AS h1, CAST(concat('0x', h[9:16]) AS BIGINT) AS h2, CAST(concat('0x', h[17:24]) AS BIGINT) AS h3, CAST(concat('0x', h[25:32]) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, len(l) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b FROM u),
f AS (SELECT doc_id, x, n, CASE WHEN x = '' OR regexp_matches(x, '<[PSM]>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form,
             CAST(coalesce(list_sum(l[1:a]), 0) AS BIGINT) AS p, CAST(coalesce(list_sum(l[1:b]), 0) AS BIGINT) AS q FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN concat('<P>', left(x, p), '<S>', substr(x, q + 1), '<M>', substr(x, p + 1, q - p))
                        ELSE concat('<S>', substr(x, q + 1), '<P>', left(x, p), '<M>', substr(x, p + 1, q - p)) END) AS output_sha256,
       sha256(x) AS restored_sha256 FROM f
"""
