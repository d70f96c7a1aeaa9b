"""Fill-in-middle: texts cut at lines into prefix, middle and suffix and put into another order, by DuckDB over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: A batch goes to DuckDB in parts of at most so many bytes of text (a longer text is a part of its own).
PART_BYTES = 16 << 20
#: A unit is a line with its end, or what follows the last line's end.
UNIT = r"[^\n]*\n|[^\n]+"

SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


def checked_marks(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """The marks, if a text without any of them can always be read back from what is built of it and them.

    All must begin with the same character, which none has again, and none may be the beginning of another; then no mark can arise
    where a text and a mark meet.
    """
    first = {m[:1] for m in marks}
    if len(set(marks)) != 3 or len(first) != 1 or "" in first or any(m.count(m[0]) != 1 for m in marks) or any(a != b and b.startswith(a) for a in marks for b in marks):
        raise ValueError("marks must be three, begin with one character that they hold once, and none may begin another")
    return marks


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def transform_sql(marks: tuple[str, str, str] = MARKS, salt: str = "7", rate: int = 100, spm: int = 50) -> str:
    """DuckDB SQL over the view batch (id, text): the id as _id and the columns of SCHEMA."""
    p, s, m = map(_quoted, marks)
    part = lambda k: f"('0x' || substr(hex, {8 * k + 1}, 8))::UBIGINT"
    joined = lambda first, last: f"array_to_string(list_slice(units, {first}, {last}), '')"
    return f"""
WITH cut AS (
  SELECT id, text, regexp_extract_all(text, {_quoted(UNIT)}) AS units, sha256({_quoted(salt + ":")} || coalesce(id::VARCHAR, '')) AS hex FROM batch
), drawn AS (
  SELECT *, {part(0)} % (len(units) + 1)::UBIGINT AS a, {part(1)} % (len(units) + 1)::UBIGINT AS b,
         CASE WHEN text = '' OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR {part(2)} % 100 >= {rate:d} THEN 'plain'
              WHEN {part(3)} % 100 < {spm:d} THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT id, text, form, len(units) AS n, {joined("1", "least(a, b)::BIGINT")} AS prefix,
         {joined("least(a, b)::BIGINT + 1", "greatest(a, b)::BIGINT")} AS middle, {joined("greatest(a, b)::BIGINT + 1", "len(units)")} AS suffix
  FROM drawn
)
SELECT id AS _id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       CASE form WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle WHEN 'spm' THEN {s} || suffix || {p} || prefix || {m} || middle ELSE text END AS output
FROM parts
"""


def parts_of(batch: pa.RecordBatch, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `most` bytes of its second column, one row at least."""
    offsets = pc.cumulative_sum(pc.binary_length(batch.column(1)).cast(pa.int64())).to_numpy(zero_copy_only=False)
    start = 0
    while start < batch.num_rows:
        before = int(offsets[start - 1]) if start else 0
        end = max(start + 1, int(offsets.searchsorted(before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marks: tuple[str, str, str] = MARKS, salt: str = "7", rate: int = 100, spm: int = 50
) -> DataFrame:
    """One row per row of docs: id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output (the new text).

    A text is cut into lines. Two cuts, drawn from the id by SHA-256, part it into prefix, middle and suffix; any of them may be
    empty. Of 100 texts, `rate` are changed, and of 100 of these `spm` have the suffix first. Plain are the others, empty texts, and
    texts that hold a mark, so that `restored` gives every text back.

    Each Arrow batch is registered with a DuckDB connection that its task keeps, in slices of at most PART_BYTES of text; SQL does all
    the work, no row is touched by Python, and nothing is shuffled. Null texts count as empty, and a null id as one without digits.
    Repeated rows come out as often as they went in, alike. Empty tables give none. Other columns are left out.
    """
    sql = transform_sql(checked_marks(marks), salt, rate, spm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1})
        for whole in batches:
            for batch in parts_of(whole):
                con.register("batch", pa.table({"id": batch.column(0), "text": batch.column(1)}))
                yield from con.sql(sql).to_arrow_table().cast(wanted).to_batches()
                con.unregister("batch")
        con.close()

    names = ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())
    wanted = pa.schema([("_id", pa.string()), *names])
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.mapInArrow(run, f"_id string, {SCHEMA}").withColumn("_id", F.col("_id").cast(docs.schema[id_col].dataType)).withColumnRenamed("_id", id_col)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that output was made of. Plain outputs are texts; of the others the parts between the marks are put into order."""
    p, s, m = (rf"\Q{x}\E" for x in checked_marks(marks))
    part = lambda k: F.get(F.split(output, f"{p}|{s}|{m}"), F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
