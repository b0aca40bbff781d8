"""What the text operators share: readers, word rules, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.sources import tables

#: A word: a run of anything but ASCII white space. `bytes.split()` cuts UTF-8 at the same characters.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return tables.table(spark, folder, "documents")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, A-Z kept as they are."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """The words with A-Z lowered; `bytes.lower` leaves all other letters alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def lowered(text: Column) -> Column:
    """A-Z lowered, other letters kept, in SQL."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def per_batch(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Apply `fn` to each Arrow batch as lists by column; it returns lists by column of `schema`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def per_row(df: DataFrame, fn: Callable[..., tuple], schema: str) -> DataFrame:
    """Apply `fn` to the values of each row; it returns the values of `schema`."""
    from pyspark.sql.types import _parse_datatype_string

    names = _parse_datatype_string(schema).names

    def run(columns: dict[str, list]) -> dict[str, list]:
        rows = [fn(*values) for values in zip(*columns.values())]
        return dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}

    return per_batch(df, run, schema)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most `rows` rows, so that Python objects are made for a few rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def rewritten(docs: DataFrame, fn: Callable[[str], str | None], keep_nulls: bool = False) -> DataFrame:
    """The documents with `fn` of each text, in one pass; those it gives null for are dropped.

    Documents without a text are dropped, or stay as they are with `keep_nulls`.
    `n_chars`, where there is one, is counted anew; all other columns stay.
    """
    names = docs.columns
    at, counted = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            given = batch.column(at).to_pylist()
            texts = [None if t is None else fn(t) for t in given]
            kept = [t is not None or (keep_nulls and g is None) for t, g in zip(texts, given)]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if counted is not None:
                columns[counted] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
