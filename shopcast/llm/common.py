"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopcast.session import materialize, scratch_dir

__all__ = ["materialize", "written", "read", "text_slices", "text_pieces", "ascii_words", "row_key", "id_key", "free_name", "keep_rows"]

#: Runs of anything but ASCII white space, as the Spark side splits words.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written as a table in the shared folder and read again."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that a task holds few texts as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Characters of a text that are turned into Python or numpy objects at a time.
PIECE = 1 << 20
_SPACE = re.compile(r"[ \t\n\x0b\x0c\r]")


def text_pieces(text: str | None, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut before ASCII white space, so that no word is cut."""
    at = 0
    while text and len(text) - at > size and (m := _SPACE.search(text, at + size)):
        yield text[at:m.start()]
        at = m.start()
    if text:
        yield text[at:]


def ascii_words(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lower-cased; ``bytes`` methods know ASCII letters and ASCII white space only."""
    return text.encode().lower().split() if text else []


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_key(df: DataFrame) -> Column:
    """64-bit hash of a whole row. Used together with the row's id: rows that agree in both are repeats of one row."""
    flat = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t or "variant" in t else F.col(f"`{c}`") for c, t in df.dtypes]
    return F.xxhash64(*flat)


def id_key(doc_id: Column) -> dict[str, Column]:
    """A nullable id as two columns without null, so that plain equality joins it."""
    return {"id": F.coalesce(doc_id, F.lit(0)), "no_id": doc_id.isNull()}


def keep_rows(df: DataFrame, kept: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows of ``df`` whose ``keys`` (without nulls) are in ``kept``, repeats of a key once, columns of ``df`` only.

    The join and the removal of repeats need the same partitioning, so the wide
    rows are shuffled once. ``kept`` has the keys' names as columns, each key once.
    """
    names = {k: free_name(df, f"__{k}") for k in keys}
    right = kept.select(*[F.col(k).alias(names[k]) for k in keys])
    return df.withColumns({names[k]: c for k, c in keys.items()}).join(right, list(names.values()), "left_semi").dropDuplicates(list(names.values())).drop(*names.values())
