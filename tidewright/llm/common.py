"""Pieces that the corpus operators share: text rules, Arrow batches, joins with hot keys. Intermediates are written in the shared folder."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import new_path, remove, shared_dir, written

__all__ = ["new_path", "remove", "shared_dir", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: White space as the contracts define it, for trimming and as a regular-expression class.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: What separates the words of the alphanumeric rule (bytes beyond ASCII belong to words).
NON_WORD_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def ascii_lower_py(text: str) -> str:
    return text.translate(_LOWER)


_LOWER = str.maketrans(UPPER, LOWER)


def alnum_words(text: Column) -> Column:
    """The words of the alphanumeric rule, lower-cased; an empty array where there are none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD_CLASS + "+"), lambda w: w != "")


def crc_fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; rows of fold 0 are held out of training. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def nullable(df: DataFrame, names: list[str], more: str) -> T.StructType:
    """The schema of df's columns `names`, all nullable, and the columns that the text `more` describes."""
    kept = [T.StructField(f.name, f.dataType, True) for f in df.select(*names).schema.fields]
    return T.StructType(kept + T._parse_datatype_string(more).fields)


def arrow_batch(kept: pa.RecordBatch | None, n: int, types: list[pa.DataType], /, **columns) -> pa.RecordBatch:
    """A batch of kept's columns and then the given ones; without values a column is null. Ids stay as they are: pandas would turn those beside nulls into floats."""
    arrays = list(kept.columns) if kept is not None else []
    names = list(kept.schema.names) if kept is not None else []
    for (name, values), kind in zip(columns.items(), types, strict=True):
        arrays.append(pa.nulls(n, kind) if values is None else pa.array(values, kind))
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that an operator is about to add, and those with a leading underscore, which operators keep for themselves."""
    taken = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken and not c.startswith("_")])


def heat_join(left: DataFrame, right: DataFrame, keys: list[str], heat: str, most_hot: int = 2000) -> DataFrame:
    """Inner join with a right table that holds each key once, beside the number of left's rows that have it (`heat`).

    A key with more than one in most_hot of the rows to be joined would be one task's. There are fewer than most_hot such
    keys whatever the tables' sizes, so they are broadcast and their rows stay where they are; the others are joined by
    shuffle. Both tables are read twice, so they should be written ones.
    """
    total = right.agg(F.sum(heat)).first()[0] or 0
    is_hot = F.col(heat).cast("double") * most_hot > F.lit(float(total))
    hot, cold = (F.broadcast(right.where(is_hot)).drop(heat), right.where(~is_hot).drop(heat))
    return left.join(hot, keys).unionByName(left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))
