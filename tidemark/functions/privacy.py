"""Salted id hashes and leak checks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.scale import cut

# fixed values: output format of a hashed id and the columns whose numbers may equal an id
HASH_HEX = 16
HASH_PATTERN = "^[0-9a-f]{16}$"
NON_ID_COLUMNS = ("repo_id", "n", "number")

FILTER_BITS = 24  # the filter of forbidden values has 2 ** FILTER_BITS bits (2 MB)


def hash_id(column: Column, salt: bytes, lower: bool = False) -> Column:
    """HMAC-SHA256 of the value's text under `salt`, first 16 hex characters, all inside the JVM."""
    key = hashlib.sha256(salt).digest() if len(salt) > 64 else salt
    key = key.ljust(64, b"\0")
    inner_pad = F.lit(bytearray(b ^ 0x36 for b in key))
    outer_pad = F.lit(bytearray(b ^ 0x5C for b in key))
    text = column.cast("string")
    message = F.encode(F.lower(text) if lower else text, "UTF-8")
    inner = F.unhex(F.sha2(F.concat(inner_pad, message), 256))
    return F.substring(F.sha2(F.concat(outer_pad, inner), 256), 1, HASH_HEX)


def hash_column(df: DataFrame, column: str, salt: bytes, out: str = "user") -> DataFrame:
    """Replace a raw id column by its salted hash."""
    return df.withColumn(out, hash_id(F.col(column), salt)).drop(column)


def _lower_text(column: Column) -> Column:
    return F.lower(column.cast("string"))


def _slot(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(1 << FILTER_BITS))


def value_filter(values: DataFrame) -> DataFrame:
    """One row (words, shortest, longest): a filter of the texts in `value`, of fixed size whatever their number.

    A text whose bit is not set in `words` (64 bits each) is certainly not among the values.
    """
    slots = values.groupBy(F.floor(_slot(F.col("value")) / 64).alias("at")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(value), {1 << FILTER_BITS}) % 64 as int))")).alias("bits"),
        F.min(F.length("value")).alias("shortest"),
        F.max(F.length("value")).alias("longest"),
    )
    found = slots.toPandas()  # at most 2 ** FILTER_BITS / 64 rows
    words = np.zeros((1 << FILTER_BITS) // 64, np.int64)
    words[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    lengths = (int(found["shortest"].min()), int(found["longest"].max())) if len(found) else (1, 0)
    schema = "words array<bigint>, shortest int, longest int"
    # plain ints: without Arrow, Spark takes no numpy numbers
    return values.sparkSession.createDataFrame([(words.tolist(), *lengths)], schema)


def audit(
    df: DataFrame, forbidden: DataFrame, hashed: str | None = None, skip: Iterable[str] = (), text_only: bool = False
) -> DataFrame:
    """(column, problem): columns of `df` that hold a value of `forbidden` (column `value`) in any case
    (`leak`), and `hashed` if one of its values is not a salted hash (`not hashed`).

    One pass over `df`. Cells are tested against a filter of the forbidden values where they are read;
    only the cells that pass it, the leaks and a few others, are moved to be compared.
    """
    skip = set(skip)
    names = [
        f.name
        for f in df.schema.fields
        if f.name not in skip and (not text_only or isinstance(f.dataType, T.StringType))
    ]
    bad = cut(forbidden.select(_lower_text(F.col("value")).alias("value")).filter("value is not null").distinct(), "forbidden")
    quoted = ["`" + n.replace("`", "``") + "`" for n in names]
    cells = [F.struct(F.lit(n).alias("column"), _lower_text(F.col(q)).alias("value"), F.lit(False).alias("wrong")) for n, q in zip(names, quoted, strict=True)]
    if hashed is not None:
        wrong = ~F.coalesce(F.col(hashed).cast("string").rlike(HASH_PATTERN), F.lit(False))
        cells.append(F.struct(F.lit(hashed).alias("column"), F.lit(None).cast("string").alias("value"), wrong.alias("wrong")))
    if not cells:
        return df.sparkSession.createDataFrame([], "column string, problem string")
    each = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    slot = _slot(F.col("value"))
    hit = F.expr("shiftrightunsigned(get(words, cast(floor(slot / 64) as int)), cast(slot % 64 as int)) & 1 = 1")
    each = each.withColumn("slot", slot)
    passes = F.col("wrong") | (F.length("value").between(F.col("shortest"), F.col("longest")) & hit)
    # the filter is one row of fixed size; a semi join only tests against it
    suspects = each.join(F.broadcast(value_filter(bad)), passes, "left_semi").select("column", "value", "wrong").distinct()
    leaks = suspects.filter("value is not null").join(bad, "value", "left_semi").select("column", F.lit("leak").alias("problem"))
    return leaks.unionByName(suspects.filter("wrong").select("column", F.lit("not hashed").alias("problem"))).distinct()


def find_leaks(
    df: DataFrame, forbidden: DataFrame, skip: Iterable[str] = (), text_only: bool = False
) -> DataFrame:
    """(column): columns of `df` that hold a value of `forbidden` (column `value`), any case; see `audit`."""
    return audit(df, forbidden, None, skip, text_only).select("column")


def hash_violations(df: DataFrame, column: str) -> DataFrame:
    """One row: how many values of `column` are not salted hashes."""
    ok = F.coalesce(F.col(column).cast("string").rlike(HASH_PATTERN), F.lit(False))
    return df.agg(F.count_if(~ok).alias("bad"), F.count(F.lit(1)).alias("total"))


def assert_hashed(df: DataFrame, column: str) -> None:
    bad = hash_violations(df, column).first()["bad"]
    if bad:
        raise ValueError(f"{bad} values of {column!r} are not salted hashes")


def anonymise(df: DataFrame, salt: bytes, column: str = "actor_id") -> DataFrame:
    """Hash `column` into `user`; raises if a raw id is left in any other column. Reads `df` twice: for the raw
    ids and for all checks together."""
    out = hash_column(df, column, salt)
    raw = df.select(F.col(column).cast("string").alias("value")).distinct()
    found = audit(out, raw, "user", NON_ID_COLUMNS).collect()  # at most two rows a column
    if any(r["problem"] == "not hashed" for r in found):
        raise ValueError("values of 'user' are not salted hashes")
    leaks = sorted(r["column"] for r in found)
    if leaks:
        raise RuntimeError(f"raw ids found in columns {leaks}")
    return out
