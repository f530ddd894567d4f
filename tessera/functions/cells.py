"""Columns that name, write and read cells. A cell is a sorted array of (dim, ref, level), empty for the reference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def assignments(n_dims: int) -> Column:
    """The cell of a landscape row: its non-reference dimensions with both levels."""
    parts = [F.struct(F.lit(k).alias("dim"), F.col(f"w{k}").alias("ref"), F.col(f"v{k}").alias("level")) for k in range(n_dims)]
    return F.filter(F.array(*parts), lambda x: x["ref"] != x["level"])


def canonical_id(cell: Column) -> Column:
    """``[[dim,"ref","level"],...]`` in the order of the dimensions."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    return F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(cell), lambda x: F.concat(F.lit("["), x["dim"].cast("string"), F.lit(","), quoted(x["ref"]), F.lit(","), quoted(x["level"]), F.lit("]"))), ","), F.lit("]"))


def short_id(cell: Column) -> Column:
    """``dim:ref>level`` joined by commas; ``REF`` for the reference."""
    return F.coalesce(F.nullif(F.array_join(F.transform(F.sort_array(cell), lambda x: F.concat(x["dim"].cast("string"), F.lit(":"), x["ref"], F.lit(">"), x["level"])), ","), F.lit("")), F.lit("REF"))


def notation(cell: Column) -> Column:
    """Ref, place from 1, level, joined by spaces, as in ``V39A D40C``."""
    return F.array_join(F.transform(F.sort_array(cell), lambda x: F.concat(x["ref"], (x["dim"] + 1).cast("string"), x["level"])), " ")


def diff(sequence: Column, reference: Column) -> Column:
    """The places where two strings of one length differ, as a cell."""
    same = F.assert_true(F.length(sequence) == F.length(reference), F.lit("sequences of different lengths"))
    places = F.when(same.isNull(), F.sequence(F.lit(0), F.length(reference) - 1))
    letters = F.transform(places, lambda i: F.struct(i.alias("dim"), F.substring(reference, i + 1, F.lit(1)).alias("ref"), F.substring(sequence, i + 1, F.lit(1)).alias("level")))
    return F.filter(letters, lambda x: x["ref"] != x["level"])


def overlay(reference: Column, cell: Column) -> Column:
    """The reference with the cell's levels in place."""
    levels = F.map_from_entries(F.transform(cell, lambda x: F.struct(x["dim"], x["level"])))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(reference) - 1), lambda i: F.coalesce(F.try_element_at(levels, i), F.substring(reference, i + 1, F.lit(1)))), "")


def parse_notation(spec: Column) -> Column:
    """The cell that a ``V39A D40C`` notation names; null if a token is malformed."""
    tokens = F.filter(F.split(F.trim(spec), r"\s+"), lambda t: t != "")
    good = F.forall(tokens, lambda t: t.rlike("^[A-Z][1-9][0-9]*[A-Z]$"))
    read = F.transform(tokens, lambda t: F.struct((F.substring(t, F.lit(2), F.length(t) - 2).cast("int") - 1).alias("dim"), F.substring(t, 1, 1).alias("ref"), F.substring(t, -1, 1).alias("level")))
    return F.when(good, F.sort_array(read))


#: Fixed values of the cell hash: its base, the room of a dimension and of a level, and the modulus.
HASH_BASE, DIM_ROOM, LEVEL_ROOM, MODULUS = 1_000_003, 400, 20, 2**31


def cell_hash(n_dims: int) -> Column:
    """A polynomial hash of the non-reference digits, reduced at each step so that it fits a long."""
    total: Column = F.lit(0).cast("long")
    for k in range(n_dims):
        d = F.col(f"d{k}").cast("long")
        total = F.when(d > 0, F.pmod(total * HASH_BASE + k * DIM_ROOM + d, F.lit(MODULUS))).otherwise(total)
    return total


def stable_order(seed: str, ident: Column) -> Column:
    """A pseudo-random order of ids that any engine with SHA-256 repeats."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), ident), 256)


def order_label(order: Column) -> Column:
    """The name of an order."""
    named = F.when(order == 0, "reference").when(order == 1, "single").when(order == 2, "pairwise").when(order == 3, "third-order")
    return named.otherwise(F.concat(order.cast("string"), F.lit("th-order")))
