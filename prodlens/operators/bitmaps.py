"""Distinct counts that can be added up along time: bitmaps of entity numbers per cell.

A count of entities in a stored cell cannot be combined with the count of the next month,
because most entities are in both. A bitmap can: the union of two bitmaps is the set of entities in
either. Entities are numbered from 0 in the order of their attributes, so the entities of one cell
lie side by side and a cell needs hardly more bitmaps than it has multiples of 32,768 entities.
Counts are exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prodlens.operators.ranking import ordered_index

PLACE = "bitmap_bucket"


def number_entities(attrs: DataFrame, entity: str, order: Sequence[str]) -> DataFrame:
    """``(entity, number)``: numbers from 0 without gaps, in the order of the columns, then of the entity."""
    coded = ordered_index(attrs.select(F.struct(*order, entity).alias("_v")), [], "_v")
    return coded.select(F.col("_v")[entity].alias(entity), F.col("code").cast("long").alias("number"))


def entity_cells(rows: DataFrame, keys: Sequence[str], number: str, conditions: Mapping[str, Column]) -> DataFrame:
    """One row per cell and block of 32,768 entity numbers, with a bitmap of the entities that have a row
    (``present``) and one for each condition, of those with a row that meets it.

    Rows are reduced to (cell, entity) before they are shuffled, and a bitmap's block is part of
    the key: a cell with very many entities is cut into its blocks.
    """
    flags = {name: F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(f"_{name}") for name, c in conditions.items()}
    seen = rows.where(F.col(number).isNotNull()).groupBy(*keys, number).agg(F.lit(1).alias("_row"), *flags.values())
    at = F.bitmap_bit_position(F.col(number))
    dealt = seen.withColumn(PLACE, F.bitmap_bucket_number(F.col(number))).repartition(*keys, PLACE)
    return dealt.groupBy(*keys, PLACE).agg(
        F.bitmap_construct_agg(at).alias("present"),
        *[F.bitmap_construct_agg(F.when(F.col(f"_{name}") == 1, at)).alias(name) for name in conditions],
    )


def distinct_entities(cells: DataFrame, keys: Sequence[str | Column], counts: Mapping[str, str]) -> DataFrame:
    """Entities of any union of cells, ``counts`` giving bitmap column and output name."""
    names = [f"_k{i}" for i in range(len(keys))]
    shown = [F.col(k) if isinstance(k, str) else k for k in keys]
    merged = cells.select(*[k.alias(n) for k, n in zip(shown, names)], PLACE, *counts).groupBy(*names, PLACE)
    merged = merged.agg(*[F.bitmap_or_agg(F.col(c)).alias(c) for c in counts])
    out = merged.groupBy(*names).agg(*[F.sum(F.bitmap_count(F.col(c))).alias(o) for c, o in counts.items()])
    titles = cells.select(*shown).columns
    return out.select(*[F.col(n).alias(t) for n, t in zip(names, titles)], *counts.values())
