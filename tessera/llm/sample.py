"""Bounded, reproducible samples of labelled rows for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_RANGE = 1 << 30


def remainder(doc_id: str, m: int) -> Column:
    """crc32 of the id as text, modulo m; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(m))


def stratified(rows: DataFrame, label: str, key: str, per_label: int, seed: str) -> DataFrame:
    """About ``per_label`` rows of each label, chosen by a hash of the key; all of a label that has fewer.

    The counts by label are the only thing gathered; rows are chosen where they lie, so no label makes a large task.
    Labels are assumed to be few (languages, grades). Rows with a null label or key are never chosen.
    """
    rows = rows.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return rows
    share = F.create_map(*[F.lit(x) for v, n in counts.items() for x in (v, min(_RANGE, _RANGE * per_label // n))])
    return rows.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(_RANGE)) < share[F.col(label)])
