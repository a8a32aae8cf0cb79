"""Extra columns under names of their own while operators work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def shielded(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but the used ones renamed by place, and what gives a result with these columns its names back.

    So no extra column can clash with what operators add, whatever it is called.
    """
    names = docs.columns
    inner = [n if n in used else f"other_{i}" for i, n in enumerate(names)]
    return docs.toDF(*inner), lambda out: out.select(*inner).toDF(*names)
