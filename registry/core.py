"""A registered query and the shared shape of its result."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

DIGITS = 6


@dataclass(frozen=True)
class Query:
    """One operator on the given tables.

    ``ints``, ``reals`` and ``texts`` are the columns of the result; reals are rounded on both
    sides. ``sql`` is a list of CTEs whose last one is called ``out``; without it only the
    rows are checked.
    """

    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    ints: Sequence[str] = ()
    reals: Sequence[str] = ()
    texts: Sequence[str] = ()

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        cols = [F.col(c).cast("long").alias(c) for c in self.ints]
        cols += [F.round(F.col(c).cast("double"), DIGITS).alias(c) for c in self.reals]
        cols += [F.col(c).cast("string").alias(c) for c in self.texts]
        return df.select(*cols)

    def oracle(self) -> str:
        cols = [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in self.ints]
        cols += [f'round(CAST("{c}" AS DOUBLE), {DIGITS}) AS "{c}"' for c in self.reals]
        cols += [f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in self.texts]
        return f"WITH {self.sql.strip().rstrip(',')} SELECT {', '.join(cols)} FROM out"


class Registry:
    def __init__(self) -> None:
        self.all: dict[str, Query] = {}

    def add(self, name, build, sql=None, ints=(), reals=(), texts=()) -> None:
        if name in self.all:
            raise ValueError(f"query registered twice: {name}")
        self.all[name] = Query(name, build, sql, tuple(ints), tuple(reals), tuple(texts))


registry = Registry()
add = registry.add


def joined(col: str, sep: str = " "):
    """An array column as text, for comparison."""
    return F.array_join(F.transform(col, lambda x: x.cast("string")), sep)
