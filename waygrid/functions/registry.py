"""Named ranking methods and evidence tables, and a hook for user embedders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Scorer = Callable[..., DataFrame]


class Registry:
    """Names to factories; a factory runs on first use, so one that fails harms no other."""

    def __init__(self, what: str):
        self.what = what
        self._make: dict[str, Callable[[], object]] = {}
        self._made: dict[str, object] = {}

    def register(self, name: str, factory: Callable[[], object]) -> None:
        self._make[name] = factory
        self._made.pop(name, None)

    def names(self) -> list[str]:
        return sorted(self._make)

    def get(self, name: str):
        if name not in self._make:
            raise KeyError(f"unknown {self.what} {name!r}; known: {', '.join(self.names())}")
        if name not in self._made:
            self._made[name] = self._make[name]()
        return self._made[name]

    def available(self) -> tuple[dict[str, object], dict[str, str]]:
        """(usable entries, reasons of those that failed)."""
        good, bad = {}, {}
        for name in self.names():
            try:
                good[name] = self.get(name)
            except Exception as e:  # noqa: BLE001 - reported, the others go on
                bad[name] = f"{type(e).__name__}: {e}"
        return good, bad


SCORERS, EVIDENCE = Registry("scorer"), Registry("evidence table")


def register_scorer(name: str, factory: Callable[[], Scorer]) -> None:
    SCORERS.register(name, factory)


def score(name: str, *args, **kwargs) -> DataFrame:
    return SCORERS.get(name)(*args, **kwargs)


def register_evidence(name: str, factory: Callable[[], DataFrame]) -> None:
    EVIDENCE.register(name, factory)


def evidence(name: str) -> DataFrame:
    return EVIDENCE.get(name)


def embed_with(df: DataFrame, content: str, fn: Callable[[pd.Series], pd.Series], id_col: str = "image_id") -> DataFrame:
    """Vectors from a user's function over a column, batch by batch: (id, embedding)."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "embedding": pd.Series([list(map(float, v)) for v in fn(b[content])], dtype=object)})

    return df.select(id_col, content).mapInPandas(run, f"{id_col} {id_type}, embedding array<float>")


def _defaults() -> None:
    def cosine():
        from ..operators.retrieval import leave_one_out_topk
        return leave_one_out_topk

    def fused():
        from ..operators.retrieval import late_fusion
        return late_fusion

    register_scorer("cosine", cosine)
    register_scorer("late_fusion", fused)


_defaults()
