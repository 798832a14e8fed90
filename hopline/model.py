"""The separation model as a function of windows: one row in, a row for each stem out (UD1)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.schemas import schema

Separator = Callable[[np.ndarray], dict[str, np.ndarray]]
OUT = "stem string, pcm array<smallint>"


def mid_side(pcm: np.ndarray) -> dict[str, np.ndarray]:
    """A stand-in for the network: the middle as vocals, each side less the middle as instrumental. The two add up to the input."""
    x = pcm.reshape(-1, 2).astype(np.int32)
    middle = (x.sum(1) // 2)[:, None].repeat(2, 1)
    return {"vocals": middle.astype(np.int16).ravel(), "instrumental": np.clip(x - middle, -32768, 32767).astype(np.int16).ravel()}


def separated(windows: DataFrame, keys: list[str], load: Callable[[], Separator]) -> DataFrame:
    """keys, stem, pcm for each stem of each window. ``load`` runs once for each task; filter to cache misses beforehand."""
    types = dict(windows.dtypes)

    def run(batches):
        model = load()
        for pdf in batches:
            rows = [(*[r[k] for k in keys], stem, pcm) for r in pdf.to_dict("records") for stem, pcm in model(np.asarray(r["pcm"], np.int16)).items()]
            yield pd.DataFrame(rows, columns=[*keys, "stem", "pcm"])

    return windows.select(*keys, "pcm").mapInPandas(run, schema(", ".join([*(f"{k} {types[k]}" for k in keys), OUT])))


def table_function(load: Callable[[], Separator], keys: str):
    """The model as a function of tables in SQL: ``stems(TABLE(windows) PARTITION BY stream ORDER BY sequence)``.

    ``keys`` is the DDL of the columns that name a window, of which the rows carry all; ``pcm`` holds its samples. After a
    partition's stems comes a row for each stem without keys or pcm: the windows it had and its peak, held as state meanwhile.
    """
    names = schema(keys).fieldNames()

    class Stems:
        def __init__(self):
            self.model = load()
            self.seen: dict[str, tuple[int, int]] = {}

        def eval(self, row):
            for stem, pcm in self.model(np.asarray(row["pcm"], np.int16)).items():
                windows, peak = self.seen.get(stem, (0, 0))
                self.seen[stem] = windows + 1, max(peak, int(np.abs(pcm.astype(np.int32)).max(initial=0)))
                yield (*[row[k] for k in names], stem, pcm.tolist(), None, None)

        def terminate(self):
            for stem, (windows, peak) in self.seen.items():
                yield (*[None] * len(names), stem, None, windows, peak)

    return F.udtf(Stems, returnType=schema(f"{keys}, {OUT}, windows long, peak int"), useArrow=True)
