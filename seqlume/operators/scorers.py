"""Scoring of sequence windows with models that the caller brings.

Weights of published networks are no part of this package. A loader is a function without arguments that returns a
function from a list of sequences to an array (sequences x outputs); it is called once for each task. base_shares is
a stand-in for trying things out; it is no prediction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Loader = Callable[[], Callable[[list[str]], np.ndarray]]
#: A, C, G, T as 0 to 3; anything else has no channel.
_CHANNEL = np.full(256, 4, np.int64)
_CHANNEL[[65, 67, 71, 84, 97, 99, 103, 116]] = [0, 1, 2, 3] * 2


def one_hot(sequences: list[str], channels: str = "ACGT", unknown: float = 0.0) -> np.ndarray:
    """float32 array (sequences, length, 4) of sequences of one length, channels in the order of these letters;
    `unknown` in all channels for other letters."""
    codes = np.stack([_CHANNEL[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)] for s in sequences])
    table = np.concatenate([np.eye(4, dtype=np.float32), np.full((1, 4), unknown, np.float32)])
    return table[:, ["ACGT".index(c) for c in channels]][codes]


def base_shares() -> Callable[[list[str]], np.ndarray]:
    return lambda sequences: one_hot(sequences).mean(axis=1)


def ensemble(windows: DataFrame, loaders: list[Loader], outputs: list[str], seq: str = "seq", batch: int = 128) -> DataFrame:
    """Adds <output>_mean and <output>_sd (population) over the models; sequences of a batch have one length."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = [load() for load in loaders]
        for frame in frames:
            mean, sd = (np.full((len(frame), len(outputs)), np.nan) for _ in range(2))
            for size, part in frame.reset_index(drop=True).groupby(frame[seq].str.len().to_numpy()):
                for k in range(0, len(part), batch):
                    rows = part.index[k : k + batch]
                    scores = np.stack([m(part[seq].iloc[k : k + batch].tolist()) for m in models])
                    mean[rows], sd[rows] = scores.mean(axis=0), scores.std(axis=0)
            extra = {f"{o}_{n}": a[:, i] for i, o in enumerate(outputs) for n, a in (("mean", mean), ("sd", sd))}
            yield frame.reset_index(drop=True).assign(**extra)

    columns = ", ".join(f"`{c}` {t}" for c, t in windows.dtypes)
    return windows.mapInPandas(run, columns + "".join(f", `{o}_{n}` double" for o in outputs for n in ("mean", "sd")))
