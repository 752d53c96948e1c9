"""Helpers for tasks that read sorted rows batch by batch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd


def starts(pdf: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """Row numbers at which a new key begins (the first row included); NULL equals NULL."""
    new = np.zeros(len(pdf), dtype=bool)
    new[:1] = True
    for c in keys:
        v, null = pdf[c].to_numpy(), pdf[c].isna().to_numpy()
        new[1:] |= (v[1:] != v[:-1]) & ~(null[1:] & null[:-1])
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches cut at group ends, with the group starts; rows must be sorted by ``keys``.

    Holds back the last group of a batch until it is complete, so memory is one
    batch and one group.
    """
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        if held:
            seam = pd.concat([held[-1].iloc[-1:], pdf.iloc[:1]])
            if len(starts(seam, keys)) == 2:
                done = pd.concat(held, ignore_index=True)
                held = []
                yield done, starts(done, keys)
        cut = starts(pdf, keys)[-1]
        if cut and held:
            done = pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)
            held = []
            yield done, starts(done, keys)
        elif cut:
            done = pdf.iloc[:cut].reset_index(drop=True)
            yield done, starts(done, keys)
        held.append(pdf.iloc[cut:])
    if held:
        done = pd.concat(held, ignore_index=True)
        yield done, starts(done, keys)
