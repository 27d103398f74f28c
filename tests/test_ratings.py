"""Runs of completions against the fold they stand for, however rows fall into batches."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest

from courierflow.operators import ratings


@pytest.mark.parametrize("seed", range(30))
def test_runs_do_not_depend_on_batches(seed):
    rnd = random.Random(seed)
    n = rnd.randint(1, 60)
    df = pd.DataFrame(
        {
            "rider_id": sorted(rnd.choice([1, 1, 1, 2, 3, 4]) for _ in range(n)),
            "ts": pd.to_datetime(np.arange(n), unit="s"),
            "id": np.arange(n),
            "was_on_time": [int(rnd.random() < 0.6) for _ in range(n)],
        }
    )
    cuts = sorted(rnd.randint(0, n) for _ in range(rnd.randint(0, 5)))
    batches = [df.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, n])]
    runs = pd.concat(list(ratings._runs(iter(batches))))
    assert list(runs["rider_id"]) == sorted(set(df["rider_id"]))
    for run in runs.itertuples():
        mine = df[df["rider_id"] == run.rider_id]
        first = mine.iloc[0]
        assert (run.first_id, run.first_ts, run.first_on_time) == (first["id"], first["ts"], first["was_on_time"])
        state = np.arange(ratings.HIGHEST + 1)
        for on_time in mine["was_on_time"].iloc[1:]:
            state = ratings.MOVES[on_time][state]
        assert list(run.later) == list(state)
