"""Decodings against their SQL where many paths are equally good, so that the last bit of a score decides."""

import numpy as np
import pandas as pd
import pytest

from metrum.plans import catalogue
from tests.oracle import differences


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    path = tmp_path_factory.mktemp("tied")
    rng = np.random.default_rng(7)
    rows = [(u, float(v)) for u in range(80) for v in rng.integers(0, 100, rng.integers(2, 90)) / 10]
    e = pd.DataFrame(rows, columns=["user_id", "value"])
    e["event_id"] = np.arange(len(e))
    e["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(e["event_id"], unit="min").astype("timedelta64[us]")
    e.assign(ts=e["ts"].astype("datetime64[us]"), event_type="view", props="{}").to_parquet(f"{path}/events.parquet", index=False)
    return str(path)


@pytest.mark.parametrize("name", ["fixed_lag_viterbi", "stream_commit"])
def test_equal_paths_end_as_in_sql(spark, tied, name):
    assert differences(catalogue.QUERIES[name](spark, tied), catalogue.ORACLES[name], tied) == ""
