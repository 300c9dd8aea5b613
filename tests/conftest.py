import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tapeline.session import local_session
    session = local_session("tests")
    yield session
    session.stop()


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    return SF


def walk_frame(n, seed=7, symbol="AAA", start="2025-01-01", freq="1h", drift=0.0, scale=1.0):
    """Seeded lognormal walk bars."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(drift, 0.006, n))) * scale
    open_ = np.r_[close[0], close[:-1]]
    return pd.DataFrame({"symbol": symbol, "interval": "1h" if freq == "1h" else "1d", "ts": pd.date_range(start, periods=n, freq=freq), "open": open_, "high": np.maximum(open_, close) * 1.002,
                         "low": np.minimum(open_, close) * 0.998, "close": close, "volume": rng.integers(100, 10000, n).astype(float)}).assign(amount=lambda f: f.close * f.volume)
