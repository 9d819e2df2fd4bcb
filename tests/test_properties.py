"""Property tests of the quota rule (pure Python, no Spark)."""

from hypothesis import given
from hypothesis import strategies as st

from papersift.operators.sampling import quota, stratum_quotas


@given(st.integers(0, 10_000), st.integers(0, 10_000), st.integers(0, 10_000),
       st.floats(0.0001, 1.0, allow_nan=False))
def test_quota_rule(n_high, n_boundary, n_low, rate):
    n = n_high + n_boundary + n_low
    q = stratum_quotas({"n": n, "high": n_high, "boundary": n_boundary, "low": n_low}, rate)
    if n == 0:
        assert q["high"] == q["boundary"] == q["low"] == 0
        return
    target = quota(n, rate)
    assert target == max(1, int(n * rate))
    assert 0 <= q["high"] <= n_high and 0 <= q["boundary"] <= n_boundary and 0 <= q["low"] <= n_low
    assert q["high"] + q["boundary"] + q["low"] == min(target, n)
    # strata fill in order: a lower stratum is used only when the higher ones are exhausted
    if q["boundary"] > 0:
        assert q["high"] == n_high
    if q["low"] > 0:
        assert q["high"] == n_high and q["boundary"] == n_boundary
