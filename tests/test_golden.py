"""Golden quota / weight arithmetic of the reference reports and property tests."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.operators.sampling import approximate_mode, class_weights, split_quotas


def test_reference_split_sizes_and_frauds():
    q = split_quotas({0: 199742, 1: 258})
    assert q[1] == (181, 38, 39)
    sizes = [q[0][i] + q[1][i] for i in range(3)]
    assert sizes == [139999, 30000, 30001]


def test_reference_class_weights_and_smote_size():
    w = class_weights({0: 139818, 1: 181})
    assert w[0] == 139999 / (2 * 139818) and abs(w[0] - 0.5006472700224578) < 1e-15
    assert abs(w[1] - 386.73756906077347) < 1e-9
    assert int(0.1 * 139818 - 181) == 13800
    assert int(139818 / 181) == 772
    assert round(181 / 139999 * 100, 6) == 0.129287


def test_fixture_sf0001_split():
    q = split_quotas({0: 983, 1: 17})
    assert [q[0][i] + q[1][i] for i in range(3)] == [699, 150, 151]
    assert q[1] == (12, 2, 3)


@given(st.dictionaries(st.integers(0, 4), st.integers(1, 10_000), min_size=1, max_size=5),
       st.floats(0.0, 1.0))
@settings(max_examples=200, deadline=None)
def test_approximate_mode_properties(counts, frac):
    n = int(sum(counts.values()) * frac)
    q = approximate_mode(counts, n)
    assert sum(q.values()) == n
    total = sum(counts.values())
    for c, v in q.items():
        assert abs(v - counts[c] * n / total) < 1.0 + 1e-9
        assert 0 <= v <= counts[c] or math.isclose(v, counts[c])
