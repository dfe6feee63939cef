"""Fetching in pages, against services made up here: nothing is lost, nothing comes twice, and ceilings are errors."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.sources import paging

ROWS = [{"id": k, "at": k * k % 97, "block": k // 4} for k in range(120)]
KEY = lambda r: r["id"]
within = lambda a, b, cap=10**9: [r for r in ROWS if a <= r["at"] <= b][:cap]
ids = lambda rows: sorted(map(KEY, rows))
ALL = list(range(120))


def test_offsets_and_cursors():
    assert ids(paging.by_offset(lambda at, n: ROWS[at : at + n], 50, 1000)) == ALL
    with pytest.raises(OverflowError):
        list(paging.by_offset(lambda at, n: ROWS[at : at + n], 50, 100))
    cursor = lambda c: (ROWS[int(c or 0) : int(c or 0) + 50], str(int(c or 0) + 50) if int(c or 0) < 100 else "LTE=")
    assert ids(paging.by_cursor(cursor)) == ALL


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 40))
def test_bisection_partitions_the_range(ceiling):
    out = paging.bisected(0, 96, lambda a, b: len(within(a, b)), ceiling)
    assert [out[0][0], out[-1][1]] == [0, 96] and all(a[1] + 1 == b[0] for a, b in zip(out, out[1:]))
    assert all(n == len(within(a, b)) and (n <= ceiling or a == b) for a, b, n in out)


def test_halving_and_windows_lose_nothing():
    assert ids(paging.fetched_by_halves(0, 96, lambda a, b: within(a, b, 20), 20, KEY)) == ALL
    with pytest.raises(OverflowError):
        paging.fetched_by_halves(0, 96, lambda a, b: within(a, b, 2), 2, KEY)
    assert ids(paging.adaptive(0, 96, lambda a, b: within(a, b, 30), 30, window=50, target=25)) == ALL
    assert ids(paging.by_moving_start(lambda s: [r for r in ROWS if r["block"] >= s][:10], 0, 10, lambda r: r["block"], KEY)) == ALL
    with pytest.raises(OverflowError):
        paging.by_moving_start(lambda s: [r for r in ROWS if r["block"] >= s][:4], 0, 4, lambda r: r["block"], KEY)


def test_batches_fall_back_to_single_ids():
    odd = lambda some: [ROWS[i] for i in some if i % 2]
    got = paging.in_batches([*ALL, 500], odd, lambda i: ROWS[i] if i < 120 else None, KEY, 7)
    assert sorted(got) == ALL


def test_remote_queries_wait_and_page():
    states = iter(["queued", "running", "done"])
    page = lambda ticket, at: (ROWS[at : at + 50], at + 50 if at + 50 < 120 else None)
    assert ids(paging.finished(lambda: "t", lambda t: next(states), page)) == ALL
    with pytest.raises(RuntimeError):
        list(paging.finished(lambda: "t", lambda t: "failed", page))
    with pytest.raises(TimeoutError):
        list(paging.finished(lambda: "t", lambda t: "running", page, tries=3))


def test_windows_split_on_timeout_and_are_replayed():
    asked, cache = [], {}

    def ask(a, b):
        asked.append((a, b))
        if b - a > 13:
            raise TimeoutError
        return [r for r in ROWS if a <= r["at"] < b]

    assert ids(paging.split_on_timeout(0, 97, ask, cache, 12)) == ALL
    first = len([x for x in asked if x[1] - x[0] <= 13])
    assert ids(paging.split_on_timeout(0, 97, ask, cache, 12)) == ALL
    assert len([x for x in asked if x[1] - x[0] <= 13]) == first
    with pytest.raises(TimeoutError):
        list(paging.split_on_timeout(0, 97, ask, {}, 50))
