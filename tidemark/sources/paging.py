"""The logic of fetching in pages, apart from any network: the caller gives the function that asks for a page.

Every function calls `ask` until nothing is left, and raises rather than lose rows at a ceiling that it cannot get under.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Iterator, Sequence
from typing import Any

Row = dict[str, Any]


def by_offset(ask: Callable[[int, int], Sequence[Row]], limit: int, ceiling: int) -> Iterator[Row]:
    """Pages by offset up to a hard ceiling of the service; a last full page at the ceiling means that rows are lost."""
    at = 0
    while at < ceiling:
        page = ask(at, min(limit, ceiling - at))
        yield from page
        if len(page) < limit:
            return
        at += len(page)
    raise OverflowError(f"the service gives no more than {ceiling} rows; ask for less at a time")


def by_cursor(ask: Callable[[str | None], tuple[Sequence[Row], str | None]], end: Iterable[str] = ("", "LTE=")) -> Iterator[Row]:
    """Pages by cursor until it is one of the end marks or does not move."""
    cursor, ends = None, {None, *end}
    while True:
        page, following = ask(cursor)
        yield from page
        if following in ends or following == cursor:
            return
        cursor = following


def bisected(low: int, high: int, size: Callable[[int, int], int], ceiling: int) -> list[tuple[int, int, int]]:
    """(low, high, size): closed ranges in order that are under the ceiling, by halving those that are not.

    A single value over the ceiling cannot be halved and is given as it is.
    """
    out, open_ = [], [(low, high)]
    while open_:
        a, b = open_.pop()
        n = size(a, b)
        if n <= ceiling or a >= b:
            out.append((a, b, n))
        else:
            middle = (a + b) // 2
            open_ += [(middle + 1, b), (a, middle)]
    return out


def fetched_by_halves(low: int, high: int, ask: Callable[[int, int], Sequence[Row]], ceiling: int, key: Callable[[Row], Hashable]) -> list[Row]:
    """Rows of a closed range of dates or blocks where a full page means that some are missing: halve until none is full.

    Rows that neighbouring ranges share count once, by key.
    """
    seen: dict[Hashable, Row] = {}
    open_ = [(low, high)]
    while open_:
        a, b = open_.pop()
        page = ask(a, b)
        if len(page) < ceiling:
            seen.update((key(r), r) for r in page)
        elif a >= b:
            raise OverflowError(f"{a} alone fills a page of {ceiling}")
        else:
            middle = (a + b) // 2
            open_ += [(middle + 1, b), (a, middle)]
    return list(seen.values())


def adaptive(low: int, high: int, ask: Callable[[int, int], Sequence[Row]], ceiling: int = 1000, window: int = 200, target: int = 900) -> Iterator[Row]:
    """Rows of a range in windows whose width follows the density seen so far; a full window is asked again at half width."""
    at = low
    while at <= high:
        end = min(high, at + window - 1)
        page = ask(at, end)
        if len(page) >= ceiling:
            if end == at:
                raise OverflowError(f"{at} alone fills a page of {ceiling}")
            window = max(1, (end - at + 1) // 2)
            continue
        yield from page
        density = len(page) / (end - at + 1)
        at = end + 1
        window = max(1, min(4 * window, int(target / density) if density else 4 * window))


def by_moving_start(ask: Callable[[int], Sequence[Row]], start: int, page_rows: int, block: Callable[[Row], int], key: Callable[[Row], Hashable]) -> list[Row]:
    """Pages that begin at a block: the next one begins at the last block seen, whose rows count once, by key."""
    seen: dict[Hashable, Row] = {}
    while True:
        page = ask(start)
        seen.update((key(r), r) for r in page)
        if len(page) < page_rows:
            return list(seen.values())
        following = max(map(block, page))
        if following == start:
            raise OverflowError(f"block {start} alone fills a page of {page_rows}")
        start = following


def in_batches(ids: Sequence[Hashable], ask: Callable[[Sequence[Hashable]], Sequence[Row]], one: Callable[[Hashable], Row | None], key: Callable[[Row], Hashable], batch: int = 100) -> dict[Hashable, Row]:
    """Rows by id, many at a time; what a batch leaves out is asked for alone."""
    found: dict[Hashable, Row] = {}
    for at in range(0, len(ids), batch):
        some = ids[at : at + batch]
        found.update((key(r), r) for r in ask(some))
        for i in some:
            if i not in found and (row := one(i)) is not None:
                found[i] = row
    return found


def finished(run: Callable[[], str], state: Callable[[str], str], page: Callable[[str, int], tuple[Sequence[Row], int | None]], tries: int = 1000) -> Iterator[Row]:
    """A query run elsewhere: start it, wait until it is done, take its pages. Waiting is the state function's affair."""
    ticket = run()
    for _ in range(tries):
        now = state(ticket)
        if now == "done":
            break
        if now == "failed":
            raise RuntimeError(f"query {ticket} failed")
    else:
        raise TimeoutError(f"query {ticket} is not done")
    at: int | None = 0
    while at is not None:
        rows, at = page(ticket, at)
        yield from rows


def split_on_timeout(low: int, high: int, ask: Callable[[int, int], Sequence[Row]], cache: dict[tuple[int, int], Sequence[Row]], leaf: int) -> Iterator[Row]:
    """Rows of [low, high): a window that times out is halved down to `leaf`; windows in the cache are replayed, not asked."""
    open_ = [(low, high)]
    while open_:
        a, b = open_.pop()
        if (a, b) not in cache:
            try:
                cache[a, b] = ask(a, b)
            except TimeoutError:
                if b - a <= leaf:
                    raise
                middle = (a + b) // 2
                open_ += [(middle, b), (a, middle)]
                continue
        yield from cache[a, b]
