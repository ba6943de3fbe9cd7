"""Exact top-k of a block of queries against one tile of chunk vectors.

This is the in-task part of the routed search. The rows of a tile are split at
medians into leaves of like direction and length. A leaf's directions lie in a box
of a few principal components and of the length of what they leave over; the box's
distance to a query bounds the angles, and with the least and greatest length all
scores of the leaf. Directions are points of the unit sphere, so a distance of at
least ``d`` is a cosine of at most ``1 - d * d / 2``; any length will do.

A query compares itself with its likeliest leaves first and then with those that can
still hold one of its best ``k``. Products of the components alone are no less than the
scores (what two vectors leave over adds at most the product of its lengths); where they
tell little, those of whole vectors follow. Both are in single precision, with room for
its error, and say which pairs are worth an exact product.
"""

from __future__ import annotations

import numpy as np

from casebrook.operators.blockscore import keep_best

LEAF = 512  # rows of a leaf at most
GROUP = 8  # leaves that are tested together first
LIKELY = 3  # leaves that a query visits before all others
BLOCK = 4096  # like queries that visit leaves together
AXES = 12  # principal components of the boxes
_SAMPLED = 20_000  # rows that the components are taken from
_PRODUCTS = 1 << 22  # numbers multiplied exactly at a time
_PENDING = 1 << 18  # pairs that wait for their exact product
_TELLING = 64  # one pair in so many may pass the products of components
_LOOSE = 1e-5  # more than the rounding error of a box's cosine


def _norms(vectors: np.ndarray) -> np.ndarray:
    wide = (vectors[at : at + (1 << 16)].astype(np.float64) for at in range(0, len(vectors), 1 << 16))
    parts = [np.linalg.norm(part, axis=1) for part in wide]
    return np.concatenate(parts) if parts else np.empty(0)


def _unit(vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return vectors.astype(np.float64) / np.where(norms > 0, norms, 1)[:, None]


def _axes(vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Orthonormal directions along which those of a sample vary most."""
    step = max(1, len(vectors) // _SAMPLED)
    some = _unit(vectors[::step], norms[::step])
    some = some - some.mean(axis=0)
    return np.linalg.eigh(some.T @ some)[1][:, ::-1][:, :AXES]


def _places(vectors: np.ndarray, norms: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Directions by their components, and the length of what is left; no two
    places are further apart than their directions."""
    parts = [np.empty((0, axes.shape[1] + 1), dtype=np.float32)]
    for at in range(0, len(vectors), 1 << 16):
        unit = _unit(vectors[at : at + (1 << 16)], norms[at : at + (1 << 16)])
        along = unit @ axes
        left = np.linalg.norm(unit - along @ axes.T, axis=1)
        parts.append(np.column_stack([along, left]).astype(np.float32))
    return np.concatenate(parts)


def _split(places: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows that puts like ones together, and where its parts of at
    most so many rows begin. Neighbouring parts are alike as well."""
    waiting, done = [np.arange(len(places))], []
    while waiting:
        rows = waiting.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        some = places[rows[:: max(1, len(rows) // 2000)]]
        half = np.argpartition(places[rows, some.std(axis=0).argmax()], len(rows) // 2)
        waiting += [rows[half[len(rows) // 2 :]], rows[half[: len(rows) // 2]]]
    return np.concatenate(done), np.cumsum([0, *map(len, done)])[:-1]


def lowest(group: np.ndarray, chunk: np.ndarray, code: np.ndarray, k: int, one_per_key: bool) -> np.ndarray:
    """Positions of the rows of each group that can be among the ``k`` with the least
    chunk ids, whichever key is left out: ``2 k`` of a group at most."""
    order = np.lexsort((chunk, code, group))

    def nth(*columns: np.ndarray) -> np.ndarray:
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.any([column[1:] != column[:-1] for column in columns], axis=0)
        return np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))

    order = order[nth(group[order], code[order]) < (1 if one_per_key else k)]
    order = order[np.lexsort((chunk[order], group[order]))]
    return order[nth(group[order]) < 2 * k]


def _worth_keeping(vectors: np.ndarray, chunk: np.ndarray, code: np.ndarray, k: int, one_per_key: bool) -> np.ndarray:
    """Rows without those that equal vectors with lower ids always outrank."""
    odd = np.random.default_rng(1).integers(0, 1 << 62, vectors.shape[1], dtype=np.uint64) * 2 + 1
    bits = vectors.view(np.uint32)
    mixed = np.zeros(len(vectors), dtype=np.uint64)
    for column, factor in enumerate(odd):
        mixed = (mixed ^ bits[:, column]) * factor
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    near = np.flatnonzero(mixed[order[1:]] == mixed[order[:-1]])
    same = np.zeros(len(order), dtype=bool)
    same[near + 1] = (bits[order[near + 1]] == bits[order[near]]).all(axis=1)
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(~same)
    keep = np.bincount(group)[group] <= 2 * k
    many = np.flatnonzero(~keep)
    if len(many):
        keep[many[lowest(group[many], chunk[many], code[many], k, one_per_key)]] = True
    return np.flatnonzero(keep)


class Leaves:
    """The rows of one tile: single-precision vectors, chunk ids and key codes.

    ``rows`` maps the numbers that ``best`` returns to positions in what was given.
    Vectors that are not finite are never found.
    """

    def __init__(self, vectors: np.ndarray, chunk: np.ndarray, code: np.ndarray, k: int, one_per_key: bool) -> None:
        vectors = np.ascontiguousarray(vectors, dtype=np.float32)
        rows = np.flatnonzero(np.isfinite(_norms(vectors)))
        rows = rows[_worth_keeping(vectors[rows], chunk[rows], code[rows], k, one_per_key)]
        self.rows = rows
        if not len(rows):
            return
        vectors = vectors[rows]
        norms = _norms(vectors)
        self.axes = _axes(vectors, norms)
        places = _places(vectors, norms, self.axes)
        known = np.log2(np.where(norms > 0, norms, 1))
        bands = np.where(norms > 0, known, known.min() - 1).astype(np.float32)
        order, self.starts = _split(np.column_stack([places, bands]), LEAF)
        self.ends = np.r_[self.starts[1:], len(order)]
        self.k, self.one_per_key = k, one_per_key
        self.rows = rows[order]
        self.vectors, self.chunk, self.code = vectors[order], chunk[self.rows], code[self.rows]
        places, norms = places[order], norms[order]
        # as many numbers as there are components anyway: whole vectors are no dearer
        self.brief = (places * norms[:, None]).astype(np.float32) if places.shape[1] < vectors.shape[1] else None

        self.low = np.minimum.reduceat(places, self.starts)
        self.high = np.maximum.reduceat(places, self.starts)
        self.short = np.minimum.reduceat(norms, self.starts)
        self.long = np.maximum.reduceat(norms, self.starts)
        sums = np.add.reduceat(self.vectors, self.starts, dtype=np.float64)
        self.mean = sums / (self.ends - self.starts)[:, None]
        self.groups = np.arange(0, len(self.starts), GROUP)

    def _bound(self, place: np.ndarray, length: np.ndarray, part: slice | None) -> np.ndarray:
        """What the leaves of one group, or all groups, can offer each query at most."""
        if part is None:
            low = np.minimum.reduceat(self.low, self.groups)
            high = np.maximum.reduceat(self.high, self.groups)
            short = np.minimum.reduceat(self.short, self.groups)
            long = np.maximum.reduceat(self.long, self.groups)
        else:
            low, high, short, long = self.low[part], self.high[part], self.short[part], self.long[part]
        square = np.zeros((len(place), len(low)), dtype=np.float32)
        apart = np.empty_like(square)
        for axis in range(place.shape[1]):
            at = place[:, axis, None]
            np.clip(at, low[:, axis], high[:, axis], out=apart)
            np.subtract(apart, at, out=apart)
            np.multiply(apart, apart, out=apart)
            np.add(square, apart, out=square)
        return _offer(square, short, long) * length[:, None]

    def bound_of_pairs(self, place: np.ndarray, length: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """What one leaf can offer each query at most."""
        apart = place - np.clip(place, self.low[leaf], self.high[leaf])
        square = np.einsum("ij,ij->i", apart, apart)
        return _offer(square, self.short[leaf], self.long[leaf]) * length

    def best(
        self, queries: np.ndarray, own: np.ndarray, bars: np.ndarray, digits: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(query, score, row)`` of the best rows of each query, and the scores that
        its k-th best has at least, given that it has ``bars`` from elsewhere.

        ``own`` is the code of the key that a query may not find; below -1 for none.
        """
        bars = bars.copy()
        norms = _norms(queries)
        found = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]
        if not len(self.rows):
            return (*found[0], bars)
        still = np.flatnonzero(norms == 0)
        if len(still):  # all scores are 0: the least ids win
            few = lowest(np.zeros(len(self.chunk), np.int64), self.chunk, self.code, self.k, self.one_per_key)
            query, row = np.repeat(still, len(few)), np.tile(few, len(still))
            found.append(self._kept(query, np.zeros(len(query)), row, own))
            _raise(bars, *found[-1][:2], self.k)
        moved = np.flatnonzero((norms > 0) & np.isfinite(norms))
        if len(moved):
            places = _places(queries[moved], norms[moved], self.axes)
            order, _ = _split(places, 256)
            for at in range(0, len(order), BLOCK):
                mine = order[at : at + BLOCK]
                some = moved[mine]
                block = _Block(self, queries[some], places[mine], norms[some], own[some], bars[some], digits)
                query, score, row = block.visit()
                found.append((some[query], score, row))
                bars[some] = block.bar
        query, score, row = (np.concatenate(column) for column in zip(*found))
        return query, score, row, bars

    def _kept(
        self, query: np.ndarray, score: np.ndarray, row: np.ndarray, own: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        other = own[query] != self.code[row]
        query, score, row = query[other], score[other], row[other]
        best = keep_best(query, score, self.chunk[row], self.code[row], self.k, self.one_per_key)
        return query[best], score[best], row[best]


def _offer(square: np.ndarray, short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """The best score of a query of length 1 and a row of one of these lengths, when
    the square of the distance of their directions is no less than this."""
    cosine = (1 + _LOOSE) - square.astype(np.float64) / 2
    return np.where(cosine >= 0, cosine * long, cosine * short)


def _raise(bar: np.ndarray, query: np.ndarray, score: np.ndarray, k: int) -> None:
    """Bars rise to the k-th best of the rows kept so far."""
    worst = np.full(len(bar), np.inf)
    np.minimum.at(worst, query, score)
    full = np.bincount(query, minlength=len(bar)) >= k
    bar[full] = np.maximum(bar[full], worst[full])


class _Block:
    """Some like queries on their way through the leaves."""

    def __init__(
        self,
        leaves: Leaves,
        queries: np.ndarray,
        places: np.ndarray,
        norms: np.ndarray,
        own: np.ndarray,
        bar: np.ndarray,
        digits: int,
    ) -> None:
        self.leaves, self.queries, self.places, self.norms = leaves, queries, places, norms
        self.own, self.bar, self.digits = own, bar, digits
        self.slack = 10.0**-digits
        self.kind = np.float32 if norms.max() * leaves.long.max() < 1e30 else np.float64
        self.narrow = queries.astype(self.kind)
        self.brief = (places * norms[:, None]).astype(self.kind)
        self.error = (4 * queries.shape[1] + 16) * np.finfo(self.kind).eps * norms
        self.kept = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.pending = 0

    def visit(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        leaves = self.leaves
        likely = self.queries @ leaves.mean.T
        seen = np.full((len(self.queries), min(LIKELY, len(leaves.starts))), -1)
        for turn in range(seen.shape[1]):
            seen[:, turn] = likely.argmax(axis=1)
            likely[np.arange(len(likely)), seen[:, turn]] = -np.inf
            bound = leaves.bound_of_pairs(self.places, self.norms, seen[:, turn])
            order = np.flatnonzero(bound >= self.bar - 2 * self.slack)
            order = order[np.argsort(seen[order, turn], kind="stable")]
            for rows in np.split(order, np.flatnonzero(np.diff(seen[order, turn])) + 1):
                if len(rows):
                    self._compare(int(seen[rows[0], turn]), rows)
            self._settle()

        bound = leaves._bound(self.places, self.norms, None)
        alive = (bound >= self.bar[:, None] - 2 * self.slack).sum(axis=0)
        for group in np.argsort(-alive, kind="stable")[: np.count_nonzero(alive)]:
            rows = np.flatnonzero(bound[:, group] >= self.bar - 2 * self.slack)
            if not len(rows):
                continue
            first = int(leaves.groups[group])
            part = slice(first, min(first + GROUP, len(leaves.starts)))
            near = leaves._bound(self.places[rows], self.norms[rows], part)
            near = near >= self.bar[rows, None] - 2 * self.slack
            for turn in seen.T:
                again = np.flatnonzero((turn[rows] >= first) & (turn[rows] < part.stop))
                near[again, turn[rows[again]] - first] = False
            for leaf in range(first, part.stop):
                self._compare(leaf, rows[near[:, leaf - first]])
        self._settle()
        return self.kept

    def _compare(self, leaf: int, rows: np.ndarray) -> None:
        """Pairs of these queries and the leaf's rows that can still be among the best."""
        if not len(rows):
            return
        leaves, k = self.leaves, self.leaves.k
        start, end = leaves.starts[leaf], leaves.ends[leaf]
        room = self.slack + self.error[rows] * leaves.long[leaf]
        least = (self.bar[rows] - room).astype(self.kind)[:, None]
        if leaves.brief is not None:
            most = self.brief[rows] @ leaves.brief[start:end].T.astype(self.kind, copy=False)
            pairs = np.flatnonzero(most >= least)
            if len(pairs) <= most.size // _TELLING:
                self._await(*np.divmod(pairs, end - start), rows, start)
                return
        score = self.narrow[rows] @ leaves.vectors[start:end].T.astype(self.kind, copy=False)
        hit = score >= least
        pairs = np.flatnonzero(hit)
        if len(pairs) > 4 * k * len(rows):
            crowded = np.flatnonzero(np.count_nonzero(hit, axis=1) > 4 * k)
            hit[crowded] &= self._nearly_best(score[crowded], self.own[rows[crowded]], leaves.code[start:end], room[crowded])
            pairs = np.flatnonzero(hit)
        self._await(*np.divmod(pairs, end - start), rows, start)

    def _await(self, query: np.ndarray, row: np.ndarray, rows: np.ndarray, start: int) -> None:
        if len(query):
            query, row = rows[query], start + row
            other = self.own[query] != self.leaves.code[row]
            self.waiting.append((query[other], row[other]))
            self.pending += np.count_nonzero(other)
            if self.pending > _PENDING:
                self._settle()

    def _nearly_best(self, score: np.ndarray, own: np.ndarray, code: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Of each row of scores those that its k-th best does not outdo."""
        score = np.where(own[:, None] == code, -np.inf, score)
        distinct = score
        if self.leaves.one_per_key:
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=-2))
            distinct = np.maximum.reduceat(score[:, order], starts, axis=1)
        n, k = distinct.shape[1], self.leaves.k
        if n < k:
            return score > -np.inf
        least = np.partition(distinct, n - k, axis=1)[:, n - k]
        return (score >= (least - 2 * room)[:, None]) & (score > -np.inf)

    def _settle(self) -> None:
        """Exact scores of the pairs that wait; the best stay and raise the bars."""
        if not self.pending:
            return
        leaves = self.leaves
        query, row = (np.concatenate(column) for column in zip(*self.waiting))
        self.waiting, self.pending = [], 0
        score = np.empty(len(query))
        step = max(1, _PRODUCTS // self.queries.shape[1])
        for at in range(0, len(query), step):
            part = slice(at, at + step)
            score[part] = np.einsum("ij,ij->i", self.queries[query[part]], leaves.vectors[row[part]].astype(np.float64))
        score = np.round(score, self.digits) + 0.0
        real = score >= self.bar[query] - self.slack
        columns = zip(self.kept, (query[real], score[real], row[real]))
        query, score, row = (np.concatenate(pair) for pair in columns)
        self.kept = leaves._kept(query, score, row, self.own)
        _raise(self.bar, *self.kept[:2], leaves.k)
