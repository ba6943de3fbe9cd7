"""Exact top-k of one block of chunk vectors against one block of queries.

This is the in-task part of the search: it sees only the rows Spark put into
one Arrow batch or one tile, and hands back at most ``k`` rows per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_CELLS = 1 << 22  # scores held at once


def matrix(vectors: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """An Arrow list column as a float64 matrix."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(vectors), dim)


def key_codes(keys: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, list]:
    """Integer codes of a key column (-1 for NULL) and the keys they stand for."""
    if isinstance(keys, pa.ChunkedArray):
        keys = keys.combine_chunks()
    coded = keys.dictionary_encode()
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return codes.astype(np.int64), coded.dictionary.to_pylist()


def keep_best(
    query: np.ndarray,
    score: np.ndarray,
    chunk: np.ndarray,
    code: np.ndarray,
    k: int,
    one_per_key: bool,
) -> np.ndarray:
    """Positions of the best ``k`` of each query, by score and then chunk id;
    with ``one_per_key`` a key counts once, with its best chunk."""
    order = np.lexsort((chunk, -score, query))
    if one_per_key:
        by_key = np.lexsort((code[order], query[order]))  # stable: best chunks of a key first
        q, c = query[order[by_key]], code[order[by_key]]
        first = np.ones(len(order), dtype=bool)
        first[1:] = (q[1:] != q[:-1]) | (c[1:] != c[:-1])
        order = order[np.sort(by_key[first])]
    q = query[order]
    starts = np.searchsorted(q, q, side="left")
    return order[np.arange(len(q)) - starts < k]


def _kth_best(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each row; -inf when there are fewer columns."""
    n = scores.shape[1]
    if n < k:
        return np.full(scores.shape[0], -np.inf)
    return np.partition(scores, n - k, axis=1)[:, n - k]


class BlockTopK:
    """Scores batches against a fixed block of queries."""

    def __init__(
        self,
        query_matrix: np.ndarray,
        own_keys: list,
        k: int,
        one_per_key: bool,
        digits: int,
    ) -> None:
        self.queries = query_matrix
        self.k = k
        self.one_per_key = one_per_key
        self.digits = digits
        self.by_own_key: dict = {}
        for at, key in enumerate(own_keys):
            if key is not None:
                self.by_own_key.setdefault(key, []).append(at)
        # k-th best score met so far: later batches only need to beat it
        self.bar = np.full(len(query_matrix), -np.inf)

    def _own_pairs(self, code: np.ndarray, keys: list) -> tuple[np.ndarray, np.ndarray]:
        """``(query, row)`` of the batch rows that belong to a query's record."""
        order = np.argsort(code, kind="stable")
        edges = np.searchsorted(code[order], np.arange(len(keys) + 1))
        queries, rows = [], []
        for i, key in enumerate(keys):
            mine = order[edges[i] : edges[i + 1]]
            for at in self.by_own_key.get(key, ()):
                queries.append(np.full(len(mine), at))
                rows.append(mine)
        if not rows:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        queries, rows = np.concatenate(queries), np.concatenate(rows)
        by_query = np.argsort(queries, kind="stable")
        return queries[by_query], rows[by_query]

    def candidates(
        self, vectors: np.ndarray, chunk: np.ndarray, code: np.ndarray, keys: list
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, query, score)`` of every pair that can still be among the
        best ``k`` of its query.

        A query whose running bar already leaves few rows needs no selection;
        the others take the k-th best of this batch (over distinct keys when a
        key counts once) as their bar.
        """
        n = len(vectors)
        repeated = self.one_per_key and len(keys) < n
        by_key = np.argsort(code, kind="stable") if repeated else np.arange(n)
        if repeated:
            vectors, code = vectors[by_key], code[by_key]
            starts = np.flatnonzero(np.diff(code, prepend=-2))
        own_query, own_row = self._own_pairs(code, keys)
        slack = 10.0**-self.digits
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        width = max(1, _CELLS // max(n, 1))
        for left in range(0, len(self.queries), width):
            right = min(left + width, len(self.queries))
            scores = self.queries[left:right] @ vectors.T
            lo, hi = np.searchsorted(own_query, (left, right))
            scores[own_query[lo:hi] - left, own_row[lo:hi]] = -np.inf
            bar = self.bar[left:right] - slack
            hit = scores >= bar[:, None]
            crowded = np.flatnonzero(np.count_nonzero(hit, axis=1) > 4 * self.k)
            if len(crowded):
                some = scores if len(crowded) == len(scores) else scores[crowded]
                distinct = np.maximum.reduceat(some, starts, axis=1) if repeated else some
                local = np.maximum(_kth_best(distinct, self.k) - slack, bar[crowded])
                hit[crowded] = some >= local[:, None]
            query, row = np.divmod(np.flatnonzero(hit), n)
            score = scores[query, row]
            real = score > -np.inf
            query, row, score = query[real], row[real], score[real]
            out.append((by_key[row], query + left, np.round(score, self.digits) + 0.0))
        return tuple(np.concatenate(part) for part in zip(*out))

    def raise_bar(self, query: np.ndarray, score: np.ndarray) -> None:
        """Take the k-th best of each query from the rows kept so far."""
        count = np.bincount(query, minlength=len(self.bar))
        worst = np.full(len(self.bar), np.inf)
        np.minimum.at(worst, query, score)
        full = count >= self.k
        self.bar[full] = worst[full]


def best_of_batch(scorer: BlockTopK, batch: pa.Table, dim: int) -> pa.Table:
    """The batch's surviving rows with ``query`` and ``score`` columns added;
    ``embedding`` is left out."""
    chunk = batch["chunk_id"].to_numpy()
    code, keys = key_codes(batch["reference_number"])
    rows, query, score = scorer.candidates(
        matrix(batch["embedding"], dim), chunk, code, keys
    )
    keep = keep_best(
        query, score, chunk[rows], code[rows], scorer.k, scorer.one_per_key
    )
    return (
        batch.drop_columns(["embedding"])
        .take(pa.array(rows[keep]))
        .append_column("query", pa.array(query[keep].astype(np.int32)))
        .append_column("score", pa.array(score[keep].astype(np.float64)))
    )


def merge_best(scorer: BlockTopK, kept: pa.Table | None, new: pa.Table) -> pa.Table:
    """Best rows of ``kept`` and ``new`` together."""
    if kept is None:
        both = new
    elif not new.num_rows:
        return kept
    else:
        both = pa.concat_tables([kept, new]).combine_chunks()
    query, score = both["query"].to_numpy(), both["score"].to_numpy()
    code, _ = key_codes(both["reference_number"])
    keep = keep_best(
        query, score, both["chunk_id"].to_numpy(), code, scorer.k, scorer.one_per_key
    )
    best = both.take(pa.array(keep))
    scorer.raise_bar(query[keep], score[keep])
    return best
