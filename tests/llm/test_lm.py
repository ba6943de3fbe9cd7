"""Language-model scores: the base against plain Python, the filter against counts."""

import functools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from casebrook.llm import countfilter, lm, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_tokens(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return WORD.findall(text) + ["</end>"]


def check_scores(rows, source):
    held = {k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in source}
    counts = Counter(w for k, t in source if not held[k] for w in plain_tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    got = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.base_score))
    want = []
    for key, text in source:
        words = plain_tokens(text)
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words)
        want.append((key, held[key], len(words), sum(counts[w] > 0 for w in words), base))
    want.sort(key=lambda r: (r[0] is None, r[0] or 0, r[4]))
    assert len(got) == len(want)
    for r, (key, is_held, n, known, base) in zip(got, want):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (key, is_held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert math.isfinite(r.score) and r.score <= 1e-9


@pytest.mark.parametrize("hot", [200_000, 20])
def test_scores(spark, folder, texts, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT", hot)
    rows = queries.op1_lm_scores(spark, folder).collect()
    check_scores(rows, list(texts.items()))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(odd, nothing):
    check_scores(lm.score_held_out(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert lm.score_held_out(nothing).collect() == []
    unknown = lm.score(odd, lm.train(nothing)).collect()
    assert all(r.n_known == 0 and r.score == pytest.approx(0) for r in unknown)


@functools.cache
def key_of(word):
    if word == "</end>":
        return int(lm._END)
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(lm.arrowwords.hashes(data, *lm.arrowwords.spans(data), True)[0])


def pair_key(one, two):
    return int(lm.pairs_of(np.array([one], dtype=np.uint64), np.array([two], dtype=np.uint64))[0])


def exact_counts(texts):
    """Counts of words and of pairs of keys, by plain Python."""
    words, pairs = Counter(), Counter()
    for text in texts:
        keys = [key_of(w) for w in plain_tokens(text)]
        words.update(keys)
        pairs.update(zip([int(lm._BEGIN), *keys], keys))
    return words, pairs


def asked(counts):
    return np.array(list(counts), dtype=np.uint64)


def test_levels_are_read_back(spark, docs, texts):
    model = lm.train(docs)
    assert model.path is not None and model.filters is None
    look = lm._mapped(model)()
    words, pairs = exact_counts(texts.values())
    assert (model.tokens, model.words) == (sum(words.values()), len(words))
    pairs = Counter({pair_key(*p): n for p, n in pairs.items()})
    for kind, counts in ((lm.WORDS, words), (lm.PAIRS, pairs)):
        levels = look(kind, asked(counts))
        true = lm.level_of(np.array(list(counts.values())))
        assert (levels >= true).all() and (levels == true).mean() > 0.98
    strange = np.arange(1, 200_001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    # 2 ** -SPARE false hits are expected among V pairs
    assert (look(lm.PAIRS, strange) > 0).sum() <= 2 + 200_000 / len(words)


@pytest.mark.parametrize("n_docs", [40, 200])
def test_probabilities_after_a_history_add_up_to_one(spark, docs, texts, n_docs):
    ids = sorted(texts)[:n_docs]
    model = lm.train(docs.where(docs.doc_id.isin(ids)))
    look = lm._mapped(model)()
    words, pairs = exact_counts(texts[i] for i in ids)
    vocabulary = asked(words)
    one = (model.values[lm.WORDS][look(lm.WORDS, vocabulary)] + 1) / model.whole
    assert one.sum() + 1 / model.whole == pytest.approx(1, abs=0.02)
    masses = []
    rare = [w for w, n in words.items() if n == 1][:100]
    for word in [int(lm._BEGIN)] + [w for w, _ in words.most_common(300)] + rare:
        known = lm._END if word == int(lm._BEGIN) else word
        if known == int(lm._END) and word != int(lm._BEGIN):
            continue  # nothing follows an end
        level = look(lm.WORDS, np.array([known], dtype=np.uint64))
        c_history = model.values[lm.WORDS][level]
        keys = lm.pairs_of(np.full(len(vocabulary), word, dtype=np.uint64), vocabulary)
        c_pairs = np.minimum(model.values[lm.PAIRS][look(lm.PAIRS, keys)], c_history)
        g = model.weights[level]
        masses.append(float((g * c_pairs / c_history + (1 - g) * one).sum() + (1 - g[0]) / model.whole))
    assert len(masses) > 300
    assert np.median(masses) == pytest.approx(1, abs=0.01)
    assert 0.8 < min(masses) and max(masses) < 1.25
    assert np.mean(np.abs(np.array(masses) - 1) < 0.1) > 0.95


def test_scores_are_those_of_exact_counts_but_for_quantising(spark, docs, texts):
    """Each text against the same formula on plain counts.

    A quantised count is off by 9 % at most, in the same direction all along a text
    that repeats one pair, so a text's bound is per token; in all, errors cancel.
    """
    model = lm.train(docs)
    words, pairs = exact_counts(texts.values())
    got = {r.doc_id: r for r in lm.score(docs, model).collect()}
    begin, off, total = int(lm._BEGIN), [], 0.0
    for key, text in texts.items():
        keys = [key_of(w) for w in plain_tokens(text)]
        want = 0.0
        for h, w in zip([begin, *keys], keys):
            c_h = words[int(lm._END)] if h == begin else words[h]
            g = model.weights[int(lm.level_of(np.array([c_h]))[0])]
            want += math.log10(g * pairs[h, w] / c_h + (1 - g) * (words[w] + 1) / model.whole)
        off.append(got[key].score - want)
        total += want
        assert abs(off[-1]) <= 0.09 * len(keys)
    assert abs(sum(off)) <= 0.005 * abs(total)
    assert np.quantile(np.abs(off), 0.95) <= 0.02 * abs(total) / len(off)


def test_thresholds():
    assert lm.THRESHOLDS[:12].tolist() == [1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16]
    assert len(lm.THRESHOLDS) < lm._LEVELS


@pytest.mark.parametrize("shards", [1, 16])
def test_a_part_reads_like_the_whole(shards):
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 64, 300_000, dtype=np.uint64))
    levels = rng.integers(1, 40, len(keys))
    shard = countfilter.shards_of(keys, shards)
    parts, sizes = [], []
    for s in range(shards):
        own = shard == s
        blocks = countfilter.blocks_for(int(countfilter.bits_of(levels[own], 20).sum()))
        sizes.append(blocks)
        parts.append(countfilter.built(keys[own], levels[own], blocks, shards, 20))
        assert len(parts[-1]) == blocks * countfilter.BLOCK_BYTES
    sizes = np.array(sizes)
    bits = np.frombuffer(b"".join(parts), dtype=np.uint8)
    assert 0.4 < np.unpackbits(bits).mean() < 0.55
    whole = countfilter.CountFilter(bits, np.cumsum(sizes) - sizes, sizes, 20)
    got = whole.levels(keys)
    assert (got >= levels).all() and (got == levels).mean() > 0.97
    for s in range(shards):
        alone = np.where(np.arange(shards) == s, sizes, 0)
        own = countfilter.CountFilter(np.frombuffer(parts[s], dtype=np.uint8), alone * 0, alone, 20)
        mine = shard == s
        assert (own.levels(keys[mine]) == got[mine]).all()
        assert not own.levels(keys[~mine]).any()
    assert whole.levels(keys[:0]).tolist() == []


def test_a_filter_in_parts_gives_the_same_scores(spark, docs, texts, monkeypatch):
    """Beyond ``MAX_BYTES`` n-grams go to the shards; the bits are the same."""
    one = lm.train(docs)
    whole = {r.doc_id: r.score for r in lm.score(docs, one).collect()}
    monkeypatch.setattr(lm, "MAX_BYTES", 1)
    model = lm.train(docs)
    assert model.path is None and model.filters is not None
    assert (model.weights == one.weights).all() and (model.values == one.values).all()
    cut = {r.doc_id: r.score for r in lm.score(docs, model).collect()}
    assert cut.keys() == whole.keys() == texts.keys()
    assert all(cut[k] == pytest.approx(whole[k], rel=1e-9) for k in whole)
    groups = lm._groups(docs.select("doc_id", "text"), model.shards).collect()
    assert sum(len(g.ids) for g in groups if g.kind is None) == len(texts)


def test_whole_and_cut_filters_take_the_same_rows(odd, nothing, monkeypatch):
    monkeypatch.setattr(lm, "MAX_BYTES", 1)
    check_scores(lm.score_held_out(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert lm.score_held_out(nothing).collect() == []


def test_pairs_seen_once_are_stored(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta alpha delta")], "doc_id long, text string")
    look = lm._mapped(lm.train(docs))()
    seen, unseen = (pair_key(key_of(a), key_of(b)) for a, b in (("alpha", "beta"), ("beta", "beta")))
    assert look(lm.PAIRS, np.array([seen, unseen], dtype=np.uint64)).tolist() == [1, 0]
