"""Line dedup and n-best segmentation against plain Python."""

import hashlib
import itertools
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from casebrook.llm import lines, oracles, queries
from casebrook.llm import segmentation as seg

# ------------------------------------------------------------------ lines


def expected(rows, min_sites=lines.MIN_SITES):
    sites = {}
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if len(line) >= lines.MIN_CHARS and site is not None:
                sites.setdefault(line, set()).add(site)
    wide = {line for line, s in sites.items() if len(s) >= min_sites}
    out = []
    for key, text, _ in rows:
        text = text or ""
        every = text.split("\n")
        kept = [s for s in every if s not in wide]
        if 2 * sum(len(s) for s in every if s in wide) > len(text):
            kept = every
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((str(key), len(every), len(every) - len(kept), digest))
    return sorted(out)


def found(df):
    return sorted(
        (str(r.doc_id), r.n_lines, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest())
        for r in df.collect()
    )


def test_lines(spark, folder, docs):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = queries.op5_line_spread(spark, folder).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_removed, r.kept_sha256) for r in got) == expected(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    sql = con.execute("SELECT doc_id, n_lines, n_removed, kept_sha256 FROM ("
                      + oracles.ORACLES["op5_line_spread"] + ")").fetchall()
    assert sorted((str(a), b, c, d) for a, b, c, d in sql) == expected(rows)


@pytest.mark.parametrize("min_sites", [2, 3, 10, 60])
def test_thresholds(spark, min_sites):
    rng = random.Random(min_sites)
    rows = []
    for i in range(400):
        own = [f"an own line of document {i} with number {k}" for k in range(4)]
        shared = [f"a line that stands on {k} sites or so" for k in range(1, 90, 3) if rng.randrange(90) < k]
        rows.append((i, "\n".join(own + shared[: rng.randint(0, 6)]), f"site{i % 90}" if i % 7 else None))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert found(lines.line_report(df, F.col("source"), min_sites)) == expected(rows, min_sites)


def test_odd_rows_through_lines(odd, nothing):
    from pyspark.sql import functions as F

    source = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    assert found(lines.line_report(odd, F.col("source"), 2)) == expected(source, 2)
    out = lines.without_boilerplate(odd, F.col("source"), 2)
    assert out.schema.names == odd.schema.names and out.dtypes == odd.dtypes
    assert out.count() == odd.count()
    same = Counter(map(str, odd.where("text is null").collect()))
    assert Counter(map(str, out.where("text is null").collect())) == same
    assert all(r.text is None or r.n_chars == len(r.text) for r in out.collect())
    assert lines.line_report(nothing, F.col("source")).collect() == []
    assert lines.without_boilerplate(nothing, F.col("source")).collect() == []


# ----------------------------------------------------------- segmentation


@pytest.fixture(scope="module")
def pieces():
    return seg.Pieces(seg.model_path())


def every_path(pieces, chunk):
    out = []
    for cuts in itertools.product((0, 1), repeat=len(chunk) - 1):
        bounds = [0] + [i + 1 for i, c in enumerate(cuts) if c] + [len(chunk)]
        edges = [pieces.edge(chunk[a:b]) for a, b in zip(bounds, bounds[1:])]
        if all(edges):
            out.append((sum(e[0] for e in edges), tuple(i for e in edges for i in e[1])))
    return sorted(out, key=lambda p: -p[0])


WORDS = ["▁the", "▁hello", "ab", "▁▁▁x", "▁étés", "▁a\nb", "\U0001f600z", "▁", "q"]


@pytest.mark.parametrize("chunk", WORDS)
def test_paths_of_a_chunk(pieces, chunk):
    want = every_path(pieces, chunk)
    got = seg.n_best(pieces, chunk, 6)
    assert [p[0] for p in got] == [p[0] for p in want[:6]]
    assert set(got) <= set(want) and len(set(got)) == len(got)
    total, ids, loss = seg._passes(pieces, [chunk, "▁another"])
    best = tuple(np.frombuffer(ids[0], dtype="<u4").tolist())
    assert total[0] == want[0][0] and (total[0], best) in want
    if len(want) > 1:
        assert loss[0] == want[0][0] - want[1][0]


def test_best_of_texts(pieces):
    rng = random.Random(1)
    segmenter = seg.Segmenter(pieces, 5)
    for _ in range(40):
        text = " ".join("".join(rng.choice("abcdeth") for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(1, 4)))
        chunks = seg.chunks_of(text)
        segmenter.learn([chunks])
        got = segmenter.segment(chunks)
        whole = "".join(chunks)
        want = every_path(pieces, whole)[:5] if whole else [(0.0, ())]
        assert [round(s, 6) for s, _, _ in got] == [round(s, 6) for s, _ in want]
        assert len({i for _, i, _ in got}) == len(got)
        for _, ids, spelled in got:
            assert pieces.decode(np.frombuffer(ids, dtype="<u4").tolist()) == text
            assert pieces.spell(np.frombuffer(ids, dtype="<u4").tolist()) == b"".join(spelled)


def check_rows(rows, count):
    by_doc = {}
    for r in rows:
        assert r.round_trip
        by_doc.setdefault(r.doc_id, []).append((r.rank, r.score))
    for own in by_doc.values():
        ranks = sorted(own)
        assert all(a[1] >= b[1] for a, b in zip(ranks, ranks[1:]))
    assert sum(r.rank == 1 for r in rows) == count


def test_segmentation(spark, folder, texts, pieces):
    rows = queries.op10_segmentation(spark, folder).collect()
    check_rows(rows, len(texts))
    first = {r.doc_id: r.score for r in rows if r.rank == 1}
    for key in sorted(texts, key=lambda k: len(texts[k]))[:60]:
        chunk = "".join(seg.chunks_of(texts[key]))
        assert first[key] == pytest.approx(seg.forward(pieces, chunk)[-1])


def test_odd_rows_through_segmentation(odd, nothing):
    rows = seg.segment_documents(odd).collect()
    check_rows([r for r in rows if r.doc_id is not None and r.doc_id != 5], 15)
    assert len([r for r in rows if r.doc_id == 0]) == 1
    assert seg.segment_documents(nothing).collect() == []


def test_every_rank_is_decoded(pieces):
    class Wrong(seg.Segmenter):
        def _paths(self, chunk):
            def longer(ids):
                ids = ids + ids[-4:]
                return ids, self.pieces.spell(np.frombuffer(ids, dtype="<u4").tolist())

            own = super()._paths(chunk)
            return [own[0], *((score, *longer(ids)) for score, ids, _ in own[1:])]

    assert [r[5] for r in seg.segmented(seg.Segmenter(pieces, 3), [1], ["hello there"])] == [True] * 3
    assert [r[5] for r in seg.segmented(Wrong(pieces, 3), [1], ["hello there"])] == [True, False, False]


def test_chunks_that_came_again_stay(pieces, monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("abdehnorsté") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    often = ["again", "and", "😀", "x" * 60]
    texts = [" ".join([*often, *words[k : k + 10]]) for k in range(0, 300, 10)]
    whole = seg.segmented(seg.Segmenter(pieces, 4), list(range(30)), texts)
    taken = []
    passes, search = seg._passes, seg.n_best
    monkeypatch.setattr(seg, "_passes", lambda p, chunks: taken.extend(chunks) or passes(p, chunks))
    monkeypatch.setattr(seg, "n_best", lambda p, c, n: taken.extend([c] * (n == 2)) or search(p, c, n))
    monkeypatch.setattr(seg, "_CACHED", 40)
    segmenter = seg.Segmenter(pieces, 4)
    rows = []
    for key in range(0, 30, 2):
        rows += seg.segmented(segmenter, [key, key + 1], texts[key : key + 2])
        assert len(segmenter.known) <= 40 + 24 and segmenter.lists.keys() <= segmenter.known.keys()
    assert rows == whole
    assert [taken.count(c) for c in ("▁again", "▁and", "▁😀", "▁" + "x" * 60)] == [1] * 4


def test_round_trip_of_chunks(pieces):
    segmenter = seg.Segmenter(pieces, 2)
    texts = ["hello there", "there", "hello", "a▁b", "▁", "", "😀 \x00  z"]
    rows = seg.segmented(segmenter, texts, texts)
    assert all(r[5] == ("▁" not in r[0]) for r in rows)
    assert [r[1] for r in rows if r[0] == "hello there"] == [1, 2]
    segmenter.wrong[segmenter.known["▁there"]] = True
    rows = seg.segmented(segmenter, texts, texts)
    assert {r[0]: r[5] for r in rows if r[1] == 1} == {
        t: t in ("hello", "", "😀 \x00  z") for t in texts
    }


def test_bytes_of_many_paths(pieces):
    paths = [p for w in WORDS for _, p in seg.n_best(pieces, w, 3)] + [()]
    raw = [np.array(p, dtype="<u4").tobytes() for p in paths]
    assert pieces.spell_each(raw) == [pieces.spell(list(p)) for p in paths]
    assert pieces.spell_each([]) == []
    missing = next(i for i in range(len(pieces.ids)) if i not in pieces.spelled)
    for spell in (lambda: pieces.spell([missing]), lambda: pieces.spell_each([np.uint32(missing).tobytes()])):
        with pytest.raises(ValueError, match=f"id {missing} is no piece"):
            spell()


def test_places_of_pieces(pieces):
    names = list(pieces.ids)
    own = pieces.places(pieces.hashes(names))
    assert pieces.key_ids[own].tolist() == [pieces.ids[p] for p in names]
    assert pieces.key_scores[own].tolist() == [pieces.scores[p] for p in names]
    others = pieces.keys[:-1] ^ np.uint64(1)  # in the slots of pieces
    assert (pieces.places(others.reshape(1, -1)) == pieces.none).all()


def test_decoding_of_a_column(spark, odd):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=seg.model_path())
    texts = ["hello there", "", "  two  blanks\n\u00e9t\u00e9 \U0001f600"]
    rows = [(k, np.array(model.encode(t), dtype="<u4").tobytes()) for k, t in enumerate(texts)]
    rows.append((3, np.array([model.bos_id(), *model.encode("abc")], dtype="<u4").tobytes()))
    df = spark.createDataFrame([*rows, (4, None)], "k int, ids binary")
    got = {r.k: r.text for r in seg.decode_ids(df).collect()}
    assert got == {0: texts[0], 1: "", 2: model.decode(model.encode(texts[2])), 3: "abc", 4: None}
    back = seg.decode_ids(seg.segment_documents(odd)).where("doc_id is not null").collect()
    whole = {r.doc_id: r.text or "" for r in odd.where("doc_id is not null").collect()}
    assert len(back) > len(whole) and all(r.text == whole[r.doc_id] for r in back)
