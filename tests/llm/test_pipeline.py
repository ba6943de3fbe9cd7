"""The pipeline stage by stage, and its result against plain Python."""

from collections import Counter

import duckdb

import __spark_entry__ as entry
import corpus_pipeline
from casebrook.llm import oracles, secrets, tokens

import test_lines_segmentation as of_lines
import test_near_duplicates as near
from test_tokens import check_pieces


def near_groups(rows):
    """Groups of five-word shingles at 0.8, as ``(id, kept)``."""
    whole = near.plain_set
    near.plain_set = lambda text: five(text)
    try:
        return {k: kept for k, _, _, kept in near.expected(rows)}
    finally:
        near.plain_set = whole


def five(text):
    words = near.WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_whole_run(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    sql = f"WITH {oracles.host_rules_sql()} SELECT doc_id FROM judged WHERE kept"
    kept = {r[0] for r in con.execute(sql).fetchall()}
    rows = con.execute("SELECT doc_id, text, source FROM documents").fetchall()
    rows = [r for r in rows if r[0] in kept]
    wide = {}
    for _, text, source in rows:
        for line in text.split("\n"):
            if len(line) >= of_lines.lines.MIN_CHARS:
                wide.setdefault(line, set()).add(source)
    wide = {s for s, sites in wide.items() if len(sites) >= of_lines.lines.MIN_SITES}
    texts = {}
    for key, text, _ in rows:
        own = text.split("\n")
        hits = sum(len(s) for s in own if s in wide)
        texts[key] = "\n".join(s for s in own if s not in wide) if 0 < 2 * hits <= len(text) else text
    stays = near_groups(list(texts.items()))
    encoding = tokens.encoder(tokens.vocabulary_path(), tokens.vocabulary_pattern())
    want = []
    for key, text in texts.items():
        if stays[key]:
            clean = secrets.redact(text, secrets.find_spans(text, encoding)[1])
            want.append((key, encoding.encode_ordinary(clean) + [1]))
    check_pieces(entry.queries()["pipeline"](spark, folder).collect(), want)


def test_stages_keep_columns_and_take_odd_rows(spark, odd, nothing, folder):
    for docs in (odd, nothing):
        rows = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before = rows
            rows = stage(spark, rows, folder)
            assert rows.dtypes == docs.dtypes
            rows = spark.createDataFrame(rows.collect(), docs.schema)
            assert {r.doc_id for r in rows.collect()} <= {r.doc_id for r in before.collect()}
        assert corpus_pipeline.STAGES[-1][1](spark, rows, folder).count() >= rows.count()


def test_repeated_rows_are_one(spark, odd):
    out = corpus_pipeline.near_dedup(spark, odd, "")
    assert max(Counter(r.doc_id for r in out.collect() if r.doc_id is not None).values()) == 1
