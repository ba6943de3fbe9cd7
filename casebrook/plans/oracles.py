"""The registered queries once more, as SQL for an independent engine.

Only the derivation of the inputs (``fixtures``) is shared; results are
computed in another way: spans by a recursive query, neighbours by joining all
pairs, verdicts with JSON functions.
"""

from __future__ import annotations

from casebrook.functions.text import SPACE_CHARS
from casebrook.operators.judging import JUDGE_TEMPLATE
from casebrook.operators.prompts import SUMMARY_TEMPLATE
from casebrook.plans import fixtures as fx
from casebrook.plans.queries import CONFIGS, PANEL
from casebrook.plans.stand_ins import CRITERIA_WEIGHTS, LETTERS
from casebrook.schemas import CRITERIA, METRICS, REASONINGS
from casebrook.sources.runs import AVERAGE_KEYS, ITEM_KEYS


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    def cell(v: object) -> str:
        return lit(v) if isinstance(v, str) else str(v)

    return "VALUES " + ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def stripped(x: str) -> str:
    return f"trim({x}, {lit(SPACE_CHARS)})"


def query(ctes: list[str], select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + select


# ------------------------------------------------------------------- corpus

DOCS = [
    f"raw AS (SELECT doc_id AS doc_ord, {fx.COMPLAINT_TEXT} AS t FROM documents)",
    r"""labelled AS (SELECT doc_ord, t,
  regexp_extract(t, '(?i)reference_number:\s*([^|]+)', 1) AS lab,
  regexp_extract(t, '(CDCR[-\w]{5,})', 1) AS pat FROM raw)""",
    f"""docs AS (SELECT doc_ord,
  CASE WHEN lab <> '' THEN {stripped('lab')} WHEN pat <> '' THEN pat ELSE 'unknown' END
    AS reference_number,
  coalesce(t, '(no content)') AS doc_text FROM labelled)""",
    """keys AS (SELECT reference_number, min(doc_ord) AS first_ord, count(*) AS n_documents
  FROM docs GROUP BY 1)""",
    """by_key AS (SELECT d.reference_number, d.doc_ord, d.doc_text
  FROM docs d JOIN keys k ON d.doc_ord = k.first_ord)""",
]

# ----------------------------------------------------------------- chunking


def _end(s: str) -> str:
    region = f"substr(t, {s} + 411, 102)"
    breaks = r"\. |\n| \| "
    return f"""CASE WHEN {s} + 512 >= n THEN {s} + 512
    WHEN regexp_matches({region}, {lit(breaks)})
    THEN {s} + 411 + length(regexp_extract({region}, {lit(f'(?s)^(.*)(?:{breaks})')}, 1))
    ELSE {s} + 512 END"""


def spans(source: str) -> list[str]:
    """``pieces(sid, i, total, piece)`` of ``source(sid, t)``."""
    return [
        f"src AS (SELECT sid, t, length(t) AS n FROM {source})",
        f"""walk(sid, i, s, e) AS (
  SELECT sid, 0, 0, {_end('0')} FROM src WHERE n > 512
  UNION ALL
  SELECT w.sid, w.i + 1, w.e - 128, {_end('(w.e - 128)')}
  FROM walk w JOIN src ON src.sid = w.sid WHERE w.e - 128 < n)""",
        f"""pieces AS (
  SELECT sid, 0 AS i, 1 AS total, t AS piece FROM src WHERE n <= 512
  UNION ALL
  SELECT w.sid, w.i, count(*) OVER (PARTITION BY w.sid),
    {stripped('substr(t, s + 1, e - s)')} FROM walk w JOIN src ON src.sid = w.sid)""",
    ]


def sectioned(sections: str) -> str:
    """Chunk rows of documents whose sections are rows of
    ``sections(doc_ord, pos, section, t)``."""
    return query(
        [
            f"cut AS ({sections})",
            "numbered AS (SELECT doc_ord * 8 + pos AS sid, * FROM cut)",
            *spans("numbered"),
        ],
        """SELECT doc_ord,
  row_number() OVER (PARTITION BY doc_ord ORDER BY pos, i) - 1 AS chunk_ord,
  section, i AS chunk_index, total AS total_chunks, piece AS chunk_text
FROM pieces JOIN numbered USING (sid)""",
        recursive=True,
    )


CHUNKS_WHOLE = sectioned(
    "SELECT doc_id AS doc_ord, 0 AS pos, 'Full-doc' AS section, text AS t FROM documents"
)
CHUNKS_SECTIONS = sectioned(
    """SELECT doc_id AS doc_ord, 0 AS pos, 'Main' AS section,
    'lead ' || doc_id || chr(10) AS t FROM documents
  UNION ALL SELECT doc_id, 1, 'Intake',
    '## Intake' || chr(10) || chr(10) || text || chr(10) FROM documents
  UNION ALL SELECT doc_id, 2, 'Detail ' || source,
    '## Detail ' || source || chr(10) || chr(10) || text FROM documents"""
)
CHUNKS_LITERAL = sectioned(
    """SELECT doc_id AS doc_ord, 0 AS pos, 'Main' AS section, text || chr(10) AS t
    FROM documents WHERE length(text) + 1 >= 512
  UNION ALL SELECT doc_id, 1, '$', '## $' || chr(10) || chr(10) || text FROM documents"""
)

CHUNKS = [
    *DOCS,
    "cut AS (SELECT doc_ord AS sid, doc_text AS t FROM docs)",
    *spans("cut"),
    f"""counted AS (SELECT sid AS doc_ord, sid * 8388608 + i AS chunk_id, piece,
  [{", ".join(f"CAST(length(piece) - length(replace(piece, '{x}', '')) AS DOUBLE)" for x in LETTERS)}]
    AS v FROM pieces)""",
    """normed AS (SELECT *, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS norm
  FROM counted)""",
    """chunks AS (SELECT chunk_id, c.doc_ord, d.reference_number, piece AS chunk_text,
  CAST([CAST(x / norm AS FLOAT) FOR x IN v] AS DOUBLE[]) AS e
  FROM normed c JOIN docs d ON d.doc_ord = c.doc_ord)""",
    """seeds AS (SELECT c.reference_number AS query_id, c.reference_number AS own, c.e AS q
  FROM chunks c JOIN (SELECT reference_number, min(chunk_id) AS chunk_id FROM chunks GROUP BY 1)
  USING (chunk_id))""",
]

# ------------------------------------------------------------------- search


def ranked(pairs: str, k: int, one_per_key: bool) -> list[str]:
    """``hits`` with 0-based rank from ``pairs(query_id, reference_number,
    chunk_id, score, ...)``."""
    per_key = (
        f"""(SELECT * FROM {pairs} QUALIFY row_number() OVER
  (PARTITION BY query_id, reference_number ORDER BY score DESC, chunk_id) = 1)"""
        if one_per_key
        else pairs
    )
    return [
        f"""hits AS (SELECT *, row_number() OVER
  (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM {per_key}
  QUALIFY rank < {k})"""
    ]


VECTORS = [
    """chunks AS (SELECT vec_id AS chunk_id, 'L' || label AS reference_number,
  label AS chunk_index, 'vector ' || vec_id AS chunk_text, CAST(embedding AS DOUBLE[]) AS e
  FROM embeddings)""",
    """seeds AS (SELECT reference_number AS query_id, reference_number AS own, e AS q
  FROM chunks QUALIFY row_number() OVER (PARTITION BY reference_number ORDER BY chunk_id) = 1)""",
]
SCORED = """pairs AS (SELECT query_id, own, c.reference_number, chunk_id, chunk_text, {more}
  round(list_dot_product(q, e), 6) AS score FROM seeds s, chunks c {where})"""
NOT_OWN = "WHERE own IS NULL OR own <> c.reference_number"
VECTOR_PAIRS = SCORED.format(more="chunk_index,", where=NOT_OWN)
ALL_VECTOR_PAIRS = SCORED.format(more="chunk_index,", where="")
CHUNK_PAIRS = SCORED.format(more="", where=NOT_OWN)
LABEL_DOCS = """label_docs AS (SELECT 'L' || length(source) AS reference_number,
  arg_min(text, doc_id) AS doc_text FROM documents GROUP BY 1)"""
DOC_HITS = """SELECT query_id, rank, hits.reference_number, chunk_id, score,
  coalesce(doc_text, chunk_text) AS text, chunk_index
FROM hits LEFT JOIN label_docs USING (reference_number)"""

COPIES = """copies AS (SELECT doc_id AS doc_ord FROM documents
  QUALIFY min(doc_id) OVER (PARTITION BY text) < doc_id)"""

# ------------------------------------------------------- prompts, summaries


def template(text: str, **slots: str) -> str:
    """A prompt template as a SQL concatenation."""
    out = lit(text)
    for name, sql in slots.items():
        out = out.replace("{" + name + "}", f"' || {sql} || '")
    return out.replace("{{", "{").replace("}}", "}")


PROMPTS = [
    *CHUNKS,
    CHUNK_PAIRS,
    *ranked("pairs", 4, True),
    """context AS (SELECT query_id AS reference_number, left(string_agg(
    '# Similar ' || rank || ' (' || hits.reference_number || ') (score: '
    || printf('%.3f', score) || ')' || chr(10) || left(doc_text, 6000),
    chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank), 12000) AS neighbours
  FROM hits JOIN by_key USING (reference_number) GROUP BY 1)""",
    f"""prompts AS (SELECT reference_number, {template(
        SUMMARY_TEMPLATE,
        target="left(doc_text, 24000)",
        neighbors="coalesce(neighbours, '')",
    )} AS prompt FROM by_key LEFT JOIN context USING (reference_number))""",
]


def summary_of(endpoint: str) -> str:
    return (
        f"{endpoint} || ' read ' || length(prompt) || ' characters and ' || "
        "(length(prompt) - length(replace(prompt, '. ', ''))) // 2 || ' sentence ends.'"
    )


# ------------------------------------------------------------------ judging

RUN_LIST = f"""run_list(run_no, run_id, llm_name, temperature, start_time, judged) AS ({values(
    [(i, r, m, t, s, int(j)) for i, (r, m, t, s, j) in enumerate(fx.RUNS)]
)})"""
JUDGED = [
    RUN_LIST,
    f"judge_list(judge, judge_no) AS ({values([(j, i) for i, j in enumerate(fx.JUDGES)])})",
    f"""judged AS (SELECT d.*, run_id, llm_name, run_no, concat('DOC-', {fx.PADDED_ID})
    AS complaint_id FROM documents d, run_list WHERE judged = 1)""",
]
FENCES = "regexp_replace(regexp_replace(regexp_replace({x}, '^```json', ''), '^```', ''), '```$', '')"
ANSWERS = [
    *JUDGED,
    f"""answers AS (SELECT run_id, complaint_id, judge, {fx.VERDICT_RESPONSE} AS response,
  {fx.VERDICT_ERROR} AS error FROM judged, judge_list)""",
    f"""cleaned AS (SELECT *, {stripped(FENCES.format(x=stripped('response')))} AS c
  FROM answers)""",
    """checked AS (SELECT *, json_valid(c) AS readable,
  CASE WHEN json_valid(c) THEN c ELSE '{}' END AS j FROM cleaned)""",
]


def _marks(ok: str) -> str:
    return ", ".join(
        f"CASE WHEN {ok} THEN CAST(json_extract(j, '$.{m}') AS DOUBLE) ELSE 3 END AS {m}"
        for m in METRICS
    )


VERDICTS = [
    *ANSWERS,
    f"""verdicts AS (SELECT run_id, complaint_id, judge, {_marks("readable AND error IS NULL")},
  {", ".join(
      f"coalesce(CASE WHEN readable AND error IS NULL THEN json_extract_string(j, '$.{x}') END, "
      f"'N/A') AS {x}" for x in REASONINGS)},
  CASE WHEN error IS NOT NULL THEN 'Error with ' || judge || ': ' || error
    WHEN readable THEN json_extract_string(j, '$.overall_assessment')
    ELSE 'Failed to parse ' || judge || ' evaluation' END AS overall_assessment,
  CASE WHEN readable AND error IS NULL THEN 0 ELSE 1 END AS failed FROM checked)""",
]
SINGLE = query(
    ANSWERS,
    f"""SELECT run_id, complaint_id, judge, {_marks("readable")},
  CASE WHEN readable THEN json_extract_string(j, '$.overall_assessment')
    ELSE 'Failed to parse evaluation' END AS overall_assessment,
  CASE WHEN NOT readable THEN response END AS raw_response
FROM checked WHERE error IS NULL""",
)


def panel_of(verdicts: str, by: str) -> str:
    parts = []
    for m in METRICS:
        parts += [
            f"coalesce(avg({m}), 3) AS {m}",
            f"coalesce(stddev_pop({m}), 0) AS {m}_std",
            f"coalesce(min({m}), 3) AS {m}_min",
            f"coalesce(max({m}), 3) AS {m}_max",
        ]
    return f"""(SELECT *, CASE WHEN overall_score_std < 5 THEN 1 - overall_score_std / 5 ELSE 0 END
    AS judge_agreement FROM (SELECT {by}, {", ".join(parts)}, count(*) AS num_judges,
    CAST(sum(failed) AS BIGINT) AS n_failed_judges FROM {verdicts} GROUP BY {by}))"""


EVALS = [*VERDICTS, f"evals AS {panel_of('verdicts', 'run_id, complaint_id')}"]
PANEL_SQL = query(
    EVALS,
    f"""SELECT run_id, complaint_id, {", ".join(
        f"round({m}, 6) AS {m}, round({m}_std, 6) AS {m}_std, {m}_min, {m}_max" for m in METRICS)},
  num_judges, n_failed_judges, round(judge_agreement, 6) AS judge_agreement,
  'Average of ' || num_judges || ' judges. Agreement: '
    || printf('%.2f', judge_agreement * 100) || '%' AS overall_assessment
FROM evals""",
)
PANEL_TEXTS = query(
    VERDICTS,
    " UNION ALL ".join(
        f"SELECT run_id, complaint_id, '{x}' AS topic, judge, {x} AS text FROM verdicts"
        for x in (*REASONINGS, "overall_assessment")
    ),
)
BREAKDOWN = query(
    VERDICTS,
    f"SELECT run_id, complaint_id, judge, {', '.join(METRICS)}, overall_assessment FROM verdicts",
)

# --------------------------------------------------------------------- runs


def averages(evals: str, lengths: str, by: str) -> str:
    sums = [
        *[f"round(avg({m}), 9) AS avg_{m}" for m in METRICS],
        "round(avg(judge_agreement), 9) AS avg_judge_agreement",
        "round(stddev_pop(accuracy), 9) AS std_accuracy",
        "round(stddev_pop(overall_score), 9) AS std_overall_score",
        "round(avg(accuracy_std), 9) AS avg_accuracy_std",
        "round(avg(overall_score_std), 9) AS avg_overall_score_std",
    ]
    return f"""(SELECT * FROM (SELECT {by}, {", ".join(sums)} FROM {evals} GROUP BY {by})
  JOIN (SELECT {by}, round(avg(summary_length), 9) AS avg_summary_length
    FROM {lengths} GROUP BY {by}) USING ({by}))"""


RUNS = [
    *EVALS,
    f"""summaries AS (SELECT run_id, complaint_id, summary, length(summary) AS summary_length
  FROM (SELECT *, {fx.SUMMARY_TEXT} AS summary FROM judged))""",
    f"averages AS {averages('evals', 'summaries', 'run_id')}",
    f"""wide AS (SELECT run_id, llm_name || '_'
    || strftime(CAST(start_time AS TIMESTAMP), '%Y%m%d_%H%M%S') AS run_name, start_time,
  CASE judged WHEN 1 THEN 'FINISHED' ELSE 'FAILED' END AS status, llm_name, temperature,
  {", ".join(AVERAGE_KEYS)}
  FROM run_list LEFT JOIN averages USING (run_id))""",
    """ordered AS (SELECT *, row_number() OVER
  (ORDER BY avg_overall_score DESC NULLS LAST, start_time DESC, run_id) AS place FROM wide)""",
]


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


COMPARED = (
    "avg_accuracy",
    "avg_completeness",
    "avg_chronology",
    "avg_clarity",
    "avg_conciseness",
    "avg_overall_score",
    "avg_summary_length",
    "std_overall_score",
    "avg_judge_agreement",
)
COMPARISON = f"SELECT run_id, start_time, llm_name, temperature, {r6(*COMPARED)} FROM ordered"
EVEN = "round_even(({x}) * 100, 0) / 100"
JUDGE_MEANS = ", ".join(f"{EVEN.format(x=f'avg({m})')} AS {m}" for m in METRICS)
RECOMMENDED = (
    ("maximum accuracy", "avg_accuracy"),
    ("best clarity", "avg_clarity"),
    ("conciseness", "avg_conciseness"),
    ("overall balance", "avg_overall_score"),
)

# --------------------------------------------------------------- experiment


def _grade(weight: int) -> str:
    return f"1 + (length(prompt) * {weight} + length(grader) * {weight + 1}) % 5"


EXPERIMENT = [
    *PROMPTS,
    f"config(llm_name, writer) AS ({values([(n, c['endpoint']) for n, c in CONFIGS.items()])})",
    f"graders(judge, grader) AS ({values(list(PANEL.items()))})",
    f"""made AS (SELECT llm_name, reference_number, {summary_of('writer')} AS summary
  FROM prompts, config)""",
    f"""asked AS (SELECT llm_name, reference_number, judge, grader, {template(
        JUDGE_TEMPLATE, original_context="left(doc_text, 20000)", summary="summary"
    )} AS prompt FROM made JOIN by_key USING (reference_number), graders)""",
    f"""graded AS (SELECT llm_name, reference_number, judge, 0 AS failed, {", ".join(
        f"{_grade(w)} AS {m}" for m, w in CRITERIA_WEIGHTS.items())} FROM asked)""",
    f"marked AS (SELECT *, ({' + '.join(CRITERIA)}) / 5.0 AS overall_score FROM graded)",
    f"evals AS {panel_of('marked', 'llm_name, reference_number')}",
    "lengths AS (SELECT llm_name, length(summary) AS summary_length FROM made)",
    f"averages AS {averages('evals', 'lengths', 'llm_name')}",
]
RESULT = (
    "avg_accuracy",
    "avg_completeness",
    "avg_chronology",
    "avg_clarity",
    "avg_conciseness",
    "avg_overall_score",
    "avg_summary_length",
    "avg_judge_agreement",
)

ORACLES: dict[str, str] = {
    "extract_keys": query(DOCS, "SELECT doc_ord, reference_number, doc_text FROM docs"),
    "distinct_keys": query(DOCS, "SELECT * FROM keys"),
    "first_keys": query(
        DOCS,
        """SELECT row_number() OVER (ORDER BY first_ord) - 1 AS position, reference_number
FROM (SELECT * FROM keys ORDER BY first_ord LIMIT 10)""",
    ),
    "known_keys": query(
        DOCS,
        f"""SELECT w.reference_number, CASE WHEN k.reference_number IS NULL
  THEN 'Complaint ' || w.reference_number || ' not found.' ELSE '' END AS message
FROM (SELECT concat('DOC-', {fx.PADDED_ID}) AS reference_number FROM labels) w
LEFT JOIN keys k USING (reference_number)""",
    ),
    "lookup_documents": query(DOCS, "SELECT reference_number, doc_ord, doc_text FROM by_key"),
    "corpus_stats": query(
        [*DOCS, "cut AS (SELECT doc_ord AS sid, doc_text AS t FROM docs)", *spans("cut")],
        """SELECT (SELECT count(*) FROM docs) AS n_documents,
  (SELECT count(*) FROM keys) AS n_complaints, (SELECT count(*) FROM pieces) AS n_chunks,
  round((SELECT count(*) FROM pieces) / (SELECT count(*) FROM docs), 6) AS chunks_per_document""",
        recursive=True,
    ),
    "chunks_whole": CHUNKS_WHOLE,
    "chunks_sections": CHUNKS_SECTIONS,
    "chunks_literal": CHUNKS_LITERAL,
    "normalise": query(
        [
            "v AS (SELECT vec_id, [CAST(CAST(x * label AS FLOAT) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings)",
            "n AS (SELECT *, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS norm FROM v)",
        ],
        """SELECT vec_id, unnest(range(len(v))) AS pos,
  unnest([round(CAST(CAST(x / norm AS FLOAT) AS DOUBLE), 5) + 0.0 FOR x IN v]) AS value FROM n""",
    ),
    "seeds": """SELECT 'L' || label AS query_id, min(vec_id) AS seed_chunk_id
FROM embeddings GROUP BY 1""",
    "attached_vectors": query(
        [
            "whole AS (SELECT doc_id AS sid, text AS t FROM documents)",
            *spans("whole"),
        ],
        """SELECT sid * 8388608 + i AS chunk_id, len(embedding) AS dimension,
  round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5)
    AS norm
FROM pieces LEFT JOIN embeddings ON vec_id = sid AND i = 0""",
        recursive=True,
    ),
    "embedding_responses": """SELECT vec_id, unnest(range(len(embedding))) AS pos,
  unnest([round(CAST(x AS DOUBLE), 5) + 0.0 FOR x IN embedding]) AS value FROM embeddings""",
    "completion_responses": """SELECT conv_id, turn, text AS content,
  'LLM call failed: ' || left(text, 500) AS failure FROM conversations""",
    "topk_chunks": query(
        [*VECTORS, VECTOR_PAIRS, *ranked("pairs", 10, False)],
        """SELECT query_id, rank, reference_number, chunk_id, score, chunk_text AS text, chunk_index
FROM hits""",
    ),
    "topk_documents": query(
        [*VECTORS, VECTOR_PAIRS, *ranked("pairs", 4, True), LABEL_DOCS], DOC_HITS
    ),
    "topk_overfetch": query(
        [
            *VECTORS,
            ALL_VECTOR_PAIRS,
            """fetched AS (SELECT * FROM pairs QUALIFY row_number() OVER
  (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 20)""",
            "kept AS (SELECT * FROM fetched WHERE own <> reference_number)",
            *ranked("kept", 4, True),
            LABEL_DOCS,
        ],
        DOC_HITS,
    ),
    "topk_without_copies": query(
        [
            *CHUNKS,
            COPIES,
            "allowed AS (SELECT * FROM chunks WHERE doc_ord NOT IN (SELECT doc_ord FROM copies))",
            CHUNK_PAIRS.replace("chunks c", "allowed c"),
            *ranked("pairs", 5, False),
        ],
        "SELECT query_id, rank, reference_number, chunk_id, score, chunk_text AS text FROM hits",
        recursive=True,
    ),
    "topk_routed": query(
        [
            VECTORS[0],
            """seeds AS (SELECT CAST(chunk_id AS VARCHAR) AS query_id, reference_number AS own,
  e AS q FROM chunks)""",
            VECTOR_PAIRS,
            *ranked("pairs", 5, False),
        ],
        "SELECT query_id, rank, reference_number, chunk_id, score FROM hits",
    ),
    "topk_any_length": query(
        [
            VECTORS[0].replace(
                "CAST(embedding AS DOUBLE[]) AS e",
                f"CAST([CAST(x * ({fx.SCALE}) AS FLOAT) FOR x IN embedding] AS DOUBLE[]) AS e",
            ),
            """seeds AS (SELECT CAST(chunk_id AS VARCHAR) AS query_id, reference_number AS own,
  e AS q FROM chunks)""",
            VECTOR_PAIRS,
            *ranked("pairs", 5, False),
        ],
        "SELECT query_id, rank, reference_number, chunk_id, score FROM hits",
    ),
    "topk_recall": "SELECT 5 * count(*) AS n_exact, true AS reached FROM embeddings",
    "topk_free_text": query(
        [
            *CHUNKS[:-1],
            f"""asked AS (SELECT CAST(item_id AS VARCHAR) AS query_id,
  [{", ".join(f"CAST(length(text) - length(replace(text, '{x}', '')) AS DOUBLE)" for x in LETTERS)}]
    AS v FROM benchmark)""",
            """asked_norm AS (SELECT *, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS norm
  FROM asked)""",
            """seeds AS (SELECT query_id, NULL AS own,
  CAST([CAST(x / norm AS FLOAT) FOR x IN v] AS DOUBLE[]) AS q FROM asked_norm)""",
            CHUNK_PAIRS,
            *ranked("pairs", 3, False),
        ],
        "SELECT query_id, rank, reference_number, chunk_id, score FROM hits",
        recursive=True,
    ),
    "summary_prompts": query(PROMPTS, "SELECT reference_number, prompt FROM prompts", True),
    "summaries": query(
        PROMPTS,
        f"""SELECT w.reference_number, coalesce({summary_of("'writer-one'")},
  'Complaint ' || w.reference_number || ' not found.') AS summary
FROM (SELECT concat('DOC-', {fx.PADDED_ID}) AS reference_number FROM labels) w
LEFT JOIN prompts USING (reference_number)""",
        True,
    ),
    "verdicts": query(
        VERDICTS,
        f"""SELECT run_id, complaint_id, judge, {", ".join(METRICS)}, overall_assessment, failed
FROM verdicts""",
    ),
    "single_verdicts": SINGLE,
    "panel": PANEL_SQL,
    "panel_texts": PANEL_TEXTS,
    "judge_breakdown": BREAKDOWN,
    "run_metrics": query(
        RUNS,
        " UNION ALL ".join(
            f"SELECT run_id, '{k}' AS key, round({k}, 6) AS value FROM averages"
            for k in AVERAGE_KEYS
        ),
    ),
    "item_metrics": query(
        EVALS,
        " UNION ALL ".join(
            f"""SELECT run_id, '{k}_' || CAST(substr(complaint_id, 5) AS BIGINT) AS key,
  round({k}, 6) AS value FROM evals"""
            for k in ITEM_KEYS
        ),
    ),
    "runs_wide": query(
        RUNS,
        f"""SELECT run_id, run_name, start_time, status, llm_name, temperature,
  {r6(*AVERAGE_KEYS)} FROM wide""",
    ),
    "recent_runs": query(
        RUNS,
        f"""SELECT run_id, start_time, status, llm_name, {r6("avg_overall_score")} FROM wide
ORDER BY start_time DESC, run_id LIMIT 5""",
    ),
    "latest_runs": query(
        RUNS,
        f"""SELECT llm_name, run_id, start_time, {r6("avg_overall_score")} FROM wide QUALIFY
row_number() OVER (PARTITION BY llm_name ORDER BY start_time DESC, run_id) = 1""",
    ),
    "comparison": query(RUNS, COMPARISON),
    "exported_results": query(RUNS, COMPARISON),
    "overall_bars": query(
        RUNS,
        """SELECT run_id, llm_name AS model, round(avg_overall_score, 6) AS score,
  round(std_overall_score, 6) AS std_dev,
  printf('%.2f', avg_overall_score) AS label FROM wide""",
    ),
    "radar": query(
        RUNS,
        " UNION ALL ".join(
            f"""SELECT run_id, llm_name AS model, CAST({i} AS BIGINT) AS point, '{m}' AS metric,
  round({i % 5} / 5.0 * 2 * pi(), 6) AS angle, round(avg_{m}, 6) AS value
FROM ordered WHERE place <= 4"""
            for i, m in enumerate((*CRITERIA, CRITERIA[0]))
        ),
    ),
    "small_multiples": query(
        RUNS,
        " UNION ALL ".join(
            f"""SELECT run_id, llm_name AS model, '{m}' AS metric, round(avg_{m}, 6) AS value
FROM ordered WHERE place <= 4"""
            for m in METRICS
        ),
    ),
    "temperature": query(
        RUNS,
        f"""SELECT run_id, llm_name, CAST(temperature AS DOUBLE) AS temperature,
  {r6("avg_overall_score", "avg_accuracy", "avg_clarity", "std_overall_score")}
FROM wide WHERE llm_name LIKE '%model-a%'""",
    ),
    "length_quality": query(
        RUNS, f"SELECT run_id, llm_name, {r6('avg_summary_length', 'avg_overall_score')} FROM wide"
    ),
    "winner": query(RUNS, COMPARISON + " WHERE place = 1"),
    "recommendations": query(
        RUNS,
        " UNION ALL ".join(
            f"""(SELECT '{label}' AS category, run_id, llm_name, round({m}, 6) AS score
FROM ordered ORDER BY {m} DESC NULLS LAST, place LIMIT 1)"""
            for label, m in RECOMMENDED
        ),
    ),
    "agreement": query(
        RUNS,
        f"""SELECT run_id, llm_name, {r6("avg_overall_score", "avg_judge_agreement")},
  printf('%.1f', avg_judge_agreement * 100) || '%' AS label,
  CASE WHEN avg_judge_agreement > 0.9 THEN 'very high' WHEN avg_judge_agreement >= 0.8
    THEN 'high' WHEN avg_judge_agreement >= 0.7 THEN 'moderate'
    WHEN avg_judge_agreement IS NOT NULL THEN 'low' END AS band,
  CAST(avg_judge_agreement >= 0.8 AS INTEGER) AS high FROM wide""",
    ),
    "judge_means": query(
        RUNS,
        f"""SELECT judge, {JUDGE_MEANS} FROM verdicts
WHERE run_id = (SELECT run_id FROM ordered WHERE place = 1) GROUP BY judge""",
    ),
    "judge_bars": query(
        VERDICTS,
        " UNION ALL ".join(
            f"""SELECT judge, '{m}' AS metric, {EVEN.format(x=f"avg({m})")} AS value
FROM verdicts GROUP BY judge"""
            for m in METRICS
        ),
    ),
    "judge_strictness": query(
        VERDICTS,
        f"""SELECT *, round(5.0 - mean_score, 6) AS strictness FROM (SELECT judge,
  {EVEN.format(x="avg(overall_score)")} AS mean_score,
  {EVEN.format(x="stddev_samp(overall_score)")} AS std_dev FROM verdicts GROUP BY judge)""",
    ),
    "sample_summaries": query(
        RUNS,
        """SELECT complaint_id, run_id, llm_name, round(avg_overall_score, 6) AS avg_overall_score,
  summary FROM summaries JOIN (SELECT run_id, llm_name, avg_overall_score FROM wide QUALIFY
  row_number() OVER (PARTITION BY llm_name ORDER BY start_time DESC, run_id) = 1) USING (run_id)""",
    ),
    "experiment": query(
        EXPERIMENT, f"SELECT llm_name, {r6(*RESULT)} FROM averages", recursive=True
    ),
    "experiment_tables": query(
        [
            *DOCS,
            f"config(llm_name) AS ({values([(n,) for n in CONFIGS])})",
            "n AS (SELECT count(*) AS n FROM keys)",
        ],
        f"""SELECT llm_name, table_name, n_rows FROM config, (
  SELECT 'run_params' AS table_name, 8 AS n_rows
  UNION ALL SELECT 'run_metrics', {len(ITEM_KEYS)} * n + {len(AVERAGE_KEYS)} FROM n
  UNION ALL SELECT 'summaries', n FROM n
  UNION ALL SELECT 'evaluations', n FROM n
  UNION ALL SELECT 'judge_breakdown', {len(PANEL)} * n FROM n)""",
    ),
}
