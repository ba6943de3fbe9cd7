"""SQL of the queries of ``record_queries``."""

from __future__ import annotations

from casebrook.operators.judging import JUDGE_TEMPLATE
from casebrook.operators.prompts import K_NEIGHBOURS
from casebrook.plans import fixtures as fx
from casebrook.plans.oracles import ORACLES as BASE_ORACLES
from casebrook.plans.oracles import (
    DOCS,
    PROMPTS,
    RUNS,
    _grade,
    averages,
    panel_of,
    query,
    summary_of,
    template,
    values,
)
from casebrook.plans.record_queries import CONFIGS, PANEL, REQUEST
from casebrook.plans.stand_ins import CRITERIA_WEIGHTS
from casebrook.schemas import CRITERIA, METRICS
from casebrook.sources.runs import AVERAGE_KEYS

NULL_DOCS = [DOCS[0].replace(fx.COMPLAINT_TEXT, fx.NULL_TEXT), *DOCS[1:]]
PANEL_ONLY = ("avg_judge_agreement", "avg_accuracy_std", "avg_overall_score_std")


def recorded(judges: dict[str, str], single: bool) -> list[str]:
    """The experiment's calls, evaluations and averages; single: a failed call
    leaves its record out."""
    neutral = ", ".join(
        f"CASE WHEN failed = 1 THEN 3 ELSE {_grade(w)} END AS {m}" for m, w in CRITERIA_WEIGHTS.items()
    )
    return [
        *PROMPTS,
        f"wanted AS ({fx.EXPERIMENT_KEYS})",
        f"config(llm_name, writer) AS ({values([(n, c['endpoint']) for n, c in CONFIGS.items()])})",
        f"graders(judge, grader) AS ({values(list(judges.items()))})",
        f"""written AS (SELECT llm_name, reference_number, writer, length(prompt) AS size,
  {summary_of('writer')} AS summary FROM prompts SEMI JOIN wanted USING (reference_number), config)""",
        "made AS (SELECT * FROM written WHERE size % 5 <> 0)",
        f"""asked AS (SELECT llm_name, reference_number, judge, grader, {template(
            JUDGE_TEMPLATE, original_context="left(doc_text, 20000)", summary="summary"
        )} AS prompt FROM made JOIN by_key USING (reference_number), graders)""",
        """called AS (SELECT *, length(prompt) AS size,
  CASE WHEN grader = 'grader-a' AND length(prompt) % 9 = 0 THEN 1 ELSE 0 END AS failed FROM asked)""",
        f"graded AS (SELECT llm_name, reference_number, judge, size, failed, {neutral} FROM called)",
        f"""marked AS (SELECT *, CASE WHEN failed = 1 THEN 3 ELSE ({' + '.join(CRITERIA)}) / 5.0 END
  AS overall_score FROM graded{' WHERE failed = 0' if single else ''})""",
        f"panels AS {panel_of('marked', 'llm_name, reference_number')}",
        "evals AS (SELECT * FROM wanted JOIN panels USING (reference_number))",
        """lengths AS (SELECT llm_name, length(summary) AS summary_length
  FROM made JOIN evals USING (llm_name, reference_number))""",
        f"averages AS {averages('evals', 'lengths', 'llm_name')}",
    ]


_BOTH = recorded(PANEL, False)
_ONE = recorded({"judge": "grader-a"}, True)
_ITEMS = " UNION ALL ".join(
    f"SELECT llm_name, '{m}_' || position AS key, round({m}, 6) AS value FROM evals" for m in METRICS
)
_AVERAGES = " UNION ALL ".join(
    f"SELECT llm_name, '{k}', round({k}, 6) FROM averages" for k in AVERAGE_KEYS if k not in PANEL_ONLY
)


def _params() -> str:
    given = []
    for name, config in CONFIGS.items():
        own = {
            "llm_name": name,
            "llm_endpoint": config["endpoint"],
            "temperature": config["temperature"],
            "max_tokens": config["max_tokens"],
            "k_neighbors": K_NEIGHBOURS,
            "num_judges": len(PANEL),
            "judge_endpoints": ", ".join(PANEL),
        }
        given += [(name, key, str(value)) for key, value in own.items()]
    counted = f"""SELECT llm_name, 'num_test_complaints' AS key, CAST(n AS VARCHAR) AS value
FROM config, (SELECT count(*) AS n FROM ({fx.EXPERIMENT_KEYS}))"""
    return query(
        [f"given(llm_name, key, value) AS ({values(given)})", f"config(llm_name) AS ({values([(n,) for n in CONFIGS])})"],
        f"SELECT * FROM given UNION ALL {counted}",
    )


ORACLES: dict[str, str] = {
    "null_texts": query(NULL_DOCS, "SELECT doc_ord, reference_number, doc_text FROM docs"),
    "catalog_records": query(DOCS, "SELECT * FROM keys"),
    "list_positions": query(
        DOCS, "SELECT row_number() OVER (ORDER BY first_ord) - 1 AS position, reference_number FROM keys"
    ),
    "lookup_in_place": query(DOCS, "SELECT reference_number, doc_ord, doc_text FROM by_key"),
    "resumed_answers": f"""SELECT doc_id, 1 + CAST(length(text) % 7 = 0 AS BIGINT) AS calls,
  CASE WHEN length(text) % 7 = 0 THEN 'LLM call failed: busy' END AS first_error,
  '{REQUEST["endpoint"]} read ' || length(text) || ' characters and '
    || (length(text) - length(replace(text, '. ', ''))) // 2 || ' sentence ends.' AS response,
  CAST(NULL AS VARCHAR) AS error FROM documents""",
    "replaced_runs": """SELECT lang AS run_id, 'n_documents' AS key,
  CAST(count(*) + CASE lang WHEN 'en' THEN 1000 ELSE 0 END AS DOUBLE) AS value
FROM documents WHERE lang NOT IN ('fr', 'es') GROUP BY lang""",
    "runs_by_source": """SELECT lang AS run_id, 'n_documents' AS key,
  CAST(count(*) + CASE lang WHEN 'en' THEN 1000 ELSE 0 END AS DOUBLE) AS value
FROM documents WHERE lang IN ('en', 'fr') GROUP BY lang""",
    "streamed_keys": BASE_ORACLES["distinct_keys"],
    "merged_counts": BASE_ORACLES["corpus_stats"],
    "runs_any_key": query(
        RUNS,
        """SELECT run_id, llm_name, temperature, 's-' || run_id AS seed,
  CAST(longest AS DOUBLE) AS max_summary_length
FROM wide LEFT JOIN (SELECT run_id, max(summary_length) AS longest FROM summaries GROUP BY 1)
  USING (run_id)""",
    ),
    "missing_experiment": f"""SELECT * FROM (VALUES ('{fx.EXPERIMENT}', {len(fx.RUNS)}, 0),
  ('no such experiment', 0, 0)) t(experiment, n_runs, n_judged)""",
    "experiment_params": _params(),
    "experiment_failures": query(
        _BOTH,
        """SELECT llm_name, reference_number AS complaint_id, 'record' AS step, NULL AS judge,
  'Complaint ' || reference_number || ' not found.' AS error
FROM wanted ANTI JOIN keys USING (reference_number), config
UNION ALL SELECT llm_name, reference_number, 'summary', NULL,
  'LLM call failed: ' || writer || ' at ' || size FROM written WHERE size % 5 = 0
UNION ALL SELECT llm_name, reference_number, 'verdict', judge,
  'LLM call failed: ' || grader || ' at ' || size FROM called WHERE failed = 1""",
        recursive=True,
    ),
    "experiment_evaluations": query(
        _BOTH,
        f"""SELECT e.llm_name, e.reference_number AS complaint_id, {", ".join(f"round(e.{m}, 6) AS {m}" for m in METRICS)},
  round(overall_score_std, 6) AS overall_score_std, round(judge_agreement, 6) AS judge_agreement,
  num_judges, n_failed_judges, s.clarity AS second_clarity,
  CASE WHEN f.failed = 1 THEN 'Error with first: LLM call failed: grader-a at ' || f.size
    ELSE f.size || ' characters' END AS first_assessment
FROM evals e
JOIN marked f ON f.llm_name = e.llm_name AND f.reference_number = e.reference_number AND f.judge = 'first'
JOIN marked s ON s.llm_name = e.llm_name AND s.reference_number = e.reference_number AND s.judge = 'second'""",
        recursive=True,
    ),
    "single_judge": query(_ONE, f"{_ITEMS} UNION ALL {_AVERAGES}", recursive=True),
}
