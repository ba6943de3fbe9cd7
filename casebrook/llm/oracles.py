"""SQL counterparts of the registered queries, where SQL can express them."""

from __future__ import annotations

from casebrook.llm import lines
from casebrook.llm.host_rules import HOST_LIMIT, MIN_PRIOR, MIN_WORDS, REPEAT_PERCENT
from casebrook.llm.oracles_vectors_phrases import codebooks_sql, collocations_sql

_RULES = {
    "symbols": ("10 * n_symbols > n_words", "2 * n_symbols > n_words"),
    "dup_lines": ("100 * n_dup_lines > 30 * n_lines", "100 * n_dup_lines > 60 * n_lines"),
    "lengths": (
        "word_chars > 10 * n_words OR word_chars < 3 * n_words",
        "word_chars > 20 * n_words OR word_chars < 2 * n_words",
    ),
}


def host_rules_sql(docs: str = "documents") -> str:
    """Measures and verdicts of every document, as CTEs ending in ``judged``."""
    sums = ",\n    ".join(
        f"sum(CAST({slight} AS BIGINT)) AS {rule}" for rule, (slight, _) in _RULES.items()
    )
    priors = ",\n    ".join(
        f"""sum({rule}) / sum(n_docs) AS {rule}_mean,
    coalesce(var_samp({rule} / n_docs), 0)
      - (sum({rule}) / sum(n_docs)) * (1 - sum({rule}) / sum(n_docs)) * avg(1 / n_docs)
      AS {rule}_extra"""
        for rule in _RULES
    )
    weights = ",\n    ".join(
        f"""{rule}_mean, CASE WHEN {rule}_extra > 0
      THEN least(1e6, greatest({MIN_PRIOR}, {rule}_mean * (1 - {rule}_mean) / {rule}_extra - 1))
      ELSE 1e6 END AS {rule}_weight"""
        for rule in _RULES
    )
    bad = ",\n    ".join(
        f"({rule} + {rule}_mean * {rule}_weight) / (n_docs + {rule}_weight) > {HOST_LIMIT}"
        f" AS {rule}_host"
        for rule in _RULES
    )
    failed = " OR ".join(
        f"({worse}) OR (({slight}) AND coalesce({rule}_host, false))"
        for rule, (slight, worse) in _RULES.items()
    )
    return f"""rows_ AS (
  SELECT row_number() OVER () AS r, * REPLACE (coalesce(text, '') AS text) FROM {docs}
), split_ AS (
  SELECT r, doc_id, source, text,
    list_filter(string_split_regex(text, '[ \\t-\\r]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS l
  FROM rows_
), words_ AS (
  SELECT r, len(w) AS n, w, unnest(range(1, len(w) - 1)) AS i FROM split_ WHERE len(w) >= 3
), windows_ AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS times FROM words_
), covered_ AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM windows_ WHERE times > 1) GROUP BY r
), measured_ AS (
  SELECT s.r, doc_id, source,
    CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[ \\t-\\r]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(len(l) AS BIGINT) AS n_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM split_ s LEFT JOIN covered_ c ON s.r = c.r
), hosts_ AS (
  SELECT source AS host, CAST(count(*) AS DOUBLE) AS n_docs,
    {sums}
  FROM measured_ WHERE source IS NOT NULL GROUP BY source
), prior_ AS (
  SELECT {priors} FROM hosts_
), weight_ AS (
  SELECT {weights} FROM prior_
), verdict_ AS (
  SELECT host, {bad} FROM hosts_, weight_
), judged AS (
  SELECT r, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
    NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words OR {failed}) AS kept
  FROM measured_ LEFT JOIN verdict_ ON source = host
)"""


SUBSTRINGS = r"""WITH words_ AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w
  FROM documents
), starts_ AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words_ WHERE len(w) >= 13
), windows_ AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY list_slice(w, i, i + 12)) AS first FROM starts_
), gone_ AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows_ WHERE first < doc_id
), each_ AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words_
), kept_ AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
  FROM each_ ANTI JOIN gone_ USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM words_ LEFT JOIN kept_ k USING (doc_id)"""

LINES = f"""WITH rows_ AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), lines_ AS (
  SELECT r, source, unnest(string_split(text, chr(10))) AS line,
    unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM rows_
), wide_ AS (
  SELECT line FROM lines_ WHERE length(line) >= {lines.MIN_CHARS}
  GROUP BY line HAVING count(DISTINCT source) >= {lines.MIN_SITES}
), hits_ AS (
  SELECT r, i, sum(length(line)) OVER (PARTITION BY r) AS chars
  FROM lines_ SEMI JOIN wide_ USING (line)
), gone_ AS (
  SELECT r, i FROM hits_ JOIN rows_ USING (r) WHERE 2 * chars <= length(text)
), kept_ AS (
  SELECT r, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n
  FROM lines_ ANTI JOIN gone_ USING (r, i) GROUP BY r
)
SELECT doc_id, CAST(len(string_split(d.text, chr(10))) AS BIGINT) AS n_lines,
  CAST(len(string_split(d.text, chr(10))) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM rows_ d LEFT JOIN kept_ k USING (r)"""

ORACLES: dict[str, str] = {
    "op5_line_spread": LINES,
    "op9_substrings": SUBSTRINGS,
    "op8_host_rules": f"WITH {host_rules_sql()} SELECT * EXCLUDE (r) FROM judged",
    "op11_vector_codes": codebooks_sql(),
    "op13_collocations": collocations_sql(),
}
