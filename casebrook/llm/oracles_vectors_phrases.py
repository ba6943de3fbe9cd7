"""SQL counterparts of the vector codebooks and the collocations."""

from __future__ import annotations

from casebrook.llm import codebooks as cb
from casebrook.llm import phrases as ph


def collocations_sql(docs: str = "documents", min_count: int = ph.MIN_COUNT, top: int = ph.TOP) -> str:
    """Every run of up to five words is counted by itself."""
    return f"""WITH lowered_ AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM {docs}
), pieces_ AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM lowered_
), words_ AS (
  SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces_
), starts_ AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words_
), runs_ AS (
  SELECT lang, w, i, unnest(range(1, least({ph.LONGEST}, len(w) - i + 1) + 1)) AS k FROM starts_
), counts_ AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM runs_ GROUP BY 1, 2, 3 HAVING count(*) >= {min_count}
), totals_ AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words_ GROUP BY lang
), candidates_ AS (
  SELECT lang, k, phrase, f AS a FROM counts_ WHERE k > 1
), kept_ AS (
  SELECT * FROM candidates_ c WHERE NOT EXISTS (
    SELECT 1 FROM candidates_ o
    WHERE o.lang = c.lang AND o.k > c.k AND 100 * o.a >= 100 * c.a
      AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))
), cuts_ AS (
  SELECT lang, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM kept_
), scored_ AS (
  SELECT c.lang, c.phrase, a, cut, l.f AS l, r.f AS r, n,
    CAST((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cuts_ c
  JOIN counts_ l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:cut], ' ')
  JOIN counts_ r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')
  JOIN totals_ t ON t.lang = c.lang
), least_ AS (
  SELECT * FROM scored_
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n, score
FROM least_ QUALIFY rank <= {top}"""


def codebooks_sql(vectors: str = "embeddings", parts: int = cb.PARTS, rounds: int = cb.ROUNDS) -> str:
    """Every part is held against every entry, round by round."""
    distance = "list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"

    def assigned(k: int) -> str:
        return f"""a{k}_ AS MATERIALIZED (
  SELECT r, p.part, min(struct_pack(d := {distance}, e := entry)) AS best
  FROM parts_ p JOIN c{k}_ c USING (part) GROUP BY r, p.part
)"""

    def moved(k: int) -> str:
        return f"""s{k}_ AS (
  SELECT part, a.best.e AS entry, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT r, part, x, unnest(range(1, len(x) + 1)) AS i FROM parts_) JOIN a{k}_ a USING (r, part)
  GROUP BY 1, 2, 3
), m{k}_ AS (
  SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS y FROM s{k}_ GROUP BY part, entry
), c{k + 1}_ AS MATERIALIZED (
  SELECT part, entry, coalesce(m.y, c.y) AS y FROM c{k}_ c LEFT JOIN m{k}_ m USING (part, entry)
)"""

    steps = ",\n".join(f"{assigned(k)},\n{moved(k)}" for k in range(rounds))
    return f"""WITH kept_ AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * {cb.SCALE}) AS BIGINT)) AS v
  FROM {vectors}
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts_ AS MATERIALIZED (
  SELECT r, part, v[part * len(v) // {parts} + 1:(part + 1) * len(v) // {parts}] AS x
  FROM kept_, range({parts}) t(part)
), c0_ AS MATERIALIZED (
  SELECT part, r - 1 AS entry, x AS y FROM parts_ WHERE r <= {cb.ENTRIES}
),
{steps},
{assigned(rounds)}, codes_ AS (
  SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM a{rounds}_ GROUP BY r
), digest_ AS (
  SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}_
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM codes_ JOIN kept_ USING (r), digest_"""
