"""Secrets in texts: named assignments, access keys, hex runs, random strings.

The first three kinds are patterns. The fourth is a test of token efficiency: a
public BPE vocabulary spends many tokens on a random string, so few characters
per token expose it. Left out first are what a pattern has found already, digests,
UUIDs, short numbers and the parts that the vocabulary itself shows to be words.

Spans count code points; the end is exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from casebrook.llm import tokens

Span = tuple[int, int, str]  # start, end, kind

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

# Candidates of the token test, and what is known not to be a secret.
MIN_RANDOM = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RANDOM},}}")
DIGEST = r"[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{56}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{96}|[0-9A-Fa-f]{128}"
UUID = r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
HARMLESS = re.compile(rf"(?<![A-Za-z0-9])(?:{UUID}|{DIGEST})(?![A-Za-z0-9])")
LETTERS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
NUMBER = re.compile(r"[0-9]{1,8}")
PART = re.compile(r"[A-Za-z0-9]+")
WORD_CHARS_PER_TOKEN = 3.0
MAX_CHARS_PER_TOKEN = 2.0
BATCH = 512  # texts rewritten at a time


def pattern_spans(text: str) -> list[Span]:
    """Spans of the three patterns, by start, then kind as listed."""
    out: list[Span] = []
    lowered = text.lower()
    if any(hint in lowered for hint in ASSIGN_HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _outside(low: int, high: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What is left of a range without those taken, where long enough to be tested."""
    for start, end in sorted(taken):
        if min(start, high) - low >= MIN_RANDOM:
            yield low, min(start, high)
        low = max(low, end)
    if high - low >= MIN_RANDOM:
        yield low, high


def is_word(part: str, encoding: tiktoken.Encoding) -> bool:
    """Short numbers, and letters of one case that the vocabulary knows as a word."""
    if NUMBER.fullmatch(part):
        return True
    if not LETTERS.fullmatch(part):
        return False
    pieces = len(encoding.encode_ordinary(part))
    return pieces == 1 or len(part) >= WORD_CHARS_PER_TOKEN * pieces


def random_spans(
    text: str,
    known: list[Span],
    encoding: tiktoken.Encoding,
    max_chars_per_token: float = MAX_CHARS_PER_TOKEN,
) -> list[Span]:
    """Runs of at least ``MIN_RANDOM`` characters on which the vocabulary is inefficient.

    Words at the ends of a run are not counted with it. A run that passes because
    of words within it is tested again between them.
    """
    out: list[Span] = []

    def exposed(low: int, high: int) -> bool:
        if high - low < MIN_RANDOM:
            return False
        return (high - low) / len(encoding.encode_ordinary(text[low:high])) < max_chars_per_token

    for match in CANDIDATE.finditer(text):
        low, high = match.span()
        taken = [(s[0], s[1]) for s in known if s[0] < high and low < s[1]]
        taken += [m.span() for m in HARMLESS.finditer(text, low, high)]
        for start, end in _outside(low, high, taken):
            runs: list[tuple[int, int]] = []  # of parts that are no words
            fresh = True
            for part in PART.finditer(text, start, end):
                if is_word(part[0], encoding):
                    fresh = True
                elif fresh:
                    runs.append(part.span())
                    fresh = False
                else:
                    runs[-1] = (runs[-1][0], part.end())
            if runs and exposed(runs[0][0], runs[-1][1]):
                out.append((runs[0][0], runs[-1][1], "random"))
            else:
                out += [(a, b, "random") for a, b in runs if exposed(a, b)]
    return out


def find_spans(text: str, encoding: tiktoken.Encoding) -> tuple[list[Span], list[Span]]:
    """``(pattern spans, all spans)``, each by start, then kind as listed."""
    base = pattern_spans(text)
    every = base + random_spans(text, base, encoding)
    return base, sorted(every, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str, spans: list[Span], mark: str = "<secret>") -> str:
    """Put ``mark`` in the place of the spans; overlapping spans are one."""
    out, at = [], 0
    reach = -1
    for start, end, _ in spans:
        if start >= reach:
            out += [text[at : max(at, start)], mark]
        reach = max(reach, end)
        at = max(at, end)
    return "".join(out) + text[at:]


SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, n_random long, "
    "base_sha256 string, spans string"
)


def scan_documents(
    docs: DataFrame, path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """Spans of every row of ``docs(doc_id, text)``.

    One pass, no shuffle. A null or empty text has no spans; repeated rows are
    reported each; a null id stays null; other columns are not read.
    """
    path = path or tokens.vocabulary_path()
    pattern = pattern or tokens.vocabulary_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokens.encoder(path, pattern)
        for batch in batches:
            counts: dict[str, list[int]] = {kind: [] for kind in KINDS}
            digests, found = [], []
            for value in batch.column(1):
                base, every = find_spans(value.as_py() or "", encoding)
                for kind in KINDS:
                    counts[kind].append(sum(s[2] == kind for s in every))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                found.append(joined(every))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(counts[kind], type=pa.int64()) for kind in KINDS),
                    pa.array(digests, type=pa.string()),
                    pa.array(found, type=pa.string()),
                ],
                names=[f.split()[0] for f in SCHEMA.split(", ")],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(
        run, SCHEMA
    )


def redact_documents(
    docs: DataFrame, path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """``docs`` with every span of ``text`` replaced; all columns and rows stay.

    Texts without a span, null ones among them, are unchanged to the byte.
    ``n_chars``, where present, is the length of the new text.
    """
    path = path or tokens.vocabulary_path()
    pattern = pattern or tokens.vocabulary_pattern()
    at = docs.columns.index("text")
    lengths = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokens.encoder(path, pattern)
        for batch in (b.slice(k, BATCH) for b in batches for k in range(0, b.num_rows, BATCH)):
            old = batch.column(at).to_pylist()
            new, changed = list(old), set()
            for k, text in enumerate(old):
                spans = find_spans(text, encoding)[1] if text else []
                if spans:
                    new[k] = redact(text, spans)
                    changed.add(k)
            columns = list(batch.columns)
            columns[at] = pa.array(new, type=columns[at].type)
            if lengths is not None and changed:
                counts = columns[lengths].to_pylist()
                for k in changed:
                    counts[k] = len(new[k])
                columns[lengths] = pa.array(counts, type=columns[lengths].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
