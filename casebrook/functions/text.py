"""Text expressions, all evaluated inside the JVM.

Every function takes and returns a Column; nothing here triggers a job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# The characters Python treats as white space in ``str.strip`` and ``\s``,
# written as a Java character class body.
SPACE = (
    r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CHARS = "".join(
    chr(c) for c in range(0x110000) if chr(c).isspace()
)  # the same characters, spelled out
UNKNOWN_KEY = "unknown"
NO_CONTENT = "(no content)"
KEY_LABEL = "reference_number"
FALLBACK_KEY = r"(CDCR[-\w]{5,})"
FENCE = "```"
# ----------------------------------------------------------------------------


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable so that ``body`` may use it many
    times while it is computed once."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode white space (not only blanks).

    ``btrim`` with a character set looks at the two ends only, where a regular
    expression would walk the whole text.
    """
    return F.btrim(text, F.lit(SPACE_CHARS))


def is_blank(text: Column) -> Column:
    """True when the text holds nothing but white space."""
    return ~F.rlike(text, F.lit(rf"[^{SPACE}]"))


def or_no_content(text: Column) -> Column:
    """A missing document reads ``(no content)``."""
    return F.coalesce(text, F.lit(NO_CONTENT))


def reference_key(
    text: Column,
    label: str = KEY_LABEL,
    fallback: str = FALLBACK_KEY,
    unknown: str = UNKNOWN_KEY,
) -> Column:
    """The record key written inside a flattened ``name: value | ...`` text.

    The value of the first ``label:`` up to the next pipe, stripped (a label
    followed by blanks only gives the empty key); else the first match of the
    ``fallback`` pattern's group; else ``unknown``. The labelled group always
    holds at least one character, so an empty extract means "no label".
    """
    labelled = F.regexp_extract(text, rf"(?i){label}:[{SPACE}]*([^|]+)", 1)
    pattern = F.regexp_extract(text, rf"(?U){fallback}", 1)
    return F.coalesce(
        F.when(labelled != "", strip(labelled)),
        F.when(pattern != "", pattern),
        F.lit(unknown),
    )


def last_index(text: Column, *literals: str) -> Column:
    """0-based start of the last occurrence of any of ``literals``; -1 if none
    occurs."""

    def position(backwards: Column, literal: str) -> Column:
        return let(
            F.instr(backwards, literal[::-1]),
            lambda at: F.when(at > 0, F.length(text) - len(literal) - at + 1).otherwise(
                F.lit(-1)
            ),
        )

    if len(literals) == 1:
        return position(F.reverse(text), literals[0])
    return let(
        F.reverse(text),
        lambda backwards: F.greatest(*[position(backwards, x) for x in literals]),
    )


def clip(text: Column, limit: int) -> Column:
    """The first ``limit`` code points: a prompt's character budget."""
    return F.substring(text, 1, limit)


def strip_code_fence(text: Column) -> Column:
    """Unwrap an answer given inside a Markdown code fence.

    Strip, drop a leading json fence, then a leading bare fence, then a
    trailing fence, and strip again.
    """
    out = strip(text)
    for pattern in (rf"\A{FENCE}json", rf"\A{FENCE}", rf"{FENCE}\z"):
        out = F.regexp_replace(out, pattern, "")
    return strip(out)


def fill_template(template: str, **slots: Column) -> Column:
    """Fill ``{name}`` slots of a prompt template; ``{{`` and ``}}`` are
    literal braces.

    The template is cut once, on the driver, into literal parts and slots and
    becomes one ``concat``: text that comes from a document can therefore
    never be taken for a slot.
    """
    from string import Formatter

    parts: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(slots[name])
    return F.concat(*parts)
