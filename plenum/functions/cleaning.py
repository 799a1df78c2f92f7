"""Cleaning of raw model text: thinking blocks, template remnants, duplicates.

Everything is a native expression.  Two regex dialect points are settled here
once: ``(?U)`` makes ``\\s``, ``\\w`` and ``\\b`` Unicode aware and ``(?d)``
keeps ``\\n`` the only line end for ``.`` and ``$``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.text import BLANKS, CUT, any_of, let, lines, present, rstrip, split_at, strip

# ---------------------------------------------------------------------------
# Fixed values (patterns and word lists that define the cleaned text)
THINK_CLOSED = r"(?isU)<think\b[^>]*>.*?</think\s*>"
THINK_OPEN = r"(?isU)<think\b[^>]*>.*$"
THINK_STRAY = r"(?isU)</think\s*>"
THINK_ANY = r"(?isU)<think\b"
CHOICE_TAG_BRACKET = r"(?iU)<\s*\(\s*{0}\s*\)?\s*>"
CHOICE_TAG_PLAIN = r"(?iU)<\s*{0}\s*\)?\s*>"
HINT_WORDS = (
    "answer|application|brief|choice|chosen|clarification|correct|"
    "description|evidence|example|explanation|format|justification|"
    "label|letter|needed|option|otherwise|phrase|reason|reasoning|"
    "selected|selection|sentence|summary|template|topic"
)
CONTROL_TAGS = r"\|endoftext\||br\s*/?|eoa|eoc|sep|end|newline|line\s+break|space|\.{2,}"
ANCHOR = (
    r"\b(?:direct reason|key evidence|application|option analysis|elimination|"
    r"judgement|answer correct|suggested answer|confidence)\s*:|\bthe final result\s+is\b"
)
TEMPLATE_LABEL = (
    r"(?iU)\b(?:answer format|direct reason|key evidence|application|option analysis|"
    r"elimination|the final result is|the answer is|answer|reasoning|reason|"
    r"explanation|justification|selected option|correct option|correct answer)\b"
)
EMPTY_CLAIM_TAIL = (
    r"(?iUd)(?:\s+(?:but|so|therefore|maybe|alternatively)\s*,?)?\s*\bthe answer is\s*$"
)
EMPTY_CLAIM = r"(?isU)\s*(?:the\s+answer\s+is|answer\s*:?)\s*[.;]?\s*"
SENTENCE_GAP = r"(?U)(?<=[.!?])\s+"
PARAGRAPH_GAP = r"(?U)\n\s*\n+"
# A text without any of these is clean: no rule finds anything in it.  Tags, line ends and blanks but
# the space; the switch; spaces at an end, in a row, behind a sentence or before its marks; a bare claim.
UNSETTLED = (
    any_of("<" + CUT + BLANKS.replace(" ", ""))
    + r"|/[nN]|^ | \z|[.!?] | [ .,;:!?]|(?iu:answer(?: is|:)?[ .;]*\z)"
)
# ---------------------------------------------------------------------------

# The tests for a placeholder are one expression each, not a pattern and a helper: native columns
# have no helper functions per match, and quantifiers must not be nested.
# <...> on one line, 1 to 120 characters, no blank at either end; U+FDD3 marks a dropped span.
_SPAN = r"<([^\s<>\n\ufdd3](?:[^<>\n\ufdd3]{0,118}[^\s<>\n\ufdd3])?)>"
_SPAN_SHAPE = r"(?=[^\s<>\n](?:[^<>\n]{0,118}[^\s<>\n])?>)"
# A span is a placeholder unless it is a choice letter: it holds a backslash,
# a bar, dots, "e.g", a hint word, or is a bare lower-case word.
PLACEHOLDER_SPAN = (
    r"<(?!\(?\s*[a-d]\s*\)?>)" + _SPAN_SHAPE
    + r"(?:(?=[^<>\n]*(?:\\|\||\.\.\.|e\.g|\b(?:" + HINT_WORDS + r")\b))[^<>\n]+"
    + r"|[a-z_/-]+|br /|line break)>"
)
# A tag of words: a letter, then letters, digits and separators, not ending in
# a separator other than "/" or "-"; or one of the control tags.
PLACEHOLDER_TAG = (
    r"<\s*/?\s*(?:" + CONTROL_TAGS + r"|[a-z][a-z0-9_/\s,;:()+-]*[a-z0-9_/-])\s*/?\s*>"
)
_FLAGS = "(?isU)"


def strip_think(text: Column) -> Column:
    """Remove closed, then unterminated thinking blocks, then stray end tags."""
    raw = F.coalesce(text, F.lit(""))
    out = raw
    for pattern in (THINK_CLOSED, THINK_OPEN, THINK_STRAY):
        out = F.regexp_replace(out, pattern, "\n")
    return strip(F.when(raw.contains("<"), out).otherwise(raw))


def unclosed_think(text: Column) -> Column:
    """True when a thinking block was opened and never closed."""
    raw = F.coalesce(text, F.lit(""))
    return raw.contains("<") & F.regexp_replace(raw, THINK_CLOSED, "").rlike(THINK_ANY)


def unwrap_choice_tags(text: Column) -> Column:
    """``<b>`` -> ``B`` and ``<(b)>`` -> ``(B)`` for the letters A to D."""
    out = text
    for letter in "ABCD":
        out = F.regexp_replace(out, CHOICE_TAG_BRACKET.format(letter), f"({letter})")
        out = F.regexp_replace(out, CHOICE_TAG_PLAIN.format(letter), letter)
    return F.when(text.contains("<"), out).otherwise(text)


def has_placeholder(text: Column) -> Column:
    return text.rlike(_FLAGS + PLACEHOLDER_SPAN) | text.rlike(_FLAGS + PLACEHOLDER_TAG)


def normalize_angle(text: Column) -> Column:
    """Unwrap ``<X>`` to ``X``; drop the span when it is a placeholder."""
    marked = F.regexp_replace(unwrap_choice_tags(text), _FLAGS + PLACEHOLDER_SPAN, "\ufdd3")
    plain = F.translate(F.regexp_replace(marked, "(?U)" + _SPAN, "$1"), "\ufdd3", "")
    return F.when(text.contains("<"), plain).otherwise(text)


def _after_placeholder(text: Column) -> Column:
    """Text from the first content anchor behind the first placeholder, or ''."""
    def behind(pattern: str) -> Column:
        return F.regexp_extract(text, f"{_FLAGS}{pattern}.*?((?:{ANCHOR}).*)$", 1)

    found = F.when(text.rlike(_FLAGS + PLACEHOLDER_SPAN), behind(PLACEHOLDER_SPAN)).otherwise(
        behind(PLACEHOLDER_TAG)
    )
    return strip(normalize_angle(found))


def is_template_paragraph(paragraph: Column) -> Column:
    """Only placeholders, known labels and punctuation."""
    bare = F.regexp_replace(unwrap_choice_tags(paragraph), _FLAGS + PLACEHOLDER_TAG, " ")
    bare = F.regexp_replace(bare, _FLAGS + PLACEHOLDER_SPAN, " ")
    bare = F.regexp_replace(bare, TEMPLATE_LABEL, " ")
    return (
        paragraph.contains("<")
        & has_placeholder(paragraph)
        & (F.length(F.regexp_replace(bare, r"(?U)[\W_]+", "")) == 0)
    )


def drop_template_paragraphs(paragraphs: Column) -> Column:
    """Keep the non-template paragraphs, or all of them when none is left."""
    kept = F.filter(paragraphs, lambda p: ~is_template_paragraph(p))
    return F.when((F.size(paragraphs) <= 1) | (F.size(kept) == 0), paragraphs).otherwise(kept)


def _same_text(paragraph: Column) -> Column:
    squeezed = F.regexp_replace(normalize_angle(paragraph), r"(?U)\s+", " ")
    return F.lower(strip(squeezed))


def collapse_adjacent(paragraphs: Column) -> Column:
    """Drop a paragraph that repeats its left neighbour."""
    keyed = F.transform(paragraphs, lambda p: F.struct(p.alias("p"), _same_text(p).alias("k")))

    def kept(pairs: Column) -> Column:
        fresh = F.filter(
            pairs, lambda x, i: (i == 0) | (x["k"] != F.get(pairs, i - 1)["k"])
        )
        return F.transform(fresh, lambda x: x["p"])

    return let(keyed, kept)


def _kept_fragments(line: Column) -> Column:
    fragments = F.transform(split_at(line, SENTENCE_GAP), strip)
    resolved = F.transform(
        fragments, lambda f: F.when(has_placeholder(f), _after_placeholder(f)).otherwise(f)
    )
    return F.array_join(F.filter(resolved, lambda f: F.length(f) > 0), " ")


def _line_without_placeholders(line: Column) -> Column:
    tagged = unwrap_choice_tags(line)
    anchored = _after_placeholder(tagged)
    return (
        F.when(~line.contains("<"), line)
        .when(~has_placeholder(tagged), tagged)
        .when(F.length(anchored) > 0, anchored)
        .otherwise(_kept_fragments(tagged))
    )


def _per_line(text: Column, rewrite) -> Column:
    """Rewrite every line; drop blank lines and empty paragraphs."""
    def paragraph(p: Column) -> Column:
        kept = F.filter(F.transform(lines(p), rewrite), present)
        return strip(F.array_join(kept, "\n"))

    parts = F.transform(split_at(text, PARAGRAPH_GAP), paragraph)
    return F.array_join(F.filter(parts, lambda p: F.length(p) > 0), "\n\n")


def drop_placeholder_fragments(text: Column) -> Column:
    return _per_line(text, _line_without_placeholders)


def _line_without_empty_claims(line: Column) -> Column:
    """A line that does not say "answer" only has its sentence gaps closed up."""
    plain = strip(F.regexp_replace(line, SENTENCE_GAP, " "))
    return F.when(F.lower(line).contains("answer"), _drop_claims(line)).otherwise(plain)


def _drop_claims(line: Column) -> Column:
    cut = rstrip(F.regexp_replace(line, EMPTY_CLAIM_TAIL, ""))
    fragments = F.transform(split_at(cut, SENTENCE_GAP), strip)
    kept = F.filter(
        fragments, lambda f: (F.length(f) > 0) & ~f.rlike(f"^{EMPTY_CLAIM}\\z")
    )
    return F.array_join(kept, " ")


def drop_empty_claims(text: Column) -> Column:
    """Remove "the answer is" that is followed by nothing."""
    return _per_line(text, _line_without_empty_claims)


def paragraphs_of(text: Column) -> Column:
    return F.filter(
        F.transform(split_at(text, PARAGRAPH_GAP), strip), lambda p: F.length(p) > 0
    )


def visible_text(text: Column) -> Column:
    """Text outside thinking blocks with line ends and control tokens settled.

    The guards are literal searches: most rows never reach the patterns.
    """
    def settle(raw: Column) -> Column:
        ends = F.when(
            raw.contains("\r"), F.regexp_replace(raw, "\r\n?", "\n")
        ).otherwise(raw)
        tags = F.regexp_replace(ends, r"(?iU)<\s*eoa\s*>", "")
        tags = F.when(raw.contains("<"), tags).otherwise(ends)
        switch = F.regexp_replace(tags, r"(?imUd)^\s*/no_think\s*$", "")
        switch = F.regexp_replace(switch, r"(?iU)\b/no_think\b", "")
        return F.when(F.lower(raw).contains("/no_think"), switch).otherwise(tags)

    return let(strip_think(text), settle)


def squeeze(text: Column) -> Column:
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r"(?U)\s+([.,;:!?])", "$1")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def _settled_paragraphs(parts: Column) -> Column:
    return F.when(
        F.size(parts) > 1, collapse_adjacent(drop_template_paragraphs(parts))
    ).otherwise(parts)


def with_clean_response(df: DataFrame, source: str, target: str) -> DataFrame:
    """Add the cleaned text.  Each stage is its own column, so Catalyst keeps
    the expensive steps separate instead of repeating them.  Texts in which no
    rule can find anything skip them all."""
    odd, visible, parts = f"__{target}_odd", f"__{target}_visible", f"__{target}_parts"
    text, raw = F.col(target), F.coalesce(F.col(source), F.lit(""))

    def where_odd(value: Column) -> Column:
        return F.when(F.col(odd), value)

    return (
        df.withColumn(odd, raw.rlike(UNSETTLED))
        .withColumn(visible, where_odd(visible_text(F.col(source))))
        .withColumn(parts, where_odd(paragraphs_of(F.col(visible))))
        .withColumn(parts, where_odd(_settled_paragraphs(F.col(parts))))
        .withColumn(
            target,
            F.when(F.size(parts) > 0, F.array_join(parts, "\n\n")).otherwise(F.coalesce(visible, raw)),
        )
        .withColumn(
            target,
            F.when(
                F.col(odd) & text.contains("<"), normalize_angle(drop_placeholder_fragments(text))
            ).otherwise(text),
        )
        .withColumn(target, where_odd(squeeze(drop_empty_claims(text))).otherwise(text))
        .drop(odd, visible, parts)
    )
