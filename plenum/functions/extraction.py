"""Answer extraction from cleaned text as native columns.

A rule is a list of patterns.  Of all matches of all patterns of a rule the
one that starts last wins, a later pattern winning ties.  Rules are tried in
order; a later rule only runs for rows where the earlier ones found nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.text import BLANKS, CUT, OTHER_LINE_ENDS, any_of, let, lines, strip, swap

# ---------------------------------------------------------------------------
# Fixed values (sources, confidences and patterns that define an answer)
CONFIDENCE = {
    "final_result": 1.00,
    "final_answer": 0.95,
    "boxed": 0.95,
    "tail_claim": 0.80,
    "weak_tail": 0.50,
    "none": 0.00,
}

MC_FINAL_RESULT = [
    r"\bthe\s+final\s+result\s+is\s*\(?\s*([A-R])\s*\)?\b",
]
MC_FINAL_ANSWER = [
    r"\bfinal\s+answer\s*[:：]\s*\(?\s*([A-R])\s*\)?\b",
    r"\bfinal\s+answer\s+is\s*[:：.]?\s*\.{0,3}\s*\(?\s*\(?\s*([A-R])\s*\)?\s*\)?\b",
]
MC_TAIL_CLAIM = [
    r"\banswer\s*[:：]\s*\(?\s*([A-R])\s*\)?\b",
    r"\bthe\s+(?:(?:correct|best|right|final|likely)\s+)?(?:answer|option|choice|diagnosis|conclusion)\s+is\s*[:：.]?\s*\.{0,3}\s*\(?\s*\(?\s*([A-R])\s*\)?\s*\)?\b",
    r"\b(?:correct|best)\s+(?:answer|option|choice)\s+is\s*[:：.]?\s*\.{0,3}\s*\(?\s*([A-R])\s*\)?\b",
    r"\b(?:diagnosis|conclusion)\s+is\s*[:：.]?\s*\.{0,3}\s*\(?\s*([A-R])\b",
    r"\btherefore\s*,?\s*(?:the\s+)?(?:answer|option|choice)\s+is\s*\(?\s*\(?\s*([A-R])\s*\)?\s*\)?\b",
    r"\b(?:therefore|thus|so|hence|overall|finally)\s*,?\s*\(?\s*([A-R])\s*\)?\s*(?:is\s+(?:correct|right))?\.?\s*$",
    r"\bI(?:\s+(?:would\s+|will\s+|am\s+)?(?:going\s+to\s+)?|'(?:d|ll|m)\s+(?:going\s+to\s+)?)(?:choose|select|pick)\s*(?:option\s+)?[:：.]?\s*\.{0,3}\s*\(?\s*([A-R])\b",
    r"\b(?:going\s+with|go\s+with)\s*[:：.]?\s*\.{0,3}\s*\(?\s*([A-R])\b",
    r"\bmy\s+(?:answer|choice|selection)\s+(?:is|would\s+be)\s*[:：.]?\s*\.{0,3}\s*\(?\s*([A-R])\b",
    r"\boption\s*\(?\s*([A-R])\s*\)?\s+is\s+(?:correct|right)\b",
    r"\(\s*([A-R])\s*\)\s+is\s+the\s+(?:right|correct)\s+answer\b",
    r"\b(?:correct|best)\s+(?:answer|option|choice)\s*[:：]?\s*\(?\s*([A-R])\s*\)?\b",
]
MC_WEAK_TAIL = [
    r"(?m)^\s*\(?\s*([A-R])\s*\)?\s*\.?\s*$",
    r"\boption\s*\(?\s*([A-R])\s*\)?\s*\.?\s*$",
    r"(?m)\(([A-R])\)\s*\.?\s*$",
    r"^\s*\(?\s*([A-R])\s*\)?\s+is\s+the\s+(?:right|correct)\s+answer\b",
]

YN_FINAL_RESULT = [r"\bthe\s+final\s+result\s+is\s*(yes|no)\b"]
YN_FINAL_ANSWER = [
    r"\bfinal\s+answer\s*(?:[:：]|is\s*[:：.]?)\s*(?:\(?[AB]\s*\)?\s*[:：.-]?\s*)?(yes|no)\b",
]
YN_TAIL_CLAIM = [
    r"\b[AB]\s*(?:[):：.\-]\s*|\(\s*)(yes|no)\s*\)?\b",
    r"\banswer\s*[:：]\s*(?:\(?[AB]\s*\)?\s*[:：.-]?\s*)?(yes|no)\b",
    r"\b(?:the|my)\s+(?:correct\s+)?answer\s+is\s*[:：.]?\s*(?:\(?[AB]\s*\)?\s*[:：.-]?\s*)?(yes|no)\b",
    r"\b(?:the|my)\s+(?:correct\s+)?answer\s+to\s+[^\n]{1,200}?\s+is\s*[:：.]?\s*(?:\(?[AB]\s*\)?\s*[:：.-]?\s*)?(yes|no)\b",
    r"\btherefore\s*,?\s*(?:the\s+)?answer\s+is\s*(yes|no)\b",
    r"\b(?:actually|finally|in\s+the\s+end)\s+(yes|no)\b",
    r"\bI\s+(?:choose|answer)\s*(yes|no)\b",
]
YN_WEAK_TAIL = [
    r"(?m)^\s*(yes|no)\s*[.!?。！？]?\s*$",
    r"(?m)^\s*(yes|no)\s*(?:[.!?。！？,，;:：]|[-–—])\s*.+$",
]
# A stands for yes and B for no, only where no word was found.
AB_FINAL_RESULT = [r"\bthe\s+final\s+result\s+is\s*\(?\s*([AB])\s*\)?\b"]
AB_FINAL_ANSWER = [r"\bfinal\s+answer\s*(?:[:：]|is\s*[:：.]?)\s*\(?\s*([AB])\s*\)?\b"]
AB_TAIL_CLAIM = [
    r"\banswer\s*[:：]\s*\(?\s*([AB])\s*\)?\b",
    r"\b(?:the|my)\s+(?:correct\s+)?answer\s+is\s*[:：.]?\s*\(?\s*([AB])\s*\)?\b",
    r"\bI\s+(?:choose|answer)\s*(?:option\s+)?\(?\s*([AB])\s*\)?\b",
]
AB_WEAK_TAIL = [
    r"(?m)^\s*\(?\s*([AB])\s*\)?\s*[.!?。！？]?\s*$",
    r"(?m)^\s*\(?\s*([AB])\s*\)?\s*[:：]\s*\S.+$",
]

MATH_FINAL_RESULT = [r"\bthe\s+final\s+result\s+is\s+(.+?)(?:\n|$)"]
MATH_FINAL_ANSWER = [
    r"\bfinal\s+answer\s*[:：]\s*(.+?)(?:\n|$)",
    r"\bfinal\s+answer\s+is\s+(.+?)(?:\n|$)",
]
MATH_TAIL_CLAIM = [
    r"\banswer\s*[:：]\s*(.+?)(?:\n|$)",
    r"\btherefore\s*,?\s*(?:the\s+)?(?:answer|result)\s+is\s+(.+?)(?:\n|$)",
    r"\bthe\s+(?:answer|result)\s+is\s+(.+?)(?:\n|$)",
    r"=\s*(-?[0-9]+(?:\.[0-9]+)?(?:/[0-9]+(?:\.[0-9]+)?)?)\s*\.?\s*$",
]
MATH_NUMBER_TAIL = [
    r"(?m)^\s*(-?[0-9]+(?:\.[0-9]+)?(?:/[0-9]+(?:\.[0-9]+)?)?)\s*\.?\s*$",
    r"(?:therefore|thus|so|equals?|is)\s+(-?[0-9]+(?:\.[0-9]+)?)\s*\.?\s*$",
    r"(?:therefore|thus)\s+(-?[0-9]+(?:\.[0-9]+)?)\s*\.?\s*$",
    r"^=\s*(-?[0-9]+(?:\.[0-9]+)?)\s*\.?\s*$",
]
# Words without which a pattern of a rule cannot match (any of them; the order
# follows the patterns).  A literal search is far cheaper than the pattern.
NEEDED = {
    "MC_FINAL_RESULT": ["result"],
    "MC_FINAL_ANSWER": ["final", "final"],
    "MC_TAIL_CLAIM": [
        "answer", "the", "correct|best", "diagnosis|conclusion", "therefore",
        "therefore|thus|so|hence|overall|finally", "choose|select|pick", "go", "my", "option",
        "is", "correct|best",
    ],
    "MC_WEAK_TAIL": ["", "option", "(", "is"],
    "YN_FINAL_RESULT": ["result"],
    "YN_FINAL_ANSWER": ["final"],
    "YN_TAIL_CLAIM": [
        "yes|no", "answer", "answer", "answer", "therefore", "actually|finally|end", "choose|answer",
    ],
    "YN_WEAK_TAIL": ["yes|no", "yes|no"],
    "AB_FINAL_RESULT": ["result"],
    "AB_FINAL_ANSWER": ["final"],
    "AB_TAIL_CLAIM": ["answer", "answer", "choose|answer"],
    "AB_WEAK_TAIL": ["", ":|："],
    "MATH_FINAL_RESULT": ["result"],
    "MATH_FINAL_ANSWER": ["final", "final"],
    "MATH_TAIL_CLAIM": ["answer", "therefore", "the", "="],
    "MATH_NUMBER_TAIL": ["", "therefore|thus|so|equal|is", "therefore|thus", "="],
}
BOXED_IN_BRACES = r"\{\\boxed\s*\{"
BOXED = r"(?i)boxed\s*\{"
MATH_STOP_WORDS = r"(?iU)\s+(?:because|since|as|with)\b"
MATH_LEADING_NUMBER = r"(?U)^\s*(-?(?:\d+(?:\.\d+)?|\.\d+)(?:/\d+(?:\.\d+)?)?)\b"
TAIL_LINES = 8
# ---------------------------------------------------------------------------

_DIALECT = "(?iUd)"
# Marks around a match: Unicode noncharacters, which no text interchange carries.  Control characters
# of a text stay where they are; only these three are taken out of it.
_ANSWER, _SPAN, _END = "\ufdd0", "\ufdd1", "\ufdd2"
_MARKS = _ANSWER + _SPAN + _END

# Letters that only case folding maps to ASCII.
_FOLDED = "\u0130\u0131\u017f\u212a"
# A text without any of these is its own prepared text and its own tail.
UNPREPARED = (
    any_of(_MARKS + "*_：\n" + OTHER_LINE_ENDS + _FOLDED) + f"|^{any_of(BLANKS)}|{any_of(BLANKS)}\\z"
)

EXTRACTED_TYPE = "struct<answer:string,source:string,confidence:double,raw_span:string>"


def tail_lines(text: Column, keep: int = TAIL_LINES) -> Column:
    """The last non-empty trimmed lines."""
    visible = F.filter(F.transform(lines(text), strip), lambda x: F.length(x) > 0)
    return let(
        visible,
        lambda a: F.array_join(
            F.slice(a, F.greatest(F.size(a) - (keep - 1), F.lit(1)), F.lit(keep)), "\n"
        ),
    )


def without_marks(text: Column) -> Column:
    return swap(F.coalesce(text, F.lit("")), _MARKS, "")


def _replaced(text: Column, old: str, new: str) -> Column:
    return F.when(text.contains(old), F.replace(text, F.lit(old), F.lit(new))).otherwise(text)


def half_width_colon(text: Column) -> Column:
    return _replaced(text, "：", ":")


def answer_markup(text: Column) -> Column:
    """Full-width colon to ``:`` and Markdown emphasis removed."""
    plain = half_width_colon(text)
    for marker in ("**", "__", "*"):
        plain = _replaced(plain, marker, "")
    return F.when(text.rlike("[*_：]"), plain).otherwise(text)


def folded(text: Column) -> Column:
    """Lower case with the letters that only case folding maps to ASCII."""
    return F.lower(swap(text, _FOLDED, "iisk"))


def _has_any(low: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(word)) for word in words])


def last_match(
    text: Column, patterns: list[str], needed: list[str] | None = None, low: Column | None = None
) -> Column:
    """struct(start, rank, answer, span) of the winning match, NULL without one.

    ``regexp_replace`` writes the captured answer and the span between marks in
    front of the rest of the text, so the last mark tells answer, span and the
    distance to the end in one pass per pattern.  With ``needed`` words and the
    folded text, patterns that cannot match are not tried.
    """
    def mark(pattern: str, words: str) -> Column:
        marked = F.regexp_replace(text, _DIALECT + pattern, f"{_ANSWER}$1{_SPAN}$0{_END}")
        return F.when(_has_any(low, words.split("|")), marked) if words and low is not None else marked

    words = needed or [""] * len(patterns)
    marked = F.array(*[mark(p, w) for p, w in zip(patterns, words, strict=True)])

    def locate(m: Column, rank: Column) -> Column:
        last = F.substring_index(m, _ANSWER, -1)
        span = F.substring_index(F.substring_index(last, _END, 1), _SPAN, -1)
        rest = F.substring_index(last, _END, -1)
        return F.when(
            F.contains(m, F.lit(_ANSWER)),
            F.struct(
                (F.length(text) - F.length(span) - F.length(rest)).alias("start"),
                rank.alias("rank"),
                F.substring_index(last, _SPAN, 1).alias("answer"),
                span.alias("span"),
            ),
        )

    return F.array_max(F.transform(marked, locate))


def balanced_braces(text: Column) -> Column:
    """Text up to the brace that closes an already opened one, else NULL."""
    tokens = F.regexp_extract_all(text, F.lit(r"[{}]|[^{}]+"), F.lit(0))

    def step(acc: Column, token: Column) -> Column:
        depth = acc["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        open_ = acc["depth"] > 0
        return F.struct(
            F.when(open_, depth).otherwise(acc["depth"]).alias("depth"),
            F.when(open_ & (depth > 0), acc["size"] + F.length(token))
            .otherwise(acc["size"])
            .alias("size"),
        )

    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("size"))
    return F.aggregate(
        tokens,
        start,
        step,
        lambda acc: F.when(acc["depth"] == 0, F.substring(text, F.lit(1), acc["size"])),
    )


def _last_balanced(text: Column, opener: str) -> Column:
    """struct(content, span) of the last opener whose brace closes, NULL without one.

    The text is cut before every opener.  If the brace of an opener stays open,
    so does that of any opener before it which has not closed by then; so the box
    wanted closes before the next opener, and every piece is scanned by itself, from
    the last one on, once.
    """
    pieces = F.split(F.regexp_replace(text, opener, f"{CUT}$0"), CUT)
    none = F.lit(None).cast("string")

    def step(acc: Column, piece: Column) -> Column:
        found = acc["content"].isNotNull()
        head = F.regexp_extract(piece, "^" + opener, 0)
        body = let(F.struct(piece.alias("piece"), head.alias("head")), lambda x: balanced_braces(
            F.substring(x["piece"], F.length(x["head"]) + 1, F.length(x["piece"]))
        ))
        closes = F.contains(piece, F.lit("}"))
        return F.struct(
            F.when(found, acc["head"]).when(closes, head).alias("head"),
            F.when(found, acc["content"]).when(closes, body).alias("content"),
        )

    start = F.struct(none.alias("head"), none.alias("content"))
    last = F.aggregate(
        F.reverse(F.slice(pieces, F.lit(2), F.size(pieces))), start, step,
        lambda acc: F.when(
            acc["content"].isNotNull(),
            F.struct(acc["content"].alias("content"), F.concat(acc["head"], acc["content"], F.lit("}")).alias("span")),
        ),
    )
    return F.when(F.contains(text, F.lit("{")) & text.rlike(opener), last)


def last_boxed(text: Column) -> Column:
    """struct(content, span) of the last balanced ``boxed{...}``, preferring ``{\\boxed{``; the span is cut from the text."""
    return F.coalesce(_last_balanced(text, BOXED_IN_BRACES), _last_balanced(text, BOXED))


def extract_boxed(text: Column) -> Column:
    """Content of the last balanced box."""
    return last_boxed(text)["content"]


def clean_token(answer: Column) -> Column:
    """Trim and drop trailing full stops; '' when nothing is left."""
    return strip(F.rtrim(strip(answer), F.lit(".。")))


def yes_no_word(answer: Column) -> Column:
    return F.when(F.lower(strip(answer)).startswith("y"), F.lit("YES")).otherwise(F.lit("NO"))


def yes_no_letter(answer: Column) -> Column:
    return F.when(F.upper(strip(answer)) == "A", F.lit("YES")).otherwise(F.lit("NO"))


def clean_math_token(answer: Column) -> Column:
    """Cut the explanation behind the answer; a leading number stands alone."""
    head = F.substring_index(F.regexp_replace(clean_token(answer), MATH_STOP_WORDS, CUT), CUT, 1)
    number = F.regexp_extract(head, MATH_LEADING_NUMBER, 1)
    return F.when(F.length(number) > 0, number).otherwise(strip(head))


def _found(match: Column, source: str, shape) -> Column:
    return let(
        match,
        lambda m: F.when(
            m.isNotNull(),
            F.struct(
                shape(m["answer"]).alias("answer"),
                F.lit(source).alias("source"),
                m["span"].alias("span"),
            ),
        ),
    )


class _Texts:
    """The prepared text, its tail, and both folded for literal searches."""

    def __init__(self, body: str, tail: str, low_body: str, low_tail: str):
        self.body, self.tail = F.col(body), F.col(tail)
        self._low = {"body": F.col(low_body), "tail": F.col(low_tail)}

    def rule(self, source: str, where: str, name: str, shape) -> Column:
        low, needed = self._low[where], NEEDED[name]
        found = _found(last_match(getattr(self, where), globals()[name], needed, low), source, shape)
        if "" in needed:
            return found
        return F.when(_has_any(low, sorted({w for words in needed for w in words.split("|")})), found)


def _mc(t: _Texts) -> list[Column]:
    return [
        t.rule("final_result", "body", "MC_FINAL_RESULT", F.upper),
        t.rule("final_answer", "body", "MC_FINAL_ANSWER", F.upper),
        t.rule("tail_claim", "tail", "MC_TAIL_CLAIM", F.upper),
        t.rule("weak_tail", "tail", "MC_WEAK_TAIL", F.upper),
    ]


def _yes_no(t: _Texts) -> list[Column]:
    return [
        t.rule("final_result", "body", "YN_FINAL_RESULT", yes_no_word),
        t.rule("final_answer", "body", "YN_FINAL_ANSWER", yes_no_word),
        t.rule("tail_claim", "tail", "YN_TAIL_CLAIM", yes_no_word),
        t.rule("weak_tail", "tail", "YN_WEAK_TAIL", yes_no_word),
        t.rule("final_result", "body", "AB_FINAL_RESULT", yes_no_letter),
        t.rule("final_answer", "body", "AB_FINAL_ANSWER", yes_no_letter),
        t.rule("tail_claim", "tail", "AB_TAIL_CLAIM", yes_no_letter),
        t.rule("weak_tail", "tail", "AB_WEAK_TAIL", yes_no_letter),
    ]


def _math(t: _Texts) -> list[Column]:
    # An empty box counts as found: the row is unparsed and later rules stay off.
    boxed = let(
        last_boxed(t.body),
        lambda b: F.when(
            b.isNotNull(),
            F.struct(
                strip(b["content"]).alias("answer"),
                F.lit("boxed").alias("source"),
                b["span"].alias("span"),
            ),
        ),
    )
    return [
        t.rule("final_result", "body", "MATH_FINAL_RESULT", clean_math_token),
        boxed,
        t.rule("final_answer", "body", "MATH_FINAL_ANSWER", clean_math_token),
        t.rule("tail_claim", "tail", "MATH_TAIL_CLAIM", clean_math_token),
        t.rule("weak_tail", "tail", "MATH_NUMBER_TAIL", lambda a: a),
    ]


def _settle(f: Column, answer: Column) -> Column:
    """Final struct; an answer that cleans to nothing makes the row unparsed."""
    hit = f.isNotNull() & (F.length(answer) > 0)
    confidence = F.lit(0.0)
    for source, value in CONFIDENCE.items():
        confidence = F.when(f["source"] == source, F.lit(value)).otherwise(confidence)
    return F.struct(
        F.when(hit, answer).alias("answer"),
        F.when(hit, f["source"]).otherwise(F.lit("none")).alias("source"),
        F.when(hit, confidence).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(hit, strip(f["span"])).otherwise(F.lit("")).alias("raw_span"),
    )


def with_extracted(
    df: DataFrame, text: str, task_type: str, target: str = "extracted"
) -> DataFrame:
    """Add the struct (answer, source, confidence, raw_span) for cleaned text.

    The prepared text and its tail are columns of their own, so each is built
    once per row, and only the rules of the row's task type are evaluated.
    """
    odd, plain, bare, tail, low, low_tail, found, answer = (
        f"__{target}_{part}" for part in ("odd", "plain", "bare", "tail", "low", "low_tail", "found", "answer")
    )
    task, raw = F.col(task_type), F.coalesce(F.col(text), F.lit(""))
    is_math = F.coalesce(task == "math", F.lit(False))
    texts = _Texts(bare, tail, low, low_tail)
    choice = F.when(task.isin("multiple_choice", "mixed"), F.coalesce(*_mc(texts)))
    word = F.when(task.isin("yes_no", "mixed"), F.coalesce(*_yes_no(texts)))
    maths = F.when(is_math, F.coalesce(*_math(texts)))

    def prepared(value: Column, otherwise: Column) -> Column:
        return F.when(F.col(odd), value).otherwise(otherwise)

    return (
        df.withColumn(odd, raw.rlike(UNPREPARED))
        .withColumn(plain, prepared(without_marks(F.col(text)), raw))
        .withColumn(
            bare,
            prepared(
                F.when(is_math, half_width_colon(F.col(plain))).otherwise(answer_markup(F.col(plain))),
                F.col(plain),
            ),
        )
        .withColumn(tail, prepared(tail_lines(F.col(bare)), F.col(bare)))
        .withColumn(low, prepared(folded(F.col(bare)), F.lower(bare)))
        .withColumn(low_tail, prepared(folded(F.col(tail)), F.col(low)))
        .withColumn(found, F.coalesce(choice, word, maths))
        .withColumn(answer, clean_token(F.col(f"{found}.answer")))
        .withColumn(target, _settle(F.col(found), F.col(answer)))
        .drop(odd, plain, bare, tail, low, low_tail, found, answer)
    )
