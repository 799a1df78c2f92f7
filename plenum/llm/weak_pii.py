"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Base spans (four fixed patterns with their checks) always count.  Looser
patterns give further candidates: numbers, obfuscated addresses, credentials,
account numbers, names.  Labelers of three kinds vote on every candidate, for,
against or not at all: patterns and checksums, gazetteers, and words of the
context.  Expectation-maximisation over the votes of all documents (Dawid and
Skene) estimates each labeler's reliability and a posterior per candidate; a
logistic span classifier is then trained on the posteriors, from votes and
shape, and adds the candidates it accepts.

Votes and shape of a candidate are one small code, so training only needs the
count of each code: the counts cover all documents and their number is bounded.
"""

from __future__ import annotations

import re
from bisect import bisect
from hashlib import sha256
from unicodedata import normalize

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.llm.common import saved

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "national", "iban", "name")
THRESHOLD = 0.5
CONTEXT = 32

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        total += digit if place % 2 == 0 else (2 * digit - 9 if digit > 4 else 2 * digit)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, leftmost and non-overlapping per kind, in order.

    An address is found from its ``@``: its local part reaches back to the last
    address or the first other character, as the leftmost match would.
    """
    found, free = [], 0
    if "@" in text:
        for m in _AT.finditer(text):
            start = m.start()
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append((start, 0, m.end()))
                free = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0")[:4] or 0) <= 255 for part in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := _digits(m.group())) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# ---------------------------------------------------------------- candidates
_NATIONAL = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
_LOOSE = (
    (2, re.compile(r"(?<![0-9A-Za-z.+])[0-9]{12,19}(?![0-9A-Za-z])")),
    (3, re.compile(r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,4}\)?(?:[\x20.-][0-9]{2,4}){2,4}(?![0-9A-Za-z])")),
    (5, _NATIONAL),
    (6, re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
)
_HIDDEN_AT = re.compile(r"(?ai)\x20?[\[(]at[\])]\x20?|\x20at\x20")
_HIDDEN_DOT = re.compile(r"(?ai)[\[(]dot[\])]|\x20dot\x20")
_HIDDEN_DOMAIN = re.compile(r"(?ai)[A-Za-z0-9-]{1,63}(?:(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{1,63}){1,8}")
_SECRET = re.compile(r"(?i)(?<![a-z])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9+/_=-]{12,})")


def _ranges(wanted) -> str:
    """Body of a character class of all letters that ``wanted`` holds for."""
    codes = [c for c in range(0x20000) if chr(c).isalpha() and wanted(chr(c))]
    breaks = [0, *(i for i in range(1, len(codes)) if codes[i] != codes[i - 1] + 1), len(codes)]
    return "".join(f"{chr(codes[i])}-{chr(codes[j - 1])}" for i, j in zip(breaks, breaks[1:]))


# Upper- and lower-case letters of all scripts; accents may be characters of their own.
_UPPER, _LOWER = _ranges(str.isupper), _ranges(str.islower) + "\u0300-\u036f"
_NAME_WORD = f"[{_UPPER}][{_LOWER}]+"
# Pairs may overlap: of three capitalised words both pairs are candidates.
_NAME = re.compile(rf"(?<![^\W\d_])(?=({_NAME_WORD}\.?\x20{_NAME_WORD})(?![^\W\d_])){_NAME_WORD}")

# Gazetteers, fixed lists.
TITLES = frozenset("Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Sr Sra".split())
FIRST_NAMES = frozenset(
    "James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth "
    "Barbara Susan Jessica Sarah Karen Daniel Matthew Anthony Mark Paul Steven Andrew Kevin Brian George Nancy Lisa "
    "Anna Emma Maria Laura Peter Hans Klaus Jürgen Wolfgang Ursula Petra Monika Pierre Jean Michel Philippe Nathalie "
    "Isabelle Sophie Carlos Juan José Luis Antonio Manuel Carmen Ana Isabel Lucía Pablo Javier".split()
)
DOMAINS = frozenset("com org net edu gov io de fr es it uk eu info biz co us ch at nl".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92".split())
FOR = {
    "email": "email mail contact write correo courriel", "ip": "ip address host server adresse", "card": "card visa mastercard credit karte carte tarjeta",
    "phone": "phone tel call mobile fax telefon téléphone teléfono", "secret": "token secret password key login", "national": "ssn social passport id steuer dni insee",
    "iban": "iban account bank konto compte cuenta", "name": "name named signed author dear mr mrs ms dr prof",
}
_FOR = {kind: re.compile(r"(?i)\b(?:" + "|".join(words.split()) + r")\b") for kind, words in FOR.items()}
_AGAINST = re.compile(r"(?i)\b(?:version|release|page|chapter|figure|table|section|isbn|issn|order|invoice|item|license|price|total|year)\W{0,3}$|[$€£#v]\s?$")

LABELERS = ("pattern", "checksum", "gazetteer", "context_for", "context_against", "surroundings")


def _iban(text: str) -> bool:
    plain = text.replace(" ", "")
    moved = plain[4:] + plain[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _checksum(kind: str, text: str) -> int:
    digits = _digits(text)
    if kind == "card":
        return 1 if 12 <= len(digits) <= 19 and luhn(digits) else -1
    if kind == "phone":
        return 1 if 9 <= len(digits) <= 15 and not _NATIONAL.fullmatch(text) else -1
    if kind == "iban":
        return 1 if _iban(text) else -1
    if kind == "national":
        return -1 if digits[:3] in ("000", "666") or digits[3:5] == "00" else 1
    if kind == "secret":
        return 1 if len(set(text)) >= 8 and digits else -1
    return 0


def _gazetteer(kind: str, text: str) -> int:
    if kind == "email":
        return 1 if text.rpartition(".")[2].lower() in DOMAINS else -1
    if kind == "phone":
        if not text.startswith("+"):
            return 0
        digits = _digits(text)
        return 1 if any(digits[:n] in CALLING_CODES for n in (1, 2)) else -1
    if kind == "name":
        first = normalize("NFC", text.split()[0].rstrip("."))
        return 1 if first in FIRST_NAMES or first in TITLES else -1
    return 0


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """One vote of each labeler: 1 for, -1 against, 0 for none."""
    left, span = text[max(0, start - CONTEXT) : start], text[start:end]
    before, after = text[start - 1 : start], text[end : end + 1]
    apart = not (before.isalnum() or after.isalnum())
    listed, against = _gazetteer(kind, span), bool(_AGAINST.search(left))
    if kind == "name":
        # a full stop after a word that is no known title or name mostly ends a sentence
        against = against or (listed < 0 and ". " in span)
    return (
        1 if base else 0,
        _checksum(kind, span),
        listed,
        1 if _FOR[kind].search(left) else 0,
        -1 if against else 0,
        1 if apart else -1,
    )


def _shape(span: str) -> int:
    """Four bits: long, mostly digits, has letters, has blanks."""
    digits = len(_DIGIT.findall(span))
    return (len(span) > 20) + 2 * (2 * digits > len(span)) + 4 * any(map(str.isalpha, span)) + 8 * (" " in span)


def _loose(text: str) -> list[tuple[int, int, int]]:
    found = []
    if _DIGIT.search(text):
        for kind, pattern in _LOOSE:
            found += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
    if "=" in text or ":" in text:
        found += [(m.start(1), 4, m.end(1)) for m in _SECRET.finditer(text)]
    for m in _HIDDEN_AT.finditer(text):
        start = m.start()
        while start and text[start - 1] in _LOCAL:  # runs before two marks never overlap
            start -= 1
        domain = _HIDDEN_DOMAIN.match(text, m.end())
        if start < m.start() and domain:
            # "at" and a plain dot alone are prose, unless a word of the context speaks for an address
            plain = m.group().strip().isalpha() and not _HIDDEN_DOT.search(domain.group())
            if not plain or _FOR["email"].search(text[max(0, start - CONTEXT) : start]):
                found.append((start, 0, domain.end()))
    for m in _NAME.finditer(text):
        # of all capitalised pairs, those that the lists or the context speak for; no labeler knows anything for the others
        start, end = m.span(1)
        if _gazetteer("name", m.group(1)) > 0 or _FOR["name"].search(text[max(0, start - CONTEXT) : start]):
            found.append((start, 7, end))
    return found


def candidates(text: str) -> list[tuple[int, int, int, bool, int]]:
    """(start, kind number, end, base, code); no loose candidate overlaps a base span."""
    base = base_spans(text)
    out = [(s, k, e, True) for s, k, e in base]
    taken = sorted((s, e) for s, _, e in base)
    at = 0
    for s, k, e in sorted(set(_loose(text))):
        while at < len(taken) and taken[at][1] <= s and (at + 1 == len(taken) or taken[at + 1][0] <= s):
            at += 1
        if not any(a < e and s < b for a, b in taken[max(0, at - 4) : at + 5]):
            out.append((s, k, e, False))
    rows = []
    for s, k, e, is_base in out:
        code = 0
        for vote in votes(text, KINDS[k], s, e, is_base):
            code = 3 * code + vote + 1
        rows.append((s, k, e, is_base, 16 * code + _shape(text[s:e])))
    return rows


# ------------------------------------------------------------------ training
def _votes_of(code: np.ndarray) -> np.ndarray:
    code, out = code // 16, np.empty((len(code), len(LABELERS)), dtype=np.int64)
    for at in range(len(LABELERS) - 1, -1, -1):
        out[:, at], code = code % 3 - 1, code // 3
    return out


def label_model(kinds: np.ndarray, vote: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each row and reliabilities[kind, labeler, class, vote + 1], by EM on weighted rows.

    Starts from the majority of the votes; one added count per outcome keeps
    rare votes from certainty.
    """
    posterior = 1 / (1 + np.exp(-1.5 * vote.sum(1)))
    reliability = np.full((len(KINDS), vote.shape[1], 2, 3), 1 / 3)
    for _ in range(rounds):
        log_odds = np.zeros(len(vote))
        for kind in range(len(KINDS)):
            rows = kinds == kind
            if not rows.any():
                continue
            shares = np.stack([(1 - posterior[rows]) * weight[rows], posterior[rows] * weight[rows]])
            total = shares.sum(1) + 1
            log_odds[rows] = np.log(total[1] / total[0])
            for at in range(vote.shape[1]):
                counts = np.stack([np.bincount(vote[rows, at] + 1, weights=share, minlength=3) for share in shares]) + 1
                reliability[kind, at] = counts / counts.sum(1, keepdims=True)
                ratio = np.log(reliability[kind, at, 1] / reliability[kind, at, 0])
                log_odds[rows] += ratio[vote[rows, at] + 1]
        posterior = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    return posterior, reliability


def _design(kinds: np.ndarray, code: np.ndarray) -> np.ndarray:
    shape = (code[:, None] >> np.arange(4)) & 1
    return np.column_stack([np.eye(len(KINDS))[kinds], _votes_of(code), shape])


def span_classifier(kinds: np.ndarray, code: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic model fitted to soft targets by Newton steps with a ridge of one."""
    x, share = _design(kinds, code), weight / max(1.0, weight.sum()) * min(weight.sum(), 1e6)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - target)) + w
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w = w - np.linalg.solve(curve, slope)
    return w


def train(counts: pd.DataFrame) -> dict[tuple[int, int], float]:
    """Probability of every (kind, code) that occurs, from the counts of all of them."""
    if counts.empty:
        return {}
    counts = counts.sort_values(["kind", "code"])
    kinds, code = counts["kind"].to_numpy(np.int64), counts["code"].to_numpy(np.int64)
    weight = counts["n"].to_numpy(np.float64)
    posterior, _ = label_model(kinds, _votes_of(code), weight)
    w = span_classifier(kinds, code, posterior, weight)
    p = 1 / (1 + np.exp(-np.clip(_design(kinds, code) @ w, -30, 30)))
    return {(int(k), int(c)): float(v) for k, c, v in zip(kinds, code, p)}


# ------------------------------------------------------------------- queries
_SPAN = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("base", T.BooleanType()),
        T.StructField("code", T.IntegerType()),
    ]
)


@F.pandas_udf(T.ArrayType(_SPAN))
def _candidates(texts: pd.Series) -> pd.Series:
    rows = []
    for raw in texts:
        found = candidates((raw or b"").decode("utf-8", "replace"))
        rows.append([dict(zip(_SPAN.names, span)) for span in found])
    return pd.Series(rows, dtype=object)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


_RESULT = T.StructType(
    [T.StructField(f"n_{kind}", T.LongType()) for kind in BASE_KINDS]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
)


def find(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Offsets are code points, ends exclusive; spans lists base and added spans
    by start, then kind as in ``KINDS``.  An added span overlaps no base span
    and, of those that overlap each other, the likelier and then the earlier
    stays.  Null and empty texts have no spans; repeated rows get equal rows; a
    null doc_id is returned as such; other columns are not touched.
    """
    found = saved(documents.select("doc_id", _candidates(F.col("text").cast("binary")).alias("found")), "span-candidates")
    # at most kinds x 3^labelers x 16 rows
    counts = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.code").agg(F.count("*").alias("n")).toPandas()
    chance = train(counts)

    @F.pandas_udf(_RESULT)
    def result(rows: pd.Series) -> pd.DataFrame:
        out = []
        for spans in rows:
            base = [(c["start"], c["kind"], c["end"]) for c in spans if c["base"]]
            loose = [(-chance[c["kind"], c["code"]], c["start"], c["kind"], c["end"]) for c in spans if not c["base"]]
            added: list[tuple[int, int, int]] = []  # in order, apart from each other
            for _, s, k, e in sorted(x for x in loose if -x[0] >= threshold):
                at = bisect(added, (s,))
                if (at == 0 or added[at - 1][2] <= s) and (at == len(added) or e <= added[at][0]):
                    added.insert(at, (s, k, e))
            kinds = [k for _, k, _ in base]
            digest = sha256(joined(base).encode()).hexdigest()
            out.append((*(kinds.count(k) for k in range(len(BASE_KINDS))), digest, joined(base + added)))
        return pd.DataFrame(out, columns=_RESULT.names)

    return found.select("doc_id", result("found").alias("r")).select("doc_id", "r.*")
