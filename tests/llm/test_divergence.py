import collections
import random
import re

import numpy as np

from plenum.llm import divergence

from .conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    count = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    hit = {at for k in range(len(words) - 7) if count[tuple(words[k : k + 8])] > 1 for at in range(k, k + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), failed


def fixture():
    rng = random.Random(9)
    rows, vocabulary = [], {lang: [f"{lang}{i}" for i in range(200)] for lang in ("ab", "cd")}
    for i in range(120):
        lang = ("ab", "cd")[i % 2]
        words = [vocabulary[lang][min(199, int(rng.expovariate(0.03)))] for _ in range(rng.randint(5, 400))]
        if i % 6 == 0:
            words += words[:9] * rng.randint(0, 5)
        text = re.sub(r" (?=\w*1 )", "\n", " ".join(words))
        rows.append((i, text, lang))
    junk = " ".join(f"@{rng.randint(0, 10**9)}^~" for _ in range(150))
    rows += [(500, junk, "ab"), (501, junk, None), (502, rows[1][1], "zz"), (503, rows[2][1], None), (503, rows[2][1], None)]
    return rows


def judged(df):
    return collections.Counter((r["doc_id"], *[r[c] for c in divergence.RESULT.names[:6]]) for r in divergence.judge(df).collect())


def test_base_counts(make, none):
    rows = fixture() + [(i, t, None) for i, t in ODD]
    assert judged(make(rows)) == collections.Counter((i, *base(t)) for i, t, _ in rows)
    assert divergence.judge(none).collect() == []


def test_verdicts(make):
    rows = fixture()
    got = {r["doc_id"]: r for r in divergence.judge(make(rows)).collect()}
    assert not got[500]["kept"] and not got[501]["kept"]
    # a wrong or missing language is no reason to drop a document
    assert got[502]["kept"] == got[1]["kept"] and got[503]["kept"] == got[2]["kept"]
    assert all(r["kept"] != r["base_failed"] for i, r in got.items() if i < 500)


def test_distance_and_repeats():
    p, q = np.array([1.0, 0, 3]), np.array([2.0, 2, 0])
    m = (p / 4 + q / 4) / 2
    plain = sum(a * np.log2(a / b) for a, b in zip(p / 4, m) if a) + sum(a * np.log2(a / b) for a, b in zip(q / 4, m) if a)
    assert abs(divergence.js_distance(p, q) - np.sqrt(plain / 2)) < 1e-12
    assert divergence.js_distance(p, p) < 1e-7 and divergence.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1
    assert divergence.js_distance(np.zeros(2), np.ones(2)) == 0
    rng = random.Random(3)
    for _ in range(200):
        ids = np.array([rng.randint(0, 1) for _ in range(rng.randint(0, 40))], dtype=np.int64)
        count = collections.Counter(tuple(ids[k : k + 8]) for k in range(len(ids) - 7))
        assert divergence.repeated_words(ids) == len({a for k in range(len(ids) - 7) if count[tuple(ids[k : k + 8])] > 1 for a in range(k, k + 8)})


def test_references_cover_all_documents(make):
    rows = fixture()
    known = {r["lang"]: divergence.Reference(bytes(r["packed"])) for r in divergence.references(make(rows)).collect()}
    total = collections.Counter(w for _, t, lang in rows if lang == "ab" for w in WORD.findall(t))
    top = sorted(total.items(), key=lambda x: (-x[1], x[0]))[: divergence.COMMON_WORDS]
    assert known["ab"].words == [w.encode() for w, _ in top]
    assert known["ab"].counts.tolist() == [n for _, n in top] + [sum(total.values()) - sum(n for _, n in top)]


def test_no_language_is_without_its_reference(make):
    rng = random.Random(11)
    rows = [(i, " ".join(f"{rng.randrange(120)}w{i}" for _ in range(1000)), f"l{i}") for i in range(505)]
    assert all(r["kept"] for r in divergence.judge(make(rows)).collect())


def test_documents_far_from_their_language_meet_all_references(make, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 3)
    rng = random.Random(12)
    langs = [f"l{k}" for k in range(11)]
    text = lambda k, n: " ".join(f"{'xyz'[k % 3] * (k % 4)}{rng.randrange(60)}w{k}" for _ in range(n))
    rows = [(i, text(i % 11, rng.choice((30, 150, 300))), langs[i % 11]) for i in range(220)]
    rows += [(1000 + i, text(i % 14, 200), rng.choice([*langs, "unknown", None])) for i in range(80)]
    docs = make(rows)
    known = divergence.references(docs).collect()
    assert {r["lang"] for r in known} == set(langs)
    references = {r["lang"]: divergence.Reference(bytes(r["packed"])) for r in known}
    want = {}
    for i, content, lang in rows:
        found = divergence.Histograms(content.encode())
        each = {name: found.excess(reference) for name, reference in references.items()}
        own = each.get(lang)
        if own is None or max(own) > 0:
            own = min((max(e), name != lang, name, e) for name, e in each.items())[3]
        want[i] = own
    got = {r["doc_id"]: (r["char_excess"], r["word_excess"]) for r in divergence.judge(docs).collect()}
    assert got == want
    assert any(max(e) > 0 for e in want.values()) and sum(max(e) <= 0 for i, e in want.items() if i >= 1000) > 20


def test_without_references(make):
    got = divergence.judge(make([(1, "a b c", "en"), (2, None, None)])).collect()
    assert [(r["char_excess"], r["word_excess"], r["kept"]) for r in got] == [(0.0, 0.0, False)] * 2
