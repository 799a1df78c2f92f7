import random
from itertools import combinations

from pyspark.sql import functions as F

from plenum.llm import license_scan
from plenum.llm.license_scan import COVERAGE, Templates, _longest_rising, align, words
from plenum.llm.license_texts import TEMPLATES

from .conftest import ODD


MIT = next(text.replace("{", "").replace("}", "") for name, text in TEMPLATES if name == "MIT" and text.startswith("{Permission"))


def test_longest_rising_run():
    rng = random.Random(1)
    for _ in range(300):
        values = rng.sample(range(30), rng.randint(0, 8))
        best = max(k for k in range(len(values) + 1) for c in combinations(values, k) if list(c) == sorted(c))
        got = _longest_rising(values)
        assert len(got) == best and got == sorted(got) and [values[i] for i in got] == sorted(values[i] for i in got)


def test_alignment_is_common_and_ordered():
    rng = random.Random(2)
    for _ in range(300):
        a, b = (rng.choices("abcdefgh", k=rng.randint(0, 14)) for _ in range(2))
        pairs = align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
    text = words(MIT)
    assert len(align(text, text)) == len(text)


def unmarked(known, number):
    """Places of words that may be missing."""
    marked = {at for a, b in known.runs[number] for at in range(a, b)}
    return [at for at in range(len(known.words[number])) if at not in marked]


def test_probes_find_every_stretch_that_covers_enough():
    known, rng = Templates(), random.Random(3)
    for number, template in enumerate(known.words):
        for _ in range(20):
            free = unmarked(known, number)
            drop = set(rng.sample(free, min(len(free), len(template) - known.needed(number))))
            text = rng.choices("qwxyz", k=40) + [w for at, w in enumerate(template) if at not in drop] + rng.choices("qwxyz", k=40)
            ranges = known.stretches(text)[number]
            first, last = 40, 40 + len(template) - len(drop)
            assert any(a <= first and last <= b for a, b in ranges)


def spans(df):
    return {r["doc_id"]: [(s["license"], s["start"], s["end"]) for s in r["found"]] for r in license_scan.scan(df).collect()}


def test_documents(make, none):
    rows, rng = list(ODD), random.Random(4)
    wanted = {}
    for i, (name, text) in enumerate(TEMPLATES):
        filler = " ".join("".join(rng.choices("qwxyz", k=5)) for _ in range(300)) + ". "
        text = text.replace("{", "").replace("}", "")
        body = " ".join(text.split()).upper() if i % 2 else text
        rows.append((100 + i, filler + body + " " + filler))
        low = body.rstrip(".")
        wanted[100 + i] = (name, len(filler), len(filler) + len(low))
    rows.append((300, "İİ Released under the MIT License. And again: released under the  MIT   license"))
    got = spans(make(rows))
    for i, span in wanted.items():
        assert span in got[i] or [s[0] for s in got[i]] == [span[0]], (i, got[i], span)
    assert got[300] == [("MIT", 3, 33), ("MIT", 46, 79)]
    assert all(not got[i] for i, _ in ODD)
    assert spans(none) == {}
    # words taken out or put in lower the coverage, down to the limit
    text = MIT.split()
    head, tail = text[:17], text[17:]  # the marked words stay
    short = " ".join(head + [w for at, w in enumerate(tail) if at % 9 or not w.isalpha() or w in ("subject", "to", "the", "following")])
    half = " ".join(w for at, w in enumerate(text) if at % 2)
    found = license_scan.scan(make([(1, short), (2, half)])).select("doc_id", F.explode("found").alias("s")).collect()
    assert [(r["doc_id"], r["s"]["license"]) for r in found] == [(1, "MIT")] and COVERAGE <= found[0]["s"]["coverage"] < 1


def test_consecutive_copies_are_all_found():
    known, rng = Templates(), random.Random(6)
    filler = rng.choices(["qwx", "xyz", "zzw", "the", "of", "and"], k=400)
    for number, template in enumerate(known.words):
        for copies in (1, 2, 3, 50 if len(template) < 400 else 5):
            found = known.scan(filler + template * copies + filler)
            places = [400 + i * len(template) for i in range(copies)]
            assert [(first, last) for first, last, *_ in found] == [(p, p + len(template)) for p in places], (known.names[number], copies)


def test_consecutive_copies_with_gaps_are_all_found():
    known, rng = Templates(), random.Random(8)
    filler = rng.choices(["qwx", "xyz", "zzw"], k=100)
    for number, template in enumerate(known.words):
        free = unmarked(known, number)
        drop = free[len(free) // 2]  # one word out, the same in every copy; not one that names the license
        short = template[:drop] + template[drop + 1 :]
        if len(short) < known.needed(number) or len(template) > 400:
            continue
        for copies in (2, 3, 10):
            found = known.scan(filler + short * copies + filler)
            assert len(found) == copies, (known.names[number], copies)


def test_repeated_notices_in_prose():
    known = Templates()
    for line, name in (("Released under the MIT License.", "MIT"), ("Licensed under CC BY 4.0.", "CC")):
        for copies in (2, 3, 50):
            text = "some prose stands before it, as in any page\n" * 9 + f"{line}\n" * copies + "and some prose stands after it\n" * 9
            found = known.scan(words(text))
            assert len(found) == copies and all(n.startswith(name) for _, _, n, *_ in found), (line, copies)


NEAR_MISSES = (
    ("Released under the Apache License.", None),
    ("Licensed under the BSD License.", None),
    ("released under the same license as Perl", None),
    ("licensed under the Elastic License", None),
    ("Released under the BSD 4-Clause License.", "BSD-4-Clause"),
    ("This work is licensed under the GNU General Public License, version 1.", "GPL-1.0"),
    ("This work is licensed under the GNU General Public License, version 4.", None),
    ("Licensed under the GNU General Public License, version 2.1.", None),
    ("Licensed under CC BY 3.0.", "CC-BY-3.0"),
    ("Licensed under CC BY 4.1.", None),
    ("Licensed under CC BY-NX 4.0.", None),
    ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
    ("Licensed under the Apache License, Version 1.1", "Apache-1.1"),
    ("Licensed under the Apache License, Version 2.0", "Apache-2.0"),
    ("Licensed under the Apache License, Version 2", None),
    ("Released under the MIT No Attribution License.", "MIT-0"),
    ("Released under the MIT Licence, in another spelling.", None),
    ("licensed under the GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
    ("licensed under the GNU Lesser General Public License, version 3", "LGPL-3.0"),
    ("licensed under the GNU Affero General Public License, version 2", None),
    ("Permission is hereby granted to enter the building, free of charge, to any person.", None),
)


def test_near_misses_give_nothing_or_their_own_name():
    known = Templates()
    for text, name in NEAR_MISSES:
        for around in ("", "some words of prose stand here, the license of which is not told. " * 3):
            found = [n for _, _, n, *_ in known.scan(words(around + text + " " + around))]
            assert found == ([name] if name else []), (text, found)


def test_full_texts_of_like_licenses_are_told_apart():
    known = Templates()
    for number, name in enumerate(known.names):
        found = known.scan(known.words[number])
        assert [(first, last, n) for first, last, n, *_ in found] == [(0, len(known.words[number]), name)]
    four = next(t for n, t in TEMPLATES if n == "BSD-4-Clause" and "advertising" in t)
    three = next(t for n, t in TEMPLATES if n == "BSD-3-Clause" and "Neither" in t)
    holder = three.replace("the copyright holder", "Jane Doe and others").replace("{", "").replace("}", "")
    assert [n for _, _, n, *_ in known.scan(words(holder))] == ["BSD-3-Clause"]
    assert [n for _, _, n, *_ in known.scan(words(four.replace("organization", "University")))] == ["BSD-4-Clause"]


def plain_scan(known, text):
    """Every template aligned at every start and end, the best ones first."""
    hits = set()
    for number, template in enumerate(known.words):
        size = len(template)
        most = int(license_scan.STRETCH * size) + 4
        for start in range(len(text)):
            for stop in range(start + known.needed(number), min(len(text), start + most) + 1):
                pairs = align(text[start:stop], template)
                if len(pairs) < known.needed(number):
                    continue
                place = {q: start + p for p, q in pairs}
                run = [[place.get(at) for at in range(a, b)] for a, b in known.runs[number]]
                if any(None in r or r != list(range(r[0], r[0] + len(r))) for r in run):
                    continue
                first, last = start + pairs[0][0], start + pairs[-1][0] + 1
                hits.add((-len(pairs), -len(pairs) / size, last - first, first, last, known.names[number]))
    kept = []
    for aligned, share, _, first, last, name in sorted(hits):
        if all(last <= a or b <= first for a, b, *_ in kept):
            kept.append((first, last, name, -aligned, -share))
    return sorted(kept)


def test_whole_scan_against_plain_alignment():
    rng = random.Random(11)
    chosen = [t for t in TEMPLATES if t[0] in ("MIT", "MIT-0", "Apache-2.0", "Apache-1.1", "GPL-2.0", "GPL-3.0", "CC-BY-4.0", "CC-BY-NC-4.0")]
    known = Templates([t for t in chosen if len(words(t[1])) < 14])
    for _ in range(150):
        text = []
        for _ in range(rng.randint(1, 3)):
            text += rng.choices(["qwx", "the", "license", "mit", "under", "version", "cc", "2.0"], k=rng.randint(0, 6))
            notice = list(rng.choice(known.words))
            change = rng.random()
            if change < 0.3:
                del notice[rng.randrange(len(notice))]
            elif change < 0.6:
                notice.insert(rng.randrange(len(notice)), rng.choice(["new", "the", "license", "2.0"]))
            text += notice
        got, wanted = known.scan(text), plain_scan(known, text)
        # a wider range can align further opening words before a gap: the name and its place count
        assert [g[2] for g in got] == [w[2] for w in wanted], (text, got, wanted)
        assert all(w[0] <= g[0] and g[1] <= w[1] for g, w in zip(got, wanted)), (text, got, wanted)
