import hashlib
import random
import re

from plenum.llm import decontaminate

from .conftest import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items):
    windows = {}
    for item, text in items:
        ws = words(text)
        size = min(13, len(ws))
        for at in range(len(ws) - size + 1 if ws else 0):
            windows.setdefault(tuple(ws[at : at + size]), set()).add(item)
    out = []
    for doc, text in rows:
        ws, hit, found = words(text), set(), set()
        for size in {len(w) for w in windows}:
            for at in range(len(ws) - size + 1):
                if tuple(ws[at : at + size]) in windows:
                    hit |= set(range(at, at + size))
                    found |= windows[tuple(ws[at : at + size])]
        ids = sorted(str(i) for i in found if i is not None)
        digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
        out.append((doc, len(ws), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(ws)))
    return sorted(out, key=repr)


def result(docs, items, **options):
    found = decontaminate.contamination(docs, items, **options)
    return sorted((tuple(r)[:6] for r in found.collect()), key=repr)


def items_of(llm, rows):
    return llm.createDataFrame(rows, "item_id long, text string").selectExpr("*", "item_id AS pos", "text AS words", "1 AS h")


def case():
    random.seed(8)
    vocabulary = ["the", "of", "Ab", "c1", "é", "日本", "x"]
    say = lambda n: " ".join(random.choices(vocabulary, k=n))
    items = [(i, say(random.choice([1, 2, 4, 6, 13, 14, 30]))) for i in range(20)]
    items += [(3, items[7][1]), (None, say(15)), (50, None), (51, ""), (52, "..."), (7, items[7][1])]
    rows = list(ODD)
    for i in range(60):
        parts = [say(random.randint(0, 25))]
        if i % 2:
            parts += [random.choice(items)[1] or "", say(random.randint(0, 300))]
        rows.append((100 + i, ", ".join(parts)))
    return rows, items


def test_against_brute_force(llm, make):
    rows, items = case()
    wanted = brute(rows, items)
    assert result(make(rows), items_of(llm, items)) == wanted
    # a benchmark beyond one broadcast goes in blocks
    assert result(make(rows), items_of(llm, items), broadcast_shingles=7) == wanted


def test_long_windows_only(llm, make):
    rows, items = case()
    items = [i for i in items if len(words(i[1])) > 12]
    assert result(make(rows), items_of(llm, items)) == brute(rows, items)


def test_empty_tables(llm, odd, none):
    empty = items_of(llm, [])
    assert result(odd, empty) == brute(ODD, [])
    assert result(none, items_of(llm, [(1, "a b c")])) == []
    assert decontaminate.keep_clean(odd, empty).count() == len(ODD)


def test_clean_rows_stay(llm, make):
    rows, items = case()
    bad = {r[0] for r in brute(rows, items) if r[5]}
    kept = decontaminate.keep_clean(make(rows), items_of(llm, items))
    assert kept.columns == make([]).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((i for i, _ in rows if i not in bad), key=repr)


def test_no_python_in_the_plan(llm, make):
    rows, items = case()
    plan = decontaminate.contamination(make(rows), items_of(llm, items))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
