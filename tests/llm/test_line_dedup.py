import random
from itertools import combinations

from plenum.llm import line_dedup
from plenum.llm.line_dedup import within

from .conftest import ODD


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    random.seed(2)
    for _ in range(4000):
        a = "".join(random.choices("ab", k=random.randint(0, 12)))
        b = list(a)
        for _ in range(random.randint(0, 5)):
            at = random.randint(0, len(b))
            b[at : at + random.randint(0, 1)] = random.choices("abé", k=random.randint(0, 1))
        b = "".join(b)
        for edits in (0, 1, 2, 3):
            assert within(a, b, edits) == (distance(a, b) <= edits)


def places(rows):
    """Lines by document; rows with equal id and text are one document."""
    out = {}
    for doc, text in rows:
        for at, line in enumerate((text or "").split("\n")):
            if len(line) >= 20:
                out[(doc, text, at)] = line
    return out


def brute(rows):
    lines = places(rows)
    texts = sorted(set(lines.values()))
    links = [(a, b) for a, b in combinations(texts, 2) if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2]
    top = {t: t for t in texts}

    def find(t):
        while top[t] != t:
            t = top[t]
        return t

    for a, b in links:
        top[find(a)] = find(b)
    degree = {t: sum(t in pair for pair in links) for t in texts}
    sizes = {}
    for t in lines.values():
        sizes[find(t)] = sizes.get(find(t), 0) + 1
    return {key: (degree[t], find(t)) for key, t in lines.items()}


def noisy(seed):
    random.seed(seed)
    bases = ["".join(random.choices("abcdé ", k=random.randint(20, 60))) for _ in range(12)]
    rows = []
    for doc in range(40):
        lines = []
        for _ in range(random.randint(0, 4)):
            line = list(random.choice(bases))
            for _ in range(random.choice([0, 0, 1, 2, 3])):
                at = random.randrange(len(line))
                line[at : at + random.randint(0, 1)] = random.choices("abcx", k=random.randint(0, 1))
            lines += ["".join(line), random.choice(["", "short", "   "])]
        rows.append((doc, "\n".join(lines)))
    return rows


def check(make, rows, **options):
    wanted = brute(rows)
    got = line_dedup.duplicate_lines(make(rows), **options).collect()
    texts = {(-1 if d is None else d, at): t for (d, t, at) in wanted for d, t, at in [(d, (d, t, at), at)]}
    seen = {}
    for r in got:
        degree, root = wanted[texts[r["k_id"], r["line_no"]]]
        assert r["n_links"] == degree
        name = (r["class_k_id"], r["class_line_no"])
        assert seen.setdefault(root, name) == name
        assert r["kept"] == ((r["k_id"], r["line_no"]) == name)
        assert name <= (r["k_id"], r["line_no"])
    assert len(set(seen.values())) == len(seen)
    assert len(got) == len(wanted)


def test_against_brute_force(make):
    for seed in (1, 2):
        check(make, noisy(seed))
    check(make, noisy(3), broadcast_rows=0)


def test_odd_rows(make, odd, none):
    got = line_dedup.duplicate_lines(odd).collect()
    kept = {(r["k_id"], r["line_no"]): r["kept"] for r in got}
    assert kept[(-1, 0)] and kept[(3, 0)]
    assert [r["kept"] for r in got if r["k_id"] == 4] == [True, True]  # repeated rows are one document
    assert line_dedup.duplicate_lines(none).collect() == []
    cut = line_dedup.drop_duplicate_lines(odd)
    assert cut.columns == odd.columns
    texts = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in cut.collect()), key=repr)
    wanted = [(i, t, None if t is None else len(t)) for i, t in ODD]
    wanted[6] = (5, "", 0)
    assert texts == sorted(wanted, key=repr)
    assert line_dedup.drop_duplicate_lines(none).collect() == []


def test_lines_that_share_a_passage_are_not_paired(make):
    passage = "a passage that every one of these many lines begins with, word for word, "
    rows = [(i, passage + "".join(random.Random(i).choices("abcdefghijkl", k=24))) for i in range(300)]
    assert all(r["kept"] for r in line_dedup.duplicate_lines(make(rows)).collect())


SHORT = [
    (1, "Share this\n\n   \n分享这篇文章。\nno copy here"),
    (2, "Share this\n\n分享这篇文章。\nShare that\n\u3000"),
    (2, "another text of id two\nShare this"),
    (3, "Share this\nShare this\n\u3000\n   "),
    (4, "a line that is long enough for the edit join\nShare this"),
    (5, "a line that is long enough for the edit joint"),
]


def test_exact_copies_of_short_lines(make):
    for broadcast_rows in (line_dedup.BROADCAST_ROWS, 0):
        got = line_dedup.duplicate_lines(make(SHORT), short=True, broadcast_rows=broadcast_rows).collect()
        assert len(got) == sum(bool(line.strip()) for _, t in SHORT for line in t.split("\n"))
        assert all(r["n_links"] == 0 for r in got if r["k_id"] in (1, 2, 3))
        assert {(r["class_k_id"], r["class_line_no"]) for r in got if r["k_id"] == 3} == {(1, 0)}
        assert sum(r["kept"] for r in got) == 5 + 1  # five short or long texts of their own, and the class of the long pair
    texts = sorted((r["doc_id"], r["text"]) for r in line_dedup.drop_duplicate_lines(make(SHORT)).collect())
    assert texts == [
        (1, SHORT[0][1]),
        (2, "\nShare that\n\u3000"),
        (2, "another text of id two"),
        (3, "\u3000\n   "),
        (4, "a line that is long enough for the edit join"),
        (5, ""),
    ]


def test_query_has_rows_of_short_lines(llm, make, tmp_path):
    from plenum.llm.queries import QUERIES

    make(SHORT).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op8_line_dedup"](llm, str(tmp_path)).collect()
    assert len(got) == sum(bool(line.strip()) for _, t in SHORT for line in t.split("\n"))
    assert sum(not r["kept"] for r in got) == 7


def test_variants_meet_within_the_distance():
    rng = random.Random(8)
    for _ in range(2000):
        a, b = ("".join(rng.choices("ab", k=rng.randint(0, 7))) for _ in range(2))
        shared = bool(line_dedup.variants(a, 2) & line_dedup.variants(b, 2))
        assert shared or distance(a, b) > 2


def family(numbers, width=4):
    return [(i, f"Page {n:0{width}d} of the yearly report of the house") for i, n in enumerate(numbers)]


def test_families_of_numbered_lines(make):
    rng = random.Random(9)
    rows = family(rng.sample(range(9000), 60))
    rows += [(100 + i, t.replace("house", "hours")) for i, t in rows[:10]] + [(200 + i, t.replace("report", "reports")) for i, t in rows[10:20]]
    rows += [(300 + i, t + "!" * (i % 3)) for i, t in rows[20:30]] + [(400 + i, t) for i, t in noisy(4)[:10]]
    check(make, rows, family=8, sampled=1)
    check(make, rows, family=8, sampled=1, broadcast_rows=0)
    check(make, [(i, t) for i, t in enumerate(t for _, t in noisy(5))], family=2, sampled=1)


def test_the_work_of_a_family_does_not_grow_with_its_square(make, monkeypatch):
    made = []
    plain = line_dedup._family_links
    monkeypatch.setattr(line_dedup, "_family_links", lambda m, t, e: made.append(m.count()) or plain(m, t, e))
    rows = family(range(0, 100_000, 50), 6)  # 2,000 lines, few of them within two edits
    got = line_dedup.duplicate_lines(make(rows)).collect()
    assert made and len(got) == 2000
    numbers = [t[5:11] for _, t in rows]
    links = {i: 0 for i in range(2000)}
    for i in range(0, 2000, 40):
        links[i] = sum(i != j and distance(numbers[i], numbers[j]) <= 2 for j in range(2000))
        assert next(r["n_links"] for r in got if r["k_id"] == i) == links[i]
