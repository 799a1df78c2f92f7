import random
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from plenum.llm import simhash

from .conftest import ODD


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [(i, plain(t)) for i, t in rows]
    parent = list(range(len(prints)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(prints)), 2):
        if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
            parent[top(a)] = top(b)
    least = {}
    for at, (i, _) in enumerate(prints):
        if i is not None:
            least[top(at)] = min(i, least.get(top(at), i))
    return sorted(((i, f"{p:016x}", least.get(top(at))) for at, (i, p) in enumerate(prints)), key=repr)


def result(df, **limits):
    found = simhash.near_duplicates(df, **limits).select("doc_id", simhash.as_hex(F.col("fingerprint")).alias("f"), "component_id")
    return sorted(map(tuple, found.collect()), key=repr)


def test_odd_rows(odd, none):
    assert result(odd) == brute(ODD)
    assert result(none) == []


def test_families_of_near_copies(make):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for family in range(12):
        base = random.choices(vocabulary, k=120)
        for _ in range(12):
            copy = list(base)
            for _ in range(random.randint(0, 2)):
                copy[random.randrange(120)] = random.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    assert result(make(rows)) == brute(rows)
    assert len({c for *_, c in result(make(rows))}) < len(rows)


def test_large_groups_link_like_pairs(llm):
    random.seed(6)
    centre = random.getrandbits(63)
    prints = {centre ^ (1 << random.randrange(62)) ^ (1 << random.randrange(62)) for _ in range(120)}
    df = llm.createDataFrame([(p,) for p in prints], "fp long")
    both = []
    for limit in (10_000, 3):
        edges = simhash.links(df, pair_group=limit).collect()
        assert all((r["a"] ^ r["b"]).bit_count() <= 2 and r["a"] < r["b"] for r in edges)
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, pair_group=limit)).collect()}
        both.append({p: roots.get(p, p) for p in prints})
    assert both[0] == both[1]


@pytest.mark.parametrize("distance", [0, 1, 3])
def test_large_groups_at_other_distances(llm, distance):
    rng = random.Random(distance)
    centre = rng.getrandbits(63)
    prints = {centre ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(12)) for _ in range(70)}
    df, both = llm.createDataFrame([(p,) for p in prints], "fp long"), []
    for limit in (10_000, 2):
        edges = simhash.links(df, distance=distance, pair_group=limit)
        assert all(0 < (r["a"] ^ r["b"]).bit_count() <= distance and r["a"] < r["b"] for r in edges.collect())
        roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
        both.append({p: roots.get(p, p) for p in prints})
    assert both[0] == both[1]


def test_one_of_each_group_stays(make, odd):
    rows = [(3, "a b c d"), (1, "a b c d"), (2, "A B C D"), (9, None), (8, ""), (None, "x y z"), (None, "x y z")]
    kept = simhash.keep_first(make(rows))
    assert kept.columns == odd.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(1, "a b c d"), (8, ""), (None, "x y z")], key=repr)
