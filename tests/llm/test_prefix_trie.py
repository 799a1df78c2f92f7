import hashlib
import random
import zlib

import pytest
from pyspark.sql import types as T

from plenum.llm import prefix_trie

SCHEMA = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        # names that the operator uses inside
        *[T.StructField(name, T.StringType()) for name in ("base", "t", "path", "sizes", "shard", "number", "kind", "depth")],
    ]
)


@pytest.fixture
def turns(llm):
    return lambda rows: llm.createDataFrame([(*r, *["c"] * 8) for r in rows], SCHEMA)


def remainder(a, m):
    return a - m * int(a / m)


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()[:32]
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", digest, text or ""))
    convs = {c: [(r, x) for _, _, r, _, x in sorted(ts)] for c, ts in convs.items()}
    members, ends = {}, {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(convs.get(c - remainder(c, 5), [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    children = {}
    for q in members:
        if q:
            children.setdefault(q[:-1], []).append(q)
    out, leaves, saved = [], {}, {}
    for q in sorted(members, key=len, reverse=True):
        kids = children.get(q, [])
        leaves[q] = sum(leaves[k] for k in kids) if kids else 1
        saved[q] = sum(saved[k] for k in kids) + ((len(members[q]) - 1) * len(q[-1][1].encode()) if q else 0)
        listed = ",".join(map(str, sorted(ends.get(q, []))))
        out.append(
            (min(members[q]), len(q), min(members[q[:-1]]) if q else None, len(members[q]), len(kids), leaves[q], saved[q],
             hashlib.sha256(listed.encode()).hexdigest())
        )
    return sorted(out, key=repr)


def found(df, **more):
    return sorted((tuple(r) for r in prefix_trie.conversation_trie(df, **more).collect()), key=repr)


def some(rng, count, texts="ab"):
    rows = []
    for c in range(count):
        shape = rng.random()
        if shape < 0.3:  # one conversation that many ids share
            rows += [(c, k, "user", "hot") for k in range(3)]
        else:
            rows += [(c, k, rng.choice(["user", "assistant", None]), rng.choice([*texts, "é日", "", None])) for k in range(rng.randint(1, 7))]
    return rows


@pytest.mark.parametrize("shard_paths", [100_000, 40, 3])
def test_against_brute_force(llm, turns, monkeypatch, shard_paths):
    monkeypatch.setattr(prefix_trie, "LEAST_SHARD", 10**9 if shard_paths == 100_000 else 5)
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    rows = some(random.Random(shard_paths), 600)
    assert found(turns(rows), shard_paths=shard_paths) == brute(rows)


def test_odd_rows(turns, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LEAST_SHARD", 1)
    rows = [
        (None, 0, "user", "of no conversation"),
        (1, None, None, None), (1, 0, "user", "first"), (1, 0, "user", "first"), (1, 0, "user", "tie"), (1, 3, None, "x"),
        (5, 0, "u", "ser"), (6, 0, "us", "er"),  # the cut between role and text counts
        (-3, 0, "user", "below zero"), (-5, 0, "user", "base"), (-5, 1, "user", "more"), (-9, 2, "user", "base"),
        (2**62, 0, "user", "far"),
        *[(20, k, "user", f"long {k}") for k in range(3000)],
        *[(21, k, "user", f"long {k}") for k in range(3000)],
    ]
    assert found(turns(rows), shard_paths=2) == brute(rows)
    assert found(turns([])) == []
    assert found(turns([(None, 0, "a", "b")])) == []


def test_the_skeleton_holds_every_prefix_of_a_splitter():
    keys = [(b"a" * 16 + b"b" * 16, 3), (b"a" * 16, 7)]
    assert prefix_trie.skeleton_of(keys) == {b"": 0, b"a" * 16: 1, b"a" * 16 + b"b" * 16: 2}


def test_a_conversation_that_all_share_is_dealt_to_many_shards(llm, turns, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LEAST_SHARD", 1)
    rows = [(c, 0, "user", "same") for c in range(1000)]
    paths = prefix_trie.rebuilt(turns(rows))
    keys = prefix_trie.splitters(paths, 20)
    assert len(keys) >= 10 and len({p for p, _ in keys}) <= 2
    assert found(turns(rows), shard_paths=50) == brute(rows)
