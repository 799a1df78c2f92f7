import collections
import math
import random
import re
import time
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from plenum.llm import url_filter

PAGES = "page_id long, url string, html string"


def pages(llm, rows):
    df = llm.createDataFrame([(i, u, h) for i, u, h in rows], PAGES)
    for name in ("host", "path", "rule", "h", "p", "name", "odds", "word"):
        df = df.withColumn(name, df["url"])
    return df


def expected(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        end = min([at for at in map(rest.find, "/?#") if at >= 0], default=len(rest))
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = rest[: min([at for at in map(rest.find, "?#") if at >= 0], default=len(rest))]
    fits = [(len(h + p), h + p, a) for a, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


URLS = [
    "http://Example.com/en/1", "https://www.example.com/en/2?x=/", "http://blog.example.com/en", "http://a.net/es/x#y", "http://net/fr/",
    "http://notnet/fr/", "no scheme", None, "", "://", "http://", "http://x.org?q=://y/", "a://b://c/d", "http://ÀB.com/En/", "HTTP://com",
    "http://com/", "http://free-bets.example.org/de/1", "http://freebets.org/1", "http://casino.org/win", "http://garden.org/tomato/3",
]


def test_hosts_paths_and_rules(llm):
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(None, URLS[0], "x"), (3, URLS[3], "<p>y"), (3, URLS[3], "<p>y")]
    got = url_filter.judge(pages(llm, rows)).collect()
    assert len(got) == len(rows)
    seen = {r["page_id"]: r for r in got}
    for i, u in enumerate(URLS):
        host, path, rule, action = expected(u)
        assert (seen[i]["host"], seen[i]["path"], seen[i]["rule"]) == (host, path, rule), u
        if action:
            assert seen[i]["verdict"] == action
        assert seen[i]["verdict"] in ("allow", "block")


def test_model_learns_the_words_around_seeds(llm):
    html = "<html><script>var freebets</script><p>free bets garden tomato free bets win</p></html>"
    rows = [(i, f"http://{'free-bets' if i % 4 == 0 else 'garden-tomato'}.org/{i}", html) for i in range(200)]
    rows += [(900, "http://freebets.org/x", html), (901, "http://gardentomato.org/x", html)]
    got = {r["page_id"]: r for r in url_filter.judge(pages(llm, rows)).collect()}
    assert got[900]["verdict"] == "block" and got[901]["verdict"] == "allow"
    assert got[0]["verdict"] == "block" and got[1]["verdict"] == "allow"


def test_empty_tables(llm):
    assert url_filter.judge(pages(llm, [])).collect() == []


def test_viterbi_finds_the_best_of_all_splits():
    counts = {"free": 50, "bets": 20, "be": 300, "ts": 2, "freeb": 1, "e": 900, "a": 700}
    total = 5000.0

    def cost(word):
        return math.log(counts[word] / total) if word in counts else math.log(10 / total) - len(word) * math.log(10)

    for run in ("freebets", "abets", "eeeaa", "xfreex"):
        known = {(s, n): math.log(counts[run[s : s + n]] / total) for s in range(len(run)) for n in range(1, len(run) - s + 1) if run[s : s + n] in counts}
        best = -math.inf
        for k in range(len(run)):
            for cuts in combinations(range(1, len(run)), k):
                parts = [run[a:b] for a, b in zip((0, *cuts), (*cuts, len(run)))]
                best = max(best, sum(map(cost, parts)))
        got = url_filter.viterbi(run, known, total)
        assert "".join(got) == run and abs(sum(map(cost, got)) - best) < 1e-9


def test_words_of_any_length_stay_whole(llm):
    word = "donaudampfschifffahrtsgesellschaft"
    counts = llm.createDataFrame([(word, 40), ("win", 60), ("donau", 3)], "word string, n bigint")
    runs = llm.createDataFrame([(f"{word}win",), (f"win{word}",), ("x" * 3000 + word,)], "run string")
    got = {r["run"]: r["words"] for r in url_filter.segment(runs, counts).collect()}
    assert got == {f"{word}win": [word, "win"], f"win{word}": ["win", word], "x" * 3000 + word: ["x" * 3000, word]}


def words_of(llm, *htmls):
    df = llm.createDataFrame([(i, h) for i, h in enumerate(htmls)], "i int, html string")
    return [r["w"] for r in df.select("i", url_filter.page_words(F.col("html")).alias("w")).orderBy("i").collect()]


def test_visible_words(llm):
    assert words_of(
        llm, "<p>a b</p><script>no</script> c <STYLE x='1'>no</STYLE >d<!-- no --> e&nbsp;f", "a <script>no <p>no", "b <!-- no", "c <p no", "d < e > f", "", None
    ) == [["a", "b", "c", "d", "e", "f"], ["a"], ["b"], ["c"], ["d", "f"], [], None]


def test_unclosed_tags_take_time_in_proportion(llm):
    def seconds(count):
        began = time.perf_counter()
        words_of(llm, "<script>" * count, "<!--" * count, "<" * count, "<p " * count, "word &amp " * count)
        return time.perf_counter() - began

    seconds(100)
    assert seconds(80_000) < 10 + 10 * seconds(8_000)  # ten times the square would be a hundred


def mixed_urls():
    rng = random.Random(5)
    hosts = [f"{a}-{b}.org" for a in ("free", "garden", "tomato", "loan", "deep") for b in ("bets", "casino", "river", "stone")]
    hosts += ["freebets.org", "gardenriver.org", "rivercasino.net", "x.y", ""]
    return [f"http://{rng.choice(hosts)}/{rng.choice(('en', 'de/win', 'blog/river', '', 'win-win'))}/{k}" for k in range(150)] + [None, "no scheme"]


def plain_names(urls):
    """(h, p) of every url, and the words of every name, by plain counting."""
    shapes = []
    for url in urls:
        host, path = expected(url)[:2]
        shapes.append(("h " + " ".join(re.findall("[a-z]+", host)), "p " + " ".join(re.findall("[a-z]+", path))))
    counts = collections.Counter(word for shape in shapes for name in shape for word in name[2:].split())
    total = float(sum(counts.values()))
    words = {}
    for name in {name for shape in shapes for name in shape}:
        found = []
        for run in name[2:].split():
            cuts = ((s, n) for s in range(len(run)) for n in range(1, len(run) - s + 1))
            found += url_filter.viterbi(run, {(s, n): math.log(counts[run[s : s + n]] / total) for s, n in cuts if run[s : s + n] in counts}, total)
        words[name] = found
    return shapes, words


def plain_bayes(shapes, words, bad):
    """Log odds by (kind, word) and the log prior odds, from the given urls."""
    tokens = {side: collections.Counter() for side in (False, True)}
    for shape, side in zip(shapes, bad):
        tokens[side].update((name[0], word) for name in shape for word in words[name])
    size, sums = len(tokens[True] | tokens[False]), {side: sum(tokens[side].values()) for side in tokens}
    odds = {t: math.log((tokens[True][t] + 1) / (tokens[False][t] + 1) * (sums[False] + size) / (sums[True] + size)) for t in tokens[True] | tokens[False]}
    return odds, math.log((sum(bad) + 0.5) / (len(bad) - sum(bad) + 0.5))


def test_scores_are_those_of_plain_bayes(llm):
    urls = mixed_urls()
    shapes, words = plain_names(urls)
    bad = [any(word in url_filter.SEEDS for name in shape for word in words[name]) for shape in shapes]
    odds, prior = plain_bayes(shapes, words, bad)
    got = {r["page_id"]: r for r in url_filter.judge(pages(llm, [(k, u, None) for k, u in enumerate(urls)])).collect()}
    for k, shape in enumerate(shapes):
        score = prior + sum(odds[name[0], word] for name in shape for word in words[name])
        assert abs(got[k]["score"] - score) < 1e-9, urls[k]
        assert got[k]["rule"] is not None or got[k]["verdict"] == ("block" if score > 0 else "allow")
    assert 0 < sum(bad) < len(bad)


@pytest.mark.parametrize("by", [("h", "p"), ("h",)])
def test_masked_recall_is_that_of_plain_cross_validation(llm, by):
    urls = mixed_urls()
    shapes, words = plain_names(urls)
    distinct = llm.createDataFrame(sorted(set(shapes)), "h string, p string")
    fold = {(r["h"], r["p"]): r["f"] for r in distinct.withColumn("f", F.pmod(F.xxhash64(*by), F.lit(3))).collect()}
    bad = [any(word in url_filter.SEEDS for name in shape for word in words[name]) for shape in shapes]
    want = collections.defaultdict(lambda: [0, 0, 0, 0])
    for held in set(fold.values()):
        rest = [(shape, side) for shape, side in zip(shapes, bad) if fold[shape] != held]
        odds, prior = plain_bayes([r[0] for r in rest], words, [r[1] for r in rest])
        for shape, side in zip(shapes, bad):
            if fold[shape] == held:
                blocked = prior + sum(odds.get((name[0], word), 0) for name in shape for word in words[name] if word not in url_filter.SEEDS) > 0
                want[held] = [a + b for a, b in zip(want[held], (1, side, blocked, side and blocked))]
    got = url_filter.masked_recall(pages(llm, [(k, u, None) for k, u in enumerate(urls)]), folds=3, by=by).collect()
    assert {r["fold"]: [r[c] for c in ("urls", "seeded", "blocked", "both")] for r in got} == dict(want)
    assert url_filter.masked_recall(pages(llm, [])).collect() == []


def test_words_beside_the_seeds_find_masked_urls(llm):
    hosts = [f"http://{a}.org/{b}" for a in ("free-bets", "win-casino", "lucky-poker") for b in ("en", "de", "fr", "es", "it")] * 4
    hosts += [f"http://{a}-{b}.org/{c}" for a in ("garden", "river", "stone") for b in ("tomato", "music") for c in ("en", "de", "fr", "es", "it")] * 4
    found = url_filter.masked_recall(pages(llm, [(k, u, None) for k, u in enumerate(hosts)])).groupBy().sum("seeded", "blocked", "both").first()
    assert found["sum(seeded)"] == 60
    assert found["sum(both)"] >= 0.9 * 60 and found["sum(both)"] >= 0.9 * found["sum(blocked)"]
