"""URL filters: host and path rules, then naive Bayes over segmented names.

Where no rule decides, the letter runs of host and path are split into words
by a unigram Viterbi search (``freebets`` gives ``free bets``), and a
multinomial naive Bayes model scores the words.  Word counts come from the
text of all pages and from the delimited names of all urls.  The model is
trained on all urls: those with a seed word among their words stand for the
blocked class, the others for the allowed one; it then also weighs the words
around the seeds.

All of it works on distinct names: a host or a path shape is segmented and
scored once, however many pages carry it.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.llm.common import saved

# (action, host, path): fits the host and its subdomains if the path starts with it
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Fixed seed words of the blocked class.
SEEDS = (
    "adult", "ads", "bet", "bets", "bingo", "casino", "cheap", "escort", "gambling", "jackpot", "loan", "loans",
    "lottery", "malware", "phishing", "pills", "poker", "porn", "sex", "slots", "spam", "viagra", "warez", "xxx",
)
_REST = r"^[^/?#]*([^?#]*)"


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit("")), F.coalesce(F.regexp_extract(rest, _REST, 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; both null if none does."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # longer ones later, so on top
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        action = F.when(fits, act).otherwise(action)
    return name, action


def _runs(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), "")


def page_words(html: Column) -> Column:
    """Letter runs of the visible text of a page; what is opened and not closed goes on to the end of the page."""
    bare = F.regexp_replace(
        html, r"(?is)<(script|style)\b(?:.*?</\1\s*>|.*)|<!--(?:.*?-->|.*)|<[^>]*(?:>|\z)|&#?\w+;", " "
    )
    return _runs(bare)


def unigrams(pages: DataFrame, names: DataFrame) -> DataFrame:
    """(word, n) over the text of all pages and the delimited names of all urls."""
    words = pages.select(F.explode(page_words(F.coalesce("html", F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    own = names.select(F.explode(F.split("name", " ")).alias("word"), "pages").filter("word <> ''").groupBy("word").agg(F.sum("pages").alias("n"))
    return words.union(own).groupBy("word").agg(F.sum("n").alias("n"))


def viterbi(run: str, known: dict[tuple[int, int], float], total: float) -> list[str]:
    """The likeliest split of a run; ``known`` has the log probability of words by (start, length).

    An unseen piece of any length costs log(10 / total) - length * log(10), never less
    than a known word there.  The best start of an unseen piece that ends here is kept
    on the way, so the time grows with the run and the known words in it.
    """
    unseen, ten = math.log(10.0 / total), math.log(10.0)
    by_end: dict[int, list[tuple[int, float]]] = {}
    for (start, size), logp in known.items():
        by_end.setdefault(start + size, []).append((start, logp))
    best, back = [0.0] + [-math.inf] * len(run), [0] * (len(run) + 1)
    top, origin = -math.inf, 0  # of best[start] + start * log(10)
    for stop in range(1, len(run) + 1):
        if best[stop - 1] + (stop - 1) * ten > top:
            top, origin = best[stop - 1] + (stop - 1) * ten, stop - 1
        value, back[stop] = best[origin] + unseen - (stop - origin) * ten, origin
        for start, logp in sorted(by_end.get(stop, ())):
            if best[start] + logp > value or best[start] + logp == value and start < back[stop]:
                value, back[stop] = best[start] + logp, start
        best[stop] = value
    words, stop = [], len(run)
    while stop:
        words.append(run[back[stop] : stop])
        stop = back[stop]
    return words[::-1]


def segment(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, words) for every distinct run, by the unigram counts of its substrings.

    Substrings of all lengths that some counted word has are looked up, so words of
    any length are found; the list of lengths is short, as long words are few.
    """
    total = float(max(counts.agg(F.sum("n")).first()[0] or 0, 1))
    sizes = sorted(r["size"] for r in counts.select(F.char_length("word").alias("size")).distinct().collect() if r["size"])
    runs = runs.select("run").distinct()
    lengths = F.array(*[F.lit(size) for size in sizes]) if sizes else F.array().cast("array<int>")
    pieces = (
        runs.withColumn("start", F.explode(F.expr("sequence(0, char_length(run) - 1)")))
        .withColumn("size", F.explode(F.filter(lengths, lambda size: size <= F.char_length("run") - F.col("start"))))
        .withColumn("word", F.expr("substring(run, start + 1, size)"))
    )
    found = pieces.join(counts, "word").groupBy("run").agg(
        F.collect_list(F.struct("start", "size", F.log(F.col("n") / total).alias("logp"))).alias("known")  # words inside one run
    )

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(run: pd.Series, known: pd.Series) -> pd.Series:
        out = []
        for text, words in zip(run, known):
            seen = {} if words is None else {(w["start"], w["size"]): w["logp"] for w in words}
            out.append(viterbi(text, seen, total))
        return pd.Series(out, dtype=object)

    return runs.join(found, "run", "left").select("run", split("run", "known").alias("words"))


def _named(pages: DataFrame) -> DataFrame:
    """Pages with host and path, and their names ``h`` and ``p``: the letter runs after the word h or p."""
    host, path = parse(F.col("url"))
    name = lambda kind: F.concat(F.lit(kind[0] + " "), F.array_join(_runs(F.col(kind)), " "))
    return pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"h": name("host"), "p": name("path")})


def _shapes_and_words(pages: DataFrame, urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (h, p) with their number of pages, and the segmented words of all names: (name, kind, word, times)."""
    shapes = saved(urls.groupBy("h", "p").agg(F.count("*").alias("pages")), "url-shapes")
    names = saved(
        shapes.select(F.col("h").alias("name"), "pages").union(shapes.select(F.col("p").alias("name"), "pages"))
        .groupBy("name").agg(F.sum("pages").alias("pages")),
        "url-names",
    )
    counts = saved(unigrams(pages.select("html"), names.select(F.expr("substring(name, 3)").alias("name"), "pages")), "unigrams")
    parts = names.select("name", F.substring("name", 1, 1).alias("kind"), F.explode(F.split(F.expr("substring(name, 3)"), " ")).alias("run")).filter("run <> ''")
    words = (
        parts.join(segment(parts, counts), "run").select("name", "kind", F.explode("words").alias("word"))
        .groupBy("name", "kind", "word").agg(F.count("*").alias("times"))
    )
    return shapes, saved(words, "name-words")


def _flagged(shapes: DataFrame, words: DataFrame, seeds) -> DataFrame:
    """Shapes with ``bad``: a seed word stands among their words."""
    seeded = words.filter(F.col("word").isin(*seeds)).select("name").distinct().withColumn("seed", F.lit(True))
    return (
        shapes.join(seeded.select(F.col("name").alias("h"), F.col("seed").alias("hs")), "h", "left")
        .join(seeded.select(F.col("name").alias("p"), F.col("seed").alias("ps")), "p", "left")
        .select(*shapes.columns, F.coalesce("hs", "ps", F.lit(False)).alias("bad"))
    )


def _by_class() -> tuple[Column, Column]:
    bad = F.sum(F.when(F.col("bad"), F.col("pages")).otherwise(0))
    good = F.sum(F.when(F.col("bad"), 0).otherwise(F.col("pages")))
    return bad.alias("bad"), good.alias("good")


def _token_counts(flagged: DataFrame, words: DataFrame, *keys: str) -> DataFrame:
    """(keys, kind, word, bad, good): on how many pages of each class a word stands, repeats included."""
    sides = [flagged.select(F.col(side).alias("name"), "pages", "bad", *keys) for side in ("h", "p")]
    weights = sides[0].union(sides[1]).groupBy("name", *keys).agg(*_by_class())
    times = [F.sum(F.col("times") * F.col(side)).alias(side) for side in ("bad", "good")]
    return words.join(weights, "name").groupBy(*keys, "kind", "word").agg(*times)


def judge(pages: DataFrame, rules=RULES, seeds=SEEDS) -> DataFrame:
    """Per page row: page_id, host, path, rule, verdict, score.

    The verdict is the rule's, else ``block`` where the log odds ``score`` of
    the blocked class are above zero.  A null url, or one without ``://``, has
    empty host and path and no words; it is judged by the class prior alone.
    Repeated rows get equal results, null page ids are returned as such, null
    html has no words; without any seed word in any url nothing is blocked by
    the model.  Other columns are not touched; no rows give no rows.
    """
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    urls = _named(pages).withColumns({"rule": rule, "action": action})
    shapes, words = _shapes_and_words(pages, urls)
    flagged = saved(_flagged(shapes, words, seeds), "url-classes")
    tokens = saved(_token_counts(flagged, words), "url-tokens")
    prior, sums = flagged.agg(*_by_class()).first(), tokens.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("size")).first()
    size = sums["size"] or 1
    shift = math.log(((sums["good"] or 0) + size) / ((sums["bad"] or 0) + size))
    odds = F.log((F.col("bad") + 1) / (F.col("good") + 1)) + shift
    start = math.log(((prior["bad"] or 0) + 0.5) / ((prior["good"] or 0) + 0.5)) if prior["bad"] else -math.inf
    scores = words.join(tokens.select("kind", "word", odds.alias("odds")), ["kind", "word"]).groupBy("name").agg(F.sum(F.col("times") * F.col("odds")).alias("odds"))
    scores = saved(scores, "name-scores")
    judged = (
        urls.join(scores.select(F.col("name").alias("h"), F.col("odds").alias("ho")), "h", "left")
        .join(scores.select(F.col("name").alias("p"), F.col("odds").alias("po")), "p", "left")
        .withColumn("score", F.lit(start) + F.coalesce("ho", F.lit(0.0)) + F.coalesce("po", F.lit(0.0)))
    )
    verdict = F.coalesce("action", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def masked_recall(pages: DataFrame, seeds=SEEDS, folds: int = 5, by: tuple[str, ...] = ("h", "p")) -> DataFrame:
    """What the model knows beyond the seeds, by cross-validation: fold, urls, seeded, blocked, both.

    Names are dealt to folds by a hash of ``by``: distinct urls up to digits by default, whole
    hosts with ``("h",)``.  Those of a fold are scored by a model that was trained on the other
    folds, and without their seed words; ``seeded`` counts the pages that hold a seed word,
    ``blocked`` those with a score above zero, ``both`` their intersection.  So both / seeded is
    recall and both / blocked is precision.  Words that the other folds lack weigh nothing.
    Rules are left out; folds without pages have no row.
    """
    shapes, words = _shapes_and_words(pages, _named(pages))
    dealt = shapes.withColumn("fold", F.pmod(F.xxhash64(*by), F.lit(folds)).cast("int"))
    flagged = saved(_flagged(dealt, words, seeds), "url-classes")
    own = saved(_token_counts(flagged, words, "fold"), "fold-tokens")
    each = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold")
    sums = lambda df, *keys: df.groupBy(*keys).agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))

    def without_own(counts: DataFrame, *keys: str) -> DataFrame:
        """Counts of all other folds for each fold."""
        held = counts.select("fold", *keys, F.col("bad").alias("b"), F.col("good").alias("g"))
        rest = sums(counts, *keys).select(*keys, "bad", "good", each).join(held, ["fold", *keys], "left")
        return rest.select("fold", *keys, *[(F.col(c) - F.coalesce(h, F.lit(0))).alias(c) for c, h in (("bad", "b"), ("good", "g"))])

    tokens = saved(without_own(own, "kind", "word").filter("bad + good > 0"), "other-tokens")
    totals = tokens.groupBy("fold").agg(F.sum("bad").alias("all_bad"), F.sum("good").alias("all_good"), F.count("*").alias("size"))
    shift = F.log((F.col("all_good") + F.col("size")) / (F.col("all_bad") + F.col("size")))
    odds = tokens.join(totals, "fold").select("fold", "kind", "word", (F.log((F.col("bad") + 1) / (F.col("good") + 1)) + shift).alias("odds"))
    scores = saved(
        words.filter(~F.col("word").isin(*seeds)).join(odds, ["kind", "word"]).groupBy("name", "fold").agg(F.sum(F.col("times") * F.col("odds")).alias("odds")),
        "masked-scores",
    )
    prior = without_own(flagged.groupBy("fold").agg(*_by_class())).select(
        "fold", F.when(F.col("bad") > 0, F.log((F.col("bad") + 0.5) / (F.col("good") + 0.5))).otherwise(F.lit(-math.inf)).alias("start")
    )
    scored = flagged.join(prior, "fold")
    for side in ("h", "p"):
        scored = scored.join(scores.select(F.col("name").alias(side), "fold", F.col("odds").alias(side + "_odds")), [side, "fold"], "left")
    score = F.col("start") + F.coalesce("h_odds", F.lit(0.0)) + F.coalesce("p_odds", F.lit(0.0))
    count = lambda fits: F.sum(F.when(fits, F.col("pages")).otherwise(0))
    return scored.groupBy("fold").agg(
        F.sum("pages").alias("urls"), count(F.col("bad")).alias("seeded"), count(score > 0).alias("blocked"), count(F.col("bad") & (score > 0)).alias("both")
    )
