"""URL filters by association rules.

FP-growth mines combinations of URL tokens that go with a ``block`` label. Rules are pruned by
support and confidence, and a rule is dropped when a shorter one over part of its tokens is at least
as confident. FP-growth knows no longest itemset, so it mines short baskets; long ones (URLs of many words, whose
itemsets grow beyond all bounds) are mined level by level up to the length of a rule. What is frequent
in all baskets is frequent in one of the two parts, so each part's finds are counted again over all. An inverted index (rarest token of a rule -> rule) finds the rules that fit a URL.
Explicit allow and block rules by host and path prefix come first; the longest decides.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Fixed values of the query: (host, path, verdict).
RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
    ("com", "/de/", "block")
)
TOKEN = re.compile(r"[^\W_]+")
LABEL = "=block"
MOST_RULES = 50_000
LONG = 12  # tokens: FP-growth makes at most 2^LONG itemsets of a basket


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), path


def tokens(host: str, path: str) -> list[str]:
    """Distinct tokens: host labels by their place from the right, path segments by depth without digits, file kinds."""
    out = [f"h{i}:{x}" for i, x in enumerate(reversed(host.split("."))) if x]
    for depth, segment in enumerate(x for x in path.split("/") if x):
        for word in TOKEN.findall(segment.lower()):
            out.append(f"p{depth}:#" if word.isdigit() else f"p{depth}:{word}")
    return sorted(set(out))


def host_rule(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """The longest explicit rule whose host is this one or a parent domain and whose path begins this one."""
    fits = [(len(h) + len(p), h + p, verdict) for h, p, verdict in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


def baskets_of(rows: DataFrame, least: int) -> DataFrame:
    """(items, bad): the tokens of each URL that are in at least ``least`` of them; of tokens that always come together the last by name."""

    @F.pandas_udf("array<string>")
    def items(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: tokens(*split_url(u)))

    rows = cut(rows.select(items("url").alias("items"), "bad").where(F.size("items") > 0).withColumn("row", F.monotonically_increasing_id()))
    every = rows.select("row", "bad", F.explode("items").alias("token"))
    place = F.xxhash64("row")
    count = every.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(place).alias("x"), F.sum(F.pmod(place, F.lit(1 << 40))).alias("s"))
    kept = count.where(F.col("n") >= least).groupBy("n", "x", "s").agg(F.max("token").alias("token")).select("token")
    return cut(
        every.join(kept, "token").groupBy("row").agg(F.max("bad").alias("bad"), F.array_sort(F.collect_list("token")).alias("items")).drop("row")
    )


def _collected(sets: DataFrame) -> set[frozenset]:
    """Itemsets (column ``items``) as sets; more than a bound is an error."""
    got = sets.limit(4 * MOST_RULES + 1).collect()
    if len(got) > 4 * MOST_RULES:
        raise ValueError("too many frequent token sets: raise the support")
    return {frozenset(r["items"]) for r in got}


def frequent_by_levels(baskets: DataFrame, least: int, max_len: int) -> set[frozenset]:
    """Sets of up to ``max_len`` items that are in at least ``least`` baskets, each level out of the one before."""
    found: set[frozenset] = set()
    known: set[frozenset] = set()
    for size in range(1, max_len + 1):
        held = baskets.sparkSession.sparkContext.broadcast(known)

        def grow(frames, size=size, held=held):
            known = held.value
            single = {next(iter(k)) for k in known} if size == 2 else {t for k in known for t in k}
            for frame in frames:
                count: Counter = Counter()
                for items in frame["items"]:
                    mine = items if size == 1 else [t for t in items if t in single]
                    for c in combinations(mine, size):
                        if size < 3 or all(frozenset(part) in known for part in combinations(c, size - 1)):
                            count[c] += 1
                yield pd.DataFrame({"items": [list(c) for c in count], "n": list(count.values())})

        sums = baskets.select("items").mapInPandas(grow, "items array<string>, n long").groupBy("items").agg(F.sum("n").alias("n"))
        known = _collected(sums.where(F.col("n") >= least).select("items"))
        found |= known
        if not known:
            break
    return found


def mine(
    labelled: DataFrame, url: str = "url", block: str = "block", support: float = 0.002, confidence: float = 0.5, least: int = 20,
    max_rows: int = 100_000, max_len: int = 3
) -> list[tuple[tuple[str, ...], float, float]]:
    """Rules (tokens, confidence, support): combinations of up to ``max_len`` tokens that imply a block label.

    A rule's tokens are in at least ``least`` and ``support`` of the rows with the label. Learns from at most about ``max_rows``
    labelled rows, drawn evenly by a seeded hash of the URL. Null URLs and labels take no part. Of
    tokens that are in the same rows one speaks for all, so repeated long URLs add few sets. More
    than MOST_RULES rules, or four times as many sets, are an error that asks for a larger support.
    """
    from pyspark.ml.fpm import FPGrowth

    rows = labelled.where(F.col(url).isNotNull() & F.col(block).isNotNull()).select(
        F.col(url).alias("url"), F.col(block).cast("boolean").alias("bad")
    )
    n = rows.count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("fp"), "url"), F.lit(1 << 30)) < int(max_rows / n * (1 << 30)))
        n = max_rows
    baskets = baskets_of(rows, min(least, n))
    total = baskets.count()
    if not total:
        return []
    share = min(1.0, max(support, least / total))
    short, long = baskets.where(F.size("items") <= LONG), baskets.where((F.size("items") > LONG) & F.col("bad"))
    marked = short.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(LABEL)))).otherwise(F.col("items")).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence).fit(marked).freqItemsets
    found = {x - {LABEL} for x in _collected(sets.where(F.array_contains("items", LABEL) & F.size("items").between(2, max_len + 1)))}
    n_long = baskets.where(F.size("items") > LONG).count()
    if n_long:
        found |= frequent_by_levels(long, max(1, math.ceil(share * n_long - 1e-9)), max_len)
    rules = {}
    for left, (f, both) in counted(baskets, found).items():
        if both >= share * total - 1e-9 and both / f >= confidence:
            rules[left] = (both / f, both / total)
    kept = without_implied(rules)
    if len(kept) > MOST_RULES:
        raise ValueError("too many rules: raise the support")
    return sorted((tuple(sorted(k)), *rules[k]) for k in kept)


def counted(baskets: DataFrame, sets: set[frozenset]) -> dict[frozenset, tuple[int, int]]:
    """For each set the baskets that hold it, and those of them with the label."""
    every = sorted(tuple(sorted(s)) for s in sets)
    held = baskets.sparkSession.sparkContext.broadcast(every)

    def count(frames):
        index = Index([(s, i) for i, s in enumerate(held.value)])
        for frame in frames:
            total, bad = Counter(), Counter()
            for items, label in zip(frame["items"], frame["bad"]):
                for _, i in index.fitting(items):
                    total[i] += 1
                    bad[i] += bool(label)
            yield pd.DataFrame({"i": list(total), "n": list(total.values()), "m": [bad[i] for i in total]})

    sums = baskets.select("items", "bad").mapInPandas(count, "i long, n long, m long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    return {frozenset(every[r["i"]]): (r["n"], r["m"]) for r in sums.collect()}  # a row for each set, whose number is bounded


def without_implied(rules: dict[frozenset, tuple[float, float]]) -> list[frozenset]:
    """The rules that have no shorter one over part of their tokens that is at least as confident."""
    parts = lambda k: (frozenset(o) for n in range(1, len(k)) for o in combinations(k, n))
    return [k for k, (c, _) in rules.items() if not any(o in rules and rules[o][0] >= c for o in parts(k))]


class Index:
    """Inverted index over mined rules: each is filed under its token that fewest rules have."""

    def __init__(self, rules):
        count: dict[str, int] = {}
        for left, *_ in rules:
            for t in left:
                count[t] = count.get(t, 0) + 1
        self.rules = rules
        self.by_token: dict[str, list[int]] = {}
        for k, (left, *_) in enumerate(rules):
            self.by_token.setdefault(min(left, key=lambda t: (count[t], t)), []).append(k)

    def fitting(self, found) -> list[tuple]:
        """The rules all of whose tokens are there."""
        have = set(found)
        return [self.rules[k] for t in found for k in self.by_token.get(t, ()) if have.issuperset(self.rules[k][0])]

    def best(self, found: list[str]) -> tuple[tuple[str, ...], float, float] | None:
        """The most confident rule all of whose tokens are there (ties: larger support, then token order)."""
        fits = self.fitting(found)
        return min(fits, key=lambda r: (-r[1], -r[2], r[0])) if fits else None


def judge(pages: DataFrame, mined: list, rules=RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule, confidence of each row; no shuffle.

    An explicit rule decides where one fits; else a mined rule blocks; else the URL is allowed. Null
    and malformed URLs have empty host and path, fit no rule and are allowed. Repeated rows are
    judged one by one.
    """
    if len(mined) > MOST_RULES:
        raise ValueError("too many rules to send to executors")
    held = pages.sparkSession.sparkContext.broadcast(mined)
    columns = ["page_id", "host", "path", "rule", "verdict", "mined_rule", "confidence"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(held.value)
        for frame in frames:
            out = []
            for page, link in zip(frame["page_id"], frame["url"]):
                host, path = split_url(link)
                fixed, fits = host_rule(host, path, rules), index.best(tokens(host, path))
                verdict = fixed[1] if fixed else "block" if fits else "allow"
                out.append((page, host, path, fixed and fixed[0], verdict, fits and " ".join(fits[0]), fits and fits[1]))
            yield pd.DataFrame(out, columns=columns)

    src = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"))
    return src.mapInPandas(
        run,
        f"page_id {src.schema[0].dataType.simpleString()}, host string, path string, rule string, verdict string, mined_rule string, confidence double"
    )
