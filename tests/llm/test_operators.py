"""Each operator against brute force, an exact round trip or held-out accuracy, on odd tables too."""

import hashlib
import json
import math
import random
import sys
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from ldlake.llm import components, fingerprints, jaccard, language, mixing, packing, queries, suffixes, tool_calls, topk, url_rules, warc  # noqa: E402
from ldlake.llm.common import cut, fresh_dir, held_out  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    return brute.odd_documents(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return brute.empty_documents(spark)


# URL rules


def test_split_url():
    assert url_rules.split_url("HTTP://WWW.Ex.ORG:80/a?b#c") == ("www.ex.org:80", "/a")
    assert url_rules.split_url("http://x.com#a/b") == ("x.com", "")
    assert url_rules.split_url("x.com/a") == url_rules.split_url(None) == ("", "")


def test_host_rule():
    assert url_rules.host_rule("a.example.org", "/en/15") == ("example.org/en/1", "block")
    assert url_rules.host_rule("a.example.org", "/en/2") == ("org/", "allow")
    assert url_rules.host_rule("notexample.org", "/es/x") == ("org/", "allow")
    assert url_rules.host_rule("x.com", "/fr/1") == ("com/fr/", "allow")
    assert url_rules.host_rule("x.net", "/fr/1") is None


def test_mined_rules(spark):
    rng = random.Random(1)
    rows = [(f"http://{rng.choice(['bad', 'good'])}.{rng.choice(['a', 'b'])}.net/{rng.choice(['en', 'fr'])}/{i}",) for i in range(600)]
    df = spark.createDataFrame(rows, "url string").withColumn(
        "block", F.col("url").contains("//bad.a.") | (F.pmod(F.xxhash64("url"), F.lit(20)) == 0)
    ).unionByName(spark.createDataFrame([(None, True)], "url string, block boolean"))
    mined = url_rules.mine(df, support=0.05, confidence=0.8)
    every = [(set(url_rules.tokens(*url_rules.split_url(r["url"]))), r["block"]) for r in df.where("url is not null").collect()]
    assert ("h1:a", "h2:bad") in [m[0] for m in mined]
    for left, confidence, _ in mined:
        hits = [b for t, b in every if t.issuperset(left)]
        assert abs(sum(hits) / len(hits) - confidence) < 1e-9 and confidence >= 0.8
    index = url_rules.Index(mined)
    for t, _ in every[:200]:
        fits = [m for m in mined if t.issuperset(m[0])]
        assert (index.best(sorted(t)) is not None) == bool(fits)
    pages = spark.createDataFrame(
        [(1, "http://bad.a.net/en/1", "x"), (2, None, None), (2, None, None), (None, "https://bad.a.org/", "y")],
        "page_id long, url string, verdict string"
    )
    got = {(r["page_id"], r["host"], r["rule"], r["verdict"]) for r in url_rules.judge(pages, mined).collect()}
    assert got == {(1, "bad.a.net", None, "block"), (2, "", None, "allow"), (None, "bad.a.org", "org/", "allow")}
    assert url_rules.mine(df.limit(0)) == [] and url_rules.judge(pages.limit(0), []).count() == 0


def test_mined_rules_are_complete_and_long_urls_end(spark, monkeypatch):
    """All rules up to three tokens, against counting every combination; short and long baskets."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(9)]
    rows = []
    for i in range(300):
        path = "/".join(rng.sample(words, rng.randint(1, 5)))
        rows.append((f"http://s{i % 3}.net/{path}", "w1" in path or rng.random() < 0.2))
    rows += [("http://long.net/" + "/".join(f"v{j}" for j in range(26)), True)] * 25 + [
        ("http://x.net/" + "/".join(rng.sample([f"u{j}" for j in range(30)], 20)), True) for _ in range(25)
    ]
    for long in (url_rules.LONG, 4):
        monkeypatch.setattr(url_rules, "LONG", long)
        mined = url_rules.mine(spark.createDataFrame(rows, "url string, block boolean"), support=0.05, confidence=0.6)
        every = [(frozenset(url_rules.tokens(*url_rules.split_url(u))), b) for u, b in rows]
        where = {}
        for k, (t, _) in enumerate(every):
            for x in t:
                where.setdefault(x, set()).add(k)
        names = {}
        for x, rows_of in where.items():
            key = frozenset(rows_of)
            names[key] = max(x, names.get(key, ""))
        use, bad = sorted(names.values()), {k for k, (_, b) in enumerate(every) if b}
        want = {}
        for size in (1, 2, 3):
            for c in __import__("itertools").combinations(use, size):
                hits = set.intersection(*(where[x] for x in c))
                if len(hits & bad) >= max(20, 0.05 * len(every)) and len(hits & bad) / len(hits) >= 0.6:
                    want[frozenset(c)] = (len(hits & bad) / len(hits), len(hits & bad) / len(every))
        kept = [k for k, (c, _) in want.items() if not any(o < k and want[o][0] >= c for o in want)]
        assert mined == sorted((tuple(sorted(k)), *want[k]) for k in kept) and mined


def test_query_verdicts_of_urls(spark):
    """The registered query against plain rules: the mined ones are given as values."""
    pages, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("pages", "labels"))
    bad = {}
    for r in labels.collect():
        bad[r["doc_id"]] = bad.get(r["doc_id"], False) or r["toxic"] == 1 or r["quality"] == 0
    known = spark.createDataFrame([(r["url"], bad[r["page_id"]]) for r in pages.collect() if r["page_id"] in bad], "url string, block boolean")
    mined = url_rules.mine(known)
    for r in queries.op1_url_rules(spark, SMALL).join(pages.select("page_id", "url"), "page_id").collect():
        url = r["url"] or ""
        host, path = "", ""
        if "://" in url:
            rest = url[url.index("://") + 3 :]
            end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
            path = rest[end:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for h, p, v in url_rules.RULES if ("." + host).endswith("." + h) and path.startswith(p)]
        have = set(url_rules.tokens(host, path))
        verdict = max(fits)[2] if fits else "block" if any(have >= set(m[0]) for m in mined) else "allow"
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, max(fits)[1] if fits else None, verdict)


def test_implied_rules_go_at_every_size():
    rng = random.Random(14)
    for n in (200, 3500):
        rules = {}
        while len(rules) < n:
            rules[frozenset(rng.sample(range(40), rng.randint(1, 3)))] = rng.randint(5, 10) / 10, 0.1
        want = [k for k, (c, _) in rules.items() if not any(o < k and rules[o][0] >= c for o in rules)]
        assert url_rules.without_implied(rules) == want and len(want) < n


# tool calls


def test_tool_calls(spark):
    call = lambda i, name, args, deps=None: {"id": i, "name": name, "arguments": args, "depends_on": deps}
    messages = [
        ("c", 1, "assistant", json.dumps({"tool_calls": [call("a", "sum", '{"y": 2, "x": [1, {"k": "ü\\n"}]}'), call("b", "sum", '{"x": "no"}', ["a", "zz"])]})),
        ("c", 2, "tool", json.dumps({"tool_call_id": "a", "content": 'said "x"'})), ("c", 3, "tool", json.dumps({"tool_call_id": "q", "content": "?"})),
        ("c", 4, "assistant", json.dumps({"tool_calls": [call("d", "nix", "{}", ["b"]), call("e", "sum", "[", ["f"]), call("f", "sum", '{"x": [], "z": 1}', ["e"])]})),
        ("c", 5, "assistant", "plain"), ("c", 6, None, None), (None, 7, "tool", "{}"), ("c", 8, "tool", json.dumps({"tool_call_id": "a", "content": "later"})),
    ]
    schemas = {"sum": {"properties": {"x": "array", "y": "integer"}, "required": ["x"]}}
    calls, results = tool_calls.from_messages(spark.createDataFrame(messages, "conv string, turn int, role string, text string"))
    got = {r["call_id"]: r for r in tool_calls.link(calls, results, schemas).collect()}
    assert {k: (r["level"], r["status"], r["valid"]) for k, r in got.items()} == {
        "a": (0, "linked", True), "b": (1, "no_result", False), "d": (2, "no_result", False), "e": (-1, "no_result", False),
        "f": (-1, "no_result", False), "q": (None, "orphan", True)
    }
    assert got["b"]["errors"] == "not array: x" and got["d"]["errors"] == "unknown tool" and got["e"]["errors"] == "arguments are no JSON object" and got["f"]["errors"] == "unexpected z"
    assert got["a"]["record"] == '{"arguments":{"x":[1,{"k":"ü\\n"}],"y":2},"call_id":"a","depends_on":[],"level":0,"name":"sum","result":"said \\"x\\""}' and got["a"]["n_results"] == 2
    for r in got.values():
        assert json.dumps(json.loads(r["record"]), sort_keys=True, ensure_ascii=False, separators=(",", ":")) == r["record"]
    assert tool_calls.link(calls.limit(0), results.limit(0), schemas).count() == 0


def test_numbers_are_canonical(spark):
    texts = [
        '{"b":1e2,"a":100,"c":100.00,"d":1.50,"e":-0.5,"f":"1.50 \\"2.0\\" x"}', '{"x":[1.0,{"y":10.10}]}',
        json.dumps({"t": "\n\"" * 60_000 + "3.0"})
    ]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tool_calls.canonical(F.try_parse_json("t"))).collect()]
    assert got[0] == '{"a":100,"b":100,"c":100,"d":1.5,"e":-0.5,"f":"1.50 \\"2.0\\" x"}' and got[1] == '{"x":[1,{"y":10.1}]}'
    assert json.loads(got[2]) == json.loads(texts[2])


def test_levels_of_null_conversations_and_chains(spark):
    rows = [
        (None, "a", []), (None, "b", ["a"]), (None, None, ["b"]), ("c", "a", ["zz", None]), ("c", "b", ["b"])
    ] + [("d", f"k{i}", [f"k{i - 1}"] if i else None) for i in range(6)]
    got = {
        (r["conv"], r["call_id"]): r["level"] for r in tool_calls.levels(
            spark.createDataFrame(rows, "conv string, call_id string, depends_on array<string>")
        ).collect()
    }
    assert got == {(None, "a"): 0, (None, "b"): 1, (None, None): 2, ("c", "a"): 0, ("c", "b"): -1} | {("d", f"k{i}"): i for i in range(6)}


def test_conversations_with_nulls(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "assistant", None), (1, 2, "user", None), (1, 2, "user", "b"), (None, 0, "user", "x"),
        (None, None, None, None), (2, 0, "user", "q"), (2, 1, "assistant", "r"), (2, 1, "assistant", "r")
    ]
    got = {
        (r["conv"], r["call_id"]): r for r in tool_calls.conversation_calls(
            spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        ).collect()
    }
    assert got["1", "turn2"]["n_calls"] == 2 and got["1", "turn2"]["level"] == 1 and got["2", "turn0"]["n_results"] == 2
    assert got["1", "turn0"]["status"] == "linked" and len(got) == 4 and got[None, "turn0"]["level"] == 0


def test_conversations_with_real_tool_calls(spark):
    call = lambda i, deps: {"id": i, "name": "sum", "arguments": {"x": 1}, "depends_on": deps}
    rows = [
        (1, 0, "user", "q"), (1, 1, "assistant", json.dumps({"tool_calls": [call("a", []), call("b", ["a"]), call("c", ["b"])]})), (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "one"})),
        (1, 3, "tool", json.dumps({"tool_call_id": "z", "content": "?"})), (1, 4, "assistant", '{"tool_calls": 3'), (2, 0, "user", "q"), (2, 1, "tool", None),
    ]
    got = {
        (r["conv"], r["call_id"]): r for r in tool_calls.conversation_calls(
            spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
        ).collect()
    }
    assert {k: (r["level"], r["status"]) for k, r in got.items()} == {
        ("1", "turn0"): (0, "linked"), ("1", "turn3"): (None, "orphan"), ("2", "turn0"): (0, "no_result"),
        ("1", "a"): (0, "linked"), ("1", "b"): (1, "no_result"), ("1", "c"): (2, "no_result"), ("1", "z"): (None, "orphan"),
    }
    assert json.loads(got["1", "a"]["record"])["result"] == "one" and json.loads(got["1", "c"]["record"])["depends_on"] == ["b"]


# top k


def test_topk(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[100:160] = x[0]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [
        (900, None, 1), (901, [1.0, None], 1), (902, [float("nan")] * 8, 1), (903, [float("inf")] * 8, 1), (904, [], 1),
        (905, [0.5, -0.5], 2)
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    good = topk.quantised(df)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(good, good.where("vec_id % 50 = 0")).collect()}
    q = {
        i: np.pad(np.floor(256 * np.array(v, float)), (0, 8 - len(v))) for i, v,
        _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)
    }
    for a in (i for i in q if i % 50 == 0):
        best = sorted(((-int(q[a] @ v), b) for b, v in q.items() if b != a))[:5]
        assert [(b, -s) for s, b in best] == [got[a, k] for k in range(1, 6)]
    few = good.where("vec_id in (50, 51, 52)")
    assert topk.top_k(few, few.where("vec_id = 50")).count() == 2 and topk.top_k(few.limit(0), few).count() == 0


def test_topk_of_large_repeated_and_long_vectors(spark):
    rng = np.random.default_rng(7)
    rows = [(i, v.tolist()) for i, v in enumerate(np.round(rng.normal(size=(60, 4)) * 4e5))]
    rows += [(50, [3e5, -1e5, 2e5, 1.0]), (50, [3e5, -1e5, 2e5, 1.0]), (51, rows[51][1]), (70, rng.normal(size=3000).tolist())]
    good = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(good, good.where("vec_id % 50 = 0")).collect()]
    whole = [(i, [math.floor(256 * c) for c in v]) for i, v in rows]
    want = []
    for a, q in ((a, q) for a, q in whole if a % 50 == 0):
        best = sorted((-sum(x * y for x, y in zip(q, v)), b) for b, v in whole if b != a)[:5]
        want += [(a, k, b, -s) for k, (s, b) in enumerate(best, 1)]
    assert sorted(got) == sorted(want) and max(s for *_, s in want) > 2**53 / 256
    huge = spark.createDataFrame([(0, [1e12] * 8), (1, [1e12] * 8)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        x = topk.quantised(huge)
        topk.top_k(x, x.where("vec_id = 0")).collect()


def test_search_stops_before_the_end_and_is_exact():
    rng = np.random.default_rng(4)
    x = np.floor(rng.standard_t(3, size=(3000, 16)) * 100).astype(np.int64)
    s, q = topk.Segments(x.ravel(), np.arange(3001) * 16), x[:20]
    for (ids, scores), v, own in zip(s.search(q, np.arange(20), np.arange(3000), 5), q, range(20)):
        want = sorted((-int(p), i) for i, p in enumerate(x @ v) if i != own)[:5]
        assert list(zip(-scores, ids)) == want
    assert sum(left > 0 for left in s.stopped) >= 10  # most queries stop on proof


# packing


def check_packing(df, size=2048):
    pdf = df.toPandas()
    for _, bin_ in pdf.groupby("sequence_id"):
        bin_ = bin_.sort_values("offset")
        assert bin_.length.sum() <= size and list(bin_.offset) == [0, *bin_.length.cumsum()[:-1]]
    return pdf


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    got = check_packing(packing.packed_documents(odd, path))
    for i, text in brute.rows_of(odd):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        mine = got[got.doc_id.isna() if i is None else got.doc_id == i].drop_duplicates("piece").sort_values("piece")
        assert mine.length.sum() == len(ids) and list(mine.start) == [0, *mine.length.cumsum()[:-1]]
        assert all(n == 2048 for n in mine.length[1:])
        for r in mine.itertuples():
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert packing.packed_documents(none, path).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é'sZ1 \n\t.<|>½²你\x1c "), max_size=60))
def test_cached_ids_are_the_tokenizer_s(text):
    t = packing._words.get("x") or packing._words.setdefault("x", packing.Words(queries.tokenizer_path()))
    assert np.frombuffer(t.ids(text), "<u4").tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids


def test_genetic_packing_is_near_the_bound():
    rng = random.Random(3)
    lengths = [rng.randint(300, 1500) for _ in range(1500)]
    first = packing.founders(lengths, 2048, random.Random(1))
    pool, done = packing.evolve(first, lengths, 2048, random.Random(2))
    bins, plain = pool[0], packing.best_fit([], list(range(1500)), lengths, 2048)
    assert done == packing.GENERATIONS and packing.fitness(bins, lengths, 2048) > packing.fitness(plain, lengths, 2048)
    assert sorted(i for b in bins for i in b) == list(range(1500)) and all(sum(lengths[i] for i in b) <= 2048 for b in bins)
    for child in (packing.crossover(plain, bins, lengths, 2048, rng, 0.4), packing.mutated(plain, lengths, 2048, rng)):
        assert sorted(i for b in child for i in b) == list(range(1500)) and all(sum(lengths[i] for i in b) <= 2048 for b in child)
    assert packing._unpacked(packing._packed(bins, 1500), 1500) == [sorted(b) for b in bins]


def test_genetic_packing_finds_the_optimum_of_small_sets():
    rng = random.Random(21)
    for k in range(6):  # cut whole bins, so the optimum is known
        lengths = []
        for _ in range(6):
            at = sorted(rng.sample(range(1, 100), 2))
            lengths += [at[0], at[1] - at[0], 100 - at[1]]
        rng.shuffle(lengths)
        pool, _ = packing.evolve(packing.founders(lengths, 100, random.Random(k)), lengths, 100, random.Random(k), 400)
        assert 6 <= len(pool[0]) <= 7


def test_islands_run_generations_and_send_their_elite(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = cut(packing.tokenised_pieces(docs, queries.tokenizer_path()))
    dealt = pieces.where("length < 2048").withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(2)))
    states = packing.evolved(dealt).collect()
    assert len(states) == 2 * packing.ISLANDS
    for s in states:
        assert s["generations"] >= packing.EPOCHS and s["migrants"] == packing.EPOCHS - 1
    got = check_packing(packing.pack(pieces))
    assert got.sequence_id.nunique() == -(-int(got.length.sum()) // 2048)  # the bound


def test_packing_over_shards(spark):
    rows = [(i, 0, 1 + (i * 7919) % 2048, "x") for i in range(3000)]
    df = packing.pack(spark.createDataFrame(rows, "row long, piece long, length long, shard string"), shard=1000)
    got = check_packing(df)
    assert len(got) == 3000 and got.sequence_id.nunique() <= 1.02 * got.length.sum() / 2048 + 2


# language


def test_language_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(df.where(~held_out(F.col("doc_id"))))
    got = language.identify(df.where(held_out(F.col("doc_id"))).drop("lang"), model).join(df, "doc_id")
    assert got.where("lang = lang_pred").count() / got.count() > 0.98


def test_language_odd(spark, odd, none):
    model = language.fit(odd)
    got = {r["doc_id"]: r for r in language.identify(odd, model).collect()}
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {5, 6, 8, 9} and all(0 <= r["score"] <= 1 for r in got.values())
    assert language.fit(none) is None and language.identify(odd, None).where("lang_pred != 'und'").count() == 0
    assert language.identify(none, model).count() == 0
    held = {r["doc_id"]: r["h"] for r in odd.select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()}
    assert held == {i: zlib.crc32(str("" if i is None else i).encode()) % 4 == 2 for i in held}


def test_code_lengths_are_ppm():
    texts = {"a": [b"abracadabra", b"banana"], "b": [b"xyzzy", b"a xylophone"]}
    lang, code, n = [], [], []
    counts = {}
    for k, (name, docs) in enumerate(sorted(texts.items())):
        for d in docs:
            p = b"\n\n\n" + d
            for i in range(3, len(p)):
                counts.setdefault(k, {}).setdefault(p[i - 3 : i + 1], 0)
                counts[k][p[i - 3 : i + 1]] += 1
    for k, c in counts.items():
        for g, m in c.items():
            lang.append(k)
            code.append(int.from_bytes(g, "big"))
            n.append(m)
    trees = language.ContextTrees(["a", "b"], np.array(lang), np.array(code), np.array(n))

    def cost(k, context, byte):
        for size in (3, 2, 1, 0):
            seen = {}
            for g, m in counts[k].items():
                if g[3 - size : 3] == context[3 - size :]:
                    seen[g[3]] = seen.get(g[3], 0) + m
            total = sum(seen.values())
            if byte in seen:
                return -math.log2(seen[byte] / (total + len(seen)))
            if total:
                return -math.log2(len(seen) / (total + len(seen))) + cost_lower(k, context, byte, size)
        return 8.0

    def cost_lower(k, context, byte, size):
        for shorter in range(size - 1, -1, -1):
            seen = {}
            for g, m in counts[k].items():
                if g[3 - shorter : 3] == context[3 - shorter :]:
                    seen[g[3]] = seen.get(g[3], 0) + m
            total = sum(seen.values())
            if byte in seen:
                return -math.log2(seen[byte] / (total + len(seen)))
            if total:
                return -math.log2(len(seen) / (total + len(seen))) + cost_lower(k, context, byte, shorter)
        return 8.0

    docs = [b"abra", b"", b"xylo banana q\xff"]
    raw = np.frombuffer(b"".join(docs), np.uint8)
    got = trees.code_lengths(raw, np.cumsum([0, *map(len, docs)]))
    for d, row in zip(docs, got):
        p = b"\n\n\n" + d
        for k in (0, 1):
            assert abs(row[k] - sum(cost(k, p[i - 3 : i], p[i]) for i in range(3, len(p)))) < 0.02


def grown_trees(texts):
    lang, code, n = [], [], []
    for k, text in enumerate(texts):
        raw = np.frombuffer(text, np.uint8)
        c, m = np.unique(language._grams(raw, np.array([0, raw.size])), return_counts=True)
        lang, code, n = [*lang, *[k] * c.size], [*code, *c], [*n, *m]
    return language.ContextTrees([*map(str, range(len(texts)))], np.array(lang), np.array(code), np.array(n))


def test_language_memory_is_bounded():
    words = [b"the quick brown fox ", "der schnelle größte Fuchs ".encode(), b"el zorro veloz "]
    tracemalloc.start()
    try:
        trees = grown_trees(words)
        raw = np.frombuffer((words[0] * 5 + words[1] + b"\xfe\x01Q") * 60_000, np.uint8)  # one long text and a short one
        before = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        got = trees.code_lengths(raw, np.array([0, raw.size - 7, raw.size]))
        peak = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert got.shape == (2, 3) and got[0].argmin() == 0
    assert sum(x.nbytes for x in vars(trees).values() if isinstance(x, np.ndarray)) < 8e6  # 67 MB, when contexts were placed by their 24 bits
    assert raw.size > 7e6 and peak < 40e6  # not a multiple of the text


def test_language_trees_are_built_once_in_a_worker():
    class Held:
        value = (["a"], np.zeros(1, int), np.array([0x0A0A0A61]), np.ones(1, int))

    import ldlake.llm.language as module
    from pyspark import cloudpickle

    sent = cloudpickle.loads(cloudpickle.dumps(language._trees))
    try:
        assert sent.__globals__ is vars(module) and sent("t", Held) is language._trees("t", Held) and sent("u", Held) and [*language._built] == ["u"]
    finally:
        language._built.clear()


@pytest.mark.parametrize("window", [1, 2, 3, 4, 7, 64])
def test_code_lengths_by_windows(monkeypatch, window):
    trees = grown_trees([b"abracadabra banana", b"xyzzy a xylophone", b"\x00\xff\n\n\nab"])
    docs = [b"", b"abra", b"", b"", b"x", b"xylo banana q\xff\xfe", b"\n\n", b"zyzzy" * 9, b""]
    raw, off = np.frombuffer(b"".join(docs), np.uint8), np.cumsum([0, *map(len, docs)])
    want = trees.code_lengths(raw, off)
    alone = [trees.code_lengths(np.frombuffer(d, np.uint8), np.array([0, len(d)]))[0] for d in docs]
    monkeypatch.setattr(language, "WINDOW", window)
    assert (trees.code_lengths(raw, off) == want).all() and (np.array(alone) == want).all()


# suffixes


def test_suffixes(spark, odd, none, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 2000)
    monkeypatch.setattr(suffixes, "BUCKET", 3000)
    got = suffixes.repeats(odd, keep_text=True, carry=("lang", "block"))
    assert brute.plain(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == brute.repeats(brute.rows_of(odd))
    assert got.where("block = 'b'").count() == got.count() and suffixes.repeats(none).count() == 0
    spans = got.where("n_removed > 0").first()
    assert sum(b - a for a, b in zip(spans["spans"][::2], spans["spans"][1::2])) == spans["n_removed"]


def test_suffixes_on_documents(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert brute.plain(suffixes.repeats(df).drop("spans")) == brute.repeats(brute.rows_of(df))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40))
def test_previous_smaller(values):
    v = np.array(values, int)
    want = [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(len(v))]
    assert list(suffixes.previous_smaller(v)) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=90).map(lambda b: bytes(c % 3 + 97 for c in b)), min_size=1, max_size=6), st.integers(8, 20))
def test_longest_previous_factors(texts, length):
    raw = np.frombuffer(b"".join(texts), np.uint8)
    starts, docs, at = [], [], 0
    for d, t in enumerate(texts):
        for j in range(len(t) - length + 1):
            starts.append(at + j)
            docs.append(d)
        at += len(t)
    got = suffixes.copies(raw, np.array(starts, int), np.array(docs, int), length)
    body = raw.tobytes()
    want = [any(body[s : s + length] == body[o : o + length] and e < d for o, e in zip(starts, docs)) for s, d in zip(starts, docs)]
    assert list(got) == want


# fingerprints


def test_fingerprints(spark, odd, none):
    hashes = {
        r["t"]: r["h"] for r in odd.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    }
    rows = sorted((i is not None, i or 0, hashes[t], t) for i, t in brute.rows_of(odd))
    for target in (fingerprints.TEXT_PARTITION, 700, 60):
        got = fingerprints.edited_fingerprints(odd, target=target).collect()
        got = sorted(
            (
                r["doc_id"] is not None, r["doc_id"] or 0, r["edited_sha256"], r["n_chars"], r["fingerprint"], r["near_next"],
                r["near_edited"], r["edited_fingerprint"]
            ) for r in got
        )
        want = []
        for k, (known, i, _, text) in enumerate(rows):
            nxt = rows[(k + 1) % len(rows)][3]
            n = len(text)
            edited = text[: n - n // 4] + nxt[: n // 4]
            f, g, h = (brute.fingerprint(x) for x in (text, edited, nxt))
            want.append((known, i, hashlib.sha256(edited.encode()).hexdigest(), n, f, fingerprints.likeness(f, h), fingerprints.likeness(f, g), g))
        assert got == sorted(want)
    assert fingerprints.edited_fingerprints(none).count() == 0


def test_walks_of_texts_of_many_lengths():
    rng = random.Random(16)
    texts = ["".join(rng.choice("abcß漢 \U0001f600") for _ in range(n)) for n in [0, 1, 3, 3, 700, 70_000, *(rng.randrange(400) for _ in range(60))]]
    for seed in (0, 3):
        assert fingerprints.fingerprints(texts, seed) == [brute.fingerprint(t, seed) for t in texts]


def edited_text(text, rate, rng):
    x = list(text)
    for _ in range(max(1, int(rate * len(x)))):
        i, k = rng.randrange(len(x)), rng.randrange(3)
        if k == 0:
            x[i] = rng.choice("abcdefgh ")
        elif k == 1:
            x.insert(i, rng.choice("abcdefgh "))
        else:
            del x[i]
    return "".join(x)


def test_earlier_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET", 25)
    rng = random.Random(19)
    bases = ["".join(rng.choice("abcdefghij ") for _ in range(rng.randrange(600, 2500))) for _ in range(12)]
    texts = [edited_text(t, 0.004 * (k % 4), rng) if k else t for t in bases for k in range(7)] + [bases[0], bases[0], "", None, "short", "short"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    for target in (9000, fingerprints.TEXT_PARTITION):
        got = {
            r["doc_id"]: (r["near_id"], r["near_likeness"]) for r in fingerprints.edited_fingerprints(
                spark.createDataFrame([*rows, (None, bases[2]), (None, "z" * 700)], "doc_id long, text string"), target=target
            ).where("doc_id is not null").collect()
        }
        prints = {i: brute.fingerprint(t or "") for i, t in rows}
        heads = {}
        for i in sorted(prints):
            for band in fingerprints.band_keys(prints[i]):
                heads.setdefault(band, i)
        for i, f in prints.items():
            near, like = got[i]
            if near is not None:
                assert near < i and like == fingerprints.likeness(f, prints[near]) and like >= fingerprints.LEAST
            if target == fingerprints.TEXT_PARTITION:  # one part: the first copy's key is the first of all
                first = min(j for j in prints if prints[j] == f)
                count = {}
                for band in fingerprints.band_keys(f):
                    if heads[band] < first:
                        count[heads[band]] = count.get(heads[band], 0) + 1
                best = min(count, key=lambda h: (-count[h], h), default=None)
                want = (None, None)
                if best is not None and fingerprints.likeness(f, prints[best]) >= fingerprints.LEAST:
                    want = (best, fingerprints.likeness(f, prints[best]))
                elif first < i:
                    want = (first, 1.0)
                assert got[i] == want
    assert sum(near is not None for near, _ in got.values()) > 60


def test_recall_of_near_duplicates(spark):
    """Half a percent of the characters edited: nine tenths of the copies name their original, or one like it, and no others do."""
    docs = [
        r["text"] for r in spark.read.parquet(
            "/root/testdata/sf0.01/documents.parquet"
        ).where("length(text) between 500 and 6000").select("text").distinct().orderBy("text").collect()
    ]
    rng = random.Random(1)
    docs = rng.sample(docs, 150)
    rows = [(i, t) for i, t in enumerate(docs)] + [(1000 + i, edited_text(t, 0.005, rng)) for i, t in enumerate(docs)]
    got = {r["doc_id"]: r["near_id"] for r in fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[1000 + i] is not None for i in range(150)) >= 0.9 * 150
    assert sum(got[1000 + i] == i for i in range(150)) >= 0.85 * 150  # some originals are copies themselves
    prints = fingerprints.fingerprints(docs)
    for i in range(150):
        if got[i] is not None:  # documents of the table that are alike themselves
            assert fingerprints.likeness(prints[i], prints[got[i]]) >= fingerprints.LEAST


def test_likeness_follows_edits():
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghij ") for _ in range(3000))
    other = "".join(rng.choice("abcdefghij ") for _ in range(3000))
    cut_ = text[:1000] + text[1003:]
    a, b, c = map(fingerprints.fingerprint, (text, cut_, other))
    assert fingerprints.likeness(a, a) == 1 and fingerprints.likeness(a, b) > 0.9 and fingerprints.likeness(a, c) < 0.3


def test_near_pairs(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefghij ") for _ in range(900)) for _ in range(8)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10 + i, t[:500] + "#" + t[501:]) for i, t in enumerate(texts)] + [(30, None), (31, "")]
    got = {(r["a"], r["b"]) for r in fingerprints.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, 10 + i) for i in range(8)}


def test_near_pairs_keeps_links_beside_the_smallest_key(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "CHUNK", 3, raising=False)
    rng = random.Random(12)
    chain = ["".join(rng.choice("abcdefghij ") for _ in range(900))]
    for k in range(11):  # each has one more edit than the one before
        at = 60 + 70 * k
        chain.append(chain[-1][:at] + "#%" * 5 + chain[-1][at + 10 :])
    rows = list(enumerate(chain)) + [(20, chain[4]), (21, chain[4]), (21, chain[4]), (22, chain[9]), (None, chain[0]), (30, None), (31, "")]
    want = {}
    for seed in range(3):
        known = [(i, fingerprints.fingerprint(t, seed)) for i, t in dict(rows).items() if t and i is not None]
        bands = {i: brute.bands(f, 16, 6) for i, f in known}
        for a, f in known:
            for b, g in known:
                like = fingerprints.likeness(f, g)
                if a < b and like >= 0.8 and bands[a] & bands[b]:
                    want[a, b] = max(like, want.get((a, b), 0))
    missed = [
        (h, a, b) for h in range(12) for a in range(h + 1, 12) for b in range(a + 1, 12) if (h, a) in want and (a, b) in want and (h, b) not in want
    ]
    assert missed and (20, 21) in want  # the first is near the second and the second near the third only
    got = fingerprints.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]): r["likeness"] for r in got} == want


# WARC


def test_warc(spark):
    big = "ä" * 600
    rows = [
        (1, "http://a", big), (2, "http://b\r\nX: y", big), (2, "again", big), (3, None, "small"), (4, "c", "small"), (5, "d", None),
        (6, "e", ""), (None, "f", big), (7, "g", "z" * 999), (8, "h", "z" * 999), (9, "i", "y" * 1000), (10, "j", "y" * 1000)
    ]
    out = fresh_dir(spark, "warc")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), out).count()
    got = sorted(
        (
            (
                r["page_id"] or 0, r["url"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]
            ) for r in warc.read(spark, out).collect()
        )
    )
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = []
    for i, u, t in rows:
        refers = {1: 2, 9: 10, None: 2}.get(i)
        want.append((i or 0, u or "", "revisit" if refers else "response", refers, len((t or "").encode()), sha(t)))
    assert got == sorted(want)
    body = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read(spark, out).where("record_type = 'response'").collect()}
    assert body[4] == "small" and body[10] == "y" * 1000 and body[5] == ""
    empty = fresh_dir(spark, "warc")
    assert warc.write(spark.createDataFrame([], "page_id long, url string, html string"), empty).count() == 0 and warc.read(spark, empty).count() == 0


def test_files_of_lost_attempts_are_not_read(spark):
    rows = [(i, f"http://x/{i}", f"{i % 7} " * 900) for i in range(40)]
    out = fresh_dir(spark, "warc")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), out)
    folder = Path(out.removeprefix("file://"))
    files = sorted(folder.glob("*.warc.gz"))
    (folder / "part-000000-99-0000.warc.gz").write_bytes(files[0].read_bytes())  # as an attempt leaves that fails after its first file
    got = warc.read(spark, out).collect()
    assert sorted(r["page_id"] for r in got) == list(range(40))
    # what a revisit refers to can be found by the standard's headers
    heads = [h for f in files for h, _ in warc.parse_records(f.read_bytes())]
    by_id = {h["warc-record-id"]: h for h in heads}
    assert len(by_id) == 40
    for h in heads:
        if h["warc-type"] == "revisit":
            to = by_id[h["warc-refers-to"]]
            assert to["warc-type"] == "response" and to["warc-payload-digest"] == h["warc-payload-digest"] and to["warc-target-uri"] == h["warc-refers-to-target-uri"] and to["warc-date"] == h["warc-refers-to-date"]


# mixing


def test_budgets_redistribute_among_siblings_first():
    leaves = {("a", "x", "1"): 10, ("a", "x", "2"): 100, ("a", "y", "3"): 100, ("b", "z", "4"): 1000}
    got = mixing.budgets(leaves, 200, {}, 1)
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 40, ("a", "y", "3"): 50, ("b", "z", "4"): 100}
    got = mixing.budgets(leaves, 600, {}, 1)
    assert got[("a", "x", "2")] == 100 and got[("b", "z", "4")] == 390
    assert sum(mixing.budgets(leaves, 5000, {}, 2).values()) == 2 * 1210


def plain_mix(rows, hashes, total, weights, epochs):
    """(row, epoch) by walking each leaf's last epoch in its order; rows: (leaf, tokens)."""
    leaves, want = {}, []
    for i, (leaf, n) in enumerate(rows):
        leaves.setdefault(leaf, []).append((i, n))
    for leaf, budget in mixing.budgets({k: sum(n for _, n in v) for k, v in leaves.items()}, total, weights, epochs).items():
        size = sum(n for _, n in leaves[leaf])
        whole, at = int(budget // size) if size else 0, 0
        rest = budget - whole * size
        for i, n in sorted(leaves[leaf], key=lambda r: hashes[whole][r[0]]):
            want += [(i, e) for e in range(whole + (at < rest))]
            at += n
    return sorted(want)


def test_mix_takes_prefixes(spark, odd, none):
    rows = [(i, f"s{i % 3}", 1 + i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    weights = {("d", "s0"): 3.0}
    key = df.select("doc_id", F.xxhash64(F.lit(11), "doc_id", "doc_id", "source", "size").alias("k"))
    hashes = [{r["doc_id"]: r["h"] for r in key.select("doc_id", F.xxhash64(F.lit(11), F.lit(e), "k").alias("h")).collect()} for e in (0, 1, 2)]
    assert sorted(hashes[0], key=hashes[0].get) != sorted(hashes[1], key=hashes[1].get)  # epochs have orders of their own
    for total in (2600, 900, 10):
        got = mixing.mix(df, [F.lit("d"), F.col("source")], F.col("size"), F.col("doc_id"), total=total, weights=weights, epochs=2)
        assert sorted((r["doc_id"], r["mix_epoch"]) for r in got.collect()) == plain_mix(
            [(("d", s), n) for _, s, n in rows], hashes, total, weights, 2
        )
    clash = odd.withColumn("mix_epoch", F.lit(9)).withColumn("_mix_x", F.lit(1)).withColumn("rest", F.lit(2))
    got = mixing.mix(clash, [F.col("lang"), F.col("source")], F.length("text"), F.col("doc_id"), share=1.0)
    assert got.count() == 17 and set(clash.columns) <= set(got.columns)  # two leaves have no tokens
    assert mixing.mix(none, [F.col("lang")], F.length("text"), F.col("doc_id")).count() == 0


def test_mix_of_ties(spark):
    same = spark.createDataFrame([(None, "s", 1, "same")] * 200, "doc_id long, source string, size long, o string")
    for share, epochs, want in ((0.5, 1, 100), (0.3, 1, 60), (1.25, 2, 250), (1.0, 1, 200)):
        assert mixing.mix(same, [F.col("source")], F.col("size"), F.col("doc_id"), share=share, epochs=epochs).count() == want
    unlike = same.withColumn("o", F.monotonically_increasing_id().cast("string"))
    got = mixing.mix(cut(unlike), [F.col("source")], F.col("size"), F.col("doc_id"), share=0.5)
    assert got.count() == got.select("o").distinct().count() == 100


# Jaccard


@pytest.mark.parametrize("cell", [3, 1500])
def test_jaccard(spark, odd, none, cell):
    got = jaccard.join(odd, k=4, percent=85, cell=cell)
    assert brute.plain(got) == brute.jaccard(brute.rows_of(odd), 4, 85)[0]
    assert jaccard.join(none).count() == 0
    rng = random.Random(8)
    base = [rng.choice("abcdefghijklmnop") + str(rng.randrange(60)) for _ in range(70)]
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(i % 8):
            words[rng.randrange(70)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    near = spark.createDataFrame(rows, "doc_id long, text string")
    assert brute.plain(jaccard.join(near, k=4, percent=60, cell=cell)) == brute.jaccard(rows, 4, 60)[0]


def families(seed, groups, each, words=60):
    """Texts in families that share a common beginning, so that regions hold several families."""
    rng = random.Random(seed)
    head, rows = [f"h{i}" for i in range(12)], []
    for g in range(groups):
        base = head + [f"w{rng.randrange(4000)}" for _ in range(words)]
        for _ in range(each):
            text = list(base)
            for _ in range(rng.randrange(5)):
                text[rng.randrange(len(text))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    return rows


def test_regions_split_into_voronoi_cells(spark, monkeypatch):
    """Pairs of a space of some families, joined through pivots, windows and homes, are those of brute force."""
    rows = families(31, 12, 9)
    sets = [np.unique(x) for x in jaccard.shingle_sets(*jaccard.utf8(__import__("pyarrow").array([t for _, t in rows])), 4)]
    depths = []
    whole = jaccard.Space.pairs

    def watched(self, index, tests, label, depth=0):
        depths.append(depth)
        return whole(self, index, tests, label, depth)

    monkeypatch.setattr(jaccard.Space, "pairs", watched)
    for percent in (60, 85):
        want = {
            (a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * np.intersect1d(sets[a], sets[b]).size >= percent * np.union1d(sets[a], sets[b]).size
        }
        got = [tuple(sorted((i, j))) for i, js in jaccard.Space(sets, percent).pairs(np.arange(len(sets)), [], None) for j in js.tolist()]
        assert len(got) == len(set(got)) and set(got) == want and want
    assert max(depths) >= 1


def test_jaccard_of_families(spark):
    rows = families(32, 10, 8) + [(900, "h0 h1 h2 h3 h4 h5 h6 h7 h8 h9"), (901, "h0 h1 h2 h3 h4 h5 h6 h7 h8 h9")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for cell in (5, 1500):
        assert brute.plain(jaccard.join(df, k=4, percent=70, cell=cell)) == brute.jaccard(rows, 4, 70)[0]


def test_one_of_each(spark, odd):
    want = brute.jaccard(brute.rows_of(odd), 5, 80)[1]
    got = [(r["doc_id"], r["text"] or "") for r in jaccard.one_of_each(odd).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(i == 15 for i, _ in got) == 0
    rows = [
        (1, "a b c d e f"), (15, "a b c d e f"), (15, "p q r s t u"), (15, "p q r s t u"), (16, "p q r s t u v"), (7, ""), (7, ""),
        (None, "x y z x y"), (3, "x y z x y")
    ]
    df = spark.createDataFrame([(*r, 0, "g") for r in rows], "doc_id long, text string, _near_id int, _gone string")
    got = jaccard.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(
        [(1, "a b c d e f"), (15, "p q r s t u"), (16, "p q r s t u v"), (7, ""), (7, ""), (None, "x y z x y")], key=str
    )


@settings(max_examples=15, deadline=None)
@given(edges=st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=14))
def test_components(edges):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_shared_folder_is_the_session_s(spark):
    assert cut(spark.range(3)).count() == 3


# pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SMALL)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        at = fresh_dir(spark, name)
        docs.write.parquet(at)
        docs = spark.read.parquet(at)
        assert 0 < docs.count() <= before.count()
        if name == "near_duplicates":
            want = sorted(i for i, _ in brute.jaccard(brute.rows_of(before), 5, 80)[1])
            assert sorted(r["doc_id"] for r in docs.collect()) == want
        if name == "repeats":
            plain = {r[0]: r[4] for r in brute.repeats(brute.rows_of(before))}
            for r in docs.collect():
                assert plain[r["doc_id"]] == hashlib.sha256(r["text"].encode()).hexdigest() or "�" not in r["text"]
    check_packing(corpus_pipeline.run(spark, SMALL))


def test_pipeline_on_odd_tables(spark, odd, none):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd.select(*corpus_pipeline.COLUMNS), "").count()
        assert stage(spark, none.select(*corpus_pipeline.COLUMNS), "").count() == 0


# registered queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_with_oracle(spark, name):
    got = queries.QUERIES[name](spark, SMALL)
    if name not in queries.ORACLE:
        assert got.count()
        return
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(queries.ORACLE[name]).df()
    cols = sorted(want.columns)
    rows = lambda f: sorted(map(str, f[cols].astype(object).where(f[cols].notna(), None).itertuples(index=False, name=None)))
    assert sorted(got.columns) == cols and rows(got.toPandas()) == rows(want)
