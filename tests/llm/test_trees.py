"""Ranked search, url verdicts and the prefix tree against brute force, with odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from hearken.llm import balltree, prefixtrie, urls
from tests_data import DATA, needs_data

# -- 11 ranked search ---------------------------------------------------------------------


def terms_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute_search(docs, items, k):
    terms = [terms_of(t) for _, t in docs]
    big_n, length = sum(bool(t) for t in terms), sum(map(len, terms))
    df = Counter(w for t in terms for w in set(t))
    out = Counter()
    for item, text in set(items):
        scores = []
        for (doc, _), own in zip(docs, terms, strict=True):
            tf, score = Counter(own), 0
            m = 25 + (75 * len(own) * big_n) // length if length else 0
            for w in terms_of(text):
                if tf[w]:
                    weight = math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1)))
                    score += weight * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m))
            if score > 0:
                scores.append((-score, doc is not None, doc or 0))
        for rank, (score, known, doc) in enumerate(sorted(scores)[:k], 1):
            out[item, rank, doc if known else None, -score] += 1
    return out


def random_docs(n, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdefg" for b in "uvwxyz"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 30)))) for i in range(n)]


ODD_DOCS = [
    (None, "AU av, bu!"), (None, "au av bu"), (901, None), (902, ""), (903, "?! -"), (904, "été 漢字 au"),
    (905, "au " * 5000 + "gz"), (906, "cu cv"), (906, "cu cv"), (906, "another cu"),
]
ITEMS = [
    (1, "au av gz gz"), (2, "CU cv Été"), (2, "CU cv Été"), (3, None), (4, " .. "), (None, "bu bv bw"),
    (5, "notfound"), (6, " ".join(f"{a}{b}" for a in "abcdefg" for b in "uvwxyz")),
]


@pytest.mark.parametrize(("block", "sample"), [(20_000, 20_000), (4, 100)])
def test_search_equals_brute_force(spark, monkeypatch, block, sample):
    monkeypatch.setattr(balltree, "SAMPLE_ROWS", sample)
    docs = random_docs(900) + ODD_DOCS
    df = spark.createDataFrame(
        [(i, t, 1, 2, 3.0, "x") for i, t in docs],
        "doc_id long, text string, n long, score int, `a.b` double, rank string",
    ).repartition(3)
    items = spark.createDataFrame(
        [(i, t, 7, 8) for i, t in ITEMS], "item_id long, text string, doc_id int, key int"
    )
    got = balltree.search(df, items, 10, block).collect()
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == brute_search(docs, ITEMS, 10)
    assert balltree.search(df.where("false"), items).collect() == []
    assert balltree.search(df, items.where("false")).collect() == []


def test_tree_bounds_and_pruning():
    rng = np.random.default_rng(1)
    rows, size = 1500, 200
    kinds = rng.integers(0, 12, rows)
    each = [
        np.unique(np.concatenate([np.arange(k * 15, k * 15 + 12), rng.integers(0, size, 5)]))
        for k in kinds
    ]
    offsets = np.concatenate(([0], np.cumsum([len(e) for e in each])))
    terms = np.concatenate(each)
    values = rng.integers(1, 900_000, len(terms))
    tree = balltree.BallTree(offsets, terms, values, size, leaf=32)
    assert sorted(tree.order) == list(range(rows))
    dense = np.zeros((rows, size), np.int64)
    dense[np.repeat(np.arange(rows), np.diff(offsets)), terms] = values
    pruned = 0
    for k in range(12):
        own = np.unique(rng.integers(k * 15, k * 15 + 12, 8))
        weights = rng.integers(0, 8000, len(own))
        scores = dense[:, own] @ weights
        bound = tree.bounds(own, weights)
        for node in range(len(bound)):
            assert scores[tree.order[tree.start[node] : tree.end[node]]].max() <= bound[node]
        best = balltree.Best(10, 1)
        names = [(True, r, 0) for r in range(rows)]
        seen, leaves = tree.search(own, weights, 1, lambda r, s, b=best: b.offer([names[x] for x in r], s))
        pruned += leaves - seen
        want = sorted((-int(s), (True, r, 0)) for r, s in enumerate(scores) if s > 0)[:10]
        assert best.rows == want
    assert pruned > 100


# -- 12 urls ------------------------------------------------------------------------------


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    fits = [
        (len(h + p), h + p, v)
        for h, p, v in urls.RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[1:] if fits else (None, None)


def brute_split(label, counts, total):
    """The best of all ways to cut."""
    best = None
    for cuts in itertools.product([0, 1], repeat=len(label) - 1):
        parts, last = [], 0
        for i, cut in enumerate(cuts, 1):
            if cut:
                parts.append(label[last:i])
                last = i
        parts.append(label[last:])
        p = sum(
            math.log(counts[w] / total) if w in counts else -math.log(total) - len(w) * math.log(10)
            for w in parts
        )
        if best is None or p > best[0] + 1e-9:
            best = p, parts
    return best


PAGES = [
    ("http://news.example.net/en/a1", "<p>good news for the garden</p><script>var xx='zz'</script>"),
    ("HTTP://News.Example.NET/EN/a", "<p>the good garden the news</p>"),
    ("https://gardennews.example.com/de/x?y=http://b", "shop shop <b>cheap</b> pills casino"),
    ("https://cheappills.example.com/de/buy-now#top", "casino casino pills <!-- hidden words -->"),
    ("https://cheappills.shop.com/buy/now7", "cheap casino"),
    ("https://thegarden.org/fr/", "garden"), ("https://thegarden.org/en/", None),
    ("http://goodnews.com/en/2020", "good"), ("http://a.net", ""), ("http://a.net/", ""),
    ("http://net/x", "x"), ("http://xnet/x", "x"), ("no url", "t"), (None, None), ("", ""),
    ("ftp://user@Host:80//p", ""), ("x://://?", ""), ("http://" + "good" * 3000 + "/p", ""),
    ("http://weird..dots.-_7.com/%20é漢/1", "é"), ("http://weird..dots.-_7.com/%20é漢/1", "é"),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(None if i == 11 else i // 2 if i > 17 else i, u, h, "r", "v", 1) for i, (u, h) in enumerate(PAGES)]
    return spark.createDataFrame(
        rows, "page_id long, url string, html string, rule string, host string, `a.b` int"
    ).repartition(3)


def test_urls_equal_brute_force(spark, pages):
    total_words = Counter()
    for _, html in PAGES:
        seen = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#\w]+;", " ", html or "")
        total_words.update(w for w in re.findall(r"[^\W\d_]+", seen.lower()) if len(w) <= 20)
    total = sum(total_words.values())

    def tokens(host, path):
        out = []
        for label in host.split("."):
            for run in re.findall(r"[^\W\d_]+|\d+|[^\w]|_", label):
                if run.isalpha():
                    out += urls.best_split(run, total_words, total)
                else:
                    out.append("0" if run.isdigit() else run)
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in path)
        return [f"h:{w}" for w in out] + [
            "p:" + ("0" if t[0].isdigit() else t) for t in re.findall(r"[^\W\d_]+|\d+", low)
        ]

    parsed = [(*brute_parts(u), *brute_rule(*brute_parts(u))) for u, _ in PAGES]
    seen, n = {"allow": Counter(), "block": Counter()}, Counter()
    for host, path, _, verdict in parsed:
        if verdict:
            seen[verdict].update(tokens(host, path))
            n[verdict] += 1
    used = len(set().union(*seen.values()))

    def score(host, path):
        out = math.log(n["block"]) - math.log(n["allow"])
        for t in tokens(host, path):
            if seen["block"][t] + seen["allow"][t]:
                out += math.log((seen["block"][t] + 1) / (seen["block"].total() + used))
                out -= math.log((seen["allow"][t] + 1) / (seen["allow"].total() + used))
        return out

    got = urls.judge_urls(pages).collect()
    want = Counter()
    for host, path, rule, verdict in parsed:
        s = None if verdict else round(score(host, path), 6) + 0.0
        want[host, path, rule, verdict or ("block" if s > 0 else "allow"), s] += 1
    assert Counter(
        (r.host, r.path, r.rule, r.verdict, None if r.score is None else round(r.score, 6) + 0.0) for r in got
    ) == want
    assert sum(r.page_id is None for r in got) == 1
    cheap = next(r for r in got if r.path == "/buy/now7")
    assert cheap.tokens == ["h:cheap", "h:pills", "h:shop", "h:com", "p:buy", "p:now", "p:0"]
    assert cheap.verdict == "block"


def test_urls_of_empty_tables_and_one_class(spark, pages):
    assert urls.judge_urls(pages.where("false")).collect() == []
    free = urls.judge_urls(pages, []).collect()
    assert {(r.rule, r.verdict) for r in free} == {(None, "allow")}
    one = urls.judge_urls(pages, [("net", "/", "block")]).collect()
    assert {r.verdict for r in one} == {"block"}


def test_split_is_the_likeliest():
    counts = {"the": 50, "re": 8, "there": 9, "in": 30, "here": 7, "t": 1, "rein": 2}
    total = sum(counts.values())
    for label in ("therein", "thethere", "inthere", "xthe", "xyz", "reinthe", "t"):
        words = urls.best_split(label, counts, total)
        assert "".join(words) == label
        assert words == brute_split(label, counts, total)[1]


@needs_data
def test_verdicts_agree_with_rules_kept_back(spark):
    """Learn from half of the hosts' ruled urls, judge the other half."""
    pages = spark.read.parquet(f"{DATA.parent}/sf0.01/pages.parquet")
    rows = urls.judge_urls(pages).where("rule IS NOT NULL").selectExpr(
        "verdict", "tokens", "pmod(xxhash64(page_id), 2) AS half"
    )
    rows = rows.withColumn("buckets", urls.token_buckets(rows["tokens"])).collect()
    learned = spark.createDataFrame(
        [(r.verdict, r.buckets) for r in rows if r.half], "verdict string, buckets array<int>"
    )
    model = urls.fit_verdicts(learned)
    kept = [r for r in rows if not r.half]
    offsets = np.cumsum([0, *(len(r.buckets) for r in kept)])
    found, _ = model.verdicts(offsets, np.concatenate([r.buckets for r in kept]))
    assert np.mean([f == r.verdict for f, r in zip(found, kept, strict=True)]) > 0.9


# -- 13 prefix tree -----------------------------------------------------------------------


def brute_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, tie, role, text))
    ordered = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in ordered.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = ordered.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def brute_tree(conversations):
    members = defaultdict(list)
    for c, turns in sorted(conversations.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    value, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        value[node] = own + sum(value[x] for x in children[node])
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
    return Counter(
        (
            m[0], len(node), members[node[:-1]][0] if node else None, len(m), len(children[node]),
            leaves[node], value[node],
            hashlib.sha256(",".join(str(c) for c in m if len(conversations[c]) == len(node)).encode()).hexdigest(),
        )
        for node, m in members.items()
    )


def shown(df):
    return Counter(
        (r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
        for r in df.collect()
    )


CONVERSATIONS = "conv_id long, turn long, role string, text string, ids int, key string, `a.b` int"


def random_turns():
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 60), *range(100, 130), 230, 231, -7, 10**12 + 3]:
        if c % 4 == 1:  # a third are copies, with one first turn for all
            own = [("user", "hello"), ("assistant", "same answer"), ("user", "bye")] * 3
        else:
            own = [("user", "hello")] + [(rng.choice("ua"), rng.choice(["x", "yy", "zz z", "été"])) for _ in range(rng.randint(0, 9))]
        rows += [(c, t, *x) for t, x in enumerate(own)]
    rows += [(None, 1, "u", "no conversation"), (300, None, None, None), (300, None, "u", "a"), (300, 1, "", "")]
    rows += [(301, 2, "u", "tie"), (301, 2, "u", "tie"), (301, -1, None, "first")]
    rows += [(302, t, "u", f"deep {t}") for t in range(400)] + [(303, t, "u", f"deep {t}") for t in range(300)]
    return rows + [(304, 0, "u", "long " * 40_000)]


@pytest.mark.parametrize(("shard", "most"), [(2000, 200_000), (2, 200_000), (1, 20)])
def test_tree_equals_brute_force(spark, shard, most):
    rows = random_turns()
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], CONVERSATIONS).repartition(3)
    conversations = brute_rebuilt(rows)
    assert any(not turns for turns in conversations.values())  # one without turns
    got = prefixtrie.prefix_tree(prefixtrie.rebuilt_conversations(df), shard, most)
    assert shown(got) == brute_tree(conversations)


def test_upper_nodes_are_bounded(spark):
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in random_turns()], CONVERSATIONS)
    sequences = prefixtrie.distinct_sequences(prefixtrie.rebuilt_conversations(df))
    assert 1 < len(prefixtrie.upper_prefixes(sequences, 1, 200)) < 200


def test_tree_of_no_conversation(spark):
    df = spark.createDataFrame([], CONVERSATIONS)
    assert prefixtrie.prefix_tree(prefixtrie.rebuilt_conversations(df)).collect() == []
    alone = spark.createDataFrame([(101, 1, "u", "t", 1, "", 2)], CONVERSATIONS)
    tree = prefixtrie.prefix_tree(prefixtrie.rebuilt_conversations(alone))
    assert shown(tree) == brute_tree(brute_rebuilt([(101, 1, "u", "t")]))


def test_double_array_holds_its_words_and_no_others():
    rng = random.Random(2)
    words = sorted({tuple(rng.randint(1, 40) for _ in range(rng.randint(1, 6))) for _ in range(300)})
    trie = prefixtrie.DoubleArray([list(w) for w in words])
    prefixes = {w[:d] for w in words for d in range(len(w) + 1)}

    def reach(word):
        state = 0
        for label in word:
            state = trie.step(state, label)
            if state < 0:
                return -1
        return state

    states = {reach(p) for p in prefixes}
    assert -1 not in states and len(states) == len(prefixes)
    for p in prefixes:
        for label in range(1, 42):
            assert (reach((*p, label)) >= 0) == ((*p, label) in prefixes)
