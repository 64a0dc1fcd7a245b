"""The text operators: SQL where there is any, brute force or exact rules elsewhere, odd rows everywhere."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from hearken.llm import (
    components,
    decontaminate,
    fingerprints,
    hashing,
    language,
    lines,
    mixing,
    neardup,
    passages,
    registry,
    tokenfile,
    tokens,
    toxicity,
)

DATA = Path("/root/testdata/sf0.001")
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "key long, _row string, _id long, h int, component_id long, `a.b` int"
)
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def words(text):
    return re.findall(WORD, text or "")


BASE = " ".join(f"w{i} is word number {i}." for i in range(40))
LONG = " ".join(f"{'abcdefghij'[i % 10]}{i * i % 997}" for i in range(30_000))
ODD = [
    (1, None), (2, ""), (3, " \n\t \n"), (4, "one"), (4, "one"), (None, "no id here"),
    (None, "no id here"), (5, BASE), (6, BASE), (7, BASE.replace("w3 ", "v3 ")),
    (8, BASE.upper()), (9, "été naïve 漢字 " + BASE[:90]), (10, LONG), (11, LONG + " tail"),
    (12, "x " * 90), (5, "another text of the same id"), (13, "\n" + BASE + "\n"),
    (14, "<|endoftext|> and  two spaces here\r\n"), (15, "!!! ... ???"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None, 1, "r", 2, 3, 4, 5)
        for k, (i, t) in enumerate(ODD)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def brute_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# -- queries against SQL on whole tables -------------------------------------------------


@needs_data
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for n in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{DATA}/{n}.parquet'")
    df = registry.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    answer = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert Counter(map(tuple, answer)) == Counter(tuple(r) for r in df.select(*columns).collect())


# -- hashing and components ---------------------------------------------------------------


def test_hashes_follow_words():
    texts = ["a b  c", "", None, "A\tb\nc d", "été 漢 字"]
    found = [
        (len(h), h.tolist())
        for *_, h, _ in hashing.hashed_texts([t and t.encode() for t in texts], hashing.SPACES, True)
    ]
    assert [n for n, _ in found] == [3, 0, 0, 4, 3]
    assert found[0][1] == found[3][1][:3]


def test_components_are_least_reachable(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))]
    links += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {
        x: root(x) for x in {y for a, b in links if a != b for y in (a, b)}
    }
    assert components.connected_components(
        spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")
    ).isEmpty()


# -- 1 near duplicates --------------------------------------------------------------------


def shingles(text):
    w = words(brute_lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows, percent):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    least = defaultdict(lambda: None)
    for k, (i, _) in zip(label, rows):
        if i is not None:
            least[k] = i if least[k] is None else min(least[k], i)
    return [(i, len(s), i if not s else least[k]) for (i, _), s, k in zip(rows, sets, label)]


def test_near_duplicates_of_odd_rows(odd, none):
    got = neardup.near_duplicates(odd).drop("key").collect()
    assert Counter(map(tuple, got)) == Counter(brute_components(ODD, 85))
    assert neardup.near_duplicates(none).collect() == []
    with pytest.raises(ValueError):
        neardup.near_duplicates(odd, percent=50)


def test_chains_and_stars_of_near_copies(spark):
    """Members that are not linked to a bucket's centre still meet each other."""
    rng = np.random.default_rng(11)
    rows, n = [], 0
    for family in range(12):
        base = [f"f{family}x{i}" for i in range(120)]
        for _ in range(14):
            copy = list(base)
            for at in rng.integers(0, 120, rng.integers(1, 6)):
                copy[at] = f"y{rng.integers(1_000_000)}"
            rows.append((n, " ".join(copy)))
            n += 1
    order = rng.permutation(len(rows))
    rows = [(int(order[i]), t) for i, t in rows]
    for percent in (85, 80):
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent)
        assert sorted(map(tuple, got.drop("key").collect())) == sorted(brute_components(rows, percent))


def test_one_of_each_keeps_columns(odd, none):
    kept = neardup.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    ids = Counter((r.doc_id, r.text) for r in kept.collect())
    assert max(ids.values()) == 1
    assert {i for i, _ in ids} == {None, 1, 2, 3, 4, 5, 9, 10, 12, 14, 15}
    assert {r["a.b"] for r in kept.collect()} == {5}
    assert neardup.keep_one_of_each(none).collect() == []


# -- 2 lines ----------------------------------------------------------------------------


def test_common_lines_of_odd_rows(spark, odd, none):
    rows = [(i, f"Same Line \nown {i}\n same line\n\nrare") for i in range(12)] + ODD
    df = spark.createDataFrame(rows, "doc_id long, text string")
    split = [(t or "").split("\n") for _, t in rows]
    key = lambda line: brute_lower(line.strip(" \t\n\x0b\x0c\r"))
    seen = Counter(k for ls in split for k in {key(x) for x in ls})
    want = Counter()
    for (i, _), ls in zip(rows, split):
        stay = [x for x in ls if not key(x) or seen[key(x)] < 10]
        want[(i, "\n".join(stay), len(ls), len(ls) - len(stay))] += 1
    assert Counter(map(tuple, lines.drop_common_lines(df).collect())) == want
    assert lines.drop_common_lines(none).collect() == []
    assert lines.drop_common_lines(odd).count() == len(ODD)


# -- 3 passages ---------------------------------------------------------------------------


def brute_passages(rows, window):
    split = [words(t) for _, t in rows]
    places = Counter(
        tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1)
    )
    out = []
    for (i, _), w in zip(rows, split):
        gone = set()
        for k in range(len(w) - window + 1):
            if places[tuple(w[k : k + window])] > 1:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


@pytest.mark.parametrize("window", [35, 8, 1])
def test_repeated_passages(spark, odd, none, window):
    rng = np.random.default_rng(window)
    shared = [" ".join(f"p{k}q{i}" for i in range(20 + 9 * k)) for k in range(6)]
    rows = [
        (100 + i, " ".join([f"u{i}v{j} u{i}w{j}" for j in range(5)] + [shared[int(k)] for k in rng.integers(0, 6, 3)] + ["a b a b"] * (i % 13)))
        for i in range(40)
    ]
    rows += [r for r in ODD if r[0] not in (10, 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = passages.drop_repeated_passages(df, window)
    assert Counter(map(tuple, got.collect())) == brute_passages(rows, window)
    if window == 35:
        assert passages.drop_repeated_passages(none).collect() == []
        assert passages.drop_repeated_passages(odd).count() == len(ODD)


def test_full_bitmap_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(passages, "LEAST_BITS", 64)
    monkeypatch.setattr(passages, "MOST_BITS", 64)
    rows = [(i, " ".join(f"t{(i * 7 + j) % 90}" for j in range(60))) for i in range(20)]
    got = passages.drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == brute_passages(rows, 35)


# -- 4 fingerprints -----------------------------------------------------------------------


def brute_print(text):
    w = words(text)
    hash_of = lambda b, seed=42: xxhash.xxh64(b, seed=seed).intdigest()
    terms = [hash_of(w[i + 1].encode(), hash_of(w[i].encode())) for i in range(len(w) - 1)]
    terms = terms or [hash_of(x.encode()) for x in w]
    out = ""
    for votes in (terms, [hash_of(t.to_bytes(8, "little")) for t in terms]):
        bits = sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in votes) > len(votes))
        out += f"{bits:016x}"
    return out


def brute_neighbours(rows):
    """Rows in descending id order, each with the text that follows."""
    texts = [t or "" for _, t in rows]
    for i, (doc, _) in enumerate(rows):
        t, after = texts[i], texts[(i + 1) % len(rows)]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        yield doc, len(t), hashlib.sha256(edited.encode()).hexdigest(), t, edited, after


@pytest.mark.parametrize("range_rows", [2000, 3])
def test_fingerprints_of_neighbours(spark, monkeypatch, range_rows):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", range_rows)
    rows = sorted({i: t for i, t in ODD if i not in (None, 10, 11)}.items(), reverse=True)
    df = spark.createDataFrame(rows + rows[:2], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.compare_with_next(df).collect()}
    assert len(got) == len(rows)
    for doc, n, sha, own, edited, after in brute_neighbours(rows):
        r = got[doc]
        show = lambda x, y: f"{x & (2**64 - 1):016x}{y & (2**64 - 1):016x}"
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert show(r.a, r.b) == brute_print(own)
        assert show(r.edited_a, r.edited_b) == brute_print(edited)
        assert show(r.next_a, r.next_b) == brute_print(after)


def test_fingerprints_of_odd_rows(odd, none):
    assert fingerprints.compare_with_next(odd).count() == len(set(ODD))
    assert fingerprints.compare_with_next(odd.where("doc_id = 7")).first().next_a is not None
    assert fingerprints.compare_with_next(none).collect() == []
    assert fingerprints.fingerprints(odd).count() == len(set(ODD))


def test_search_finds_all_within_radius(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(-(2**63), 2**63, 40)]
    prints = set()
    for x in base:
        for k in range(6):
            y = x
            for bit in rng.integers(0, 63, k):
                y ^= 1 << int(bit)
            prints.add((y, x))
    df = spark.createDataFrame(sorted(prints), "a long, b long")
    for radius in (0, 3, 5):
        got = {(r.q_a, r.q_b, r.a, r.b) for r in fingerprints.within_radius(df, df, radius).collect()}
        want = {
            (*p, *q)
            for p in prints
            for q in prints
            if sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(p, q)) <= radius
        }
        assert got == want


# -- 5 and 6 tokens -----------------------------------------------------------------------


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


TRICKY = [
    "", " ", "\n", "a", " a", "a ", "a\nb", "\na", "a\n", "a\n\nb", "a \nb", "a\n b", "it's  x", "\ta",
    "x y z", "<|endoftext|>", "a <|endoftext|> b", "don't stop 12 34!? ok...\nyes", "été 漢字 😀 x",
    "a\r\nb", "a\x1cb c", " a b", "...", " . \n", "l'eau d'or\nÇa va",
]


def test_pieces_encode_like_the_library():
    lib = library()
    texts = TRICKY * 2 + [t for _, t in ODD if t and len(t) < 10_000]
    ids = tokens.PieceEncoder(tokens.tokenizer_path(), counts=False)
    n = tokens.PieceEncoder(tokens.tokenizer_path(), True, {"is": 1})
    for text, got, count in zip(texts, ids.encode(texts), n.encode(texts), strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want, repr(text)
        assert count == len(want), repr(text)


def test_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 5)
    encoder, lib = tokens.PieceEncoder(tokens.tokenizer_path(), True), library()
    for text in [BASE, "other words " + BASE, BASE]:
        assert encoder.encode([text]) == [len(lib.encode(text, add_special_tokens=False).ids)]


@needs_data
def test_token_counts_of_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    want = {
        (d.doc_id, len(d.text.encode()), n, n > 1024)
        for d, n in zip(docs, (len(e.ids) for e in library().encode_batch([d.text for d in docs])))
    }
    assert {tuple(r) for r in registry.QUERIES["op6_token_counts"](spark, str(DATA)).collect()} == want


def test_token_counts_of_odd_rows(odd, none):
    lib = library()
    got = Counter(tuple(r) for r in tokens.count_tokens(odd).collect())
    assert got == Counter((i, len((t or "").encode()), len(lib.encode(t or "").ids)) for i, t in ODD)
    assert tokens.count_tokens(none).collect() == []


def index_of(rows):
    """Rows of the token index, from (id, text) in file order."""
    lib, start, out = library(), 0, []
    for i, t in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_round_trip(spark, odd, none, tmp_path):
    path = str(tmp_path / "t.orc")
    tokenfile.write_tokens(tokenfile.encode_documents(odd), path)
    back = tokenfile.read_tokens(spark, path)
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    got = sorted(map(tuple, tokenfile.token_index(back).collect()), key=lambda r: r[1])
    assert got == index_of(order)
    plan = back.where("doc_id = 7").select("doc_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in plan
    assert back.where("doc_id = 7").count() == 1
    path = str(tmp_path / "e.orc")
    tokenfile.write_tokens(tokenfile.encode_documents(none), path)
    assert tokenfile.token_index(tokenfile.read_tokens(spark, path)).collect() == []


# -- 7 and 8 labels -----------------------------------------------------------------------


@needs_data
def test_held_out_languages(spark):
    sf = str(DATA).replace("0.001", "0.01")
    got = registry.QUERIES["op7_language_id"](spark, sf)
    rows = got.join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_rows(spark, odd, none):
    nothing = language.identify_languages(odd, language.fit_languages(none)).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    rows = [(i, "the cat and the dog were there " * 3, "en") for i in range(9)]
    rows += [(i, "der Hund und die Katze waren nicht hier " * 3, "de") for i in range(9, 18)]
    model = language.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = language.identify_languages(odd, model)
    assert got.count() == len(ODD)
    assert {r.lang_pred for r in got.where("doc_id IN (1, 2, 3, 15)").collect()} == {"und"}
    mixed = model.infer("the cat and the dog were there " * 8 + "der Hund und die Katze waren nicht " * 5)
    assert [lang for lang, _ in mixed[0]] == ["en", "de"] and 0.5 < mixed[1] < 0.75
    assert [lang for lang, _ in model.infer("the dog and the cat")[0]] == ["en"]
    kept = language.keep_identified(odd, model)
    assert kept.columns == odd.columns
    assert not {r.doc_id for r in kept.collect()} & {1, 2, 3, 15}
    assert language.keep_identified(none, model).collect() == []


@needs_data
def test_held_out_toxicity(spark):
    sf = str(DATA).replace("0.001", "0.1")
    got = registry.QUERIES["op8_toxicity"](spark, sf)
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.9
    assert hit / sum(r.predicted for r in rows) > 0.9
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_toxicity_of_odd_rows(spark, odd, none):
    rows = [(i, f"you are a horrid person number {i}", 1) for i in range(30)]
    rows += [(i, f"you are a kind person number {i}", 0) for i in range(30, 90)]
    rows += [(i, "that horrid henry book is fine", 0) for i in range(90, 96)]
    lexicon = toxicity.fit_lexicon(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert lexicon.score("such a horrid thing") > 0.3 > lexicon.score("such a kind thing")
    assert lexicon.score("a h0rr1d, HORRID thing") > 0.3
    assert lexicon.score("a hоrrid thing") > 0.3  # a Cyrillic o
    assert "horrid henry" in lexicon.exceptions and lexicon.score("the horrid henry book") < 0.3
    got = toxicity.score_toxicity(odd, lexicon)
    assert got.count() == len(ODD) and got.where("score IS NULL").isEmpty()
    assert toxicity.score_toxicity(none, toxicity.fit_lexicon(none.selectExpr("doc_id", "text", "1 toxic"))).collect() == []


def test_folding():
    assert toxicity.fold("1di0t") == ["idiot", "ldiot"]
    assert toxicity.fold("L0SER, 42 m0r0n!") == ["loser", "moron"]
    assert toxicity.fold(None) == []


# -- 9 mixing -----------------------------------------------------------------------------


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mix_meets_targets(spark, odd):
    rows = [(i, "w " * (i * 37 % 211), f"src{min(i % 30, 9)}" if i % 30 < 12 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    whole, parts = mixing.mix(df)
    got = mixing.mixed_sizes(whole, parts).join(df, "doc_id").collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.size == len(words(r.text)) and r.taken <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * mixing.BLOCK_WORDS
    again = mixing.mixed_sizes(*mixing.mix(df.repartition(5))).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in got}


def test_mixed_documents_are_whole_or_cut(odd, none):
    texts = defaultdict(set)
    for i, t in ODD:
        texts[i].add(t)
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    for r in mixed.collect():
        assert r.n_chars == len(r.text)
        assert any(
            r.text == t or not Counter(words(r.text)) - Counter(words(t)) for t in texts[r.doc_id] if t
        )
    taken = mixing.mixed_sizes(*mixing.mix(odd))
    assert taken.count() == len(ODD)
    assert taken.agg(F.sum("taken")).first()[0] == sum(len(words(r.text)) for r in mixed.collect())
    assert mixing.mixed_documents(none).collect() == []


def test_permutation_is_one_to_one(spark):
    for n in (1, 2, 3, 63, 64, 65, 1000):
        p = mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9).cast("long"))
        assert sorted(r[0] for r in spark.range(n).select(p).collect()) == list(range(n))


# -- 10 decontamination -------------------------------------------------------------------

ITEMS = [
    (1, " ".join(f"w{i} is word number {i}" for i in range(5, 9))), (2, "One"), (3, None), (4, " ?! "),
    (1, "é漢 字 b"), (5, "x x x x x x x x x x x x"), (None, "no id"),
]


def brute_windows(docs, items, window):
    tokens_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute_lower(t))
    out = Counter()
    for i, t in docs:
        w, hit, found = tokens_of(t), set(), set()
        for item, text in items:
            own = tokens_of(text)
            size = min(window, len(own))
            grams = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in grams:
                    hit |= set(range(k, k + size))
                    found.add(item)
        out[(i, len(w), len(hit), tuple(sorted(found, key=str)))] += 1
    return out


@pytest.mark.parametrize("block", [100_000, 3])
def test_windows_of_odd_rows(spark, odd, none, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.find_windows(odd, items, block=block).collect()
    shown = Counter(
        (r.doc_id, r.n_words, r.n_hit, tuple(sorted({m.item_id for m in r.matches}, key=str))) for r in got
    )
    assert shown == brute_windows(ODD, ITEMS, 10)
    assert decontaminate.find_windows(none, items, block=block).collect() == []
    clean = decontaminate.find_windows(odd, items.where("false"), block=block)
    assert clean.agg(F.sum("n_hit")).first()[0] == 0
    kept = decontaminate.drop_contaminated(odd, items)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if not r.n_hit)


# -- pipeline -----------------------------------------------------------------------------


@needs_data
def test_pipeline_stages(spark):
    sf = str(DATA)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, items = docs.columns, spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "decontamination", "source_mixing", "token_output"]

    def rows(df):
        return sorted((r.doc_id, r.text) for r in df.collect())

    known = stages["language_id"](spark, docs, sf)
    assert known.columns == columns and rows(known) == rows(docs)
    once = stages["near_dedup"](spark, known, sf)
    want = [i for i, _, c in brute_components(rows(known), 80) if i == c]
    assert once.columns == columns and sorted(r.doc_id for r in once.collect()) == want
    clean = stages["decontamination"](spark, once, sf)
    hit = brute_windows(rows(once), [(r.item_id, r.text) for r in items], 10)
    assert clean.columns == columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(k[0] for k in hit if not k[2])
    mixed = stages["source_mixing"](spark, clean, sf)
    assert mixed.columns == columns
    sizes, taken = Counter(), Counter()
    for r in clean.collect():
        sizes[r.source] += len(words(r.text))
    for r in mixed.collect():
        taken[r.source] += len(words(r.text))
    for s, t in brute_targets(sizes).items():
        assert abs(taken[s] - t) <= 2 * mixing.BLOCK_WORDS
    index = sorted(map(tuple, stages["token_output"](spark, mixed, sf).collect()), key=lambda r: r[1])
    assert index == index_of(rows(mixed))


def test_pipeline_of_odd_rows(spark, odd, none, tmp_path):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_key_of_a_line_is_made_once(spark):
    from hearken.llm.lines import _hashes, text_lines

    docs = spark.createDataFrame([(" Ab \nab\n",)], "text string")
    found = docs.select(_hashes(text_lines(F.col("text")), 1).alias("k"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
    keys = found.first()["k"]
    assert [k["at"] for k in keys] == [0, 1] and keys[0]["h"] == keys[1]["h"]
