"""Operators on small frames: skew, profile, groups, metrics, sessions, routing."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hearken.functions.text import clean_text, one_blank
from hearken.operators import groups, metrics, profile, routing, sessions, sketches, skew, tfidf


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


# -- skew --------------------------------------------------------------------


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("rows_per_slice", [3, 1000])
def test_sliced_join_equals_plain_join(spark, how, rows_per_slice):
    data = [(i, "hot" if i % 3 else f"k{i % 7}") for i in range(90)] + [(99, None)]
    left = spark.createDataFrame(data, "id long, key string")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "key string, x int")
    plain = left.join(right, "key", how)
    sliced = skew.sliced_join(left, right, ["key"], ["id"], how, rows_per_slice)
    key = lambda r: tuple(str(v) for v in r)
    cols = plain.columns
    assert sorted(map(tuple, sliced.select(*cols).collect()), key=key) == sorted(
        map(tuple, plain.collect()), key=key
    )


def test_heavy_keys_are_cut_to_slices(spark):
    left = spark.createDataFrame([(i, "hot") for i in range(10)] + [(11, "x")], "id long, key string")
    assert [r._slices for r in skew.heavy_keys(left, ["key"], 3).collect()] == [4]


# -- profile and groups ------------------------------------------------------


def test_duplicates_after_the_first(spark):
    df = spark.createDataFrame(
        [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None), (6, "a")], "id long, t string"
    )
    for limit in (1, 1000):
        marked = profile.mark_duplicates(df, "id", "t", limit)
        assert [r[0] for r in rows(marked.where("is_duplicate"), "id")] == [3, 6]
        assert marked.count() == 6


def test_histogram_closes_last_bin_and_shows_empty_ones(spark):
    df = spark.createDataFrame([("x" * n,) for n in (0, 0, 5, 10)], "text string")
    assert rows(profile.length_histogram(df, bins=5)) == [(0, 2), (1, 0), (2, 1), (3, 0), (4, 1)]
    same = spark.createDataFrame([("ab",), ("cd",)], "text string")
    assert rows(profile.length_histogram(same, bins=2)) == [(0, 2), (1, 0)]


def test_longest_takes_first_on_ties(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bbb"), (3, "ccc")], "id long, text string")
    assert rows(profile.longest_text(df, "id")) == [(3, 2)]
    assert [r.id for r in profile.longest_n(df, "id", n=2).collect()] == [2, 3]


def _sized(spark):
    data, i = [], 0
    for size in (1, 2, 3, 4, 5, 6, 94):
        for _ in range(size):
            data.append((i, f"c{size}"))
            i += 1
    data.append((i, None))
    return spark.createDataFrame(data, "pair_id long, context string")


def test_routes_and_report(spark):
    pairs = _sized(spark)
    table = groups.route_groups(pairs, "pair_id")
    assert {r.context: r.route for r in table.collect()} == {
        "c1": "single", "c2": "kept_all", "c3": "kept_all", "c4": "kept_all",
        "c5": "kept_all", "c6": "clustered", "c94": "clustered",
    }
    report = groups.reduction_report(table, dropped=pairs.where("context is null")).first()
    assert (report.rows_in, report.rows_out, report.no_context) == (116, 25, 1)
    assert (report.single, report.kept_all, report.clustered) == (1, 4, 2)
    assert report.reduction_pct == round(100 * (1 - 25 / 116), 1)


# -- metrics -----------------------------------------------------------------


def _labelled(spark):
    y = ["a"] * 5 + ["b"] * 3 + ["c"] * 2
    p = ["a", "a", "b", "d", "a", "b", "b", "a", "b", "b"]
    return spark.createDataFrame(
        [(t, q, 0.7 if t == q else 0.0) for t, q in zip(y, p)], "y string, p string, p_true double"
    ), list(zip(y, p))


def test_report_counts_unpredicted_and_untrue_labels(spark):
    df, pairs = _labelled(spark)
    support, predicted = Counter(y for y, _ in pairs), Counter(p for _, p in pairs)
    hits = Counter(y for y, p in pairs if y == p)
    got = {r.label: r for r in metrics.full_report(df).collect()}
    f1 = {}
    for x in "abcd":
        precision = hits[x] / predicted[x] if predicted[x] else 0.0
        recall = hits[x] / support[x] if support[x] else 0.0
        f1[x] = 2 * hits[x] / (predicted[x] + support[x])
        assert got[x].precision == pytest.approx(precision)
        assert got[x].recall == pytest.approx(recall)
        assert got[x].f1 == pytest.approx(f1[x])
        assert got[x].support == support[x]
    assert got["macro"].f1 == pytest.approx(sum(f1.values()) / 4)
    weighted = sum(f1[x] * support[x] for x in "abcd") / 10
    assert got["weighted"].f1 == pytest.approx(weighted)
    one = metrics.evaluation(df).first()
    assert one.f1_weighted == pytest.approx(weighted)
    assert one.accuracy == pytest.approx(sum(hits.values()) / 10)
    assert one.loss == pytest.approx(
        (5 * -math.log(0.7) + 5 * -math.log(metrics.PROBABILITY_FLOOR)) / 10
    )


def test_confusion_matrix_is_zero_filled(spark):
    df, _ = _labelled(spark)
    got = {r.y: r for r in metrics.confusion_matrix(df, ["a", "b", "c", "d"]).collect()}
    assert (got["a"].p_a, got["a"].p_b, got["a"].p_d, got["d"].p_a) == (3, 1, 1, 0)


def test_class_weight_of_absent_label_is_null(spark):
    df = spark.createDataFrame([(0,)] * 9 + [(1,)], "label int")
    got = {r.label: r.weight for r in metrics.class_weights(df, "label", [0, 1, 2]).collect()}
    assert got == {0: pytest.approx(10 / 27), 1: pytest.approx(10 / 3), 2: None}


def test_char_tfidf_matches_brute_force(spark):
    docs = [(1, "Ab ab"), (2, "ab  c"), (3, "xyz"), (4, "")]
    grams = {}
    for i, t in docs:
        t = " ".join(t.lower().split())
        grams[i] = Counter(t[j : j + n] for n in range(1, 6) for j in range(len(t) - n + 1))
    df = Counter(g for c in grams.values() for g in c)
    expected = {}
    for i, counts in grams.items():
        w = {g: n * (math.log(5 / (1 + df[g])) + 1) for g, n in counts.items() if df[g] >= 2}
        length = math.sqrt(sum(x * x for x in w.values()))
        expected.update({(i, g): x / length for g, x in w.items()})
    frame = spark.createDataFrame(docs, "id long, text string")
    for limit in (1, 1000):
        got = tfidf.char_tfidf(frame, "id", rows_per_slice=limit).collect()
        assert {(r.id, r.gram): r.unit_weight for r in got} == pytest.approx(expected)


# -- sessions ----------------------------------------------------------------


def _turns(spark, n=23):
    data = []
    for session, length in ((1, n), (2, 3), (3, 1)):
        for t in range(length):
            role = "system" if t == 0 else ("user" if t % 2 else "assistant")
            # Turn numbers have gaps wider than a block.
            data.append((session, t * 3 if session == 1 else t, role, f"{session}-{t}"))
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string"), data


@pytest.mark.parametrize("block", [2, 7, 10_000])
def test_history_length_and_pairs_over_block_edges(spark, block):
    turns, data = _turns(spark)
    expected_len, expected_pairs = [], []
    for s in (1, 2, 3):
        mine = [d for d in data if d[0] == s]
        for d in mine:
            before = [x for x in mine if x[1] < d[1] and x[2] != "system"]
            expected_len.append((s, d[1], len(before)))
        talk = [d for d in mine if d[2] != "system"]
        expected_pairs += [
            (s, a[1], a[3], b[3])
            for a, b in zip(talk, talk[1:]) if a[2] == "user" and b[2] == "assistant"
        ]
    indexed = sessions.history_index(turns, block_turns=block)
    assert rows(indexed, "conv_id", "turn", "history_len") == sorted(expected_len)
    assert rows(sessions.turn_pairs(turns, block_turns=block)) == sorted(expected_pairs)


def test_history_of_open_request_and_clear(spark):
    turns, data = _turns(spark)
    requests = sessions.open_requests(turns).select("conv_id", "request_turn")
    for limit in (2, 1000):
        got = sessions.history_lookup(requests, turns, rows_per_slice=limit)
        last = {s: max(d[1] for d in data if d[0] == s and d[2] == "user") for s in (1, 2)}
        assert rows(got, "conv_id", "turn") == sorted(
            (d[0], d[1]) for d in data
            if d[0] in last and d[2] != "system" and d[1] < last[d[0]]
        )
        clears = spark.createDataFrame([(1, 9), (1, 12), (77, 1)], "conv_id long, clear_turn long")
        left = sessions.clear_sessions(turns, clears, rows_per_slice=limit)
        assert rows(left, "conv_id", "turn") == sorted(
            (d[0], d[1]) for d in data if d[0] != 1 or d[1] > 12
        )
    assert rows(sessions.clear_status(clears)) == [(1, "cleared"), (77, "cleared")]


def test_first_vote(spark):
    votes = spark.createDataFrame(
        [("m", 2, "down", 20), ("m", 1, "up", 10), ("n", 3, "down", 5)],
        "message_id string, event_id long, vote string, ts long",
    )
    assert rows(sessions.first_vote(votes), "message_id", "vote") == [("m", "up"), ("n", "down")]


# -- routing -----------------------------------------------------------------


def test_defaults_keep_blank_session_ids(spark):
    df = spark.createDataFrame(
        [(1, None, None), (2, "", 7), (3, " ", 2), (4, "s", 1)], "id int, session_id string, k int"
    )
    got = {r.id: r for r in routing.with_defaults(df).collect()}
    assert len(got[1].session_id) == len(got[2].session_id) == 36
    assert got[1].session_id != got[2].session_id
    assert (got[3].session_id, got[4].session_id) == (" ", "s")
    assert [got[i].k for i in (1, 2, 3, 4)] == [4, 7, 2, 1]
    assert (got[1].lang, got[1].emotion) == ("en", "neutral")


def test_requests_that_are_not_valid_are_kept_with_a_reason(spark):
    raw = spark.createDataFrame(
        [(1, '{"question":"q"}'), (2, '{"question":"q","k":"x"}'), (3, "{bad"), (4, '{"k":3}'),
         (5, '{"question":"q","session_id":"s","k":9}'), (6, None)],
        "id int, payload string",
    )
    good, bad = routing.parse_requests(raw)
    assert {(r.id, r.session_id, r.k) for r in good.collect()} == {(1, None, 4), (5, "s", 9)}
    assert {r.id: r.reason for r in bad.collect()} == {
        2: "k is not an integer", 3: "malformed", 4: "no question", 6: "malformed"
    }


def test_translation_rules(spark):
    df = spark.createDataFrame(
        [("1", "EN", "a"), ("2", "English", "b"), ("3", "ar", "c"), ("4", "ar", "d"),
         ("5", "ar", "e"), ("6", "ar", "f")],
        "request_id string, lang string, question string",
    )
    replies = spark.createDataFrame(
        [("1", "no"), ("3", ' "x\'" '), ("4", ""), ("6", None), ("6", "late")],
        "request_id string, reply string",
    )
    got = {r.request_id: (r.pivot_text, r.pivot_text_status)
           for r in routing.pivot_merge(df, replies).collect()}
    assert got == {
        "1": ("a", "not_needed"), "2": ("b", "not_needed"), "3": ("x", "translated"),
        "4": ("", "translated"), "5": ("e", "fallback"), "6": ("late", "translated"),
    }
    asked = routing.pivot_requests(df)
    assert [r[0] for r in rows(asked, "request_id")] == ["3", "4", "5", "6"]
    finished = routing.finish_answers(df.withColumn("pivot_answer", F.lit("p")), replies)
    assert {r.request_id: r.answer for r in finished.collect()}["1"] == "p"


def test_branch_sends_null_to_the_default(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, go boolean")
    out = routing.branch(
        df, F.col("go"), lambda d: d.withColumn("w", F.lit("a")), lambda d: d.withColumn("w", F.lit("b"))
    )
    assert rows(out, "id", "w") == [(1, "a"), (2, "b"), (3, "b")]


@pytest.mark.parametrize(("block", "limit"), [(1, 2), (3, 5), (10_000, 200_000)])
def test_history_of_every_request(spark, block, limit):
    log = [(s, t, "user" if t % 2 == 0 else "assistant", f"{s}{t}") for s in "ab" for t in range(0, 40, 3 if s == "a" else 1)]
    log += [("a", 4, "system", "left out"), ("c", 7, "user", "alone")]
    turns = spark.createDataFrame(log, "conv_id string, turn long, role string, text string")
    asked = [(f"{s}/{t}", s, t) for s, t, role, _ in log if role == "user"] + [("d/1", "d", 1), ("a/999", "a", 999)]
    requests = spark.createDataFrame(asked, "request_id string, conv_id string, request_turn long")
    got = sessions.history_of_requests(requests, turns, block_turns=block, rows_per_slice=limit)
    want = [
        (r, s, u, role, text)
        for r, s, t in asked
        for s2, u, role, text in log
        if s2 == s and u < t and role in ("user", "assistant")
    ]
    assert sorted(map(tuple, got.select("request_id", "conv_id", "turn", "role", "text").collect())) == sorted(want)


def test_answers_are_written_back_once(spark):
    log = spark.createDataFrame([("s", 0, "user", "q"), ("t", 0, "user", "p")], "session_id string, turn long, role string, text string")
    answered = spark.createDataFrame(
        [("s", 0, "q", "a"), ("t", 0, "p", None), ("new", 5, "x", "y")],
        "session_id string, turn long, pivot_text string, pivot_answer string",
    )
    finished = sessions.answered_turns(answered)
    once = sessions.with_answers(log, finished)
    want = [("new", 5, "user", "x"), ("new", 6, "assistant", "y"), ("s", 0, "user", "q"),
            ("s", 1, "assistant", "a"), ("t", 0, "user", "p")]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, sessions.with_answers(once, finished).collect())) == want


def test_profiles_add_up(spark):
    data = [(i % 7, None if i % 11 == 0 else f"text {i % 900}") for i in range(3000)]
    data += [(None, "alone"), (9, None)]
    df = spark.createDataFrame(data, "day int, text string")
    early = sketches.part_profiles(df.where("day < 3 OR day IS NULL"), "day", "text")
    late = sketches.part_profiles(df.where("day >= 2"), "day", "text")  # day 2 again
    got = sketches.merged_profile(sketches.add_parts(early, late)).first()
    texts = [t for _, t in data if t]
    assert (got.n_rows, got.n_null) == (len(data), len(data) - len(texts))
    assert (got.n_chars, got.max_chars) == (sum(map(len, texts)), max(map(len, texts)))
    assert abs(got.n_distinct - len(set(texts))) <= 0.05 * len(set(texts))
    none = sketches.merged_profile(sketches.part_profiles(df.where("false"), "day", "text")).first()
    assert (none.n_rows, none.n_distinct) == (0, 0)


def test_grams_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "Ab  ab"), (1, "ab"), (2, None), (3, ""), (None, "é漢")], "id int, text string")
    got = Counter(map(tuple, tfidf.ngram_counts(docs, "id").collect()))
    want = Counter()
    for i, clean in [(1, "ab ab"), (1, "ab"), (None, "é漢")]:
        own = Counter(clean[a : a + n] for n in range(1, 6) for a in range(len(clean) - n + 1))
        want.update((i, g, n) for g, n in own.items())
    assert got == want
    assert {tuple(r) for r in tfidf.ngram_df(docs).collect()} == {("a", 2), ("b", 2), ("ab", 2)}
    assert tfidf.ngram_counts(docs.where("false"), "id").collect() == []


def test_last_attempt_that_says_something_counts(spark):
    asked = spark.createDataFrame([(x,) for x in "abcd"], "request_id string")
    replies = spark.createDataFrame(
        [("a", "zebra", 1), ("a", "apple", 2), ("a", " ", 3), ("b", "", 1), ("b", None, 2), ("c", None, 1)],
        "request_id string, reply string, attempt int",
    )
    got = {r.request_id: r.reply for r in routing.join_replies(asked, replies).collect()}
    assert got == {"a": "apple", "b": "", "c": None, "d": None}
    untimed = {r.request_id: r.reply for r in routing.join_replies(asked, replies.drop("attempt")).collect()}
    assert untimed == got


def _brute_grams(texts):
    return [Counter(t[a : a + n] for n in range(1, 6) for a in range(len(t) - n + 1)) for t in texts]


@pytest.mark.parametrize("most", [1 << 62, 1 << 40, 1 << 14])
def test_grams_of_a_block(monkeypatch, most):
    monkeypatch.setattr(tfidf, "MOST", most)  # small: numbers are given anew, places are sorted
    texts = ["", "a", "ab ab", "", "é漢😀é漢😀x", "ab", "".join(map(chr, range(200, 9000))), "aaaaaaa", "b"]
    block = tfidf.Block(texts)
    got = [Counter() for _ in texts]
    for g in block.grams():
        grams = block.texts(g.start, g.length).to_pylist()
        assert len(set(grams)) == len(grams)
        for row, rank, tf in zip(g.row, g.rank, g.tf, strict=True):
            got[row][grams[rank]] += int(tf)
    assert got == _brute_grams(texts)
    assert list(tfidf.Block(["", ""]).grams()) == []


def test_char_tfidf_of_many_blocks(spark, monkeypatch):
    data = [(i % 17 if i % 5 else None, f"Wort {i % 7}  und\t{'x' * (i % 4)}é漢 ") for i in range(60)]
    data += [(100, None), (101, ""), (102, " \n"), (103, "q")]
    texts = [" ".join((t or "").lower().split()) for _, t in data]
    df = Counter(g for c in _brute_grams(texts) for g in c)
    n = sum(t is not None for _, t in data)
    rows, square = [], Counter()
    for (i, _), c in zip(data, _brute_grams(texts), strict=True):
        for g, tf in c.items():
            if df[g] >= 2:
                w = tf * (math.log((1 + n) / (1 + df[g])) + 1)
                rows.append((i, g, tf, w))
                square[i] += w * w
    want = sorted((str(i), g, tf, round(w, 9), round(w / math.sqrt(square[i]), 9)) for i, g, tf, w in rows)
    monkeypatch.setattr(tfidf, "BLOCK_CHARS", 100)  # eight blocks
    frame = spark.createDataFrame(data, "id int, text string")
    for limit in (2, 1000):  # hot grams in slices, and none
        found = tfidf.char_tfidf(frame, "id", rows_per_slice=limit).collect()
        assert sorted((str(r.id), r.gram, r.tf, round(r.weight, 9), round(r.unit_weight, 9)) for r in found) == want
    assert tfidf.char_tfidf(frame.where("false"), "id").collect() == []


def test_char_tfidf_moves_no_gram_by_document(spark):
    """Grams move by their text and by block; 300 copies in one block make one row a gram."""
    frame = spark.createDataFrame([(i, "the same words") for i in range(300)], "id long, text string")
    found = tfidf.char_tfidf(frame, "id")
    assert found.count() == 300 * len(_brute_grams(["the same words"])[0])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_block" in plan and "hashpartitioning(id" not in plan


def test_one_blank_is_clean_text(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()] + ["​", "﻿", "\x00", "᠎"]
    texts = [f"{s}A{s}{s} İß{s}Σ{s}" for s in spaces] + ["", " ", "a"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        F.lower("t").alias("low"), clean_text("t").alias("clean")
    )
    assert all(one_blank(r.low) == r.clean for r in rows.collect())
