"""Column functions against plain Python."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearken.functions import labels, prompts, text, vectors

PY_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]


def values(spark, rows, column, schema="v string"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in df.select(column).collect()]


def py_clean(s):
    return None if s is None else " ".join(s.lower().split())


def test_clean_text_knows_every_white_space_character(spark):
    rows = [f"A{c}B{c}{c} c{c}" for c in PY_SPACES] + ["", "  ", None, "a\r\n\tb"]
    assert values(spark, rows, text.clean_text("v")) == [py_clean(r) for r in rows]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(max_codepoint=0x2FF, exclude_characters="İ"), max_size=40),
                min_size=1, max_size=200))
def test_clean_text_matches_python(spark, rows):
    assert values(spark, rows, text.clean_text("v")) == [py_clean(r) for r in rows]


def test_blank_rows_are_split_off_with_a_reason(spark):
    rows = [("a", 1), (" 　\t", 2), (None, 3), ("", 4)]
    valid, rejects = text.split_valid(spark.createDataFrame(rows, "text string, id int"))
    assert [r.id for r in valid.collect()] == [1]
    assert sorted((r.id, r.reason) for r in rejects.collect()) == [
        (2, "blank"), (3, "missing"), (4, "blank")
    ]


@pytest.mark.parametrize(
    "given_text, left",
    [
        ("<img a>\nb", "\nb"),
        ("x <img a\rb\nc", "x \nc"),
        ("x <img a b\nc", "x \nc"),
        ("x <img a> y <img b>", "x "),
        ("x <img a\r\nc", "x \nc"),
        ("no tag", "no tag"),
    ],
)
def test_cut_stops_at_line_feed_only(spark, given_text, left):
    assert values(spark, [given_text], text.cut_from("v")) == [left]


def test_tidy_reply_strips_in_order(spark):
    rows = [' "a" ', "\"'a'\"", "'\"a\"'", '""\'\'a', "a", " ", None]
    expected = [None if r is None else r.strip().strip('"').strip("'") for r in rows]
    assert values(spark, rows, text.tidy_reply("v")) == expected


def test_char_ngrams_match_slices_and_keep_code_points_whole(spark):
    rows = ["abcdefg", "ab", "", "a🙃b\nc", "éèê"]
    expected = [
        [r[i : i + n] for n in range(1, 6) for i in range(len(r) - n + 1)] for r in rows
    ]
    assert values(spark, rows, text.char_ngrams("v")) == expected


def test_truncate_and_length(spark):
    long = " ".join(str(i) for i in range(200))
    assert values(spark, [long, "a b", ""], text.truncate_tokens("v")) == [
        " ".join(str(i) for i in range(128)), "a b", ""
    ]
    assert values(spark, ["🙃é"], text.text_length("v")) == [2]


def test_guard_label(spark):
    rows = [" Greeting\n", "goodbye.", "GRATITUDE", "", None, "other"]
    assert values(spark, rows, labels.guard_label("v")) == [
        "greeting", "out_of_scope", "gratitude", "out_of_scope", "out_of_scope", "out_of_scope"
    ]


# Expected labels are ours, derived from the written rules and the priority order.
INTENT_CASES = [
    ("Good evening, team", "greeting"),
    ("hey HEY hey", "greeting"),
    ("Since the move I am lonely at night", labels.ASKING),
    ("Much appreciated.", "gratitude"),
    ("Which bus goes to the harbour?", "out_of_scope"),
    ("Take care, all of you", "goodbye"),
    ("Hello. And farewell", "goodbye"),
    ("Thanks for the tea, good night", "goodbye"),
    ("Hi, my panic comes back each Monday", labels.ASKING),
    ("Bye, still worried though", labels.ASKING),
    ("A hive of bees", "out_of_scope"),
    ("Chipped cups, three of them", "out_of_scope"),
    ("I guess it is all right", "out_of_scope"),
    ("", "out_of_scope"),
]


# Keywords know no context: what the rules say of these is wrong, and only written down here.
RULE_LIMITS = ["Stressed syllables rhyme", "The thesis measures grief in elephants"]


def test_limits_of_intent_rules(spark):
    assert values(spark, RULE_LIMITS, labels.intent_by_rules("v")) == [labels.ASKING] * 2


def test_intent_rules(spark):
    got = values(spark, [t for t, _ in INTENT_CASES], labels.intent_by_rules("v"))
    assert got == [i for _, i in INTENT_CASES]


def test_reply_field_order(spark):
    rows = [
        '{"answer":"a","text":"t"}', '{"response":"r"}', '{"message":"m"}', '{"reply":"p"}',
        '{"text":"t"}', '{"answer":"","reply":"p"}', '{"other":1}',
    ]
    assert values(spark, rows, labels.reply_field("v")) == ["a", "r", "m", "p", "t", "p", '{"other":1}']


def test_prompts_insert_text_verbatim(spark):
    odd = 'a {x} %s "q"\n$1 \\d'
    shown = values(spark, [odd], F.concat(
        prompts.intent_prompt("v"), prompts.translation_prompt(F.lit("de"), F.lit("en"), "v"),
        prompts.system_message("v", "v", "v"),
    ))[0]
    assert shown.count(odd) == 5


def test_softmax_and_prediction(spark):
    rows = [[1000.0, 1000.0, 0.0], [-5.0, -5.0, -5.0], [0.0, 1.0, 2.0]]
    got = values(
        spark, rows, vectors.prediction(vectors.softmax("v"), ["a", "b", "c"]), "v array<double>"
    )
    for scores, p in zip(rows, got):
        exps = [math.exp(s - max(scores)) for s in scores]
        assert p.label == "abc"[scores.index(max(scores))]
        assert p.confidence == pytest.approx(max(exps) / sum(exps))
        assert sum(p.probs.values()) == pytest.approx(1.0)


def test_vectors(spark):
    rows = [[3.0, 4.0], [0.0, 0.0]]
    assert values(spark, rows, vectors.l2_normalize("v"), "v array<float>") == [
        pytest.approx([0.6, 0.8]), [0.0, 0.0]
    ]
    assert values(spark, rows, vectors.cosine("v", F.array(F.lit(3.0), F.lit(4.0))),
                  "v array<float>") == [pytest.approx(1.0), 0.0]
