"""Language mixtures and lexicon matching against plain Python."""

import itertools
import math
import random

import numpy as np
import pytest

from hearken.llm import language, tokens, toxicity


def brute_mixture(p, of, n):
    """EM in loops; p[k][g] of gram g, n[g] its count."""
    share = {k: 1 / len(of) for k in of}
    while True:
        new = dict.fromkeys(of, 0.0)
        for g, count in n.items():
            total = sum(share[k] * p[k][g] for k in of)
            for k in of:
                new[k] += count * share[k] * p[k][g] / total
        new = {k: v / sum(n.values()) for k, v in new.items()}
        moved = max(abs(new[k] - share[k]) for k in of)
        share = new
        if moved <= language.SETTLED:
            break
    return share, sum(c * math.log(sum(share[k] * p[k][g] for k in of)) for g, c in n.items())


def brute_infer(model, text):
    grams = language.trigram_buckets(text).tolist()
    n = {g: grams.count(g) / language.OVERLAP for g in set(grams)}
    p = model.p.tolist()
    ks = range(len(model.languages))
    alone = [sum(c * math.log(p[k][g]) for g, c in n.items()) for k in ks]
    first = max(ks, key=lambda k: (alone[k], -k))
    share, _ = brute_mixture(p, list(ks), n)
    price = language.PENALTY + 0.5 * math.log(1 + sum(n.values()))
    chosen, best, best_share = [first], alone[first], {first: 1.0}
    for k in sorted(ks, key=lambda k: (-share[k], k)):
        if k in chosen:
            continue
        with_k, likelihood = brute_mixture(p, [*chosen, k], n)
        if likelihood - best <= price:
            break
        chosen, best, best_share = [*chosen, k], likelihood, with_k
    return sorted(((model.languages[k], best_share[k]) for k in chosen), key=lambda x: (-x[1], model.languages.index(x[0])))


WORDS = {
    "de": "der und nicht ein schön haus wird über straße kinder".split(),
    "en": "the and not house would over street children with beautiful".split(),
    "fr": "le et pas maison serait rue enfants avec beau être".split(),
}


@pytest.fixture(scope="module")
def model():
    names = sorted(WORDS)
    counts = [
        np.bincount(language.trigram_buckets(" ".join(WORDS[k] * 9)), minlength=language.BUCKETS)
        for k in names
    ]
    return language.LanguageModel(names, np.array(counts, float))


def test_mixtures_equal_plain_em(model):
    rng = random.Random(3)
    seen = set()
    for size, mixed in itertools.product((2, 8, 60), (1, 2, 3)):
        for _ in range(3):
            of = rng.sample(sorted(WORDS), mixed)
            text = " ".join(rng.choice(WORDS[rng.choice(of)]) for _ in range(size))
            found, score = model.infer(text)
            want = brute_infer(model, text)
            assert [k for k, _ in found] == [k for k, _ in want]
            assert [s for _, s in found] == pytest.approx([s for _, s in want], abs=1e-6)
            assert 0 < score <= 1
            seen.add(len(found))
    assert seen == {1, 2, 3}


def brute_matched(entries, exceptions, words):
    total = 0.0
    inside = set()
    for i in range(len(words) - 1):
        if f"{words[i]} {words[i + 1]}" in exceptions:
            inside |= {i, i + 1}
    for i, w in enumerate(words):
        weights = [v for e, v in entries.items() if f" {w} ".startswith(e)]
        if weights and i not in inside:
            total += max(weights)
    return total


def test_matching_equals_a_scan_of_all_entries():
    rng = random.Random(8)
    vocabulary = ["awful", "awfully", "awe", "lawful", "vile", "evil", "devil", "day", "x", "kind"]
    for _ in range(60):
        entries = {
            f" {w[: rng.randint(3, len(w))]}" if rng.random() < 0.7 else f" {w} ": rng.uniform(0.1, 3)
            for w in rng.sample(vocabulary[:8], 4)
        }
        exceptions = {f"{rng.choice(vocabulary)} {rng.choice(vocabulary)}" for _ in range(4)}
        lexicon = toxicity.Lexicon(entries, exceptions)
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        assert lexicon.matched(words) == pytest.approx(brute_matched(entries, exceptions, words))


@pytest.mark.parametrize(("pieces", "bits", "part"), [(1_500_000, 22, 1 << 19), (40, 3, 16)])
def test_pieces_give_the_library_s_tokens(monkeypatch, pieces, bits, part):
    for name, value in (("CACHE_PIECES", pieces), ("TABLE_BITS", bits), ("PART_BYTES", part)):
        monkeypatch.setattr(tokens, name, value)
    rng = random.Random(1)
    odd = [
        "", " ", "\n", "a", " a", "a ", "\na\n", "don't", "x,y .z", "é, ö. “q”, ñ'", "ab,,, !!a", "word—, — w",
        "A" * 3000, "漢字" * 900 + " x", "a'b c's 'tis 're", "1,2 3.4 a1,b2 ", "x\xa0y", "t\tt", "two  ",
        "<|endoftext|>", "a<b |c|", "é, á.", "_a_, a_b", "ª, º. µ,", "a\x00b", "a,b" * 500,
    ]
    made = ["".join(rng.choices("abé ,.'\n1", k=rng.randint(0, 120))) for _ in range(200)]
    ids = tokens.PieceEncoder(tokens.tokenizer_path(), False)
    counts = tokens.PieceEncoder(tokens.tokenizer_path(), True, {" a": 1, ",": 1})
    texts = odd + made + odd
    for text, own, n in zip(texts, ids.encode(texts), counts.encode(texts), strict=True):
        want = ids.library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own, "<u4").tolist() == want and n == len(want)
