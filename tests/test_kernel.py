"""Kernels against the standard library's matcher."""

import random
from difflib import SequenceMatcher

import pytest

from quillmatch.functions import kernel
from quillmatch.operators import lsh


def standard(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


@pytest.mark.parametrize(
    "a, b, r",
    [
        ("", "", 1.0), ("", "q", 0.0), ("q", "", 0.0), ("oak", "oak", 1.0), ("oak", "oar", 2 / 3), ("a slow grey cat", "a slow grey cow", 26 / 30),
        ("Дождь", "Дождик", 8 / 11), ("stone", "notes", 0.2), ("notes", "stone", 0.4), ("mmmmnnnnoooo", "mmmm.nnnn.oooo", 24 / 26), ("😀ok😀", "ok😀", 6 / 7),
    ],
)
def test_known_values(a, b, r):
    assert kernel.ratio(a, b) == kernel.b2j_ratio(a, b) == standard(a, b) == r


def test_the_order_of_the_arguments_matters():
    assert kernel.ratio("tide", "diet") != kernel.ratio("diet", "tide")


@pytest.mark.parametrize("alphabet, most, rounds", [("abcde", 50, 600), ("aПб😀", 60, 300), ("abcdef", 900, 12), ("ab", 500, 12)])
def test_against_the_standard_library(alphabet, most, rounds):
    draw = random.Random(len(alphabet) * most)
    for _ in range(rounds):
        a, b = ("".join(draw.choice(alphabet) for _ in range(draw.randint(0, most))) for _ in range(2))
        assert kernel.ratio(a, b) == standard(a, b)


def test_long_edited_texts():
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 9))) for _ in range(300)]
    for _ in range(6):
        a = " ".join(draw.choice(words) for _ in range(250))
        b = list(a)
        for _ in range(60):
            b[draw.randrange(len(b))] = draw.choice("xyz ")
        assert kernel.ratio(a, "".join(b)) == standard(a, "".join(b))


def test_edge_agrees_with_the_ratio_at_every_threshold():
    draw = random.Random(9)
    for _ in range(500):
        a, b = ("".join(draw.choice("abcd") for _ in range(draw.randint(0, 40))) for _ in range(2))
        r = standard(a, b)
        for t in (0.25, 0.5, 0.75, 0.9, 1.0):
            assert kernel.edge(a, b, t) == (r if r >= t else None)
    assert kernel.edge("abc", "abc", 1.5) is None


def test_early_exits_agree_with_the_ratio():
    draw = random.Random(13)
    for _ in range(60):
        alphabet, n = draw.choice(["ab", "abcdefgh "]), draw.choice([70, 200, 500])
        a = "".join(draw.choice(alphabet) for _ in range(n))
        b = list(a)
        for _ in range(draw.randint(0, n // 3)):
            b[draw.randrange(n)] = draw.choice(alphabet)
        index = kernel.Index("".join(b))
        r = standard(a, index.text)
        for t in (0.3, 0.75, 0.9, r):
            assert kernel.edge(a, index, t) == (r if r >= t else None)
            assert kernel.qualifies(a, index, t) == (r >= t)
            assert kernel.ratio_capped(a, index, t) == (r if r <= t else 2.0)


def test_subsequence_bound_of_many_pairs():
    draw = random.Random(17)
    texts = ["".join(draw.choice(draw.choice(["ab", "abcd😀"])) for _ in range(draw.choice([0, 1, 63, 64, 65, 200]))) for _ in range(40)]
    left, right = ([draw.randrange(40) for _ in range(300)] for _ in range(2))
    need = [draw.randint(0, 60 + len(texts[i]) // 2) for i in left]
    got = kernel.lcs_reach_many(texts, left, right, need)
    assert got.tolist() == [kernel.lcs_reaches(texts[i], texts[j], n) for i, j, n in zip(left, right, need)]


def test_subsequence_bound_is_is_never_below_the_matched_total():
    draw = random.Random(11)
    for _ in range(200):
        a, b = ("".join(draw.choice("abc") for _ in range(draw.randint(0, 150))) for _ in range(2))
        m = kernel.matched(a, b)
        assert kernel.lcs_reaches(a, b, m)
        assert not kernel.lcs_reaches(a, b, min(len(a), len(b)) + 1)


def test_matching_stats():
    for a, b in (("xabcy", "zabc"), ("", "a"), ("aa", ""), ("abab", "ba")):
        want = [max((k for k in range(end + 1) if a[end - k : end] in b), default=0) for end in range(1, len(a) + 1)]
        assert kernel.matching_stats(a, b) == want


def test_chain_cap():
    assert [kernel.delta_to_chain_cap(d) for d in (0, 1, 0.01, 0.05, 0.1, 0.2, 0.5)] == [2**32 - 1, 1, 10, 5, 4, 3, 2]


def test_hash_vectors():
    assert [f"{lsh.fnv1a(x):x}" for x in (b"", b"a", b"foobar")] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8"]
    a, b = lsh.permutations(2)
    assert [f"{x:x}" for x in (a[0], b[0], a[1], b[1])] == ["dc1b77ae0bf34dad", "64f0eeb9026e6076", "7b07ce91e5906137", "305f050c368dcc74"]
    for text in ("", "abc", "123456789", "1234567890", "žluťoučký kůň"):
        raw = text.encode()
        want = {lsh.fnv1a(raw[k : k + 9]) for k in range(max(1, len(raw) - 8))}
        assert set(lsh.shingles(text).tolist()) == want
