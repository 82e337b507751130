import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from uttera.llm import fragments as fr


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_set(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def plain_components(rows, words, percent):
    sets = [plain_set(t, words) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                group[find(i)] = find(j)
    low = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            low[find(k)] = min(low.get(find(k), d), d)
    return [(d, len(s), low.get(find(k))) for k, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB é\t\n\x0b\x1c ", max_size=60), max_size=4), st.integers(1, 5))
def test_sets_of_any_texts(texts, words):
    raw = [t.encode() for t in texts]
    found = list(fr.ngram_sets(raw, words))
    assert [len(s) for s in found] == [len(plain_set(t, words)) for t in texts]
    assert all((next(fr.ngram_sets([t], words)) == s).all() for t, s in zip(raw, found, strict=True))


def test_pieces_give_the_same_sets(monkeypatch):
    texts = [b"one two three four five", b"", b"a b c", b"word " * 300 + b"averyveryverylongwordindeed" * 9]
    whole = list(fr.ngram_sets(texts, 3))
    monkeypatch.setattr(fr, "TEXT_BYTES", 10)
    monkeypatch.setattr(fr, "AT_ONCE", 7)
    assert all((a == b).all() for a, b in zip(whole, fr.ngram_sets(texts, 3), strict=True))


def test_words_are_told_apart_at_any_length():
    words = [b"a" * n + b"b" * m for n in range(40) for m in range(3)] + [b"\xc3\xa9" * n for n in range(1, 20)]
    words = sorted(set(words) - {b""})
    assert len(np.unique(fr.word_hashes(b" ".join(words))[1])) == len(words)
    assert len({int(next(fr.ngram_sets([t], 4))[0]) for t in (b"a", b"a a", b"a a a", b"a a a a")}) == 4


def test_odd_cells_never_count_more_than_differ():
    rng = np.random.default_rng(2)
    for n in (1, 50, 3000):
        a, b = (np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for _ in range(2))
        b = np.union1d(a[n // 5 :], b[: n // 7])
        apart = int(np.bitwise_count((fr.odd_cells(a) ^ fr.odd_cells(b)).view(np.uint64)).sum())
        assert apart <= len(np.setxor1d(a, b))


def changed(rng, words, n):
    words = list(words)
    for at in rng.integers(0, len(words), n):
        words[at] = f"x{rng.integers(0, 10**6)}"
    return " ".join(words)


@pytest.mark.parametrize(("words", "percent", "first"), [(4, 85, fr.FIRST), (5, 80, 1), (1, 60, 2)])
def test_components_against_brute_force(spark, monkeypatch, words, percent, first):
    monkeypatch.setattr(fr, "FIRST", first)
    monkeypatch.setattr(fr, "GROWTH", 3)
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = rng.choice(vocabulary, 160).tolist()
    line = " the very same line stands in all of these texts again and again"
    rows = [(100 + i, changed(rng, base, int(rng.integers(0, 9)))) for i in range(120)]  # a crowd of near copies
    rows += [(400 + i, " ".join(rng.choice(vocabulary, int(rng.integers(1, 12)))) + line) for i in range(80)]
    rows += [(600 + i, " ".join(rng.choice(vocabulary, 60))) for i in range(30)]
    chain = rng.choice(vocabulary, 300).tolist()
    rows += [(700 + i, " ".join(chain[5 * i : 5 * i + 200])) for i in range(20)]  # each links to the next alone
    rows += [(50, " ".join(base)), (50, " ".join(base)), (None, " ".join(base).upper()), (None, "only here " * 9), (1, None), (2, ""), (3, " \t"), (4, None)]
    rows += [(5, "a b"), (6, "A b"), (7, "a b c"), (8, "long " * 30000), (9, "long " * 70)]
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, class string, n int").repartition(3)
    found = fr.near_copies(docs, words=words, percent=percent).collect()
    want = [(d, n, d if n == 0 else c) for d, n, c in plain_components(rows, words, percent)]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found]
    assert sorted(set(got) ^ set(want), key=str) == [] and len(got) == len(want)
    assert all((r["class_id"] is None) == (r["n_shingles"] == 0) for r in found)


def test_empty_tables_texts_without_words_and_bad_parameters(spark):
    docs = spark.createDataFrame([(1, None), (2, " "), (2, " ")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in fr.near_copies(docs).collect()) == [(1, 0, 1), (2, 0, 2), (2, 0, 2)]
    assert fr.near_copies(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fr.near_copies(docs, percent=101)


def test_another_seed_when_signatures_share_their_first_half(spark, monkeypatch):
    real, seeds = fr.signature, []

    def clashing(grams, seed):
        first, second = real(grams, seed)
        return (5 if seed == 0 else first), second

    monkeypatch.setattr(fr, "signature", clashing)
    monkeypatch.setattr(fr, "_sets", lambda docs, words, seed, plain=fr._sets: seeds.append(seed) or plain(docs, words, seed))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "u v w x y z"), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in fr.near_copies(docs).collect()) == [(1, 1), (2, 2), (3, 1)]
    assert seeds in ([0], [0, 1])  # workers that hold the module already see the plain function
