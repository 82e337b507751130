import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from uttera.llm import pii_tagger as pii

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            total = sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(digits[::-1]))
            fits = (True, kind == 1 and all(int(p) <= 255 for p in m.group().split(".")), 13 <= len(digits) <= 19 and total % 10 == 0, 9 <= len(digits) <= 15)
            if fits[kind]:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="0011234a.@+- ()_%é\n", max_size=60))
def test_base_spans_of_any_text(text):
    assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize("text", ["a.b@c.d_e@f.g x@y", "1.2.3.4.5.6.7.8", "+1 (555) 010-9999 +49 1.2.3", "4111 1111 1111 1111-", "ü@ü.de a@b.c.@d.e",
                                  "000255.1.1.1 256.1.1.1 1.1.1.0000000000001", "a@@b.c", "+1" + " " * 50 + "2345678 9"])
def test_base_spans_of_hard_cases(text):
    assert pii.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    n = 400_000
    for text in ("a" * n + "@", "1" * n, "1." * n, "+1" + " " * n, "a@" * n, "+" * n, "1 " * n, "+1(" * n):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def tiny():
    rng = np.random.default_rng(1)
    tagger = pii.Tagger.fresh(4, 2)
    tagger.moves += rng.normal(0, 0.5, tagger.moves.shape).astype(np.float32)
    x = rng.integers(1, pii.CLASSES, (3, 6)).astype(np.uint8)
    x[2, 4:] = pii.PAD
    return tagger, x, rng.integers(0, pii.TAGS, (3, 6))


def loss(tagger, x, tags):
    scores = tagger.emissions(x).astype(np.float64)
    total = 0.0
    for w in range(len(x)):
        paths = [path_score(tagger, scores[:, w], p) for p in itertools.product(range(pii.TAGS), repeat=x.shape[1])]
        total += np.logaddexp.reduce(paths) - path_score(tagger, scores[:, w], tags[w])
    return total / len(x)


def path_score(tagger, scores, path):
    return tagger.first[path[0]] + sum(scores[t, k] for t, k in enumerate(path)) + sum(tagger.moves[a, b] for a, b in zip(path, path[1:], strict=False))


def test_viterbi_and_marginals_against_all_paths(tiny):
    tagger, x, _ = tiny
    scores = tagger.emissions(x)
    tags, marginals = tagger.viterbi(scores), tagger.marginals(scores)
    for w in range(len(x)):
        paths = list(itertools.product(range(pii.TAGS), repeat=x.shape[1]))
        values = np.array([path_score(tagger, scores[:, w].astype(np.float64), p) for p in paths])
        assert tuple(tags[w]) == paths[int(values.argmax())]
        p = np.exp(values - np.logaddexp.reduce(values))
        for t in (0, 3, 5):
            for k in range(pii.TAGS):
                assert marginals[t, w, k] == pytest.approx(sum(q for path, q in zip(paths, p, strict=True) if path[t] == k), abs=1e-4)


def test_gradient_against_differences(tiny):
    tagger, x, tags = tiny
    x, tags = x[:2, :4], tags[:2, :4]
    for a, g in zip(tagger.arrays(), tagger.gradient(x, tags), strict=True):
        for at in list(np.ndindex(a.shape))[:: max(1, a.size // 6)]:
            old = a[at]
            a[at] = old + 1e-2
            up = loss(tagger, x, tags)
            a[at] = old - 1e-2
            down = loss(tagger, x, tags)
            a[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-2, abs=5e-3)


def test_windows_cover_every_trigger_and_are_reconciled():
    rng = np.random.default_rng(2)
    for n in (0, 1, 63, 64, 65, 127, 128, 129, 500):
        text = "".join(rng.choice(list("ab 1@é"), n))
        starts, x = pii.windows_of(text)
        covered = {int(s) + k for s in starts for k in range(pii.WINDOW)}
        assert {i for i, c in enumerate(text) if c in "1@"} <= covered
    tags = np.zeros((2, pii.WINDOW), np.int8)
    tags[0, 60:128], tags[1, 0:10] = 1, 1
    found = pii.reconciled(300, np.array([0, 64]), tags, np.ones_like(tags, np.float32))
    assert found == [(0, 60, 96, 1.0)]


def test_table_with_odd_rows(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(300):
        n = rng.integers(0, 10, 6)
        forms = [f"joe.{n[0]}{n[1]}@mail{n[2]}.example.com", f"{n[0]}1.{n[1]}2.{n[2]}3.{n[3]}4", f"+1 (4{n[0]}{n[1]}) 555-01{n[2]}{n[3]}", "word"]
        rows.append((i, f"some text here {forms[i % 4]} and more of it " * 2, 1, "x"))
    rows += [(None, None, 1, "x"), (1000, "", 1, "x"), (1001, "4111 1111 1111 1111", 1, "x"), (1001, "4111 1111 1111 1111", 1, "x"), (1002, "no " * 100000 + "a@b.c", 2, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base int, record string")
    tagger = pii.fit(docs)
    assert tagger is not None
    for r in pii.find_personal_data(docs, tagger).collect():
        text = r["record"]["text"] or ""
        base = [(pii.KINDS.index(s["kind"]), s["start"], s["end"]) for s in r["base"]]
        assert base == plain(text)
        for s in r["added"]:
            assert pii.sound(pii.KINDS.index(s["kind"]), text[s["start"] : s["end"]])
            assert all(s["end"] <= a or s["start"] >= b for _, a, b in base)
    assert pii.find_personal_data(docs.limit(0), tagger).count() == 0
    assert pii.fit(docs.filter("text = ''")) is None
    assert pii.find_personal_data(docs, None).count() == docs.count()


def test_the_network_learns_and_adds_what_no_pattern_matches(spark):
    rng = np.random.default_rng(8)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    rows = [(i, f"erty and the fon +1 ({digits(3)}) 555-{digits(4)} with inder " + " ".join(rng.choice(["an", "ther", "ing"], 20))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tagger = pii.fit(docs)
    odd = spark.createDataFrame([(1, "anther ing +1 (415) 555/0134 with inder an ing")], "doc_id long, text string")
    x = pii.windows_of("anther ing +1 (415) 555/0134 with inder an ing")[1]
    tags, _ = pii._decode(tagger, x)
    assert (tags[0] == 4).sum() >= 8
    assert pii.find_personal_data(odd, tagger).count() == 1


def test_query_spans_hash_is_that_of_the_listing(spark, folder):
    from uttera.llm.catalog import op9_bilstm_crf_pii

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in op9_bilstm_crf_pii(spark, folder).collect():
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in plain(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))


FORMS = {0: "joe.77@mail3.example.com", 1: "97.51.17.173", 2: "4111111111111111", 3: "+1 (415) 555-0134"}


@pytest.mark.parametrize("kind", FORMS)
def test_rewrites_are_sound_and_are_what_no_pattern_matches(kind):
    text = "an ther " * 20 + FORMS[kind] + " ing an" * 20
    seen = set()
    for seed in range(60):
        for passage, k, a, b in pii.altered(text, random.Random(seed)):
            assert len(passage) <= pii.WINDOW
            if k < 0:
                continue
            form = passage[a:b]
            seen.add(form)
            assert k == kind and pii.sound(kind, form)
            assert all(e <= a or s >= b for _, s, e in plain(passage))
            assert pii._only_digits(form) in pii._only_digits(FORMS[kind])
            assert len(pii.windows_of(passage)[0])
    assert len(seen) >= 5


def test_decoys_hold_no_personal_data():
    for seed in range(300):
        form = pii.decoy(random.Random(seed))
        assert not plain(form) and not any(pii.sound(kind, form) for kind in (0, 2))


def test_windows_with_spelt_signs_alone_run():
    for text in ("joe at example.com", "joe [at] example", "joe (at) x", "joe x dot com"):
        assert len(pii.windows_of("é " * 300 + text)[0])
    assert not len(pii.windows_of("an at of the dots " * 100)[0])


def test_query_lists_forms_that_no_pattern_matches(spark, tmp_path):
    from uttera.llm.catalog import op9_bilstm_crf_pii

    rng = np.random.default_rng(8)
    words = ["an", "ther", "ing", "und", "la", "of", "re", "Es"]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    around = lambda: " ".join(rng.choice(words, rng.integers(8, 20)))

    def card():
        head = "4" + digits(14)
        return next(head + str(k) for k in range(10) if pii.luhn(head + str(k)))

    make = (
        lambda: f"{rng.choice(words).lower()}.{digits(2)}@mail{digits(1)}.example.com",
        lambda: ".".join(str(k) for k in rng.integers(10, 256, 4)),
        card,
        lambda: f"+1 ({digits(3)}) 555-{digits(4)}",
    )
    rows = [(i, f"{around()} {make[i % 4]()} {around()}") for i in range(400)]
    planted = {}
    for i in range(400, 480):
        kind = i % 4
        form, drawn = None, random.Random(i)
        while form is None or plain(form):
            form = pii.rewritten(kind, make[kind](), drawn)
        head = around() + " "
        planted[i] = f"{pii.KINDS[kind]}:{len(head)}:{len(head) + len(form)}"
        rows.append((i, f"{head}{form} {around()}"))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in op9_bilstm_crf_pii(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    hit = sum(planted[i] in found[i]["spans"].split(",") for i in planted)
    wrong = sum(len(set(found[i]["spans"].split(",")) - {planted.get(i, "")}) - (i not in planted) for i in found if found[i]["spans"])
    assert hit >= 0.6 * len(planted)
    assert wrong <= 0.1 * hit
    assert all(found[i][f"n_{k}"] == 0 for i in planted for k in pii.KINDS)
