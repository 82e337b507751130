import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from uttera.operators import ngram, subword, vocab

TEXTS = ["abba", "abba", "abbb", "  ", "b😀"]


def by_hand(texts, order):
    counts, totals = Counter(), Counter()
    for text in filter(None, (t.strip() for t in texts)):
        symbols = ["<s>"] * (order - 1) + list(text) + ["</s>"]
        for i in range(order - 1, len(symbols)):
            context = ngram.SEP.join(symbols[i - order + 1 : i])
            counts[context, symbols[i]] += 1
            totals[context] += 1
    return counts, totals


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_counts_and_scores(spark, tmp_path, order):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    model = ngram.train(df, "t", order, 0.1)
    counts, totals = by_hand(TEXTS, order)
    assert {(r["context"], r["token"]): r["n"] for r in model.counts.collect()} == counts
    assert {r["context"]: r["total"] for r in model.totals.collect()} == totals
    meta = model.meta.first()
    assert (meta["lines"], meta["vocab_size"]) == (4, 4)

    def score(text, eos=True):
        symbols = ["<s>"] * (order - 1) + list(text) + (["</s>"] if eos else [])
        total = 0.0
        for i in range(order - 1, len(symbols)):
            c = ngram.SEP.join(symbols[i - order + 1 : i])
            total += math.log((counts[c, symbols[i]] + 0.1) / (totals[c] + 0.4))
        return total

    probes = spark.createDataFrame([(i, t) for i, t in enumerate(["abba", "abza", "", "b😀b"])], "i int, t string")
    for limit in ("10m", "-1"):  # broadcast, then sorted and merged
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        got = {r["i"]: r["score"] for r in ngram.score_text(probes, "i", "t", model).collect()}
        for i, t in enumerate(["abba", "abza", "", "b😀b"]):
            assert got[i] == pytest.approx(score(t)), (t, limit)
        ext = {r["i"]: r["score"] for r in ngram.score_extension(probes, "i", "t", model).collect()}
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert ext[0] == pytest.approx(score("abba", False) - score("abb", False)) and ext[2] == 0.0
    assert got[0] > got[1]
    path = str(tmp_path / "lm")
    ngram.save_lm(model, path)
    again = ngram.load_lm(spark, path)
    assert {r["i"]: r["score"] for r in ngram.score_text(probes, "i", "t", again).collect()} == pytest.approx(got)


def test_order_must_be_positive(spark):
    with pytest.raises(ValueError):
        ngram.ngram_counts(spark.createDataFrame([("a",)], "t string"), "t", 0).collect()


def test_rescoring(spark):
    model = ngram.train(spark.createDataFrame([("abab",)] * 5, "t string"), "t", 2, 0.1)
    rows = [(0, "ab", -1.0), (0, "zz", -0.9), (1, "a", -1.0), (1, "abab", -1.0)]
    df = spark.createDataFrame(rows, "utterance_id int, text string, acoustic double")
    best = {r["utterance_id"]: r["text"] for r in ngram.rescore_nbest(df, model, 0.5, 0.0).collect()}
    assert best[0] == "ab" and best[1] == "a"
    longer = {r["utterance_id"]: r["text"] for r in ngram.rescore_nbest(df, model, 0.5, 5.0).collect()}
    assert longer[1] == "abab"


def test_vocabulary(spark):
    df = spark.createDataFrame([("баб",), ("a b",)], "t string")
    table = vocab.char_vocab(df, "t")
    rows = {r["token"]: r["id"] for r in table.collect()}
    assert rows == {"<blank>": 0, " ": 1, "a": 2, "b": 3, "а": 4, "б": 5}
    assert {r["token"] for r in vocab.char_vocab(df, "t", 2).collect()} == {"<blank>", "б"}
    ids = vocab.encode_chars(df, "t", table)
    assert [r["ids"] for r in ids.collect()] == [[5, 4, 5], [2, 1, 3]]
    odd = spark.createDataFrame([([0, 1, 0, 0, 1, 0],)], "ids array<int>")
    first = table.filter("id = 1").first()["token"]
    assert odd.select(vocab.decode_ids(F.col("ids"), table)).first()[0] == first * 2
    for bad in ([1, 99], [-1], [None]):
        with pytest.raises(Exception, match="id not in the vocabulary"):
            spark.createDataFrame([(bad,)], "ids array<int>").select(vocab.decode_ids(F.col("ids"), table)).collect()
    back = ids.select(vocab.decode_ids(F.col("ids"), table)).collect()
    assert [r[0] for r in back] == ["баб", "a b"]
    more = spark.createDataFrame([("axyx",)], "t string")
    assert {r["token"]: r["n"] for r in vocab.unknown_chars(more, "t", table).collect()} == {"x": 2, "y": 1}
    with pytest.raises(Exception, match="not in the vocabulary: x y"):
        vocab.encode_chars(more, "t", table).collect()
    assert vocab.vocab_match(table, table).count() == 0
    assert vocab.vocab_match(table, vocab.char_vocab(df, "t", 2)).count() == 6


def test_token_lengths(spark):
    df = spark.createDataFrame([("abc", 0), ("abc", 7), ("", None), ("abcd", None)], "t string, token_length bigint")
    assert [r["token_length"] for r in vocab.fill_token_lengths(df, "t").collect()] == [3, 7, 1, 4]


CORPUS = "low lower lowest newer newest wider new new aaaa aaa the then there this that thin".split()


def merges_by_hand(words, n):
    table = {w: (list(w), c) for w, c in Counter(words).items()}
    done = []
    while len(done) < n:
        pairs = Counter()
        for symbols, c in table.values():
            for pair in zip(symbols, symbols[1:]):
                pairs[pair] += c
        if not pairs:
            break
        a, b = min(pairs, key=lambda p: (-pairs[p], p))
        done.append((a, b, pairs[a, b]))
        for word, (symbols, c) in table.items():
            out = []
            for s in symbols:
                if out and s == b and out[-1] == a:
                    out[-1] = a + b
                else:
                    out.append(s)
            table[word] = (out, c)
    return done


@pytest.mark.parametrize("ahead", [3, 500])
def test_merges_equal_one_at_a_time(spark, ahead):
    words = subword.word_counts(spark.createDataFrame([(" ".join(CORPUS),)], "t string"), "t")
    got, table = subword.bpe_merges(words, 18, ahead)
    assert got == merges_by_hand(CORPUS, 18)
    framed = {r["framed"].replace(subword.OPEN, "").replace(subword.CLOSE, "") for r in table.collect()}
    assert framed == set(CORPUS)


def test_subword_kinds(spark):
    df = spark.createDataFrame([(" ".join(CORPUS),)] * 2, "t string")
    assert subword.subword_vocab(df, "t", 1, "word").first()["piece"] == "new"
    assert subword.subword_vocab(df, "t", 1, "char").first()["piece"] == "e"
    letters = set("".join(CORPUS))
    bpe = subword.subword_vocab(df, "t", len(letters) + 4, "bpe").collect()
    assert len(bpe) == len(letters) + 4 and letters <= {r["piece"] for r in bpe}
    uni = subword.subword_vocab(df, "t", len(letters) + 6, "unigram").collect()
    assert len(uni) <= len(letters) + 6 and letters <= {r["piece"] for r in uni}
    assert sum(math.exp(r["logp"]) for r in uni) == pytest.approx(1.0, abs=1e-6)
    with pytest.raises(ValueError):
        subword.subword_vocab(df, "t", 5, "other")


def test_expected_counts_are_those_of_all_segmentations():
    import itertools

    import pandas as pd

    logp = {k: math.log(p) for k, p in {"a": 0.3, "b": 0.2, "ab": 0.3, "ba": 0.1, "aba": 0.1}.items()}
    word = "abab"
    want, total = Counter(), 0.0
    for cuts in itertools.product([0, 1], repeat=3):
        parts, start = [], 0
        for i, cut in enumerate(cuts, 1):
            if cut:
                parts.append(word[start:i])
                start = i
        parts.append(word[start:])
        if all(p in logp for p in parts):
            weight = math.exp(sum(logp[p] for p in parts))
            total += weight
            for p in parts:
                want[p] += weight
    out = next(subword._expected_counts(logp, 8)(iter([pd.DataFrame({"word": [word], "n": [3]})])))
    got = dict(zip(out["piece"], out["n"]))
    assert got == pytest.approx({k: 3 * x / total for k, x in want.items()})


def test_all_letters_are_kept(spark):
    letters = [chr(0x4E00 + i) for i in range(120)]
    df = spark.createDataFrame([("".join(letters[i : i + 3]),) for i in range(118)] + [("ab ab ab",)], "t string")
    for kind, more in (("bpe", {}), ("unigram", {"seeds": 20})):
        pieces = {r["piece"] for r in subword.subword_vocab(df, "t", 10, kind, **more).collect()}
        assert {*letters, "a", "b"} <= pieces, kind


def test_vocabularies_of_different_types_never_match(spark):
    table = spark.createDataFrame([("<blank>", 0), ("a", 1)], "token string, id int")
    assert vocab.vocab_match(table, table).count() == 0
    told = vocab.vocab_match(table, table, ("character", "bpe")).collect()
    assert sorted(r["only_in"] for r in told) == ["left: character", "right: bpe"]


def test_pair_counts_follow_merges_without_a_recount(spark, monkeypatch):
    monkeypatch.setattr(subword, "WRITE_EVERY", 3)  # tables are written in between several times
    words = subword.word_counts(spark.createDataFrame([(" ".join(CORPUS),)], "t string"), "t")
    got, _ = subword.bpe_merges(words, 12)
    assert got == merges_by_hand(CORPUS, 12)
    framed = words.select(subword._framed(F.col("word")).alias("framed"), F.col("n").cast("bigint").alias("n"))
    after = framed.withColumn("framed", subword._merged(F.col("framed"), got))
    kept = subword._changed_counts(subword.pair_counts(framed), framed, got)
    assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in subword.pair_counts(after).collect()}
    assert subword.pair_changes(framed, [("q", "q", 1)]).count() == 0  # no word holds it, so none is counted


def test_words_of_a_length_are_worked_out_together():
    """expected counts come from arrays of words; they are those of the single words in logarithms, rare and long words too."""
    import numpy as np
    import pandas as pd

    logp = {"a": -1.0, "b": -2.0, "é": -3.0, "ab": -1.5, "ba": -2.5, "aba": -2.0, "bab\x00": -4.0, "\x00": -60.0}
    words = ["a", "b", "ab", "aé", "abab", "baba", "xaba", "bab\x00", "\x00" * 9, "ab" * 50, "ab" * 150, "x", "éx"]
    counts = [float(i + 1) for i in range(len(words))]
    model = subword._Pieces(logp, 8)
    place = {name: i for i, name in enumerate(model.names)}
    alone = np.zeros(len(place))
    for word, n in zip(words, counts):
        model.add_by_logs(word, n, place, alone)
    out = next(subword._expected_counts(logp, 8)(iter([pd.DataFrame({"word": words, "n": counts})])))
    assert dict(zip(out["piece"], out["n"])) == pytest.approx({k: alone[i] for k, i in place.items() if alone[i]})
    together = np.zeros(len(place))
    assert model.add(["abab", "bbbb", "xaba", "\x00ab\x00"], np.ones(4), together) == [2]  # no pieces make it up


def test_decoding_counts_the_corpus_once(spark, monkeypatch):
    """encoding and decoding read one vocabulary that lies in files, instead of counting the corpus for each."""
    from uttera.catalog import language

    seen = []
    whole = language.vocab.decode_ids
    monkeypatch.setattr(language.vocab, "decode_ids", lambda ids, table: seen.append(table) or whole(ids, table))
    language.array_decode(spark, "/root/testdata/sf0.001")
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "Aggregate" not in plan


def test_a_round_counts_its_own_merges_alone(spark, monkeypatch):
    """no merge's changes are counted in a second round."""
    words = spark.createDataFrame([("abcabd", 5), ("bcdbcd", 3), ("cabcad", 2)], "word string, n bigint")
    counted = []
    whole = subword._changed_counts
    monkeypatch.setattr(subword, "_changed_counts", lambda c, w, merges: counted.extend(merges) or whole(c, w, merges))
    got, _ = subword.bpe_merges(words, 4)
    assert counted == got[: len(counted)] and len(counted) < len(got) == 4
