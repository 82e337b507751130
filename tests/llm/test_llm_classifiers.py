import zlib

import numpy as np
import pytest

from uttera.llm import factorisation as fm
from uttera.llm import toxic_segments as ts
from uttera.llm.common import is_held_out, labelled_sample


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_pairwise_term_equals_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    machine = fm.Machine(0.3, rng.normal(size=fm.DIMENSION), rng.normal(size=(fm.DIMENSION, fm.RANK)))
    index, value = fm.features(b"one two two THREE!!\nfour", 24)
    direct = machine.bias + value @ machine.weights[index]
    for a in range(len(index)):
        for b in range(a + 1, len(index)):
            direct += machine.factors[index[a]] @ machine.factors[index[b]] * value[a] * value[b]
    assert machine.logit(index, value) == pytest.approx(direct)


def test_features_of_odd_texts():
    for text in (b"", b"\n\n", b" ", "ß".encode(), b"\x00" * 10, b"word " * 50000):
        for declared in (None, -5, 0, 3, 10**15):
            index, value = fm.features(text, declared)
            assert len(index) == len(set(index.tolist())) == len(value) and index.max() < fm.DIMENSION and np.isfinite(value).all()


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(4)
    prose = lambda n: " ".join(rng.choice(["ta", "te", "tion", "er", "and", "of", "wild"], n))
    docs, labels = [], []
    for i in range(400):
        bad, toxic = i % 5 == 0, i % 4 == 0
        text = "\n".join([prose(30)] * 3) + "!! $$$ ###" * 20 if bad else prose(60)
        if toxic:
            words = text.split(" ")
            for k in rng.integers(0, len(words), 3):
                words[k] = "Moron," if k % 2 else "scum"
            text = " ".join(words)
        docs.append((i, text, "s", len(text), 0.5, "x"))
        labels.append((i, 0 if bad else 1, 1 if toxic else 0))
    docs += [(1000, None, None, None, None, None), (1001, "", "s", 0, 1.0, None), (None, "moron " * 5, None, -1, None, None), (1002, "x " * 100000, "s", 9, 0.1, "y")]
    docs.append(docs[3])
    labels += [(1000, 1, 0), (5000, 0, 1), (None, 1, 1), (7, None, None), (8, 1, 0), (8, 0, 1)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long, score double, record string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_sample_has_no_held_out_and_no_contradicting_ids(spark, labelled):
    docs, labels = labelled
    ids = {r["doc_id"]: r["label"] for r in labelled_sample(docs, labels, "quality", 1000).collect()}
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 for i in ids) and 8 not in ids
    assert 0 < sum(labelled_sample(docs, labels, "quality", 10).groupBy("label").count().toPandas()["count"]) <= 20
    held = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").select("doc_id", is_held_out().alias("h")).collect()
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in held)


def test_quality_on_held_out_rows(labelled):
    docs, labels = labelled
    scored = fm.score(docs, fm.fit(docs, labels))
    got = {r["record"]["doc_id"]: r["score"] for r in scored.collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == (i % 5 != 0) for i in held]) > 0.97
    assert scored.count() == docs.count() and all(0 <= s <= 1 for s in got.values())
    assert rows_of(scored) == rows_of(fm.score(docs, fm.fit(docs, labels)))


def test_quality_without_labels_or_rows(labelled):
    docs, labels = labelled
    none = fm.fit(docs, labels.limit(0))
    assert {r["score"] for r in fm.score(docs, none).collect()} == {0.5}
    one = fm.fit(docs, labels.filter("quality = 1 and doc_id <> 8"))
    assert all(r["score"] > 0.9 for r in fm.score(docs, one).collect())
    assert fm.score(docs.limit(0), one).count() == 0
    assert fm.score(docs, fm.fit(docs, labels, declared=None), declared=None).count() == docs.count()


def best_segments(scores):
    """All maximal scoring segments by their definition: the best one, then the best on either side of it."""
    def find(a, b):
        top = max(((sum(scores[i:j]), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if top[0] <= 0:
            return []
        i = -top[2]
        j = i - top[1]
        return [*find(a, i), (i, j, sum(scores[i:j])), *find(j, b)]

    return find(0, len(scores))


def test_segments_against_their_definition():
    rng = np.random.default_rng(6)
    lexicon = ts.Lexicon({b"a": 2.0, b"b": 5.0, b"c": 1.0, b"d": -3.0}, -1.0, 1.0, 0.0, 1.0, 0.0)
    for _ in range(150):
        words = list(rng.choice([b"a", b"b", b"c", b"d", b"x"], int(rng.integers(0, 14)), p=[0.15, 0.1, 0.2, 0.1, 0.45]))
        words = [bytes(w) for w in words]
        scores = [lexicon.scores.get(w, lexicon.other) for w in words]
        got = ts.segments(words, lexicon)
        assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in best_segments(scores)))
        assert all(s == pytest.approx(sum(scores[a:b])) for a, b, s in got)


def test_many_hits_in_a_long_text_take_linear_time():
    lexicon = ts.Lexicon({b"a": 1.0}, -1.0, 1.0, 0.0, 1.0, 0.0)
    assert len(ts.segments([b"a", b"x", b"x"] * 200000, lexicon)) == 200000


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    scored = ts.score(docs, ts.fit(docs, labels))
    got = {r["record"]["doc_id"]: (r["score"], r["passages"]) for r in scored.collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i][0] >= 0.7) == (i % 4 == 0) for i in held]) > 0.97
    assert got[None][0] >= 0.7 and got[1000][0] < 0.7 and got[1001][1] == [] and got[1002][1] == []
    assert scored.count() == docs.count()


def test_toxicity_without_labels_or_rows(labelled):
    docs, labels = labelled
    lexicon = ts.fit(docs, labels.limit(0))
    assert {r["score"] for r in ts.score(docs, lexicon).collect()} == {0.5}
    assert ts.score(docs.limit(0), ts.fit(docs.limit(0), labels)).count() == 0


def test_sample_table_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    truth = {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    for at, module, label, limit, least in ((0, fm, "quality", 0.5, 0.95), (1, ts, "toxic", 0.7, 0.95)):
        scored = module.score(docs, module.fit(docs, labels, label))
        got = {r["doc_id"]: r["score"] for r in scored.select("record.doc_id", "score").collect()}
        assert np.mean([(got[i] >= limit) == bool(y[at]) for i, y in truth.items()]) >= least
