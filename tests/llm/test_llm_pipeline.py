"""The stages of the pipeline against brute force, each on its own input."""

from collections import Counter, defaultdict

import corpus_pipeline
from test_llm_fm_index import brute as contaminated_brute
from test_llm_simhash import plain_components, plain_fingerprint

from uttera.llm import factorisation, mixing
from uttera.llm.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_the_sample(spark, folder):
    docs = table(spark, folder, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["factorisation_quality", "simhash_near_dedup", "fm_index_decontamination", "golden_ratio_mix", "feistel_shards"]

    good = stages["factorisation_quality"](spark, docs, folder).cache()
    machine = factorisation.fit(docs, table(spark, folder, "labels"))
    scores = {r["doc_id"]: r["score"] for r in factorisation.score(docs, machine).select("record.doc_id", "score").collect()}
    assert {r["doc_id"] for r in good.collect()} == {i for i, s in scores.items() if s >= 0.5} and good.columns == COLUMNS

    single = stages["simhash_near_dedup"](spark, good, folder).cache()
    prints = [(r["doc_id"], plain_fingerprint(r["text"])) for r in good.collect()]
    low = plain_components(prints)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(d for d, f in prints if low[f] == d) and single.columns == COLUMNS

    clean = stages["fm_index_decontamination"](spark, single, folder).cache()
    items = [(r["item_id"], r["text"]) for r in table(spark, folder, "benchmark").collect()]
    found = contaminated_brute([(r["doc_id"], r["text"]) for r in single.collect()], items)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d, n, hit, _ in found if not (hit and 20 * hit >= n))
    assert clean.columns == COLUMNS

    mixed = stages["golden_ratio_mix"](spark, clean, folder).cache()
    assert mixed.columns == COLUMNS
    slim = clean.select("doc_id", "source", mixing.word_count("text").alias("size"), mixing.shuffle_key("doc_id", "text").alias("key"))
    targets = {r["source"]: (min(round(r["target"]), 2 * r["source_size"]), r["source_size"]) for r in mixing.source_targets(slim).collect()}
    at, want = defaultdict(int), Counter()
    for r in sorted(slim.collect(), key=lambda r: r["key"]):
        words, whole = targets[r["source"]]
        for k in range(2):
            want[r["doc_id"]] += at[r["source"]] + k * whole + r["size"] // 2 < words
        at[r["source"]] += r["size"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == +want

    shards = stages["feistel_shards"](spark, mixed, folder)
    assert shards.columns == [*COLUMNS, "shard", "slot"]
    by = defaultdict(list)
    for r in shards.collect():
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and sum(map(len, by.values())) == mixed.count()


def test_run_writes_and_rereads_every_stage(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns == [*COLUMNS, "shard", "slot"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_odd_and_empty_tables(spark, folder):
    rows = [(1, None, None, None, None), (None, "", "en", None, 0), (2, "a b c", "en", "s", 5), (2, "a b c", "en", "s", 5), (3, "w " * 30000, None, "s", -1)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            assert out.columns[:5] == COLUMNS
            assert out.count() <= 2 * docs.count(), name


def test_stages_keep_columns_of_clashing_names(spark, folder):
    more = ["score", "record", "size", "key", "fingerprint", "root", "n_words", "items", "sid", "rank", "target"]
    rows = [(i, f"some words of text number {i}", "en", "s", 30, *[f"{c}{i}" for c in more]) for i in range(1, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in more))
    whole = {r["doc_id"]: tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        assert all(tuple(r)[: len(docs.columns)] == whole[r["doc_id"]] for r in out.collect()), name
