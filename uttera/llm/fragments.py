"""Join of documents by the Jaccard similarity of their word n-grams, by vertical partitioning.

All n-grams have one global order, rare ones first. The order is cut into ``FRAGMENTS`` fragments of equal weight, and
every document's set falls into one segment for each. Overlaps are counted fragment by fragment, on segments alone, and
summed per pair.

What comes before:

* Documents with equal sets are one class, found by a 128-bit signature. A class with more n-grams of its own than a
  link allows has no partner. This is counted on the fragment of the smallest hashes alone, for all classes, and
  leaves the ones that may have partners.
* Two linked sets share one of the rarest n-grams of each (its prefix). Classes meet on these. Of the m classes of an n-gram
  every one meets those of smaller priority, in rounds: first only the two of smallest priority, then the next 30, and so on.
  Between rounds verified links are put together to components, and classes of one component need not meet any more. A
  dense group of near copies thus costs rows in proportion to its members; pairs of different components are never left out
  but where sizes rule a link out: those of the whole sets, or, as odd or even, those of 512 cells of the hashes.

N-grams are told apart by 64-bit hashes. What matters is a collision between two n-grams of one pair of documents: for
two documents of 20000 words its probability is 2 in 10^11, whatever the size of the corpus. Classes that share the first 64
bits of their signature and not the others are detected, and another seed is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.llm.common import ASCII_LOWER, opened, ragged, texts_in
from uttera.llm.components import connected_components
from uttera.session import scratch_path
from uttera.sources.files import list_files

WORDS = 5
PERCENT = 80
FRAGMENTS = 4
#: Counters behind the global order: a class of hashes each.
COUNTERS = 1 << 20
#: Bits of the filter that keeps hopeless sets from being shuffled, at most.
FILTER_BITS = 1 << 28
#: Cells whose odd or even sizes are compared before two sets meet.
CELLS = 512
#: Classes that meet on an n-gram, from which on sizes and cells are compared inside the join.
CROWDED = 16
#: Pairs whose classes may be broadcast.
FEW_PAIRS = 1 << 18
#: Classes of an n-gram that all others meet in the first round, and by how much they become more in every round.
FIRST, GROWTH = 2, 16
#: Words, and bytes of texts, that are hashed at once.
AT_ONCE = 1 << 16
TEXT_BYTES = 1 << 20
#: Signatures that a task remembers.
REMEMBERED = 1 << 18
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_hashes(text: bytes, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of every word of lower-cased bytes, eight bytes of all words at a time."""
    padded = np.frombuffer(text + b" " * 9, np.uint8)
    inside = ~SPACES[padded]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    start, length = edge[::2], edge[1::2] - edge[::2]
    out = length.astype(np.uint64) * MIX[1] + np.uint64(seed)
    for low in range(0, len(start), AT_ONCE):
        todo, at = np.arange(low, min(low + AT_ONCE, len(start))), 0
        while len(todo):
            left = length[todo] - at
            lane = padded[np.minimum(start[todo, None] + at + np.arange(8), len(padded) - 1)]
            lane[np.arange(8) >= left[:, None]] = 0
            out[todo] = _mixed(out[todo] ^ lane.view("<u8").ravel(), at // 8)
            at += 8
            todo = todo[left > 8]
    return start, out


def _mixed(value: np.ndarray, turn: int) -> np.ndarray:
    value = value * MIX[turn % 2]
    value ^= value >> np.uint64(32)
    value *= MIX[1 - turn % 2]
    return value ^ (value >> np.uint64(29))


def ngram_sets(texts: list[bytes], words: int, seed: int = 0) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams; a text of fewer words, but not none, has one.

    Texts are worked on a megabyte, or one text, at a time.
    """
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= TEXT_BYTES:
            yield from _sets_of(held, words, seed)
            held, size = [], 0
    if held:
        yield from _sets_of(held, words, seed)


def _sets_of(texts: list[bytes], words: int, seed: int) -> list[np.ndarray]:
    start, codes = word_hashes(b" ".join(texts).translate(ASCII_LOWER), seed)
    cuts = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts])).tolist()
    whole = np.full(max(0, len(codes) - words + 1), words, np.uint64)
    for k in range(words):
        whole = _mixed(whole ^ codes[k : k + len(whole)], k)
    sets, first = [], 0
    for end in cuts:
        if end - first >= words:
            sets.append(np.unique(whole[first : end - words + 1]))
        else:
            short = np.full(min(1, end - first), end - first, np.uint64)  # never that of a longer n-gram
            for k in range(first, end):
                short = _mixed(short ^ codes[k], k - first)
            sets.append(short)
        first = end
    return sets


def signature(grams: np.ndarray, seed: int) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(grams.tobytes(), seed)
    return value >> 64, value & (2**64 - 1)


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _sets(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """(doc_id, n, class, proof) of every document: size of its set and the two halves of its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(g), signature(g, seed)) for g in ngram_sets(texts_in(batch.column(1)), words, seed)]
            columns = [_signed([n for n, _ in found]), _signed([s[0] for _, s in found]), _signed([s[1] for _, s in found])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=["doc_id", "n", "class", "proof"])

    return docs.mapInArrow(run, "doc_id long, n long, class long, proof long")


def _grams(docs: DataFrame, words: int, seed: int, below: int, chosen: list[str] | None = None, bits: int = 0) -> DataFrame:
    """(class, n, grams): the hashes up to ``below`` of each set, once for copies that are near each other in a task.

    With ``chosen``, files of a bit filter, only classes that the filter may hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held = None if chosen is None else _bit_filter(chosen, bits)
        for batch in batches:
            names, sizes, lists = [], [], []
            for grams in ngram_sets(texts_in(batch.column(0)), words, seed):
                if not len(grams):
                    continue
                name = signature(grams, seed)[0]
                if name in seen or held is not None and not held(name):
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(name)
                names.append(name)
                sizes.append(len(grams))
                lists.append(grams[: np.searchsorted(grams, np.uint64(below), "right")].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(_signed(names)), pa.array(sizes, pa.int64()), ragged(lists, pa.int64())], names=["class", "n", "grams"]
            )

    return docs.select("text").mapInArrow(run, "class long, n long, grams array<long>")


def _bit_filter(files: list[str], bits: int):
    table = np.zeros(max(1, bits >> 6), np.uint64)
    for address in files:
        system, path = opened(address)
        rows = pq.read_table(path, filesystem=system)
        table[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    shift = 64 - (bits.bit_length() - 1)
    return lambda name: int(table[(name >> shift) >> 6]) >> ((name >> shift) & 63) & 1


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"ngram-join-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _files(df: DataFrame, name: str) -> list[str]:
    path = scratch_path(df.sparkSession, f"ngram-join-{name}")
    df.write.parquet(path)
    return [f for f in list_files(df.sparkSession, path) if f.endswith(".parquet")]


def _missing(n: Column, percent: int) -> Column:
    """How many n-grams of a set of n may lack in a linked one."""
    return F.floor((100 - percent) * n / 100)


def _promising(docs: DataFrame, classes: DataFrame, words: int, percent: int, seed: int) -> DataFrame:
    """Classes without too many n-grams of their own, judged by the smallest hashes."""
    share = min(1.0, 1.6 * (100 - percent) / 100)
    below = min(int(share * 2.0**64), 2**64 - 1)
    each = _grams(docs, words, seed, below).select("class", F.explode("grams").alias("gram"))
    own = each.groupBy("gram").agg(F.min("class").alias("class"), F.max("class").alias("__last")).filter(F.col("class") == F.col("__last"))
    counted = own.groupBy("class").agg(F.count("*").alias("__own"))
    return classes.join(counted, "class", "left").filter(F.coalesce("__own", F.lit(0)) <= _missing(F.col("n"), percent)).drop("__own")


def _full_sets(docs: DataFrame, alive: DataFrame, words: int, seed: int) -> DataFrame:
    """(class, n, grams) of the given classes, one row each."""
    wanted = max(1, alive.count())
    bits = min(FILTER_BITS, max(64, 1 << (16 * wanted - 1).bit_length()))
    place = F.shiftrightunsigned("class", 64 - (bits.bit_length() - 1))
    filled = (
        alive.select(F.shiftright(place, 6).alias("word"), place.bitwiseAND(63).cast("int").alias("bit"))
        .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    )
    sets = _grams(docs, words, seed, 2**64 - 1, _files(filled, "filter"), bits)
    return sets.join(alive.select("class"), "class", "left_semi").dropDuplicates(["class"])


def _order(files: list[str], fragments: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank, fragment) of every counter: rising counts, cut so that fragments hold equally many n-grams."""
    counts = np.zeros(COUNTERS, np.int64)
    for address in files:
        system, path = opened(address)
        rows = pq.read_table(path, filesystem=system)
        counts[rows["counter"].to_numpy()] = rows["n"].to_numpy()
    order = np.argsort(counts, kind="stable")
    rank = np.empty(COUNTERS, np.int32)
    rank[order] = np.arange(COUNTERS, dtype=np.int32)
    before = np.cumsum(counts[order]) - counts[order]
    fragment = np.empty(COUNTERS, np.int8)
    fragment[order] = before * fragments // max(1, int(counts.sum()))
    return rank, fragment


def odd_cells(grams: np.ndarray) -> np.ndarray:
    """A bit for each cell of the hashes' low bits: whether the set has an odd number of n-grams there.

    Where two sets' bits differ, at least one n-gram belongs to one of them alone.
    """
    counts = np.bincount((grams & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
    return np.packbits((counts & 1).astype(bool), bitorder="little").view("<i8")


def _segments(full: DataFrame, percent: int, fragments: int) -> DataFrame:
    """(class, n, fragment, grams, prefix, odd): a row for each segment; that of fragment 0 carries the set's prefix and odd cells."""
    counter = F.shiftrightunsigned(F.col("gram"), 64 - (COUNTERS.bit_length() - 1)).cast("int")
    counted = full.select(F.explode("grams").alias("gram")).groupBy(counter.alias("counter")).agg(F.count("*").alias("n"))
    files = _files(counted, "order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, fragment = _order(files, fragments)
        shift, none = np.uint64(64 - (COUNTERS.bit_length() - 1)), np.empty(0, np.int64)
        for batch in batches:
            names, sizes, parts, lists, prefixes, odds = [], [], [], [], [], []
            values = batch.column(2)
            flat = values.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))
            for name, n, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends, strict=True):
                grams = flat[end - n : end]
                counters = (grams >> shift).astype(np.int64)
                order = np.lexsort((grams, rank[counters]))
                part = fragment[counters]
                for f in range(fragments):
                    own = grams[part == f]
                    if f and not len(own):
                        continue
                    names.append(name)
                    sizes.append(n)
                    parts.append(f)
                    lists.append(own.view(np.int64))
                    prefixes.append(grams[order[: n - -(-percent * n // 100) + 1]].view(np.int64) if f == 0 else none)
                    odds.append(odd_cells(grams) if f == 0 else none)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(parts, pa.int32()), ragged(lists, pa.int64()),
                 ragged(prefixes, pa.int64()), ragged(odds, pa.int64())], names=["class", "n", "fragment", "grams", "prefix", "odd"],
            )

    return full.select("class", "n", "grams").mapInArrow(
        run, "class long, n long, fragment int, grams array<long>, prefix array<long>, odd array<long>"
    )


def _overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """(a, b, common): partial overlaps of each fragment in ``segments``, counted apart and summed per pair.

    The member's segments travel to the hub's, so a hub that many members meet can be split.
    """
    own = segments.select(F.col("class").alias("b"), "fragment", F.col("grams").alias("__b"))
    hub = segments.select(F.col("class").alias("a"), "fragment", F.col("grams").alias("__a"))
    both = pairs.join(own, "b").join(hub, ["a", "fragment"])
    partial = both.select("a", "b", F.size(F.array_intersect("__a", "__b")).cast("long").alias("__n"))
    return partial.groupBy("a", "b").agg(F.sum("__n").alias("common"))


def _linked(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of sets of which the intersection holds ``percent`` of the union at least. ``pairs`` is a written table.

    Segments of classes in no pair are left where they are. For up to FEW_PAIRS pairs their classes are broadcast for it
    (16 bytes a pair), beyond that they are joined like any table.
    """
    asked = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    asked = F.broadcast(asked) if pairs.count() <= FEW_PAIRS else asked
    counted = pairs.join(_overlaps(pairs.select("a", "b"), segments.join(asked, "class", "left_semi")), ["a", "b"])
    return counted.filter((100 + percent) * F.col("common") >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def _traits(segments: DataFrame) -> DataFrame:
    """(class, n, odd), a row per class."""
    return segments.filter("fragment = 0").select("class", "n", "odd")


def _may_link(percent: int, na: str, nb: str, oa: str, ob: str) -> str:
    """What sizes and odd cells tell about a pair."""
    differing = " + ".join(f"bit_count({oa}[{i}] ^ {ob}[{i}])" for i in range(CELLS // 64))
    return (
        f"100 * least({na}, {nb}) >= {percent} * greatest({na}, {nb}) "
        f"and {100 + percent} * ({differing}) <= {100 - percent} * ({na} + {nb})"
    )


def _priority(name: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(name, F.lit(7)), 12)


def _meetings(segments: DataFrame) -> DataFrame:
    """(gram, class, m, component, n, odd): classes on the n-grams of their prefixes that m > 1 classes have there.

    Rows are many and short. Only where more than CROWDED classes meet they carry the traits, which then rule
    pairs out inside the join; other pairs are looked at once they are distinct.
    """
    posts = segments.filter("fragment = 0").select(F.explode("prefix").alias("gram"), "class")
    shared = posts.groupBy("gram").agg(F.count("*").alias("m")).filter("m > 1")
    met = _written(posts.join(shared, "gram"), "posts").withColumn("component", F.col("class"))
    crowd = met.filter(F.col("m") > CROWDED).join(_traits(segments), "class")
    rest = met.filter(F.col("m") <= CROWDED)
    return crowd.unionByName(rest, allowMissingColumns=True)


def class_links(segments: DataFrame, percent: int = PERCENT) -> DataFrame | None:
    """(node, root) of classes with partners: the components of all links; None if there is no link."""
    posts = _written(_meetings(segments), "meetings")
    reached, step, roots, links = 0, FIRST, None, []
    one, other = (_traits(segments).toDF(*names) for names in (("a", "na", "oa"), ("b", "nb", "ob")))
    while (most := posts.agg(F.max("m")).first()[0] or 0) > reached:
        place = _priority("class") / F.lit(float(1 << 52)) * F.col("m")
        hubs = posts.filter((place >= reached) & (place < step)).select(
            "gram", F.col("class").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("odd").alias("oa")
        )
        first = (_priority("a") < _priority("class")) | ((_priority("a") == _priority("class")) & (F.col("a") < F.col("class")))
        met = hubs.join(posts, "gram").filter(first).filter(
            f"ca <> component and (m <= {CROWDED} or {_may_link(percent, 'na', 'n', 'oa', 'odd')})"
        )
        distinct = met.select("a", F.col("class").alias("b")).distinct()
        possible = distinct.join(one, "a").join(other, "b").filter(_may_link(percent, "na", "nb", "oa", "ob"))
        pairs = _written(possible.select("a", "b", "na", "nb"), "pairs")
        found = _written(_linked(pairs, segments, percent), "links")
        reached, step = step, step * GROWTH
        if found.isEmpty():
            continue
        links.append(found)
        roots = connected_components(reduce(DataFrame.unionAll, links))
        if most <= reached:
            break
        named = posts.drop("component").join(roots.toDF("class", "component"), "class", "left")
        named = named.withColumn("component", F.coalesce("component", "class"))
        open_grams = named.groupBy("gram").agg(F.min("component").alias("__low"), F.max("component").alias("__high")).filter("__low <> __high")
        posts = _written(named.join(open_grams.select("gram"), "gram", "left_semi"), "meetings")
    return roots


def near_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, fragments: int = FRAGMENTS
) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) per document.

    ``class_id`` is equal for documents of equal sets, ``component_id`` the smallest doc_id reachable over links, the document's
    own included; null ids count only where a component has no other. Documents without words (null, empty or blank texts)
    are linked with nothing and have a class_id of null. Repeated ids and rows keep a row each. An empty table gives no rows.
    Other columns are not read.
    """
    if not 50 < percent <= 100 or words < 1 or fragments < 1:
        raise ValueError("percent must be above 50 and at most 100, words and fragments at least 1")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    seed = 0
    while True:
        sets = _written(_sets(docs, words, seed), "sets")
        proved = sets.filter("n > 0").groupBy("class").agg(
            F.min("n").alias("n"), F.min("doc_id").alias("low"), F.min("proof").alias("__p"), F.max("proof").alias("__q")
        )
        classes = _written(proved, "classes")
        if classes.filter("__p <> __q").isEmpty():
            break
        seed += 1
    alive = _written(_promising(docs, classes.select("class", "n"), words, percent, seed), "promising")
    full = _written(_full_sets(docs, alive, words, seed), "full")
    segments = _written(_segments(full, percent, fragments), "segments")
    roots = class_links(segments, percent)
    lows = classes.select("class", "low")
    if roots is None:
        named = lows.withColumnRenamed("low", "component_id")
    else:
        rooted = _written(lows.join(roots.withColumnRenamed("node", "class"), "class"), "rooted")
        least = _written(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "least")
        linked = rooted.join(least, "root").select("class", "component_id")
        named = lows.join(linked, "class", "left").select("class", F.coalesce("component_id", "low").alias("component_id"))
    placed = _written(named, "components")
    own = F.when(F.col("n") > 0, F.col("class"))
    found = sets.withColumn("class", own).join(placed, "class", "left")
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("class").alias("class_id"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
