"""SimHash near-duplicates found by pigeonring filtering.

A text's fingerprint has 64 bits. Two fingerprints link when at most ``most`` bits differ. The bits are cut
into ``most + 1`` segments on a ring. If at most ``most`` bits differ, the pigeonring principle gives a
segment from which every chain of k consecutive segments has at most floor(k * most / segments) differing
bits. The first two links of such a chain are the key on which candidates meet (one segment equal, the next
within one bit); longer chains and the whole distance are checked before a link is made.

Equal fingerprints are one node. Candidates of a key are searched breadth-first and only a spanning forest of
links leaves a key, so a dense group of near copies costs rows in proportion to its members, not to its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uttera.llm.common import ASCII_LOWER, map_texts
from uttera.llm.components import connected_components
from uttera.session import cut_lineage

SEED = 42
WORDS = 4
MOST = 4
#: Members of one key that meet in one task; larger keys are cut into pairs of blocks of this size.
BLOCK = 1 << 18


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Majority bits of the XXH64 of all word shingles; 0 for a text without words."""
    parts = text.translate(ASCII_LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = [0, *ends[: len(parts) - words].tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, stops, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        chunk = hashes[k : k + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(chunk, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """(record, fingerprint): the 64 bits as a signed bigint. Null and empty texts have fingerprint 0."""

    def make():
        def work(texts, _):
            return [pa.array(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))]

        return work

    return map_texts(docs, make, [T.StructField("fingerprint", T.LongType())], text)


def segments(most: int) -> list[tuple[int, int]]:
    """(shift, width) of most + 1 segments of the 64 bits, widths at most one apart."""
    n = most + 1
    cuts = [round(64 * i / n) for i in range(n + 1)]
    return [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(n)]


def _chain_keys(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fingerprint, probe). Every fingerprint is stored under its own key of each start; it probes
    that key and the keys with one set bit of the second segment cleared. Of two fingerprints that differ
    in one bit there, exactly one has it set, so each pair of a chain meets."""
    cut = segments(most)
    n = len(cut)
    budget = [(k + 1) * most // n for k in range(n)]
    keys, owners, probes = [], [], []
    for i in range(n):
        (s0, w0), (s1, w1) = cut[i], cut[(i + 1) % n]
        first = (fps >> np.uint64(s0)) & np.uint64((1 << w0) - 1)
        second = (fps >> np.uint64(s1)) & np.uint64((1 << w1) - 1)
        base = (np.uint64(i) << np.uint64(58)) | (first << np.uint64(w1))
        keys += [base | second, base | second]
        owners += [fps, fps]
        probes += [np.zeros(len(fps), bool), np.ones(len(fps), bool)]
        for bit in range(w1 if n > 1 and budget[1] >= 1 else 0):
            has = (second >> np.uint64(bit)) & np.uint64(1) == 1
            keys.append((base | (second & ~np.uint64(1 << bit)))[has])
            owners.append(fps[has])
            probes.append(np.ones(int(has.sum()), bool))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(probes)


def _ring_passes(diff: np.ndarray, most: int) -> np.ndarray:
    """Whether some start has all its chains within their proportional budgets."""
    cut = segments(most)
    n = len(cut)
    counts = np.stack([np.bitwise_count((diff >> np.uint64(s)) & np.uint64((1 << w) - 1)) for s, w in cut]).astype(np.int16)
    found = np.zeros(diff.shape, bool)
    for i in range(n):
        total, fits = np.zeros(diff.shape, np.int16), np.ones(diff.shape, bool)
        for k in range(n):
            total = total + counts[(i + k) % n]
            fits &= total <= (k + 1) * most // n
        found |= fits
    return found


def _near(x: np.uint64, others: np.ndarray, most: int) -> np.ndarray:
    """Positions of the others within the distance: ring filter first, then the full check."""
    diff = others ^ x
    at = np.flatnonzero(_ring_passes(diff, most)) if len(diff) > 64 else np.arange(len(diff))
    return at[np.bitwise_count(diff[at]) <= most]


def _forest(stored: np.ndarray, probing: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning links of the graph between stored and probing members of one key."""
    links = []
    sides = [np.unique(stored), np.unique(probing)]  # not yet reached
    while len(sides[0]):
        root, sides[0] = sides[0][0], sides[0][1:]
        queue = [(0, root)]
        while queue:
            side, x = queue.pop()
            other = 1 - side
            near = _near(x, sides[other], most)
            if len(near):
                reached = sides[other][near]
                links.append((np.full(len(near), x), reached))
                sides[other] = np.delete(sides[other], near)
                queue += [(other, y) for y in reached]
    return links


def _links(keys: np.ndarray, fps: np.ndarray, probes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole key groups; rows are sorted by key."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    ends = np.r_[starts[1:], len(keys)]
    mixed = np.add.reduceat(probes.astype(np.int64), starts)
    stored = (ends - starts) - mixed
    # A fingerprint probes its own key, so two rows of which one is stored are one member alone.
    busy = np.flatnonzero((stored > 0) & (mixed > 1))
    a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for g in busy:
        f, p = fps[starts[g] : ends[g]], probes[starts[g] : ends[g]]
        for x, y in _forest(f[~p], f[p], most):
            a.append(x)
            b.append(y)
    a, b = np.concatenate(a), np.concatenate(b)
    return a[a != b], b[a != b]


def links_of(fingerprints: DataFrame, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints connected by pairs within the distance.

    ``fingerprints`` has one bigint column ``fingerprint`` of distinct values. Keys held by more than
    ``block`` members are cut into blocks, and every pair of blocks is searched in a task of its own.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 4096):
                keys, owners, probes = _chain_keys(fps[at : at + 4096], most)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(owners.view(np.int64)), pa.array(probes)],
                    names=["key", "fingerprint", "probe"],
                )

    keyed = fingerprints.mapInArrow(spread, "key long, fingerprint long, probe boolean")
    heavy = (
        keyed.filter("not probe").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block)
        .select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    )
    # At most members / block keys are heavy; mostly there is none.
    placed = keyed.join(F.broadcast(heavy), "key", "left").select(
        "key", "fingerprint", "probe", F.coalesce("blocks", F.lit(1)).alias("blocks")
    )
    own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    placed = placed.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key",
        F.when(F.col("probe"), F.col("__other")).otherwise(own).alias("i"),
        F.when(F.col("probe"), own).otherwise(F.col("__other")).alias("j"),
        "fingerprint",
        "probe",
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(cols):
            a, b = _links(*cols, most)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held: list[list[np.ndarray]] = []  # rows of the last key, which the next batch may go on with
        last = None

        def together(parts):
            return [np.concatenate([p[k] for p in parts]) for k in range(3)]

        for batch in batches:
            if not batch.num_rows:
                continue
            key, i, j = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            new = np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
            new[0] = last != (key[0], i[0], j[0])
            group = np.cumsum(new)
            cols = [group, batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64),
                    batch.column(4).to_numpy(zero_copy_only=False)]
            if new[0] and held:
                yield out(together(held))
                held = []
            tail = int(np.searchsorted(group, group[-1]))
            if group[0] == group[-1] and not new[0]:
                cols[0] = np.zeros(len(group), group.dtype)
                held.append(cols)
            else:
                head = [c[:tail] for c in cols]
                if held:
                    held_rows = together(held)
                    held_rows[0][:] = 0
                    head = [np.concatenate([h, c]) for h, c in zip(held_rows, head, strict=True)]
                if len(head[0]):
                    yield out(head)
                held = [[c[tail:] for c in cols]]
                held[0][0] = np.zeros(len(held[0][0]), group.dtype)
            last = (key[-1], i[-1], j[-1])
        if held:
            yield out(together(held))

    return (
        placed.repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
        .mapInArrow(search, "a long, b long")
    )


def components_of(prints: DataFrame, doc_id: str = "doc_id", most: int = MOST) -> DataFrame:
    """(fingerprint, root, component_id) for each distinct fingerprint of (doc_id, fingerprint).

    component_id is the smallest doc_id reachable over links; null ids count only where a component has
    no other. ``root`` names the component even then.
    """
    nodes = cut_lineage(prints.groupBy("fingerprint").agg(F.min(doc_id).alias("low")))
    roots = connected_components(links_of(nodes.select("fingerprint"), most))
    linked = cut_lineage(nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint"))
    # Kept, so that both sides of the next join are dealt out by it, and a large component can be split.
    lows = cut_lineage(linked.groupBy("root").agg(F.min("low").alias("component_id")))
    named = linked.drop("low").join(lows, "root")
    placed = nodes.join(named, "fingerprint", "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"), F.coalesce("component_id", "low").alias("component_id")
    )
    return cut_lineage(placed)  # dealt out anew by the joins with documents, which can then split a group of copies


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """(doc_id, fingerprint, root, component_id) per document; an empty table gives no rows.

    Repeated ids and rows keep one row each. Texts are read whole; a null text counts as empty.
    """
    prints = with_fingerprint(docs.select(doc_id, text), text)
    prints = cut_lineage(prints.select(F.col(f"record.{doc_id}").alias("doc_id"), "fingerprint"))
    return prints.join(components_of(prints, "doc_id", most), "fingerprint")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """The documents without near-duplicates: of each component the row with the smallest id stays
    (one row also where that id is repeated)."""
    prints = with_fingerprint(docs, text)
    slim = cut_lineage(prints.select(F.col(f"record.{doc_id}").alias("doc_id"), "fingerprint"))
    kept = prints.join(components_of(slim, "doc_id", most), "fingerprint").filter(
        F.col(f"record.{doc_id}").eqNullSafe(F.col("component_id"))
    )
    return kept.dropDuplicates(["root"]).select("record.*")
