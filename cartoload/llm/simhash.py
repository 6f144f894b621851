"""SimHash near-duplicates by the generalised pigeonhole principle (operator 2).

A document's fingerprint has 64 bits, each the majority over the hashes of its word shingles. Two
fingerprints link if at most ``radius`` bits differ. The bits are dealt into ``parts`` groups; if
the groups' thresholds sum to ``radius - parts + 1``, any linked pair agrees in some group to within
that group's threshold (a threshold of -1 leaves a group out). So each fingerprint probes, per group,
all values within its threshold, meets the fingerprints indexed under those values, and the pairs
met are verified on all 64 bits. Nothing is missed whatever the thresholds; they only set the cost.

* Correlated bits go to the same group, so that the values of different groups are as independent as
  they can be and a crowded value in one group says little about the others.
* The thresholds are allocated per fingerprint by dynamic programming over the groups: the cost of a
  group at a threshold is the number of values to probe plus the estimated number of candidates,
  from the counts of the most crowded values and a background of independent bits.

Three bits find copies with hardly a change. ``similar_documents`` finds texts whose sets of shingles have a
Jaccard similarity of ``SIMILAR`` or more. Such texts differ in up to 15 % of the bits (19 % where they have
four or five shingles), too many for 64 of them to leave groups that tell texts apart. So a fingerprint has eight
words there, whose bits are dealt twice into five groups of 12 or 13, and is filed under the value of each of the 80 groups.
All fingerprints within 39 of the 512 bits meet for certain. Two texts with a similarity of 0.8, of which 0.15 of the bits
differ give or take 0.016, agree in one of the groups with a chance of 0.9996 (0.99 with four and five shingles; 0.885
and 0.67 with 32 groups of 16); the more alike they are, the surer. Those filed under one value are
compared on all 512 bits inside a task, a crowded value in blocks in many tasks. What leaves the task grows with
the rows, not with their pairs: a star for each component of sure pairs, one for each family of near ones, and of the pairs that
the bits leave open the nearest of a text, to be judged by their shingles. Families with more open pairs than that are then compared
whole: each text's shingles go to the tasks of its family once, and only links come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartoload.llm.common import LOWER, annotate, components, map_arrow, release, truncate_lineage

BITS = 64
SHINGLE = 3
RADIUS = 3
SIMILAR = 0.8  # similarity of sets of shingles
WORDS = 8  # 64-bit words of a long fingerprint
WIDTH = 13  # bits of a group of a long fingerprint, at most
DEALS = 2  # times that the bits of a word are dealt into groups
SMALL = 64  # sets of fewer shingles have their own limits on the bits that may differ
#: How many open pairs of a text and a value are judged by their shingles, nearest first, before those inside a
#: component drop out; at last (None) all that are left, by families.
ROUNDS = (1, None)
BLOCK = 16384  # texts filed under one value that are compared as one block
MOST_PLACES = 1 << 26  # bits of the bitmap that keeps texts out of a join
SHINGLES = 2_000_000  # shingles of a family's texts that are compared as one block
CHUNK = 8_000_000  # bytes of blocks that a task compares at once
PENDING = 500_000  # near pairs that a task holds before it reduces them
_PLACE = 16  # bits of the number of either share in the number of a block
CROWDED = 256  # how many of the most crowded values the cost estimates know
OPEN, SURE, NEAR, MORE = range(4)  # kinds of pairs
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str | None, size: int) -> list[int]:
    """The hashes of a text's shingles, repeats included; none for a text without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) < size:
        return [hashed(joined, 42)]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    return [hashed(joined[a:b], 42) for a, b in zip(starts, ends[size - 1:].tolist())]


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number; 0 for a text without a word."""
    hashes = shingle_hashes(text, size)
    if not hashes:
        return 0
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``docs`` with ``fp bigint``. A null text counts as empty; a column named ``fp`` is replaced."""
    return annotate(docs, ["text"], "fp bigint", lambda texts: [[fingerprint(t, size) for t in texts.to_pylist()]])


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often each two bits are set together (64 x 64 sums)."""
    def sums(batches):
        total, n = np.zeros((BITS, BITS), dtype=np.int64), 0
        for batch in batches:
            octets = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(octets, axis=1, bitorder="little").astype(np.float32)
            total += np.rint(bits.T @ bits).astype(np.int64)
            n += len(octets)
        yield pa.RecordBatch.from_pydict({"bit": list(range(BITS)), "n": [n] * BITS, "both": total.tolist()},
                                         schema=pa.schema([("bit", pa.int32()), ("n", pa.int64()), ("both", pa.list_(pa.int64()))]))

    parts = map_arrow(prints.select("fp"), "bit int, n bigint, both array<bigint>", sums)
    rows = parts.groupBy("bit").agg(F.sum("n"), *[F.sum(F.col("both")[k]) for k in range(BITS)]).collect()
    together = np.zeros((BITS, BITS), dtype=np.int64)
    for row in rows:
        together[row[0]] = row[2:]
    return (rows[0][1] if rows else 0), together


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt into ``parts`` groups of equal width: each group grows by the bit most correlated with it."""
    share = together.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    linked = np.abs(together / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(linked, 0)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        width = (BITS - sum(map(len, groups))) // (parts - k)
        seed = max(sorted(free), key=lambda b: linked[b, sorted(free)].max() if len(free) > 1 else 0)
        group = [seed]
        free.discard(seed)
        while len(group) < width:
            best = max(sorted(free), key=lambda b: linked[b, group].sum())
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def project(prints: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of one group, packed into the low bits of an unsigned number."""
    out = np.zeros(len(prints), dtype=np.uint64)
    for place, bit in enumerate(group):
        out |= ((prints >> np.uint64(bit)) & np.uint64(1)) << np.uint64(place)
    return out


def flips(width: int, threshold: int) -> np.ndarray:
    """All values of ``width`` bits with at most ``threshold`` set bits."""
    return np.array([sum(1 << b for b in chosen) for k in range(threshold + 1) for chosen in combinations(range(width), k)], dtype=np.uint64)


def allocate(costs: np.ndarray, radius: int) -> np.ndarray:
    """Thresholds per row from ``costs[row, group, threshold + 1]``, by dynamic programming over the groups.

    A group at threshold t uses t + 1 units; all groups together use ``radius + 1`` units. No threshold
    is higher than ``costs`` has columns for.
    """
    rows, parts, most = costs.shape
    units = radius + 1
    best = np.full((rows, units + 1), np.inf)
    best[:, 0] = 0
    chosen = np.zeros((rows, parts, units + 1), dtype=np.int64)
    for g in range(parts):
        options = np.full((most, rows, units + 1), np.inf)  # [units of this group, row, units so far]
        for own in range(min(most, units + 1)):
            options[own, :, own:] = best[:, :units + 1 - own] + costs[:, g, own, None]
        chosen[:, g] = options.argmin(axis=0)
        best = options.min(axis=0)
    thresholds = np.zeros((rows, parts), dtype=np.int64)
    left = np.full(rows, units)
    for g in reversed(range(parts)):
        own = chosen[np.arange(rows), g, left]
        thresholds[:, g] = own - 1
        left = left - own
    return thresholds


def probe_costs(prints: np.ndarray, groups: list[list[int]], n: int, share: np.ndarray, crowded: list[tuple[np.ndarray, np.ndarray]], radius: int) -> np.ndarray:
    """Values to probe plus estimated candidates, ``[row, group, threshold + 1]``."""
    costs = np.zeros((len(prints), len(groups), radius + 2))
    for g, group in enumerate(groups):
        own = project(prints, group)
        apart = 2 * share[group] * (1 - share[group])  # chance that two fingerprints differ in each bit
        chance = np.zeros(radius + 1)
        chance[0] = 1.0
        for p in apart:
            chance[1:] = chance[1:] * (1 - p) + chance[:-1] * p
            chance[0] *= 1 - p
        values, often = crowded[g]
        distance = np.bitwise_count(own[:, None] ^ values[None, :]) if len(values) else np.zeros((len(prints), 0))
        for t in range(radius + 1):
            probes = sum(comb(len(group), k) for k in range(t + 1))
            costs[:, g, t + 1] = probes + n * chance[: t + 1].sum() + (distance <= t) @ often
    return costs


def links(spark: SparkSession, prints: DataFrame, radius: int = RADIUS, parts: int = 2) -> DataFrame:
    """All pairs ``(a, b)``, ``a < b``, of distinct fingerprints within ``radius`` bits.

    ``prints`` holds distinct values ``fp`` and is read several times, so it should be a table.
    """
    n, together = bit_counts(prints)
    groups = group_bits(n, together, parts)
    share = together.diagonal() / max(n, 1)
    code = arrow_keys(groups)

    def indexed(batches):
        for batch in batches:
            own = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            for g, group in enumerate(groups):
                yield code(g, project(own, group), own)

    schema = "key bigint, fp bigint"
    index = map_arrow(prints.select("fp"), schema, indexed)
    counted = index.groupBy("key").count().orderBy(F.desc("count"), "key").limit(CROWDED).collect()
    crowded = []
    for g in range(len(groups)):
        mine = [(r[0] ^ _mark(g), r[1]) for r in counted if _part_of(r[0]) == g and r[1] > 1]
        crowded.append((np.array([v for v, _ in mine], dtype=np.uint64), np.array([c for _, c in mine], dtype=np.float64)))

    def probed(batches):
        for batch in batches:
            every = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            for start in range(0, len(every), 2000):
                own = every[start:start + 2000]
                thresholds = allocate(probe_costs(own, groups, n, share, crowded, radius), radius)
                for g, group in enumerate(groups):
                    value = project(own, group)
                    for t in range(radius + 1):
                        mine = thresholds[:, g] == t
                        if mine.any():
                            near = flips(len(group), t)
                            for part in np.array_split(np.flatnonzero(mine), 1 + int(mine.sum()) * len(near) // 500_000):
                                yield code(g, (value[part][:, None] ^ near[None, :]).ravel(), np.repeat(own[part], len(near)))

    probes = map_arrow(prints.select("fp"), schema, probed).withColumnRenamed("fp", "probe")
    met = probes.join(index, "key").where((F.col("probe") != F.col("fp")) & (F.bit_count(F.col("probe").bitwiseXOR(F.col("fp"))) <= radius))
    return met.select(F.least("probe", "fp").alias("a"), F.greatest("probe", "fp").alias("b")).distinct()


def _mark(group: int) -> int:
    return group << 56


def _part_of(key: int) -> int:
    return (key >> 56) & 0x7F


def arrow_keys(groups: list[list[int]]):
    """Batches ``(key, fp)``; the key holds the number of the group above its bits."""
    if max(map(len, groups)) > 56:
        raise ValueError("at least two parts are needed")

    def code(g: int, values: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((values | np.uint64(_mark(g))).view(np.int64)), pa.array(prints.view(np.int64))], names=["key", "fp"])

    return code


def near_duplicates(spark: SparkSession, docs: DataFrame, radius: int = RADIUS, parts: int = 2, size: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row of ``docs``: the smallest ``doc_id`` reachable over links.

    Equal fingerprints are one class, so a group of copies is one value in the search. Null and
    empty texts have fingerprint 0 and link like any other; repeated rows each get a row; a null
    ``doc_id`` never names a component unless no other id is there; an empty table gives an empty
    result.
    """
    marked = truncate_lineage(spark, fingerprints(docs.select("doc_id", "text"), size).select("doc_id", "fp"), "fingerprints")
    classes = truncate_lineage(spark, marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    pairs = truncate_lineage(spark, links(spark, classes, radius, parts), "pairs")
    joined = components(spark, pairs)
    # Components are named by fingerprint so far; the smallest document of each gives the name.
    reach = joined.join(classes.withColumnRenamed("fp", "node"), "node")
    named = reach.groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = joined.join(named, "component").select(F.col("node").alias("fp"), "component_id")
    ids = classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    ids = truncate_lineage(spark, ids, "ids")  # so that the join below may split a fingerprint that very many share
    return marked.join(ids, "fp").select("doc_id", "fp", "component_id")


# ------------------------------------------------------------------ texts by the similarity of their shingles


def mixed(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` further hashes of each hash, by the finishing steps of the splitmix64 generator."""
    steps = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = hashes[:, None] + steps[None, :]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, size), dtype=np.uint64))


def long_fingerprint(hashes: np.ndarray) -> bytes:
    """The majority over a set of shingles in each of ``64 * WORDS`` bits; zeros for none."""
    ones = np.zeros(BITS * WORDS, dtype=np.int64)
    for start in range(0, len(hashes), 4096):
        octets = mixed(hashes[start:start + 4096]).astype("<u8").view(np.uint8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def words_of_prints(prints: pa.Array) -> np.ndarray:
    """``[row, word]`` of long fingerprints."""
    return np.frombuffer(b"".join(prints.to_pylist()), dtype="<u8").reshape(-1, WORDS)


def long_groups(classes: DataFrame) -> list[tuple[int, list[int]]]:
    """The groups of bits of long fingerprints ``classes.fp``, as ``(word, bits)``."""
    def sums(batches):
        total, n = np.zeros((WORDS, BITS, BITS), dtype=np.int64), 0
        for batch in batches:
            own = words_of_prints(batch.column(0))
            for w in range(WORDS):
                bits = np.unpackbits(np.ascontiguousarray(own[:, w]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total[w] += np.rint(bits.T @ bits).astype(np.int64)
            n += len(own)
        if n:
            yield pa.RecordBatch.from_pydict({"bit": list(range(WORDS * BITS)), "n": [n] * WORDS * BITS, "both": total.reshape(-1, BITS).tolist()},
                                             schema=pa.schema([("bit", pa.int32()), ("n", pa.int64()), ("both", pa.list_(pa.int64()))]))

    partial = map_arrow(classes.select("fp"), "bit int, n bigint, both array<bigint>", sums)
    rows = partial.groupBy("bit").agg(F.sum("n"), *[F.sum(F.col("both")[k]) for k in range(BITS)]).collect()
    n = rows[0][1] if rows else 0
    together = np.zeros((WORDS * BITS, BITS), dtype=np.int64)
    for row in rows:
        together[row[0]] = row[2:]
    together = together.reshape(WORDS, BITS, BITS)
    return [(w, group) for w in range(WORDS) for group in deals(group_bits(n, together[w], -(-BITS // WIDTH)))]


def deals(groups: list[list[int]]) -> list[list[int]]:
    """``groups`` and their bits dealt anew, ``DEALS`` times in all; each new group has bits of all groups of the deal before."""
    every = list(groups)
    for _ in range(DEALS - 1):
        in_order = [bit for group in groups for bit in group]
        groups = [sorted(in_order[k::len(groups)]) for k in range(len(groups))]
        every += groups
    return every


def joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``label`` (of each row the smallest row it is joined to) after the rows ``x`` are joined to the rows ``y``."""
    while True:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        if np.array_equal(low, high):
            return label
        np.minimum.at(label, high, low)
        while not np.array_equal(label[label], label):
            label = label[label]


class Comparison:
    """Compares the rows of whole blocks, which lie one after the other."""

    def __init__(self, groups: list[tuple[int, list[int]]], similarity: float, most: int):
        bits = BITS * WORDS
        self.words = np.array([w for w, _ in groups])
        self.masks = np.array([sum(1 << bit for bit in group) for _, group in groups], dtype=np.uint64)
        self.close, self.surely, self.maybe = limits(similarity, BITS, 4), spread(similarity, bits, -3), limits(similarity, bits, 3)
        self.similarity, self.most = similarity, most

    def near(self, block: np.ndarray, right: np.ndarray, component: np.ndarray, sizes: np.ndarray, own: np.ndarray):
        """``(x, y, apart)`` of the rows that are near, a step apart at a time; each pair only in the first group where it meets."""
        heads = np.ascontiguousarray(own[:, 0])
        part = block >> (2 * _PLACE + WIDTH)
        within = (block >> _PLACE) & ((1 << _PLACE) - 1) == block & ((1 << _PLACE) - 1)
        x, step = np.arange(len(block)), 0
        while len(x):
            step += 1
            x = x[:np.searchsorted(x, len(block) - step)]
            x = x[block[x] == block[x + step]]
            y = x + step
            few = np.bitwise_count(heads[x] ^ heads[y]) <= self.close.max()
            a, b = x[few], y[few]
            low, high = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
            fits = (low >= self.similarity * high) & (component[a] != component[b]) & (within[a] | (right[a] != right[b]))
            a, b, low = a[fits], b[fits], np.minimum(low[fits], SMALL)
            few = np.bitwise_count(heads[a] ^ heads[b]) <= self.close[low]
            a, b, low = a[few], b[few], low[few]
            differ = own[a] ^ own[b]
            apart = np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
            few = apart <= self.maybe[low]
            a, b, apart, differ = a[few], b[few], apart[few], differ[few]
            first = ((differ[:, self.words] & self.masks) == 0).argmax(axis=1) == part[a]
            if first.any():
                yield a[first], b[first], apart[first]

    def __call__(self, block: np.ndarray, right: np.ndarray, ids: np.ndarray, component: np.ndarray, sizes: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        label, family, crowded = np.arange(len(block)), np.arange(len(block)), np.zeros(len(block), dtype=bool)
        pending: list[tuple[np.ndarray, ...]] = []

        def reduced() -> list[tuple[np.ndarray, ...]]:
            nonlocal label, family
            x, y, apart = (np.concatenate(column) for column in zip(*pending))
            sure = apart <= self.surely
            family = joined(family, x, y)
            label = joined(label, x[sure], y[sure])
            left = label[x] != label[y]
            x, y, apart = x[left], y[left], apart[left]
            later, sooner = np.where(ids[x] > ids[y], x, y), np.where(ids[x] > ids[y], y, x)
            order = np.lexsort((ids[sooner], apart, later))
            x, y, apart = later[order], sooner[order], apart[order]
            starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, dtype=np.int64)
            place = np.arange(len(x)) - np.repeat(starts, np.diff(np.r_[starts, len(x)]))
            crowded[x[place >= self.most]] = True
            x, y, apart = (column[place < self.most] for column in (x, y, apart))
            return [(x, y, apart)]

        held = 0
        for found in self.near(block, right, component, sizes, own):
            pending.append(found)
            held += len(found[0])
            if held > PENDING:
                pending, held = reduced(), 0
        x, y, apart = reduced()[0] if pending else (np.zeros(0, dtype=np.int64),) * 3
        rows = np.arange(len(block))
        star, ray, more = np.flatnonzero(label != rows), np.flatnonzero(family != rows), np.flatnonzero(crowded)
        one, two = ids[np.r_[x, star, ray, more]], ids[np.r_[y, label[star], family[ray], more]]
        kind = np.repeat([OPEN, SURE, NEAR, MORE], [len(x), len(star), len(ray), len(more)])
        apart = np.r_[apart, np.zeros(len(one) - len(x), dtype=np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), pa.array(apart), pa.array(kind.astype(np.int32))], names=["a", "b", "apart", "kind"])


def whole_blocks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows as batches of about ``CHUNK`` bytes that don't cut a block: rows equal in their first ``keys`` columns."""
    held, size = [], 0
    for batch in batches:
        held.append(pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names))  # batches differ in what may be null
        size += batch.nbytes
        if size < CHUNK:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        cut = int(block_starts(whole, keys)[-1])  # the last block may go on
        if cut:
            yield whole.slice(0, cut)
        rest = whole.take(pa.array(np.arange(cut, whole.num_rows)))
        held, size = [rest], (rest.nbytes if cut else 0)  # a block over CHUNK is looked at again after another CHUNK
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    held = whole = rest = None
    release()


def block_starts(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """The rows where another block begins."""
    new = np.zeros(batch.num_rows, dtype=bool)
    new[0] = True
    for k in range(keys):
        column = batch.column(k).to_numpy(zero_copy_only=False)
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` with ``lo``, ``hi`` and ``right``: each two of the ``blocks`` shares of a key's rows are a block, with the rows of the later share to the right."""
    blocks = F.coalesce("blocks", F.lit(1))
    shares = rows.withColumn("own", F.pmod(F.xxhash64("id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    return shares.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other"), "right": F.col("own") > F.col("other")})


def similar_pairs(spark: SparkSession, nodes: DataFrame, compare: Comparison) -> DataFrame:
    """Pairs ``(a, b, apart, kind)``, ``a <= b``, of ids of different components that meet in a group and are near.

    ``nodes`` holds distinct ``(id, component, size, fp)`` and is read several times, so it should be a table. ``SURE`` pairs come as a
    star for each block and component, as do ``NEAR`` ones (all there are) for each block and family; of ``OPEN`` pairs the
    nearest ``compare.most`` to smaller ids for each id and block. ``MORE`` names an id that has more of them.
    """
    words, masks = compare.words.tolist(), compare.masks.tolist()
    bits = [[k for k in range(BITS) if mask >> k & 1] for mask in masks]

    def key_of(own: np.ndarray, part: int) -> np.ndarray:
        return (project(own[:, words[part]], bits[part]) | np.uint64(part << WIDTH)).view(np.int64)

    # What a task leaves out as rare is less than BLOCK of a value in all tasks together, so no share is over twice that.
    least = max(1, BLOCK // nodes.rdd.getNumPartitions())

    def counts(batches):
        often = np.zeros(len(words) << WIDTH, dtype=np.int64)
        for batch in batches:
            own = words_of_prints(batch.column(0))
            for part in range(len(words)):
                often += np.bincount(key_of(own, part), minlength=len(often))
        key = np.flatnonzero(often >= least)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(often[key])], names=["key", "n"])

    def filed(batches):
        for batch in batches:
            own = words_of_prints(batch.column(3))
            for part in range(len(words)):
                yield pa.RecordBatch.from_arrays([pa.array(key_of(own, part)), *batch.columns], names=["key", *batch.schema.names])

    counted = map_arrow(nodes.select("fp"), "key bigint, n bigint", counts).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK)
    crowd = truncate_lineage(spark, counted.select("key", F.ceil(F.col("n") / BLOCK).alias("blocks")), "crowd")
    index = map_arrow(nodes.select("id", "component", "size", "fp"), "key bigint, id bigint, component bigint, size int, fp binary", filed)
    if crowd.isEmpty():
        placed = index.withColumn("block", F.shiftleft("key", 2 * _PLACE)).withColumn("right", F.lit(False))
    else:
        placed = dealt(index.join(crowd, "key", "left")).withColumn("block", F.shiftleft("key", 2 * _PLACE) + F.shiftleft("lo", _PLACE) + F.col("hi"))

    def compared(batches):
        for batch in whole_blocks(batches, 1):
            yield compare(*[batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)], words_of_prints(batch.column(5)))

    blocks = placed.select("block", "right", "id", "component", "size", "fp").repartition("block").sortWithinPartitions("block")
    return map_arrow(blocks, "a bigint, b bigint, apart bigint, kind int", compared)


def family_links(spark: SparkSession, named: DataFrame, members: DataFrame, similarity: float, size: int) -> DataFrame:
    """Links ``(a, b)`` that join components of a family, by shingles; of several that join the same two, one.

    ``members`` holds ``(id, fp, component, family)``. Texts that may have the similarity by their bits are compared, nearest first.
    """
    maybe = limits(similarity, BITS * WORDS, 3)
    sets = shingle_sets(spark, named, members.select(F.col("id").alias("doc_id")).distinct(), size).withColumnRenamed("doc_id", "id")
    ready = truncate_lineage(spark, members.join(sets, ["id", "fp"]), "members")
    shares = ready.groupBy("family").agg(F.ceil(F.sum(F.size("hashes")) / SHINGLES).alias("blocks")).where("blocks > 1")
    placed = dealt(ready.join(truncate_lineage(spark, shares, "shares"), "family", "left"))

    def compared(batches):
        for batch in whole_blocks(batches, 3):
            within = (batch.column(1).to_numpy() == batch.column(2).to_numpy())
            right, ids = batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_numpy()
            label, own = batch.column(5).to_numpy().copy(), words_of_prints(batch.column(6))
            edges = batch.column(7).offsets.to_numpy().astype(np.int64)
            values, codes = np.unique(batch.column(7).values.to_numpy()[edges[0]:edges[-1]], return_inverse=True)
            edges, mark, pairs = edges - edges[0], np.zeros(len(values), dtype=bool), []
            many = np.diff(edges)
            starts = block_starts(batch, 3)
            for start, end in zip(starts, np.r_[starts[1:], len(ids)]):
                for x in range(start + 1, end):
                    apart = np.bitwise_count(own[start:x] ^ own[x]).sum(axis=1, dtype=np.int64)
                    low, high = np.minimum(many[start:x], many[x]), np.maximum(many[start:x], many[x])
                    open_ = (apart <= maybe[np.minimum(low, SMALL)]) & (low >= similarity * high) & (label[start:x] != label[x]) & (within[x] | (right[start:x] != right[x]))
                    if not open_.any():
                        continue
                    near = start + np.flatnonzero(open_)
                    near = near[np.lexsort((ids[near], apart[near - start]))]
                    mine = codes[edges[x]:edges[x + 1]]
                    mark[mine] = True
                    while len(near):
                        some, near = near[:32], near[32:]
                        sizes = edges[some + 1] - edges[some]
                        hits = np.r_[0, np.cumsum(mark[np.concatenate([codes[edges[y]:edges[y + 1]] for y in some])])]
                        ends = np.cumsum(sizes)
                        common = hits[ends] - hits[ends - sizes]
                        for y in some[common >= similarity * (len(mine) + sizes - common)].tolist():
                            if label[y] != label[x]:
                                pairs.append((ids[x], ids[y]))
                                inside = label[start:end]
                                inside[inside == label[y]] = label[x]
                        near = near[label[near] != label[x]]
                    mark[mine] = False
            found = np.array(pairs, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    keys = ["family", "lo", "hi"]
    blocks = placed.select(*keys, "right", "id", "component", "fp", "hashes").repartition(*keys).sortWithinPartitions(*keys, "id")
    return map_arrow(blocks, "a bigint, b bigint", compared)


def spread(similarity: float, bits: int, errors: float) -> int:
    """Bits of ``bits`` in which texts of a similarity differ, ``errors`` standard errors off the mean."""
    chance = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(bits * chance + errors * np.sqrt(bits * chance * (1 - chance)))


def differing(one: int, two: int, common: int) -> float:
    """The chance that a bit differs in the majorities over two sets of hashes."""
    shared = np.arange(common + 1)
    sets = []
    for n in (one, two):
        more = [sum(comb(n - common, i) for i in range(k, n - common + 1)) / 2 ** (n - common) for k in range(n - common + 2)]
        sets.append(np.array(more)[np.clip(n // 2 + 1 - shared, 0, n - common + 1)])
    a, b = sets
    return float(np.array([comb(common, k) / 2**common for k in range(common + 1)]) @ (a * (1 - b) + b * (1 - a)))


def limits(similarity: float, bits: int, errors: float) -> np.ndarray:
    """``spread`` by the size of the smaller set, up to ``SMALL``: majorities over few hashes, and ties among them, let more bits differ."""
    most = np.full(SMALL + 1, spread(similarity, bits, errors))
    for one in range(1, SMALL):
        for two in range(one, int(one / similarity + 1e-9) + 1):
            common = ceil(similarity * (one + two) / (1 + similarity) - 1e-9)
            if common <= one:
                chance = differing(one, two, common)
                most[one] = max(most[one], int(bits * chance + errors * np.sqrt(bits * chance * (1 - chance))))
    return most


def between(spark: SparkSession, pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The ``pairs`` whose ends are in different components."""
    for end in ("a", "b"):
        pairs = pairs.join(labels.withColumnsRenamed({"node": end, "component": f"in_{end}"}), end, "left")
    apart = F.coalesce("in_a", "a") != F.coalesce("in_b", "b")
    return truncate_lineage(spark, pairs.where(apart).select("a", "b", "apart"), "open")


def narrowed(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``doc_id`` isn't among ``ids``: these are marked in a bitmap of 16 to 32 bits an id, 8 MB at most, that
    goes to all executors. An exact join is to follow; it gets a share of the rows about as large as that of the ids."""
    places = min(max(1 << (16 * ids.count()).bit_length(), 1 << 15), MOST_PLACES)
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(places))
    block, within = F.expr("_place div 32768"), F.expr("_place % 32768")
    marks = ids.select(place.alias("_place")).groupBy(block.alias("_block")).agg(F.bitmap_construct_agg(within).alias("_bits"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_place % 32768 div 8 + 1 as int), 1)")), 16, 10).cast("int")
    met = rows.withColumn("_place", place).withColumn("_block", block).join(F.broadcast(marks), "_block")
    return met.where(F.getbit(byte, F.expr("cast(_place % 8 as int)")) == 1).select(*rows.columns)


def shingle_sets(spark: SparkSession, named: DataFrame, ends: DataFrame, size: int) -> DataFrame:
    """``(doc_id, fp, hashes)``: the set of shingles of each text of the distinct ids ``ends``."""
    def sets(texts):
        hashes = [shingle_set(x, size) for x in texts.to_pylist()]
        return [[long_fingerprint(x) for x in hashes], [x.view(np.int64) for x in hashes]]

    # No semi join: Spark would move that before the other one.
    return annotate(narrowed(named, ends).join(ends, "doc_id").distinct(), ["text"], "fp binary, hashes array<bigint>", sets).drop("text")


def alike(spark: SparkSession, named: DataFrame, pairs: DataFrame, similarity: float, size: int) -> DataFrame:
    """Those of ``pairs`` of which a text of the one and one of the other have the ``similarity``, by their shingles."""
    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = truncate_lineage(spark, shingle_sets(spark, named, ends, size), "sets")
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("of_a")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("of_b")), "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(common >= F.lit(similarity) * (F.size("of_a") + F.size("of_b") - common)).select("a", "b")


def similar_documents(spark: SparkSession, docs: DataFrame, similarity: float = SIMILAR, size: int = 5) -> DataFrame:
    """``(doc_id, component_id)`` per row of ``docs``: the smallest ``doc_id`` reachable over similar texts.

    Two texts link if the sets of their shingles of ``size`` words have a Jaccard similarity of
    ``similarity`` or more and their fingerprints meet (see above for the chance of that). A pair far
    nearer or farther on 512 bits than the similarity asks for is decided by them, at three standard
    errors; a pair between them only if the surer ones don't join it already, by its shingles. Equal
    fingerprints are one class, so copies cost nothing; an id with several texts links by any of them.
    Texts without a word are one class; texts are taken whole, a very long one in its task. Repeated rows each get a
    row; rows with a null ``doc_id`` link with nothing and have a null ``component_id``; other columns are ignored; an empty
    table gives an empty result.
    """
    def marks(texts):
        made = [(long_fingerprint(hashes), len(hashes)) for hashes in (shingle_set(t, size) for t in texts.to_pylist())]
        return [[fp for fp, _ in made], [n for _, n in made]]

    named = docs.select("doc_id", "text")
    marked = truncate_lineage(spark, annotate(named, ["text"], "fp binary, size int", marks).select("doc_id", "fp", "size"), "fingerprints")
    grouped = marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id"), F.min("size").alias("size"))
    classes = truncate_lineage(spark, grouped.select("id", "fp", "size"), "classes")
    # An id that stands for two texts is one node, so its classes are one, too.
    groups = long_groups(classes)
    nodes, labels, families = classes.withColumn("component", F.col("id")), None, None
    for most in ROUNDS:
        if most is None:
            new = family_links(spark, named, nodes, similarity, size)
        else:
            found = truncate_lineage(spark, similar_pairs(spark, nodes, Comparison(groups, similarity, most)), "found")
            if labels is None:
                labels = truncate_lineage(spark, components(spark, found.where(F.col("kind") == SURE)), "labels")
                families = truncate_lineage(spark, components(spark, found.where(F.col("kind") == NEAR)).withColumnsRenamed({"node": "id", "component": "family"}), "families")
            rest = between(spark, found.where(F.col("kind") == OPEN).dropDuplicates(["a", "b"]), labels)
            new = alike(spark, named, rest, similarity, size)
        # The labels so far are links, too: from each node to its component.
        labels = truncate_lineage(spark, components(spark, labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(new)), "labels")
        if most is None:
            break
        # Families go on that have more open pairs and are not one component.
        crowded = families.join(found.where(F.col("kind") == MORE).select(F.col("a").alias("id")), "id", "left_semi").select("family").distinct()
        named_so_far = classes.join(families, "id").join(crowded, "family", "left_semi").join(labels.withColumnRenamed("node", "id"), "id", "left").select(
            "id", "fp", "size", F.coalesce("component", "id").alias("component"), "family")
        named_so_far = truncate_lineage(spark, named_so_far, "nodes")
        apart_still = named_so_far.groupBy("family").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("family")
        nodes = truncate_lineage(spark, named_so_far.join(apart_still, "family", "left_semi").select("id", "fp", "size", "component", "family"), "nodes")
        if nodes.isEmpty():
            break
    node = classes.join(labels.withColumnRenamed("node", "id"), "id", "left")
    ids = truncate_lineage(spark, node.select("fp", F.coalesce("component", "id").alias("component_id")), "ids")
    return marked.join(ids, "fp", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
