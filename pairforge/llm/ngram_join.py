"""N-gram Jaccard join with multiple-global-order filtering.

Two texts link when the Jaccard similarity of their sets of word shingles reaches ``percent``.
Under any total order of the shingles, two linked sets share one in their prefixes of
``n - ceil(t n) + 1``. Here a pair has to share one under each of three orders: by document frequency
(the rare ones first) and by two hashes; the intersection of the three filters is verified exactly.
Shingles of a single set come first in all three orders, so they never have to be indexed, and a set
whose prefixes hold nothing else has no link.

How it runs:

1. Texts become sorted sets of 56-bit shingle hashes inside a task. Equal sets share a class, named
   by a 64-bit hash of the set, and a task sends each class once. Sets travel in blocks, by ranges of
   hashes; a block names a class once and holds seven bytes for each hash.
2. Per range of hashes, frequencies are counted over all classes; only shingles of two classes or
   more go back, by class. Classes with enough of them are the candidates; most texts end here.
3. Candidates whose shared shingles have the same smallest one under a hash order are compared, in
   blocks of BLOCK classes, each block of a larger group also with the most central classes of the
   group. That connects most near copies at a cost that grows with their number. A class that such a
   comparison finds linked to a class of many (HUB_MEMBERS) is a member of that hub.
4. Links that are still missing join two components. Their classes share a shingle of the rarest-first
   prefix, so only shingles that several components hold are looked at, and there each hub stands for
   its members. Shingles whose hubs begin with the same one (by hash) are met together; a group of
   more than BLOCK hubs is met by pairs of blocks. No group is closed over chains of shared shingles.
5. The Jaccard distance is a metric: members of two hubs can only link if the hubs are no farther apart
   than the distance of a link and both hubs' own farthest members. Where hubs are that near, and still
   in two components, the members of the larger one meet those of all its near ones, by pairs of blocks.
6. Verified links give the components; classes give them to their documents.

Null and empty texts have the empty set and link with nothing; texts with fewer words than a shingle
are one shingle; repeated rows are of one class; null keys take part but name no component.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import arrow_map, keyed, mixed, pinned, slices, texts_of, with_row, words_of
from pairforge.llm.components import components

ORDERS = 3
BLOCK = 256
CENTRES = 8
#: A class with so many members found in its block stands for them.
HUB_MEMBERS = 16
REMEMBERED = 100_000
#: The largest components, named by a broadcast table of so many rows at most.
HOT_COMPONENTS = 1000
#: Shingle hashes have so many bits.
BITS = 56
#: Bytes of text whose words and shingles a task holds at once.
SLICE_BYTES = 2_000_000


class _Hashes(dict):
    """Word to 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Hashes()


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    listed = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in listed], np.int64)
    flat = [w for one in listed for w in one]
    hashes = np.fromiter(map(_HASHES.__getitem__, flat), np.uint64, len(flat))
    ends = np.cumsum(sizes)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
        for k in range(words):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + mixed(hashes[k : k + len(rolled)], k)
    rolled = mixed(rolled, words) >> np.uint64(64 - BITS)
    out = []
    for begin, end, size in zip(ends - sizes, ends, sizes, strict=True):
        if size >= words:
            out.append(np.unique(rolled[begin : end - words + 1]))
        elif size:
            one = xxhash.xxh3_64_intdigest(hashes[begin:end].tobytes(), 7 + int(size)) >> (64 - BITS)
            out.append(np.array([one], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _class_of(one: np.ndarray) -> int:
    """The name of a set: a signed 64-bit hash of it."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(one.tobytes()))))


def least_overlap(n, percent: int):
    """ceil(percent / 100 * n): a partner of a set of n shares at least so many."""
    return -(-n * percent // 100)


def classes(docs: DataFrame, words: int) -> DataFrame:
    """(id, n, class) of each row with ``id`` and ``text``; class is null for empty sets."""
    kind = dict(docs.dtypes)["id"]

    def work(batch):
        texts = texts_of(batch)
        for a, b in slices(texts, SLICE_BYTES):
            sets = shingle_sets(texts[a:b], words)
            yield {
                "id": batch.column("id")[a:b],
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "class": pa.array([_class_of(s) if len(s) else None for s in sets], pa.int64()),
            }

    return arrow_map(docs, work, f"id {kind}, n bigint, class bigint")


def _packed(names: np.ndarray, sizes: np.ndarray, counts: np.ndarray, hashes: np.ndarray, frequency: np.ndarray | None = None) -> bytes:
    """A block: how many classes, then column by column their names, set sizes and numbers of hashes, and the hashes."""
    low = np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8]
    columns = [np.array([len(names)], "<i8"), names.astype("<i8"), sizes.astype("<u4"), counts.astype("<u4"), low]
    if frequency is not None:
        # Frequencies only order the hashes: those beyond 32 bits tie, in every block alike.
        columns.append(np.minimum(frequency, 0xFFFFFFFF).astype("<u4"))
    return b"".join(c.tobytes() for c in columns)


def _unpacked(contents, with_frequency: bool = False) -> list[np.ndarray]:
    """Class, size of its set, hash (and frequency) of every entry of some blocks."""
    heads = [int(np.frombuffer(content, "<i8", 1)[0]) for content in contents]
    counts = [np.frombuffer(content, "<u4", k, 8 + 12 * k) for content, k in zip(contents, heads, strict=True)]
    totals = [int(c.sum()) for c in counts]
    # Filled in place: lists of arrays that are joined afterwards would hold every entry twice.
    kinds = [np.int64, np.uint32, np.uint64] + [np.uint32] * with_frequency
    columns = [np.zeros(sum(totals), kind) for kind in kinds]
    begin = 0
    for content, k, count, total in zip(contents, heads, counts, totals, strict=True):
        at, end = 8 + 16 * k, begin + total
        columns[0][begin:end] = np.repeat(np.frombuffer(content, "<i8", k, 8), count)
        columns[1][begin:end] = np.repeat(np.frombuffer(content, "<u4", k, 8 + 8 * k), count)
        wide = columns[2][begin:end].view(np.uint8).reshape(total, 8)
        wide[:, : BITS // 8] = np.frombuffer(content, np.uint8, total * BITS // 8, at).reshape(total, -1)
        if with_frequency:
            columns[3][begin:end] = np.frombuffer(content, "<u4", total, at + total * BITS // 8)
        begin = end
    return columns


def _taken(columns: list[np.ndarray], rows: np.ndarray) -> None:
    """The rows of each column, one column at a time."""
    for k in range(len(columns)):
        columns[k] = columns[k][rows]


def _runs(part: np.ndarray, owner: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the runs of equal (part, owner) begin, how long they are, and the first run of each part; both are sorted."""
    begins = np.flatnonzero(np.concatenate([np.ones(min(1, len(part)), bool), (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])]))
    return begins, np.diff(np.append(begins, len(part))), np.searchsorted(part[begins], np.arange(parts + 1))


def _blocks(docs: DataFrame, words: int, ranges: int) -> DataFrame:
    """(part, content): the sets of all classes, cut by ranges of shingle hashes, packed."""
    width = np.uint64((1 << BITS) // ranges + 1)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts, SLICE_BYTES):
                sets, names = [], []
                for one in shingle_sets(texts[a:b], words):
                    if len(one) and (name := _class_of(one)) not in seen:
                        seen.add(name)
                        sets.append(one)
                        names.append(name)
                if not sets:
                    continue
                named = np.array(names, np.int64)
                sizes = np.array([len(s) for s in sets], np.int64)
                hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                part = (hashes // width).astype(np.int64)
                order = np.argsort(part, kind="stable")
                hashes, owner, part = hashes[order], owner[order], part[order]
                bounds = np.searchsorted(part, np.arange(ranges + 1))
                begins, counts, firsts = _runs(part, owner, ranges)
                names_of, sizes_of = named[owner[begins]], sizes[owner[begins]]
                parts, contents = [], []
                for p in np.flatnonzero(np.diff(bounds)):
                    own = slice(firsts[p], firsts[p + 1])
                    contents.append(_packed(names_of[own], sizes_of[own], counts[own], hashes[bounds[p] : bounds[p + 1]]))
                    parts.append(int(p))
                yield pa.RecordBatch.from_pydict({"part": pa.array(parts, pa.int32()), "content": pa.array(contents, pa.binary())})

    return docs.select("text").mapInArrow(run, "part int, content binary")


def _shared(buckets: int):
    """Entries of one range of hashes to those that two classes or more have, by buckets of classes."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        columns = _unpacked(rows["content"])
        _taken(columns, np.lexsort((columns[0], columns[2])))
        names, _, hashes = columns
        first = np.ones(len(names), bool)  # several tasks may have sent one class
        first[1:] = (hashes[1:] != hashes[:-1]) | (names[1:] != names[:-1])
        # Entries of one class alone go before anything else is made of them: most end here.
        begins = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        lengths = np.diff(np.append(begins, len(hashes)))
        counts = np.add.reduceat(first, begins, dtype=np.int64)
        kept = first & np.repeat(counts > 1, lengths)
        del names, hashes
        _taken(columns, kept)
        frequency = np.repeat(counts[counts > 1], counts[counts > 1])
        bucket = (mixed(columns[0].view(np.uint64), 5) % np.uint64(buckets)).astype(np.int64)
        columns += [frequency, bucket]
        _taken(columns, np.lexsort((columns[0], bucket)))
        names, sizes, hashes, frequency, bucket = columns
        bounds = np.searchsorted(bucket, np.arange(buckets + 1))
        there = np.flatnonzero(np.diff(bounds))
        begins, many, firsts = _runs(bucket, names, buckets)
        names_of, sizes_of = names[begins], sizes[begins]
        contents = []
        for b in there:
            own, every = slice(firsts[b], firsts[b + 1]), slice(bounds[b], bounds[b + 1])
            contents.append(_packed(names_of[own], sizes_of[own], many[own], hashes[every], frequency[every]))
        return pd.DataFrame({"bucket": there.astype(np.int32), "content": contents})

    return run


def prefix_of(hashes: np.ndarray, frequency: np.ndarray, n: int, order: int, percent: int) -> np.ndarray:
    """The shared shingles in the prefix of a set of n under one order; those of one set come before them."""
    size = n - least_overlap(n, percent) + 1 - (n - len(hashes))
    if size <= 0:
        return hashes[:0]
    keys = (hashes, frequency) if order == 0 else (mixed(hashes, 100 + order),)
    return hashes[np.lexsort(keys)[:size]]


def _candidates(percent: int):
    """Entries of one bucket of classes to the classes that may have a link."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        columns = _unpacked(rows["content"], with_frequency=True)
        _taken(columns, np.lexsort((columns[2], columns[0])))
        names, sizes, every, frequencies = columns
        sizes = sizes.astype(np.int64)
        begins = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        ends = np.append(begins[1:], len(names))
        enough = ends - begins >= least_overlap(sizes[begins], percent)
        found = []
        for begin, end in zip(begins[enough], ends[enough], strict=True):
            name, n = names[begin], sizes[begin]
            hashes, frequency = every[begin:end], frequencies[begin:end]
            prefixes = [prefix_of(hashes, frequency, int(n), k, percent) for k in range(ORDERS)]
            central = (end - begin) / n + float(np.log(frequency).mean()) / 100
            found.append((name, n, hashes.tobytes(), *[p.tobytes() for p in prefixes], central, int(prefixes[1][0]), prefixes[0].view(np.int64).tolist()))
        return pd.DataFrame(found, columns=["class", "n", "shared", *[f"p{k}" for k in range(ORDERS)], "central", "least", "prefix"])

    return run


_CANDIDATE = "class bigint, n bigint, shared binary, " + ", ".join(f"p{k} binary" for k in range(ORDERS)) + ", central double, least bigint, prefix array<bigint>"


def _common(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """How many hashes each pair of sets shares: products of 0/1 matrices, some columns at a time."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, back, counts = np.unique(flat, return_inverse=True, return_counts=True)
    twice = counts[back] > 1
    owner, column = owner[twice], (np.cumsum(counts > 1) - 1)[back[twice]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    columns = min(columns, int((counts > 1).sum()) or 1)
    for begin in range(0, int((counts > 1).sum()), columns):
        here = (column >= begin) & (column < begin + columns)
        part = np.zeros((len(sets), columns), np.float32)
        part[owner[here], column[here] - begin] = 1
        out += part @ part.T
    return out


def _counted(rows: pd.DataFrame, may: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the pairs that ``may`` marks, and how many shingles each pair shares."""
    a, b = np.nonzero(may)
    if not len(a):
        return a, b, a
    sets = [np.frombuffer(s, np.uint64) for s in rows["shared"]]
    if len(a) > 4 * len(rows):
        return a, b, _common(sets)[a, b].astype(np.int64)
    return a, b, np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)])


def _linked(rows: pd.DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and distances of all linked pairs of classes of two sides: filter by each order, then verify."""
    n, side = rows["n"].to_numpy(), rows["side"].to_numpy()
    may = np.triu((side[:, None] != side) | (side < 0), 1)
    may &= np.minimum(n[:, None], n) * 100 >= percent * np.maximum(n[:, None], n)
    for k in range(ORDERS):
        if not may.any():
            break
        may &= _common([np.frombuffer(p, np.uint64) for p in rows[f"p{k}"]]) > 0
    a, b, common = _counted(rows, may)
    union = n[a] + n[b] - common
    linked = 100 * common >= percent * union
    return a[linked], b[linked], 1 - common[linked] / union[linked]


def _forest(a: np.ndarray, b: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Each node of a component to its first node: as many edges as nodes, however many links there are."""
    root = list(range(size))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(x, r) for x in range(size) if (r := find(x)) != x]


_UNIT = ["unit", "i", "j"]


def _edges(percent: int):
    """Star edges (a, b) of the components inside each unit that the task has."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, unit in rows.groupby(_UNIT, sort=False):
            names = unit["class"].to_numpy()
            a, b, _ = _linked(unit, percent)
            out += [(names[x], names[y]) for x, y in _forest(a, b, len(unit))]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _hubs_of(a: np.ndarray, b: np.ndarray, far: np.ndarray, size: int) -> list[tuple[int, int, float]]:
    """Each node that is linked to an earlier hub, the first such hub and its distance; other nodes are hubs."""
    near = [[] for _ in range(size)]
    for x, y, d in zip(a.tolist(), b.tolist(), far.tolist(), strict=True):
        near[x].append((y, d))
    free, out = [True] * size, []
    for x in range(size):
        if free[x]:
            for y, d in near[x]:
                if free[y]:
                    free[y] = False
                    out.append((y, x, d))
    return out


def _stars(percent: int):
    """(a, b, far) of each unit: a class and its hub with their distance, and star edges of the components with far -1."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        # Centres come first and in one order, so all blocks of a group agree on the hubs among them.
        rows = rows.sort_values(["centre", "central", "class"], ascending=False).drop_duplicates([*_UNIT, "class"])
        for _, unit in rows.groupby(_UNIT, sort=False):
            if len(unit) == 1:
                continue
            names = unit["class"].to_numpy()
            a, b, far = _linked(unit, percent)
            out += [(names[x], names[y], d) for x, y, d in _hubs_of(a, b, far, len(unit))]
            out += [(names[x], names[y], -1.0) for x, y in _forest(a, b, len(unit))]
        return pd.DataFrame(out, columns=["a", "b", "far"]).astype({"a": "int64", "b": "int64", "far": "float64"})

    return run


def _meetings(percent: int):
    """(a, b, linked) of each unit: edges between hubs of two components, and hubs near enough for links of their members."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, unit in rows.groupby(_UNIT, sort=False):
            names, component, block = (unit[c].to_numpy() for c in ("class", "component", "block"))
            n, radius = unit["n"].to_numpy(), unit["radius"].to_numpy()
            may = np.triu(component[:, None] != component, 1)
            if unit["i"].iloc[0] != unit["j"].iloc[0]:
                may &= block[:, None] != block
            # A little less than asked for: distances are rounded.
            least = percent / 100 - radius[:, None] - radius - 1e-9
            may &= np.minimum(n[:, None], n) >= least * np.maximum(n[:, None], n)
            alone = (radius[:, None] == 0) & (radius == 0)
            for k in range(ORDERS):
                if not (may & alone).any():
                    break
                may &= ~alone | (_common([np.frombuffer(p, np.uint64) for p in unit[f"p{k}"]]) > 0)
            a, b, common = _counted(unit, may)
            union = n[a] + n[b] - common
            linked = 100 * common >= percent * union
            out += [(names[x], names[y], True) for x, y in _forest(a[linked], b[linked], len(unit))]
            near = ~linked & ~alone[a, b] & (common >= least[a, b] * union)
            out += [(names[x], names[y], False) for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True)]
        return pd.DataFrame(out, columns=["a", "b", "linked"]).astype({"a": "int64", "b": "int64", "linked": "bool"})

    return run


def _tasks(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows of units (unit, i, j) by task: units of a block or less share a task, blocks of larger ones have their own."""
    few = F.pmod(F.xxhash64("unit"), F.lit(buckets).cast("bigint"))
    return rows.withColumn("task", F.when(F.col("blocks") == 1, few).otherwise(F.xxhash64("unit", "i", "j"))).groupBy("task")


def _blocks_of(size: str):
    return F.ceil(F.col(size) / BLOCK).cast("int")


def _block(name: str, seed: int, blocks: str):
    return F.pmod(F.xxhash64(name, F.lit(seed)), F.col(blocks)).cast("int")


_SETS = ["class", "n", "shared", *[f"p{k}" for k in range(ORDERS)]]


def _copies(candidates: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(a, b, far), as ``_stars`` has it, of candidates with the same least shingle."""
    # Only groups of more than a block are broadcast, so no group is dealt out by its own key.
    large = candidates.groupBy(F.col("least").alias("unit")).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > BLOCK)
    placed = candidates.withColumnRenamed("least", "unit").join(F.broadcast(large), "unit", "left")
    placed = placed.withColumn("blocks", F.coalesce(_blocks_of("k"), F.lit(1)))
    placed = placed.select("unit", "blocks", *_SETS, "central", _block("class", 1, "blocks").alias("i"), F.lit(0).alias("centre"))
    # No side: all classes of a block are compared.
    centres = (
        placed.where("blocks > 1").groupBy("unit", F.pmod(F.xxhash64("class", F.lit(2)), F.lit(CENTRES)).alias("k"))
        .agg(F.max_by(F.struct("blocks", *_SETS, "central"), F.struct("central", "class")).alias("c"))
        .select("unit", "c.*", F.explode(F.sequence(F.lit(0), F.col("c.blocks") - 1)).alias("i"), F.lit(1).alias("centre"))
    )
    rows = placed.unionByName(centres).withColumns({"j": F.col("i"), "side": F.lit(-1)})
    return pinned(_tasks(rows, buckets).applyInPandas(_stars(percent), "a bigint, b bigint, far double"))


def _hubs(candidates: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class, hub) of each candidate, itself if it has no hub of many members; (hub, members, radius) of those hubs."""
    stars = found.where("far >= 0").groupBy(F.col("a").alias("class")).agg(F.min(F.struct("b", "far")).alias("s"))
    stars = stars.select("class", F.col("s.b").alias("hub"), "s.far")
    many = stars.groupBy("hub").agg(F.count(F.lit(1)).alias("members"), F.max("far").alias("radius"))
    many = pinned(many.where(F.col("members") >= HUB_MEMBERS).withColumn("members", F.col("members") + 1))
    named = candidates.select("class").join(stars.join(many.select("hub"), "hub").select("class", "hub"), "class", "left")
    return named.select("class", F.coalesce("hub", "class").alias("hub")), many


def _met(candidates: DataFrame, hubs: DataFrame, many: DataFrame, found: DataFrame, buckets: int) -> DataFrame:
    """Units of hubs whose classes share rarest-first prefix shingles that more than one component holds."""
    of_class = hubs.join(found, F.col("class") == F.col("node"), "left").select(
        "class", "hub", F.coalesce("component", "class").alias("component")
    )
    entries = candidates.select("class", F.explode("prefix").alias("shingle")).join(of_class, "class")
    entries = entries.select("shingle", "hub", "component").distinct()
    held = entries.groupBy("shingle").agg(F.min(F.xxhash64("hub")).alias("unit"), F.min("component").alias("low"), F.max("component").alias("high"))
    units = pinned(entries.join(held.where("low < high").select("shingle", "unit"), "shingle").select("unit", "hub", "component").distinct())
    sizes = units.groupBy("unit").agg(F.count(F.lit(1)).alias("k")).withColumn("blocks", _blocks_of("k")).drop("k")
    placed = units.join(sizes, "unit").withColumn("block", _block("hub", 3, "blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = placed.withColumn("other", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    placed = placed.join(many.drop("members"), "hub", "left").withColumn("radius", F.coalesce("radius", F.lit(0.0)))
    return _tasks(placed.join(candidates.select(*_SETS), F.col("hub") == F.col("class")), buckets)


def _members_met(candidates: DataFrame, hubs: DataFrame, many: DataFrame, near: DataFrame, percent: int, buckets: int) -> DataFrame:
    """Edges (a, b) between the members of near hubs (a, b): those of the larger hub meet those of all its near ones."""
    sized = near
    for side in ("a", "b"):
        sized = sized.join(many.select(F.col("hub").alias(side), F.col("members").alias(f"k{side}")), side, "left")
    larger = F.coalesce("ka", F.lit(1)) >= F.coalesce("kb", F.lit(1))
    pairs = sized.select(F.when(larger, F.col("a")).otherwise(F.col("b")).alias("unit"), F.when(larger, F.col("b")).otherwise(F.col("a")).alias("hub"))
    others = pinned(pairs.join(hubs, "hub").select("unit", "class"))
    sizes = others.groupBy("unit").agg(F.count(F.lit(1)).alias("k"))
    sizes = sizes.join(many.withColumnRenamed("hub", "unit"), "unit").select("unit", _blocks_of("members").alias("bi"), _blocks_of("k").alias("bj"))
    sides = []
    for rows, side, i, j in ((hubs.select(F.col("hub").alias("unit"), "class"), 0, "i", "j"), (others, 1, "j", "i")):
        rows = rows.join(sizes, "unit").withColumn(i, _block("class", 4, f"b{i}")).withColumn(j, F.explode(F.sequence(F.lit(0), F.col(f"b{j}") - 1)))
        sides.append(rows.select("unit", "i", "j", (F.col("bi") * F.col("bj")).alias("blocks"), "class", F.lit(side).alias("side")))
    rows = sides[0].unionByName(sides[1]).join(candidates.select(*_SETS), "class")
    return _tasks(rows, buckets).applyInPandas(_edges(percent), "a bigint, b bigint")


def _verified(candidates: DataFrame, percent: int, buckets: int) -> DataFrame:
    """Edges (a, b) between classes whose components are those of all links."""
    copies = _copies(candidates, percent, buckets)
    edges = copies.select("a", "b")
    hubs, many = _hubs(candidates, copies)
    units = _met(candidates, hubs, many, components(edges), buckets)
    met = pinned(units.applyInPandas(_meetings(percent), "a bigint, b bigint, linked boolean"))
    edges = edges.unionByName(met.where("linked").select("a", "b"))

    # Members of near hubs are only compared where the links of hubs have not joined them yet.
    found = components(edges)
    near = met.where(~F.col("linked")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for side in ("a", "b"):
        own = found.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
        near = near.join(own, side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    near = pinned(near.where("ca <> cb").select("a", "b"))
    return edges.unionByName(_members_met(candidates, hubs, many, near, percent, buckets))


def _named(classes_found: DataFrame) -> DataFrame:
    """(class, component_id): the smallest id in the component of each class (class, first, found).

    A component of very many classes is no hot group: the HOT_COMPONENTS largest ones are broadcast,
    and any other holds less than 1/HOT_COMPONENTS of the classes.
    """
    lowest = classes_found.groupBy("found").agg(F.min("first").alias("lowest"), F.count(F.lit(1)).alias("k"))
    hot = lowest.where(F.col("k") > BLOCK).orderBy(F.desc("k"), "found").limit(HOT_COMPONENTS)
    marked = classes_found.join(F.broadcast(hot.select("found", F.col("lowest").alias("hot_id"))), "found", "left")
    # Classes that have their name already get a key of their own.
    place = F.when(F.col("hot_id").isNull(), F.col("found")).otherwise(F.col("class"))
    rest = marked.withColumn("found", place).join(lowest.drop("k"), "found", "left")
    return rest.select("class", F.coalesce("hot_id", "lowest").alias("component_id"))


def linked(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, ranges: int | None = None
) -> DataFrame:
    """(key, n_shingles, component_id) of every row.

    ``ranges`` of shingle hashes are worked on one by one; the default follows the session's number of
    shuffle partitions, which has to fit the input as for any other shuffle.
    """
    own = keyed(docs, key, text)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or partitions
    members = classes(own, words)
    blocks = _blocks(own, words, ranges)
    shared = blocks.groupBy("part").applyInPandas(_shared(ranges), "bucket int, content binary")
    candidates = pinned(shared.groupBy("bucket").applyInPandas(_candidates(percent), _CANDIDATE))
    found = components(_verified(candidates, percent, ranges)).select(F.col("node").alias("class"), F.col("component").alias("found"))
    members = pinned(members)
    by_class = members.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("id").alias("first"))
    # A class is a row here, so a component of many copies is not a hot group.
    of_class = _named(pinned(by_class.join(found, "class", "left").withColumn("found", F.coalesce("found", "class"))))
    return members.join(of_class, "class", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The documents with the smallest key of their component, with their own columns: one of each group stays.

    Rows are dropped one by one: others with the same key stay. Rows with a null key are all kept; of
    equal keys in a component one row stays.
    """
    rows = with_row(docs, "_row")
    # Null keys come last, so they name a component only if all its keys are null.
    place = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "_row")
    found = linked(rows.select(place.alias("place"), text), "place", text, words, percent)
    gone = found.where((F.col("place") != F.col("component_id")) & ~F.col("place.none")).select(F.col("place._row").alias("gone"))
    return rows.join(gone, rows["_row"] == gone["gone"], "left_anti").drop("_row")
