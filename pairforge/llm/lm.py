"""Language-model scoring with a log-frequency Bloom filter.

Counts are taken over every training text and every bigram of words, whatever their frequency. A
bigram whose count has quantisation level q is inserted q times, once per level; a look-up probes
level after level and stops at the first that is missing, so the number of hits gives the quantised
count. The filter is cut into segments by a hash of both words, built where the counts are; each has
BITS_EACH bits for each of its insertions, so it grows with the corpus and never fills up. A filter
of at most BROADCAST bytes is broadcast; with a larger one the probes are sent to its segments.

    P(w | v) = (c(v, w) + T(v) * Q(w | v)) / (C(v) + T(v))

with quantised c, C(v) their exact sum, T(v) the number of followers of v, and Q the same formula
over classes: the CLASSES most frequent words (and the end of a text) are classes of their own, all
others share one, in which a word has its share of the smoothed unigram distribution. Class counts
are levels in a table of (CLASSES + 2)^2 bytes, which has no false hits. Classes back off to the
unigram distribution P1(w) = (n(w) + 1) / (N + V + 1). Contexts without followers use Q alone.

The statistics of the FREQUENT most frequent words (a bounded list) are broadcast, the rest are
joined by key; a word outside that list has less than 1/FREQUENT of all tokens, so none of those
keys is hot.

Null and empty texts hold only the end token; with no training text N = V = 0 and every token has
probability 1, so scores are 0; repeated rows are counted each; null keys are in the training part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import arrow_map, keyed, mixed, pinned, shared_path, slices, texts_of, words_of

CLASSES = 4096
FREQUENT = 1 << 18
BITS_EACH = 16
PROBES = 3
SEGMENTS = 64  # at least; more for more than SEGMENT_TEXT bytes of text each
SEGMENT_TEXT = 8_000_000
BROADCAST = 160_000_000
HOT = 100_000
BASE = 1.5  # levels stand for 1, 1.5, 2.25, ... : a level's error is a fifth at most
END = 1  # the hash that stands for the end of a text
START = 0  # and for what stands before a text
REMEMBERED = 300_000


class _Hashes(dict):
    """Word to 63-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes | None) -> int:
        if word is None:
            return END
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = (xxhash.xxh3_64_intdigest(word) >> 1) or 2
        return value


_HASHES = _Hashes()


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, each text closed by END; where each text ends."""
    words, ends = [], []
    for text in texts:
        words += words_of(text)
        words.append(None)
        ends.append(len(words))
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    return hashes, np.array(ends, np.int64)


def _folded(values: np.ndarray) -> dict:
    keys, n = np.unique(values, return_counts=True)
    return {"key": pa.array(keys.astype(np.int64)), "n": pa.array(n, pa.int64())}


def _counted(docs: DataFrame, work) -> DataFrame:
    """(key, n) over all tasks; each batch folds its own keys first."""
    return arrow_map(docs, work, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _before(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash before each token."""
    out = np.empty_like(hashes)
    out[1:] = hashes[:-1]
    out[np.concatenate([[0], ends[:-1]])] = START
    return out


def code_of(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A 64-bit code of a bigram, from the hashes of both words."""
    with np.errstate(over="ignore"):
        return mixed(mixed(before, 5) + after.astype(np.uint64), 6)


def _merged(before: np.ndarray, after: np.ndarray, n: np.ndarray):
    """Equal bigrams added up; the bigrams come out by code."""
    code = code_of(before, after)
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return before[order][first], after[order][first], np.add.reduceat(n[order], first) if len(code) else n, code[first]


def _summed(keys: np.ndarray, *values: np.ndarray):
    """Distinct keys and the sums of their values."""
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, *[np.bincount(at, v, len(distinct)).astype(float) for v in values]


def bigrams(docs: DataFrame, segments: int) -> DataFrame:
    """(segment, content): packed hashes and counts of the bigrams of each batch."""

    def work(batch):
        texts = texts_of(batch)
        for a, b in slices(texts):
            hashes, ends = _tokens(texts[a:b])
            before, after, n, code = _merged(_before(hashes, ends), hashes, np.ones(len(hashes), np.int64))
            part = segment_of(code, segments)
            order = np.argsort(part, kind="stable")
            there, at = np.unique(part[order], return_index=True)
            packed = [np.split(x[order], at[1:]) for x in (before, after, n)]
            content = [b"".join(x.tobytes() for x in columns) for columns in zip(*packed, strict=True)]
            yield {"segment": pa.array(there.astype(np.int32)), "content": pa.array(content, pa.binary())}

    return arrow_map(docs.select("text"), work, "segment int, content binary")


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    """One segment: its filter, and its share of the statistics of each word."""
    parts = [np.frombuffer(x, np.uint64).reshape(3, -1) for x in rows["content"]]
    before, after, n = np.concatenate(parts, axis=1)
    before, after, n, code = _merged(before, after, n.astype(np.int64))
    levels = level_of(n)
    bits = int(max(levels.sum(), 64)) * BITS_EACH // 8 * 8
    filter_ = build_segment(code, levels, bits)
    v, t, c = _summed(before, np.ones(len(before)), count_of(levels))
    w, counts = _summed(after, n)
    return pd.DataFrame(
        {
            "segment": rows["segment"].iloc[:1],
            "bits": [filter_.tobytes()],
            "contexts": [b"".join(x.tobytes() for x in (v.astype(np.int64), t, c))],
            "words": [b"".join(x.tobytes() for x in (w.astype(np.int64), counts))],
            "hot": [np.column_stack([code, levels.astype(np.uint64)])[n > HOT].tobytes()],
        }
    )


def _statistics(built: DataFrame) -> DataFrame:
    """(key, n, t, c): exact count of each word, its followers, and their quantised counts."""

    def work(batch):
        for contexts, words in zip(batch.column("contexts").to_pylist(), batch.column("words").to_pylist(), strict=True):
            k = len(contexts) // 24
            t, c = np.frombuffer(contexts, np.float64, offset=8 * k).reshape(2, -1)
            yield {"key": np.frombuffer(contexts, np.int64, k), "n": np.zeros(k, np.int64), "t": t, "c": c}
            k = len(words) // 16
            n = np.frombuffer(words, np.float64, offset=8 * k).astype(np.int64)
            yield {"key": np.frombuffer(words, np.int64, k), "n": n, "t": np.zeros(k), "c": np.zeros(k)}

    each = arrow_map(built.select("contexts", "words"), work, "key bigint, n bigint, t double, c double")
    return each.groupBy("key").agg(*[F.sum(x).alias(x) for x in ("n", "t", "c")])


class Classes:
    """Rank of each frequent word, by hash, and counts by rank."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.rank, self.counts_by_rank = keys[order].astype(np.uint64), order, counts

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Rank by count, or the number of ranks for all other words."""
        if not len(self.keys):
            return np.full(len(hashes), 0)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.rank[at], len(self.keys))


def level_of(counts: np.ndarray) -> np.ndarray:
    """1 for a count of 1, one more each time the count grows by BASE."""
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The count a level stands for: the middle of its range."""
    low, high = np.power(BASE, levels - 1.0), np.power(BASE, levels * 1.0)
    return np.where(levels <= 0, 0.0, np.where(levels == 1, 1.0, (low + high) / 2))


def segment_of(codes: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    return (mixed(codes, 9) % np.uint64(segments)).astype(np.int64)


def _places(codes: np.ndarray, level: int, bits: int | np.ndarray) -> list[np.ndarray]:
    salted = codes.astype(np.uint64) ^ np.uint64(level << 48)
    return [(mixed(salted, k) % np.asarray(bits).astype(np.uint64)).astype(np.int64) for k in range(PROBES)]


def build_segment(codes: np.ndarray, levels: np.ndarray, bits: int) -> np.ndarray:
    """The bits of one segment, a byte array."""
    flags = np.zeros(bits, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        there = codes[levels >= level]
        for at in _places(there, level, bits):
            flags[at] = True
    return np.packbits(flags, bitorder="little")


def _probed(filter_: np.ndarray, begins: np.ndarray, bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Probe level after level until one is missing; the hits are the level."""
    out = np.zeros(len(codes), np.int64)
    alive, level = np.flatnonzero(bits > 0), 1
    while len(alive):
        hit = np.ones(len(alive), bool)
        for at in _places(codes[alive], level, bits[alive]):
            at = at + begins[alive]
            hit &= (filter_[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        alive = alive[hit]
        out[alive] = level
        level += 1
    return out


def levels_in(filter_: np.ndarray, bits: int | np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Levels of codes; ``bits`` of each segment, or of all alike."""
    sizes = np.full(SEGMENTS, bits) if np.ndim(bits) == 0 else bits
    part = segment_of(codes, len(sizes))
    return _probed(filter_, (np.cumsum(sizes) - sizes)[part], sizes[part], codes)


def fit(docs: DataFrame, volume: int | None = None) -> tuple[dict, DataFrame]:
    """The broadcast part of the model, and all word statistics (key, n, t, c), from rows with ``text``.

    ``volume``: bytes of all text that will be counted or scored, which sets the number of segments.
    ``filter`` is None if it is larger than BROADCAST; ``built`` then has the segments, and bigrams of
    more than HOT occurrences, which would send too many probes to one segment, are a list of their own.
    """
    spark = docs.sparkSession
    if volume is None:
        volume = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    segments = max(SEGMENTS, -(-volume // SEGMENT_TEXT))
    path = shared_path(spark, "bigrams")
    made = bigrams(docs, segments).groupBy("segment").applyInPandas(_built, "segment int, bits binary, contexts binary, words binary, hot binary")
    made.write.option("compression", "zstd").parquet(path)
    built = spark.read.parquet(path)
    stats = pinned(_statistics(built))
    words = stats.where("n > 0")
    top = words.orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()  # bounded by FREQUENT
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    start = stats.where(F.col("key") == START).select("t", "c").first() or (0.0, 0.0)
    frequent = Classes(top.column("key").to_numpy(), top.column("n").to_numpy())
    size = min(CLASSES, len(frequent.counts_by_rank))
    held = spark.sparkContext.broadcast(frequent)

    def work(batch):
        texts = texts_of(batch)
        for a, b in slices(texts):
            before, after = _pairs(*_tokens(texts[a:b]), held.value, size)[:2]
            yield _folded(before * (size + 2) + after)

    def row(rows: pd.DataFrame) -> pd.DataFrame:
        levels = np.zeros(size + 1, np.uint8)
        levels[rows["key"].to_numpy() % (size + 2)] = level_of(rows["n"].to_numpy())
        return pd.DataFrame({"v": rows["key"].iloc[:1] // (size + 2), "levels": [levels.tobytes()]})

    pairs = _counted(docs.select("text"), work)
    rows = pairs.groupBy(F.floor(F.col("key") / (size + 2)).alias("v")).applyInPandas(row, "v bigint, levels binary").toArrow()
    table = np.zeros((size + 2, size + 1), np.uint8)  # a row per class at most
    for at, content in zip(rows.column("v").to_pylist(), rows.column("levels").to_pylist(), strict=True):
        table[at] = np.frombuffer(content, np.uint8)
    t = np.append(top.column("t").to_numpy(), [0.0, start[0]])  # by rank, then light words, then the start
    c = np.append(top.column("c").to_numpy(), [0.0, start[1]])
    stands = count_of(np.arange(256))
    inside = (frequent.counts_by_rank[:size] + 1).sum() / (n + v + 1)
    model = {
        "classes": frequent, "size": size, "n": int(n), "v": int(v), "t": t, "c": c, "table": table,
        "masses": np.array([stands[x].sum() for x in table]), "kinds": (table > 0).sum(axis=1),
        "outside": max(1 - inside, 1 / (n + v + 1)), "filter": None, "segments": segments, "built": path,
    }
    large = built.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()[0] > BROADCAST
    if not large:
        parts = built.select("segment", "bits").toArrow()  # at most BROADCAST bytes
        content = dict(zip(parts.column("segment").to_pylist(), parts.column("bits").to_pylist(), strict=True))
        model["bits"] = np.array([8 * len(content.get(s, b"")) for s in range(segments)], np.int64)
        model["filter"] = np.frombuffer(b"".join(content.get(s, b"") for s in range(segments)), np.uint8)
    else:
        hot = np.frombuffer(b"".join(r[0] for r in built.where(F.length("hot") > 0).select("hot").collect()), np.uint64).reshape(-1, 2)
        hot = hot[np.argsort(hot[:, 0])]  # less than one for each HOT tokens
        model["hot"], model["hot_levels"] = hot[:, 0], hot[:, 1].astype(np.int64)
    return model, stats


def _pairs(hashes: np.ndarray, ends: np.ndarray, classes: Classes, size: int):
    """Class before, class and rank of each token; a text begins after class ``size + 1``."""
    rank = classes.of(hashes)
    after = np.minimum(rank, size)
    before = np.empty_like(after)
    before[1:] = after[:-1]
    before[np.concatenate([[0], ends[:-1]])] = size + 1
    return before, after, rank


def class_logs(model: dict, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """log10 P(class | class before)."""
    size, total = model["size"], model["n"] + model["v"] + 1
    own = (model["classes"].counts_by_rank[:size] + 1) / total
    unigram = np.append(own, max(1 - own.sum(), 1 / total))
    counts = count_of(model["table"][before, after].astype(np.int64))
    mass, kinds = model["masses"][before], model["kinds"][before]
    lower = np.where(mass > 0, kinds / np.maximum(kinds + mass, 1e-300), 1.0)
    return np.log10((1 - lower) * counts / np.maximum(mass, 1e-300) + lower * unigram[after])


def _mixture(c, t, mass, back):
    """P(w | v) of counts c, followers t and their counts' sum, and the back-off probability."""
    return np.where(mass > 0, (np.minimum(c, mass) + t * back) / np.maximum(t + mass, 1e-300), back)


def _judged(model: dict, before: np.ndarray, after: np.ndarray, levels: np.ndarray, begins: np.ndarray):
    """Sum of log10 P(w | v) of each run of bigrams from ``begins``, and a list of those that need rarer words' statistics."""
    classes, size, total = model["classes"], model["size"], model["n"] + model["v"] + 1
    listed = len(classes.counts_by_rank)
    v, w = np.where(before == START, listed + 1, classes.of(before)), classes.of(after)
    class_before = np.where(v == listed + 1, size + 1, np.minimum(v, size))
    back = 10.0 ** class_logs(model, class_before, np.minimum(w, size))
    shares = np.append((classes.counts_by_rank + 1) / total / model["outside"], np.nan)
    shares[:size] = 1
    c, t, mass, share = count_of(levels), model["t"][v], model["c"][v], shares[w]
    whole = (v != listed) & (w != listed)
    logs = np.where(whole, np.log10(np.where(whole, _mixture(c, t, mass, back * share), 1.0)), 0.0)
    light = np.flatnonzero(~whole)
    # Listed words get keys that match nothing, and that do not meet in one partition.
    none = -1 - (mixed(np.arange(len(light)) + mixed(before[light], 3), 4) >> np.uint64(1)).astype(np.int64)
    rare_v, rare_w = v[light] == listed, w[light] == listed
    columns = {
        "v": np.where(rare_v, before[light].astype(np.int64), none),
        "w": np.where(rare_w, after[light].astype(np.int64), none),
        "own": pa.array(np.where(rare_w, 1.0, share[light]), mask=rare_w),
        "back": back[light], "count": c[light], "followers": t[light], "mass": mass[light],
    }
    content = pa.StructArray.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))
    offsets = np.searchsorted(light, np.append(begins, len(before))).astype(np.int32)
    return _sums(logs, begins), pa.ListArray.from_arrays(pa.array(offsets), content)


def _sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of runs, which may be empty."""
    run = np.searchsorted(begins, np.arange(len(values)), side="right") - 1
    return np.bincount(run, values, len(begins)).astype(float)  # integers if there are no values


LIGHT = "array<struct<v:bigint,w:bigint,own:double,back:double,count:double,followers:double,mass:double>>"


def _answered(read: DataFrame, model: dict, held) -> DataFrame:
    """(uid, logs, light): probes sent to the segments of a filter that is too large to broadcast."""
    segments = model["segments"]

    def send(batch):
        content = batch.column("probes").to_pylist()
        pairs = np.concatenate([np.frombuffer(x, np.uint64).reshape(2, -1) for x in content], axis=1)
        uid = np.repeat(batch.column("uid").to_numpy(), [len(x) // 16 for x in content]).astype(np.uint64)
        if not len(uid):
            return
        part = segment_of(code_of(*pairs), segments)
        order = np.argsort(part, kind="stable")
        there, at = np.unique(part[order], return_index=True)
        packed = [np.split(x[order], at[1:]) for x in (uid, *pairs)]
        rows = [b"".join(x.tobytes() for x in columns) for columns in zip(*packed, strict=True)]
        yield {"segment": pa.array(there.astype(np.int32)), "content": pa.array(rows, pa.binary())}

    def answer(asked: pa.Table, built: pa.Table) -> pa.Table:
        content = [np.frombuffer(x, np.uint64).reshape(3, -1) for x in asked.column("content").to_pylist()]
        rows = np.concatenate([np.zeros((3, 0), np.uint64), *content], axis=1)
        uid, before, after = rows[:, np.argsort(rows[0], kind="stable")]
        filter_ = np.frombuffer(built.column("bits")[0].as_py() if built.num_rows else b"", np.uint8)
        codes, at = np.unique(code_of(before, after), return_inverse=True)
        levels = _probed(filter_, np.zeros(len(codes), np.int64), np.full(len(codes), 8 * len(filter_)), codes)[at]
        texts, begins = np.unique(uid, return_index=True)
        logs, light = _judged(held.value, before, after, levels, begins)
        return pa.table({"uid": texts.astype(np.int64), "logs": logs, "light": light})

    sent = arrow_map(read.select("uid", "probes"), send, "segment int, content binary").groupBy("segment")
    built = read.sparkSession.read.parquet(model["built"]).select("segment", "bits").groupBy("segment")
    return sent.cogroup(built).applyInArrow(answer, f"uid bigint, logs double, light {LIGHT}")


def scored(docs: DataFrame, trainable: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    own = keyed(docs, key, text)
    volume = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    model, stats = fit(own.where(trainable), volume)
    total = model["n"] + model["v"] + 1
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        texts, known = texts_of(batch), held.value
        classes = known["classes"]
        grown = np.append(np.log10(classes.counts_by_rank + 1), 0.0)
        for a, b in slices(texts):
            hashes, ends = _tokens(texts[a:b])
            before, begins = _before(hashes, ends), np.concatenate([[0], ends[:-1]])
            rank = classes.of(hashes)
            codes, at = np.unique(code_of(before, hashes), return_inverse=True)
            if known["filter"] is not None:
                here, levels = np.ones(len(hashes), bool), levels_in(known["filter"], known["bits"], codes)[at]
            else:
                place = np.minimum(np.searchsorted(known["hot"], codes), max(len(known["hot"]) - 1, 0))
                found = known["hot"][place] == codes if len(known["hot"]) else np.zeros(len(codes), bool)
                here, levels = found[at], np.where(found, known["hot_levels"][place] if len(known["hot"]) else 0, 0)[at]
            kept = np.searchsorted(np.flatnonzero(here), begins)
            logs, light = _judged(known, before[here], hashes[here], levels[here], kept)
            left = [np.flatnonzero(~here[i:j]) + i for i, j in zip(begins, ends, strict=True)] if known["filter"] is None else [[]] * (b - a)
            yield {
                "uid": batch.column("uid")[a:b],
                "id": batch.column("id")[a:b],
                "n_tokens": pa.array(ends - begins, pa.int64()),
                "known": pa.array(np.add.reduceat((rank < len(classes.counts_by_rank)).astype(np.int64), begins)),
                "base": pa.array(np.add.reduceat(grown[rank], begins)),
                "logs": pa.array(logs),
                "light": light,
                "probes": pa.array([before[x].tobytes() + hashes[x].tobytes() if len(x) else b"" for x in left], pa.binary()),
            }

    kind = dict(own.dtypes)["id"]
    schema = f"uid bigint, id {kind}, n_tokens bigint, known bigint, base double, logs double, light {LIGHT}, probes binary"
    read = pinned(arrow_map(own.withColumn("uid", F.monotonically_increasing_id()), work, schema))
    lights, rest = read.select("uid", "light"), None
    if model["filter"] is None:
        answered = pinned(_answered(read, model, held))
        lights = lights.unionByName(answered.select("uid", "light"))
        rest = answered.select("uid", F.lit(0).cast("bigint").alias("known"), F.lit(0.0).alias("base"), "logs")
    # Words outside the list: exact statistics by key, a sum for each text.
    each = lights.select("uid", F.inline("light"))
    each = each.join(stats.select(F.col("key").alias("v"), "t", F.col("c").alias("all")), "v", "left")
    each = each.join(stats.select(F.col("key").alias("w"), "n"), "w", "left")
    n, rare = F.coalesce("n", F.lit(0)), F.col("own").isNull()
    back = F.col("back") * F.coalesce("own", (n + 1) / F.lit(float(total * model["outside"])))
    t, mass = F.coalesce("t", "followers"), F.coalesce("all", "mass")
    mixture = F.when(mass > 0, (F.least("count", mass) + t * back) / (t + mass)).otherwise(back)
    sums = each.select(
        "uid",
        F.when(rare & (n > 0), 1).otherwise(0).cast("bigint").alias("known"),
        F.when(rare, F.log10(n + 1.0)).otherwise(0.0).alias("base"),
        F.log10(mixture).alias("logs"),
    )
    sums = (sums if rest is None else sums.unionByName(rest)).groupBy("uid").agg(*[F.sum(x).alias(f"rare_{x}") for x in ("known", "base", "logs")])

    def with_rare(name: str, zero) -> Column:
        return F.col(name) + F.coalesce(f"rare_{name}", F.lit(zero))

    return read.drop("light", "probes").join(sums, "uid", "left").select(
        F.col("id").alias(key),
        (~trainable).alias("held_out"),
        "n_tokens",
        with_rare("known", 0).alias("n_known"),
        F.lit(model["n"]).cast("bigint").alias("train_tokens"),
        (with_rare("base", 0.0) - F.col("n_tokens") * float(np.log10(total))).alias("base_score"),
        with_rare("logs", 0.0).alias("score"),
    )
