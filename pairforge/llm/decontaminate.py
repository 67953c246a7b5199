"""Benchmark decontamination by canonical templates.

Texts become word sequences in which numbers, units after numbers, and names (capitalised words inside
a sentence) are typed placeholders. Windows of five words of the documents are hash-joined with those
of the benchmark items. Where a window holds slots, the values on both sides are paired, and pairs at
the same alignment must be consistent (one benchmark value, one document value); inconsistent
alignments lose their windows that rest on slots. A document is contaminated by an item if at least
``least`` of the item's windows are found in it, so re-parameterised questions are caught as well.

Names at the start of a text or sentence, after digits, quotes or line breaks look like any capitalised
word, and numbers may be written with separators and decimals, or stuck to their unit. So all is done
again on a wider form, in which every capitalised word is a name, a whole number is one placeholder
and a unit is split from it; it adds the items that the first form did not find in a document. Only
windows that hold under other names count there, for items in which these are half of all or more.

An item whose windows are too few words or too many placeholders to carry evidence is looked for word
for word: its whole word sequence, anchored by the hash of its first words and then compared in full.

A name is matched as a word too, so that copies in other case are found. Two bit filters of fixed size
only save work. Words of letters are themselves in every form, so a document that misses too many pairs
of neighbouring ones cannot hold ``least`` of an item's windows: of each item as many pairs are kept as cannot
all be missing, those of fewest items first, and documents without any of them are not looked at further.
Windows of the others pass a filter made from the benchmark's windows. What the filters let through is
joined exactly. Everything is DataFrame functions.

Null texts count as empty and match nothing; windows with fewer than three words that are no
placeholders carry no evidence, and items without any other window match whole, numbers included,
however short they are; rows with null item ids are passed over;
repeated item ids count as one item, of which each window may be found; repeated documents are one
document, and all documents with a null key are one document.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.binding import bind
from pairforge.llm.common import pinned, with_row

WORDS = 5
LITERALS = 3
FILTER_BITS = 1 << 20
#: Units of measure that count as such after a number.
UNITS = (
    "kg g mg lb lbs oz ton tons km m cm mm mile miles ft feet inch inches yard yards l ml litre litres liter liters gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents"
).split()
#: A capitalised word after a small letter or a sign inside a sentence; of two in a row the second needs a second pass.
_NAME = r"([\p{Ll},;:] )(\p{Lu}\p{Ll}+)"


#: In the wider form: the sign that stands for a separator inside a number, and all that may be a name.
_INSIDE = "\u00b7"
_CAPITALISED = r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}+(?![\p{L}\p{N}])"


def _folded(text: Column) -> Column:
    """Separators inside numbers to one sign, units split from their number."""
    inside = F.regexp_replace(F.translate(text, _INSIDE, " "), r"(?<=\p{Nd})[.,](?=\p{Nd})", _INSIDE)
    return F.regexp_replace(inside, rf"(?i)(\p{{Nd}})({'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])", "$1 $2")


def _numbered(text: Column) -> Column:
    """Lower case, digits to ``#``, units after a number to ``§``."""
    plain = F.regexp_replace(F.lower(text), rf"\p{{Nd}}+(?:{_INSIDE}\p{{Nd}}+)*", "#")
    return F.regexp_replace(plain, rf"# ({'|'.join(UNITS)})([^\p{{L}}\p{{N}}]|$)", "# §$2")


def _named(text: Column) -> Column:
    """Names to ``@``."""
    twice = F.regexp_replace(F.regexp_replace(text, _NAME, "$1@$2"), _NAME, "$1@$2")
    return F.regexp_replace(twice, r"@\p{Lu}\p{Ll}+", "@")


def _split(text: Column, more: str = "") -> Column:
    return F.filter(F.split(text, rf"[^\p{{L}}\p{{N}}#§@{more}]+"), lambda w: w != "")


def _words(rows: DataFrame, wide: bool = False) -> DataFrame:
    """Three aligned word lists: as words, as a template with names, and the words themselves."""
    text = F.translate(F.col("text"), "#§@", "   ")
    rows = rows.withColumn("text", _folded(text) if wide else F.translate(text, _INSIDE, " "))
    named = F.regexp_replace("text", _CAPITALISED, "@") if wide else _named(F.col("text"))
    more = _INSIDE if wide else ""
    return rows.select(
        "id",
        _split(_numbered(F.col("text")), more).alias("plain"),
        _split(_numbered(named), more).alias("template"),
        _split(F.lower("text"), more).alias("words"),
    )


def _zipped(column: str) -> Column:
    """Each word with the four that follow it; the last windows are cut off."""
    least = F.size(column) >= WORDS
    shifted = [F.slice(column, k, F.greatest(F.size(column) - (WORDS - 1), F.lit(0))) for k in range(1, WORDS + 1)]
    return F.when(least, F.arrays_zip(*[s.alias(f"w{k}") for k, s in enumerate(shifted)]))


def _windows(rows: DataFrame, wide: bool = False) -> DataFrame:
    """(id, pos, plain, template, words): hashes of both forms of each window, and the document's words."""
    listed = _words(rows, wide)
    both = F.arrays_zip(_zipped("plain").alias("p"), _zipped("template").alias("t"))
    each = listed.select("id", "words", F.posexplode(both).alias("pos", "window"))
    name = [f"w{k}" for k in range(WORDS)]
    return each.select(
        "id",
        "pos",
        F.xxhash64(*[F.col("window.p")[n] for n in name]).alias("plain"),
        F.xxhash64(*[F.col("window.t")[n] for n in name]).alias("template"),
        "words",
        "window",
    )


def _slots(form: str) -> Column:
    return F.array(*[F.col(f"window.{form}")[f"w{k}"].isin("#", "§", "@") for k in range(WORDS)])


def _literals(form: str) -> Column:
    """Pairs of neighbouring words of letters that no form changes: no units, and no sigma, whose small letter depends on what follows."""
    same = lambda w: F.rlike(w, F.lit(r"^\p{L}+$")) & ~w.isin(UNITS) & ~F.rlike(w, F.lit("[σς]"))
    words = [F.col(f"window.{form}")[f"w{k}"] for k in range(WORDS)]
    return F.array_compact(F.array_distinct(F.array(*[F.when(same(v) & same(w), F.struct(v.alias("v"), w.alias("w"))) for v, w in zip(words, words[1:])])))


def benchmark_windows(items: DataFrame, key: str = "item_id", text: str = "text", wide: bool = False) -> DataFrame:
    """(hash, item, item_pos, slots, values, literals): both forms of each window with enough literal words."""
    own = items.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    forms = _windows(own, wide).select(
        F.col("id").alias("item"),
        F.col("pos").alias("item_pos"),
        F.slice("words", F.col("pos") + 1, WORDS).alias("values"),
        F.explode(
            F.array_distinct(
                F.array(
                    F.struct(F.col("plain").alias("hash"), _slots("p").alias("slots"), F.lit(not wide).alias("named"), _literals("p").alias("literals")),
                    F.struct(F.col("template").alias("hash"), _slots("t").alias("slots"), F.lit(True).alias("named"), _literals("t").alias("literals")),
                )
            )
        ).alias("form"),
    )
    literal = F.size(F.filter("form.slots", lambda s: ~s))
    if wide:
        counted = forms.where(literal >= LITERALS).groupBy("item").agg(
            F.countDistinct("item_pos").alias("all"), F.countDistinct(F.when(F.col("form.named"), F.col("item_pos"))).alias("named")
        )
        enough = counted.where(2 * F.col("named") >= F.col("all"))
        forms = forms.where("form.named").join(enough.select("item"), "item", "left_semi")
    return forms.where(literal >= LITERALS).select("form.hash", "item", "item_pos", "form.slots", "values", "form.literals")


def _bits(windows: DataFrame) -> DataFrame:
    """One row: the bit filter, FILTER_BITS / 64 numbers."""
    place = F.pmod(F.col("hash"), F.lit(FILTER_BITS))
    set_ = windows.groupBy(F.shiftright(place, 6).cast("int").alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))).alias("bits")
    )
    # At most FILTER_BITS / 64 rows.
    one = set_.agg(F.map_from_entries(F.collect_list(F.struct("at", "bits"))).alias("m"))
    zeros = F.sequence(F.lit(0), F.lit(FILTER_BITS // 64 - 1))
    listed = one.select(F.map_zip_with("m", F.map_from_arrays(zeros, F.transform(zeros, lambda _: F.lit(0).cast("bigint"))), lambda _, a, b: F.coalesce(a, b)).alias("m"))
    return listed.select(F.transform(F.array_sort(F.map_entries("m")), lambda e: e["value"]).alias("bits"))


def _may_hold(bits: Column, hash_: Column) -> Column:
    place = F.pmod(hash_, F.lit(FILTER_BITS))
    return F.call_function("getbit", F.get(bits, F.shiftright(place, 6).cast("int")), (place % 64).cast("int")) == 1


def _needed(known: DataFrame, least: float) -> DataFrame | None:
    """(v, w): pairs of neighbouring words, of which a document holds one at least, if it holds ``least`` of the windows of any item.

    A found window holds all its literal pairs, WORDS - 1 at most. So the windows of the pairs that a document
    misses, added up by pair, are at most WORDS - 1 times those it may miss. None if an item has too few pairs.
    """
    each = known.groupBy("item", "item_pos").agg(F.collect_set("literals").alias("forms"))
    held = F.aggregate("forms", F.get("forms", F.lit(0)), F.array_intersect)
    pairs = each.select("item", F.explode(held).alias("pair")).groupBy("item", "pair").agg(F.count(F.lit(1)).alias("n"))
    spread = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("items"))
    rank = F.struct("items", (-F.length("pair.v") - F.length("pair.w")).alias("size"), "pair", "n")
    listed = pairs.join(spread, "pair").groupBy("item").agg(F.array_sort(F.collect_list(rank)).alias("pairs"))
    may_miss = known.groupBy("item").agg((F.countDistinct("item_pos") * ((WORDS - 1) * (1 - least)) + 1e-6).alias("may_miss"))

    def before(k) -> Column:
        return F.aggregate(F.slice("pairs", F.lit(1), k), F.lit(0).cast("bigint"), lambda n, w: n + w["n"])

    rows = pinned(may_miss.join(listed, "item", "left"))
    if not rows.where(~F.coalesce(before(F.size("pairs")) > F.col("may_miss"), F.lit(False))).isEmpty():
        return None
    first = F.filter("pairs", lambda w, k: before(k) <= F.col("may_miss"))
    return rows.select(F.explode(first).alias("first")).select("first.pair.*").distinct()


def _with_needed(own: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Rows that may hold ``least`` of the windows of an item, by the pairs of neighbouring words they hold."""
    needed = _needed(known, least)
    if needed is None:
        return own
    hashes = [F.xxhash64("v", "w", F.lit(k)) for k in range(2)]
    # One row of FILTER_BITS / 64 numbers, joined: as a literal it would stand in every text of the plan that the driver keeps.
    bits = pinned(_bits(needed.select(F.explode(F.array(*hashes)).alias("hash"))).select(F.col("bits").alias("_needed")))
    words = F.split(F.lower(F.translate("text", "#§@", "   ")), r"[^\p{L}\p{N}]+")
    may_hold = lambda v, w: reduce(and_, [_may_hold(F.col("_needed"), F.xxhash64(v, w, F.lit(k))) for k in range(2)])
    holds = bind(words, lambda x: F.exists(F.zip_with(x, F.slice(x, F.lit(2), F.size(x)), may_hold), lambda found: found))
    return own.join(F.broadcast(bits), holds, "left_semi")


def _whole(docs: DataFrame, items: DataFrame, known: DataFrame) -> DataFrame | None:
    """(id, item) for items without a row in ``known`` whose whole word sequence stands in a document."""
    listed = _words(items).select(F.col("id").alias("item"), F.col("words").alias("sequence")).where(F.size("sequence") > 0)
    anchor = F.slice("sequence", 1, WORDS)
    short = pinned(listed.join(known.select("item").distinct(), "item", "left_anti").withColumn("hash", F.xxhash64(anchor, F.size(anchor))))
    lengths = [row[0] for row in short.select(F.size(anchor)).distinct().collect()]  # WORDS at most
    if not lengths:
        return None
    bits = _bits(short).scalar()
    each = _words(docs).select("id", "words", F.posexplode("words").alias("pos", "word")).drop("word")
    begun = each.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.slice("words", F.col("pos") + 1, k).alias("said")) for k in lengths])).alias("run"))
    begun = begun.where(F.size("run.said") == F.col("run.k")).withColumn("hash", F.xxhash64("run.said", "run.k"))
    begun = begun.where(_may_hold(bits, F.col("hash")))
    same = F.slice("words", F.col("pos") + 1, F.size("sequence")) == F.col("sequence")
    return begun.join(short, "hash").where(same).select("id", "item").distinct()


def contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", least: float = 0.8
) -> DataFrame:
    """A row for each document and item found in it: key, item_id, n_found, n_windows, share, reworded."""
    named = [F.col("id").alias(key), F.col("item").alias(item), "n_found", "n_windows", "share", "reworded"]
    own = docs.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    asked = items.where(F.col(item).isNotNull()).select(F.col(item).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    known = benchmark_windows(items, item)
    found = pinned(_shared(own, known, least))
    wider = _shared(own, benchmark_windows(items, item, wide=True), least, wide=True)
    seen = found.select(F.col("id").alias("seen_id"), F.col("item").alias("seen_item"))
    found = found.unionByName(wider.join(seen, F.col("id").eqNullSafe(F.col("seen_id")) & (F.col("item") == F.col("seen_item")), "left_anti"))
    whole = _whole(own, asked, known)
    if whole is not None:
        one = F.lit(1).cast("bigint")
        found = found.unionByName(whole.select("id", "item", one.alias("n_found"), one.alias("n_windows"), F.lit(1.0).alias("share"), F.lit(False).alias("reworded")))
    return found.select(*named)


def _shared(own: DataFrame, known: DataFrame, least: float, wide: bool = False) -> DataFrame:
    """Items of which ``least`` of the windows are in a document: id, item, n_found, n_windows, share, reworded."""
    sizes = known.groupBy("item").agg(F.countDistinct("item_pos").alias("n_windows"))
    bits = _bits(known).scalar()
    forms = ["template"] if wide else ["plain", "template"]
    held = reduce(or_, [_may_hold(bits, F.col(f)) for f in forms])
    passed = _windows(_with_needed(own, known, least), wide).where(held)
    asked = passed.select(
        "id",
        "pos",
        F.slice("words", F.col("pos") + 1, WORDS).alias("said"),
        F.explode(F.array_distinct(F.array(*forms))).alias("hash"),
    )
    found = asked.join(known, "hash")
    found = pinned(found.select("id", "pos", "said", "item", "item_pos", "slots", "values")).withColumns(
        {
            "offset": F.col("pos") - F.col("item_pos"),
            "pairs": F.filter(F.arrays_zip("slots", "values", "said"), lambda x: x["slots"]),
        }
    )
    on_slots = F.size("pairs") > 0
    valued = found.where(on_slots).select("id", "item", "offset", F.explode("pairs").alias("pair"))
    unlike = (
        valued.groupBy("id", "item", "offset", F.col("pair.values").alias("value"))
        .agg(F.min("pair.said").alias("first"), F.max("pair.said").alias("last"))
        .where("first <> last")
        .select("id", "item", "offset")
        .distinct()
    )
    unlike = unlike.select(*[F.col(c).alias(f"unlike_{c}") for c in ("id", "item", "offset")])
    same = [F.col(c).eqNullSafe(F.col(f"unlike_{c}")) for c in ("id", "item", "offset")]
    checked = found.join(unlike, same[0] & same[1] & same[2] & on_slots, "left_anti")
    # A window found at several places, or in both forms, counts once.
    once = checked.groupBy("id", "item", "item_pos").agg(F.min(F.exists("pairs", lambda p: p["values"] != p["said"])).alias("reworded"))
    counted = once.groupBy("id", "item").agg(F.count(F.lit(1)).alias("n_found"), F.max("reworded").alias("reworded"))
    share = F.col("n_found") / F.col("n_windows")
    return (
        counted.join(sizes, "item")
        .withColumn("share", share)
        .where(share >= least)
        .select("id", "item", "n_found", "n_windows", "share", "reworded")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """The documents in which no item is found, with their own columns."""
    # Each row is a document of its own: keys may be null or repeated. Ids are written before use, so retries agree.
    rows = with_row(docs, "_row")
    found = contaminated(rows.select("_row", text), items, "_row", text, least=least).select(F.col("_row").alias("found")).distinct()
    return rows.join(found, rows["_row"] == found["found"], "left_anti").drop("_row")
