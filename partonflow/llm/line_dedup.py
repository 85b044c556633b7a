"""Line dedup by an exact set-similarity join.

A line is the set of its words in lower case.  A line goes if an earlier line,
in the order of (doc_id, position), has a Jaccard similarity of ``threshold`` or
more to it, whether that earlier line itself stays or not.

* The words of a line are ordered by rarity: first by a class of how often the
  word's slot of a table of 2^18 slots occurs, then by hash.  Two similar lines share
  a word among the rarest few of each (prefix filter).  Any one order is exact, so
  the counts come from a sample of about SAMPLE documents, chosen by a hash of their ids and texts.
* Lines with the same set are one entry of the join, so copies never meet.  Entries
  are numbered in the order of (doc_id, position); the index of prefix words holds
  that number, the size, the place of the word and the parity bits, nothing else.
* Entries that share a prefix word meet the first HUBS of them, its hubs; an entry is
  compared with the hub that looks nearest, and what is removed need not be compared
  again as a later line.  Only the rest meets all other earlier entries of its words, again
  the nearest first.  So a large group of near copies mostly costs its size, not its square.
* The index is made and joined in SLICES parts by word, one after the other, so that
  the shuffle files of one part are on disk at a time.
* A pair must pass the length and the positional filter, and the Hamming
  distance of parity bits of the two sets, which is never larger than their
  difference, before the sets themselves are compared.  The index has 64 of them for a short
  line and 128 for a long one, which may differ in more words than 64 bits can tell from
  chance (from about 250 words on, more than 128 can); a pair is compared in as many as both have.

Built-in functions only.  Texts do not move but those of documents with a pair
to verify or a line to remove.  Tables are dropped, and shuffle files given up, as
soon as nothing reads them any more.

Contract: lines without words stay, NULL texts stay NULL, all columns pass
through and clashing names are no problem.  Rows that repeat an id and a text
are one document: both keep and lose the same lines.  NULL ids come first, as if
they were one id: of two rows with NULL and different texts the lines are in order of position.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partonflow.llm.common import WORD_SPLIT, dropped, partitions, released, stored, unused

SLOT_BITS, PER_LONG = 18, 16
#: Lines of more words have 128 parity bits, others 64.
LONGER = 36
#: Parts of the index, by word.  They are shuffled one after the other, so that the shuffle files of one are on disk at a time.
SLICES = 3
#: Entries of each word that all its later ones meet.
HUBS = 4
BITS = ("parity", "half")
MEMBER = ("entry", "n", "at", *BITS)
#: Parity bits of a set where pairs are verified.
WIDE = 256


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shift(name: str, value: Column, by: Column) -> Column:
    return F.call_function(name, value, by.cast("int"))


def words_of(line: Column) -> Column:
    """Words of a line in lower case; one empty word if there is none."""
    return F.split(F.btrim(F.lower(line), F.lit(" \t\n\x0b\x0c\r")), WORD_SPLIT)


def _table(values: DataFrame, count: int) -> Column:
    """Scalar: the longs ``v`` at ``i`` of ``values`` as one array of ``count`` longs, 0 where there is none."""
    dense = values.sparkSession.range(count).join(values.withColumnRenamed("i", "id"), "id", "left")
    row = dense.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("v", F.lit(0)).alias("v"))))["v"].alias("t"))
    # Written, so that the queries that use it do not count again.
    return stored(row, "table").scalar()


def rarity_table(words: DataFrame) -> Column:
    """Scalar: for each slot of a hash of ``word`` a class of its number of occurrences, 16 slots in a long.

    The eight classes divide the powers of two from a sixteenth of the mean count to the largest, at any corpus size.
    """
    slot = F.shiftrightunsigned(F.xxhash64("word"), 64 - SLOT_BITS)
    slots = stored(words.groupBy(slot.alias("slot")).count(), "slots")
    least = F.greatest(F.lit(0.0), F.log2(F.sum("count") / (1 << SLOT_BITS)) - 4)
    span = slots.agg(F.struct(least.alias("low"), F.log2(F.max("count")).alias("high"))).scalar()
    part = 8 * (F.log2("count") - span["low"]) / F.greatest(F.lit(1e-9), span["high"] - span["low"])
    classed = slots.select("slot", F.greatest(F.lit(0), F.least(F.lit(7), F.floor(part))).cast("long").alias("level"))
    bits = _shift("shiftleft", F.col("level"), F.col("slot") % PER_LONG * 4)
    return _table(classed.filter("level > 0").groupBy(F.shiftright("slot", 4).alias("i")).agg(F.sum(bits).alias("v")), (1 << SLOT_BITS) // PER_LONG)


def membership(keys: DataFrame, bits: int = 21) -> Column:
    """Scalar: a bit for the hash of each ``key``; a value whose bit is not set is not among the keys."""
    slot = F.shiftrightunsigned(F.xxhash64("key"), 64 - bits)
    one = _shift("shiftleft", F.lit(1).cast("long"), F.col("slot") % 64)
    longs = keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("i")).agg(F.bit_or(one).alias("v"))
    return _table(longs, (1 << bits) // 64)


def maybe_in(value: Column, table: str, bits: int = 21) -> Column:
    """Whether the bit of ``value`` is set in the column ``table``."""
    slot = F.shiftrightunsigned(F.xxhash64(value), 64 - bits)
    return F.bit_get(F.element_at(F.col(table), F.shiftright(slot, 6).cast("int") + 1), (slot % 64).cast("int")) == 1


def ranked_words(line: Column, table: Column) -> Column:
    """Distinct words of a line as longs: three bits of rarity class, then 60 bits of hash; sorted."""

    # ``table`` is read in place; bound to a lambda, or as a column of every line, it would be copied for each.
    def key(h: Column) -> Column:
        level = _shift("shiftright", F.element_at(table, F.shiftrightunsigned(h, 68 - SLOT_BITS).cast("int") + 1), F.shiftrightunsigned(h, 64 - SLOT_BITS) % PER_LONG * 4)
        return F.shiftleft(level.bitwiseAND(7), 60).bitwiseOR(F.shiftrightunsigned(h, 4))

    hashes = F.transform(F.filter(words_of(line), lambda w: w != ""), lambda w: F.xxhash64(w))
    return F.sort_array(F.array_distinct(F.transform(hashes, key)))


def _needed(n: Column, threshold: float) -> Column:
    """Words that a set of ``n`` must share with any similar one; exact, as the threshold is in thousandths."""
    return F.floor((n * round(threshold * 1000) + 999) / 1000).cast("int")


def _may_match(threshold: float) -> Column:
    """Length, positional and parity filter of two entries, their columns called a_ and b_."""
    t = round(threshold * 1000)
    na, nb, pa, pb = (F.col(f"{x}_{y}").cast("long") for y in ("n", "at") for x in ("a", "b"))
    both = na + nb
    # The smallest overlap that reaches the threshold.  All of it lies from the first common word on, so that word's
    # row passes; rows of the same pair for later common words need not.
    overlap = F.ceil(both * t / (1000 + t) - 1e-9)
    reach = F.least(na - pa, nb - pb)
    return (
        (na * 1000 >= nb * t)
        & (nb * 1000 >= na * t)
        & (reach >= overlap)
        & (_far(longer=False) <= both - 2 * overlap)
        & (_far() <= both - 2 * overlap)
    )


def _parity(words: str) -> list[Column]:
    """The columns BITS of a set: parity of 64 slots and, of a long set, of the first 64 of 128."""
    none, one = F.lit(0).cast("long"), lambda w: _shift("shiftleft", F.lit(1).cast("long"), w % 64)
    whole = F.aggregate(words, none, lambda acc, w: acc.bitwiseXOR(one(w)))
    half = F.aggregate(words, none, lambda acc, w: acc.bitwiseXOR(F.when(F.shiftright(w, 6) % 2 == 0, one(w)).otherwise(none)))
    return [whole.alias("parity"), F.when(F.size(words) > LONGER, half).otherwise(none).alias("half")]


def _far(longer: bool = True) -> Column:
    """Differing parity bits of a_ and b_, of as many as both have: the half that is not kept is what the other differs in from the whole."""
    whole, half = (F.col(f"a_{x}").bitwiseXOR(F.col(f"b_{x}")) for x in BITS)
    both = F.bit_count(half) + F.bit_count(whole.bitwiseXOR(half))
    return F.when(F.least("a_n", "b_n") > LONGER, both).otherwise(F.bit_count(whole)) if longer else F.bit_count(whole)


def _side(name: str, of: str = "") -> list[Column]:
    """The columns MEMBER of an entry, in front of them ``name``; never NULL, which stored columns may be for all that Spark knows."""
    return [F.coalesce(F.col(of + c), F.lit(0)).alias(f"{name}_{c}") for c in MEMBER]


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """(doc, hash, pos) of the lines to remove; ``hash`` is xxhash64 of the document's text, ``pos`` from 0."""
    source = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).filter("text IS NOT NULL")
    levels = rarity_table(source.select(F.explode(words_of(F.col("text"))).alias("word")))

    ranked = source.withColumn("t", levels).select(
        "doc", F.xxhash64("text").alias("hash"), F.posexplode(F.transform(F.split("text", "\n"), lambda line: ranked_words(line, F.col("t")))).alias("pos", "words")
    )
    n = F.size("words")
    prefix = F.slice("words", F.lit(1), n - _needed(n, threshold) + 1)
    lines = ranked.filter(n > 0).select(
        "doc", "hash", "pos", F.xxhash64("words").alias("key"), n.alias("n"), *_parity("words"), prefix.alias("prefix")
    )
    lines = stored(lines, "lines")

    # One entry for each set of words: its first line, numbered in the order of lines.
    first = F.min(F.struct("doc", "pos", *BITS, "prefix")).alias("f")
    entries = lines.groupBy("key", "n").agg(first, F.count("*").alias("copies")).select("key", "n", "copies", "f.*")
    entries = entries.repartitionByRange(partitions(docs.sparkSession), "doc", "pos", "key").sortWithinPartitions("doc", "pos", "key")
    ordered = stored(entries.withColumn("entry", F.monotonically_increasing_id()), "ordered")
    entries = stored(ordered.drop("prefix", *BITS), "entries")
    whole, lines = lines, stored(lines.select("doc", "hash", "pos", "key", "n"), "places")
    dropped(whole)

    # Sets of up to three words are similar to equal ones only.
    smallest = next(k for k in range(1, 1000) if k * 1000 >= (k + 1) * round(threshold * 1000)) if threshold < 1 else 1 << 30
    spread = ordered.filter(F.col("n") >= smallest).select(F.posexplode("prefix").alias("at", "word"), "entry", "n", *BITS)
    # Words of a single entry, most of the rare ones, meet nobody.
    same = Window.partitionBy("word").orderBy("entry").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hubs = F.array(*[F.nth_value(F.struct(*MEMBER), k + 1).over(same) for k in range(HUBS)])
    met = []
    for part in range(SLICES):
        some = spread.filter(F.pmod("word", F.lit(SLICES)) == part)
        some = some.select("word", *MEMBER, F.count("*").over(same).alias("members"), hubs.alias("hubs"))
        met.append(stored(some.filter("members > 1"), "met"))
        released(docs.sparkSession)
    dropped(ordered)

    def candidates(met: DataFrame) -> DataFrame:
        """(later, earlier) of pairs that may match, with how near they look: differing parity bits, and shared prefix words."""
        pairs = met.filter(F.col("a_entry") > F.col("b_entry")).filter(_may_match(threshold))
        pairs = pairs.select(F.col("a_entry").alias("later"), F.col("b_entry").alias("earlier"), _far().alias("far"))
        return pairs.groupBy("later", "earlier").agg(F.min("far").alias("far"), (-F.count("*")).alias("shared"))

    def settled(pairs: DataFrame) -> DataFrame:
        """``later`` of these pairs that are similar."""
        return _verified(pairs.select("later", "earlier"), entries, source, levels, threshold)

    nearest = F.min(F.struct("far", "shared", "earlier"))["earlier"].alias("earlier")
    rays = reduce(DataFrame.unionByName, met).select(*MEMBER, F.explode("hubs").alias("hub")).filter("hub IS NOT NULL AND entry > hub.entry")
    star = stored(candidates(rays.select(*_side("a"), *_side("b", "hub."))), "star")
    gone = settled(star.groupBy("later").agg(nearest))

    more = []
    for some in met:
        rest = some.filter(F.col("members") > HUBS + 1).filter(F.col("entry") > F.get("hubs", F.lit(HUBS - 1))["entry"]).select("word", *MEMBER)
        # What its nearest hub removed meets nobody else as a later line.
        a = _without(rest, gone).select("word", *_side("a"))
        b = rest.select("word", *_side("b"))
        more.append(stored(candidates(a.join(b, "word")), "more"))
        dropped(some)
    both = reduce(DataFrame.unionByName, more).groupBy("later", "earlier").agg(F.min("far").alias("far"), F.sum("shared").alias("shared"))
    # First the earlier line that looks nearest, of each later one; all its others only where that one is not similar.
    pairs = stored(both.unionByName(star.join(gone, "later", "left_anti")), "pairs")
    dropped(star, *more)
    gone = stored(gone.unionByName(settled(pairs.groupBy("later").agg(nearest))), "gone")
    gone = gone.unionByName(settled(pairs.join(gone, "later", "left_anti"))).distinct().withColumn("similar", F.lit(True))

    # All lines of a set that goes, and all but the first of any other.
    known = entries.join(gone.withColumnRenamed("later", "entry"), "entry", "left")
    known = known.filter("similar OR copies > 1").select("key", "n", F.col("doc").alias("d"), F.col("pos").alias("p"), F.coalesce("similar", F.lit(False)).alias("similar"))
    last = lines.join(known, ["key", "n"])
    itself = F.col("doc").eqNullSafe(F.col("d")) & (F.col("pos") == F.col("p"))
    found = stored(last.filter(F.col("similar") | ~itself).select("doc", "hash", "pos").distinct(), "found")
    dropped(lines, entries, pairs)
    return found


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose entry is not among ``gone``; only those that a bit table cannot clear are moved for it."""
    marked = rows.withColumn("t", membership(gone.select(F.col("later").alias("key"))))
    clear = maybe_in(F.col("entry"), "t")
    maybe = marked.filter(clear).drop("t").join(gone.select(F.col("later").alias("entry")), "entry", "left_anti")
    return marked.filter(~clear).drop("t").unionByName(maybe.select(*rows.columns))


def _wide(words: str) -> Column:
    """Parity bits of a set, one for each of WIDE slots, as longs."""

    def part(i: int) -> Column:
        mine = F.filter(words, lambda w: F.shiftright(w, 6) % (WIDE // 64) == i)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda acc, w: acc.bitwiseXOR(_shift("shiftleft", F.lit(1).cast("long"), w % 64)))

    return F.array(*[part(i) for i in range(WIDE // 64)])


def _verified(pairs: DataFrame, entries: DataFrame, source: DataFrame, levels: Column, threshold: float) -> DataFrame:
    """``later`` of the pairs whose sets of words are similar."""
    asked = pairs = stored(pairs, "candidates")
    numbers = pairs.select(F.col("later").alias("entry")).union(pairs.select("earlier")).distinct()
    wanted = entries.select("entry", "doc", "pos", "key").join(numbers, "entry")
    documents = stored(wanted.groupBy("doc").agg(F.collect_set(F.struct("entry", "pos", "key")).alias("lines")), "wanted")
    # A hash that NULL has as well, and that no type of id lacks.
    near = source.withColumn("t", membership(documents.select(F.xxhash64("doc").alias("key")))).filter(maybe_in(F.xxhash64("doc"), "t")).select("doc", "text")
    near = near.join(documents, near["doc"].eqNullSafe(documents["doc"])).select(near["doc"], "text", "lines")
    parts = _let(F.split("text", "\n"), lambda part: F.transform("lines", lambda x: F.struct(x["entry"], x["key"], F.get(part, x["pos"]).alias("line"))))
    near = near.select(F.filter(parts, lambda x: x["line"].isNotNull()).alias("parts")).withColumn("t", levels)
    found = near.select(F.explode(F.transform("parts", lambda x: F.struct(x["entry"], x["key"], ranked_words(x["line"], F.col("t")).alias("words")))).alias("x"))
    found = found.select("x.entry", "x.key", "x.words")
    # A row that repeats an id with another text has other words at that position.
    found = found.filter(F.xxhash64("words") == F.col("key")).select("entry", "words").dropDuplicates(["entry"])
    found = stored(found.select("entry", "words", F.size("words").alias("n"), _wide("words").alias("odd")), "sets")
    # Most pairs that are not similar go by WIDE parity bits, before the sets are sent.
    for side in ("later", "earlier"):
        known = found.select(F.col("entry").alias(side), F.col("n").alias(f"{side}_n"), F.col("odd").alias(f"{side}_odd"))
        pairs = pairs.join(known, side)
    both, t = F.col("later_n") + F.col("earlier_n"), round(threshold * 1000)
    differ = sum((F.bit_count(F.get("later_odd", F.lit(i)).bitwiseXOR(F.get("earlier_odd", F.lit(i)))) for i in range(WIDE // 64)), F.lit(0))
    pairs = stored(pairs.filter(differ * (1000 + t) <= both * (1000 - t)).select("later", "earlier"), "near")
    joined = pairs.join(found.select(F.col("entry").alias("later"), F.col("words").alias("a")), "later")
    joined = joined.join(found.select(F.col("entry").alias("earlier"), F.col("words").alias("b")), "earlier")
    shared = F.size(F.array_intersect("a", "b"))
    union = F.size("a") + F.size("b") - shared
    similar = stored(joined.filter(shared * 1000 >= union * round(threshold * 1000)).select("later").distinct(), "similar")
    dropped(asked, pairs, documents, found)
    return similar


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """``docs`` with ``text`` without its removed lines."""
    gone = removed_lines(docs, doc_id, text, threshold)
    doc, mark, places, t = (unused(f"_{c}", docs.columns) for c in ("doc", "hash", "gone", "t"))
    gone = stored(gone.groupBy(F.col("doc").alias(doc), F.col("hash").alias(mark)).agg(F.collect_set("pos").alias(places)), "removed")
    touched = docs.withColumn(t, membership(gone.select(F.col(mark).alias("key"))))
    hit = F.coalesce(maybe_in(F.xxhash64(text), t), F.lit(False))
    alike = touched.filter(~hit).drop(t)
    changed = touched.filter(hit).drop(t)
    changed = changed.join(gone, changed[doc_id].eqNullSafe(gone[doc]) & (F.xxhash64(changed[text]) == gone[mark]), "left")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(places, i)), "\n")
    changed = changed.withColumn(text, F.when(F.col(places).isNull(), F.col(text)).otherwise(left))
    return alike.unionByName(changed.select(*docs.columns))
