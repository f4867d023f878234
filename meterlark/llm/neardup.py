"""Problem 5: pairs of texts whose word sets are nearly the same, by a signature-coordinate inverted join.

Texts of the same word set are one class; classes are joined, then copies are put back.

A class's signature has two groups of coordinates, and classes are posted under coordinate-value
pairs. Every rare word (in at most RARE classes) is a coordinate of its own. The other, common
words are hashed onto k coordinates; the value of such a coordinate is the hash of all words that
fall on it.

* Rare words. All are posted, by lists no longer than RARE, and the collisions of a pair are counted:
  their number is that of the rare words it shares. A pair is retained if the common words that the
  smaller of the two sets has could make up what is missing to the threshold.
* Pairs without any rare word in common. All rare words of both are among their differences, so that
  what is left of the difference that the threshold allows is the budget of their common words, the sum
  of a slack that each class has; it is negative for most classes, which need no more postings. Else slacks are
  rounded down to steps that grow with the size of sets, and the sum of both steps is the pair's level. On a level
  whose budgets are below m, words are hashed onto 5/4 m coordinates; fewer than m can differ, so that one of
  the m rarest of each class is shared: only these are posted, under the level and the leading class's step, so that
  classes meet only where their budget is of that level. Of a pair, one class has a slack of at
  least 0 and leads; the others post only where a leading one has posted, as far as a bitmap can tell. A collision
  counts if the parities of the common words on 256 bits, which go along, differ in no more bits than the budget.

Retained pairs are verified on the classes' word sets. No link is lost: these are bounds, not chances.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from meterlark.session import durable

#: Longest posting list of a single word.
RARE = 32
#: Common words that tasks may hold as a table (16 bytes each); where there are more, they are joined by a shuffle.
HELD = 1_000_000
#: Cells of coordinates that are computed together.
CELLS = 1 << 20
#: Largest bitmap of the leading classes' postings, in bits.
BITS = 1 << 29
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _parted(heads: DataFrame) -> DataFrame:
    """(cid, size, rare, common, common_df) of classes (cid, words): their words in at most RARE classes, and the others with the number of classes they are in.

    A table of the common words goes to the tasks where it has at most HELD rows, which is counted
    first; words stand there under their place in it, which packs better. Else they are joined.
    """
    posted = heads.select("cid", F.explode("words").alias("w"))
    common = durable(posted.groupBy("w").agg(F.count("*").alias("df")).filter(F.col("df") > RARE))
    if common.count() > HELD:
        found = posted.join(common, "w", "left").groupBy("cid").agg(
            F.count("*").cast("int").alias("size"),
            F.collect_list(F.when(F.col("df").isNull(), F.col("w"))).alias("rare"),
            F.array_sort(F.collect_list(F.when(F.col("df").isNotNull(), F.struct("w", "df")))).alias("f"),
        )
        return found.select("cid", "size", "rare", F.col("f.w").alias("common"), F.col("f.df").alias("common_df"))
    held = common.orderBy("df", "w").toPandas()
    order = np.argsort(held["w"].to_numpy())
    table = heads.sparkSession.sparkContext.broadcast((held["w"].to_numpy()[order], order, held["df"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, place, dfs = table.value
        for batch in batches:
            lists = batch.column(1)
            flat, count = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(count)), count)
            at = np.minimum(np.searchsorted(words, flat), max(len(words) - 1, 0))
            hit = words[at] == flat if len(words) else np.zeros(len(flat), bool)
            number = np.sort(owner[hit] * (len(words) + 1) + place[at[hit]]) % (len(words) + 1)
            offsets = lambda o: pa.array(np.concatenate([[0], np.cumsum(np.bincount(o, minlength=len(count)))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count.astype(np.int32)), pa.ListArray.from_arrays(offsets(owner[~hit]), pa.array(flat[~hit])), *(pa.ListArray.from_arrays(offsets(owner[hit]), pa.array(x.astype(np.int64))) for x in (number, dfs[number]))],
                ["cid", "size", "rare", "common", "common_df"],
            )

    return heads.select("cid", "words").mapInArrow(run, "cid long, size int, rare array<long>, common array<long>, common_df array<long>")


def _band(size: np.ndarray, similarity: float) -> np.ndarray:
    """Sizes whose ratio is at least the similarity are in the same band or in neighbouring ones."""
    return np.floor(np.log(np.maximum(size, 1)) / -np.log(similarity) + 1e-9).astype(np.int64)


def _scale(size: np.ndarray) -> np.ndarray:
    """Logarithm of a size to the base of 4, rounded down."""
    return np.floor(np.log(np.maximum(size, 1)) / np.log(4) + 1e-9).astype(np.int64)


def _bitmap(postings: DataFrame) -> Broadcast:
    """A bitmap with two bits for every posting's value."""
    bits = min(max(1 << 15, 1 << (16 * postings.count()).bit_length()), BITS)
    at = F.explode(F.array(F.col("value").bitwiseAND(bits - 1), F.shiftrightunsigned("value", 32).bitwiseAND(bits - 1)))
    parts = postings.select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND((1 << 15) - 1)).alias("bits"))
    out = np.zeros((bits >> 15, 1 << 12), np.uint8)
    for r in parts.toLocalIterator():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return postings.sparkSession.sparkContext.broadcast(out.ravel())


def _in_bitmap(bitmap: np.ndarray, value: np.ndarray) -> np.ndarray:
    found = np.ones(len(value), bool)
    for at in (value, value >> _U(32)):
        at = at & _U(len(bitmap) * 8 - 1)
        found &= (bitmap[at >> _U(3)] >> (at & _U(7)).astype(np.uint8) & 1).astype(bool)
    return found


def _postings(classes: DataFrame, similarity: float, tops: dict[int, float], total: int, wanted: Broadcast | None = None) -> DataFrame:
    """(value, cid, size, slack, b0 to b3): postings of the common words of classes that may have a partner without shared rare words.

    ``tops``: the largest slack of the classes of a band. ``slack``: differing words a class allows, less its rare
    words; the budget of a pair is the sum of both. ``total``: number of all classes. b0 to b3: parities.
    ``wanted``: bitmap of the postings of the classes that lead, for those that follow; None for those that lead.
    The values of a pair's postings hold its scale (of the larger set), its level and the leading class's step.
    """
    part = (1 - similarity) / (1 + similarity)
    near = lambda b: max(tops.get(x, -np.inf) for x in range(b - 2, b + 3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cid, size, slack = (batch.column(i).to_numpy() for i in range(3))
            lists = batch.column(3)
            flat, dfs = lists.flatten().to_numpy().view(_U), batch.column(4).flatten().to_numpy()
            bounds = lists.offsets.to_numpy() - lists.offsets.to_numpy()[:1]
            count = np.diff(bounds)
            owner = np.repeat(np.arange(len(cid)), count)
            hashed, rarity = _mix(flat + _U(1)), np.log(dfs / total) - 1e-9  # the rarer, the lower
            bits = np.zeros((len(cid), 4), _U)
            np.bitwise_xor.at(bits, (owner, (hashed & _U(3)).astype(np.int64)), _U(1) << (hashed >> _U(2) & _U(63)))
            # the largest slack of any partner: of all classes near in size, and by the partner's size
            bands, which = np.unique(_band(size, similarity), return_inverse=True)
            most = np.minimum(np.array([near(b) for b in bands.tolist()])[which], part * size / similarity)
            lowest, highest = _scale(size), _scale(size / similarity)
            for scale in range(lowest.min(), highest.max() + 1):
                unit = max(4, 4**scale // 16)
                step = np.floor((slack + 1e-6) / unit).astype(np.int64)
                # levels by the steps of partners: those of a leading class's are no larger, and it has at least step 0
                if wanted is None:
                    first, last = np.full(len(cid), -1), 2 * step
                else:
                    first, last = np.maximum(-1, np.maximum(step, 2 * step)), step + np.floor((most + 1e-6) / unit).astype(np.int64)
                last[(lowest > scale) | (highest < scale)] = -2
                for level in range(-1, last.max() + 1):
                    on = np.flatnonzero((first <= level) & (level <= last))
                    m = unit * (level + 2)
                    k = m + -(-m // 4)
                    for rows in np.array_split(on, max(1, min(len(on), -(-len(on) * k // CELLS)))):
                        if not len(rows):
                            continue
                        n = count[rows]
                        keep = np.arange(n.sum()) + np.repeat(bounds[rows] - (np.cumsum(n) - n), n)
                        h = hashed[keep]
                        slot = np.repeat(np.arange(len(rows)) * k, n) + ((h >> _U(8)) % _U(k)).astype(np.int64)
                        value = np.zeros(len(rows) * k, _U)
                        np.add.at(value, slot, _mix(h + _U(1)))
                        score = np.bincount(slot, rarity[keep], len(rows) * k)  # an empty coordinate is the commonest
                        # one order for all classes: by the value's estimated frequency, then by the value and coordinate themselves
                        value = _mix(value.reshape(-1, k) + np.arange(k).astype(_U) * _U(0x9E3779B97F4A7C15))
                        order = np.lexsort((value, np.round(score.reshape(-1, k), 6)), axis=1)[:, :m]
                        r, value = np.repeat(rows, m), np.take_along_axis(value, order, 1).ravel()
                        leads = step[r] if wanted is None else level - step[r]
                        value = _mix(value + _mix(((scale << 48) + ((level + 2) << 24) + leads).astype(_U)))
                        if wanted is not None:
                            shared = _in_bitmap(wanted.value, value)
                            r, value = r[shared], value[shared]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(value.view(np.int64)), pa.array(cid[r]), pa.array(size[r]), pa.array(slack[r]), *(pa.array(bits[r, b].view(np.int64)) for b in range(4))],
                            ["value", "cid", "size", "slack", "b0", "b1", "b2", "b3"],
                        )

    return classes.select("cid", "size", "slack", "common", "common_df").mapInArrow(run, "value long, cid long, size int, slack double, b0 long, b1 long, b2 long, b3 long")


def similar(df: DataFrame, key: str, text: str, similarity: float = 0.7, least_words: int = 8) -> DataFrame:
    """(key_a, key_b): pairs of rows, the smaller key first, whose Jaccard similarity of distinct words is at least ``similarity``.

    Words are the longest runs of ASCII letters and digits, in lower case; texts of fewer than
    ``least_words`` distinct words, null and blank ones among them, form no pairs. Rows with equal
    word sets are similar; rows of one key form no pair with each other. Keys must be whole
    numbers. Very long texts are taken whole; an empty table gives an empty table; other columns
    don't matter. Words are compared by 64-bit hashes.
    """
    members, links = classes_and_links(df, key, text, similarity, least_words)
    a, b = (members.select(F.col("cid").alias(f"cid_{x}"), F.col("k").alias(x)) for x in "ab")
    copies = a.join(b, F.col("cid_a") == F.col("cid_b")).filter("a < b").select("a", "b")
    across = links.join(a, "cid_a").join(b, "cid_b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return copies.unionByName(across).distinct().select(F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b"))


def classes_and_links(df: DataFrame, key: str, text: str, similarity: float = 0.7, least_words: int = 8) -> tuple[DataFrame, DataFrame]:
    """Membership (k, cid) of rows in classes of equal word sets, and links (cid_a, cid_b) between classes, cid_a < cid_b. Class ids are hashes of the sets."""
    # lower case is taken word by word: of a whole text it would make ASCII letters out of others
    words = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("t", F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: F.xxhash64(F.lower(w)))))
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).filter(F.col("k").isNotNull() & F.col("t").isNotNull())
    sets = rows.select("k", words.alias("words")).filter(F.size("words") >= least_words)
    # a class id is a hash of two 64-bit hashes of its words
    own = F.xxhash64(F.xxhash64("words"), F.xxhash64(F.lit(1), F.size("words"), F.reverse("words")))
    members = durable(sets.select("k", "words", own.alias("cid"), F.monotonically_increasing_id().alias("row")))
    first = members.groupBy("cid").agg(F.min("row").alias("row"))
    heads = durable(members.join(first, ["cid", "row"], "left_semi").select("cid", "words"))
    return durable(members.select("k", "cid").distinct()), durable(_links(heads, similarity))


def _links(heads: DataFrame, similarity: float) -> DataFrame:
    """(cid_a, cid_b) of classes (cid, words) at or above the similarity."""
    part = (1 - similarity) / (1 + similarity)
    classes = durable(_parted(heads).withColumn("n", F.size("common")).withColumn("slack", F.lit(part) * F.col("size") - (F.col("size") - F.col("n"))))
    fits = F.least("size_a", "size_b") >= F.lit(similarity) * F.greatest("size_a", "size_b") - 1e-9
    needed = F.lit(similarity / (1 + similarity)) * (F.col("size_a") + F.col("size_b")) - 1e-9

    rare = classes.select("cid", "size", "n", F.explode("rare").alias("w"))
    a, b = (rare.select("w", *(F.col(c).alias(f"{c}_{x}") for c in ("cid", "size", "n"))) for x in "ab")
    counted = a.join(b, "w").filter(F.col("cid_a") < F.col("cid_b")).filter(fits).groupBy("cid_a", "cid_b").agg(F.count("*").alias("collisions"), *(F.any_value(c).alias(c) for c in ("size_a", "size_b", "n_a", "n_b")))
    candidates = counted.filter(F.col("collisions") + F.least("n_a", "n_b") >= needed).select("cid_a", "cid_b")

    # the number of bands grows with the logarithm of the largest size
    of_band = F.floor(F.log("size") / F.lit(-float(np.log(similarity))) + 1e-9)
    tops = {r["band"]: r["top"] for r in classes.groupBy(of_band.alias("band")).agg(F.max("slack").alias("top")).collect()}
    top = max(tops.values(), default=-1.0)
    if top >= -1e-9:
        total = classes.count()
        leading = durable(_postings(classes.filter("slack >= -1e-9"), similarity, tops, total))
        following = _postings(classes.filter(F.col("slack") + top >= -1e-9), similarity, tops, total, _bitmap(leading))
        side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("cid", "size", "slack", "b0", "b1", "b2", "b3")]
        # of a pair, one class has a slack of at least 0: it leads; equals are led by the lower id
        a, b = leading.select("value", *side("a")), following.select("value", *side("b"))
        budget = F.col("slack_a") + F.col("slack_b") + 1e-9
        leads = (F.col("slack_a") > F.col("slack_b")) | ((F.col("slack_a") == F.col("slack_b")) & (F.col("cid_a") < F.col("cid_b")))
        differing: Column = sum((F.bit_count(F.col(f"b{i}_a").bitwiseXOR(F.col(f"b{i}_b"))) for i in range(1, 4)), F.bit_count(F.col("b0_a").bitwiseXOR(F.col("b0_b"))))
        by_level = a.join(b, "value").filter(leads & fits & (differing <= budget)).select(F.least("cid_a", "cid_b").alias("cid_a"), F.greatest("cid_a", "cid_b").alias("cid_b"))
        candidates = candidates.unionByName(by_level).distinct()

    x, y = (classes.select(F.col("cid").alias(f"cid_{x}"), F.col("size").alias(f"size_{x}"), F.col("rare").alias(f"rare_{x}"), F.col("common").alias(f"common_{x}")) for x in "ab")
    both = F.size(F.array_intersect("common_a", "common_b")) + F.size(F.array_intersect("rare_a", "rare_b"))
    return durable(candidates).join(x, "cid_a").join(y, "cid_b").filter(both >= needed).select("cid_a", "cid_b")


def classes(df: DataFrame, key: str, text: str, similarity: float = 0.7, least_words: int = 8) -> DataFrame:
    """(key, class, links): every row's class, named by its lowest key, and the number of other classes it is linked to.

    Rows that form no pairs, see ``similar``, are left out; with ``class_links`` this tells all
    pairs without writing out those among copies.
    """
    members, links = classes_and_links(df, key, text, similarity, least_words)
    ends = links.select(F.explode(F.array("cid_a", "cid_b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("links"))
    names = members.groupBy("cid").agg(F.min("k").alias("class")).join(ends, "cid", "left")
    return members.join(names, "cid").select(F.col("k").alias(key), "class", F.coalesce("links", F.lit(0)).alias("links"))


def class_links(df: DataFrame, key: str, text: str, similarity: float = 0.7, least_words: int = 8) -> DataFrame:
    """(class_a, class_b): linked classes by their lowest keys, the smaller first."""
    members, links = classes_and_links(df, key, text, similarity, least_words)
    a, b = (members.groupBy("cid").agg(F.min("k").alias(x)).withColumnRenamed("cid", f"cid_{x}") for x in "ab")
    return links.join(a, "cid_a").join(b, "cid_b").filter("a <> b").select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b")).distinct()


def groups(df: DataFrame, key: str, text: str, similarity: float = 0.7, least_words: int = 8) -> DataFrame:
    """(key, group): connected groups of similar rows, named by their lowest key; a row that forms no pair is a group by itself, those of too few words are left out."""
    members, links = classes_and_links(df, key, text, similarity, least_words)
    names = members.groupBy("cid").agg(F.min("k").alias("name"))
    joined = components(links).join(names, "cid")
    tops = joined.groupBy("root").agg(F.min("name").alias("top"))
    named = names.join(joined.select("cid", "root").join(tops, "root").select("cid", "top"), "cid", "left").select("cid", F.coalesce("top", "name").alias("group"))
    return members.join(named, "cid").groupBy(F.col("k").alias(key)).agg(F.min("group").alias("group"))


def components(links: DataFrame) -> DataFrame:
    """(cid, root): the connected component of each end of (cid_a, cid_b), by large and small stars.

    Each round hangs every node's larger neighbours to its smallest one, then every node's smaller
    neighbours; rounds grow with the logarithm of a component's size. A node with many neighbours is
    aggregated, never gathered.
    """
    edges = durable(links.select(F.greatest("cid_a", "cid_b").alias("u"), F.least("cid_a", "cid_b").alias("v")).filter("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        new = durable(small)
        if new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty():
            break
        edges = new
    return edges.select(F.col("u").alias("cid"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("cid"), F.col("v").alias("root"))).distinct()
