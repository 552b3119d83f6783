"""SpotSigs: fingerprints from chains of content words that follow common-word anchors.

Each common word (anchor) followed by content words gives a signature: the anchor and its next two content words, among the
six words after it. A text's fingerprint is its set of signatures. A text without any anchor takes every word as one, so
that it has a fingerprint as well. Likeness is the Jaccard similarity of two sets; near pairs are found among partitions by set
length, since a similarity of s needs lengths within a factor of s, and the rarest signatures of each set (prefix) must meet.

Nulls: a null text counts as empty; an empty text has an empty set, alike only to another empty one; a null id comes before all others. Equal texts have equal fingerprints. Very long
texts are read whole. Repeated rows are kept; rows of one id are ordered by their text. An empty table gives an empty result. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, cut, let, longs, text_of
from .components import components

#: Common words of the four languages.
COMMON = (
    "the a an of to and in is that it was for on are as with be at by this have from or not but he she they which you his her their has had were been will would there what all can if no one so "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine einen als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie über "
    "le la les de des du et un une à est en que qui dans pour pas au sur ne se ce il elle sont par plus avec son sa ses aux mais comme ou nous vous ils "
    "el los las del y que se por con para su al lo como más pero sus este esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos"
)
ANCHORS = tuple(sorted(set(COMMON.split())))
CHAIN, REACH = 2, 6


def _chains(w: Column) -> Column:
    """Hashes of (anchor, chain) for each anchor that content words follow; where there is no anchor, for each word."""
    common = lambda x: x.isin(*ANCHORS)

    def chain(i: Column) -> Column:
        after = F.filter(F.slice(w, i + 2, REACH), lambda x: ~common(x))
        return let(after, lambda c: F.when(F.size(c) > 0, F.xxhash64(F.get(w, i), F.get(c, F.lit(0)), F.coalesce(F.get(c, F.lit(1)), F.lit("")))))

    def plain(i: Column) -> Column:
        return F.xxhash64(F.get(w, i), F.coalesce(F.get(w, i + 1), F.lit("")), F.coalesce(F.get(w, i + 2), F.lit("")))

    at = F.sequence(F.lit(0), F.size(w) - 1)
    spots = F.filter(F.transform(at, lambda i: F.when(common(F.get(w, i)), chain(i))), lambda x: x.isNotNull())
    return F.when(F.size(w) == 0, F.expr("cast(array() as array<bigint>)")).otherwise(let(spots, lambda s: F.when(F.size(s) > 0, s).otherwise(F.transform(at, plain))))


def signatures(text: Column) -> Column:
    """The sorted set of a text's signatures, array<bigint>. Words are compared in lower case, without marks at their ends."""
    # A mark alone stays a word, so that texts of marks have signatures too.
    words = F.filter(F.split(F.lower(text), BLANKS + "+"), lambda x: x != "")
    bare = F.transform(words, lambda x: let(F.trim(x, F.lit(".,;:!?\"'()[]|*#$%&")), lambda b: F.when(b == "", x).otherwise(b)))
    return let(bare, lambda w: F.sort_array(F.array_distinct(_chains(w))))


def fingerprint(sigs: Column) -> Column:
    """A short name of the set: its length and a digest of its members."""
    return F.concat(F.size(sigs).cast("string"), F.lit(":"), F.sha2(F.concat_ws(",", F.transform(sigs, lambda x: F.hex(x))).cast("binary"), 256))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity; where nothing is shared the union is not built; 1 for two empty sets."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(let(shared, lambda n: n / (F.size(a) + F.size(b) - n)))


def edited(text: Column, following: Column) -> Column:
    """The last quarter of the code points replaced by the first as many of the following text."""
    n = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - n), F.substring(following, F.lit(1), n))


def _following(blocks: DataFrame) -> DataFrame:
    """block, follow: the next block that has rows, the first after the last. Within a thousand blocks by a window, across them by a window over one row for each thousand."""
    many = blocks.select("block", F.floor(F.col("block") / 1000).alias("span"))
    over = Window.orderBy("span")
    spans = many.groupBy("span").agg(F.min("block").alias("low")).select("span", F.coalesce(F.lead("low").over(over), F.first("low").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("then"))
    return many.withColumn("follow", F.lead("block").over(Window.partitionBy("span").orderBy("block"))).join(spans, "span").select("block", F.coalesce("follow", "then").alias("follow"))


def _blocked(rows: DataFrame, block: int, most: int = 512) -> Column:
    """The number of a row's block: about `block` rows of neighbouring ids, ascending for ids of any spread. Quantiles of the ids give `most` ranges at most, each is divided evenly by id; null ids come first."""
    n, cuts = rows.agg(F.count("*"), F.percentile_approx("doc_id", [i / most for i in range(most + 1)], 20 * most)).first()
    ranges = min(most, max(1, n // block))
    points = sorted({cuts[i * most // ranges] for i in range(ranges + 1)}) if cuts else [0]
    inside, i, starts = max(1, n // (ranges * block)), F.col("doc_id"), longs(points)
    steps = longs(1 << b for b in reversed(range(len(points).bit_length())))
    found = F.aggregate(steps, F.lit(0).cast("long"), lambda at, width: F.when(F.get(starts, (at + width).cast("int")) <= i, at + width).otherwise(at))

    def number(k: Column) -> Column:
        low, high = (F.get(longs(x), k.cast("int")).cast("double") for x in (points, [*points[1:], points[-1]]))
        part = F.floor((i.cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * inside)
        return k * inside + F.least(F.lit(inside - 1), F.greatest(F.lit(0), part))

    return F.when(i.isNull(), F.lit(-1)).otherwise(let(found, number)).cast("long")


def _compared(pairs: DataFrame, near_next: Column) -> list[Column]:
    return [
        F.col("doc_id"), F.length("text").cast("long").alias("n_chars"), F.col("e.sha").alias("edited_sha256"), fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("e.sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("e.sigs")).alias("near_edited"), near_next.alias("near_next"), F.size("sigs").cast("long").alias("n_signatures"),
    ]


def compare_edits(docs: DataFrame, block: int = 256) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures: each text against itself edited and against the text of the next id (after the last: the first).

    Ids are dealt in blocks of neighbouring ids, so that texts are shuffled once and no task needs them all; the last row of a
    block meets the first of the next block with rows afterwards. Rows of one id are ordered by their text.
    """
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    own = own.withColumn("block", _blocked(own, block))
    order = Window.partitionBy("block").orderBy(F.asc_nulls_first("doc_id"), "text")
    edit = lambda e: F.struct(F.sha2(e.cast("binary"), 256).alias("sha"), signatures(e).alias("sigs"))
    lined = own.withColumns({"next": F.lead("text").over(order), "nth": F.row_number().over(order)})
    signed = lined.select("doc_id", "text", "block", "next", "nth", signatures(F.col("text")).alias("sigs"), F.when(F.col("next").isNotNull(), let(edited(F.col("text"), F.col("next")), edit)).alias("e"))
    signed = signed.withColumn("next_sigs", F.lead("sigs").over(order))
    edge = (F.col("nth") == 1) | F.col("next").isNull()
    inner = cut(signed.select(*_compared(signed, likeness(F.col("sigs"), F.col("next_sigs"))), "block", (F.col("nth") == 1).alias("head"), F.col("next").isNull().alias("last"), F.when(edge, F.col("text")).alias("text")), "spots")
    heads = inner.where("head").select(F.col("block").alias("follow"), F.col("text").alias("next"))
    ends = inner.where("last").select("doc_id", "text", "block")
    ends = ends.join(_following(inner.where("head").select("block")), "block").join(heads, "follow")
    ends = ends.select("doc_id", "text", signatures(F.col("text")).alias("sigs"), let(edited(F.col("text"), F.col("next")), edit).alias("e"), signatures(F.col("next")).alias("next_sigs"))
    done = inner.where(~F.col("last")).drop("block", "head", "last", "text")
    return done.unionByName(ends.select(*_compared(ends, likeness(F.col("sigs"), F.col("next_sigs")))))


def _links(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets are alike enough."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("rep").alias(side), F.col("sigs").alias(f"sigs_{side}")), side)
    return pairs.where(likeness(F.col("sigs_a"), F.col("sigs_b")) >= least - 1e-12).select("a", "b")


def near_classes(docs: DataFrame, least: float = 0.8, block: int = 512) -> DataFrame:
    """doc_id, class_id (smallest id among the documents that links join to it), n_sets (different signature sets of the class) for each document.

    Equal sets are one from the start. A pair must share one of the rarest signatures of both sets (prefix filter); a set is posted under these in its length partition and in the
    next, so that it meets all sets of lengths within the factor. Within a posting each set is first compared with the posting's first set, so a group of near copies costs one
    comparison a set; then, where a posting's sets still belong to several classes, those of different classes are compared, a large posting in blocks. Sets without a signature are alike only to each other.
    """
    import math

    signed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), signatures(text_of(docs)).alias("sigs")).withColumn("name", fingerprint(F.col("sigs")))
    signed = cut(signed, "spot-sets")
    every = cut(signed.groupBy("name").agg(F.min("doc_id").alias("doc"), F.first("sigs").alias("sigs")).withColumn("rep", F.monotonically_increasing_id()), "spot-classes")
    sets = every.select("rep", "sigs", F.size("sigs").alias("n"))
    each = sets.select("rep", "n", F.explode("sigs").alias("sig"))
    # Signatures of one set alone can't meet; they come first in the order and use up the prefix.
    ranked = each.join(each.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1"), "sig")
    whole = Window.partitionBy("rep")
    ranked = ranked.withColumns({"nth": F.row_number().over(whole.orderBy("df", "sig")), "met": F.count("*").over(whole)})
    prefix = ranked.where(F.col("nth") + F.col("n") - F.col("met") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    part = F.floor(F.log(F.col("n").cast("double")) / -math.log(least) + 1e-9).cast("int")
    posted = cut(prefix.select("rep", "n", "sig", F.explode(F.array(part, part + 1)).alias("part")), "spot-postings")
    key = ["sig", "part"]
    level = lambda x, y: (F.col(x) >= F.col(y) * least - 1e-9) & (F.col(y) >= F.col(x) * least - 1e-9)
    hubs = posted.groupBy(key).agg(F.min(F.struct("rep", "n")).alias("hub"), F.count("*").alias("k")).where("k > 1").select(*key, F.col("hub.rep").alias("a"), F.col("hub.n").alias("hub_n"))
    stars = posted.join(hubs, key).where((F.col("rep") != F.col("a")) & level("n", "hub_n")).select("a", F.col("rep").alias("b")).distinct()
    links = cut(_links(stars, sets, least), "spot-links")
    labels = components(links)
    classed = posted.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("class", F.coalesce("label", "rep")).drop("label")
    mixed = classed.groupBy(key).agg(F.count("*").alias("k"), F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select(*key, F.ceil(F.col("k") / block).alias("blocks"))
    rows = classed.join(mixed, key)
    own, all_blocks = F.pmod(F.xxhash64("rep"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = rows.select(*key, F.col("rep").alias("a"), F.col("n").alias("na"), F.col("class").alias("ca"), own.alias("i"), all_blocks.alias("j"))
    right = rows.select(*key, F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("class").alias("cb"), all_blocks.alias("i"), own.alias("j"))
    cross = left.join(right, [*key, "i", "j"]).where((F.col("ca") < F.col("cb")) & level("na", "nb")).select("a", "b").distinct()
    labels = components(links.unionByName(cut(_links(cross, sets, least), "spot-links")))
    named = every.select("name", "doc", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    named = named.join(named.groupBy("label").agg(F.min("doc").alias("class_id"), F.count("*").alias("n_sets")), "label").select("name", "class_id", "n_sets")
    return signed.select("doc_id", "name").join(named, "name").select("doc_id", "class_id", "n_sets")
