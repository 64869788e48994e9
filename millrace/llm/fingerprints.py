"""Document fingerprints by SpotSigs (built-in functions only).

After Theobald, Siddharth and Paepcke (2008). Common words are anchors; each spot where content
follows an anchor gives a signature, the chain of the next content words. Navigation, lists
and other matter without common words hardly counts so. A document's fingerprint is the set of its
signatures; likeness is the Jaccard similarity of two sets.

To find near duplicates, sets are partitioned by length so that only neighbouring partitions can
reach the threshold, and compared where their rarest signatures meet.
"""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_search, stage

#: Anchors: common words of English, German, French and Spanish.
ANCHORS = tuple(
    "the a an of to and in that it is was for on are as with be by at or from this have not which but they "
    "der die das den dem des ein eine und zu von mit im ist nicht auf auch sich für als bei "
    "le la les de du des un une et à en que qui dans pour est sur au avec pas "
    "el los las del y por con una su para se lo al como más".split()
)
#: Content words of a chain.
CHAIN = 3
#: Most splitters of the order of ids that the driver holds, and rows between two of them.
MOST_SPLITTERS, ROWS_BETWEEN = 200_000, 500
_LEAST = -(2**63)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; an empty string may stand at either end."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def with_signatures(df: DataFrame, text: str, out: str, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """``df`` with ``out``, the sorted distinct signatures (8 hexadecimal digits each) of column ``text``.

    A signature is the hash of up to ``chain`` content words, from one that follows an anchor
    directly; anchors in between are skipped. A text without such a spot uses every content word as one,
    and a text without content words has no signature.
    """
    w, c = f"{out}_words", f"{out}_content"
    names = list(dict.fromkeys(anchors))
    content = F.filter(
        F.transform(F.col(w), lambda v, i: F.struct(v.alias("v"), ((i > 0) & F.get(F.col(w), i - 1).isin(names)).alias("spot"))),
        lambda s: (s["v"] != "") & ~s["v"].isin(names),
    )
    spots = F.exists(F.col(c), lambda s: s["spot"])
    follow = lambda i: [F.get(F.col(c), i + k)["v"] for k in range(1, chain)]
    found = F.transform(
        F.col(c), lambda s, i: F.when(s["spot"] | ~F.col(f"{out}_spots"), F.substring(F.md5(F.concat_ws(" ", s["v"], *follow(i)).cast("binary")), 1, 8))
    )
    return (
        df.withColumn(w, words(F.col(text)))
        .withColumn(c, content)
        .withColumn(f"{out}_spots", F.coalesce(spots, F.lit(False)))
        .withColumn(out, F.array_sort(F.array_distinct(F.array_compact(found))))
        .drop(w, c, f"{out}_spots")
    )


def fingerprint(signatures: Column) -> Column:
    """The set as one string."""
    return F.array_join(signatures, "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets; two empty sets are alike."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total == 0, F.lit(1.0)).otherwise(both / total)


def _backwards(text: Column, size: int = 24) -> Column:
    """A string that falls as the first bytes of ``text`` rise: their digits complemented, and an end after them that is larger than a digit."""
    start = F.substring(text.cast("binary"), 1, size)
    return F.concat(F.translate(F.hex(start), "0123456789ABCDEF", "FEDCBA9876543210"), F.when(F.length(start) < size, "G").otherwise(""))


#: In a splitter, instead of a text: behind all texts of its id.
_LAST = "H"


def _splitters(docs: DataFrame, key: Column, tie: Column) -> tuple[Column, int]:
    """Ascending splitters ``(k, t)``, each the place of some row, and the last behind all rows.

    An id that the sample meets once is a splitter as a whole; one that it meets with several texts has one for each of them.
    """
    n, top = docs.agg(F.count("*"), F.max(key)).first()
    if not n:
        return F.array(F.struct(F.lit(0).cast("long").alias("k"), F.lit(_LAST).alias("t"))), 1
    share = min(1.0, min(MOST_SPLITTERS, n / ROWS_BETWEEN) / n)
    picked = docs.select(key.alias("k"), tie.alias("t")).filter(F.pmod(F.xxhash64("k", "t"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    found = picked.distinct().collect()
    often = Counter(r["k"] for r in found)
    bounds = sorted({(r["k"], r["t"] if often[r["k"]] > 1 else _LAST) for r in found} | {(top, _LAST)})
    return F.from_json(F.lit(json.dumps([{"k": k, "t": t} for k, t in bounds])), "array<struct<k: bigint, t: string>>"), len(bounds)


def with_next(docs: DataFrame) -> DataFrame:
    """Every row's ``doc_id, text, n_chars, sigs`` with the next document's text and signatures.

    The order is by descending doc_id, a null one last, ties by text; after the last comes the first.
    Rows are dealt to ranges between sampled splitters, which tell the texts of an id apart where it has many, so an id
    that is null or repeated fills no task; only rows that agree in the id and the first 24 bytes of the text stay together. Every splitter is some row's place
    and the largest of its range, so that row is also sent to the end of the range above, and
    each range finds its successors by itself: whole texts are shuffled once.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))
    text = F.coalesce("text", F.lit(""))
    bounds, n = _splitters(docs, key, _backwards(text))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), key.alias("key"))
    rows = with_signatures(rows, "text", "sigs").withColumn("tie", _backwards(F.col("text")))
    # number of splitters below the row: ranges are (splitter, splitter]
    own_place = F.struct(F.col("key").alias("k"), F.col("tie").alias("t"))
    rows = rows.withColumn("range", binary_search(bounds, own_place, n, strict=True) if n > 1 else F.lit(0)).withColumn("end", F.get(bounds, F.col("range")))
    place = lambda r, extra: F.struct(r.cast("int").alias("range"), F.lit(extra).alias("extra"))
    own, above = place(F.col("range"), 0), place((F.col("range") + 1) % n, 1)
    last = (F.col("key") == F.col("end.k")) & ((F.col("end.t") == _LAST) | (F.col("tie") == F.col("end.t")))
    rows = rows.withColumn("to", F.explode(F.when(last, F.array(own, above)).otherwise(F.array(own))))
    rows = rows.select("doc_id", "text", "sigs", "key", "to.range", "to.extra")
    order = Window.partitionBy("range").orderBy("extra", F.col("key").desc(), "text")
    found = rows.select("doc_id", "text", "sigs", "extra", F.lead("text").over(order).alias("next_text"), F.lead("sigs").over(order).alias("next_sigs"))
    return found.filter("extra = 0").select("doc_id", "text", F.char_length("text").alias("n_chars"), "sigs", "next_text", "next_sigs")


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. In
    the edited text the last third (rounded down) gives way to as much of the next document's beginning.

    Null text is empty. Rows that repeat a doc_id follow each other in the order of their
    texts. With one document, the next is itself; an empty table gives an empty result. Whole texts are edited and signed,
    however long; extra columns are ignored.
    """
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - third), F.substring(F.col("next_text"), F.lit(1), third))
    rows = with_next(docs).withColumn("edited", edited)
    rows = with_signatures(rows, "edited", "edited_sigs")
    return rows.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def near_pairs(docs: DataFrame, threshold: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Pairs of different signature sets at least ``threshold`` alike, and which document has which set.

    Returns ``pairs`` (``a, b, likeness``; a < b, each the smallest doc_id with that set) and
    ``members`` (``doc_id, rep``). Empty sets have no pairs. Sets are put in length classes that grow by
    1/threshold, so partners are in the same class or the next; a pair is a candidate if the two
    share one of the rarest n - ceil(threshold * n) + 1 signatures of each, which no qualifying
    pair can miss. Candidates of too different length are pruned before sets are compared.
    """
    sets = stage(
        with_signatures(docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text"), "text", "sigs").select("doc_id", "sigs").withColumn("digest", F.sha2(F.array_join("sigs", "").cast("binary"), 256)), "spot-sets"
    )
    reps = sets.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    members = sets.join(reps, "digest").select("doc_id", "rep")
    own = stage(sets.join(reps, "digest").filter("doc_id = rep and size(sigs) > 0").dropDuplicates(["rep"]).select("rep", "sigs", F.size("sigs").alias("n")), "spot-own")
    spread = own.select("rep", "n", F.explode("sigs").alias("sig"))
    rank = Window.partitionBy("rep").orderBy("df", "sig")
    kept = F.col("n") - F.ceil(F.col("n") * threshold) + 1
    prefix = spread.join(spread.groupBy("sig").agg(F.count("*").alias("df")), "sig").withColumn("k", F.row_number().over(rank)).filter(F.col("k") <= kept)
    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold)).cast("int")
    prefix = stage(prefix.select("rep", "n", "sig", size_class.alias("class")), "spot-prefix")
    left = prefix.select(F.col("rep").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("class"))
    right = prefix.select(F.col("rep").alias("b"), F.col("n").alias("nb"), "sig", "class")
    met = left.join(right, ["sig", "class"]).filter((F.col("a") != F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold))
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda x: own.select(F.col("rep").alias(x), F.col("sigs").alias(f"s{x}"))
    pairs = met.join(side("a"), "a").join(side("b"), "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).filter(F.col("likeness") >= threshold)
    return pairs, members
