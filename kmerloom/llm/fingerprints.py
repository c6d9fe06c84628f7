"""Document fingerprints: threshold-scaled sketches, by DataFrame functions only.

Every five-word shingle whose hash lies below a fixed fraction of the hash space is retained. The rule looks at one hash
at a time, so sketches of any two texts can be merged (set union) and compared without bias, however unequal their
lengths. Unless that is turned off, a text's least hash is retained too, whatever it is, so that short texts keep one: the
least of a union is the least of the parts' least, so such sketches are merged like the others; above the limit it is no
sample of the text, and estimates of containment pass it over. Texts are dealt by doc_id once; what a document needs of the
next one, a quarter of its length and a sketch, is sent on from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kmerloom.llm.common import checkpointed

SHINGLE = 5
#: One shingle in so many is retained.
SCALE = 4
SEPARATORS = "[ \t-\r]+"


def words(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATORS), lambda w: w != "")


def sketch(words_column: str, shingle: int = SHINGLE, scale: int = SCALE, least: bool = True) -> Column:
    """The sorted distinct retained hashes (their upper 32 bits) of a column of words; with `least`, the least hash is always one.

    Fewer words than a shingle are one shingle; no words, an empty sketch.
    """
    limit = -(1 << 63) + (1 << 64) // scale
    below = f"h -> h < {limit}L" if scale > 1 else "h -> true"
    n = f"size({words_column})"
    each = ", ".join(f"get({words_column}, i + {j})" for j in range(shingle))  # beyond the end null, which a hash passes over
    hashes = f"transform(sequence(0, greatest({n} - {shingle}, 0)), i -> xxhash64({each}))"
    upper = "h -> cast(shiftright(h, 32) as int)"
    kept = f"transform(filter({hashes}, {below}), {upper})"
    if least:  # only if nothing lies below the limit all hashes are made again
        kept = f"element_at(transform(array({kept}), f -> case when size(f) > 0 then f else transform(array(array_min({hashes})), {upper}) end), 1)"
    return F.expr(f"case when {n} = 0 then cast(array() as array<int>) else sort_array(array_distinct({kept})) end")


def fingerprint(sketch_column: Column) -> Column:
    """A sketch as text: its hashes in hexadecimal, end to end."""
    return F.array_join(F.transform(sketch_column, lambda h: F.lower(F.lpad(F.hex(h.cast("long") + F.lit(1 << 31)), 8, "0"))), "")


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def likeness(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Estimated Jaccard similarity of two sketches; `empty` if neither retained anything."""
    both = common(a, b)
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).when(union == 0, F.lit(empty)).otherwise(F.lit(0.0))


def last_below(scale: int) -> int:
    """The upper 32 bits of the largest hash below the limit."""
    return -(1 << 31) + ((1 << 64) // scale - 1 >> 32)


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated share of a's shingles that b has; 0 if a retained none.

    Hashes below the limit are a fair sample of a's. Where a has only its least hash, above the limit, b may have it without
    retaining it: the estimate is 1 if it is b's least too, 0 if b's least is larger (or b has none), and else null, as nothing is known.
    """
    sample = F.filter(a, lambda h: h <= last_below(scale))
    least = F.array_min(a)
    alone = F.when(F.array_contains(b, least), F.lit(1.0)).when((F.size(b) == 0) | (F.array_min(b) > least), F.lit(0.0))
    return F.when(F.size(sample) > 0, common(sample, b) / F.size(sample)).when(F.size(a) > 0, alone).when(b.isNotNull(), F.lit(0.0))


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts together; of hashes above the limit only the least stays, and only if it is the least of all."""
    union = F.array_sort(F.array_union(a, b))
    return F.filter(union, lambda h, i: (h <= last_below(scale)) | (i == 0))


def next_ids(needs: DataFrame) -> DataFrame:
    """`needs` (distinct doc_id, need) with next_id: the next doc_id in ascending order, after the last one the first.

    Ids are dealt by ranges, as many as the session has shuffle partitions; each orders its own ids, and only each one's first id
    meets the others in one task.
    """
    needs = checkpointed(needs.repartitionByRange("doc_id").withColumn("block", F.spark_partition_id()))
    ordered = needs.withColumn("next_id", F.lead("doc_id").over(W.partitionBy("block").orderBy("doc_id")))
    firsts = needs.groupBy("block").agg(F.min("doc_id").alias("first_id"))
    everything = W.orderBy("block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    after = firsts.select("block", F.coalesce(F.lead("first_id").over(W.orderBy("block")), F.min("first_id").over(everything)).alias("block_next"))
    return ordered.join(F.broadcast(after), "block").select("doc_id", "need", F.coalesce("next_id", "block_next").alias("next_id"))


def compared(docs: DataFrame, shingle: int = SHINGLE, scale: int = SCALE, least: bool = True) -> DataFrame:
    """Fingerprint every whole text of `docs` (doc_id, text), and its edited text; one row per row.

    The edited text: the last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document's, in ascending order of doc_id, after the last the first. Returned: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next (estimated Jaccard similarities of the fingerprint to that of
    the edited text and of the next document), in_next (estimated containment in the next document, null where the sketches tell
    nothing of it, see containment()).

    With `least`, each text's least hash is always retained and two empty fingerprints, those of texts without a word, have a
    similarity of 1; without, a short text often has the empty fingerprint, and a similarity of 0 to any other.

    A null text counts as empty. Of rows that repeat a doc_id, the one with the least text start stands for it as a next
    document, and each gets the same next. A row without doc_id is no document's next and has none: its end is only cut.
    Other columns are ignored.
    """
    # Under names of their own both uses of the dealt texts have one plan, and Spark deals them once.
    every = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("body"))
    given = every.where("id is not null")
    cut = F.floor(F.length("body") / 4).cast("int")
    needs = given.groupBy(F.col("id").alias("doc_id")).agg(F.max(cut).alias("need"))
    asked = next_ids(needs).select(F.col("doc_id").alias("for_id"), "next_id", "need")
    heads = (
        given.join(asked, F.col("id") == F.col("next_id"))
        .select("for_id", F.substring("body", F.lit(1), F.col("need")).alias("head"), words(F.col("body")).alias("words"))
        .select("for_id", "head", sketch("words", shingle, scale, least).alias("next_sketch"))
        .groupBy("for_id")
        .agg(F.min(F.struct("head", "next_sketch")).alias("next"))
    )
    alone = every.where("id is null").select("id", "body", F.lit("").alias("head"), F.expr("cast(null as array<int>)").alias("next_sketch"))
    rows = given.join(heads, F.col("id") == F.col("for_id")).select("id", "body", "next.head", "next.next_sketch").unionByName(alone).select(F.col("id").alias("doc_id"), F.col("body").alias("text"), "head", "next_sketch")
    cut = F.floor(F.length("text") / 4).cast("int")
    return (
        rows.withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("head", F.lit(1), cut)))
        .withColumns({"words": words(F.col("text")), "edited_words": words(F.col("edited")), "edited_sha256": F.sha2("edited", 256)})
        .select("doc_id", "n_chars", "edited_sha256", "next_sketch", sketch("words", shingle, scale, least).alias("own"), sketch("edited_words", shingle, scale, least).alias("other"))
        .select(
            "doc_id", "n_chars", "edited_sha256",
            fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("other")).alias("edited_fingerprint"),
            likeness(F.col("own"), F.col("other"), float(least)).alias("near_edited"), likeness(F.col("own"), F.col("next_sketch"), float(least)).alias("near_next"),
            containment(F.col("own"), F.col("next_sketch"), scale).alias("in_next"),
        )
    )
