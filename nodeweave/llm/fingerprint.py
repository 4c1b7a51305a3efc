"""Document fingerprints from closed syncmers, in DataFrame functions alone.

A text is a sequence of units: runs of up to UNIT characters without white space, and of longer runs every window of UNIT
characters, so that text without white space is rolled over by the character. A k-mer of units is a closed syncmer if
the least of its inner s-mers, by hash, is its first or its last; of K - S + 1 that is two, so half of the k-mers are kept.
Whether one is depends on nothing outside the k-mer, so
an edit changes only the anchors that it touches, and equal passages have the same anchors wherever they stand. The
fingerprint is all closed syncmers in the order of the text, each as eight hex digits, and beside it the number of the
first unit of each; its size follows that of the text.

The likeness of two fingerprints matches by position: two anchors in a row agree with two in a row of the other text if
the hashes and the distance are the same, wherever they stand. It is the Dice coefficient of the distinct links. Null text is empty text, with an empty fingerprint. A text with fewer units than a k-mer, or without a syncmer, has
one anchor: its own hash. Two empty fingerprints are alike (1), an empty and another are not (0). Equal texts have equal
fingerprints; hashes that are equal by chance would be taken as one anchor. A text of any length is one row. Other columns,
of whatever name, are left alone, but for old ones named as the results. An empty table gives no rows. The least long of
all is no id here, and an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nodeweave.llm.common import cut, prepare, table

UNIT, K, S = 12, 5, 2
LOW = (1 << 32) - 1
#: Stands for a null id in joins; ids are larger.
NO_ID = -(1 << 63)


def short(h: Column) -> Column:
    """The upper half of a 64-bit hash."""
    return F.shiftright(h, 32).cast("int")


def units(unit: int) -> str:
    """Pattern whose first group is each unit: a whole run of up to `unit` characters, or each window of a longer one."""
    run = rf"(?<!\S)\S{{1,{unit}}}+(?!\S)"
    return rf"(?=({run}|\S{{{unit}}}))(?:{run}|\S)"


def with_anchors(df: DataFrame, text: str, out: str, *, unit: int = UNIT, k: int = K, s: int = S, anchors: int | None = None) -> DataFrame:
    """Add `out`, array<int>: the anchors of the text in its order; and `out`_at, array<int>: the first unit of each.

    All of them, unless `anchors` bounds them to those of so many least hashes.
    """
    u, m, at = f"{out}_u", f"{out}_m", f"{out}_at"
    df = df.withColumn(u, F.transform(F.regexp_extract_all(text, F.lit(units(unit)), F.lit(1)), lambda x: F.xxhash64(x)))
    upto = lambda array, n: F.when(F.size(array) >= n, F.sequence(F.lit(0), F.size(array) - n)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(m, F.transform(upto(u, s), lambda i: F.xxhash64(*(F.get(u, i + j) for j in range(s)))))
    last = k - s

    def closed(i: Column) -> Column:
        least = F.least(*(F.get(m, i + j) for j in range(last + 1)))
        return (least == F.get(m, i)) | (least == F.get(m, i + last))

    inner = range(0, last + 1, s)
    mer = lambda i: short(F.xxhash64(*(F.get(m, i + j) for j in inner), F.get(m, i + last)))
    df = df.withColumn(at, F.filter(upto(u, k), closed))
    if anchors is not None:
        chosen = F.slice(F.sort_array(F.array_distinct(F.transform(at, mer))), 1, anchors)
        most = f"{out}_most"
        df = df.withColumn(most, F.try_element_at(chosen, F.lit(-1))).withColumn(at, F.filter(at, lambda i: mer(i) <= F.col(most))).drop(most)
    none = F.array().cast("array<int>")
    one = lambda x: F.when(F.col(text) == "", none).otherwise(F.array(x))
    df = df.withColumn(out, F.when(F.size(at) > 0, F.transform(at, mer)).otherwise(one(short(F.xxhash64(text)))))
    return df.withColumn(at, F.when(F.size(at) > 0, F.col(at)).otherwise(one(F.lit(0)))).drop(u, m)


def links(anchors: str) -> Column:
    """The distinct links: each anchor with the next and the units between them, hashed; of one anchor, itself."""
    at = f"{anchors}_at"
    pair = lambda i: F.xxhash64(F.get(anchors, i), F.get(anchors, i + 1), F.get(at, i + 1) - F.get(at, i))
    each = F.when(F.size(anchors) > 1, F.transform(F.sequence(F.lit(0), F.size(anchors) - 2), pair)).otherwise(F.transform(anchors, lambda x: F.xxhash64(x)))
    return F.array_distinct(each)


def as_text(anchors: str) -> Column:
    return F.concat_ws("", F.transform(anchors, lambda x: F.lpad(F.lower(F.hex(x.cast("bigint").bitwiseAND(F.lit(LOW)))), 8, "0")))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two arrays of distinct links."""
    share = 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(share)


def fingerprints(docs: DataFrame, *, text: str = "text", out: str = "fingerprint", **how) -> DataFrame:
    """Add the fingerprint string of every row's text and, as `out`_at, the places of its anchors; other columns stay."""
    prepare(docs.sparkSession)
    own = [F.col(f"`{c}`") for c in docs.columns if c not in (out, f"{out}_at")]
    base = docs.select(*own, F.coalesce(F.col(text), F.lit("")).alias("__nw_body"))
    return with_anchors(base, "__nw_body", "__nw_anchors", **how).select(*own, as_text("__nw_anchors").alias(out), F.col("__nw_anchors_at").alias(f"{out}_at"))


def successors(keys: DataFrame) -> DataFrame:
    """Each (id, hash) with the next one by descending id; the last is followed by the first. Null ids, as NO_ID, come last.

    The keys are dealt by ranges, each range is ordered on its own, and the ranges are joined by their first rows, of
    which there are as many as partitions.
    """
    down = [F.desc("id"), F.asc("hash")]
    dealt = keys.repartitionByRange(*down).withColumn("range", F.spark_partition_id())
    dealt = cut(dealt)
    here = Window.partitionBy("range").orderBy(*down)
    firsts = cut(dealt.withColumn("i", F.row_number().over(here)).filter("i = 1").select("range", "id", "hash"))
    across = Window.orderBy("range")
    after = firsts.select("range", F.lead(F.struct("id", "hash")).over(across).alias("after"), F.first(F.struct("id", "hash")).over(across).alias("very_first"))
    nexts = after.select("range", F.coalesce("after", "very_first").alias("after"))
    inside = dealt.withColumn("inside", F.lead(F.struct("id", "hash")).over(here))
    return inside.join(F.broadcast(nexts), "range").withColumn("next", F.coalesce("inside", "after")).select("id", "hash", "n_chars", F.col("next.id").alias("next_id"), F.col("next.hash").alias("next_hash"))


def edited_pairs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, the fingerprints of the text and of its edited form with the places of
    their anchors, and the likeness of the text to its edited form and to the next.

    Rows that share id and text have one and the same next document, the first other one.
    """
    prepare(docs.sparkSession)
    own = F.when(F.col(doc_id) == NO_ID, F.raise_error(F.lit("the least long can't be an id")).cast("bigint")).otherwise(F.col(doc_id))
    base = docs.select(F.coalesce(own, F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body")).withColumn("hash", F.xxhash64("body"))
    following = cut(successors(base.select("id", "hash", F.length("body").alias("n_chars")).distinct()))
    # The texts are dealt by (id, hash) once: as themselves, and as the next of another. Anchors take more room than text, so they are found where the texts meet.
    full = base
    one_by_one = Window.partitionBy("id", "hash").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = full.withColumn("copy", F.count(F.lit(1)).over(one_by_one)).filter("copy = 1")
    of_next = following.select(F.col("id").alias("p_id"), F.col("hash").alias("p_hash"), F.floor(F.col("n_chars") / 2).cast("int").alias("half"), F.col("next_id").alias("id"), F.col("next_hash").alias("hash"))
    heads = heads.join(of_next, ["id", "hash"]).select(F.col("p_id").alias("id"), F.col("p_hash").alias("hash"), "half", F.col("body").alias("next_body"))
    both = full.join(following.select("id", "hash", "n_chars"), ["id", "hash"]).join(heads, ["id", "hash"])
    kept = F.substring("body", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int"))
    done = both.withColumn("edited", F.concat(kept, F.substring("next_body", F.lit(1), F.col("half"))))
    for of, out in (("body", "anchors"), ("next_body", "next_anchors"), ("edited", "edited_anchors")):
        done = with_anchors(done, of, out).withColumn(f"{out}_links", links(out))
    return done.select(
        F.nullif(F.col("id"), F.lit(NO_ID)).alias("doc_id"), F.col("n_chars").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), as_text("anchors").alias("fingerprint"), as_text("edited_anchors").alias("edited_fingerprint"),
        F.col("anchors_at").alias("fingerprint_at"), F.col("edited_anchors_at").alias("edited_fingerprint_at"), likeness(F.col("anchors_links"), F.col("edited_anchors_links")).alias("near_edited"), likeness(F.col("anchors_links"), F.col("next_anchors_links")).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(table(spark, sf_dir, "documents"))
