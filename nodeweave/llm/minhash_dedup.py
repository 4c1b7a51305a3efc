"""Near-duplicates by bottom-k sketches from one hash function.

1. Each text becomes the set of its word shingles, as 64-bit hashes; documents of one set are one class.
2. A class keeps the k smallest hashes of its set. Two classes of Jaccard similarity s share Binomial(k, s) of them or
   more, so but for a chance of MISS they share `least` values, and the whole required overlap where a set is no larger
   than its sketch. By the pigeonhole principle two such sketches share one of their (size - least + 1) rarest values:
   inverted lists are made of those alone, so common shingles make no long lists.
3. First each member of a list is paired with the list's hub, the member with the most common values; that is linear in
   the lists and joins most of a group of any number of copies. Then lists of at most SMALL members give the pairs across
   the components so far; pairs within one can't change the result and are never made.
4. Documents of longer lists that are still in several components are listed anew, by the rarest values of their full
   sets: two sets as similar as asked share one of the rarest fifth or so, which few unrelated ones do. What lists are
   then long, as of a large group with many edits each, is decided without a row per pair: documents meet in blocks,
   each block counts the common values of all its pairs by matrix products, and returns links that connect components
   of the block, no more of them than documents.
5. The sketch of a pair's union estimates its similarity; pairs that may reach the threshold are verified on full sets.
6. Connected components of the verified links.

Null text, or text without a word, has the empty set, and is linked with nothing. With fewer words than a shingle has,
the whole sequence is the one shingle. Rows with null id are linked like others, and their component is null unless it
holds a row with an id; an id of 2**62 or more is an error. Repeated rows are documents of the same class. A text of any
length is one row of its task; its set is there only while its sketch is made or a pair of it is verified. Other columns
of the table, of whatever name, are not read. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeweave.llm.common import cut, new_folder, prepare, release, stored, table, tidy
from nodeweave.llm.components import components

SKETCH, MISS = 48, 1e-6
#: Members of a list that are paired one by one, and documents in a block of those that are not.
SMALL, BLOCK = 24, 1024
NO_ID = 1 << 62
#: Up to so many pairs of longs are broadcast to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 250_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """Hashes of words seen before, bounded; a partition starts with none, so that workers don't hold them on."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


@functools.lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; bytes.lower() and split() treat ASCII only, as asked."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    acc = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        acc = _mix(acc + _A) + h[j : len(words) - n + 1 + j]
    return np.unique(_mix(acc).view(np.int64))


def least_shared(k: int, percent: int, miss: float = MISS) -> int:
    """The most c for which Binomial(k, percent / 100) stays below c with a chance of `miss` at most."""
    p, total, c = percent / 100, 0.0, 0
    while total + (now := math.comb(k, c) * p**c * (1 - p) ** (k - c)) <= miss:
        total, c = total + now, c + 1
    return max(c, 1)


def sketches(docs: DataFrame, width: int, k: int) -> DataFrame:
    """(id, doc_id, text_hash, n, set1, set2, sketch) of each row; set1 and set2 are hashes of the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x, width) for x in b["text"].to_pylist()]
            one = [xxhash.xxh64_intdigest(s.tobytes(), 1) - (1 << 63) for s in sets]
            two = [xxhash.xxh64_intdigest(s.tobytes(), 2) - (1 << 63) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b["id"], b["doc_id"], b["text_hash"], pa.array([len(s) for s in sets], pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array([s[:k] for s in sets], pa.list_(pa.int64()))],
                names=["id", "doc_id", "text_hash", "n", "set1", "set2", "sketch"],
            )
        word_hashes().clear()
        release()

    return docs.mapInArrow(run, "id bigint, doc_id bigint, text_hash bigint, n bigint, set1 bigint, set2 bigint, sketch array<bigint>")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, items) of the rows whose (id, text_hash) is in `wanted`, repeated rows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["id"], pa.array([shingles(x, width) for x in b["text"].to_pylist()], pa.list_(pa.int64()))], names=["id", "items"])
        word_hashes().clear()
        release()

    # Repeated rows go while they are texts, which take less room than sets.
    once = picked(docs, wanted, ["id", "text_hash"]).groupBy("id").agg(F.first("text").alias("text"))
    return stored(once.mapInArrow(run, "id bigint, items array<bigint>"), "sets")


def similar_size(a: str, b: str, percent: int):
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def numbered(doc_id: Column, text: Column) -> Column:
    """The id; for a null one a number above all ids, by the text, so that it is the same at every reading."""
    unnamed = F.xxhash64(F.lit("without an id"), text).bitwiseAND(F.lit(NO_ID - 1)) + NO_ID
    return F.when(doc_id.isNull(), unnamed).when(doc_id < NO_ID, doc_id).otherwise(F.raise_error(F.lit("ids must be below 2**62")).cast("bigint"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """One row per row of `docs`: doc_id, text_hash (xxhash64 of the text), n_shingles, component_id, kept."""
    spark = docs.sparkSession
    prepare(spark)
    least = least_shared(k, percent)
    rows = docs.select(numbered(F.col(doc_id).cast("bigint"), F.col(text)).alias("id"), F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    folder = new_folder(spark, "sketches")
    sketches(rows, width, k).write.parquet(folder)
    every = spark.read.parquet(folder)
    classes = every.filter("n > 0").groupBy("n", "set1", "set2").agg(F.min_by(F.struct("id", "text_hash", "sketch"), F.struct("id", "text_hash")).alias("x"))
    classes = cut(classes.select("n", "set1", "set2", "x.*"))
    check = lambda pairs: verified(rows, classes, pairs, width, percent, k, least)

    whole = f"(n * {percent} + 99) div 100"  # the overlap that a set of n needs
    partner_may_be_cut = F.col("n") * 100 > F.lit(k * percent)
    need = F.when(partner_may_be_cut, F.least(F.expr(whole), F.lit(least))).otherwise(F.expr(whole))
    lists = rarest(classes.select("id", "n", F.col("sketch").alias("items")), need)

    # The hubs are stored first: they are broadcast if small, or else Spark splits the lists of hot values among tasks, which
    # it can do only where both sides of a join are shuffled.
    hubs = stored(lists.groupBy("v").agg(F.max_by(F.struct("id", "n"), F.struct("weight", "id")).alias("hub")), "hubs")
    # The hub comes first: its set is joined to its many pairs while these are short, which then part by their other ends.
    pairs = lists.join(hubs, "v").select(F.col("hub.id").alias("a"), F.col("id").alias("b"), "n", F.col("hub.n").alias("m"))
    pairs = cut(pairs.filter((F.col("a") != F.col("b")) & similar_size("n", "m", percent)).select("a", "b").distinct())
    links = check(pairs)
    labels = components(links)
    tidy(spark)

    few, many = by_length(lists, labels)
    tested = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = check(cut(across(few, percent).join(tested, ["a", "b"], "left_anti")))
    links = links.union(found)
    labels = components(links)
    tidy(spark)

    crowded = cut(many.select("id").join(classes.select("id", "text_hash"), "id").distinct())
    if not crowded.isEmpty():
        links = links.union(within_crowd(rows, crowded, labels, width, percent, whole, check))
        labels = components(links)
        tidy(spark)

    of_class = classes.select("n", "set1", "set2", "id").join(labels.withColumnRenamed("node", "id"), "id", "left").select("n", "set1", "set2", F.coalesce("label", "id").alias("label"))
    joined = every.drop("sketch").join(of_class, ["n", "set1", "set2"], "left").withColumn("label", F.coalesce("label", "id"))
    return joined.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("label") < NO_ID, F.col("label")).alias("component_id"), (F.col("id") == F.col("label")).alias("kept"))


def rarest(sets: DataFrame, need: Column, folder: str | None = None) -> DataFrame:
    """Inverted lists (v, id, n, weight): of each set's `items` the rarest, one more than may be missing from an overlap
    of `need`; values that only one set has are left out. weight: how common a set's values are.

    With `folder`, each set's values that others have too are written there, as by_df, by falling rarity.
    """
    entries = sets.select("id", "n", F.size("items").alias("size"), F.explode("items").alias("v"))
    common = stored(entries.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "shared-values")  # see hubs
    ranked = entries.join(common, "v").groupBy("id", "n", "size").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("by_df"), F.sum("df").alias("weight"))
    if folder is not None:
        ranked.write.parquet(folder)
        ranked = sets.sparkSession.read.parquet(folder)
    # the values of one set alone come first and take their part of the length
    length = F.col("size") - need + 1 - (F.col("size") - F.size("by_df"))
    listed = ranked.filter(length > 0).select("id", "n", (F.col("weight") / F.col("size")).alias("weight"), F.explode(F.slice("by_df", F.lit(1), length.cast("int"))).alias("e"))
    return cut(listed.select(F.col("e.v").alias("v"), "id", "n", "weight"))


def named(lists: DataFrame, labels: DataFrame) -> DataFrame:
    return lists.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))


def by_length(lists: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lists that are still in several components, with labels: short ones, and long ones."""
    with_labels = named(lists, labels)
    sizes = with_labels.groupBy("v").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("members"))
    sizes = stored(sizes.filter("low < high").select("v", "members"), "open-lists")  # see hubs
    open_lists = cut(with_labels.join(sizes, "v"))
    return open_lists.filter(F.col("members") <= SMALL), open_lists.filter(F.col("members") > SMALL)


def across(lists: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of members of one short list in different components."""
    left = lists.select("v", F.col("id").alias("a"), "n", F.col("label").alias("la"))
    right = lists.select("v", F.col("id").alias("b"), F.col("n").alias("m"), F.col("label").alias("lb"))
    on = (left["v"] == right["v"]) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & similar_size("n", "m", percent)
    return left.join(right, on).select("a", "b").distinct()


def within_crowd(rows: DataFrame, crowded: DataFrame, labels: DataFrame, width: int, percent: int, whole: str, check) -> DataFrame:
    """Links (a, b) among the documents of long lists, across the components in `labels`."""
    spark = rows.sparkSession
    sets = full_sets(rows, crowded, width).withColumn("n", F.size("items").cast("bigint"))
    shared = new_folder(spark, "shared")
    few, many = by_length(rarest(sets, F.expr(whole), shared), labels)
    links = check(cut(across(few, percent)))
    if many.isEmpty():
        return links
    # Documents that long lists connect are one crowd; those outside its largest component meet all of it.
    hubs = stored(many.groupBy("v").agg(F.min("id").alias("b")), "crowd-hubs")
    crowds = components(many.join(hubs, "v").filter("id <> b").select(F.col("id").alias("a"), "b").distinct())
    members = cut(named(crowds.select(F.col("node").alias("id"), F.col("label").alias("crowd")), labels))
    by_part = members.groupBy("crowd", "label").agg(F.count(F.lit(1)).alias("docs"))
    sizes = by_part.groupBy("crowd").agg(F.max_by("label", "docs").alias("largest"), F.ceil(F.sum("docs") / BLOCK).alias("blocks"))
    # Values that no other set has count in a set's size alone.
    held = spark.read.parquet(shared).select("id", "n", F.transform("by_df", lambda e: e["v"]).alias("items"))
    placed = members.join(sizes, "crowd").join(held, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    columns = packed(placed.select("crowd", "block", "id", "label", "n", "items"), "block")
    outside = placed.filter("label <> largest").select("crowd", F.col("block").alias("rows"), "blocks", "id", "label", "n", "items")
    sought = packed(outside.select("crowd", "rows", "id", "label", "n", "items"), "rows").join(sizes.select("crowd", "blocks"), "crowd").withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
    met = sought.select("crowd", "block", *(F.col(c).alias(f"x_{c}") for c in PACKED)).join(columns, ["crowd", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                get = lambda name: b[name][i].values.to_numpy()  # noqa: B023, E731
                one, two = ([get(f"{x}{c}") for c in PACKED] for x in ("x_", ""))
                yield pa.RecordBatch.from_pydict(dict(zip("ab", block_links(one, two, percent), strict=True)))

    return links.union(cut(met.mapInArrow(run, "a bigint, b bigint")))


PACKED = ("ids", "labels", "sizes", "ends", "items")


def packed(docs: DataFrame, by: str) -> DataFrame:
    """One row per crowd and block, of about BLOCK documents: ids, labels, sizes of the full sets, and the shared values of
    each behind each other, with their ends."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        sets = t["items"].chunk(0)
        ends = np.cumsum(pa.compute.list_value_length(sets).to_numpy()).astype(np.int64)
        longs = pa.list_(pa.int64())
        cols = [t["id"].to_numpy(), t["label"].to_numpy(), t["n"].to_numpy(), ends, sets.flatten().to_numpy()]
        return pa.table({"crowd": t["crowd"][:1], by: t[by][:1], **{n: pa.array([c], longs) for n, c in zip(PACKED, cols, strict=True)}})

    longs = ", ".join(f"{n} array<bigint>" for n in PACKED)
    return docs.groupBy("crowd", by).applyInArrow(pack, f"crowd bigint, {by} bigint, {longs}")


def block_links(one: list[np.ndarray], two: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): links between two blocks across components, a spanning forest of the components that they connect."""
    (ids, labels, sizes, ends, items), (ids2, labels2, sizes2, ends2, items2) = one, two
    values = np.intersect1d(items, items2)
    shared = np.zeros((len(ids), len(ids2)), np.float32)
    places = []
    for own, size in ((items, np.diff(ends, prepend=0)), (items2, np.diff(ends2, prepend=0))):
        at = np.searchsorted(values, own)
        at[at == len(values)] = 0
        held = values[at] == own if len(values) else np.zeros(len(own), bool)
        places.append((np.repeat(np.arange(len(size)), size)[held], at[held]))
    for low in range(0, len(values), 4096):
        dense = []
        for (doc, at), n in zip(places, (len(ids), len(ids2)), strict=True):
            here = (at >= low) & (at < low + 4096)
            m = np.zeros((n, min(4096, len(values) - low)), np.float32)
            m[doc[here], at[here] - low] = 1
            dense.append(m)
        shared += dense[0] @ dense[1].T
    near = shared * 100 >= (sizes[:, None] + sizes2[None, :] - shared) * percent
    i, j = np.nonzero(near & (labels[:, None] != labels2[None, :]))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    _, first = np.unique(np.stack([labels[i], labels2[j]]), axis=1, return_index=True)
    for at in first.tolist():
        a, b = root(int(labels[i[at]])), root(int(labels2[j[at]]))
        if a != b:
            parent[a] = b
            keep.append(at)
    return ids[i[keep]], ids2[j[keep]]


def verified(rows: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int, k: int, least: int) -> DataFrame:
    """Those (a, b) whose full sets reach the threshold, after the estimate by sketches."""
    brief = picked(classes.select("id", "n", "text_hash", "sketch"), pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), ["id"])
    a, b = (brief.select(*(F.col(c).alias(f"{x}_{c}") for c in ("text_hash", "n", "sketch")), F.col("id").alias(x)) for x in "ab")
    both = pairs.join(a, "a").join(b, "b")
    union = F.slice(F.array_sort(F.array_union("a_sketch", "b_sketch")), 1, k)
    both = both.withColumn("u", union).withColumn("shared", F.size(F.array_intersect("u", F.array_intersect("a_sketch", "b_sketch"))))
    exact = (F.col("a_n") <= k) & (F.col("b_n") <= k) & (F.size("u") < k)
    likely = F.when(exact, F.col("shared") * 100 >= F.size("u") * percent).otherwise(F.col("shared") >= least)
    left = cut(both.filter(likely).select("a", "b", "a_n", "b_n", "a_text_hash", "b_text_hash"))
    wanted = left.select(F.col("a").alias("id"), F.col("a_text_hash").alias("text_hash")).union(left.select("b", "b_text_hash")).distinct()
    sets = full_sets(rows, wanted, width)  # stored, so that the pairs of a hub can be split, see hubs
    got = left.select("a", "b", "a_n", "b_n").join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return cut(got.select("a", "b", "a_n", "b_n", shared.alias("shared")).filter(f"shared * 100 >= (a_n + b_n - shared) * {percent}").select("a", "b"))


def picked(df: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """The rows of `df` whose key is in `wanted`: by broadcast up to BROADCAST_IDS keys, else by a shuffle."""
    small = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(wanted) if small else wanted, on, "left_semi")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each group the row with the smallest id stays, once.

    Rows without an id are told apart by their text alone.
    """
    key, text_hash = "__nw_key", "__nw_hash"
    kept = near_duplicates(docs, doc_id=doc_id, text=text, **how).filter("kept")
    kept = cut(kept.groupBy(F.coalesce("doc_id", F.lit(-NO_ID)).alias(key), F.col("text_hash").alias(text_hash)).agg(F.count(F.lit(1)).alias("rows")))
    marked = docs.withColumns({key: F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-NO_ID)), text_hash: F.xxhash64(text)})
    left = picked(marked, kept.select(key, text_hash), [key, text_hash])
    if not kept.filter("rows > 1").isEmpty():  # repeated rows
        left = left.dropDuplicates([key, text_hash])
    return left.drop(key, text_hash)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2).drop("text_hash")


#: The same rows by all common shingles of all pairs; for small tables.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w
), n AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM s
), u AS MATERIALIZED (SELECT doc_id, n, unnest(s) AS x FROM s JOIN n USING (doc_id)
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80 GROUP BY ALL
), l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)
), e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""
