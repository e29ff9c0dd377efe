"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame operations only.

Words are lower-cased runs of letters and digits; shingles are five of them in a row (a
shorter item has one shingle, of all its words). Candidates are found by an exact join of
shingles: a window as long as an item, and the item, can reach the threshold only if enough
of the window's places hold a shingle of the item, wherever in it. All windows of which that
is true are taken, so none is lost before it is fingerprinted. Each gets a 64-bit SimHash of its
shingles, weighted by how often they occur in it. The items' fingerprints are indexed by
``BLOCKS`` blocks of bits, each with all values within ``radius // BLOCKS`` bits: of two
fingerprints within the radius some block differs in no more bits than that, so the index
finds every item of the window's length within the radius. Those are verified by exact
weighted Jaccard similarity of the shingles. What the radius itself passes over is lost.

The benchmark and its index are broadcast only while it has at most ``MOST`` shingles and
``MOST_ITEMS`` items; a larger one is
joined by shuffles of (row, place, hash) alone. Otherwise documents are not shuffled:
only stretches of two windows are, around shared shingles.

Defined results. Null or wordless text or item: no match. Repeated rows: a result each.
Several items or places: the best window for each row and item, the first of equal ones.
Null ids are kept as they are. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.shared import stored, table

BLOCKS = 7
#: Shingles and items that are broadcast at most: an item has some 320 rows of the index.
MOST, MOST_ITEMS = 500_000, 5_000
#: The bits at which blocks of a fingerprint begin.
EDGES = [round(i * 64 / BLOCKS) for i in range(BLOCKS + 1)]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != "")


def _shingles(df: DataFrame, text: Column, size: int) -> DataFrame:
    """Adds w (words) and h (hashes of shingles). The words pass through a generator, as an
    array that a lambda refers to would else be computed anew for every shingle."""
    held = df.withColumn("w", F.explode(F.array(_words(text)))).where(F.size("w") > 0)
    n = F.size("w")
    each = F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), lambda i: F.xxhash64(F.slice("w", i + 1, size)))
    return held.withColumn("n", n).withColumn("h", F.explode(F.array(each)))


def _fingerprint(h: Column) -> Column:
    """SimHash of an array of hashes; repeats count each time. A long counts two bits."""
    pair = F.lit(1 << 32 | 1)
    names = [f"c{b}" for b in range(32)]
    zero = F.struct(*(F.lit(0).cast("long").alias(c) for c in names))
    add = lambda acc, x: F.struct(*((acc[c] + F.shiftright(x, b).bitwiseAND(pair)).alias(c) for b, c in enumerate(names)))

    def bits(acc: Column) -> Column:
        ones = [acc[names[b % 32]].bitwiseAND(F.lit((1 << 32) - 1)) if b < 32 else F.shiftright(acc[names[b % 32]], 32) for b in range(64)]
        return reduce(lambda p, q: p.bitwiseOR(q), [F.when(c * 2 > F.size(h), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")) for b, c in enumerate(ones)])

    return F.aggregate(h, zero, add, bits)


def _starts(p: Column, need: Column, span: Column, low: Column, high: Column) -> Column:
    """Starts from ``low`` to ``high`` of the windows of ``span`` places that hold ``need`` or
    more of the places p (in order), each once: with the first place held, i, those that
    reach place i + need - 1 and begin after place i - 1."""

    def of(i: Column) -> Column:
        first = F.greatest(low, F.get(p, i + need - 1) - span + 1, F.get(p, i - 1) + 1)
        last = F.least(high, F.get(p, i))
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(p) - need), of))


def _block(fp: Column, i: int) -> Column:
    width = EDGES[i + 1] - EDGES[i]
    return F.shiftright(fp, EDGES[i]).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def _index(items: DataFrame, radius: int) -> DataFrame:
    """(n, block, value, item, fp2): every value near enough to a block of the item."""

    def values(i: int) -> Column:
        masks = [sum(1 << b for b in c) for k in range(radius // BLOCKS + 1) for c in combinations(range(EDGES[i + 1] - EDGES[i]), k)]
        return F.transform(F.array(*map(F.lit, masks)), lambda m: F.struct(F.lit(i).alias("block"), _block(F.col("fp"), i).bitwiseXOR(m).alias("value")))

    rows = [values(i) for i in range(BLOCKS)]
    return items.select("item", "n", F.col("fp").alias("fp2"), F.explode(F.concat(*rows)).alias("e")).select("item", "n", "fp2", "e.*")


def weighted_similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays, each element weighing how often it occurs."""
    times = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    once = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    common = F.when(once, F.size(F.array_intersect(a, b))).otherwise(F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, x: acc + F.least(times(a, x), times(b, x))))
    return common / (F.size(a) + F.size(b) - common)


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 5, radius: int = 20, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item, key, start, n_words, similarity, hamming): for each row and item, the best
    window at or over the threshold; ``key``: xxhash64 of the row's text."""
    raw = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("t"))
    items = _shingles(raw, F.col("t"), size).select("item", "n", F.col("h").alias("h2"))
    total = items.agg(F.sum(F.size("h2")).alias("s"), F.count(F.lit(1)).alias("c"), F.collect_set(F.least("n", F.lit(size))).alias("k")).first()
    large = (total.s or 0) > MOST or total.c > MOST_ITEMS
    small = (lambda df: df) if large else F.broadcast
    prints = items.withColumn("fp", _fingerprint(F.col("h2")))
    index = _index(prints, radius)
    places = items.select("item", F.col("n").alias("n2"), F.explode(F.array_distinct("h2")).alias("x"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t")).withColumns({"key": F.xxhash64("t"), "row": F.monotonically_increasing_id()})
    texts = stored(texts, "texts") if large else texts  # rows are joined to themselves
    found = None
    for k in sorted(total.k):  # five, and what shorter items have
        held = _shingles(texts, F.col("t"), k).drop("t", "w")
        own = places.where(F.least("n2", F.lit(size)) == k)
        m = F.col("n2") - k + 1  # shingles of an item
        span = F.least(m, F.greatest(F.col("n") - k + 1, F.lit(1)))
        last = F.greatest(F.lit(0), F.col("n") - F.col("n2"))
        need = F.greatest(F.lit(1), F.ceil((span + m) * (threshold / (1 + threshold)) - 1e-9).cast("int"))
        if large:  # places alone are shuffled; a document's hashes meet them once
            spots = held.select("row", "n", F.posexplode("h").alias("at", "x")).join(own, "x").groupBy("row", "n", "n2", "item").agg(F.collect_set("at").alias("p"))
            ordered = spots.where(F.size("p") >= need).withColumn("p", F.explode(F.array(F.sort_array("p"))))
            starts = ordered.select("row", "n2", F.explode(_starts(F.col("p"), need, span, F.lit(0), last)).alias("start"))
            wanted = starts.groupBy("row").agg(F.collect_set(F.struct("n2", "start")).alias("e"))
            window = held.join(wanted, "row").withColumn("e", F.explode("e")).select("doc_id", "key", "row", "n", "h", "e.*").select("doc_id", "key", "row", "n2", "start", F.slice("h", F.col("start") + 1, span).alias("h"))
        else:  # part c: the windows that start at its m places, from c * m on
            hit = held.select("doc_id", "key", "row", "n", "h", F.posexplode("h").alias("at", "x")).join(F.broadcast(own), "x")

            def part(c: Column) -> Column:
                return F.when((c >= 0) & (c <= F.floor(last / m)), F.struct(c.alias("part"), F.slice("h", F.greatest(c, F.lit(0)) * m + 1, 2 * m - 1).alias("near")))

            c = F.floor(F.col("at") / m).cast("int")
            parts = hit.select("doc_id", "key", "row", "n", "n2", "item", "at", F.explode(F.array(part(c), part(c - 1))).alias("e")).where("e is not null").select("*", "e.*")
            spots = parts.groupBy("row", "n2", "item", "part").agg(*(F.first(x).alias(x) for x in ("doc_id", "key", "n", "near")), F.collect_set("at").alias("p"))
            ordered = spots.where(F.size("p") >= need).withColumn("p", F.explode(F.array(F.sort_array("p"))))
            low = F.col("part") * m
            starts = ordered.withColumn("start", F.explode(_starts(F.col("p"), need, span, low, F.least(last, low + m - 1))))
            window = starts.select("doc_id", "key", "row", "n2", "start", F.slice("near", F.col("start") - low + 1, span).alias("h"))
        found = window if found is None else found.union(window)
    if found is None:  # no items
        return docs.select(F.col(id_col).alias("doc_id")).limit(0).select("doc_id", F.lit(None).cast(raw.schema["item"].dataType).alias("item"), *(F.lit(None).cast(t).alias(c) for c, t in (("key", "long"), ("start", "int"), ("n_words", "int"), ("similarity", "double"), ("hamming", "int"))))
    marked = found.withColumn("h", F.explode(F.array("h"))).withColumn("fp", F.explode(F.array(_fingerprint(F.col("h")))))
    probes = marked.withColumn("e", F.explode(F.array(*(F.struct(F.lit(i).alias("block"), _block(F.col("fp"), i).alias("value")) for i in range(BLOCKS))))).select("*", "e.*").drop("e")
    near = probes.join(small(index.withColumnRenamed("n", "n2")), ["n2", "block", "value"]).withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2")))).where(F.col("hamming") <= radius)
    pairs = near.groupBy("row", "n2", "start", "item").agg(*(F.first(c).alias(c) for c in ("doc_id", "key", "h", "hamming")))
    scored = pairs.withColumnRenamed("item", "own").join(small(items.withColumnRenamed("n", "n3")), F.col("own").eqNullSafe(F.col("item")) & (F.col("n2") == F.col("n3")))
    kept = scored.withColumn("similarity", weighted_similarity(F.col("h"), F.col("h2"))).where(F.col("similarity") >= threshold)
    best = kept.groupBy("row", "item").agg(F.first("doc_id").alias("doc_id"), F.first("key").alias("key"), F.max(F.struct("similarity", (-F.col("start")).alias("first"), F.col("n2").alias("n_words"), "hamming")).alias("b"))
    return best.select("doc_id", "item", "key", (-F.col("b.first")).alias("start"), "b.n_words", "b.similarity", "b.hamming")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark."""
    leaks = find_leaks(docs, benchmark, id_col=id_col, text_col=text_col, **params).select(F.col("doc_id").alias("of_id"), F.col("key").alias("of_key")).distinct()
    return docs.join(leaks, docs[id_col].eqNullSafe(leaks["of_id"]) & (F.xxhash64(docs[text_col].cast("string")) == leaks["of_key"]), "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("item").alias("item_id"), F.col("start").cast("long").alias("start"), F.col("n_words").cast("long").alias("n_words"), F.round("similarity", 6).alias("similarity"), F.col("hamming").cast("long").alias("hamming"))
