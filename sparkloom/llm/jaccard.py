"""Exact n-gram Jaccard self-join with a token-group matrix.

1. Texts with equal shingle sets are one class (128 bits of set hash).
2. For each shingle (token), in how many classes it occurs; a class with too few shared
   tokens to reach the threshold is left out, with nothing lost (``shared_tokens``).
3. Groups: similar classes share the least hash of their sets; each is compared with the
   most central of its group and joins it if they link, in a few rounds over what is left. So a
   group is always a set of classes that links connect (``grouped``).
4. The matrix holds which tokens occur in which group's union, each pair once. A class
   probes it with its rarest tokens, as many as any linked pair must share one of; the
   groups found are bounded by how many of its tokens their unions hold. A group within
   the bound is opened: its most linked member first, as one link is enough; if that
   does not link, the members that hold a token of the class that fewer than ``COMMON``
   members hold, and those so short that common tokens alone can do (``cross_links``).
5. Connected components over groups and links.

A large group of copies is one class, near copies are one group after step 3: no step
makes pairs within either, and a token in thousands of them is one entry of the matrix.

Defined results. Null, empty or wordless text: an empty set, linked with nothing, a
component of its own. Repeated ids: one class if equal, else as different documents; the
component is the smallest id. A null id counts for nothing there; a component of null ids
only is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.bytewords import SPACED, U, find_words, mix, slices, text_buffer, windows
from sparkloom.llm.components import components
from sparkloom.llm.routing import ROWS, blob_table, bucket_of, buckets_for, by_document, pack, regroup, unpack, with_keys
from sparkloom.llm.shared import stored, table

TOKENS_PER_BYTE = 0.18
TOKEN_BITS = U(52)
#: A token that so many members hold is common to their group; rarer ones name members.
COMMON = 32


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, token) of each distinct shingle, in order; at most 4096 documents."""
    words = find_words(*text_buffer(column), SPACED, lower=True)
    h, counts = words.hashes(), words.counts()
    at, w = windows(h, words.first, size)
    docs, tokens = [words.doc_of()[at]], [w]
    for few in range(1, size):  # the whole sequence of a shorter text
        if np.any(counts == few):
            at, w = windows(h, words.first, few)
            doc = words.doc_of()[at]
            own = counts[doc] == few
            docs.append(doc[own])
            tokens.append(mix(w[own] + U(few)))
    key = np.concatenate(docs).astype(np.uint64) << TOKEN_BITS | np.concatenate(tokens) >> (U(64) - TOKEN_BITS)
    key = np.sort(key)
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    return (key >> TOKEN_BITS).astype(np.int64), key & ((U(1) << TOKEN_BITS) - U(1))


def _signatures(rows: int, doc: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.bincount(doc, minlength=rows)
    k1, k2 = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        first = (np.cumsum(n) - n)[some]
        k1[some] = np.add.reduceat(mix(token + U(11)), first)
        k2[some] = np.add.reduceat(mix(token * U(3) + U(7)), first)
    return n, k1.view(np.int64), k2.view(np.int64)


def _parts(batch: pa.RecordBatch, batch_bytes: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batch, "text", batch_bytes):
        for low in range(0, part.num_rows, 4096):
            yield part.slice(low, 4096)


def signed_documents(docs: DataFrame, size: int, id_col: str, text_col: str, batch_bytes: int = 6 << 20) -> DataFrame:
    """(doc_id, r1, r2, n, k1, k2): each row's id and key, the size and the hash of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole, batch_bytes):
                n, k1, k2 = _signatures(batch.num_rows, *shingle_sets(batch.column("text"), size))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64()), pa.array(k1), pa.array(k2)], ["doc_id", "r1", "r2", "n", "k1", "k2"])

    rows = with_keys(docs, id_col, text_col).select("text", "doc_id", F.col("k1").alias("r1"), F.col("k2").alias("r2"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, r1 long, r2 long, n long, k1 long, k2 long")


def need(n, threshold: Fraction):
    """The least number of shared tokens that a set of n can reach the threshold with."""
    return -(-n * threshold.numerator // threshold.denominator)


def shared_tokens(docs: DataFrame, size: int, text_col: str, buckets: int, threshold: Fraction, batch_bytes: int = 6 << 20) -> DataFrame:
    """(k1, k2, n, tokens): for each class that has enough of them, its tokens that other
    classes have too, as 64-bit integers, the rarest first."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole, batch_bytes):
                doc, token = shingle_sets(batch.column(0), size)
                n, k1, k2 = _signatures(batch.num_rows, doc, token)
                _, first = np.unique(np.stack([k1, k2]), axis=1, return_index=True)  # of equal sets, one
                own = np.isin(doc, first)
                doc, token = doc[own], token[own]
                found = list(pack([k1, k2, n], doc, None, token, bucket_of(token << (U(64) - TOKEN_BITS), buckets), 5))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["bucket", "blob"])

    def count(key: tuple, group: pa.Table) -> pa.Table:
        (k1, k2, n), run, _, h = unpack(group.column("blob").to_pylist(), 3, 5, False)
        named = np.empty(len(k1), [("a", "i8"), ("b", "i8")])
        named["a"], named["b"] = k1, k2
        _, first, own = np.unique(named, return_index=True, return_inverse=True)
        keep = first[own[run]] == run  # of equal sets, one
        run, h = run[keep], h[keep]
        order = np.argsort(h, kind="stable")
        s = h[order]
        groups = np.cumsum(np.r_[False, s[1:] != s[:-1]])
        many = np.empty(len(h), np.int64)
        many[order] = np.bincount(groups)[groups] if len(h) else 0
        picked = np.flatnonzero(many > 1)
        rarity = np.minimum(np.log2(many[picked]) * 4, 255).astype(np.uint64)
        token = rarity << U(56) | U(key[0].as_py() & 0xFFFF) << U(40) | h[picked]
        run = run[picked]
        return blob_table(list(pack([k1, k2, n], run, None, token, regroup(k1, buckets)[run], 8)))

    def gather(group: pa.Table) -> pa.Table:
        keys, run, _, token = unpack(group.column("blob").to_pylist(), 3, 8, False)
        (k1, k2, n), cells = by_document(keys, run, token)
        enough = np.array([len(c) for c in cells], np.int64) >= need(n, threshold)
        kept = [c.astype("<u8").tobytes() for c, e in zip(cells, enough.tolist()) if e]
        return pa.table({"k1": k1[enough], "k2": k2[enough], "n": n[enough], "tokens": pa.array(kept, pa.binary())})

    entries = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(emit, ROWS)
    return entries.groupBy("bucket").applyInArrow(count, ROWS).groupBy("bucket").applyInArrow(gather, "k1 long, k2 long, n long, tokens binary")


def _tokens(cell: bytes) -> np.ndarray:
    return np.frombuffer(cell, "<u8")


def linked(pairs: DataFrame, threshold: Fraction) -> DataFrame:
    """(a, b) of the pairs (a, n, tokens, b, n2, tokens2) that link: the exact check."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, n, b, m in zip(batch.column("tokens"), batch.column("n").to_pylist(), batch.column("tokens2"), batch.column("n2").to_pylist()):
                common = len(np.intersect1d(_tokens(a.as_py()), _tokens(b.as_py()), assume_unique=True))
                keep.append(common * threshold.denominator >= threshold.numerator * (n + m - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], ["a", "b"])

    return pairs.select("a", "n", "tokens", "b", "n2", "tokens2").mapInArrow(run, "a long, b long")


def first_of_groups(sets: DataFrame, threshold: Fraction, rounds: int) -> DataFrame:
    """Links (a, b) from classes to the most central one of the group that their least hash
    puts them in: that whose tokens are the commonest, the likeliest to be what the others
    were made from. Each round, with another hash, takes those not yet linked."""
    links = None
    for i in range(rounds):

        def key(batches: Iterator[pa.RecordBatch], salt: np.uint64 = U(2 * i + 1)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = [_tokens(x.as_py()) for x in batch.column("tokens")]
                least = [int(mix(c * salt + salt).min().view(np.int64)) for c in cells]
                central = [int((c >> U(56)).sum()) * 1000 // int(n) for c, n in zip(cells, batch.column("n").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(least, pa.int64()), pa.array(central, pa.int64()), *batch.columns], ["key", "central", "a", "n", "tokens"])

        left = sets if links is None else sets.join(links.select(F.col("a").alias("sid")), "sid", "left_anti")
        keyed = left.select(F.col("sid").alias("a"), "n", "tokens").mapInArrow(key, "key long, central long, a long, n long, tokens binary")
        groups = keyed.groupBy("key").agg(F.max(F.struct("central", "a"))["a"].alias("b"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
        firsts = groups.join(left.select(F.col("sid").alias("b"), F.col("n").alias("n2"), F.col("tokens").alias("tokens2")), "b")
        new = linked(keyed.join(firsts, "key").where("a <> b"), threshold)
        links = stored(new if links is None else links.union(new), "links")
    return links


def cross_links(sets: DataFrame, stars: DataFrame, groups: DataFrame, threshold: Fraction) -> DataFrame:
    """Links (a, b) between classes of different groups, by the token-group matrix."""
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    grouped = sets.join(groups.withColumnRenamed("node", "sid"), "sid", "left").withColumn("g", F.coalesce("component", "sid")).join(sizes, "component", "left").select("sid", "n", "tokens", "g", F.coalesce("members", F.lit(1)).alias("members"))
    grouped = stored(grouped, "groups", "none")

    def rows(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = [_tokens(x.as_py()) for x in batch.column("tokens")]
                full = np.array([len(c) for c in cells], np.int64)
                if not whole:  # a prefix of the sorted set: n - need + 1 tokens, of which the unshared ones are left out
                    n = np.array(batch.column("n").to_pylist(), np.int64)
                    cells = [c[: max(0, len(c) - int(k) + 1)] for c, k in zip(cells, need(n, threshold))]
                count = np.array([len(c) for c in cells], np.int64)
                which = pa.array(np.repeat(np.arange(len(cells)), count))
                token = np.concatenate(cells).view(np.int64) if len(cells) else np.zeros(0, np.int64)
                left = np.repeat(full + np.cumsum(count) - count, count) - np.arange(len(token))
                step = 1 << 18
                for low in range(0, len(token), step):
                    at = which.slice(low, step)
                    yield pa.RecordBatch.from_arrays([pa.array(token[low : low + step]), *(batch.column(c).take(at) for c in ("sid", "n", "g", "members")), pa.array(left[low : low + step])], ["token", "sid", "n", "g", "members", "left"])

        return run

    num, den = threshold.numerator, threshold.denominator
    # left: this token and the shared ones after it, in the order of rarity
    schema = "token long, sid long, n long, g long, members long, left long"
    prefix = grouped.select("sid", "n", "tokens", "g", "members").mapInArrow(rows(False), schema)
    mixed = prefix.groupBy("token").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low <> high").select("token")
    probes = stored(prefix.join(mixed, "token", "left_semi"), "probes")
    matrix = probes.groupBy("token", F.col("g").alias("g2")).agg(F.first("members").alias("members2"), F.max("left").alias("left2"), F.min("n").alias("low2"), F.max("n").alias("high2"))
    # of a linked pair, the first common token has enough others after it on both sides
    enough = F.least("left", "left2") * (num + den) >= (F.col("n") + F.col("low2")) * num
    sized = (F.col("low2") * num <= F.col("n") * den) & (F.col("high2") * den >= F.col("n") * num)
    # the smaller group asks the larger one
    smaller = "g <> g2 and (members < members2 or members = members2 and g < g2)"
    found = probes.join(matrix, "token").where(smaller).where(enough & sized).select("sid", "g2").distinct()
    found = stored(found, "candidates")
    asked = grouped.join(found.select("sid").distinct(), "sid", "left_semi").mapInArrow(rows(True), schema).select("token", "sid").join(found, "sid")
    entries = grouped.join(found.select(F.col("g2").alias("g")).distinct(), "g", "left_semi").select("sid", "n", "tokens", "g", "members").mapInArrow(rows(True), schema)
    union = entries.groupBy("token", F.col("g").alias("g2")).agg(F.count(F.lit(1)).alias("holders"))
    overlap = stored(asked.join(union, ["token", "g2"]), "overlap")
    within = overlap.groupBy("sid", "g2").agg(F.count(F.lit(1)).alias("bound"), F.count_if(F.col("holders") >= COMMON).alias("common"))
    of_query = grouped.select(F.col("sid").alias("a"), "n", "tokens")
    of_member = grouped.select(F.col("sid").alias("b"), F.col("n").alias("n2"), F.col("tokens").alias("tokens2"), F.col("g").alias("g2"), "members")
    queries = of_query.select("a", "n").join(within.withColumnRenamed("sid", "a"), "a").where(F.col("bound") * den >= F.col("n") * num)
    queries = stored(queries.select("a", "n", "g2", "common"), "queries")
    close = (F.col("n2") * den >= F.col("n") * num) & (F.col("n") * den >= F.col("n2") * num)
    # one link to a group is enough: its most linked member is asked first
    degrees = stars.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    heads = degrees.join(groups, "node").groupBy(F.col("component").alias("g2")).agg(F.max(F.struct("degree", "node"))["node"].alias("b"))
    heads = stored(heads.union(grouped.where("members = 1").select(F.col("g").alias("g2"), F.col("sid").alias("b"))), "heads")
    asked_first = queries.select("a", "g2").join(heads, "g2").join(of_query, "a").join(of_member.drop("g2", "members"), "b").where(close)
    first = stored(linked(asked_first, threshold), "first")
    open_ = queries.join(first.join(heads, "b").select("a", "g2"), ["a", "g2"], "left_anti").join(sizes.where("members > 1").select(F.col("component").alias("g2")), "g2", "left_semi")
    # of the others, those that hold a rare token of the query, or are short enough without any
    short = open_.join(of_member.select("b", "n2", "g2"), "g2").where(close & (F.col("common") * (num + den) >= (F.col("n") + F.col("n2")) * num)).select("a", "b")
    rare = overlap.where(F.col("holders") < COMMON).select("token", F.col("sid").alias("a"), "g2").join(open_.select("a", "g2"), ["a", "g2"])
    sharing = rare.join(entries.select("token", F.col("sid").alias("b"), F.col("g").alias("g2")), ["token", "g2"]).select("a", "b")
    pairs = short.union(sharing).distinct().join(of_query, "a").join(of_member.drop("g2", "members"), "b").where(close)
    return stored(first.union(linked(pairs, threshold)), "cross")


def jaccard_components(docs: DataFrame, size: int = 5, threshold: Fraction = Fraction(3, 4), id_col: str = "doc_id", text_col: str = "text", rounds: int = 5) -> DataFrame:
    """(doc_id, r1, r2, n_shingles, k1, k2, component, component_id) for every row: the key
    of the row (``with_keys``), its class, and what names its component (null: alone)."""
    threshold = Fraction(threshold)
    signed = stored(signed_documents(docs, size, id_col, text_col), "signed")
    buckets = buckets_for(docs, text_col, TOKENS_PER_BYTE)
    sets = stored(shared_tokens(docs, size, text_col, buckets, threshold).withColumn("sid", F.monotonically_increasing_id()), "sets", "none")
    stars = first_of_groups(sets, threshold, rounds)
    groups = components(stars)
    cross = cross_links(sets, stars, groups, threshold)
    if not cross.isEmpty():
        groups = components(stars.union(cross))
    classes = signed.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"))
    own = sets.select("sid", "k1", "k2").join(groups.withColumnRenamed("node", "sid"), "sid").join(classes, ["k1", "k2"])
    least = own.groupBy("component").agg(F.min("least").alias("least"))
    joined = stored(own.drop("least").join(least, "component").select("k1", "k2", "least", "component"), "joined")
    name = F.when(F.col("component").isNull(), F.struct(F.lit(0).alias("kind"), F.col("k1").alias("a"), F.col("k2").alias("b"))).otherwise(F.struct(F.lit(1).alias("kind"), F.col("component").alias("a"), F.lit(0).cast("long").alias("b")))
    final = classes.join(joined.withColumnRenamed("least", "linked"), ["k1", "k2"], "left").select("k1", "k2", F.coalesce("linked", "least").alias("component_id"), name.alias("component"))
    cols = ["doc_id", "r1", "r2", F.col("n").alias("n_shingles"), "k1", "k2", "component"]
    empty = signed.where("n = 0").withColumn("component", F.lit(None).cast("struct<kind:int,a:bigint,b:bigint>"))
    return signed.where("n > 0").join(final, ["k1", "k2"]).select(*cols, "component_id").union(empty.select(*cols, F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs``, one of each component: that with the smallest id, null ids last.
    Texts without words all stay."""
    found = jaccard_components(docs, id_col=id_col, text_col=text_col, **params)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "r1", "r2")).alias("m")
    kept = stored(found.where("component is not null").groupBy("component").agg(first).select("m.r1", "m.r2"), "kept")
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    row = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = with_keys(row.select("row", "doc_id", "text"), "doc_id", "text", "row")
    left = rows.where(~blank).join(kept, (rows["k1"] == kept["r1"]) & (rows["k2"] == kept["r2"]), "left_semi").dropDuplicates(["k1", "k2"])
    return left.select("row.*").union(rows.where(blank).select("row.*"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
