"""Line dedup by a segment-partition edit join, in DataFrame operations only.

A line goes if an equal line, or one within ``threshold`` edits, stands at an earlier
place (order: document id, nulls first; then the row; then the line number). Distinct lines
are joined once each: a line of n characters has ``threshold + 1`` even segments, and any
line within the threshold holds one of them whole, near where it stood. So a line has keys
of (n, number, text of the segment), for every length up to ``threshold`` below its own and
the few positions that a match can have; those of its own segments are the index.

Each line is first compared with the earliest line of each of its keys: that settles
families of near lines without pairs within them. Lines that this leaves open are then
joined with all earlier ones of their keys whose letters' counts allow it (``letters``).
Candidates are cut to where they differ, and if a part between two edits is equal
(``may_match``) verified by a banded bit-parallel automaton: for 0, 1, ... edits, a word of
bits says which diagonals can be reached. Texts are not shuffled with keys.

Defined results. Null text: no lines, kept text empty. Blank lines stay and match nothing.
Lines below ``min_near`` characters match equal lines only: two edits are a quarter of a
line of 8, and short lines such as dates or numbers differ by that and are no copies; that
is part of the definition. A threshold over 4 raises ``ValueError``, as its words of bits
do not fit 64. Repeated rows: the later one's
lines all go, but for blank ones. A null id counts as the smallest. Other columns are
ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.shared import stored, table


def _segment(n: Column, i: Column | int, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i (from 0) of a line of n characters; the last
    n mod parts ones are longer by one."""
    short = F.floor(n / parts).cast("int")
    longer = F.greatest(F.lit(0), F.lit(i - parts) + n % parts)  # longer ones before this
    return short * i + longer + 1, short + (F.lit(i) >= parts - n % parts).cast("int")


def _key(n: Column, i: Column, text: Column) -> Column:
    return F.xxhash64(n, i, text)


def _part(line: Column, start: Column, size: Column) -> Column:
    """Characters of a line given as UTF-32, where any is found at once."""
    return F.substr(line, (start - 1) * 4 + 1, size * 4)


def line_keys(lines: DataFrame, threshold: int, min_near: int) -> DataFrame:
    """(lid, key, own): keys of the substrings of each line (lid, line, n) that can be a
    segment of a line as long or shorter: those that leave no more edits on either side than
    the segments there allow. ``own``: of the line's own segments."""
    parts = threshold + 1
    shapes = []
    for less in range(parts):
        for i in range(parts):
            low, high = max(-i, less - (threshold - i)), min(i, less + (threshold - i))
            shapes += [F.struct(F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(off).alias("off")) for off in range(low, high + 1)]
    # a line is encoded once, and a row made for each shape: as columns side by side, the
    # keys would be more code than the JVM compiles
    wide = lines.select("lid", "n", F.explode(F.array(F.encode("line", "UTF-32"))).alias("wide"))
    each = wide.select("*", F.explode(F.array(*shapes)).alias("s"))
    n, size_of, i = F.col("n"), F.col("n") - F.col("s.less"), F.col("s.i")
    start, size = _segment(size_of, i, parts)
    at = start + F.col("s.off")
    fits = (at >= 1) & (at + size - 1 <= n) & (size_of >= min_near)
    return each.where(fits).select("lid", _key(size_of, i, _part(F.col("wide"), at, size)).alias("key"), ((F.col("s.less") == 0) & (F.col("s.off") == 0)).alias("own"))


#: Words of 64 bits in a filter, whatever is put into it.
WORDS = 1 << 18


def perhaps_in(df: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` whose ``name`` is in ``found``, and some others: by a filter of bits
    that has a fixed size and so is broadcast. An exact join that follows moves fewer rows."""
    h = F.xxhash64(name)
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int"))
    word = F.pmod(h, F.lit(WORDS)).alias("__word")
    words = found.select(word, mask.alias("mask")).groupBy("__word").agg(F.bit_or("mask").alias("__bits"))
    return df.withColumn("__word", word).join(F.broadcast(words), "__word").where(F.col("__bits").bitwiseAND(mask) != 0).drop("__word", "__bits")


#: Characters whose counts are compared, 8 bits each, 8 a number.
LETTERS = "etaoinsrhldcumfgypwbvkjxqz0123456789 .,-"


def letters(line: Column) -> Column:
    """How often each of ``LETTERS`` occurs, at most 255, as a struct of numbers."""
    count = lambda c: F.least(F.length(line) - F.length(F.replace(line, F.lit(c), F.lit(""))), F.lit(255)).cast("long")
    groups = [LETTERS[i : i + 8] for i in range(0, len(LETTERS), 8)]
    return F.struct(*(reduce(lambda p, q: p.bitwiseOR(q), [F.shiftleft(count(c), 8 * i) for i, c in enumerate(g)]).alias(f"l{j}") for j, g in enumerate(groups)))


def letters_apart(a: Column, b: Column) -> Column:
    """How far counts are apart in sum; an edit changes that by 2 at most."""
    one = lambda x, i: F.shiftrightunsigned(x[f"l{i // 8}"], 8 * (i % 8)).bitwiseAND(F.lit(255))
    return reduce(lambda p, q: p + q, [F.abs(one(a, i) - one(b, i)) for i in range(len(LETTERS))])


#: Lines of 2 ** ``STEPS`` characters or more are not cut.
STEPS = 17


def may_match(pairs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (x, y, n, m: lines and their lengths) that can be within the threshold. Of
    what is left without the common start and end, the first and the last characters
    differ, so at most ``threshold - 2`` edits are between; of ``threshold - 1`` parts one
    is whole in the other line, moved by no more than the threshold."""
    # each is a column by way of a generator: expressions that build on each other would grow without end
    held = lambda df, name, column: df.withColumn(name, F.explode(F.array(column)))
    df = held(held(pairs, "x4", F.encode("x", "UTF-32")), "y4", F.encode("y", "UTF-32"))
    x, y, p, q, n, m = (F.col(c) for c in ("x4", "y4", "p", "q", "n", "m"))
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(STEPS))))
    df = held(df, "p", F.aggregate(steps, F.lit(0), lambda p, s: p + F.when(_part(x, p + 1, s) == _part(y, p + 1, s), s).otherwise(0)))
    ends = lambda q, s: (q + s <= F.least(n, m) - p) & (_part(x, n - q - s + 1, s) == _part(y, m - q - s + 1, s))
    df = held(df, "q", F.aggregate(steps, F.lit(0), lambda q, s: q + F.when(ends(q, s), s).otherwise(0)))
    a, b = n - p - q, m - p - q
    if threshold < 2:
        fine = (a <= threshold) & (b <= threshold)
    else:
        inner, parts = a - 2, threshold - 1
        same = []
        for i in range(parts):
            start, size = _segment(inner, i, parts)
            at = p + 1 + start
            same += [(at + off >= 1) & (_part(x, at, size) == _part(y, at + off, size)) for off in range(-threshold, threshold + 1)]
        fine = (a <= 2) | (b <= 2) | reduce(lambda s, t: s | t, same)
    return df.where((F.greatest("n", "m") >= 1 << STEPS) | fine).drop("x4", "y4", "p", "q")


def within(x: Column, y: Column, threshold: int) -> Column:
    """Whether two strings, given as arrays of characters, are within the threshold. Bit k of
    word d: with d edits, as many characters of x, plus k - threshold, as of y can have been
    consumed. The arrays must be columns of a table, as lambdas compute what they refer to
    anew at every step."""
    width = 2 * threshold + 1
    full, every = (1 << width) - 1, sum(1 << (width * d) for d in range(threshold + 1))
    n, m = F.size(x), F.size(y)

    def word(state: Column, d: int) -> Column:
        return F.shiftright(state, width * d).bitwiseAND(F.lit(full))

    def same(j: Column) -> Column:
        """For every diagonal, in each word, whether it goes on with equal characters."""
        return reduce(lambda p, q: p.bitwiseOR(q), [F.when(F.get(x, j + (k - threshold)) == F.get(y, j), F.lit(every << k)).otherwise(F.lit(0)) for k in range(width)])

    def advance(state: Column, same: Column) -> Column:
        # with equal characters; else one edit more: another character, one too few, one too many
        words = [word(state, 0).bitwiseAND(same)]
        for d in range(1, threshold + 1):
            before = word(state, d - 1)
            words.append(word(state, d).bitwiseAND(same).bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(words[-1], 1)).bitwiseAND(F.lit(full)))
        return reduce(lambda p, q: p.bitwiseOR(q), [F.shiftleft(w, width * d) for d, w in enumerate(words)])

    start = sum(sum(1 << (threshold + k) for k in range(d + 1)) << (width * d) for d in range(threshold + 1))
    last = F.aggregate(F.transform(F.sequence(F.lit(0), m - 1), same), F.lit(start), advance, lambda state: word(state, threshold))
    gap = n - m + threshold
    return (gap >= 0) & (gap < width) & (F.pmod(F.floor(last / F.pow(F.lit(2), gap)), F.lit(2)) == 1)


def near_lines(lines: DataFrame, threshold: int, min_near: int) -> DataFrame:
    """(lid): lines that an earlier one is near to. ``lines``: (lid, line, n), distinct, in
    order of lid."""
    near = lines.where(F.col("n") >= min_near)
    keys = line_keys(near, threshold, min_near)
    # most keys are of one line, or of no line's own segments: only the others' lines go on
    shared = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("own")).where("n > 1 and own").select("key"), "shared")
    marked = stored(perhaps_in(keys, shared, "key").join(shared, "key").groupBy("key", "lid").agg(F.max("own").alias("own")), "marked")
    wanted = perhaps_in(near, marked, "lid").join(marked.select("lid").distinct(), "lid", "left_semi")
    near = stored(wanted.select("lid", "n", "line", letters(F.col("line")).alias("letters")), "wanted")
    heads = marked.groupBy("key").agg(F.min(F.when(F.col("own"), F.col("lid"))).alias("first_own"), F.min("lid").alias("first_any")).where("first_own is not null")
    live = stored(marked.join(heads, "key").join(near.select("lid", "letters"), "lid"), "live")

    def verified(pairs: DataFrame) -> DataFrame:
        one = near.select(F.col("lid").alias("a"), F.col("line").alias("x"), "n")
        two = near.select(F.col("lid").alias("b"), F.col("line").alias("y"), F.col("n").alias("m"))
        cut = may_match(pairs.distinct().join(one, "a").join(two, "b"), threshold).select("b", "x", "y")
        # arrays pass through a generator, as lambdas compute what they refer to anew
        wide = cut.withColumn("x", F.explode(F.array(F.split("x", "")))).withColumn("y", F.explode(F.array(F.split("y", ""))))
        return wide.where(within(F.col("x"), F.col("y"), threshold)).select(F.col("b").alias("lid"))

    first = live.select(F.explode(F.array("first_own", F.when(F.col("own"), F.col("first_any")))).alias("a"), F.col("lid").alias("b")).where("a < b")
    settled = stored(verified(first).distinct(), "settled")
    open_ = live.join(settled, "lid", "left_anti").select("key", "first_own", "first_any", F.col("own").alias("own_b"), F.col("lid").alias("b"), F.col("letters").alias("of_b"))
    earlier = live.select("key", F.col("own").alias("own_a"), F.col("lid").alias("a"), F.col("letters").alias("of_a"))
    new = "a < b and (own_a or own_b) and a <> first_own and not (own_b and a = first_any)"
    rest = open_.join(earlier, "key").where(new).where(letters_apart(F.col("of_a"), F.col("of_b")) <= 2 * threshold).select("a", "b")
    return settled.union(verified(rest)).distinct()


def _place(row: Column, pos: Column) -> Column:
    """A number in order of (row, pos): 20 bits of the row's partition, 21 of its place there
    and 22 of the line's. More of them end the job; none is cut off."""
    part, at = F.shiftright(row, 33), row.bitwiseAND(F.lit((1 << 33) - 1))
    fits = (part < 1 << 20) & (at < 1 << 21) & (pos < 1 << 22)
    number = F.shiftleft(part, 43).bitwiseOR(F.shiftleft(at, 22)).bitwiseOR(pos.cast("long"))
    return F.when(fits, number).otherwise(F.raise_error(F.lit("more lines or rows than places have bits: use more partitions")).cast("long"))


def dedup_lines(docs: DataFrame, threshold: int = 2, min_near: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_equal, n_near, kept): how many lines an equal or else a near one
    precedes, and the text without them."""
    if not 0 <= threshold <= 4:
        raise ValueError(f"a threshold from 0 to 4 is needed, not {threshold}")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = stored(texts.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "rows")
    split = F.split("text", "\n")
    places = rows.select("row", F.posexplode(split).alias("pos", "line")).where(F.length(F.trim("line")) > 0)
    hashed = places.withColumns({"place": _place(F.col("row"), F.col("pos")), "h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("line"), F.col("line"), F.length("line"))})
    distinct = hashed.groupBy("h1", "h2").agg(F.min(F.struct("place", "row", "pos", "line")).alias("m"))
    lines = stored(distinct.select("h1", "h2", F.struct("m.row", "m.pos").alias("first"), F.col("m.line").alias("line"), F.length("m.line").alias("n"), F.col("m.place").alias("lid")), "lines")
    near = stored(near_lines(lines.select("lid", "line", "n"), threshold, min_near), "near")
    judged = lines.select("h1", "h2", "first", "lid").join(near.withColumn("near", F.lit(True)), "lid", "left").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    found = hashed.select("h1", "h2", "row", "pos").join(judged, ["h1", "h2"]).select("row", "pos", (F.struct("row", "pos") != F.col("first")).alias("equal"), "near").where("equal or near")
    gone = found.groupBy("row").agg(F.collect_list("pos").alias("gone"), F.count_if("equal").alias("n_equal"), F.count_if(~F.col("equal")).alias("n_near"))
    joined = rows.join(gone, "row", "left").withColumn("lines", F.explode(F.array(split)))  # a column, as lambdas compute what they refer to anew
    all_ = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.transform(F.array_except(all_, F.coalesce("gone", F.array().cast("array<int>"))), lambda i: F.get("lines", i))
    return joined.select(
        "doc_id", F.when(F.col("text") == "", 0).otherwise(F.size("lines")).cast("long").alias("n_lines"), F.coalesce("n_equal", F.lit(0)).alias("n_equal"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.array_join(kept, "\n").alias("kept")
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_equal", "n_near", F.sha2("kept", 256).alias("kept_sha256"))
