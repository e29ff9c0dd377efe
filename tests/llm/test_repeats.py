"""Substring dedup, Jaccard join, decontamination and line dedup against brute force."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import components, decontaminate, jaccard, lines, routing, substrings

#: Names that the operators use inside.
CLASHING = {"k1": 1, "row": "r", "n": 2, "h": 3, "at": 4, "component": 5, "bucket": 6, "t": 7, "key": 8, "x": 9, "unit": 10}


def clashes():
    return [F.lit(v).alias(k) for k, v in CLASHING.items()]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").select("*", *clashes())


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def odd_rows():
    return [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "One two"), (905, "one TWO"), (905, "one TWO"), (None, "a null id of its own here"), (None, None)]


def spaced(text):
    return re.findall("[^\\x20\\x09-\\x0D]+", text or "")


def brute_repeats(docs, size):
    found = [spaced(t) for _, t in docs]
    starts = Counter(tuple(w[i : i + size]) for w in found for i in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(docs, found):
        gone = {j for a in range(len(w) - size + 1) if starts[tuple(w[a : a + size])] > 1 for j in range(a, a + size)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("size", [3, 8, 35])
def test_substrings(spark, size):
    rng = random.Random(size)
    shared = [words(rng, n) for n in (size - 1, size, size + 1, 3 * size)]
    docs = [(i, " ".join(words(rng, rng.randrange(5, 90)) + shared[i % 4] + words(rng, rng.randrange(40)))) for i in range(40)]
    docs += [(100, "é " * 60), (101, "x y " * 50), (102, docs[3][1]), (102, docs[3][1]), (103, docs[3][1].replace(" ", " \n")), (104, " ".join(words(rng, 20_000)))]
    docs += [(110 + i, " ".join(rng.choice("ab") for _ in range(30))) for i in range(10)] + odd_rows()
    got = substrings.remove_repeats(frame(spark, docs), size).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats(docs, size)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_substrings_of_no_rows(spark):
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


def test_a_passage_of_most_rows_sends_one_entry_a_batch(spark, monkeypatch):
    rng = random.Random(5)
    passage, sent = words(rng, 60), []
    hits = substrings.hits
    monkeypatch.setattr(substrings, "hits", lambda entries, *a: sent.append(entries) or hits(entries, *a))
    docs = [(i, " ".join(words(rng, rng.randrange(9), 10**6) + passage + words(rng, 3, 10**6))) for i in range(1200)]
    df = frame(spark, docs).coalesce(2)
    got = substrings.remove_repeats(df, 35).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats(docs, 35)

    def entries(f):
        blobs = [bytes(r.blob) for r in f.where("bucket >= 0").collect()]
        return [routing.unpack([b], 2, 4 if f is sent[0] else 8)[3] for b in blobs]

    for f in sent:  # the hash of a window of the passage comes once from each batch
        most = Counter(h for part in entries(f) for h in part.tolist()).most_common(1)
        assert not most or most[0][1] <= 4


def shingles(text, size=5):
    w = spaced(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_components(docs):
    sets, root = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least.get(find(i))) for i, (d, s) in enumerate(zip([d for d, _ in docs], sets))], [find(i) for i in range(len(docs))]


def near_docs(seed):
    """Families whose members lie on both sides of the threshold, in chains too."""
    rng, docs = random.Random(seed), []
    for family in range(14):
        w = words(rng, rng.randrange(8, 120), 60 if family % 3 else 4000)
        for _ in range(rng.randrange(2, 7)):
            docs.append((rng.randrange(10_000), " ".join(w).title() if rng.random() < 0.2 else " ".join(w)))
            if rng.random() < 0.7:
                w = list(w)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                w = w[rng.randrange(1, 3) :] + words(rng, 1)
    docs += [(20_000 + i, docs[0][1]) for i in range(50)]
    return docs + odd_rows() + [(30_000, " ".join(words(rng, 20_000)))]


@pytest.mark.parametrize("seed, common", [(1, 32), (2, 2)])
def test_jaccard(spark, seed, common, monkeypatch):
    """Few rounds leave much to the matrix."""
    monkeypatch.setattr(jaccard, "COMMON", common)
    docs = near_docs(seed)
    want, _ = brute_components(docs)
    got = jaccard.jaccard_components(frame(spark, docs), rounds=seed).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_keep_one(spark):
    docs = near_docs(3)
    _, root = brute_components(docs)
    blank = [i for i, (_, t) in enumerate(docs) if not spaced(t)]
    df = frame(spark, docs)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    rows = Counter((r.doc_id, r.text) for r in kept.collect())
    groups = {}
    for i, (d, t) in enumerate(docs):
        if i not in blank:
            groups.setdefault(root[i], []).append((d is None, d))
    assert Counter(d for d, t in rows.elements() if spaced(t)) == Counter(min(g)[1] for g in groups.values())
    assert sum(n for (_, t), n in rows.items() if not spaced(t)) == len(blank)
    assert jaccard.keep_one(frame(spark, [])).count() == 0


def test_exact_threshold(spark):
    a = [f"a{i}" for i in range(11)]  # 7 shingles
    docs = [(1, " ".join(a)), (2, " ".join(a + ["b", "c"])), (3, " ".join(a + ["b", "c", "d"]))]  # 7/9, 7/10, 9/10
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame(spark, docs)).collect()}
    assert got == {1: 1, 2: 1, 3: 1}
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame(spark, docs), threshold=Fraction(7, 9)).collect()}
    assert got == {1: 1, 2: 1, 3: 1}
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame(spark, docs), threshold=Fraction(8, 9)).collect()}
    assert got == {1: 1, 2: 2, 3: 2}


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in list(root)}


def lettered(text):
    return [w for w in re.split("[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", (text or "").lower()) if w]


def brute_leaks(docs, items, size=5, threshold=0.75):
    def parts(w, k):
        return [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []

    out = {}
    for d, t in docs:
        w = lettered(t)
        for item, q in items:
            v = lettered(q)
            if not v or not w:
                continue
            k = min(size, len(v))
            want = Counter(parts(v, k))
            for s in range(max(1, len(w) - len(v) + 1)):
                have = Counter(parts(w[s : s + len(v)], k)) if len(w) >= k else Counter()
                common = sum((have & want).values())
                similarity = common / (sum(have.values()) + sum(want.values()) - common)
                if similarity >= threshold:
                    out[d, item] = max(out.get((d, item), 0), round(similarity, 6))
    return out


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, rng.randrange(8, 40), 5000))) for i in range(12)] + [(20, "three short words"), (21, None), (22, " ... "), (23, "ab " * 12)]
    docs = []
    for i in range(40):
        w = items[i % 12][1].split()
        for _ in range(i % 3):
            w[rng.randrange(len(w))] = f"z{rng.randrange(99)}"
        if i % 7 == 6:
            w = w[: len(w) // 2]
        text = words(rng, rng.randrange(60), 5000) + ([x.upper() + "," for x in w] if i % 2 else w) + words(rng, rng.randrange(60), 5000)
        docs.append((i, " ".join(text)))
    docs += [(50, "so, three SHORT words!"), (51, "three short"), (52, "ab " * 40), (53, items[0][1]), (54, " ".join(words(rng, 20_000, 5000)) + " " + items[1][1]), (55, f"{items[2][1]}\n{items[2][1]} and {items[3][1]}")] + odd_rows()
    df = frame(spark, docs)
    bench = spark.createDataFrame(items, "item_id long, text string").select("*", *clashes())
    found = decontaminate.find_leaks(df, bench).collect()
    assert {(r.doc_id, r.item): round(r.similarity, 6) for r in found} == brute_leaks(docs, items)
    assert all(r.hamming <= 20 for r in found)
    kept = decontaminate.keep_clean(df, bench)
    bad = {d for d, _ in brute_leaks(docs, items)}
    assert kept.columns == df.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(x for x in docs if x[0] not in bad)
    for none in (decontaminate.find_leaks(frame(spark, []), bench), decontaminate.find_leaks(df, bench.limit(0))):
        assert none.count() == 0
    assert decontaminate.keep_clean(df, bench.limit(0)).count() == len(docs)


def test_large_benchmark_is_joined_by_shuffles(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST", 0)
    test_decontamination(spark)


@pytest.mark.parametrize("most", [500_000, 0])
def test_leaks_with_moved_parts(spark, monkeypatch, most):
    """Halves swapped and sentences moved: no offset of a shingle lays the item over its best window."""
    monkeypatch.setattr(decontaminate, "MOST", most)
    rng = random.Random(11)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(n))) for i, n in enumerate((38, 50, 59, 120))] + [(4, "ab cd ef gh ij " * 8)]
    docs = []
    for i, q in items[:4]:
        w, n = q.split(), len(q.split())
        moved = w[n // 3 :] + w[: n // 3]
        for j, part in enumerate((w[n // 2 :] + w[: n // 2], moved, w[: n // 4] + w[n // 2 :] + w[n // 4 : n // 2])):
            docs.append((10 * i + j, " ".join(words(rng, 90, 5000) + part + words(rng, 90, 5000))))
            docs.append((10 * i + j + 5, " ".join(part)))
    docs += [(100, "ab cd ef gh ij " * 30), (101, " ".join(words(rng, 70, 5000)) + " " + "ij ab cd ef gh " * 9)] + odd_rows()
    want = brute_leaks(docs, items)
    assert {(0, 0), (10, 1), (20, 2), (100, 4), (101, 4)} <= want.keys()
    df, bench = frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_leaks(df, bench).collect()
    assert {(r.doc_id, r.item): round(r.similarity, 6) for r in found} == want
    kept = decontaminate.keep_clean(df, bench)
    bad = {d for d, _ in want}
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(x for x in docs if x[0] not in bad)


def edits(a, b):
    while a and b and a[0] == b[0] and a[-1] == b[-1] and min(len(a), len(b)) > 500:  # equal ends of very long lines
        a, b = a[1:], b[1:]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def brute_lines(docs, threshold, min_near):
    earlier, out = [], []
    for d, text in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        own = (text or "").split("\n")
        kept, equal, near = [], 0, 0
        for line in own:
            if not line.strip(" "):
                kept.append(line)
                continue
            if line in earlier:
                equal += 1
            elif any(min(len(x), len(line)) >= min_near and abs(len(x) - len(line)) <= threshold and edits(x, line) <= threshold for x in earlier):
                near += 1
            else:
                kept.append(line)
            earlier.append(line)
        out.append((d, len(own) if text else 0, equal, near, "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("threshold, min_near", [(2, 24), (1, 6), (3, 12)])
def test_lines(spark, threshold, min_near):
    rng = random.Random(threshold)
    base = ["".join(rng.choice("abcde éß😀") for _ in range(rng.randrange(min_near - 3, min_near + 30))) for _ in range(12)]
    docs = []
    for d in range(30):
        own = []
        for _ in range(rng.randrange(1, 7)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
                at = rng.randrange(len(line))
                line[at : at + rng.choice([0, 1, 1])] = rng.choice(["", "x", "q"])
            own.append("".join(line))
        docs.append((d, "\n".join(own + ["", "  ", "short"][: rng.randrange(4)])))
    docs += [(40, None), (41, ""), (42, "\n\n"), (None, "first of all lines, as its id is null\nshort"), (43, "a" * 20_000), (44, "a" * 20_001), (45, "b" * 30 + "\n" + "b" * 31)]
    got = lines.dedup_lines(frame(spark, docs), threshold, min_near).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_equal, r.n_near, r.kept) for r in got) == brute_lines(docs, threshold, min_near)


def test_lines_of_repeated_rows(spark):
    got = lines.dedup_lines(frame(spark, [(1, "a line\n\nanother"), (1, "a line\n\nanother")])).collect()
    assert sorted(r.kept for r in got) == ["", "a line\n\nanother"]
    assert lines.dedup_lines(frame(spark, [])).count() == 0


def test_lines_keys_are_compiled_and_not_stored(spark, monkeypatch):
    # a method of 8000 bytes or more is interpreted by the JVM
    sizes, stored = {}, lines.stored

    def watched(df, name):
        text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
        sizes[name] = max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text)), default=0)
        return stored(df, name)

    monkeypatch.setattr(lines, "stored", watched)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines.dedup_lines(frame(spark, [(1, "a line of more than twenty-four characters"), (2, "a line of more then twenty-four characters")]))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "entries" not in sizes and 0 < sizes["shared"] < 8000


def test_lines_that_differ_in_rare_letters_are_no_candidates(spark):
    text = "on and then the other one said that it has been so ever since "
    made = [text[:i] + w + text[i:] for i, w in ((5, "ymcw"), (20, "bdkg"), (40, "vxqf"), (55, "lpuz"))]
    near = spark.createDataFrame([(i, x) for i, x in enumerate(made)], "i int, x string").withColumn("c", lines.letters(F.col("x")))
    pairs = near.alias("a").join(near.alias("b"), F.col("a.i") < F.col("b.i"))
    assert pairs.where(lines.letters_apart(F.col("a.c"), F.col("b.c")) <= 4).count() == 0


def test_lines_filter_of_bits_loses_nothing(spark):
    df, found = spark.range(3000), spark.range(0, 3000, 50)
    got = {r.id for r in lines.perhaps_in(df, found, "id").collect()}
    assert set(range(0, 3000, 50)) <= got and len(got) < 200
