"""Mixing sources to target weights by hierarchical budgets.

Leaves are (domain, language, source). A total budget of tokens falls down the tree by
weights among siblings. No node gets more than its leaves can give (``max_epochs`` times
their tokens): what one cannot take goes to its siblings, as their weights stand, until
all are full; as a node's own limit is the sum of its leaves', only then does anything
pass to its parent's siblings. Each level is one window over siblings, ordered by how
soon they fill. Every leaf then takes whole epochs, and of the next the prefix, in an
order seeded by epoch, whose tokens fit. That prefix is found by sums over hash ranges;
rows are sorted only in the one range where it ends, so a leaf of any size is no one task.

Defined results. Null text: no tokens; such rows are taken where the order reaches them. A
null domain, language or source is a node of its own. Repeated rows: one unit, taken
together. Weights that are missing: ``default_weight``. No rows: nothing.
A leaf without tokens: all its rows, ``min_epochs`` times.
Other columns are ignored by ``plan`` and kept by ``mix``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.shared import table

LEVELS = ["domain", "lang", "source"]
DIGITS = 3  # hash digits (of 16 values each) of a range


@dataclass(frozen=True)
class Mix:
    """``budget``: share of all tokens (1.0: as many as there are); ``weights``: by level and
    name; every leaf gets ``min_epochs`` before weights deal out the rest."""

    budget: float = 0.75
    weights: dict[str, dict[str, float]] = field(default_factory=dict)
    default_weight: float = 1.0
    min_epochs: int = 0
    max_epochs: int = 2
    seed: int = 7


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """For tables without domains: four of them, by the number that ends a source's name."""
    number = F.regexp_extract(source, "([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (number.cast("long") % 4).cast("string"))).otherwise("other")


def _weight(level: str, p: Mix) -> Column:
    known = p.weights.get(level, {})
    if not known:
        return F.lit(float(p.default_weight))
    names = F.create_map(*(x for k, w in known.items() for x in (F.lit(k), F.lit(float(w)))))
    return F.coalesce(names[F.col(level)], F.lit(float(p.default_weight)))


def unit_of(id_col: str, text_col: str, domain: Column) -> Column:
    """Names a row; equal rows share it."""
    parts = (F.col(id_col), F.md5(F.col(text_col).cast("string")), domain, F.col("lang"), F.col("source"))
    return F.md5(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("\x01")) for c in parts)))


def units(docs: DataFrame, domain: Column, id_col: str, text_col: str) -> DataFrame:
    """(domain, lang, source, tokens, unit) of every row."""
    return docs.select(domain.cast("string").alias("domain"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), tokens_of(F.col(text_col).cast("string")).alias("tokens"), unit_of(id_col, text_col, domain).alias("unit"))


def _join(nodes: DataFrame, given: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes with the share of what has the same keys."""
    names = {k: f"of_{k}" for k in keys}
    return nodes.join(given.withColumnsRenamed(names), [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()]).drop(*names.values())


def budgets(leaves: DataFrame, p: Mix) -> DataFrame:
    """Adds ``take`` (tokens) to (domain, lang, source, tokens)."""
    room = p.max_epochs - p.min_epochs
    total = leaves.agg(F.sum("tokens").alias("total")).select((F.greatest(F.lit(0.0), F.col("total") * (p.budget - p.min_epochs))).alias("share"))
    limits = leaves.select(*LEVELS, F.col("tokens"), (F.col("tokens") * float(room)).alias("limit"))
    parent, given = [], total
    for depth, level in enumerate(LEVELS):
        keys = LEVELS[: depth + 1]
        node = limits.groupBy(*keys).agg(F.sum("limit").alias("limit")).withColumn("weight", _weight(level, p))
        if depth:
            node = _join(node, given, parent)
        else:
            node = node.join(F.broadcast(given))  # a table of one row
        siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        order = siblings.orderBy(F.col("limit") / F.col("weight"), F.col(level))
        before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
        node = node.withColumn("rise", (F.col("share") - before) / after)  # if all before are full
        node = node.withColumn("full", F.col("limit") <= F.col("rise") * F.col("weight"))
        node = node.withColumn("pos", F.row_number().over(order)).withColumn("level", F.min(F.when(~F.col("full"), F.struct("pos", "rise"))).over(siblings)["rise"])
        given = node.select(*keys, F.when(F.col("level").isNull() | F.col("full"), F.col("limit")).otherwise(F.col("level") * F.col("weight")).alias("share"))
        parent = keys
    return _join(limits, given, LEVELS).select(*LEVELS, "tokens", (F.floor(F.round("share", 3)) + F.col("tokens") * p.min_epochs).cast("long").alias("take"))


def plan(docs: DataFrame, p: Mix = Mix(), domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(unit, copies): how many epochs take each unit."""
    domain = domain_of(F.col("source")) if domain is None else domain
    unit = units(docs, domain, id_col, text_col).groupBy("unit", *LEVELS).agg(F.sum("tokens").alias("tokens"))
    leaf = F.xxhash64(*(F.coalesce(F.col(k), F.lit("\x01")) for k in LEVELS), *(F.col(k).isNull() for k in LEVELS))
    leaves = budgets(unit.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), p)
    some = F.col("tokens") > 0  # a leaf without tokens takes its least epochs, and no prefix
    leaves = leaves.withColumns({"leaf": leaf, "epochs": F.when(some, F.floor(F.col("take") / F.col("tokens"))).otherwise(p.min_epochs), "rest": F.when(some, F.col("take") % F.col("tokens")).otherwise(-1)})
    own = unit.select("unit", "tokens", leaf.alias("leaf"))
    epoch = leaves.select("leaf", "epochs", "rest")
    placed = own.join(epoch, "leaf").withColumn("place", F.md5(F.concat_ws("|", F.lit(str(p.seed)), F.col("epochs").cast("string"), F.col("unit")))).withColumn("range", F.substring("place", 1, DIGITS))
    ranges = placed.groupBy("leaf", "range").agg(F.sum("tokens").alias("have"), F.max("rest").alias("rest"))
    before = F.coalesce(F.sum("have").over(Window.partitionBy("leaf").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("leaf", "range", before.alias("before"), (before + F.col("have")).alias("through"))
    judged = placed.join(ranges, ["leaf", "range"])
    whole = judged.where("through <= rest or before > rest").select("unit", (F.col("epochs") + (F.col("through") <= F.col("rest")).cast("int")).alias("copies"))
    cut = judged.where("through > rest and before <= rest")
    so_far = F.col("before") + F.sum("tokens").over(Window.partitionBy("leaf", "range").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return whole.union(cut.withColumn("so_far", so_far).select("unit", (F.col("epochs") + (F.col("so_far") <= F.col("rest")).cast("int")).alias("copies")))


def mix(docs: DataFrame, p: Mix = Mix(), domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as its unit is taken. Ties and nulls as above."""
    domain = domain_of(F.col("source")) if domain is None else domain
    taken = plan(docs, p, domain, id_col, text_col).where("copies > 0")
    row = F.struct(*(docs[c] for c in docs.columns))
    named = docs.select(row.alias("row"), unit_of(id_col, text_col, domain).alias("unit"))
    return named.join(taken, "unit").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


PRODUCTION = Mix(0.75, {"domain": {"d0": 0.4, "d1": 0.3, "d2": 0.2, "d3": 0.1}, "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}})


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    domain = domain_of(F.col("source"))
    rows = docs.select("doc_id", domain.alias("domain"), "lang", "source", tokens_of(F.col("text")).alias("n_tokens"), unit_of("doc_id", "text", domain).alias("unit"))
    return rows.join(plan(docs, PRODUCTION), "unit", "left").select("doc_id", "domain", "lang", "source", "n_tokens", F.coalesce("copies", F.lit(0)).cast("long").alias("copies"))


def _level(name: str, parent: str, keys: list[str], weights: dict[str, float]) -> str:
    """SQL of one level: ``name`` from ``parent`` (its keys and share) and the leaves."""
    own, up = ", ".join(keys), keys[:-1]
    w = "CASE " + " ".join(f"WHEN {keys[-1]} = '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1.0 END" if weights else "1.0"
    on = " AND ".join(f"n.{k} IS NOT DISTINCT FROM p.{k}" for k in up) or "true"
    part = f"PARTITION BY {', '.join(up)} " if up else ""
    return f"""
{name}_n AS (SELECT {own}, sum(tokens * 2.0)::DOUBLE AS lim, ({w})::DOUBLE AS w FROM leaves GROUP BY {own}),
{name}_o AS (SELECT n.*, p.share FROM {name}_n n JOIN {parent} p ON {on}),
{name}_r AS (SELECT *, row_number() OVER ({part}ORDER BY lim / w, {keys[-1]} NULLS FIRST) AS pos FROM {name}_o),
{name}_x AS (SELECT *, (share - coalesce(sum(lim) OVER ({part}ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER ({part}ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rise FROM {name}_r),
{name}_y AS (SELECT *, lim <= rise * w AS isfull FROM {name}_x),
{name}_z AS (SELECT *, arg_min(rise, pos) FILTER (NOT isfull) OVER ({part or ''}) AS lev FROM {name}_y),
{name} AS (SELECT {own}, CASE WHEN lev IS NULL OR isfull THEN lim ELSE lev * w END AS share FROM {name}_z)"""


OP8_SQL = (
    r"""
WITH d AS (SELECT doc_id, lang, source, CASE WHEN regexp_extract(source, '([0-9]+)$', 1) <> '' THEN 'd' || (CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 4) ELSE 'other' END AS domain,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_tokens, coalesce(md5(text), chr(1)) AS t FROM documents),
u AS (SELECT *, md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), chr(1)), t, domain, coalesce(lang, chr(1)), coalesce(source, chr(1)))) AS unit FROM d),
units AS (SELECT unit, domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM u GROUP BY ALL),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM units GROUP BY ALL),
root AS (SELECT sum(tokens) * 0.75::DOUBLE AS share FROM leaves),"""
    + _level("l1", "root", ["domain"], PRODUCTION.weights["domain"])
    + ","
    + _level("l2", "l1", ["domain", "lang"], PRODUCTION.weights["lang"])
    + ","
    + _level("l3", "l2", ["domain", "lang", "source"], {})
    + """,
goal AS (SELECT v.*, CAST(floor(round(l3.share, 3)) AS BIGINT) AS take FROM leaves v JOIN l3 ON v.domain IS NOT DISTINCT FROM l3.domain AND v.lang IS NOT DISTINCT FROM l3.lang AND v.source IS NOT DISTINCT FROM l3.source WHERE v.tokens > 0),
placed AS (SELECT units.*, take // goal.tokens AS epochs, take % goal.tokens AS rest, md5('7|' || (take // goal.tokens) || '|' || unit) AS place
    FROM units JOIN goal ON units.domain IS NOT DISTINCT FROM goal.domain AND units.lang IS NOT DISTINCT FROM goal.lang AND units.source IS NOT DISTINCT FROM goal.source),
done AS (SELECT unit, epochs + CASE WHEN sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS copies FROM placed)
SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(coalesce(copies, 0) AS BIGINT) AS copies FROM u LEFT JOIN done USING (unit)
"""
)
