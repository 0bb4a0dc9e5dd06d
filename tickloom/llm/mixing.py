"""Mixing sources to target weights, in DataFrame functions alone.

The token budget flows from the root through domains and languages to sources. A node's capacity is what its leaves hold in
`max_epochs` epochs. Among siblings a budget is shared by weight; who cannot take its share is filled up and the rest is
shared again among the others (so siblings take a shortage before any ancestor does, and no node is offered more than it
holds). A leaf takes whole epochs and then, in the last epoch's seeded order, the prefix that holds its remaining tokens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.types import MapType

from tickloom.llm.common import small, stored

LEVELS = ("domain", "lang", "source")
#: Characters of the seeded hash that name a bucket of a leaf; only the bucket at the cut is sorted.
BUCKET = 3
_ALL = Window.unboundedPreceding


def n_tokens(text: Column) -> Column:
    """Words between white space; null counts as none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def seeded(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("-"))).cast("binary"))


def share(nodes: DataFrame, parent: Sequence[str], budget: str = "budget") -> DataFrame:
    """Budgets of sibling nodes: columns parent..., name, weight, capacity and the parent's `budget` give `got`.

    Nodes are taken by capacity per weight: those that fill up come first, and each is cut off at its capacity while its share
    of what is left exceeds it. Whole tokens; what rounding leaves goes to the first nodes that still have room. All in exact
    integers (decimals), so every engine gets the same budgets.
    """
    big = lambda c: c.cast("decimal(38,0)")
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), "name")
    before, after = order.rowsBetween(_ALL, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.col(budget) - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    weight = F.sum("weight").over(after)
    out = nodes.withColumn("_left", left).withColumn("_weight", weight)
    out = out.withColumn("_full", big(F.col("_left")) * big(F.col("weight")) >= big(F.col("capacity")) * big(F.col("_weight")))
    # The nodes that fill up are a prefix of this order; the rest share what they leave.
    out = out.withColumn("_prefix", F.min(F.col("_full").cast("int")).over(order.rowsBetween(_ALL, 0)))
    whole = Window.partitionBy(*parent)
    filled = F.sum(F.when(F.col("_prefix") == 1, F.col("capacity")).otherwise(0)).over(whole)
    open_weight = F.sum(F.when(F.col("_prefix") == 0, F.col("weight")).otherwise(0)).over(whole)
    rest = big(F.col(budget) - filled)
    base = F.when(F.col("_prefix") == 1, F.col("capacity")).otherwise(F.expr("CAST(_rest * CAST(weight AS DECIMAL(38,0)) DIV _open AS BIGINT)"))
    out = out.withColumn("_rest", rest).withColumn("_open", big(F.greatest(open_weight, F.lit(1)))).withColumn("_base", base)
    room = F.col("capacity") - F.col("_base")
    spare = F.least(F.col(budget), F.sum("capacity").over(whole)) - F.sum("_base").over(whole)
    out = out.withColumn("_room", room).withColumn("_spare", spare)
    taken = F.coalesce(F.sum("_room").over(before), F.lit(0))
    more = F.greatest(F.lit(0), F.least(F.col("_room"), F.col("_spare") - taken))
    return out.withColumn("got", (F.col("_base") + more).cast("long")).drop("_left", "_weight", "_full", "_prefix", "_rest", "_open", "_base", "_room", "_spare")


def budgets(leaves: DataFrame, weights: dict[str, Column], total: Column, max_epochs: int) -> DataFrame:
    """(domain, lang, source, tokens) to the same leaves with `budget`; `weights` gives each level's weight as a Column."""
    nodes = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    tree = nodes.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
    root = tree.agg(total.cast("long").alias("budget"))
    top = share(tree.crossJoin(F.broadcast(root)).withColumn("name", F.col("domain")).withColumn("weight", weights["domain"]).withColumn("_root", F.lit(0)), ["_root"])
    top = top.select("domain", F.col("got").alias("budget"))
    mid = nodes.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).join(top, "domain").withColumn("name", F.col("lang")).withColumn("weight", weights["lang"])
    mid = share(mid, ["domain"]).select("domain", "lang", F.col("got").alias("budget"))
    low = nodes.join(mid, ["domain", "lang"]).withColumn("name", F.col("source")).withColumn("weight", weights["source"])
    return share(low, ["domain", "lang"]).select(*LEVELS, "tokens", F.col("got").alias("budget"))


def select(keyed: DataFrame, planned: DataFrame, seed: int) -> DataFrame:
    """Rows doc_id, domain, lang, source, n_tokens (and columns to carry) and leaf budgets to taken rows with epoch and take.

    Whole epochs repeat every row. In the cut epoch, buckets of the seeded hash below the cut are taken whole, the bucket at
    the cut is ordered and its rows take what is left, and later ones drop out: a hot leaf is never sorted whole.
    """
    plan = planned.filter("budget > 0").withColumn("whole", F.expr("budget DIV tokens").cast("int")).withColumn("part", F.expr("budget % tokens"))
    rows = keyed.filter("n_tokens > 0").join(plan.select(*LEVELS, "whole", "part"), list(LEVELS))
    full = rows.filter("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1))).withColumn("take", F.col("n_tokens"))
    last = rows.filter("part > 0").withColumn("epoch", F.col("whole")).withColumn("_h", seeded(seed, F.col("epoch"), F.col("doc_id"))).withColumn("_b", F.substring("_h", 1, BUCKET))
    sums = last.groupBy(*LEVELS, "_b", "part").agg(F.sum("n_tokens").alias("s"))
    below = F.coalesce(F.sum("s").over(Window.partitionBy(*LEVELS).orderBy("_b").rowsBetween(_ALL, -1)), F.lit(0))
    sums = sums.withColumn("_below", below).filter("_below < part").select(*LEVELS, "_b", "_below", (F.col("_below") + F.col("s") <= F.col("part")).alias("_whole"))
    last = last.join(sums, [*LEVELS, "_b"])
    inside = last.filter("_whole").withColumn("take", F.col("n_tokens"))
    carried = [c for c in keyed.columns if c not in ("doc_id", *LEVELS, "n_tokens")]
    order = Window.partitionBy(*LEVELS, "_b").orderBy("_h", "doc_id", "n_tokens", *carried).rowsBetween(_ALL, -1)
    at_cut = last.filter("NOT _whole").withColumn("_at", F.col("_below") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    at_cut = at_cut.withColumn("take", F.least(F.col("n_tokens"), F.col("part") - F.col("_at"))).filter("take > 0")
    out = ["doc_id", *LEVELS, "n_tokens", *carried, "epoch", "take"]
    return full.select(*out).unionByName(inside.select(*out)).unionByName(at_cut.select(*out))


#: Default tree: sources fall into three domains by their number; weights are whole numbers.
def default_domain(source: Column) -> Column:
    number = F.coalesce(F.regexp_extract(source, "([0-9]+)$", 1).try_cast("long"), F.lit(0))
    return F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("code")), (number % 3 + 1).cast("int"))


DOMAIN_WEIGHTS = {"web": 5, "books": 3, "code": 2}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 2}


def weight_of(column: str, weights: dict[str, int], other: int = 1) -> Column:
    out = F.lit(other)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def default_weights() -> dict[str, Column]:
    return {"domain": weight_of("domain", DOMAIN_WEIGHTS), "lang": weight_of("lang", LANG_WEIGHTS), "source": F.lit(1).cast("long")}


def mix(docs: DataFrame, target_share: tuple[int, int] = (3, 4), max_epochs: int = 2, seed: int = 10) -> DataFrame:
    """One row a taken document and epoch: doc_id, domain, lang, source, n_tokens, epoch, take (tokens of its prefix).

    The budget is the share `target_share` (a fraction) of all tokens. Null languages and sources are leaves named "-"; null
    and empty texts hold no tokens and are not taken. Repeated rows count and are taken each on their own. A leaf that cannot
    meet its budget in `max_epochs` epochs passes the rest to its siblings, then upwards. An empty table gives no rows.
    Columns other than doc_id, text, lang and source are not read.
    """
    return _mixed(_keyed(docs), target_share, max_epochs, seed)


def _keyed(docs: DataFrame, *carried: Column) -> DataFrame:
    source = F.coalesce("source", F.lit("-"))
    keys = ["doc_id", default_domain(source).alias("domain"), F.coalesce("lang", F.lit("-")).alias("lang"), source.alias("source"), n_tokens(F.col("text")).alias("n_tokens")]
    return stored(docs.select(*keys, *carried), "tokens")


def _mixed(keyed: DataFrame, target_share: tuple[int, int], max_epochs: int, seed: int) -> DataFrame:
    leaves = keyed.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")).filter("tokens > 0")
    total = F.expr(f"sum(tokens) * {target_share[0]} DIV {target_share[1]}")
    return select(keyed, stored(budgets(leaves, default_weights(), total, max_epochs), "budgets"), seed)


def prefix_of(text: Column, take: Column) -> Column:
    """The first `take` tokens of a text with the white space between them as it is."""
    pieces = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    return F.array_join(F.slice(pieces, F.lit(1), take.cast("int")), "")


def mixture(docs: DataFrame, target_share: tuple[int, int] = (3, 4), max_epochs: int = 2, seed: int = 10) -> DataFrame:
    """The mixed documents themselves, with the columns of docs: a row an epoch, texts cut to their taken prefix.

    n_chars, where there is one, is that of the cut text. Rows are taken one by one, also those without doc_id and those that
    share one: a row is known by a hash of all its columns (but maps), and equal rows stand for each other. Null and empty texts
    hold no tokens and are not taken; an empty table stays empty; columns may have any names.
    """
    columns = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, MapType)]
    mark = F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns[::-1]).alias("b"))
    keyed = _keyed(docs, mark.alias("mark"))
    takes = _mixed(keyed, target_share, max_epochs, seed).groupBy("mark", "n_tokens", "epoch", "take").agg(F.count("*").alias("times"))
    rows = docs.select(mark.alias("mark"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    equal = stored(keyed.groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1").select("mark"), "equal")
    if n := equal.count():
        one = rows.join(small(equal, n), "mark", "left_semi").groupBy("mark").agg(F.first("row").alias("row"))
        rows = rows.join(small(equal, n), "mark", "left_anti").unionByName(one)
    rows = rows.join(takes, "mark").withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    cut = F.col("take") < F.col("n_tokens")
    text = F.when(cut, prefix_of(F.col("row.text"), F.col("take"))).otherwise(F.col("row.text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.char_length(text)).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def sql(target_share: tuple[int, int] = (3, 4), max_epochs: int = 2, seed: int = 10) -> str:
    """The same mixture in DuckDB SQL, with whole-leaf windows."""
    case = lambda c, ws: "CASE " + " ".join(f"WHEN {c} = '{k}' THEN {v}" for k, v in ws.items()) + " ELSE 1 END"

    def level(name: str, source: str, parent: str, column: str, weight: str, keep: str) -> str:
        over = f"PARTITION BY {parent} ORDER BY capacity / weight, {column}"
        return f"""
{name}_w AS (SELECT *, ({weight})::HUGEINT AS weight FROM {source}),
{name}_f AS (SELECT *, (budget - coalesce(sum(capacity) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight >= capacity::HUGEINT * sum(weight) OVER ({over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fits FROM {name}_w),
{name}_p AS (SELECT *, min(fits::INT) OVER ({over} ROWS UNBOUNDED PRECEDING) AS prefix FROM {name}_f),
{name}_b AS (SELECT *, CASE WHEN prefix = 1 THEN capacity ELSE ((budget - sum(CASE WHEN prefix = 1 THEN capacity ELSE 0 END) OVER (PARTITION BY {parent})) * weight) // greatest(1, sum(CASE WHEN prefix = 0 THEN weight ELSE 0 END) OVER (PARTITION BY {parent})) END AS base FROM {name}_p),
{name}_s AS (SELECT *, least(budget, sum(capacity) OVER (PARTITION BY {parent})) - sum(base) OVER (PARTITION BY {parent}) AS spare FROM {name}_b),
{name} AS (SELECT {keep}, base + greatest(0, least(capacity - base, spare - coalesce(sum(capacity - base) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS budget FROM {name}_s)"""

    return rf"""
WITH keyed AS (SELECT doc_id, ['web', 'books', 'code'][(coalesce(try_cast(regexp_extract(coalesce(source, '-'), '([0-9]+)$', 1) AS BIGINT), 0) % 3 + 1)::INT] AS domain, coalesce(lang, '-') AS lang, coalesce(source, '-') AS source,
                      len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::HUGEINT AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, sum(n_tokens)::HUGEINT * {max_epochs} AS capacity FROM keyed GROUP BY ALL HAVING sum(n_tokens) > 0),
root AS (SELECT sum(tokens) * {target_share[0]} // {target_share[1]} AS budget FROM leaf),
d0 AS (SELECT domain, sum(capacity)::HUGEINT AS capacity, any_value(budget)::HUGEINT AS budget FROM leaf, root GROUP BY domain),{level("d1", "d0", "1", "domain", case("domain", DOMAIN_WEIGHTS), "domain")},
m0 AS (SELECT leaf.domain, lang, sum(capacity)::HUGEINT AS capacity, any_value(budget)::HUGEINT AS budget FROM leaf JOIN d1 USING (domain) GROUP BY ALL),{level("m1", "m0", "domain", "lang", case("lang", LANG_WEIGHTS), "domain, lang")},
s0 AS (SELECT leaf.*, budget::HUGEINT AS budget FROM leaf JOIN m1 USING (domain, lang)),{level("s1", "s0", "domain, lang", "source", "1", "domain, lang, source, tokens")},
plan AS (SELECT *, budget // tokens AS whole, budget % tokens AS part FROM s1 WHERE budget > 0),
rows_ AS (SELECT k.*, whole, part FROM keyed k JOIN plan USING (domain, lang, source) WHERE n_tokens > 0),
cut AS (SELECT *, whole AS epoch, part - coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}:' || whole::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '-')), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM rows_ WHERE part > 0)
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, unnest(range(whole::BIGINT))::INT AS epoch, n_tokens::BIGINT AS take FROM rows_ WHERE whole > 0
UNION ALL SELECT doc_id, domain, lang, source, n_tokens::BIGINT, epoch::INT, least(n_tokens, room)::BIGINT FROM cut WHERE room > 0
"""
