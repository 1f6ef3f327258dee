"""Mixing sources to target weights over a domain - language - source tree, in DataFrame operations only.

1. One scan counts words; tokens are summed by leaf with partial sums in each task.
2. A node can take ``max_epochs`` times the tokens below it. From the root down, a node's budget is shared among its
   children by weight; children that cannot take their share are filled, and what they leave goes to their siblings
   by weight. As a node's limit is the sum below it, only what all siblings cannot take reaches other branches.
   A weight of 0 shuts a branch. All amounts are integers; a division drops its remainder.
3. A leaf with budget b and T tokens repeats every document b div T times and takes a prefix of the next epoch's
   seeded order with at most b mod T tokens. The order's leading two digits cut it into 256 cells: a running sum over
   them finds the cell that holds the cut. A cell of more than ``sort_rows`` documents is cut again by its next two
   digits, until few documents are left to sort; so no task gets more than 256 rows or those of a leaf.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.llm.common import lookup, write_shared

LEAF = ["domain", "lang", "source"]


@dataclass(frozen=True)
class Mix:
    """Integer weights by name (1 where none is given, 0 to take nothing), domains by source, and the budget in percent of all tokens."""

    domains: dict[str, str] = field(default_factory=lambda: {f"src{i}": "web" if i < 10 else "books" for i in range(20)})
    other_domain: str = "other"
    domain_weights: dict[str, int] = field(default_factory=lambda: {"web": 2, "books": 3})
    lang_weights: dict[str, int] = field(default_factory=lambda: {"en": 5, "fr": 2, "de": 2, "es": 1})
    source_weights: dict[str, int] = field(default_factory=dict)
    budget_percent: int = 80
    max_epochs: int = 2
    seed: int = 11
    sort_rows: int = 2000

    def __post_init__(self):
        weights = [*self.domain_weights.values(), *self.lang_weights.values(), *self.source_weights.values()]
        if any(w < 0 for w in weights) or self.budget_percent < 0 or self.max_epochs < 0:
            raise ValueError("weights, the budget and the number of epochs must not be negative")


def _case(column, names: dict, default):
    out = None
    for k, v in names.items():
        out = (F.when if out is None else out.when)(column == k, F.lit(v))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def _share_out(nodes: DataFrame, parent: list[str], child: str, budgets: DataFrame | None, total: int | None) -> DataFrame:
    """Budgets of the children of each parent; ``nodes`` has the parent's columns, child, w and cap (0 where w is)."""
    if budgets is None:
        x = nodes.withColumn("b", F.lit(total).cast("long"))
    else:
        x = nodes.join(budgets.select(*parent, F.col("budget").alias("b")), parent)
    by = Window.partitionBy(*(parent or [F.lit(0)]))
    order = by.orderBy(F.col("cap") / F.greatest("w", F.lit(1)), child)
    x = x.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("weight_left", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    x = x.withColumn("full", F.expr("(b - before) * w >= cap * weight_left"))
    x = x.withColumn("b_left", F.col("b") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(by)).withColumn("w_left", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(by))
    return x.withColumn("budget", F.expr("case when full then cap else b_left * w div w_left end")).select(*parent, child, "budget")


def mix_sources(docs: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, domain, lang, source, n_tokens, copies (0: left out).

    Null languages and sources count as empty ones, null texts as texts without tokens; in a leaf without tokens every
    row gets no copy. Rows that repeat an id are taken one by one, those with fewer tokens first. Other columns are
    ignored, whatever their names. No rows give no rows.
    """
    found = _mixed(docs, mix or Mix(), F.lit(None).cast("long"), id_col, text_col, lang_col, source_col)
    return found.select(F.col("id").alias(id_col), *LEAF, "n_tokens", "copies")


def _mixed(docs: DataFrame, mix: Mix, number, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    source = F.coalesce(F.col(source_col), F.lit(""))
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows, _ = write_shared(docs.select(F.col(id_col).alias("id"), number.alias("number"), _case(source, mix.domains, mix.other_domain).alias("domain"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), source.alias("source"), words.alias("n_tokens")), "tokens")
    leaves = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_rows")).withColumn("w", _case(F.col("source"), mix.source_weights, 1))
    leaves = leaves.withColumn("cap", F.when(F.col("w") > 0, F.col("tokens") * mix.max_epochs).otherwise(0))
    leaves, _ = write_shared(leaves, "leaves")
    total = (leaves.agg(F.sum("tokens")).first()[0] or 0) * mix.budget_percent // 100

    def above(nodes: DataFrame, names: list[str], weights: dict) -> DataFrame:
        x = nodes.groupBy(*names).agg(F.sum("cap").alias("cap")).withColumn("w", _case(F.col(names[-1]), weights, 1))
        return x.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(0))

    langs = above(leaves, ["domain", "lang"], mix.lang_weights)
    domains = above(langs, ["domain"], mix.domain_weights)
    budgets = _share_out(domains, [], "domain", None, total)
    budgets = _share_out(langs, ["domain"], "lang", budgets, None)
    budgets = _share_out(leaves.select(*LEAF, "cap", "w"), ["domain", "lang"], "source", budgets, None)
    plan = leaves.join(budgets, LEAF).withColumn("full", F.expr("case when tokens > 0 then budget div tokens else 0 end")).withColumn("rest", F.expr("budget - full * tokens"))
    plan, _ = write_shared(plan.select(*LEAF, "n_rows", "tokens", "full", "rest"), "plan")

    placed = lookup(rows, plan, LEAF, "n_rows", ["full", "rest"])
    placed, _ = write_shared(placed.withColumn("place", F.md5(F.concat_ws(":", F.lit(mix.seed), F.col("full") + 1, F.col("id")).cast("binary"))), "placed")
    keep, done = ["id", "number", *LEAF, "n_tokens", "full"], []
    edge, leaves_left, digits = placed.withColumn("ahead", F.lit(0).cast("long")), plan.select(*LEAF, "n_rows"), 0
    while digits < 32:
        found, most = _cut(edge, leaves_left, digits)
        done.append(found.filter("cell <> cut").select(*keep, F.expr("cell < cut").alias("taken")))
        edge, digits = found.filter("cell = cut").select(*keep, "rest", "place", F.col("cut_ahead").alias("ahead")), digits + 2
        if most <= mix.sort_rows:
            break
        leaves_left = edge.groupBy(*LEAF).agg(F.count("*").alias("n_rows"))
    run = F.sum("n_tokens").over(Window.partitionBy(*LEAF).orderBy("place", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    out = edge.select(*keep, ((F.col("rest") > 0) & (F.col("ahead") + run <= F.col("rest"))).alias("taken"))
    for part in done:
        out = out.union(part)
    return out.withColumn("copies", F.col("full") + F.col("taken").cast("long"))


def _cut(rows: DataFrame, leaves: DataFrame, digits: int) -> tuple[DataFrame, int]:
    """``rows`` with their cell by the next two digits, the cell of their leaf's cut, and the tokens ahead of that; and the most rows of such a cell."""
    rows = rows.withColumn("cell", F.substring("place", digits + 1, 2))
    cells = rows.groupBy(*LEAF, "cell").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("c"), F.first("rest").alias("rest"), F.first("ahead").alias("ahead"))
    upto = F.col("ahead") + F.sum("n").over(Window.partitionBy(*LEAF).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    # Without a budget the first cell has the cut, so that nothing is taken; without tokens all cells lie behind it.
    past = cells.withColumn("upto", upto).filter("rest = 0 or upto > rest").groupBy(*LEAF).agg(F.min("cell").alias("cut"), F.min_by(F.col("upto") - F.col("n"), "cell").alias("cut_ahead"), F.min_by("c", "cell").alias("c"))
    ends, _ = write_shared(leaves.join(past, LEAF), "ends")
    most = ends.agg(F.max("c")).first()[0] or 0
    return write_shared(lookup(rows, ends, LEAF, "n_rows", ["cut", "cut_ahead"]), "found")[0], most


def take_mix(docs: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", **columns) -> DataFrame:
    """The rows of ``docs``, all columns, as often as :func:`mix_sources` says.

    Where ids are null or repeat, rows are first written with a number of their own that finds their copies again.
    """
    mix, mark = mix or Mix(), docs.select(F.col(id_col).alias("__id")).groupBy("__id").agg(F.count("*").alias("c"))
    if mark.filter("c > 1 or __id is null").isEmpty():
        chosen = _mixed(docs, mix, F.lit(None).cast("long"), id_col, **columns).filter("copies > 0").select(F.col("id").alias("__key"), F.col("copies").alias("__copies"))
        out = docs.join(chosen, F.col(id_col) == F.col("__key"))
        return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*[F.col(c) for c in docs.columns])
    numbered, _ = write_shared(docs.select(F.struct(*docs.columns).alias("__row"), F.monotonically_increasing_id().alias("__number")), "numbered")
    rows = numbered.select("__row.*", "__number")
    chosen = _mixed(rows, mix, F.col("__number"), id_col, **columns).filter("copies > 0").select("number", F.col("copies").alias("__copies"))
    out = numbered.join(chosen, F.col("__number") == F.col("number"))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select("__row.*")


def _sql_case(column: str, names: dict, default) -> str:
    text = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in names.items()) + f" ELSE {text(default)} END" if names else text(default)


def oracle_sql(mix: Mix | None = None) -> str:
    """DuckDB SQL for the rows of :func:`mix_sources` over ``documents``, by plain running sums over whole leaves."""
    m = mix or Mix()

    def shared(name: str, nodes: str, parent: list[str], child: str, budgets: str | None) -> str:
        p = ", ".join(parent)
        by = f"PARTITION BY {p}" if p else ""
        order = f"{by} ORDER BY cap / greatest(w, 1), {child}"
        x = f"SELECT n.*, {'b.budget' if budgets else '(SELECT sum(tokens) FROM leaves)::BIGINT * ' + str(m.budget_percent) + ' // 100'} AS b FROM {nodes} n" + (f" JOIN {budgets} b USING ({p})" if budgets else "")
        return f"""
{name}_a AS (SELECT *, coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM ({x})),
{name}_b AS (SELECT *, (b - before) * w >= cap * weight_left AS filled FROM {name}_a),
{name}_c AS (SELECT *, b - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ({by}) AS b_left, sum(CASE WHEN filled THEN 0 ELSE w END) OVER ({by}) AS w_left FROM {name}_b),
{name} AS (SELECT {p + ', ' if p else ''}{child}, (CASE WHEN filled THEN cap ELSE b_left * w // w_left END)::BIGINT AS budget FROM {name}_c)"""

    return f"""
WITH docs AS (SELECT doc_id, {_sql_case("coalesce(source, '')", m.domains, m.other_domain)} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
sums AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, {_sql_case("source", m.source_weights, 1)} AS w FROM docs GROUP BY ALL),
leaves AS (SELECT *, CASE WHEN w > 0 THEN tokens * {m.max_epochs} ELSE 0 END::BIGINT AS cap FROM sums),
langs AS (SELECT domain, lang, CASE WHEN w > 0 THEN cap ELSE 0 END::BIGINT AS cap, w FROM (SELECT domain, lang, sum(cap)::BIGINT AS cap, {_sql_case("lang", m.lang_weights, 1)} AS w FROM leaves GROUP BY domain, lang)),
domains AS (SELECT domain, CASE WHEN w > 0 THEN cap ELSE 0 END::BIGINT AS cap, w FROM (SELECT domain, sum(cap)::BIGINT AS cap, {_sql_case("domain", m.domain_weights, 1)} AS w FROM langs GROUP BY domain)),
{shared("bd", "domains", [], "domain", None)},
{shared("bl", "langs", ["domain"], "lang", "bd")},
{shared("bs", "leaves", ["domain", "lang"], "source", "bl")},
plan AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole FROM leaves JOIN bs USING (domain, lang, source)),
placed AS (SELECT d.*, whole, budget - whole * tokens AS rest, tokens, md5(concat_ws(':', '{m.seed}', whole + 1, doc_id)) AS place FROM docs d JOIN plan USING (domain, lang, source)),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, (whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM run
"""
