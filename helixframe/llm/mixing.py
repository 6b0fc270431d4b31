"""Mixing sources to target weights by temperature.

A source's share of the tokens, raised to an exponent and normalised, is its weight: 1 keeps the shares, 0 gives
every source alike. The exponent is bisected to the flattest mixture in which no source repeats more often than
`repetitions`, or to a target entropy. The budget is the number of tokens at which the least repeated source is
read exactly once, or given. A source's weight times the budget, over its tokens, is its number of
epochs. Whole epochs take all of its documents; the fraction takes blocks of documents in a permuted order until its
tokens are used up, the last block document by document.

The order is a hash: a document's block among `BLOCKS` of its source, a block's place, and its place in the
block. Sums are taken by (source, block), so a source with a third of all documents is many tasks' work, and only the
block where the fraction ends is ordered by document. Texts are never shuffled. The bisection reads a row
a source: each round evaluates a grid of exponents in one aggregate and narrows it.

Tokens are words, `[^ \\t-\\r]+`.

Defined cases: null texts count as empty; null sources are a source of their own; a source without any token is read once;
rows of equal ids have one place and stay or go together; null ids share one place; an empty table
gives an empty result; with one source every document is read once. Other columns are passed through by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lookup, table, written

BLOCKS, GRID, ROUNDS, REPETITIONS = 4096, 33, 8, 2.0
#: Sources whose plan, a short row each, is broadcast; of more only those that hold a thousandth of the rows are.
FEW_SOURCES = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def place(*parts: Column) -> Column:
    """A hash of 60 bits that SQL engines share: the first 15 hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(x.cast("string"), F.lit("")) for x in parts])), 1, 15), 16, 10).cast("long")


def own_columns(docs: DataFrame, id_col: str, source_col: str) -> dict[str, Column]:
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))  # "" is the null source
    spot = place(F.lit("document"), F.col(id_col))
    return {"source": source, "spot": spot, "block": F.pmod(spot, F.lit(BLOCKS)).cast("int")}


def weights_at(sources: DataFrame, exponents: list[float]) -> DataFrame:
    """exponent, most (the most repetitions at the budget of the least repeated source), entropy."""
    grid = F.explode(F.array(*[F.lit(float(x)) for x in exponents]))
    rows = sources.select("tokens", "share", grid.alias("exponent")).withColumn("raised", F.pow("share", "exponent"))
    sums = rows.groupBy("exponent").agg(
        F.sum("raised").alias("all"), F.sum(F.col("raised") * F.log("raised")).alias("logs"), F.min(F.col("raised") / F.col("tokens")).alias("least"), F.max(F.col("raised") / F.col("tokens")).alias("most")
    )
    return sums.select("exponent", (F.col("most") / F.col("least")).alias("most"), (F.log("all") - F.col("logs") / F.col("all")).alias("entropy"))


def bisect(sources: DataFrame, repetitions: float | None, entropy: float | None) -> float:
    """The least exponent in [0, 1] that keeps to the limit of repetitions; or the greatest that reaches the entropy (nats)."""
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        steps = [lo + (hi - lo) * i / (GRID - 1) for i in range(GRID)]
        found = sorted(tuple(r) for r in weights_at(sources, steps).collect())  # GRID rows
        if not found:
            return 1.0
        if repetitions is not None:
            fits = [m <= repetitions for _, m, _ in found]
        else:
            fits = [e <= entropy for _, _, e in found]
        if all(fits):
            return lo
        if not any(fits):
            return hi
        at = fits.index(True)
        lo, hi = steps[at - 1], steps[at]
    return hi


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", repetitions: float | None = REPETITIONS, entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """A row a source: source (marked), tokens, share, weight, epochs, whole, edge_block, edge_spot.

    A document is read whole times, and once more if its block lies before edge_block in the permuted order, or is
    that block and its spot is at most edge_spot."""
    tokens = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    own = docs.select(tokens.alias("tokens"), F.lit(1).alias("n"), *[v.alias(k) for k, v in own_columns(docs, id_col, source_col).items()])
    sums = written(own.groupBy("source", "block").agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("n")), "mix-blocks").withColumn("turn", place(F.lit("block"), F.col("block")))
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    sources = sums.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("n")).withColumn("share", F.col("tokens") / F.lit(float(max(1, total))))
    sources = written(sources, "mix-sources")
    real = sources.where("tokens > 0")
    exponent = bisect(real, repetitions if entropy is None else None, entropy)
    norm, least = real.agg(F.sum(F.pow("share", F.lit(exponent))), F.min(F.pow("share", F.lit(exponent)) / F.col("tokens"))).first()
    norm, least = norm or 1.0, least or 1.0
    spent = budget if budget is not None else norm / least
    weight = F.when(F.col("tokens") > 0, F.pow("share", F.lit(exponent)) / F.lit(norm)).otherwise(0.0)
    epochs = F.when(F.col("tokens") > 0, F.round(weight * F.lit(spent) / F.col("tokens"), 9)).otherwise(1.0)
    sources = sources.withColumn("weight", weight).withColumn("epochs", epochs).withColumn("whole", F.floor("epochs").cast("int"))
    sources = sources.withColumn("rest", F.floor((F.col("epochs") - F.col("whole")) * F.col("tokens")).cast("long"))
    # At most BLOCKS rows a source.
    before = F.sum("tokens").over(Window.partitionBy("source").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1))
    laid = sums.withColumn("before", F.coalesce(before, F.lit(0))).join(sources.select("source", "rest"), "source")
    edge = written(laid.where("rest > 0 AND before < rest AND before + tokens >= rest").groupBy("source").agg(F.max(F.struct("turn", "block", "before", "rest")).alias("e")).select("source", F.col("e.turn").alias("edge_turn"), F.col("e.block").alias("edge_block"), (F.col("e.rest") - F.col("e.before")).alias("left")), "mix-edges")
    inside = own.join(edge.select("source", F.col("edge_block").alias("block"), "left"), ["source", "block"])
    run = F.sum("tokens").over(Window.partitionBy("source", "block").orderBy("spot").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    spots = inside.withColumn("run", run).where(F.col("run") <= F.col("left")).groupBy("source").agg(F.max("spot").alias("edge_spot"))
    out = sources.drop("rest").join(edge.drop("left"), "source", "left").join(spots, "source", "left")
    return written(out, "mix-plan")


def place_documents(docs: DataFrame, sources: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with __hx_copies, how often a document is read, and __hx_turn and __hx_spot, its place in an epoch."""
    own = own_columns(docs, id_col, source_col)
    turn = place(F.lit("block"), own["block"])
    names = {"source": "__hx_source", "whole": "__hx_whole", "edge_turn": "__hx_edge_turn", "edge_spot": "__hx_edge_spot"}
    right = sources.select(*[F.col(k).alias(v) for k, v in names.items()], F.col("n").alias("__hx_n"))
    docs = docs.withColumns({"__hx_source": own["source"], "__hx_turn": turn, "__hx_spot": own["spot"]})
    if sources.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES:
        placed = docs.join(F.broadcast(right.drop("__hx_n")), "__hx_source")
    else:
        placed = lookup(docs, right, "__hx_source", sources.agg(F.sum("n")).first()[0], "__hx_n")
    more = F.coalesce((F.col("__hx_turn") < F.col("__hx_edge_turn")) | (F.col("__hx_turn") == F.col("__hx_edge_turn")) & (F.col("__hx_spot") <= F.col("__hx_edge_spot")), F.lit(False))
    placed = placed.withColumn("__hx_copies", F.col("__hx_whole") + more.cast("int"))
    return placed.drop(*names.values())


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **target) -> DataFrame:
    """The documents, each row as often as it is read."""
    placed = place_documents(docs, plan(docs, id_col, text_col, source_col, **target), id_col, source_col)
    return placed.withColumn("__hx_copy", F.explode(F.array_repeat(F.lit(0), F.col("__hx_copies")))).drop("__hx_copy", "__hx_copies", "__hx_turn", "__hx_spot")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: doc_id, source, copies, turn and spot (its block's and its own place in an epoch)."""
    docs = table(spark, sf_dir, "documents")
    placed = place_documents(docs, plan(docs))
    return placed.select("doc_id", "source", F.col("__hx_copies").cast("long").alias("copies"), F.col("__hx_turn").alias("turn"), F.col("__hx_spot").alias("spot"))


#: The limit of repetitions alone binds, so the exponent has a closed form here.
SQL = f"""
WITH own AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS s,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens,
         CAST('0x' || substr(md5('document:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS spot
  FROM documents),
d AS (SELECT *, CAST(spot % {BLOCKS} AS INTEGER) AS block,
             CAST('0x' || substr(md5('block:' || CAST(spot % {BLOCKS} AS VARCHAR)), 1, 15) AS BIGINT) AS turn FROM own),
src AS (SELECT s, sum(tokens) AS tokens FROM d GROUP BY s),
lim AS (SELECT max(tokens) AS hi, min(tokens) AS lo FROM src WHERE tokens > 0),
ex AS (SELECT CASE WHEN hi = lo THEN 0.0 ELSE greatest(0.0, 1 - ln({REPETITIONS}) / ln(hi / lo)) END AS a, hi FROM lim),
ep AS (SELECT s, tokens, CASE WHEN tokens > 0 THEN round(pow(tokens / hi, a - 1), 9) ELSE 1.0 END AS epochs FROM src, ex),
pl AS (SELECT *, CAST(floor(epochs) AS BIGINT) AS whole, CAST(floor((epochs - floor(epochs)) * tokens) AS BIGINT) AS rest FROM ep),
bl AS (SELECT s, block, turn, sum(tokens) AS tokens FROM d GROUP BY ALL),
cu AS (SELECT *, sum(tokens) OVER (PARTITION BY s ORDER BY turn, block) - tokens AS before FROM bl),
ed AS (SELECT cu.s, max(turn) AS edge_turn, max_by(block, turn) AS block, max_by(rest - before, turn) AS left_over
       FROM cu JOIN pl ON cu.s = pl.s WHERE rest > 0 AND before < rest AND before + cu.tokens >= rest GROUP BY cu.s),
sp AS (SELECT s, max(spot) AS edge_spot FROM (
         SELECT d.s, spot, left_over, sum(tokens) OVER (PARTITION BY d.s ORDER BY spot RANGE UNBOUNDED PRECEDING) AS run
         FROM d JOIN ed ON d.s = ed.s AND d.block = ed.block) WHERE run <= left_over GROUP BY s)
SELECT doc_id, source,
       CAST(whole + CASE WHEN coalesce(turn < edge_turn OR (turn = edge_turn AND spot <= edge_spot), false) THEN 1 ELSE 0 END AS BIGINT) AS copies,
       turn, spot
FROM d JOIN pl ON d.s = pl.s LEFT JOIN ed ON d.s = ed.s LEFT JOIN sp ON d.s = sp.s
"""
