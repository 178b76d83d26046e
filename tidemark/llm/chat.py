"""Chat formatting with cumulative-snapshot collapse (operator 1).

Loggers often store a conversation again after every turn. Every turn gets a rolling hash of
the conversation up to it: two sums over the turns so far of hashes of (position, role, text), so
one running total in the turn order gives the hashes of all prefixes. A conversation whose whole
hash and length equal those of a proper prefix of a longer one is a snapshot of it; an
anti-join removes it. Of equal conversations the smallest conv_id stays. What remains is
rendered.

Texts are hashed where they are read and are shuffled once, for the conversations kept. The totals need them only in
conversations where turns of one number and role differ in text, which are ordered by it. The joins see one row for
each distinct (length, hash), aggregated before the shuffle, so a first turn or conversation that very many share is one row.

The two sums hold 40 bits of differently seeded 64-bit hashes each; different prefixes agree in
both with a probability of 2**-80.

Defined cases: turns are ordered by turn, then role, then text (nulls first), and a repeated row is
a turn of its own; null role or text count as a value of their own in the comparison and
render as empty; all rows with a null conv_id form one conversation, ordered by one task, with hashes only unless turns tie; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, cut

_MASK = (1 << 40) - 1


def _key() -> list[Column]:
    """conv_id as a key without nulls."""
    return [F.coalesce("conv_id", F.lit(0)).alias("_k"), F.col("conv_id").isNull().alias("_z")]


def _totals(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds pos (1..), n (turns of the conversation), h1 and h2 (of the turns up to this one) to rows with the turns' own hashes."""
    whole = Window.partitionBy("conv_id")
    over = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("pos", F.row_number().over(whole.orderBy(*order))).withColumn("n", F.count(F.lit(1)).over(whole))
    for k in (1, 2):
        rows = rows.withColumn(f"h{k}", F.sum(F.xxhash64(F.lit(k), "pos", f"own{k}").bitwiseAND(F.lit(_MASK))).over(over))
    return rows


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, pos (1..), n (turns of the conversation), h1 and h2 (of the turns up to this one)."""
    parts = [F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    own = turns.select("*", *[F.xxhash64(F.lit(k * 7919), *parts).alias(f"own{k}") for k in (1, 2)])
    # without texts: the order is the right one unless turns of one number and role differ in text
    light = _totals(own.drop("text"), ["turn", "role", "own1"])
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "own1")
    same = [F.lag(c).over(before).eqNullSafe(F.col(c)) for c in ("turn", "role", "own1")]
    light = light.withColumn("tie", (F.col("pos") > 1) & same[0] & same[1] & ~same[2]).withColumn("tie", F.max("tie").over(Window.partitionBy("conv_id")))
    names = ["conv_id", "pos", "n", "h1", "h2"]
    light = cut(light.select(*names, "tie"))
    tied = light.where("tie").select(*_key()).distinct()
    light = light.where("not tie").select(*names)
    if tied.isEmpty():
        return light
    heavy = own.select("*", *_key()).join(tied, ["_k", "_z"], "left_semi")
    return light.unionByName(_totals(heavy, ["turn", "role", "text"]).select(*names))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that prefix no longer one; of equal ones the smallest conv_id."""
    hashed = prefix_hashes(columns(turns, "conv_id", "turn", "role", "text"))
    whole = hashed.where("pos = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    inside = hashed.where("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
    return whole.join(inside, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), "copies")


def render(turns: DataFrame, keep: DataFrame, start: str = "<|{role}|>\n", end: str = "\n<|end|>\n") -> DataFrame:
    """conv_id, n_turns, copies and chat: the turns of each kept conversation in order, one string."""
    t = columns(turns, "conv_id", "turn", "role", "text")
    # a key without nulls, so that the join and the grouping share one exchange of the texts
    t = t.select("turn", "role", "text", *_key()).join(keep.select("*", *_key()), ["_k", "_z"])
    before, _, after = start.partition("{role}")
    piece = lambda x: F.concat(F.lit(before), F.coalesce(x["role"], F.lit("")), F.lit(after), F.coalesce(x["text"], F.lit("")), F.lit(end))
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    chat = F.array_join(F.transform(rows, piece), "")
    out = t.groupBy("_k", "_z").agg(F.first("conv_id").alias("conv_id"), F.first("n_turns").alias("n_turns"), F.first("copies").alias("copies"), chat.alias("chat"))
    return out.drop("_k", "_z")


def op1_chat_snapshots(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return render(turns, maximal(turns))


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns, count(*) AS n
  FROM conversations GROUP BY conv_id
), w AS (
  SELECT turns, n, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY turns, n
), p AS (
  SELECT DISTINCT list_slice(turns, 1, k) AS turns FROM (SELECT turns, unnest(range(1, n)) AS k FROM w)
)
SELECT conv_id, n AS n_turns, copies,
  list_aggregate(list_transform(turns, lambda x: '<|' || coalesce(x.role, '') || '|>' || chr(10) || coalesce(x.text, '') || chr(10) || '<|end|>' || chr(10)), 'string_agg', '') AS chat
FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.turns = w.turns)
"""
