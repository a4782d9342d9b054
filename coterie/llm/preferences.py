"""Preference formatting of conversations (operator 3).

A pair is two conversations, chosen and rejected. Their longest common turn prefix is the prompt and is
rendered once; what follows on either side is a completion. Output is one row per turn of a pair, so no
conversation is ever gathered into one cell: a prompt row has the rendered turn in `prompt`; a completion
row has both sides' turns at that place, `chosen` and `rejected` (null where a side has no turn there), each
with the characters [loss_start, loss_end) on which loss falls: the words and end mark of assistant turns,
nothing elsewhere. format_pairs gives the same turns in a longer form, one row for each side.

Pairs can be given. Where none are known, branched() makes one of every conversation, at its last assistant
turn: chosen is the conversation as it stands, rejected the same turns up to there and then the last assistant
turn of the next conversation in the order of the md5 of conv_id (after the last comes the first), whose
number is rejected_id. So the prompt is all that was said before that reply. A conversation that has no
assistant turn, or is the only one that has, stands alone: rejected_id is null and all its turns are its
completion. If both replies are equal words, the prompt holds them too.

whole_pairs() instead pairs conversations with each other. Those that open with the same turn go together:
within an opening, in the order of (conv_id mod SALTS, conv_id), the first with the second, the third with
the fourth, and so on; the one with more assistant characters is chosen, the earlier one if they have equally
many. Ranks come from counts by salt and a row number inside each salt, so one very common opening is spread
over many tasks. Who has no partner in an opening is paired across openings, with an empty prompt: in buckets
of the md5 of conv_id, in the order of conv_id, and the odd ones of the buckets with each other. If the
number of conversations is odd, the last has a null rejected_id and all its turns are its completion.

Cases: exact repeats of a row count once; several different rows of one turn number are turns one after
another, by role and text (nulls first); null turn numbers come first; null role or text renders as
empty; very long texts and conversations of very many turns are rows like any other; rows with a null conv_id
belong to no conversation and are left out; a pair of equal conversations has prompt rows only; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.ordered import numbered
from .base import stash, table

SALTS = 64


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, part, role, text, same): distinct turns in order of (turn, part); `same` is equal
    for equal turns."""
    t = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    t = t.where(F.col("conv_id").isNotNull()).distinct()
    part = F.row_number().over(W.partitionBy("conv_id", "turn").orderBy(F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()))
    marked = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    same = F.md5(F.concat(marked(F.col("role")), F.lit("\n"), marked(F.col("text"))))
    return t.withColumn("part", part).withColumn("same", same)


def _openings(turns: DataFrame, salts: int) -> DataFrame:
    """(conv_id, opening, n, rank): the first turn, the assistant characters and the rank in the opening."""
    order = F.struct("turn", "part")
    length = F.sum(F.when(F.col("role") == "assistant", F.length("text")).otherwise(0))
    convs = turns.groupBy("conv_id").agg(F.min_by("same", order).alias("opening"), F.coalesce(length, F.lit(0)).alias("n"))
    convs = stash(convs.withColumn("salt", F.pmod("conv_id", F.lit(salts))), "openings")
    sums = convs.groupBy("opening", "salt").agg(F.count("*").alias("c"))
    before = F.sum("c").over(W.partitionBy("opening").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("opening", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy("opening", "salt").orderBy("conv_id")) - 1
    return convs.withColumn("rank", rank).join(sums, ["opening", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))


def _couples(ranked: DataFrame, *keys: str) -> DataFrame:
    """Neighbours in rank under the keys: k of them (two, or one at an odd end), the chosen one as best."""
    return ranked.groupBy(*keys, F.expr("rank div 2").alias("pair")).agg(
        F.count("*").alias("k"),
        F.max(F.struct("n", (-F.col("rank")).alias("late"), "conv_id")).alias("best"),
        F.min(F.struct("n", (-F.col("rank")).alias("late"), "conv_id")).alias("rest"),
    )


def _ids(couples: DataFrame) -> DataFrame:
    return couples.where("k = 2").select(F.col("best.conv_id").alias("chosen_id"), F.col("rest.conv_id").alias("rejected_id"))


def opening_pairs(turns: DataFrame, salts: int = SALTS) -> DataFrame:
    """(chosen_id, rejected_id) of conversations that open with the same turn."""
    return _ids(_couples(_openings(turns, salts), "opening"))


def whole_pairs(turns: DataFrame, salts: int = SALTS) -> tuple[DataFrame, DataFrame]:
    """(chosen_id, rejected_id) over all conversations, each in one pair, and (conv_id) of the one that is
    left if their number is odd."""
    bucket = F.substring(F.md5(F.col("conv_id").cast("string")), 1, 3).alias("bucket")
    odd = lambda couples: couples.where("k = 1").select("best.n", "best.conv_id").select("n", "conv_id", bucket)
    alike = stash(_couples(_openings(turns, salts), "opening"), "couples")
    near = odd(alike).withColumn("rank", F.row_number().over(W.partitionBy("bucket").orderBy("conv_id")) - 1)
    near = stash(_couples(near, "bucket"), "couples")
    # at most one a bucket is left, 4096 rows
    last = stash(_couples(odd(near).withColumn("rank", F.row_number().over(W.orderBy("bucket")) - 1)), "couples")
    return _ids(alike).union(_ids(near)).union(_ids(last)), odd(last).select("conv_id")


def branched(turns: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, best, turn, part, role, text, same): the turns of both sides of each pair, or
    of the one side of a conversation alone."""
    replies = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "part", "text", "same")).alias("last"))
    ring = stash(numbered(replies.withColumn("order", F.md5(F.col("conv_id").cast("string"))), [F.col("order"), F.col("conv_id")]), "ring")
    n = ring.count()
    donor = ring.select((F.when(F.col("rn") == 1, n).otherwise(F.col("rn") - 1)).alias("rn"), F.col("conv_id").alias("rejected_id"), F.col("last.text").alias("_text"), F.col("last.same").alias("_same"))
    pairs = stash(ring.join(donor, "rn").where("conv_id != rejected_id").select(F.col("conv_id").alias("chosen_id"), "rejected_id", F.struct("last.turn", "last.part").alias("_end"), "_text", "_same"), "branches")
    both = turns.join(pairs.select(F.col("chosen_id").alias("conv_id"), "rejected_id", "_end"), "conv_id", "left")
    sides = F.array(F.lit(True), F.lit(False))
    earlier = F.col("rejected_id").isNotNull() & (F.struct("turn", "part") < F.col("_end"))
    own = both.withColumn("best", F.explode(F.when(earlier, sides).otherwise(F.slice(sides, 1, 1))))
    own = own.select(F.col("conv_id").alias("chosen_id"), "rejected_id", "best", "turn", "part", "role", "text", "same")
    other = pairs.select("chosen_id", "rejected_id", F.lit(False).alias("best"), "_end.turn", "_end.part", F.lit("assistant").alias("role"), F.col("_text").alias("text"), F.col("_same").alias("same"))
    return own.unionByName(other)


def render(role: Column, text: Column) -> tuple[Column, Column]:
    """Header and body of a turn."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n")), F.concat(F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def format_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rendered segments of each pair (chosen_id, rejected_id), over turns as turns_of gives them."""
    sides = F.explode(F.array(F.struct(F.col("chosen_id").alias("conv_id"), F.lit("chosen").alias("side")), F.struct(F.col("rejected_id").alias("conv_id"), F.lit("rejected").alias("side"))))
    sided = pairs.select("chosen_id", "rejected_id", sides.alias("s")).select("chosen_id", "rejected_id", "s.conv_id", "s.side")
    rows = stash(turns.join(sided, "conv_id"), "sided")
    # the prefix ends at the first place where one side has no turn or another one
    place = F.struct("turn", "part")
    met = rows.groupBy("chosen_id", "rejected_id", "turn", "part").agg(F.max(F.when(F.col("side") == "chosen", F.col("same"))).alias("a"), F.max(F.when(F.col("side") == "rejected", F.col("same"))).alias("b"))
    apart = ~F.col("a").eqNullSafe(F.col("b"))
    ends = met.groupBy("chosen_id", "rejected_id").agg(F.min(F.when(apart, place)).alias("end"))
    ends = met.join(ends, ["chosen_id", "rejected_id"]).groupBy("chosen_id", "rejected_id").agg(F.first("end").alias("end"), F.count(F.when(F.col("end").isNull() | (place < F.col("end")), 1)).alias("n_prompt_turns"))
    out = rows.join(ends, ["chosen_id", "rejected_id"])
    shared = F.col("end").isNull() | (place < F.col("end"))
    out = out.where(~shared | (F.col("side") == "chosen")).withColumn("segment", F.when(shared, "prompt").otherwise(F.col("side")))
    head, body = render(F.col("role"), F.col("text"))
    learns = (F.col("segment") != "prompt") & (F.coalesce("role", F.lit("")) == "assistant")
    rendered = F.concat(head, body)
    return out.select(
        "chosen_id", "rejected_id", "segment", "turn", F.col("part").cast("long").alias("turn_part"), "role", rendered.alias("rendered"),
        F.when(learns, F.length(head)).otherwise(0).cast("long").alias("loss_start"), F.when(learns, F.length(rendered)).otherwise(0).cast("long").alias("loss_end"), "n_prompt_turns",
    )


def format_alone(turns: DataFrame, alone: DataFrame) -> DataFrame:
    """Rendered segments, as format_pairs gives them, of conversations (conv_id) without a partner."""
    head, body = render(F.col("role"), F.col("text"))
    learns, rendered, none = F.coalesce("role", F.lit("")) == "assistant", F.concat(head, body), F.lit(None).cast("long")
    return turns.join(alone, "conv_id").select(
        F.col("conv_id").alias("chosen_id"), none.alias("rejected_id"), F.lit("chosen").alias("segment"), "turn", F.col("part").cast("long").alias("turn_part"), "role", rendered.alias("rendered"),
        F.when(learns, F.length(head)).otherwise(0).cast("long").alias("loss_start"), F.when(learns, F.length(rendered)).otherwise(0).cast("long").alias("loss_end"), F.lit(0).cast("long").alias("n_prompt_turns"),
    )


def format_paired(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per turn of each pair (chosen_id, rejected_id; a null rejected_id for one without partner)."""
    sides = F.explode(F.array(F.struct(F.col("chosen_id").alias("conv_id"), F.lit(True).alias("best")), F.struct(F.col("rejected_id").alias("conv_id"), F.lit(False).alias("best"))))
    sided = pairs.select("chosen_id", "rejected_id", sides.alias("s")).select("chosen_id", "rejected_id", "s.conv_id", "s.best")
    return format_sides(turns.join(sided, "conv_id"))


def format_sides(sided: DataFrame) -> DataFrame:
    """One row per turn of each pair, from the turns of both its sides (best: of the chosen one)."""
    of = lambda best: F.max(F.when(F.col("best") == best, F.struct("same", "role", "text")))
    met = sided.groupBy("chosen_id", "rejected_id", "turn", "part").agg(of(True).alias("a"), of(False).alias("b"))
    met = stash(met, "met")
    # the prefix ends at the first place where one side has no turn or another one
    place = F.struct("turn", "part")
    ends = met.groupBy("chosen_id").agg(F.min(F.when(~F.col("a.same").eqNullSafe(F.col("b.same")), place)).alias("end"))
    ends = met.select("chosen_id", "turn", "part").join(ends, "chosen_id").groupBy("chosen_id").agg(F.first("end").alias("end"), F.count(F.when(F.col("end").isNull() | (place < F.col("end")), 1)).alias("n_prompt_turns"))
    out = met.join(ends, "chosen_id")
    shared = F.col("end").isNull() | (place < F.col("end"))
    text = {c: F.concat(*render(F.col(f"{c}.role"), F.col(f"{c}.text"))) for c in "ab"}
    side = {c: F.when(~shared & F.col(f"{c}.same").isNotNull(), text[c]) for c in "ab"}

    def loss(c: str, what: Column) -> Column:
        learns = ~shared & F.col(f"{c}.same").isNotNull() & (F.coalesce(F.col(f"{c}.role"), F.lit("")) == "assistant")
        return F.when(learns, F.length(what)).otherwise(0).cast("long")

    head = {c: render(F.col(f"{c}.role"), F.col(f"{c}.text"))[0] for c in "ab"}
    return out.select(
        "chosen_id", "rejected_id", F.when(shared, "prompt").otherwise("completion").alias("segment"), "turn", F.col("part").cast("long").alias("turn_part"), F.when(shared, text["a"]).alias("prompt"),
        side["a"].alias("chosen"), loss("a", head["a"]).alias("chosen_loss_start"), loss("a", text["a"]).alias("chosen_loss_end"),
        side["b"].alias("rejected"), loss("b", head["b"]).alias("rejected_loss_start"), loss("b", text["b"]).alias("rejected_loss_end"), "n_prompt_turns",
    )


def op3_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_sides(branched(turns_of(table(spark, sf_dir, "conversations"))))


def op3_preference_formatting_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations paired with each other, in the longer form."""
    turns = turns_of(table(spark, sf_dir, "conversations"))
    pairs, alone = whole_pairs(turns)
    return format_pairs(turns, pairs).union(format_alone(turns, alone))


OP3_ORACLE = """
WITH t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, text NULLS FIRST) AS part,
         md5(coalesce('=' || role, '-') || chr(10) || coalesce('=' || text, '-')) AS same
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, part) AS place FROM t),
convs AS (
  SELECT conv_id, max(CASE WHEN place = 1 THEN same END) AS opening,
         coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END), 0) AS n
  FROM placed GROUP BY conv_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY opening ORDER BY ((conv_id % 64) + 64) % 64, conv_id) - 1 AS rank FROM convs),
couples AS (
  SELECT a.conv_id AS one, b.conv_id AS two, a.n AS n1, b.n AS n2
  FROM ranked a JOIN ranked b ON a.opening = b.opening AND a.rank % 2 = 0 AND b.rank = a.rank + 1),
pairs AS (SELECT CASE WHEN n1 >= n2 THEN one ELSE two END AS chosen_id, CASE WHEN n1 >= n2 THEN two ELSE one END AS rejected_id FROM couples),
sides AS (
  SELECT p.*, placed.*, 'chosen' AS side FROM pairs p JOIN placed ON conv_id = chosen_id
  UNION ALL
  SELECT p.*, placed.*, 'rejected' AS side FROM pairs p JOIN placed ON conv_id = rejected_id),
met AS (
  SELECT chosen_id, rejected_id, turn, part,
         max(CASE WHEN side = 'chosen' THEN same END) AS a, max(CASE WHEN side = 'rejected' THEN same END) AS b
  FROM sides GROUP BY ALL),
walked AS (
  SELECT *, sum(CASE WHEN a IS DISTINCT FROM b THEN 1 ELSE 0 END) OVER (
    PARTITION BY chosen_id, rejected_id ORDER BY turn NULLS FIRST, part ROWS UNBOUNDED PRECEDING) AS differ
  FROM met),
counted AS (SELECT *, count(*) FILTER (differ = 0) OVER (PARTITION BY chosen_id, rejected_id) AS n_prompt_turns FROM walked),
cut AS (
  SELECT s.*, w.n_prompt_turns, CASE WHEN w.differ = 0 THEN 'prompt' ELSE s.side END AS segment,
         '<|' || coalesce(s.role, '') || '|>' || chr(10) AS head, coalesce(s.text, '') || '<|end|>' || chr(10) AS body
  FROM sides s JOIN counted w ON s.chosen_id = w.chosen_id AND s.rejected_id = w.rejected_id
       AND s.turn IS NOT DISTINCT FROM w.turn AND s.part = w.part
  WHERE w.differ > 0 OR s.side = 'chosen')
SELECT chosen_id, rejected_id, segment, turn, part AS turn_part, role, head || body AS rendered,
  CASE WHEN segment <> 'prompt' AND role = 'assistant' THEN length(head) ELSE 0 END AS loss_start,
  CASE WHEN segment <> 'prompt' AND role = 'assistant' THEN length(head || body) ELSE 0 END AS loss_end, n_prompt_turns
FROM cut"""

#: The same but for the couples: each conversation is in one, the last one with nobody if the number is odd.
_COUPLES = """couples AS (
  SELECT a.conv_id AS one, b.conv_id AS two, a.n AS n1, b.n AS n2
  FROM {r} a JOIN {r} b ON a.{key} = b.{key} AND a.rank % 2 = 0 AND b.rank = a.rank + 1)"""
_LEFT = "SELECT conv_id, n, substr(md5(CAST(conv_id AS VARCHAR)), 1, 3) AS bucket, 0 AS everything FROM {r} a WHERE rank % 2 = 0 AND NOT EXISTS (SELECT 1 FROM {r} b WHERE a.{key} = b.{key} AND b.rank = a.rank + 1)"
_STEPS = [("ranked", "opening"), ("ranked2", "bucket"), ("ranked3", "everything")]
OP3_WHOLE_ORACLE = (
    OP3_ORACLE[: OP3_ORACLE.index("couples AS (")]
    + f"""left1 AS ({_LEFT.format(r="ranked", key="opening")}),
ranked2 AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY conv_id) - 1 AS rank FROM left1),
left2 AS ({_LEFT.format(r="ranked2", key="bucket")}),
ranked3 AS (SELECT *, row_number() OVER (ORDER BY bucket) - 1 AS rank FROM left2),
"""
    + ", ".join(f"step{k}_{_COUPLES.format(r=r, key=key)}" for k, (r, key) in enumerate(_STEPS))
    + f""",
couples AS (
  SELECT * FROM step0_couples UNION ALL SELECT * FROM step1_couples UNION ALL SELECT * FROM step2_couples
  UNION ALL SELECT conv_id, NULL, n, -1 FROM ({_LEFT.format(r="ranked3", key="everything")})),
"""
    + OP3_ORACLE[OP3_ORACLE.index("pairs AS (") :].replace("s.rejected_id = w.rejected_id", "s.rejected_id IS NOT DISTINCT FROM w.rejected_id")
)

_HEAD, _BODY = (" || ".join(x) for x in (("'<|'", "coalesce({c}_role, '')", "'|>'", "chr(10)"), ("coalesce({c}_text, '')", "'<|end|>'", "chr(10)")))


def _side(c: str, name: str) -> str:
    head, body = _HEAD.format(c=c), _BODY.format(c=c)
    learns = f"differ > 0 AND {c} IS NOT NULL AND {c}_role = 'assistant'"
    return f"""CASE WHEN differ > 0 AND {c} IS NOT NULL THEN {head} || {body} END AS {name},
  CASE WHEN {learns} THEN length({head}) ELSE 0 END AS {name}_loss_start, CASE WHEN {learns} THEN length({head} || {body}) ELSE 0 END AS {name}_loss_end"""


OP3_PAIRED_ORACLE = (
    OP3_WHOLE_ORACLE[: OP3_WHOLE_ORACLE.index("met AS (")]
    + f"""met AS (
  SELECT chosen_id, rejected_id, turn, part, """
    + ", ".join(f"max(CASE WHEN side = '{side}' THEN {column} END) AS {name}" for c, side in (("a", "chosen"), ("b", "rejected")) for column, name in (("same", c), ("role", f"{c}_role"), ("text", f"{c}_text")))
    + f"""
  FROM sides GROUP BY ALL),
walked AS (
  SELECT *, sum(CASE WHEN a IS DISTINCT FROM b THEN 1 ELSE 0 END) OVER (
    PARTITION BY chosen_id ORDER BY turn NULLS FIRST, part ROWS UNBOUNDED PRECEDING) AS differ
  FROM met)
SELECT chosen_id, rejected_id, CASE WHEN differ = 0 THEN 'prompt' ELSE 'completion' END AS segment, turn, part AS turn_part,
  CASE WHEN differ = 0 THEN {_HEAD.format(c="a")} || {_BODY.format(c="a")} END AS prompt,
  {_side("a", "chosen")},
  {_side("b", "rejected")},
  count(*) FILTER (differ = 0) OVER (PARTITION BY chosen_id) AS n_prompt_turns
FROM walked"""
)

#: The query's: the same rows over sides that branch at the last assistant turn.
OP3_BRANCHED_ORACLE = (
    OP3_ORACLE[: OP3_ORACLE.index("convs AS (")]
    + """last AS (SELECT * FROM placed WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) = 1),
ring AS (SELECT *, coalesce(lead(conv_id) OVER w, first_value(conv_id) OVER w) AS donor FROM last WINDOW w AS (ORDER BY md5(CAST(conv_id AS VARCHAR)), conv_id)),
pairs AS (SELECT r.conv_id AS chosen_id, d.conv_id AS rejected_id, r.turn, r.part, r.place, d.text, d.same FROM ring r JOIN last d ON d.conv_id = r.donor WHERE r.donor <> r.conv_id),
sides AS (
  SELECT t.conv_id AS chosen_id, p.rejected_id, t.turn, t.part, t.role, t.text, t.same, 'chosen' AS side FROM placed t LEFT JOIN pairs p ON p.chosen_id = t.conv_id
  UNION ALL
  SELECT p.chosen_id, p.rejected_id, t.turn, t.part, t.role, t.text, t.same, 'rejected' FROM placed t JOIN pairs p ON p.chosen_id = t.conv_id AND t.place < p.place
  UNION ALL
  SELECT chosen_id, rejected_id, turn, part, 'assistant', text, same, 'rejected' FROM pairs),
"""
    + OP3_PAIRED_ORACLE[OP3_PAIRED_ORACLE.index("met AS (") :]
)
