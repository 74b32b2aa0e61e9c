"""Preference pairs from two conversations with a common beginning.

The longest common prefix of turns is rendered once, as the prompt; what
follows in either conversation is its completion, and only the assistant's
turns in it count for the loss. The result is a row for each rendered turn, so
no conversation is ever gathered in one row or task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is rendered: before the role, between role and text, and after the text.
TEMPLATE = ("<|", "|>\n", "<|end|>\n")


def render(role: Column, text: Column) -> Column:
    """A turn as text; a null role or text is empty."""
    return F.concat(F.lit(TEMPLATE[0]), F.coalesce(role, F.lit("")), F.lit(TEMPLATE[1]), F.coalesce(text, F.lit("")), F.lit(TEMPLATE[2]))


def format_pairs(turns: DataFrame) -> DataFrame:
    """Rows ``(pair_id, part, turn, role, rendered, loss, paired)``.

    ``turns`` has ``pair_id``, ``side`` (``chosen`` or ``rejected``), ``turn``,
    ``role`` and ``text``. Turns are equal if both sides have that turn with
    the same role and text, nulls being equal; the prompt ends before the first
    turn that differs. ``part`` is ``prompt``, ``chosen`` or ``rejected``, and
    ``loss`` is true for assistant turns of completions. With equal
    conversations all is prompt. If a side is missing, all is the other side's
    completion and ``paired`` is false. Rows without a pair, a side or a turn
    are left out; of rows that repeat a turn, that with the least role and text
    counts, nulls last. Other columns are not read.
    """
    given = turns.where("pair_id is not null and turn is not null and side in ('chosen', 'rejected')")
    # nulls last: a flag before each value
    word = F.struct(F.col("role").isNull().alias("no_role"), "role", F.col("text").isNull().alias("no_text"), "text")
    both = given.groupBy("pair_id", "turn").agg(F.min(F.when(F.col("side") == "chosen", word)).alias("c"), F.min(F.when(F.col("side") == "rejected", word)).alias("r"))
    split = both.groupBy("pair_id").agg(
        F.min(F.when(~F.col("c").eqNullSafe(F.col("r")), F.col("turn"))).alias("first"),
        (F.count("c") > 0).alias("has_c"),
        (F.count("r") > 0).alias("has_r"),
    )
    rows = both.join(split, "pair_id")
    common = F.coalesce(F.col("turn") < F.col("first"), F.lit(True))

    def piece(part: str, word: str, when: Column) -> Column:
        loss = F.lit(part != "prompt") & F.coalesce(F.col(word)["role"] == "assistant", F.lit(False))
        return F.when(when & F.col(word).isNotNull(), F.struct(F.lit(part).alias("part"), F.col(word)["role"].alias("role"), render(F.col(word)["role"], F.col(word)["text"]).alias("rendered"), loss.alias("loss")))

    pieces = F.filter(F.array(piece("prompt", "c", common), piece("chosen", "c", ~common), piece("rejected", "r", ~common)), lambda x: x.isNotNull())
    out = rows.select("pair_id", "turn", (F.col("has_c") & F.col("has_r")).alias("paired"), F.explode(pieces).alias("x"))
    return out.select("pair_id", "x.part", "turn", "x.role", "x.rendered", "x.loss", "paired")


def neighbours(conversations: DataFrame) -> DataFrame:
    """Turns of conversations as pairs: of ids 2n and 2n + 1 the first is chosen, the second rejected."""
    side = F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected")
    return conversations.where("conv_id is not null").select(F.floor(F.col("conv_id") / 2).alias("pair_id"), side.alias("side"), "turn", "role", "text")


#: The same for ``neighbours(conversations)`` in SQL.
SQL = """
WITH given AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, turn, role, text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, side, turn ORDER BY role NULLS LAST, text NULLS LAST) AS place FROM given
), c AS (SELECT * FROM ranked WHERE side = 0 AND place = 1), r AS (SELECT * FROM ranked WHERE side = 1 AND place = 1),
both_sides AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.turn, r.turn) AS turn,
         c.turn IS NOT NULL AS in_c, r.turn IS NOT NULL AS in_r,
         c.role AS c_role, c.text AS c_text, r.role AS r_role, r.text AS r_text,
         c.turn IS NOT NULL AND r.turn IS NOT NULL AND c.role IS NOT DISTINCT FROM r.role AND c.text IS NOT DISTINCT FROM r.text AS same
  FROM c FULL JOIN r ON c.pair_id = r.pair_id AND c.turn = r.turn
), marked AS (
  SELECT *, min(CASE WHEN NOT same THEN turn END) OVER (PARTITION BY pair_id) AS first,
         bool_or(in_c) OVER (PARTITION BY pair_id) AND bool_or(in_r) OVER (PARTITION BY pair_id) AS paired
  FROM both_sides
), parts AS (
  SELECT pair_id, 'prompt' AS part, turn, c_role AS role, c_text AS text, paired FROM marked WHERE coalesce(turn < first, true) AND in_c
  UNION ALL SELECT pair_id, 'chosen', turn, c_role, c_text, paired FROM marked WHERE turn >= first AND in_c
  UNION ALL SELECT pair_id, 'rejected', turn, r_role, r_text, paired FROM marked WHERE turn >= first AND in_r
)
SELECT pair_id, part, turn, role,
       '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS rendered,
       part <> 'prompt' AND coalesce(role = 'assistant', false) AS loss, paired
FROM parts
"""
