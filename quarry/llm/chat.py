"""Chat formatting by multi-party perspective rotation (operator 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize
from quarry.llm.ordering import with_global_order

OPEN, CLOSE, NARRATOR = "<|", "<|end|>\n", "system"


def named(name: Column) -> Column:
    """A name that can neither open nor close a header."""
    return F.regexp_replace(F.replace(F.replace(name, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >")), r"[\r\n]+", " ")


def rotate_perspectives(conversations: DataFrame, part_chars: int = 65_536, ranges: int = 64, sample: int = 4096) -> DataFrame:
    """Render each dialogue once for every participant: that speaker as assistant, the others as named users.

    Input: conv_id, turn, role (the speaker's name), text. Turns are ordered by turn, then name, then text. `system`
    narrates: it is rendered as system in every perspective and has none of its own. A turn is
    `<|assistant|>\\n`, `<|user:NAME|>\\n` or `<|system|>\\n`, the text, and `<|end|>\\n`; `<|` inside a text or name becomes `< |`
    (so it can't be told from a `< |` that was there), and in a name also `|>` becomes `| >` and line ends a space.
    `mask` lists start:end (code points in this row's text, end exclusive) of what the assistant says with its `<|end|>`.

    A dialogue longer than part_chars is cut between turns into parts, so no task gathers more than part_chars plus
    one turn, whatever the length of a conversation: its place on the global line of turns tells a turn's part.

    Returns conv_id, perspective, part, first_turn, n_turns, n_masked, chars, text, mask. Null or blank role: the
    speaker `unknown`. Null text: empty. Null conv_id: one conversation of its own. Repeated rows are repeated turns.
    A conversation of narrators only, and empty input, give no rows. Further columns aren't read.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        named(F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.lit("unknown"))).alias("speaker"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("body"),
    ).withColumns({"_key": F.md5("body"), "_weight": (F.length("body") + F.lit(32)).cast("long")})
    ordered, _, _ = with_global_order(turns, ["conv_id", "turn", "speaker", "_key"], "_weight", ranges, sample)
    ordered = materialize(ordered.drop("_key", "_weight"), "turns")

    speakers = ordered.filter(F.col("speaker") != NARRATOR).groupBy(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).agg(F.lit(1).alias("one"))
    starts = ordered.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("before").alias("_start"))
    same = lambda side: F.col("conv_id").eqNullSafe(F.col("_conv"))
    cut = ordered.join(starts, same(starts)).withColumn("part", F.expr(f"(before - _start) div {part_chars}"))
    parts = cut.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("rank", "turn", "speaker", "body"))).alias("turns"))

    mine = lambda t: t["speaker"] == F.col("perspective")
    header = lambda t: F.when(mine(t), F.lit("<|assistant|>\n")).when(t["speaker"] == NARRATOR, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user:"), t["speaker"], F.lit("|>\n")))
    line = lambda t: F.concat(header(t), t["body"], F.lit(CLOSE))
    # the state of the fold: characters so far, and the mask as text
    step = lambda acc, t: F.struct(
        (acc["at"] + F.length(line(t))).alias("at"),
        F.when(mine(t), F.concat(acc["mask"], F.when(acc["mask"] == "", F.lit("")).otherwise(F.lit(",")), (acc["at"] + F.lit(14)).cast("string"), F.lit(":"), (acc["at"] + F.length(line(t)) - 1).cast("string"))).otherwise(acc["mask"]).alias("mask"),
    )
    fold = F.aggregate("turns", F.struct(F.lit(0).alias("at"), F.lit("").alias("mask")), step)
    return (
        parts.join(speakers, same(speakers))
        .withColumn("_fold", fold)
        .select(
            "conv_id",
            "perspective",
            "part",
            F.col("turns")[0]["turn"].alias("first_turn"),
            F.size("turns").cast("long").alias("n_turns"),
            F.size(F.filter("turns", mine)).cast("long").alias("n_masked"),
            F.col("_fold")["at"].cast("long").alias("chars"),
            F.array_join(F.transform("turns", line), "").alias("text"),
            F.col("_fold")["mask"].alias("mask"),
        )
    )


SQL = r"""
WITH m AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, regexp_replace(replace(replace(coalesce(nullif(trim(role, ' '), ''), 'unknown'), '<|', '< |'), '|>', '| >'), '[\r\n]+', ' ', 'g') AS speaker,
                  replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
o AS (SELECT *, row_number() OVER w AS rk, sum(length(body) + 32) OVER w - length(body) - 32 AS before
      FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn, speaker, md5(body) ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, CAST(before // 65536 AS BIGINT) AS part FROM o),
s AS (SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker <> 'system'),
r AS (SELECT p.conv_id, s.perspective, p.part, p.rk, p.turn, p.speaker = s.perspective AS mine,
             CASE WHEN p.speaker = s.perspective THEN '<|assistant|>' WHEN p.speaker = 'system' THEN '<|system|>' ELSE '<|user:' || p.speaker || '|>' END
             || chr(10) || p.body || '<|end|>' || chr(10) AS line
      FROM p JOIN s ON p.conv_id IS NOT DISTINCT FROM s.conv_id),
a AS (SELECT *, sum(length(line)) OVER (PARTITION BY conv_id, perspective, part ORDER BY rk ROWS UNBOUNDED PRECEDING) AS done FROM r)
SELECT conv_id, perspective, part, first(turn ORDER BY rk) AS first_turn, count(*) AS n_turns, count(*) FILTER (WHERE mine) AS n_masked,
       CAST(sum(length(line)) AS BIGINT) AS chars, string_agg(line, '' ORDER BY rk) AS text,
       coalesce(string_agg(CAST(CAST(done - length(line) + 14 AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(done - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY rk) FILTER (WHERE mine), '') AS mask
FROM a GROUP BY conv_id, perspective, part
"""
