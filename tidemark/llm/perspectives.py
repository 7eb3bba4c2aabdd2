"""Multi-party perspective rotation (operator 3), in DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant and everyone else as a named user; what the assistant says is trained on, the
rest is masked. System turns stay system turns and are no participant.

A conversation is whole in each of its rows. It is rendered by parts of PART_TURNS turn
numbers, in many tasks if it is long, and the rows put the parts together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYSTEM, UNKNOWN = "system", "unknown"
#: Turn numbers in a part; the first part of null turns, beyond any number's.
PART_TURNS, LATE = 256, 1 << 60
END = "<|end|>\n"


def rotate(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, perspective, n_turns, n_trained, rendered, spans): a row per conversation and participant.

    spans: where training applies, as start-end offsets in characters of ``rendered``,
    end exclusive, joined by commas; a span holds the text and the end mark, not the header.

    Turns come in the order of turn, role, text; repeated rows are repeated turns. A null or
    empty text is an empty message; a null role speaks as the user "unknown" and is no
    participant. Null turns come after the numbered ones, in the order of a hash of role and
    text modulo PART_TURNS, then role and text. A null conv_id names no conversation: each of
    its turns stands alone, with its repeats. A conversation without participants has no row.
    Other columns are ignored; an empty table gives no rows.
    """
    turn, role, text = F.col(turn_col), F.col(role_col), F.coalesce(F.col(text_col), F.lit(""))
    alone = F.when(F.col(conv_col).isNull(), F.xxhash64(turn, role, text))
    part = F.coalesce(F.floor(turn / PART_TURNS), LATE + F.pmod(F.xxhash64(role, text), F.lit(PART_TURNS))).cast("long")
    said = turns.select(F.col(conv_col).alias("_conv"), alone.alias("_alone"), part.alias("_part"), F.struct(turn.alias("turn"), role.alias("role"), text.alias("text")).alias("_said"))
    parts = said.groupBy("_conv", "_alone", "_part").agg(F.sort_array(F.collect_list("_said")).alias("_said"))
    speakers = said.select(F.col("_conv").alias("_c"), F.col("_alone").alias("_a"), F.col("_said.role").alias("_me")).where(F.col("_me") != SYSTEM).distinct()
    both = parts.join(speakers, F.col("_conv").eqNullSafe(F.col("_c")) & F.col("_alone").eqNullSafe(F.col("_a")))
    me = F.col("_me")
    header = lambda t: (
        F.when(t["role"] == me, F.lit("<|assistant|>\n"))
        .when(t["role"] == SYSTEM, F.lit("<|system|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), F.coalesce(t["role"], F.lit(UNKNOWN)), F.lit("|>\n")))
    )
    pieces = F.transform("_said", lambda t: F.struct(header(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), F.coalesce(t["role"] == me, F.lit(False)).alias("mine")))
    made = both.select("_conv", "_alone", "_me", "_part", pieces.alias("_p"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:long,end:long>>").alias("spans"))

    def step(acc, p):
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        span = F.struct(begin.cast("long").alias("begin"), end.cast("long").alias("end"))
        return F.struct(end.cast("long").alias("at"), F.when(p["mine"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    rendered = F.array_join(F.transform("_p", lambda p: F.concat(p["head"], p["body"])), "")
    measured = made.select("_conv", "_alone", "_me", "_part", F.size("_p").alias("n"), rendered.alias("text"), F.aggregate("_p", start, step).alias("_at"))
    row = F.struct(F.col("_part").alias("part"), "n", "text", F.col("_at.at").alias("size"), F.col("_at.spans").alias("spans"))
    whole = measured.groupBy("_conv", "_alone", "_me").agg(F.sort_array(F.collect_list(row)).alias("_parts"))
    sums = F.aggregate("_parts", F.array(F.lit(0).cast("long")), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + p["size"])))
    moved = F.zip_with("_parts", F.slice(sums, 1, F.size("_parts")), lambda p, at: F.transform(p["spans"], lambda s: F.concat((s["begin"] + at).cast("string"), F.lit("-"), (s["end"] + at).cast("string"))))
    whole = whole.select("*", F.flatten(moved).alias("_spans"))
    return whole.select(
        F.col("_conv").alias(conv_col),
        F.col("_me").alias("perspective"),
        F.aggregate("_parts", F.lit(0).cast("long"), lambda acc, p: acc + p["n"]).alias("n_turns"),
        F.size("_spans").cast("long").alias("n_trained"),
        F.array_join(F.transform("_parts", lambda p: p["text"]), "").alias("rendered"),
        F.array_join("_spans", ",").alias("spans"),
    )


#: DuckDB SQL for the query over ``conversations``, which has no nulls.
ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, role, text FROM conversations
), s AS (
  SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> '{SYSTEM}'
), p AS (
  SELECT t.*, perspective, role = perspective AS mine,
         CASE WHEN role = perspective THEN '<|assistant|>' || chr(10) WHEN role = '{SYSTEM}' THEN '<|system|>' || chr(10)
              ELSE '<|user name=' || role || '|>' || chr(10) END AS head, text || '<|end|>' || chr(10) AS body
  FROM t JOIN s USING (conv_id)
), o AS (
  SELECT *, CAST(sum(length(head) + length(body)) OVER w AS BIGINT) AS stop
  FROM p WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, count(*) AS n_turns, count(*) FILTER (mine) AS n_trained,
       string_agg(head || body, '' ORDER BY turn, role, text) AS rendered,
       coalesce(string_agg((stop - length(body)) || '-' || stop, ',' ORDER BY turn, role, text) FILTER (mine), '') AS spans
FROM o GROUP BY conv_id, perspective
"""
