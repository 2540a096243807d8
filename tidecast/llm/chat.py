"""Chat formatting: turns in budgeted windows with a loss mask, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The template: ``<turn>role``, a line break, the text, ``</turn>`` and a line break.
OPEN, CLOSE = "<turn>", "</turn>\n"


def escaped(text: Column) -> Column:
    r"""Make the template's strings impossible inside a text: ``\`` becomes ``\\`` and ``<`` becomes ``\l``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    """The inverse of ``escaped`` (and of a role's ``\\n``): between doubled backslashes, single ones start escapes."""
    piece = lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n"))
    return F.array_join(F.transform(F.split(text, r"\\\\"), piece), "\\")


def windows(conversations: DataFrame, budget: int = 1024) -> DataFrame:
    """Conversations as windows of whole turns: one row a window, ``conv_id``, ``window`` (from 0), ``formatted``,
    ``context_turns`` (leading turns repeated from before) and ``loss`` (spans of code points in ``formatted``).

    A turn weighs a quarter of its formatted bytes in tokens. What the system turn (if the conversation begins with one)
    leaves of the budget is the room: a quarter of it for history, the rest for new turns. The prefix sum of tokens
    chooses the spans: a window takes the turns that begin in one half of the rest, so that it ends whole; a turn of more
    than such a half stands alone, however long it is. Every later window repeats the system turn, and the turn before it
    if that weighs a quarter of the room at most and the window still keeps its budget. So no window exceeds the budget
    but one whose single new turn does so with the system turn. Only assistant turns that are new carry loss, so each is
    learned once. Rows go by turn (null first), then role and text; null text and roles are empty; rows of a null
    ``conv_id`` are one conversation; repeated rows are turns of their own. Other columns are not used.
    """
    whole = Window.partitionBy("conv_id")
    own = whole.orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    new = F.expr("IF(is_system, 0L, tokens)")
    turns = (
        conversations.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
        .withColumn("head", F.concat(F.lit(OPEN), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n")))
        .withColumn("body", escaped(F.col("text")))
        .withColumn("tokens", F.expr(f"CAST((octet_length(head) + octet_length(body) + {len(CLOSE)} + 3) DIV 4 AS BIGINT)"))
        .withColumn("i", F.row_number().over(own))
        .withColumn("is_system", F.expr("i = 1 AND role = 'system'"))
        .withColumn("system", F.max(F.expr("IF(is_system, tokens, 0L)")).over(whole))
        .withColumn("room", F.expr(f"greatest({budget} - system, 2L)"))
        .withColumn("half", F.expr("greatest(room * 3 DIV 8, 1L)"))
        .withColumn("sum", F.coalesce(F.sum(new).over(before), F.lit(0)))
        .withColumn("span", F.expr("IF(is_system, NULL, 2 * (sum DIV half) + IF(tokens > half, 1, 0))"))
        # the system turn goes with the first of the others
        .withColumn("span", F.coalesce("span", F.lead("span").over(own), F.lit(0)))
        .withColumn("window", F.dense_rank().over(whole.orderBy("span")) - 1)
        .withColumn("held", F.sum(new).over(Window.partitionBy("conv_id", "window")))
        .withColumn("next", F.lead("window").over(own))
        .withColumn("next_held", F.lead("held").over(own))
        .withColumn("last", F.max("window").over(whole))
    )
    uses = F.expr(
        f"""CASE WHEN is_system THEN transform(sequence(window, last), w -> struct(w AS window, w > window AS again))
              WHEN next > window AND tokens <= room DIV 4 AND system + tokens + next_held <= {budget}
                THEN array(struct(window AS window, false AS again), struct(next AS window, true AS again))
              ELSE array(struct(window AS window, false AS again)) END"""
    )
    placed = turns.withColumn("use", F.explode(uses)).groupBy("conv_id", F.col("use.window").alias("window"))
    parts = placed.agg(F.sort_array(F.collect_list(F.struct("i", F.col("use.again").alias("again"), "role", "head", "body"))).alias("parts"))
    # a window has few turns, so its places are folded over an array
    fold = F.expr(
        f"""aggregate(parts, struct(CAST(0 AS BIGINT) AS at, CAST(array() AS array<struct<start:bigint,end:bigint>>) AS loss),
          (a, p) -> struct(
            a.at + length(p.head) + length(p.body) + {len(CLOSE)} AS at,
            IF(p.again OR p.role != 'assistant', a.loss, concat(a.loss, array(
              struct(a.at + length(p.head) AS start, a.at + length(p.head) + length(p.body) AS end)))) AS loss))"""
    )
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    return parts.select(
        "conv_id",
        "window",
        text.alias("formatted"),
        F.size(F.filter("parts", lambda p: p["again"])).alias("context_turns"),
        fold["loss"].alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Windows read again: one row a conversation, its ``turns`` (role and text, in order) and ``loss`` (text under the mask)."""
    pieces = F.filter(F.split("formatted", CLOSE), lambda p: p != "")
    new = F.expr("slice(pieces, context_turns + 1, size(pieces))")
    parsed = F.transform(
        new,
        lambda p: F.struct(
            unescaped(F.substring_index(F.substring(p, len(OPEN) + 1, 2**31 - 1), "\n", 1)).alias("role"),
            unescaped(F.regexp_replace(p, r"^[^\n]*\n", "")).alias("text"),
        ),
    )
    masked = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    rows = formatted.withColumn("pieces", pieces).select("conv_id", "window", parsed.alias("turns"), F.array_join(masked, "").alias("loss"), F.length("formatted").alias("chars"))
    return (
        rows.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
        .select("conv_id", F.flatten("w.turns").alias("turns"), F.array_join("w.loss", "").alias("loss"), "formatted_chars")
    )


def oracle(budget: int = 1024) -> str:
    """DuckDB SQL for the query over ``conversations``: the contract's digests, and the lengths that the windows give."""
    return rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, '{OPEN}' || replace(replace(replace(role, '\', '\\'), '<', '\l'), chr(10), '\n') || chr(10)
  || replace(replace(text, '\', '\\'), '<', '\l') || '</turn>' || chr(10) AS out FROM c),
t AS (SELECT *, (strlen(out) + 3) // 4 AS tokens, row_number() OVER w AS i FROM f
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
y AS (SELECT *, i = 1 AND role = 'system' AS is_system, max(CASE WHEN i = 1 AND role = 'system' THEN tokens ELSE 0 END)
  OVER (PARTITION BY conv_id) AS sys FROM t),
r AS (SELECT *, greatest({budget} - sys, 2) AS room, greatest(greatest({budget} - sys, 2) * 3 // 8, 1) AS half,
  CASE WHEN is_system THEN 0 ELSE tokens END AS fresh FROM y),
s AS (SELECT *, coalesce(sum(fresh) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM r),
u AS (SELECT *, CASE WHEN NOT is_system THEN 2 * (CAST(b AS BIGINT) // half) + CASE WHEN tokens > half THEN 1 ELSE 0 END END AS own FROM s),
v AS (SELECT *, coalesce(own, lead(own) OVER (PARTITION BY conv_id ORDER BY i), 0) AS span FROM u),
p AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY span) AS win FROM v),
h AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id, win) AS held FROM p),
q AS (SELECT *, lead(win) OVER o AS nxt, lead(held) OVER o AS next_held, max(win) OVER (PARTITION BY conv_id) AS final FROM h
  WINDOW o AS (PARTITION BY conv_id ORDER BY i))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(out) * CASE WHEN is_system THEN final - win + 1
    WHEN nxt > win AND tokens <= room // 4 AND sys + tokens + next_held <= {budget} THEN 2 ELSE 1 END) AS BIGINT) AS formatted_chars
FROM q GROUP BY conv_id"""
