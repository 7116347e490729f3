"""Quotation linking: reply-ordered conversations without quotes. Native DataFrame code only.

1. A line's quote level is the number of ``>`` at its start (``> >`` and ``>>`` alike). Attribution lines ("... wrote:")
   right before a quote go with it. A quoted passage is a run of lines of one level.
2. Passages and their single lines are normalised (lower case, white space collapsed) and hashed (MD5); so are the
   messages' own runs and lines. Within a conversation, each quoted hash is linked to the latest earlier message that
   wrote it: one sort of (conversation, hash) groups in turn order, not a join, so a line that everybody repeats costs
   its occurrences, never their pairs.
3. A message replies to the message that its shallowest linked quotes come from: most linked characters first, then the
   latest. The first message of a reply chain is its thread, found by pointer doubling (a logarithmic number of joins).
4. In a conversation, threads are ordered by their first turn and messages by turn, so a reply follows its original.

Defined results: a null text counts as empty; rows that repeat (conversation, turn) are kept, share links, and are
ordered by role and text; quotes that match nothing are removed but link nothing; a message never links to itself or
to a later one; rows with a null conversation or turn are kept without links,
those without a conversation at position 1 of one of their own; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

_QUOTE = r"^(?:[ \t]*>)+"
_ATTRIBUTION = r"(?m)^[^\n>]*wrote:[ \t\r]*\n(?=[ \t]*>)"


def without_attributions(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _ATTRIBUTION, "")


def own_text(text: Column) -> Column:
    """The text without quoted lines and their attributions."""
    lines = F.split(without_attributions(text), "\n")
    return F.array_join(F.filter(lines, lambda x: ~x.rlike(_QUOTE)), "\n")


def quote_level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _QUOTE, 0), "[^>]", ""))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, _QUOTE, "")), r"[ \t\r\x0B\f]+", " "))


def _passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, key, n: each run of lines of one level, and each line of it."""
    lines = (
        messages.where("conv_id is not null and turn is not null")
        .select("conv_id", "turn", F.posexplode(F.split(without_attributions(F.col("text")), "\n")).alias("no", "line"))
        .withColumns({"level": quote_level(F.col("line")), "key": normalised(F.col("line"))})
        .select("conv_id", "turn", "no", "level", "key")
        .distinct()
    )
    message = Window.partitionBy("conv_id", "turn").orderBy("no", "level", "key")
    level = Window.partitionBy("conv_id", "turn", "level").orderBy("no", "key")
    runs = lines.withColumn("run", F.row_number().over(message) - F.row_number().over(level))
    whole = runs.groupBy("conv_id", "turn", "level", "run").agg(F.sort_array(F.collect_list(F.struct("no", "key"))).alias("parts"))
    text = F.array_join(F.filter(F.transform("parts", lambda p: p["key"]), lambda k: k != ""), "\n")
    return (
        whole.select("conv_id", "turn", "level", text.alias("key"))
        .union(lines.select("conv_id", "turn", "level", "key"))
        .where("key <> ''")
        .select("conv_id", "turn", "level", F.md5("key").alias("hash"), F.length("key").alias("n"))
    )


def reply_links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to: the message that a message's quotes come from."""
    items = _passages(messages).groupBy("conv_id", "hash", "turn", "level").agg(F.max("n").alias("n"))
    # Within equal turns quotes sort before own text, so a message is never its own original.
    earlier = Window.partitionBy("conv_id", "hash").orderBy("turn", F.expr("level = 0")).rowsBetween(Window.unboundedPreceding, -1)
    origin = F.last(F.when(F.col("level") == 0, F.col("turn")), ignorenulls=True).over(earlier)
    linked = items.withColumn("origin", origin).where("level > 0 and origin is not null")
    by_origin = linked.groupBy("conv_id", "turn", "level", "origin").agg(F.sum("n").alias("n"))
    return by_origin.groupBy("conv_id", "turn").agg(
        F.max_by("origin", F.struct(-F.col("level"), F.col("n"), F.col("origin"))).alias("reply_to")
    )


def threads(links: DataFrame) -> DataFrame:
    """Adds thread, the first turn of the chain of replies, by pointer doubling."""
    known = links.select("*", F.col("reply_to").alias("thread"))
    while True:
        known = staged(known, "threads")
        up = known.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("above"))
        known_next = known.join(up, ["conv_id", "thread"], "left")
        if not known_next.where("above is not null").limit(1).count():
            return known
        known = known_next.select("conv_id", "turn", "reply_to", F.coalesce("above", "thread").alias("thread"))


def linked_conversations(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, position, turn, role, reply_to, thread, text (without quotes)."""
    rows = messages.select("conv_id", "turn", "role", "text")
    links = threads(reply_links(rows))
    order = Window.partitionBy("conv_id").orderBy("thread", "turn", "role", "text")
    own = rows.select("conv_id", "turn", "role", own_text(F.col("text")).alias("text"))
    linked = own.where("conv_id is not null").join(links, ["conv_id", "turn"], "left").withColumn("thread", F.coalesce("thread", "turn"))
    names = ["conv_id", "position", "turn", "role", "reply_to", "thread", "text"]
    alone = own.where("conv_id is null").withColumns({"position": F.lit(1).cast("long"), "reply_to": F.lit(None).cast(linked.schema["reply_to"].dataType), "thread": F.col("turn")})
    return linked.withColumn("position", F.row_number().over(order).cast("long")).select(*names).union(alone.select(*names))


ORACLE_SQL = r"""
WITH RECURSIVE m AS (
    SELECT conv_id, turn, role, text,
           regexp_replace(coalesce(text, ''), '(^|\n)[^\n>]*wrote:[ \t\r]*(\n[ \t]*>)', '\1\2', 'g') AS body FROM conversations
), l AS (
    SELECT conv_id, turn, generate_subscripts(string_split(body, chr(10)), 1) AS no, unnest(string_split(body, chr(10))) AS line
    FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), k AS (
    SELECT DISTINCT conv_id, turn, no, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level,
           trim(regexp_replace(lower(regexp_replace(line, '^(?:[ \t]*>)+', '')), '[ \t\r\x0B\f]+', ' ', 'g')) AS key FROM l
), r AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY no, level, key)
              - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY no, key) AS run FROM k
), p AS (
    SELECT conv_id, turn, level, string_agg(key, chr(10) ORDER BY no, key) FILTER (key <> '') AS key FROM r GROUP BY conv_id, turn, level, run
    UNION ALL SELECT conv_id, turn, level, key FROM k
), i AS (
    SELECT conv_id, turn, level, md5(key) AS hash, max(length(key)) AS n FROM p WHERE key <> '' GROUP BY ALL
), o AS (
    SELECT *, last_value(CASE WHEN level = 0 THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id, hash ORDER BY turn, level = 0
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS origin FROM i
), s AS (
    SELECT conv_id, turn, level, origin, sum(n) AS n FROM o WHERE level > 0 AND origin IS NOT NULL GROUP BY ALL
), link AS (
    SELECT conv_id, turn, origin AS reply_to FROM s
    QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, origin DESC) = 1
), up AS (
    SELECT conv_id, turn, reply_to AS thread FROM link
    UNION ALL
    SELECT up.conv_id, up.turn, link.reply_to FROM up JOIN link ON up.conv_id = link.conv_id AND up.thread = link.turn
), root AS (SELECT conv_id, turn, min(thread) AS thread FROM up GROUP BY ALL)
SELECT m.conv_id, CASE WHEN m.conv_id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY m.conv_id ORDER BY coalesce(root.thread, m.turn), m.turn, role, own) END AS position,
       m.turn, role, reply_to, coalesce(root.thread, m.turn) AS thread, own AS text
FROM (SELECT *, array_to_string(list_filter(string_split(body, chr(10)), lambda x: NOT regexp_matches(x, '^(?:[ \t]*>)+')), chr(10)) AS own FROM m) m
LEFT JOIN link ON link.conv_id = m.conv_id AND link.turn = m.turn
LEFT JOIN root ON root.conv_id = m.conv_id AND root.turn = m.turn
"""
