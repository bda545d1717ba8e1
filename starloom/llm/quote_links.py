"""Quotation linking: who answers whom, from what messages quote.

A line's quote level is the number of ">" before it. Lines of one level that follow each other are a block. Quoted blocks
and the lines in them are normalised (letters and digits in lower case, anything else one space) and looked up by MD5 among
the unquoted texts and lines of all messages. A passage's message is the nearest earlier one of the same conversation that
holds it, else the first of another conversation. The whole block's message is its original; without one, the message of
some line that holds most of the block's lines. Only built-in functions run here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.llm.common import discard, materialise, table

#: A line before a quotation that only names its author and date.
ATTRIBUTION = r"(?i)^(on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:?\s*$"
KEY = ["conv_id", "turn", "role", "mark"]
#: Turns in a block of the two-level search for the nearest earlier holder of a passage.
SPAN = 1024


def _join(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which nulls equal nulls."""
    right = right.withColumnsRenamed({n: f"__{n}" for n in names})
    on = reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names])
    return left.join(right, on, how).drop(*[f"__{n}" for n in names])


def _normal(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")))


def parse(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) with mark (MD5 of the text), body (the text without quotations and attributions), held (digests of body and its lines) and quotes (level, lines). Only texts with a ">" are taken apart by levels."""
    rows = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.md5("text").alias("mark"))
    rows = rows.withColumn("split", F.split("text", "\r?\n", -1))
    prefix = lambda line: F.regexp_extract(line, r"^((?:[ \t]*>)*)", 1)
    level = lambda line: F.length(prefix(line)) - F.length(F.translate(prefix(line), ">", ""))
    plain = rows.where(~F.contains("text", F.lit(">"))).withColumns({"own_lines": F.col("split"), "quotes": F.array().cast("array<struct<level:int,lines:array<string>>>")})
    marked = rows.where(F.contains("text", F.lit(">"))).withColumn("levels", F.transform("split", level))
    marked = marked.withColumn("words", F.transform("split", lambda x: F.substr(x, F.length(prefix(x)) + 1)))
    quoted_next = lambda i: F.coalesce(F.get("levels", i + 1), F.lit(0)) > 0
    own = F.filter("words", lambda x, i: (F.get("levels", i) == 0) & ~(x.rlike(ATTRIBUTION) & quoted_next(i)))
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: (i == 0) | (F.get("levels", i) != F.get("levels", i - 1)))
    marked = marked.withColumns({"own_lines": own, "starts": starts})
    block = lambda s, k: F.struct(F.get("levels", s).alias("level"), F.slice("words", s + 1, F.coalesce(F.get("starts", k + 1), F.size("words")) - s).alias("lines"))
    quotes = F.filter(F.transform("starts", block), lambda b: (b["level"] > 0) & (_normal(F.array_join(b["lines"], " ")) != ""))
    names = ["conv_id", "turn", "role", "mark", "own_lines", "quotes"]
    both = plain.select(names).unionByName(marked.withColumn("quotes", quotes).select(names))
    both = both.withColumn("body", F.btrim(F.array_join("own_lines", "\n"), F.lit(" \t\r\n")))
    return both.select(*KEY, "body", "quotes", _digests(F.concat(F.array("body"), F.col("own_lines"))).alias("held"))


def _digests(texts: Column) -> Column:
    """MD5s of the normal forms of some texts, each once; texts without a letter or digit have none."""
    forms = F.filter(F.array_distinct(F.transform(texts, _normal)), lambda f: f != "")
    return F.transform(forms, lambda f: F.unhex(F.md5(f)))


def _nearest(asked: DataFrame, held: DataFrame) -> DataFrame:
    """Rows (passage, conv_id, turn, to_turn): of each asked passage, the largest turn of its conversation before its own that holds it. A passage of any frequency is searched in blocks of turns, and the blocks by their largest turns."""
    names = ["passage", "conv_id"]
    events = asked.select(*names, "turn", F.lit(None).cast("long").alias("holder")).unionByName(held.select(*names, "turn", F.col("turn").cast("long").alias("holder")))
    events = events.withColumn("block", F.floor(F.col("turn") / SPAN))
    tops = events.groupBy(*names, "block").agg(F.max("holder").alias("top"))
    below = Window.partitionBy(*names).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*names, "block", F.max("top").over(below).alias("below"))
    earlier = Window.partitionBy(*names, "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = events.withColumn("inside", F.max("holder").over(earlier)).where("holder is null").join(tops, [*names, "block"])
    return found.select(*names, "turn", F.coalesce("inside", "below").alias("to_turn")).where("to_turn is not null").distinct()


def _elsewhere(held: DataFrame) -> DataFrame:
    """Rows (passage, first, second): the first message that holds a passage, and the first of another conversation."""
    places = held.groupBy("passage", "conv_id").agg(F.min("turn").alias("turn"))
    place = F.min(F.struct("conv_id", "turn"))
    firsts = places.groupBy("passage").agg(place.alias("first"))
    others = places.join(firsts, "passage").where(F.col("conv_id") != F.col("first.conv_id")).groupBy("passage").agg(place.alias("second"))
    return firsts.join(others, "passage", "left")


def block_links(parsed: DataFrame) -> DataFrame:
    """A row for each quoted block that finds its original: KEY, place, level, to_conv, to_turn. Of lines' messages with equally many of the block's lines, one in its conversation is taken, then the latest there, else the first."""
    quoted = parsed.where(F.size("quotes") > 0).select(*KEY, F.posexplode("quotes").alias("place", "quote"))
    whole = _digests(F.array(F.array_join("quote.lines", " ")))
    passages = F.concat(F.transform(whole, lambda p: F.struct(p.alias("passage"), F.lit(True).alias("whole"))), F.transform(F.array_except(_digests(F.col("quote.lines")), whole), lambda p: F.struct(p.alias("passage"), F.lit(False).alias("whole"))))
    quoted = quoted.select(*KEY, "place", F.col("quote.level").alias("level"), F.explode(passages).alias("p")).select(*KEY, "place", "level", "p.passage", "p.whole")
    quoted = materialise(quoted, "quoted-passages")
    asked = quoted.select("passage").distinct()
    held = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("held").alias("passage"))
    held = materialise(held.join(asked, "passage", "left_semi").distinct(), "held-passages")
    inside = _nearest(quoted.where("conv_id is not null and turn is not null").select("passage", "conv_id", "turn").distinct(), held)
    found = quoted.join(inside, ["passage", "conv_id", "turn"], "left").join(_elsewhere(held), "passage", "left")
    other = F.when(F.col("first.conv_id").eqNullSafe(F.col("conv_id")), F.col("second")).otherwise(F.col("first"))
    found = found.select(*KEY, "place", "level", "passage", "whole", F.when(F.col("to_turn").isNotNull(), F.col("conv_id")).otherwise(other["conv_id"]).alias("to_conv"), F.coalesce("to_turn", other["turn"]).alias("to_turn")).where("to_turn is not null")
    found = materialise(found, "passage-links")
    # how many of a block's lines each of its candidates holds
    block = [*KEY, "place", "level"]
    candidates = found.where("not whole").select(*block, "to_conv", "to_turn").distinct()
    lines = _join(candidates, quoted.where("not whole").select(*block, "passage"), block)
    at = held.select("passage", F.col("conv_id").alias("to_conv"), F.col("turn").alias("to_turn"))
    votes = lines.join(at, ["passage", "to_conv", "to_turn"], "left_semi").groupBy(*block, "to_conv", "to_turn").agg(F.count("*").alias("votes"))
    votes = votes.unionByName(found.where("whole").select(*block, "to_conv", "to_turn", F.lit(1 << 62).alias("votes")))
    away = ~F.col("to_conv").eqNullSafe(F.col("conv_id"))
    order = F.struct((-F.col("votes")).alias("votes"), away.cast("int").alias("away"), "to_conv", F.when(away, F.col("to_turn")).otherwise(-F.col("to_turn")).alias("order"), "to_turn")
    best = votes.groupBy(*block).agg(F.min(order).alias("best"))
    return best.select(*block, F.col("best.to_conv").alias("to_conv"), F.col("best.to_turn").alias("to_turn"))


def reply_depths(parents: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, root_turn, depth) for every message with a parent, from rows (conv_id, turn, parent_turn), parent_turn < turn, one a message. Pointers double each round: rounds grow with the logarithm of the longest chain."""
    state = materialise(parents.select("conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth")), "replies")
    while True:
        up = state.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("above"), F.col("depth").alias("more"))
        joined = state.select("conv_id", "turn", "root_turn", "depth").join(up, ["conv_id", "root_turn"], "left")
        moved = materialise(joined.select("conv_id", "turn", F.coalesce("above", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved")), "replies")
        again = not moved.where("moved").isEmpty()
        discard(state)
        if not again:
            return moved.drop("moved")
        state = moved


def link_quotations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages without quotations, in reply order: conv_id, turn, role, body, n_quotes, n_linked, max_level, parent_turn, source_conv, source_turn, root_turn, depth, position.

    The outermost linked quotation of a message (the first of equals) decides: parent_turn if it is in the conversation, else
    source_conv and source_turn. root_turn and depth come from the chain of parents; a message without one is its own root.
    position (from 1) orders a conversation by root, depth, turn, role and MD5 of the text, so every message comes after the
    one that it answers. Equal rows share a position. Null texts are empty; a null conversation is one of its own whose messages
    aren't originals; null turns come first, neither answer nor are answered. Only the four named columns are read. An empty
    table gives no rows.
    """
    parsed = parse(messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")))
    parsed = materialise(parsed, "parsed-messages")
    links = materialise(block_links(parsed), "quote-links")
    # a message's links, by level and place
    per = links.groupBy(*KEY).agg(F.count("*").alias("n_linked"), F.min(F.struct("level", "place", "to_conv", "to_turn")).alias("best"))
    per = per.select(*KEY, "n_linked", F.when(F.col("best.to_conv") == F.col("conv_id"), F.col("best.to_turn")).alias("parent_turn"), "best")
    per = per.select(*KEY, "n_linked", "parent_turn", F.when(F.col("parent_turn").isNull(), F.col("best.to_conv")).alias("source_conv"), F.when(F.col("parent_turn").isNull(), F.col("best.to_turn")).alias("source_turn"))
    per = materialise(per, "message-links")
    depths = reply_depths(per.where("parent_turn is not null").groupBy("conv_id", "turn").agg(F.min("parent_turn").alias("parent_turn")))

    keys = _join(parsed.select(*KEY).distinct(), per, KEY, "left")
    keys = keys.join(depths, ["conv_id", "turn"], "left").withColumns({"root_turn": F.coalesce("root_turn", "turn"), "depth": F.coalesce("depth", F.lit(0).cast("long"))})
    # ranges of the whole order split a conversation of any length, and a thread of any shape; ranks in them follow from the ranges' sizes
    order = ["conv_id", "root_turn", "depth", "turn", "role", "mark"]
    ranges = keys.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    keys = materialise(ranges, "message-ranges")
    keys = keys.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*[F.asc_nulls_first(c) for c in order[1:]])))
    sizes = keys.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    sizes = sizes.select("conv_id", "range", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("range")) - F.col("n")).alias("before"))
    keys = _join(keys, sizes, ["conv_id", "range"]).withColumn("position", F.col("before") + F.col("rank"))
    keys = keys.select(*KEY, "n_linked", "parent_turn", "source_conv", "source_turn", "root_turn", "depth", "position")
    rows = parsed.select(*KEY, "body", F.size("quotes").cast("long").alias("n_quotes"), F.coalesce(F.array_max(F.col("quotes.level")), F.lit(0)).cast("long").alias("max_level"))
    return _join(rows, keys, KEY).select(
        F.col("conv_id").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "body", "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "max_level",
        "parent_turn", "source_conv", "source_turn", "root_turn", "depth", "position",
    )


def op1_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(table(spark, sf_dir, "conversations"))


OP1_SQL = rf"""
WITH RECURSIVE l AS (SELECT conv_id, turn, role, md5(text) AS mark, unnest(regexp_split_to_array(coalesce(text, ''), '\r?\n')) AS line,
    generate_subscripts(regexp_split_to_array(coalesce(text, ''), '\r?\n'), 1) AS i FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
p AS (SELECT *, regexp_extract(line, '^((?:[ \t]*>)*)', 1) AS prefix FROM l),
v AS (SELECT conv_id, turn, role, mark, i, length(prefix) - length(replace(prefix, '>', '')) AS level, substr(line, length(prefix) + 1) AS words FROM p),
n AS (SELECT *, coalesce(lead(level) OVER m, 0) AS after, lag(level) OVER m IS DISTINCT FROM level AS starts FROM v WINDOW m AS (PARTITION BY conv_id, turn, role, mark ORDER BY i)),
b AS (SELECT *, sum(starts::INT) OVER (PARTITION BY conv_id, turn, role, mark ORDER BY i) AS place FROM n),
own AS (SELECT conv_id, turn, role, mark, i, words FROM b WHERE level = 0 AND NOT (regexp_matches(words, '{ATTRIBUTION}') AND after > 0)),
body AS (SELECT conv_id, turn, role, mark, trim(string_agg(words, chr(10) ORDER BY i), ' ' || chr(9) || chr(13) || chr(10)) AS body FROM own GROUP BY ALL),
q AS (SELECT conv_id, turn, role, mark, place, level, string_agg(words, ' ' ORDER BY i) AS whole FROM b WHERE level > 0 GROUP BY ALL),
norm(conv_id, turn, role, mark, place, level, form, whole) AS (
    SELECT conv_id, turn, role, mark, place, level, form, bool_or(whole) FROM (
    SELECT conv_id, turn, role, mark, place, level, trim(lower(regexp_replace(w, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))) AS form, whole FROM (
        SELECT conv_id, turn, role, mark, place, level, whole AS w, true AS whole FROM q UNION ALL SELECT conv_id, turn, role, mark, place, level, words, false FROM b WHERE level > 0))
    WHERE form <> '' GROUP BY ALL),
quotes AS (SELECT conv_id, turn, role, mark, place, level FROM q WHERE regexp_matches(whole, '[\p{{L}}\p{{N}}]')),
held AS (SELECT DISTINCT conv_id, turn, trim(lower(regexp_replace(w, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))) AS form FROM (
    SELECT conv_id, turn, body AS w FROM body UNION ALL SELECT conv_id, turn, words FROM own) WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
inside AS (SELECT n.conv_id, n.turn, n.form, max(h.turn) AS near FROM (SELECT DISTINCT conv_id, turn, form FROM norm) n JOIN held h ON h.form = n.form AND h.conv_id = n.conv_id AND h.turn < n.turn GROUP BY ALL),
outside AS (SELECT n.conv_id, n.form, min((h.conv_id, h.turn)) AS far FROM (SELECT DISTINCT conv_id, form FROM norm) n JOIN held h ON h.form = n.form AND h.conv_id IS DISTINCT FROM n.conv_id GROUP BY ALL),
hits AS (SELECT n.*, CASE WHEN i.near IS NOT NULL THEN n.conv_id ELSE o.far[1] END AS to_conv, coalesce(i.near, o.far[2]) AS to_turn
    FROM norm n LEFT JOIN inside i ON i.form = n.form AND i.conv_id = n.conv_id AND i.turn = n.turn LEFT JOIN outside o ON o.form = n.form AND o.conv_id IS NOT DISTINCT FROM n.conv_id),
candidates AS (SELECT DISTINCT conv_id, turn, role, mark, place, level, to_conv, to_turn FROM hits WHERE to_turn IS NOT NULL AND NOT whole),
votes AS (SELECT c.*, count(*) AS votes FROM candidates c JOIN norm n ON n.conv_id IS NOT DISTINCT FROM c.conv_id AND n.turn IS NOT DISTINCT FROM c.turn AND n.role IS NOT DISTINCT FROM c.role AND n.mark IS NOT DISTINCT FROM c.mark AND n.place = c.place AND NOT n.whole
    JOIN held h ON h.form = n.form AND h.conv_id = c.to_conv AND h.turn = c.to_turn GROUP BY ALL
    UNION ALL SELECT conv_id, turn, role, mark, place, level, to_conv, to_turn, 4611686018427387904 FROM hits WHERE to_turn IS NOT NULL AND whole),
blocks AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY conv_id, turn, role, mark, place ORDER BY votes DESC, (to_conv IS DISTINCT FROM conv_id)::INT, to_conv, CASE WHEN to_conv IS DISTINCT FROM conv_id THEN to_turn ELSE -to_turn END) = 1),
best AS (SELECT *, count(*) OVER (PARTITION BY conv_id, turn, role, mark) AS n_linked FROM blocks QUALIFY row_number() OVER (PARTITION BY conv_id, turn, role, mark ORDER BY level, place) = 1),
up AS (SELECT conv_id, turn, min(to_turn) AS parent FROM best WHERE to_conv = conv_id GROUP BY ALL),
chain AS (SELECT conv_id, turn, parent AS root, 1 AS depth FROM up UNION ALL SELECT c.conv_id, c.turn, u.parent, c.depth + 1 FROM chain c JOIN up u ON u.conv_id = c.conv_id AND u.turn = c.root),
roots AS (SELECT conv_id, turn, min(root) AS root, max(depth) AS depth FROM chain GROUP BY ALL),
counts AS (SELECT conv_id, turn, role, mark, count(*) AS n_quotes, max(level) AS max_level FROM quotes GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role, coalesce(body.body, '') AS body, coalesce(n_quotes, 0)::BIGINT AS n_quotes, coalesce(n_linked, 0)::BIGINT AS n_linked, coalesce(max_level, 0)::BIGINT AS max_level,
    CASE WHEN best.to_conv = m.conv_id THEN best.to_turn END AS parent_turn,
    CASE WHEN best.to_conv IS DISTINCT FROM m.conv_id THEN best.to_conv END AS source_conv, CASE WHEN best.to_conv IS DISTINCT FROM m.conv_id THEN best.to_turn END AS source_turn,
    coalesce(roots.root, m.turn) AS root_turn, coalesce(roots.depth, 0)::BIGINT AS depth,
    dense_rank() OVER (PARTITION BY m.conv_id ORDER BY coalesce(roots.root, m.turn) NULLS FIRST, coalesce(roots.depth, 0), m.turn NULLS FIRST, m.role NULLS FIRST, md5(m.text) NULLS FIRST)::BIGINT AS position
FROM conversations m
LEFT JOIN body ON body.conv_id IS NOT DISTINCT FROM m.conv_id AND body.turn IS NOT DISTINCT FROM m.turn AND body.role IS NOT DISTINCT FROM m.role AND body.mark IS NOT DISTINCT FROM md5(m.text)
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM m.conv_id AND counts.turn IS NOT DISTINCT FROM m.turn AND counts.role IS NOT DISTINCT FROM m.role AND counts.mark IS NOT DISTINCT FROM md5(m.text)
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM m.conv_id AND best.turn IS NOT DISTINCT FROM m.turn AND best.role IS NOT DISTINCT FROM m.role AND best.mark IS NOT DISTINCT FROM md5(m.text)
LEFT JOIN roots ON roots.conv_id = m.conv_id AND roots.turn = m.turn
"""
