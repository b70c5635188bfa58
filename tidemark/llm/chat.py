"""Chat formatting by quotation linking, with DataFrame functions only.

Lines that begin with ``>`` are quotes, as deep as they have marks. Quoted text is cut into sentences,
which are normalised and hashed, and a hash is joined to the first earlier message of the conversation
that says the sentence in its own words. The message that most sentences of the outermost quote come
from is the one replied to. Conversations are put in reply order, depth first, and formatted without the
quotes, ``PART_MESSAGES`` messages a row.

A place in a conversation is the number of rows in the trees before, which are summed by buckets of turns,
and in the own tree, which is walked by pointer doubling. So neither a conversation that holds a large share
of all rows nor one long thread meets in one task; only rows that repeat one turn do.

Defined cases: a null text is an empty message, a null role ``unknown``; without quotes the turns'
order stands; a null conv_id or turn is never linked and sorts first; rows that repeat a turn are
messages of their own with one parent, in order of role and text; of a quote with longer sentences,
those of fewer than ``LEAST_CHARS`` characters link nothing; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, table

PART_MESSAGES = 512
BUCKET_TURNS = 256
LEAST_CHARS = 12
QUOTE = "^[ \\t]*(>[ \\t]*)+"
ATTRIBUTION = "wrote:[ \\t\\r]*$"


def parsed_lines(text: Column) -> Column:
    """Lines as (level, body): the number of quote marks, and the line without them."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda line: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 0), "[^>]", "")).alias("level"),
            F.regexp_replace(line, QUOTE, "").alias("body"),
        ),
    )


def own_text(lines: Column) -> Column:
    """The unquoted lines, less those that announce the quote after them."""
    kept = F.filter(
        lines,
        lambda line, i: (line["level"] == 0)
        & ~(line["body"].rlike(ATTRIBUTION) & F.coalesce(F.get(lines, i + 1)["level"] > 0, F.lit(False))),
    )
    return F.trim(F.array_join(F.transform(kept, lambda line: line["body"]), "\n"), F.lit(" \n\t\r"))


def sentences(text: Column) -> Column:
    """Normalised sentences: lower case, letters and digits, single blanks."""
    flat = F.lower(F.regexp_replace(text, "[ \\t\\r\\n\\f]+", " "))
    parts = F.split(F.regexp_replace(flat, "([.!?]) ", "$1\n"), "\n")
    plain = F.transform(parts, lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, "[^\\p{L}\\p{N} ]", ""), " +", " ")))
    return F.array_distinct(F.filter(plain, lambda s: F.length(s) > 0))


def linking(quoted: Column) -> Column:
    """What links a quote: its sentences of ``LEAST_CHARS`` characters at least, or all if it has none such."""
    long = F.filter(quoted, lambda s: F.length(s) >= LEAST_CHARS)
    return F.when(F.size(long) > 0, long).otherwise(quoted)


def quoted_text(lines: Column, level: Column) -> Column:
    return F.array_join(F.transform(F.filter(lines, lambda line: line["level"] == level), lambda line: line["body"]), " ")


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, lines and body of every message."""
    lined = messages.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), parsed_lines(F.col("text")).alias("lines"))
    return lined.withColumn("body", own_text(F.col("lines")))


def reply_links(parsed: DataFrame) -> DataFrame:
    """conv_id, turn and parent: the earlier message that a message quotes outermost and most."""
    said = (
        parsed.select("conv_id", "turn", F.explode(sentences(F.col("body"))).alias("sentence"))
        .groupBy("conv_id", F.xxhash64("sentence").alias("passage"))
        .agg(F.min("turn").alias("parent"))
    )
    levels = F.array_distinct(F.transform(F.filter("lines", lambda line: line["level"] > 0), lambda line: line["level"]))
    quoted = (
        parsed.where(F.exists("lines", lambda line: line["level"] > 0))
        .select("conv_id", "turn", "lines", F.explode(levels).alias("level"))
        .select("conv_id", "turn", "level", F.explode(linking(sentences(quoted_text(F.col("lines"), F.col("level"))))).alias("sentence"))
        .select("conv_id", "turn", "level", F.xxhash64("sentence").alias("passage"))
    )
    met = quoted.join(said, ["conv_id", "passage"]).where("parent < turn")
    votes = met.groupBy("conv_id", "turn", "parent").agg(F.min("level").alias("level"), F.count("*").alias("votes"))
    best = F.max_by("parent", F.struct((-F.col("level")).alias("level"), "votes", "parent"))
    return votes.groupBy("conv_id", "turn").agg(best.alias("parent"))


def _siblings(links: DataFrame) -> DataFrame:
    """conv_id, turn, parent and sibling (the next turn with that parent). A parent's replies meet in buckets of turns."""
    bucketed = links.select("conv_id", "turn", "parent", F.floor(F.col("turn") / BUCKET_TURNS).alias("bucket"))
    inside = Window.partitionBy("conv_id", "parent", "bucket").orderBy("turn")
    starts = bucketed.groupBy("conv_id", "parent", "bucket").agg(F.min("turn").alias("start"))
    after = starts.select("conv_id", "parent", "bucket", F.lead("start").over(Window.partitionBy("conv_id", "parent").orderBy("bucket")).alias("after"))
    return (
        bucketed.withColumn("sibling", F.lead("turn").over(inside))
        .join(after, ["conv_id", "parent", "bucket"])
        .select("conv_id", "turn", "parent", F.coalesce("sibling", "after").alias("sibling"))
    )


def reply_order(links: DataFrame, counts: DataFrame) -> DataFrame:
    """conv_id, turn, parent, top (the tree's root), before, depth and size of every message that replies or is replied to.

    ``before`` counts the rows (``counts``: conv_id, turn, n) that stand before a message in its tree, depth first, and
    ``size`` all rows of the tree. A tree is walked as a list of events, entering and leaving each message; every event
    points to a later one, and pointers double until they reach the tree's end. So an event keeps its few numbers
    however deep the thread is, and no two events of a round point to one.
    """
    kids = materialise(_siblings(links), "kids")
    tops = links.select("conv_id", F.col("parent").alias("turn")).distinct().join(links.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")
    none = F.lit(None).cast("long")
    tree = kids.unionByName(tops.select("conv_id", "turn", none.alias("parent"), none.alias("sibling")))
    first = links.groupBy("conv_id", "parent").agg(F.min("turn").alias("child")).select("conv_id", F.col("parent").alias("turn"), "child")
    tree = tree.join(first, ["conv_id", "turn"], "left").join(counts, ["conv_id", "turn"])
    # Leaving is odd, entering even: (turn, leaves) names an event.
    enter = F.struct(
        F.lit(0).alias("leaves"), F.coalesce("child", "turn").alias("to"), F.when(F.col("child").isNull(), 1).otherwise(0).alias("to_leaves"), F.col("n").alias("rows"), F.lit(1).alias("down")
    )
    leave = F.struct(
        F.lit(1).alias("leaves"), F.coalesce("sibling", "parent").alias("to"), F.when(F.col("sibling").isNull(), 1).otherwise(0).alias("to_leaves"), F.lit(0).cast("long").alias("rows"), F.lit(-1).alias("down")
    )
    events = tree.select("conv_id", "turn", F.explode(F.array(enter, leave)).alias("e")).select(
        "conv_id", "turn", "e.leaves", "e.to", "e.to_leaves", "e.rows", F.col("e.down").cast("long").alias("down"), F.when(F.col("e.to").isNull(), F.col("turn")).alias("top")
    )
    state = materialise(events, "events")
    while not state.where("to is not null").isEmpty():
        later = state.select(
            "conv_id", F.col("turn").alias("to"), F.col("leaves").alias("to_leaves"), F.col("to").alias("far"), F.col("to_leaves").alias("far_leaves"),
            F.col("rows").alias("far_rows"), F.col("down").alias("far_down"), F.col("top").alias("far_top"),
        )
        met = state.join(later, ["conv_id", "to", "to_leaves"], "left")
        state = materialise(
            met.select(
                "conv_id", "turn", "leaves", F.col("far").alias("to"), F.coalesce("far_leaves", "to_leaves").alias("to_leaves"),
                (F.col("rows") + F.coalesce("far_rows", F.lit(0))).alias("rows"), (F.col("down") + F.coalesce("far_down", F.lit(0))).alias("down"), F.coalesce("far_top", "top").alias("top"),
            ),
            "events",
            state,
        )
    ranked = state.where("leaves = 0").select("conv_id", "turn", "top", F.col("rows").alias("rest"), (-F.col("down")).alias("depth"))
    sizes = ranked.where("turn = top").select("conv_id", "top", F.col("rest").alias("size"))
    met = ranked.join(sizes, ["conv_id", "top"]).join(links, ["conv_id", "turn"], "left")
    return met.select("conv_id", "turn", "parent", "top", (F.col("size") - F.col("rest")).alias("before"), "depth", "size")


def link_messages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, parent, depth and position of every message; positions are reply order, gapless from 0."""
    parsed = parse(messages)
    links = materialise(reply_links(parsed), "links")
    plain = parsed.select("conv_id", "turn", "role", "body")
    counts = messages.groupBy("conv_id", "turn").agg(F.count("*").alias("n"))
    alone = [F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("depth")]
    if links.isEmpty():
        placed = counts.select("conv_id", "turn", *alone, F.col("turn").alias("top"), F.col("n").alias("size"))
    else:
        tree = materialise(reply_order(links, counts), "trees")
        rest = counts.join(tree.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")
        placed = rest.select("conv_id", "turn", *alone, F.col("turn").alias("top"), F.col("n").alias("size")).unionByName(tree.select("conv_id", "turn", "parent", "before", "depth", "top", "size"))
    # Trees and messages alone stand in the order of their first turns: rows in the buckets before, and in the own one.
    roots = placed.where("parent is null").select(F.col("conv_id").alias("root_conv"), F.col("top").alias("root_turn"), "size", F.floor(F.col("top") / BUCKET_TURNS).alias("bucket"))
    sums = roots.groupBy(F.col("root_conv").alias("sum_conv"), F.col("bucket").alias("sum_bucket")).agg(F.sum("size").alias("rows"))
    upto = lambda value, w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sums.select("sum_conv", "sum_bucket", upto("rows", Window.partitionBy("sum_conv").orderBy("sum_bucket")).alias("base"))
    inside = roots.select("root_conv", "bucket", "root_turn", upto("size", Window.partitionBy("root_conv", "bucket").orderBy("root_turn")).alias("inside"))
    same = lambda **names: [F.col(a).eqNullSafe(F.col(b)) for a, b in names.items()]
    at = inside.join(bases, same(root_conv="sum_conv", bucket="sum_bucket")).select("root_conv", "root_turn", (F.col("base") + F.col("inside")).alias("base"))
    known = placed.join(at, same(conv_id="root_conv", top="root_turn")).select(
        F.col("conv_id").alias("own_conv"), F.col("turn").alias("own_turn"), "parent", "depth", (F.col("base") + F.col("before")).alias("start")
    )
    met = plain.join(known, same(conv_id="own_conv", turn="own_turn"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "body"))
    return met.select("conv_id", "turn", "role", "body", "parent", "depth", (F.col("start") + nth - 1).alias("position"))


def chat_rows(linked: DataFrame, part_messages: int = PART_MESSAGES) -> DataFrame:
    """A row for each ``part_messages`` messages of a conversation: their turns in reply order, and the formatted chat."""
    message = F.struct("position", "turn", "parent", "role", "body")
    grouped = linked.groupBy("conv_id", F.floor(F.col("position") / part_messages).alias("part")).agg(F.sort_array(F.collect_list(message)).alias("messages"))
    turns = F.transform("messages", lambda m: F.coalesce(m["turn"].cast("string"), F.lit("")))
    replies = F.transform(
        F.filter("messages", lambda m: m["parent"].isNotNull()), lambda m: F.concat_ws(">", m["turn"].cast("string"), m["parent"].cast("string"))
    )
    chat = F.transform("messages", lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["body"], F.lit("\n")))
    return grouped.select(
        "conv_id",
        "part",
        F.size("messages").cast("long").alias("n_messages"),
        F.array_join(turns, ",").alias("turns"),
        F.array_join(replies, ",").alias("replies"),
        F.array_join(chat, "").alias("chat"),
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_rows(link_messages(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


#: The same, for DuckDB.
OP6_SQL = r"""
WITH RECURSIVE lined AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, 'unknown') AS role,
         list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {
           'level': length(regexp_replace(regexp_extract(x, '^[ \t]*(>[ \t]*)+'), '[^>]', '', 'g')),
           'body': regexp_replace(x, '^[ \t]*(>[ \t]*)+', '')}) AS lines
  FROM conversations),
parsed AS (
  SELECT rid, conv_id, turn, role, lines,
         trim(array_to_string(list_transform(list_filter(lines, lambda x, i: x.level = 0 AND NOT (
           regexp_matches(x.body, 'wrote:[ \t\r]*$') AND coalesce(lines[i + 1].level > 0, false))), lambda x: x.body), chr(10)),
           ' ' || chr(10) || chr(9) || chr(13)) AS body
  FROM lined),
said AS (
  SELECT conv_id, sentence, min(turn) AS parent FROM (
    SELECT conv_id, turn, unnest(list_distinct(list_transform(
      string_split(regexp_replace(lower(regexp_replace(body, '[ \t\r\n\f]+', ' ', 'g')), '([.!?]) ', '\1' || chr(10), 'g'), chr(10)),
      lambda s: trim(regexp_replace(regexp_replace(s, '[^\p{L}\p{N} ]', '', 'g'), ' +', ' ', 'g'))))) AS sentence
    FROM parsed) WHERE length(sentence) > 0 GROUP BY ALL),
levels AS (
  SELECT rid, conv_id, turn, lines, unnest(list_distinct(list_transform(list_filter(lines, lambda x: x.level > 0), lambda x: x.level))) AS level
  FROM parsed),
quotes AS (
  SELECT rid, conv_id, turn, level, unnest(list_distinct(list_transform(
      string_split(regexp_replace(lower(regexp_replace(array_to_string(list_transform(list_filter(lines, lambda x: x.level = level), lambda x: x.body), ' '),
        '[ \t\r\n\f]+', ' ', 'g')), '([.!?]) ', '\1' || chr(10), 'g'), chr(10)),
      lambda s: trim(regexp_replace(regexp_replace(s, '[^\p{L}\p{N} ]', '', 'g'), ' +', ' ', 'g'))))) AS sentence
  FROM levels),
linking AS (SELECT * FROM quotes WHERE length(sentence) > 0
  QUALIFY length(sentence) >= 12 OR max(length(sentence)) OVER (PARTITION BY rid, level) < 12),
votes AS (
  SELECT q.conv_id, q.turn, s.parent, min(q.level) AS level, count(*) AS votes
  FROM linking q JOIN said s ON q.conv_id = s.conv_id AND q.sentence = s.sentence AND s.parent < q.turn
  GROUP BY ALL),
links AS (
  SELECT conv_id, turn, parent FROM votes
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, votes DESC, parent DESC) = 1),
keys AS (SELECT DISTINCT k.conv_id, k.turn, l.parent FROM parsed k LEFT JOIN links l ON k.conv_id = l.conv_id AND k.turn = l.turn),
paths AS (
  SELECT conv_id, turn, parent, [turn] AS path FROM keys WHERE parent IS NULL
  UNION ALL
  SELECT k.conv_id, k.turn, k.parent, list_append(p.path, k.turn) FROM keys k JOIN paths p ON k.conv_id = p.conv_id AND k.parent = p.turn),
placed AS (
  SELECT p.conv_id, p.turn, p.role, p.body, t.parent,
         row_number() OVER (PARTITION BY p.conv_id ORDER BY t.path, p.role, p.body) - 1 AS position
  FROM parsed p JOIN paths t ON p.conv_id IS NOT DISTINCT FROM t.conv_id AND p.turn IS NOT DISTINCT FROM t.turn)
SELECT conv_id, CAST(position // 512 AS BIGINT) AS part, count(*) AS n_messages,
       string_agg(coalesce(CAST(turn AS VARCHAR), ''), ',' ORDER BY position) AS turns,
       coalesce(string_agg(CAST(turn AS VARCHAR) || '>' || CAST(parent AS VARCHAR), ',' ORDER BY position) FILTER (parent IS NOT NULL), '') AS replies,
       string_agg('<|' || role || '|>' || chr(10) || body || chr(10), '' ORDER BY position) AS chat
FROM placed GROUP BY conv_id, part
"""
