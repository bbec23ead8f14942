"""Chat formatting by quotation linking (native DataFrame code).

Messages quote earlier ones with ``>`` marks, ``>>`` for a quote in a quote.
Each message is parsed into its own lines and its quoted passages (runs of
lines of one level); passages and their lines are normalised and hashed and
joined to the messages that said them: the latest earlier message of the same
conversation, else the first one anywhere. A message answers the message its
longest level-1 passage was said in. Conversations come back without quotes,
thread by thread, every reply after what it answers.

Normalised: lower-cased, runs of white space one space, trimmed. Messages are
(conv_id, turn); rows with the same pair are parts of one message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.common import materialize

QUOTE = r"^[ \t]*((?:>[ \t]?)+)"
TURN_BLOCK = 1024      # turns per group when the latest earlier saying is searched
MAX_ROUNDS = 60


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once (a bound lambda variable)."""
    return F.transform(F.array(value), body)[0]


def lines_with_level(text: Column) -> Column:
    """array<struct<level int, line string>>: quote level and the line without its marks."""
    def parse(line: Column) -> Column:
        mark = F.regexp_extract(line, QUOTE, 1)
        return F.struct(F.length(F.regexp_replace(mark, "[^>]", "")).alias("level"),
                        F.regexp_replace(line, QUOTE, "").alias("line"))
    return F.transform(F.split(text, "\r?\n"), parse)


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def own_text(lines: Column) -> Column:
    """The unquoted lines, outer blank lines trimmed."""
    own = F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    return F.regexp_replace(own, r"^\s+|\s+$", "")


def runs(lines: Column) -> Column:
    """array<struct<level, passage, parts array<string>>> of the quoted runs; parts
    are the normalised lines."""
    def cut(ls: Column) -> Column:
        n = F.size(ls)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (
            F.get(ls, i)["level"] != F.get(ls, F.greatest(i - 1, F.lit(0)))["level"]))

        def passage(st: Column) -> Column:
            def piece(start: Column, k: Column) -> Column:
                end = F.coalesce(F.get(st, k + 1), n)
                part = F.slice(ls, start + 1, end - start)
                return F.struct(
                    F.get(ls, start)["level"].alias("level"),
                    normalise(F.array_join(F.transform(part, lambda x: x["line"]), " ")).alias("passage"),
                    F.filter(F.transform(part, lambda x: normalise(x["line"])), lambda s: s != "").alias("parts"))
            return F.transform(st, piece)
        return let(starts, passage)
    return F.filter(let(lines, cut), lambda r: (r["level"] > 0) & (r["passage"] != ""))


def parsed(messages: DataFrame) -> DataFrame:
    """``messages(conv_id, turn, role, text)`` with ``lines`` parsed and ``own`` text:
    a message without quotes as it is, others without the quoted lines."""
    return messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("_text"),
                           lines_with_level(F.coalesce("text", F.lit(""))).alias("lines")) \
        .withColumn("own", F.when(F.exists("lines", lambda x: x["level"] > 0), own_text(F.col("lines")))
                    .otherwise(F.col("_text"))).drop("_text")


def quoted_units(messages: DataFrame) -> DataFrame:
    """One row per quoted passage and per line of one: conv_id, turn, level, unit, n (characters)."""
    return parsed(messages.where(F.col("text").rlike(r"(?m)" + QUOTE))) \
        .select("conv_id", "turn", F.explode(runs(F.col("lines"))).alias("r")) \
        .select("conv_id", "turn", F.col("r.level").alias("level"),
                F.explode(F.array_distinct(F.concat(F.array("r.passage"), F.col("r.parts")))).alias("u")) \
        .select("conv_id", "turn", "level", F.xxhash64("u").alias("unit"), F.length("u").alias("n"))


def said_units(messages: DataFrame) -> DataFrame:
    """One row per message and own passage: the whole own text and each own line."""
    return parsed(messages).select("conv_id", "turn", F.explode(F.array_distinct(F.concat(
        F.array(normalise(F.col("own"))),
        F.transform(F.filter(F.col("lines"), lambda x: x["level"] == 0), lambda x: normalise(x["line"]))))).alias("u")) \
        .where("u <> ''").select("conv_id", "turn", F.xxhash64("u").alias("unit"))


def _latest_before(quotes: DataFrame, said: DataFrame) -> DataFrame:
    """For each (conv_id, unit, turn) of ``quotes`` the latest turn of ``said``
    before it. Groups are cut into blocks of turns; only each block's last
    saying goes on to the search over blocks, so no conversation or common
    line is one task's group."""
    every = quotes.select("conv_id", "unit", "turn", F.lit(True).alias("asks")) \
        .unionByName(said.select("conv_id", "unit", "turn", F.lit(False).alias("asks"))).distinct() \
        .withColumn("block", F.floor(F.col("turn") / TURN_BLOCK))
    said_turn = F.when(~F.col("asks"), F.col("turn"))
    inside = Window.partitionBy("conv_id", "unit", "block").orderBy("turn") \
        .rangeBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("conv_id", "unit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = every.groupBy("conv_id", "unit", "block").agg(F.max(said_turn).alias("last"), F.max("asks").alias("asks")) \
        .withColumn("earlier", F.max("last").over(before)).where("asks").select("conv_id", "unit", "block", "earlier")
    return every.withColumn("near", F.max(said_turn).over(inside)).where("asks") \
        .join(blocks, ["conv_id", "unit", "block"]) \
        .select("conv_id", "unit", "turn", F.coalesce("near", "earlier").alias("said_turn"))


def quote_links(messages: DataFrame) -> DataFrame:
    """One row per quoted unit of a message: conv_id, turn, level, unit, n,
    said_conv, said_turn (NULL where nobody said it)."""
    known = messages.where("conv_id is not null and turn is not null")
    quotes = materialize(quoted_units(known).distinct(), "quotes")
    wanted = quotes.select("unit").distinct()
    said = materialize(said_units(known).join(wanted, "unit", "left_semi").distinct(), "quotes-said")
    here = materialize(_latest_before(quotes, said), "quotes-here").where("said_turn is not null")
    # the first saying, and the first in another conversation than that: one of them is elsewhere
    sayer = F.struct("conv_id", "turn")
    first = materialize(said.groupBy("unit").agg(F.min(sayer).alias("first")), "quotes-first")
    second = said.join(first, "unit").where(F.col("conv_id") != F.col("first.conv_id")) \
        .groupBy("unit").agg(F.min(sayer).alias("second"))
    sayings = materialize(first.join(second, "unit", "left"), "quotes-sayings")
    elsewhere = F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("second"))
    return quotes.join(here, ["conv_id", "unit", "turn"], "left").join(sayings, "unit", "left") \
        .withColumn("elsewhere", F.when(F.col("said_turn").isNull(), elsewhere)) \
        .select("conv_id", "turn", "level", "unit", "n",
                F.when(F.col("said_turn").isNotNull(), F.col("conv_id"))
                .otherwise(F.col("elsewhere.conv_id")).alias("said_conv"),
                F.coalesce("said_turn", "elsewhere.turn").alias("said_turn"))


def reply_parents(links: DataFrame) -> DataFrame:
    """One row per message with a linked passage: conv_id, turn, parent_conv,
    parent_turn, n_links. The outermost level counts first, then the longer
    passage, then the own conversation, then the later message."""
    rank = F.struct(-F.col("level"), F.col("n"), (F.col("said_conv") == F.col("conv_id")).cast("int"),
                    "said_turn", "said_conv")
    return links.where("said_turn is not null").groupBy("conv_id", "turn") \
        .agg(F.max_by(F.struct("said_conv", "said_turn"), rank).alias("p"), F.count("*").alias("n_links")) \
        .select("conv_id", "turn", F.col("p.said_conv").alias("parent_conv"),
                F.col("p.said_turn").alias("parent_turn"), "n_links")


def reply_threads(parents: DataFrame) -> DataFrame:
    """Thread root and depth of every message that answers one of its own
    conversation, by pointer jumping: conv_id, turn, thread_turn, depth."""
    inner = parents.where("parent_conv = conv_id")
    state = materialize(inner.select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).alias("depth")),
                        "threads")
    for _ in range(MAX_ROUNDS):
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("top"), F.col("depth").alias("more"))
        step = materialize(
            state.join(above, ["conv_id", "up"], "left")
            .select("conv_id", "turn", F.coalesce("top", "up").alias("up"),
                    (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                    F.col("top").isNotNull().alias("moved")), "threads")
        state = step.drop("moved")
        if step.where("moved").isEmpty():
            return state.withColumnRenamed("up", "thread_turn")
    raise RuntimeError(f"threads did not settle in {MAX_ROUNDS} rounds")


def linked_conversations(messages: DataFrame) -> DataFrame:
    """One row per row of ``messages(conv_id, turn, role, text)``: conv_id, turn,
    role, text without quotes, thread_turn and depth (the place in the reply
    order: sort a conversation by thread_turn, depth, turn), parent_conv and
    parent_turn (what it answers, if known), n_links.

    Messages without a linked quote start a thread of their own (depth 0). A
    NULL text is empty. Rows with a NULL conv_id or turn are kept and linked
    with nothing. Repeated rows come out as often. A message is never linked
    to itself or, in its conversation, to a later one. Other columns are
    ignored; an empty table gives no rows."""
    messages = messages.select("conv_id", "turn", "role", "text")
    parents = materialize(reply_parents(quote_links(messages)), "reply-parents")
    place = materialize(parents.join(reply_threads(parents), ["conv_id", "turn"], "left"), "reply-place")
    return parsed(messages).select("conv_id", "turn", "role", F.col("own").alias("text")) \
        .join(place, ["conv_id", "turn"], "left") \
        .select("conv_id", "turn", "role", "text",
                F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).alias("depth"),
                "parent_conv", "parent_turn", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))


ORACLE_SQL = r"""
with recursive m as (
  select row_number() over () as id, conv_id, turn, role, coalesce(text, '') as text from conversations),
l as (
  select id, conv_id, turn, generate_subscripts(ls, 1) as i, unnest(ls) as line
  from (select *, regexp_split_to_array(text, '\r?\n') as ls from m)),
p as (
  select id, conv_id, turn, i, len(regexp_replace(regexp_extract(line, '^[ \t]*((?:>[ \t]?)+)', 1), '[^>]', '', 'g')) as level,
    regexp_replace(line, '^[ \t]*((?:>[ \t]?)+)', '') as line
  from l),
own as (
  select id, case when max(level) = 0 then any_value(text) else
    coalesce(regexp_replace(string_agg(line, chr(10) order by i) filter (level = 0), '^\s+|\s+$', '', 'g'), '') end as own
  from p join m using (id) group by id),
g as (select *, i - row_number() over (partition by id, level order by i) as run from p),
r as (
  select id, conv_id, turn, level, run, trim(regexp_replace(lower(string_agg(line, ' ' order by i)), '\s+', ' ', 'g')) as u
  from g where level > 0 group by id, conv_id, turn, level, run),
q as (
  select distinct conv_id, turn, level, u from (
    select conv_id, turn, level, u from r where u <> ''
    union all
    select g.conv_id, g.turn, g.level, trim(regexp_replace(lower(g.line), '\s+', ' ', 'g'))
    from g join r on r.id = g.id and r.level = g.level and r.run = g.run and r.u <> '')
  where u <> '' and conv_id is not null and turn is not null),
said as (
  select distinct conv_id, turn, u from (
    select conv_id, turn, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) as u from p where level = 0
    union all
    select conv_id, turn, trim(regexp_replace(lower(own), '\s+', ' ', 'g')) from m join own using (id))
  where u <> '' and conv_id is not null and turn is not null),
here as (
  select q.conv_id, q.turn, q.level, q.u, max(s.turn) as t
  from q left join said s on s.conv_id = q.conv_id and s.u = q.u and s.turn < q.turn group by all),
link as (
  select here.conv_id, here.turn, level, here.u, length(here.u) as n, t,
    min(row(s.conv_id, s.turn)) filter (s.conv_id is not null) as f,
    case when t is not null then here.conv_id else f[1] end as sc, case when t is not null then t else f[2] end as st
  from here left join said s on s.u = here.u and s.conv_id <> here.conv_id group by here.conv_id, here.turn, level, here.u, t),
par as (
  select conv_id, turn, max(row(-level, n, (sc = conv_id)::int, st, sc)) as best, count(*) as n_links
  from link where st is not null group by 1, 2),
pt as (select conv_id, turn, best[5] as pc, best[4] as pt, n_links from par),
up as (
  select conv_id, turn, pt as up_turn, 1 as depth from pt where pc = conv_id
  union all
  select up.conv_id, up.turn, pt.pt, up.depth + 1 from up join pt on pt.conv_id = up.conv_id and pt.turn = up.up_turn
    and pt.pc = pt.conv_id),
th as (select conv_id, turn, arg_max(up_turn, depth) as root, max(depth) as depth from up group by 1, 2)
select m.conv_id, m.turn, m.role, own.own as text, coalesce(th.root, m.turn) as thread_turn,
  cast(coalesce(th.depth, 0) as int) as depth, pt.pc as parent_conv, pt.pt as parent_turn, coalesce(pt.n_links, 0) as n_links
from m join own using (id) left join pt on pt.conv_id = m.conv_id and pt.turn = m.turn
  left join th on th.conv_id = m.conv_id and th.turn = m.turn
"""
