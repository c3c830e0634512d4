"""Chat formatting by quotation linking, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, spread_join

_MARKS = r"^((?:[ \t]*>)*)"
#: Turns that one row of a built conversation holds.
TURNS = 64
#: Different messages of one turn that stand in the same row.
VARIANTS = 4


def quote_level(line: Column) -> Column:
    """How many quote marks a line begins with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), r"[ \t]", ""))


def normalised(line: Column) -> Column:
    """A line without quote marks, in lower case, with runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, _MARKS, "")), r"\s+", " "))


def with_passages(rows: DataFrame, text: str) -> DataFrame:
    """Adds `lines`, an array of (level, words, line), and `passages`, an array of (level, words): neighbouring lines of one level, up to a blank one, joined by spaces.

    A passage is the same however its lines were broken.
    """
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.struct(quote_level(x).alias("level"), normalised(x).alias("words"), x.alias("line")))
    rows = rows.withColumn("lines", lines)
    at = lambda k: F.element_at("lines", k)
    begins = lambda k: (at(k)["level"] != at(k - 1)["level"]) | (at(k)["words"] == "") | (at(k - 1)["words"] == "")
    rows = rows.withColumn("_at", F.filter(F.sequence(F.lit(1), F.size("lines")), lambda k: F.when(k == 1, F.lit(True)).otherwise(begins(F.greatest(k, F.lit(2))))))
    end = lambda i: F.when(i < F.size("_at"), F.element_at("_at", F.least(i + 1, F.size("_at")))).otherwise(F.size("lines") + 1)
    run = lambda begin, i: F.struct(at(begin)["level"].alias("level"), F.array_join(F.transform(F.slice("lines", begin, end(i) - begin), lambda x: x["words"]), " ").alias("words"))
    return rows.withColumn("passages", F.filter(F.transform("_at", lambda begin, i: run(begin, i + 1)), lambda x: x["words"] != "")).drop("_at")


def sentences(words: Column) -> Column:
    return F.split(F.regexp_replace(words, r"([.!?]) ", "$1\n"), "\n")


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", least_chars: int = 12) -> DataFrame:
    """(conv, turn, role, clean_text, n_quoted, links, reply_to, thread, depth, variants) for each message.

    Lines that begin with quote marks are quotes, their level is the number of marks; `clean_text` has the other lines.
    Neighbouring lines of one level are a passage. Each sentence of a quoted passage belongs to the first message of the
    conversation that says it unquoted, as a sentence of a passage or as a line. A sentence of fewer than `least_chars`
    characters (normalised) belongs there only if no other message of the conversation says it. Sentences meet by hashes
    of 64 and 32 bits.
    `links` lists (level, turn, chars) of each earlier message quoted; `reply_to` is the one quoted at the lowest level,
    by most characters, the later on ties. `thread` is the turn that begins the chain of replies and `depth` the replies
    up to it; a message replies only to smaller turns, so there are no cycles and (conv, thread, turn) puts every reply
    behind what it answers. A message that quotes nothing of an earlier one begins a thread.
    Null texts count as empty; a message with a null conversation or turn stands alone. Messages of one (conv, turn) are
    one to reply to and stay rows of their own (`variants` says how many different ones there are), repeated rows as well.
    Extra columns are left out.
    """
    m = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    m = with_passages(m, "text")
    key = lambda x: F.struct(F.xxhash64("conv", x).alias("k"), F.hash(x).alias("h"), F.length(x).alias("n"))
    of = lambda found: F.flatten(F.transform(F.filter("passages", found), lambda p: F.transform(sentences(p["words"]), lambda x: F.struct(p["level"].alias("level"), x.alias("words")))))
    own = F.filter("lines", lambda x: x["level"] == 0)
    said = F.array_distinct(F.concat(F.transform(of(lambda p: p["level"] == 0), lambda x: x["words"]), F.transform(own, lambda x: x["words"])))
    quoted = F.transform(of(lambda p: p["level"] > 0), lambda x: F.struct(x["level"].alias("level"), key(x["words"]).alias("key")))
    clean = F.trim(F.array_join(F.transform(own, lambda x: x["line"]), "\n"))
    there = F.col("conv").isNotNull() & F.col("turn").isNotNull()
    m = m.select("conv", "turn", "role", clean.alias("clean_text"), (F.size("lines") - F.size(own)).alias("n_quoted"), F.when(there, F.transform(F.filter(said, lambda x: x != ""), key)).alias("said"), F.when(there, quoted).alias("quoted"))
    m = checkpointed(m)
    quotes = m.select("conv", "turn", F.explode("quoted").alias("q")).select("conv", "turn", "q.level", "q.key.*")
    first = m.select("turn", F.explode("said").alias("s")).groupBy("s.k", "s.h", "s.n").agg(F.min("turn").alias("source"), F.max("turn").alias("last"))
    first = first.where((F.col("n") >= least_chars) | (F.col("source") == F.col("last")))
    found = quotes.join(first, ["k", "h", "n"]).where("source < turn").groupBy("conv", "turn", "level", "source").agg(F.sum("n").alias("chars"))
    per_message = found.groupBy("conv", "turn").agg(F.array_sort(F.collect_list(F.struct("level", F.col("source").alias("turn"), "chars"))).alias("links"), F.max(F.struct(-F.col("level"), "chars", "source")).alias("best"))
    replies = checkpointed(per_message.select("conv", "turn", "links", F.col("best.source").alias("reply_to")))
    # threads by doubling: each round looks twice as far up the chains
    chain = replies.select("conv", "turn", F.col("reply_to").alias("top"), F.lit(1).cast("long").alias("depth"), F.lit(True).alias("open"))
    while True:
        up = chain.select("conv", F.col("turn").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"))
        chain = checkpointed(spread_join(chain, up, ["conv", "top"], "turn", "left").select("conv", "turn", F.coalesce("next", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("open")))
        if chain.where("open").isEmpty():
            break
    digest = F.xxhash64("role", "clean_text")
    several = m.where("conv is not null and turn is not null").groupBy("conv", "turn").agg(F.min(digest).alias("x"), F.max(digest).alias("y"), F.approx_count_distinct(digest).alias("about")).where("x <> y").select("conv", "turn", F.greatest("about", F.lit(2)).alias("variants"))
    known = replies.join(chain.select("conv", "turn", F.col("top").alias("thread"), "depth"), ["conv", "turn"]).join(several, ["conv", "turn"], "full")
    out = spread_join(m.drop("said", "quoted"), known, ["conv", "turn"], "clean_text", "left")
    empty = F.array().cast("array<struct<level:int,turn:bigint,chars:bigint>>")
    return out.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "clean_text", "n_quoted", F.coalesce("links", empty).alias("links"), "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("variants", F.lit(1)).alias("variants"))


def build_conversations(linked: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role") -> DataFrame:
    """(conv, thread, part, slice, n_messages, n_links, replies, formatted): what link_quotes found, as conversations.

    A thread's messages stand in the order of turns, so each reply comes after what it answers, without their quotes.
    A row holds TURNS turns of a thread: longer threads go on in the next part, so that no row or task holds a thread of
    any length. A turn of more than VARIANTS different messages is dealt over slices. Rows that repeat a message count
    once. `replies` has "turn<reply_to" of each reply. A message without conversation or turn is a thread of its own.
    """
    conv, turn, role = F.col(conv_col), F.col(turn_col), F.col(role_col)
    alone = F.when(conv.isNull() | turn.isNull(), F.xxhash64(turn, role, "clean_text")).otherwise(F.lit(0))
    part, cut = F.floor((turn - F.col("thread")) / TURNS), F.pmod(F.xxhash64(role, "clean_text"), F.ceil(F.col("variants") / VARIANTS)).cast("int")
    text = F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), F.col("clean_text"), F.lit("\n<|end|>\n"))
    one = F.struct(turn.alias("turn"), role.alias("role"), text.alias("text"), F.col("reply_to"), F.size("links").alias("n_links"))
    rows = linked.select(conv.alias(conv_col), "thread", F.coalesce(part, F.lit(0)).alias("part"), F.coalesce(cut, F.lit(0)).alias("slice"), alone.alias("alone"), one.alias("m"))
    out = rows.groupBy(conv_col, "thread", "part", "slice", "alone").agg(F.array_sort(F.collect_set("m")).alias("m"))
    answers = F.transform(F.filter("m", lambda x: x["reply_to"].isNotNull()), lambda x: F.concat(x["turn"].cast("string"), F.lit("<"), x["reply_to"].cast("string")))
    links = F.aggregate("m", F.lit(0), lambda a, x: a + x["n_links"])
    return out.select(conv_col, "thread", "part", "slice", F.size("m").alias("n_messages"), links.alias("n_links"), F.array_join(answers, " ").alias("replies"), F.array_join(F.transform("m", lambda x: x["text"]), "").alias("formatted"))


def quoting(messages: DataFrame) -> DataFrame:
    """conversations as mail: each message begins with the one before it, quoted, and that one's predecessor quoted twice.

    Quotes are broken into lines of 40 to 60 characters. The tables hold no quotes; this is what the query links.
    """
    said = messages.where("conv_id is not null and turn is not null and text is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    said = said.withColumn("text", F.regexp_replace("text", r"(.{40,60}) ", "$1\n"))
    quote = lambda c, mark: F.coalesce(F.concat(F.lit(mark), F.regexp_replace(c, "\n", f"\n{mark}"), F.lit("\n")), F.lit(""))
    before = [said.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("text").alias(f"_{k}")) for k in (1, 2)]
    both = before[0].join(before[1], ["conv_id", "turn"], "full")
    out = spread_join(messages, both, ["conv_id", "turn"], "text", "left")
    return out.withColumn("text", F.concat(quote(F.col("_2"), "> > "), quote(F.col("_1"), "> "), F.coalesce("text", F.lit("")))).drop("_1", "_2")


def op10(spark, sf_dir: str) -> DataFrame:
    """The conversations, quoted as mail, linked again by their quotes and built without them."""
    return build_conversations(link_quotes(quoting(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
