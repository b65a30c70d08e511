"""Chat formatting in Spark expressions only: sort collected turns, merge neighbours of one role, concatenate, and read back.

Template: `<s>`, then for each run of turns of one role `[INST]` role `[/INST]` text, with `[NEXT]` before each further text
of the run, and `</s>`. In roles and texts a backslash becomes `\\s`, `<` becomes `\\l` and `[` becomes `\\b`: no control
string can stand there, and the steps undone in the opposite order give the text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BEGIN, ROLE, TEXT, NEXT, END = "<s>", "[INST]", "[/INST]", "[NEXT]", "</s>"
#: Escaped in this order, undone in the opposite one.
ESCAPES = (("\\", "\\s"), ("<", "\\l"), ("[", "\\b"))


def escape(x: Column) -> Column:
    for plain, mark in ESCAPES:
        x = F.replace(x, F.lit(plain), F.lit(mark))
    return x


def unescape(x: Column) -> Column:
    for plain, mark in reversed(ESCAPES):
        x = F.replace(x, F.lit(mark), F.lit(plain))
    return x


def split_at(x: Column, mark: str) -> Column:
    return F.split(x, "\\Q" + mark + "\\E", -1)


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): one string for each conversation, and the code-point spans {start, length} of assistant texts in it.

    Turns are ordered by turn, ties by role, then text, nulls first; repeated rows are turns of their own. A null text or
    role is empty. Rows without conv_id make one conversation. A conversation must fit one string (half a billion code
    points), as its output is one; its turns take linear time. Only conv_id, turn, role and text are read; an empty table
    gives an empty one.
    """
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    sorted_ = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    # a turn's mark says whether it begins a run of one role, ends the run before, or goes on with its own
    t = F.col("t")
    mark = lambda x, i: F.when((i > 0) & (F.get(t, i - 1)["role"] == x["role"]), F.lit(NEXT)).otherwise(F.concat(F.when(i > 0, END).otherwise(BEGIN), F.lit(ROLE), escape(x["role"]), F.lit(TEXT)))
    merged = sorted_.select("conv_id", F.transform(t, lambda x, i: F.struct(mark(x, i).alias("mark"), escape(x["text"]).alias("text"), (x["role"] == "assistant").alias("said"))).alias("t"))
    # lengths of everything before, summed by a window over the turns of a conversation
    each = merged.select("conv_id", F.posexplode("t").alias("pos", "x")).withColumn("size", F.length("x.mark") + F.length("x.text"))
    end = F.sum(F.col("size").cast("long")).over(Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = each.select("conv_id", "pos", "x", (end - F.length("x.text")).alias("start"))
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "x", "start"))).alias("t"))
    formatted = F.concat(F.array_join(F.transform("t", lambda y: F.concat(y["x"]["mark"], y["x"]["text"])), ""), F.lit(END))
    loss = F.transform(F.filter("t", lambda y: y["x"]["said"]), lambda y: F.struct(y["start"].alias("start"), F.length(y["x"]["text"]).cast("long").alias("length")))
    return whole.select("conv_id", formatted.alias("formatted"), loss.alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns {role, text} of a formatted conversation."""
    body = F.substring(formatted, len(BEGIN) + 1, 2147483647)
    blocks = F.filter(split_at(body, END), lambda b: b != "")
    parts = lambda b: split_at(F.replace(b, F.lit(ROLE), F.lit("")), TEXT)
    turn = lambda p: F.transform(split_at(F.get(p, F.lit(1)), NEXT), lambda x: F.struct(unescape(F.get(p, F.lit(0))).alias("role"), unescape(x).alias("text")))
    return F.flatten(F.transform(F.transform(blocks, parts), turn))


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what is read back from `formatted`, and of the text under its loss mask."""
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    # four bytes a code point, so that a span is cut out where it stands instead of being counted off from the start
    span = lambda b: lambda s: unescape(F.decode(F.substring(b, (4 * s["start"] + 1).cast("int"), (4 * s["length"]).cast("int")), "UTF-32"))
    masked = F.get(F.transform(F.array(F.encode("formatted", "UTF-32")), lambda b: F.array_join(F.transform("loss", span(b)), "")), F.lit(0))
    return (
        formatted.withColumn("turns", read_back(F.col("formatted")))
        .withColumn("masked", masked)
        .select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"), F.length("masked").cast("long").alias("loss_chars"), sha(F.col("masked")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
    )
