r"""Chat formatting in Spark expressions only.

A conversation's turns are collected as structs, sorted, and adjacent turns of one role are merged by array
aggregation into blocks:  <s>[ROLE]role[/ROLE]text[SEP]text</s>  with one text a turn. Control strings inside roles and
texts are escaped by a tilde after their first character ("</s>" becomes "<~/s>", "<~/s>" becomes "<~~/s>"), which is
undone by taking one tilde away; other text stays as it is. No control string can arise where a text meets a mark: marks
begin with "<" or "[" and hold these nowhere else. The loss mask is a list of spans (start, length in code points) over
the formatted text: the escaped text of each assistant turn.

Cases: null texts and roles count as empty. Turns with equal numbers are ordered by role, then text; null turn numbers
come first. Repeated rows are turns of their own. Rows with a null conversation id form one conversation. An empty
table gives an empty result. Extra columns are dropped.

Scale: a conversation is one row by nature, as its format and digest are; conversations are spread by id in one shuffle,
and nothing is gathered beyond one conversation. Work grows in proportion to its turns: offsets are running sums, blocks
are slices between the places where the role changes, and no array is copied turn by turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, ROLE, END_ROLE, SEP, CLOSE = "<s>", "[ROLE]", "[/ROLE]", "[SEP]", "</s>"
CONTROL = r"(/?s>|/?ROLE\]|/?SEP\]|/?INST\])"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(~*)" + CONTROL, "$1~$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])~(~*)" + CONTROL, "$1$2$3")


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learned: str = LEARNED) -> DataFrame:
    """One row a conversation: id, formatted, loss_spans (array of start, length; starts count from 1)."""
    role, text = (escape(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in (role_col, text_col))
    rows = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    # Where a text starts: what all turns up to it take, in the order in which they are merged below.
    w = Window.partitionBy("id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    before, head = F.lag("role").over(w), F.length("role") + len(OPEN + ROLE + END_ROLE)
    ahead = F.when(before.isNull(), head).when(before != F.col("role"), head + len(CLOSE)).otherwise(len(SEP))
    ends = F.sum(ahead + F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("start", (ends - F.length("text") + 1).cast("int"))
    sorted_ = placed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "start"))).alias("turns"))
    at = lambda i: F.get("turns", i)
    firsts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (at(i)["role"] != at(i - 1)["role"]))
    merged = sorted_.select("id", "turns", firsts.alias("firsts"))

    def block(first: Column, k: Column) -> Column:
        own = F.slice("turns", first + 1, F.coalesce(F.get("firsts", k + 1), F.size("turns")) - first)
        return F.concat(F.lit(OPEN + ROLE), at(first)["role"], F.lit(END_ROLE), F.array_join(F.transform(own, lambda t: t["text"]), SEP), F.lit(CLOSE))

    spans = F.transform(F.filter("turns", lambda t: t["role"] == learned), lambda t: F.struct(t["start"].alias("start"), F.length(t["text"]).alias("length")))
    return merged.select(F.col("id").alias(id_col), F.array_join(F.transform("firsts", block), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns in a formatted text: array of (role, text), unescaped."""

    def turns(block: Column) -> Column:
        role = unescape(F.substring_index(F.substring(block, F.lit(len(OPEN + ROLE) + 1), F.length(block)), END_ROLE, 1))
        texts = F.substring(block, F.locate(END_ROLE, block) + len(END_ROLE), F.length(block))
        return F.transform(F.split(texts, r"\[SEP\]", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    # The piece after the last mark is empty.
    blocks = F.split(formatted, "</s>", -1)
    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns))


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    # Four bytes a code point: a span is reached without walking over what stands before it. The sign ahead of each
    # keeps a byte order mark from being taken for one.
    sign = F.lit(bytearray(b"\0\0\0|"))
    part = lambda u, s: F.decode(F.concat(sign, F.substring(u, s["start"] * 4 - 3, s["length"] * 4)), "UTF-32")
    whole = lambda u: F.array_join(F.transform(spans, lambda s: unescape(F.substring(part(u, s), F.lit(2), s["length"]))), "")
    return F.get(F.transform(F.array(F.encode(formatted, "UTF-32")), whole), F.lit(0))
