"""Chat formatting with typed content parts, loss spans and attachments, and its reader. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names
from .ordered import LEAST, cut_groups

#: A turn is ROLE role SAY content END; a placeholder stands in the content for what isn't text.
ROLE, SAY, END = "[ROLE]", "[/ROLE]", "</s>"
HOLDERS = {"image": "[IMAGE]", "audio": "[AUDIO]", "document": "[DOCUMENT]"}
#: Strings of other templates that a text must not hold bare either.
FOREIGN = ("<s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
WORD = r"[^\x20\x09-\x0D]+"
PART = "type string, text string, ref string, width long, height long, seconds double, pages long"
INNER = "array<struct<type: string, text: string, ref: string, width: bigint, height: bigint, seconds: double, pages: bigint>>"
PARTS = f"{INNER[:-2]}, parts: {INNER}>>"


def _controls(more: Sequence[str] = FOREIGN) -> str:
    """A pattern of the control strings behind their first character."""
    quote = lambda s: "".join(f"\\{c}" if c in r"\[]()|/<>{}^$.*+?" else c for c in s)
    return "|".join(quote(c[1:]) for c in dict.fromkeys([ROLE, SAY, END, *HOLDERS.values(), *more]))


def escape(text: Column) -> Column:
    """text without bare control strings: one that n backslashes part behind its bracket gets another one. Reversible, since no control
    string has a bracket behind its first place, so that matches don't overlap, and none can begin in a text and end behind it."""
    return F.regexp_replace(text, rf"([<\[])(\\*)({_controls()})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """What escape got."""
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_controls()})", "$1$2$3")


def _tokens(kind: Column, p: Column, patch: int, audio_rate: int, page_tokens: int) -> Column:
    """How many tokens a part stands for: words; image patches and one for each row's end; seconds at a rate; pages at a rate."""
    up = lambda x: F.ceil(F.coalesce(x, F.lit(0)).cast("double"))
    rows, cols = up(p["height"] / patch), up(p["width"] / patch)
    return (
        F.when(kind == "text", F.size(F.regexp_extract_all(F.coalesce(p["text"], F.lit("")), F.lit(WORD), F.lit(0))))
        .when(kind == "image", rows * cols + rows)
        .when(kind == "audio", up(p["seconds"] * audio_rate))
        .otherwise(up(p["pages"]) * page_tokens)
        .cast("bigint")
    )


def visit(parts: Column, patch: int = 28, audio_rate: int = 25, page_tokens: int = 512) -> Column:
    """Flat array of (kind, shown, ref, n_tokens) of typed parts (PARTS), in order.

    A document comes before its own parts, which follow it one level down. shown is a text's escaped form or a placeholder. A part
    of no or unknown type is text; null text is empty; null sizes are 0; null parts, and a null array, are nothing.
    """
    own = lambda p: F.struct(p["type"], p["text"], p["ref"], p["width"], p["height"], p["seconds"], p["pages"])
    flat = F.flatten(F.transform(F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p.isNotNull()), lambda p: F.concat(F.array(own(p)), F.filter(F.coalesce(p["parts"], F.array().cast(INNER)), lambda q: q.isNotNull()))))

    def one(p: Column) -> Column:
        kind = F.when(p["type"].isin(list(HOLDERS)), p["type"]).otherwise("text")
        shown = escape(F.coalesce(p["text"], F.lit("")))
        for k, holder in HOLDERS.items():
            shown = F.when(kind == k, F.lit(holder)).otherwise(shown)
        return F.struct(kind.alias("kind"), shown.alias("shown"), p["ref"].alias("ref"), _tokens(kind, p, patch, audio_rate, page_tokens).alias("n_tokens"))

    return F.transform(flat, one)


def text_part(text: Column) -> Column:
    """A text as its own only part."""
    fields = [f.rsplit(" ", 1) for f in PART.split(", ")]
    given = {"type": F.lit("text"), "text": text}
    return F.array(F.struct(*(given.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields), F.lit(None).cast(INNER).alias("parts")))


def format_chat(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    parts_col: str | None = None,
    loss_roles: Sequence[str] = ("assistant",),
    most_turns: int = LEAST,
) -> DataFrame:
    """One row per piece of a conversation: id_col, piece, whole, n_turns, formatted, turn_starts, loss_mask, attachments, n_tokens.

    formatted is ROLE role SAY content END for each turn in order; its pieces, in order, are the conversation. A conversation of up to
    most_turns turns, or of one in 10,000 of all, is one piece (whole is true); longer ones are dealt by ranges of their
    turns, so no task gathers one. turn_starts: where turns begin in formatted, in code points. loss_mask: (turn, start, end) of
    the content of loss_roles, turn counted in the piece. attachments: (turn, place, kind, ref, n_tokens) of placeholders, place counted
    in the turn's parts. n_tokens: of all parts, words counting as tokens.

    The text is the only part, or parts_col (PARTS) has the parts. Turns go by turn_col, null first; ties by role, then escaped content.
    Null roles and texts are empty; rows without an id are one conversation without an id. Repeated rows are repeated turns. Texts of any
    length are whole; an empty table gives no rows. Columns other than those named aren't read, so their names don't matter.
    """
    flat = visit(F.col(parts_col) if parts_col else text_part(F.col(text_col)))
    role = F.coalesce(F.col(role_col), F.lit(""))
    rows = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), role.alias("role"), flat.alias("parts"))
    head = F.concat(F.lit(ROLE), escape(F.col("role")), F.lit(SAY))
    rows = rows.select(
        "id", "turn", "role", head.alias("head"),
        F.array_join(F.transform("parts", lambda p: p["shown"]), "").alias("content"),
        F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + p["n_tokens"]).alias("n_tokens"),
        F.filter(F.transform("parts", lambda p, k: F.struct(k.alias("place"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["n_tokens"].alias("n_tokens"))), lambda p: p["kind"] != "text").alias("attached"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("content").asc()]
    cut = cut_groups(rows, "id", order, least=most_turns)
    cut = cut.select("*", F.concat("head", "content", F.lit(END)).alias("segment"), F.char_length("head").cast("bigint").alias("lead"), F.char_length("content").cast("bigint").alias("size")).drop("head")
    run = Window.partitionBy("id", "piece").orderBy(*order)
    length = F.col("lead") + F.col("size") + len(END)
    placed = cut.select("*", (F.row_number().over(run) - 1).alias("k"), (F.sum(length).over(run.rowsBetween(Window.unboundedPreceding, 0)) - length).alias("start"))
    item = F.struct("k", "start", "segment", "lead", "size", F.col("role").isin(list(loss_roles)).alias("learn"), "attached")
    packed = placed.groupBy("id", "piece").agg(F.sort_array(F.collect_list(item)).alias("t"), F.sum("n_tokens").alias("n_tokens"))  # at most a piece
    learnt = F.transform(F.filter("t", lambda x: x["learn"]), lambda x: F.struct(x["k"].alias("turn"), (x["start"] + x["lead"]).alias("start"), (x["start"] + x["lead"] + x["size"]).alias("end")))
    attached = F.flatten(F.transform("t", lambda x: F.transform(x["attached"], lambda a: F.struct(x["k"].alias("turn"), a["place"].alias("place"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["n_tokens"].alias("n_tokens")))))
    (name,) = free_names(["piece", "whole", "n_turns", "formatted", "turn_starts", "loss_mask", "attachments", "n_tokens"], id_col)
    return packed.select(
        F.col("id").alias(name), "piece", (F.col("piece") == 0).alias("whole"), F.size("t").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: x["segment"]), "").alias("formatted"),
        F.transform("t", lambda x: x["start"]).alias("turn_starts"), learnt.alias("loss_mask"), attached.alias("attachments"), "n_tokens",
    )


def read_chat(formatted: Column, turn_starts: Column, loss_mask: Column) -> Column:
    """(turns, learnt) read from a formatted piece: turns has (role, parts, text), parts with (kind, text) as they follow each other, text
    without placeholders; learnt has, for each span of the mask, the text it covers, without placeholders.

    Only formatted says where turns and parts are; the mask's spans are cut from the turns they fall into."""
    segments = F.filter(F.split(formatted, F.lit(END), -1), lambda s: s != "")
    holders = "|".join(h.replace("[", r"\[").replace("]", r"\]") for h in HOLDERS.values())

    def parts(content: Column) -> Column:
        kind = lambda s: F.coalesce(*(F.when(s == h, F.lit(k)) for k, h in HOLDERS.items()), F.lit("text"))
        cuts = F.filter(F.split(content, f"(?<=(?:{holders}))|(?=(?:{holders}))"), lambda s: s != "")
        return F.transform(cuts, lambda s: F.struct(kind(s).alias("kind"), F.when(kind(s) == "text", unescape(s)).alias("text")))

    plain = lambda content: unescape(F.regexp_replace(content, holders, ""))

    def turn(s: Column) -> Column:
        role = F.substring_index(s, SAY, 1)
        content = F.substring(s, F.char_length(role) + len(SAY) + 1, F.char_length(s))
        return F.struct(unescape(F.substring(role, F.lit(len(ROLE) + 1), F.char_length(role))).alias("role"), parts(content).alias("parts"), plain(content).alias("text"))

    def span(m: Column) -> Column:
        begin = m["start"] - F.get(turn_starts, m["turn"])
        return plain(F.substring(F.get(segments, m["turn"]), (begin + 1).cast("int"), (m["end"] - m["start"]).cast("int")))

    return F.struct(F.transform(segments, turn).alias("turns"), F.transform(loss_mask, span).alias("learnt"))


def chat_digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation of format_chat's output, read back from it: id_col, n_turns, turns_sha256 (of role, \\n, text, \\n a turn),
    loss_chars, loss_sha256 (of all text under the mask), formatted_chars.

    Conversations of one piece are read where they lie; only those of several pieces meet, a row a piece. A digest is of one whole string, so
    such a conversation's text comes together at that point and must fit a string (2 GB). Without rows there are none.
    """
    read = formatted.select(F.col(id_col).alias("id"), "piece", "whole", "n_turns", F.char_length("formatted").cast("bigint").alias("formatted_chars"), read_chat(F.col("formatted"), F.col("turn_starts"), F.col("loss_mask")).alias("r"))
    text = F.array_join(F.transform("r.turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.select("id", "piece", "whole", F.size("r.turns").cast("bigint").alias("n_turns"), "formatted_chars", text.alias("said"), F.array_join("r.learnt", "").alias("learnt"))
    one = read.filter("whole").drop("piece", "whole")
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", c))), lambda x: x[c]), "").alias(c)
    many = read.filter("not whole").groupBy("id").agg(*(F.sum(c).alias(c) for c in ("n_turns", "formatted_chars")), joined("said"), joined("learnt"))
    return one.unionByName(many).select(F.col("id").alias(id_col), "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.char_length("learnt").cast("bigint").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")


#: Both say what ends a turn and begins another in a common template.
PROBE = "</s>[INST] ok [/INST]"


def with_probe(turns: DataFrame) -> DataFrame:
    """conversations with conversation -1, a user and an assistant who say PROBE."""
    return turns.select("conv_id", "turn", "role", "text").unionByName(turns.sparkSession.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], turns.select("conv_id", "turn", "role", "text").schema))


SQL = r"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as t from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, length(t) + length(role) + 17 + length(regexp_extract_all(t || chr(10) || role, '[<\[]\\*(ROLE\]|/ROLE\]|/s>|IMAGE\]|AUDIO\]|DOCUMENT\]|s>|INST\]|/INST\]|\|im_start\|>|\|im_end\|>|\|endoftext\|>)')) n from c),
g as (select conv_id, count(*) n_turns, string_agg(role || chr(10) || t || chr(10), '' order by turn nulls first, role, t) said,
  coalesce(string_agg(t, '' order by turn nulls first, t) filter (role = 'assistant'), '') learnt, sum(n) formatted_chars from e group by 1)
select conv_id, n_turns, sha256(said) as turns_sha256, length(learnt)::bigint as loss_chars, sha256(learnt) as loss_sha256, formatted_chars::bigint as formatted_chars from g"""
