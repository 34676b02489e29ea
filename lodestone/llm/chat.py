r"""Conversations of typed content parts as one marked text each, with built-in expressions only.

A visitor goes through the parts of each turn in order: text is escaped and put down, an image,
a recording or a document leaves a placeholder, and its reference and the number of tokens it
expands to join the list of attachments, so the n-th placeholder of a conversation stands for its
n-th attachment.  Turns stand as `<turn ROLE>`, a line feed, the parts, `</turn>` and a line feed.

Every mark begins with `<`; in texts and roles the characters `<`, `>` and `\` are preceded by `\`,
so no text can hold a mark, and taking the character after each `\` gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.spans import let, running

#: Marks of the template.
OPEN, OPENED, CLOSE = "<turn ", ">\n", "</turn>\n"
#: Turns of a conversation that are joined before the conversation is: the rows of a hot one meet in so many fewer rows.
TURN_BLOCK = 64
#: Side of an image patch that is a token, tokens a second of sound, tokens a page of a document.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 512
KINDS = ("image", "audio", "document")
PART = "struct<kind:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>"
_TURN = r"(?s)<turn ((?:[^\\<>]++|\\.)*+)>\n((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<>])", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """A plain text (null: empty) as the only part of a turn."""
    none = {"ref": "string", "width": "bigint", "height": "bigint", "seconds": "double", "pages": "bigint"}
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in none.items()]))


def _expanded(part: Column) -> Column:
    """Tokens that a part takes once its placeholder is expanded; a size that isn't given counts as one unit."""
    image = F.ceil(F.coalesce(part["width"], F.lit(1)) / PATCH) * F.ceil(F.coalesce(part["height"], F.lit(1)) / PATCH)
    audio = F.ceil(F.coalesce(part["seconds"], F.lit(1.0)) * PER_SECOND)
    document = F.coalesce(part["pages"], F.lit(1)) * PER_PAGE
    return F.when(part["kind"] == "image", image).when(part["kind"] == "audio", audio).otherwise(document).cast("bigint")


def _visited(part: Column) -> Column:
    """The text that a part leaves: a placeholder of its kind, or its own text where the kind is text or not known."""
    return F.when(part["kind"].isin(*KINDS), F.concat(F.lit("<"), part["kind"], F.lit(">"))).otherwise(escaped(F.coalesce(part["text"], F.lit(""))))


def formatted_chats(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss and attachments of each conversation.

    turns: conv_id, turn, role and parts (an array of PART, see text_parts).  loss has a span
    (start, end: code points of formatted, end exclusive) for each turn in order, around its parts
    where the role is trained and empty elsewhere.  attachments has kind, ref and tokens.

    Turns stand in the order of turn, then role, then what the parts leave; repeated rows repeat.
    A null turn comes first, a null role is an empty one, null parts and texts are empty, a null
    conv_id is a conversation of its own; an empty table gives an empty result.  Other columns
    are left out.  A conversation of any length is joined in blocks of TURN_BLOCK turns first.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    rows = turns.select(
        "conv_id",
        F.floor(F.col("turn") / TURN_BLOCK).alias("_block"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.array_join(F.transform(parts, _visited), "").alias("body"),
        F.transform(F.filter(parts, lambda p: p["kind"].isin(*KINDS)), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), _expanded(p).alias("tokens"))).alias("found"),
    )
    marked = rows.select("conv_id", "_block", F.struct("turn", "role", "body", "found", F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(OPENED)).alias("head")).alias("_turn"))
    blocks = marked.groupBy("conv_id", "_block").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))

    def lengths(x: Column) -> Column:
        body = F.char_length(x["body"]).cast("bigint")
        return F.struct(F.char_length(x["head"]).cast("bigint").alias("head"), body.alias("body"), (F.char_length(x["head"]) + body + len(CLOSE)).alias("all"), x["role"].isin(*trained).alias("loss"))

    def spans(sizes: Column) -> Column:
        before = running(F.transform(sizes, lambda x: x["all"]), lambda a, b: a + b)
        return F.zip_with(sizes, before, lambda x, at: F.struct((at + x["head"]).alias("start"), (at + x["head"] + F.when(x["loss"], x["body"]).otherwise(0)).alias("end")))

    blocks = blocks.select(
        "conv_id",
        F.struct(
            F.col("_block").alias("at"),
            F.array_join(F.transform("_turns", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "").alias("text"),
            let(F.transform("_turns", lengths), spans).alias("loss"),
            F.flatten(F.transform("_turns", lambda x: x["found"])).alias("found"),
        ).alias("_part"),
    )
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list("_part")).alias("_parts"))
    starts = let(F.transform("_parts", lambda x: F.char_length(x["text"]).cast("bigint")), lambda n: running(n, lambda a, b: a + b))
    moved = F.zip_with("_parts", starts, lambda x, at: F.transform(x["loss"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"))))
    return whole.select("conv_id", F.array_join(F.transform("_parts", lambda x: x["text"]), "").alias("formatted"), F.flatten(moved).alias("loss"), F.flatten(F.transform("_parts", lambda x: x["found"])).alias("attachments"))


def read_turns(formatted: Column) -> Column:
    """Role and text of each turn, as the marks of a formatted text part them; placeholders stay as they are."""
    both = F.arrays_zip(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(1)).alias("role"), F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(2)).alias("text"))
    return F.transform(both, lambda x: F.struct(unescaped(x["role"]).alias("role"), unescaped(x["text"]).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, span by span, unescaped.

    Turns are cut out first, and each span is taken from its own turn: the work stays in
    proportion to the text, however many turns there are.
    """

    def texts(turns: Column) -> Column:
        before = let(F.transform(turns, lambda x: F.char_length(x).cast("bigint")), lambda n: running(n, lambda a, b: a + b))
        placed = F.arrays_zip(turns.alias("text"), before.alias("at"), loss.alias("span"))
        return F.transform(placed, lambda x: unescaped(F.substring(x["text"], (x["span"]["start"] - x["at"] + 1).cast("int"), (x["span"]["end"] - x["span"]["start"]).cast("int"))))

    return let(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), texts)
