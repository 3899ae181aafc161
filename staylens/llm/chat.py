"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted, adjacent
turns of one role are merged by array functions, and the template is
concatenated.  A conversation is one output row, so its turns meet in one row.

The template marks a block of same-role turns as
``[ROLE]role[TEXT]text[TURN]text[/ROLE]`` and a conversation as
``<s>...</s>``.  Control strings inside roles and texts are escaped by a
backslash after their first character; further backslashes there gain one
more, so that unescaping is exact for every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOS, EOS = "<s>", "</s>"
ROLE, TEXT, TURN, END = "[ROLE]", "[TEXT]", "[TURN]", "[/ROLE]"
#: What must not appear raw inside a text: the template's own marks and common instruction marks.
TAILS = r"/?s>|/?INST\]|/?SYS\]|/?ROLE\]|TEXT\]|TURN\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({TAILS})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({TAILS})", "$1$2$3")


def format_chats(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per conversation: ``formatted``, ``n_blocks`` and ``loss_spans``.

    ``loss_spans`` holds (start, length) in code points of ``formatted``, one
    per text of a role in ``loss_roles``.  Null text or role: empty.  Turns
    sort by (turn, role, text), null turn first, so ties and repeated rows
    have one order; repeated rows are turns of their own.  Null conversation
    ids form one conversation.  An empty table gives no rows; other columns
    are ignored.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    convs = turns.groupBy(conv_col).agg(
        F.array_sort(F.collect_list(F.struct(F.col(turn_col).alias("t"), text(role_col).alias("r"), text(text_col).alias("x")))).alias("turns")
    )
    # where a run of one role starts; a block reaches to the next start
    starts = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i)["r"] != F.get("turns", F.greatest(i - 1, F.lit(0)))["r"]),
    )
    runs = convs.withColumn("starts", starts).withColumn("ends", F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("turns"))))
    blocks = F.zip_with(
        "starts", "ends",
        lambda a, b: F.struct(
            F.get("turns", a)["r"].alias("r"),
            F.transform(F.slice("turns", a + 1, b - a), lambda t: escape(t["x"])).alias("xs"),
        ),
    )
    marked = runs.withColumn("blocks", blocks).select(
        F.col(conv_col),
        F.size("blocks").alias("n_blocks"),
        # pieces in order, each with its loss flag: opening mark, texts with [TURN] between, closing mark
        F.flatten(
            F.transform(
                "blocks",
                lambda b: F.concat(
                    F.array(_piece(F.concat(F.lit(ROLE), escape(b["r"]), F.lit(TEXT)), F.lit(False))),
                    F.flatten(F.transform(b["xs"], lambda x, i: F.array(
                        _piece(F.when(i > 0, F.lit(TURN)).otherwise(F.lit("")), F.lit(False)), _piece(x, b["r"].isin(*loss_roles))))),
                    F.array(_piece(F.lit(END), F.lit(False))),
                ),
            )
        ).alias("pieces"),
    )
    # appending to an array copies it, so pieces are taken in chunks: inside a chunk from the chunk's own start on
    chunks = _chunks(F.col("pieces"))
    sizes = F.transform(chunks, lambda ch: F.aggregate(ch, F.lit(0).cast("long"), lambda n, p: n + F.length(p["x"])))
    begins = F.aggregate(
        sizes, F.struct(F.lit(len(BOS)).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def inside(ch: Column, begin: Column) -> Column:
        return F.aggregate(
            ch,
            F.struct(begin.alias("at"), F.array().cast(SPANS).alias("spans")),
            lambda acc, p: F.struct(
                (acc["at"] + F.length(p["x"])).alias("at"),
                F.when(
                    p["loss"],
                    F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), F.length(p["x"]).cast("long").alias("length")))),
                ).otherwise(acc["spans"]).alias("spans"),
            ),
            lambda acc: acc["spans"],
        )

    spans = F.flatten(F.zip_with(chunks, begins, inside))
    return marked.select(
        conv_col,
        F.concat(F.lit(BOS), F.array_join(F.transform("pieces", lambda p: p["x"]), ""), F.lit(EOS)).alias("formatted"),
        "n_blocks",
        spans.alias("loss_spans"),
    )


#: Array entries that are handled at once where work per entry grows with the array.
CHUNK = 256
SPANS = "array<struct<start:bigint,length:bigint>>"


def _chunks(array: Column) -> Column:
    """An array as an array of arrays of ``CHUNK`` entries (none of an empty one)."""
    n = F.ceil(F.size(array) / CHUNK).cast("int")
    return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda c: c < n), lambda c: F.slice(array, c * CHUNK + 1, F.lit(CHUNK)))


def _piece(x: Column, loss: Column) -> Column:
    return F.struct(x.alias("x"), loss.alias("loss"))


def read_chats(formatted: DataFrame, *, conv_col: str = "conv_id") -> DataFrame:
    """``turns`` (array of role and text) and ``loss_text``, read back from the output of ``format_chats``."""
    quote = lambda s: "\\Q" + s + "\\E"
    body = F.substring(F.col("formatted"), len(BOS) + 1, F.length("formatted") - len(BOS) - len(EOS))
    blocks = F.split(body, quote(END), -1)
    turns = F.flatten(
        F.transform(
            F.slice(blocks, 1, F.size(blocks) - 1),
            lambda b: F.transform(
                F.split(F.substring_index(b, TEXT, -1), quote(TURN), -1),
                lambda x: F.struct(unescape(F.substring(F.substring_index(b, TEXT, 1), F.lit(len(ROLE) + 1), F.length(b))).alias("role"), unescape(x).alias("text")),
            ),
        )
    )
    # a substring is searched from the start of its text, so spans are cut out of the stretch that their chunk covers
    first, last = lambda ch: F.element_at(ch, 1)["start"], lambda ch: F.element_at(ch, -1)["start"] + F.element_at(ch, -1)["length"]
    cut = lambda text, at, n: F.substring(text, (at + 1).cast("int"), n.cast("int"))
    stretches = F.transform(_chunks(F.col("loss_spans")), lambda ch: F.struct(
        ch.alias("spans"), first(ch).alias("at"), cut(F.col("formatted"), first(ch), last(ch) - first(ch)).alias("text")))
    loss = F.array_join(F.flatten(F.transform(stretches, lambda c: F.transform(c["spans"], lambda s: unescape(cut(c["text"], s["start"] - c["at"], s["length"]))))), "")
    return formatted.select(conv_col, turns.alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"), "n_blocks")
