"""Conversations as one marked text with a loss mask, in Spark expressions only.

A block is a run of turns of one role: ``<|role|>`` text ``<|turn|>`` text ... ``<|end|>``. ``<|turn|>`` stands between merged turns, so
they can be told apart again. Control strings inside a text get one backslash after their first character, also those
of other common templates, and a text that already has such backslashes gets one more: reading takes one away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What may not stand in a text, after its first character.
_HEAD, _TAIL = r"([<\[])", r"(\||/?s>|/?INST\]|</?SYS>>)"
TURN, END = "<|turn|>", "<|end|>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _HEAD + r"(\\*)" + _TAIL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _HEAD + r"\\(\\*)" + _TAIL, "$1$2$3")


def _header(role: Column) -> Column:
    return F.concat(F.lit("<|"), F.url_encode(role), F.lit("|>"))


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = ASSISTANT) -> DataFrame:
    """``conv, formatted, mask``: one row per conversation.

    ``mask`` is ``array<struct<n_chars, loss>>``: lengths (code points) of the parts of ``formatted`` one after another, and
    whether the loss counts there: exactly in the texts of the ``trained`` role. Null texts and roles are empty strings. Turns are sorted by turn number, null
    first; ties and repeated rows by role, then text. Rows with a null conversation id form one conversation. An
    empty table gives an empty result. A conversation is one value of the result, so its turns meet in one row.
    """
    clean = rows.select(
        F.col(f"`{conv}`").alias("c"), F.col(f"`{turn}`").alias("n"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("r"),
        escape(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("x"))
    turns = F.array_sort(F.collect_list(F.struct("n", "r", "x")))
    sorted_turns = clean.groupBy("c").agg(turns.alias("t"))
    # the places where a run of one role begins; the runs are disjoint slices, so merging is linear in the turns
    last = F.size("t")
    begins = F.filter(F.sequence(F.lit(0), last - 1), lambda i: (i == 0) | (F.get("t", i)["r"] != F.get("t", i - 1)["r"]))
    heads = sorted_turns.select("c", "t", begins.alias("b"))
    runs = F.transform("b", lambda i, k: F.slice("t", i + 1, F.coalesce(F.get("b", k + 1), last) - i))
    blocks = heads.select("c", F.transform(runs, lambda run: F.struct(run[0]["r"].alias("r"), F.transform(run, lambda t: t["x"]).alias("x"))).alias("blocks"))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(_header(b["r"]), F.array_join(b["x"], TURN), F.lit(END))), "")

    def part(n: Column, loss: Column) -> Column:
        return F.struct(n.cast("int").alias("n_chars"), loss.alias("loss"))

    no = F.lit(False)
    mask = F.flatten(F.transform("blocks", lambda b: F.concat(
        F.flatten(F.transform(b["x"], lambda x, i: F.array(
            part(F.when(i == 0, F.length(_header(b["r"]))).otherwise(len(TURN)), no), part(F.length(x), b["r"] == trained)))),
        F.array(part(F.lit(len(END)), no)))))
    return blocks.select(F.col("c").alias(conv), formatted.alias("formatted"), mask.alias("mask"))


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``conv, turns, under_mask, fits, n_chars``: what the formatted text holds, read from it alone.

    ``turns``: ``array<struct<role, text>>``. ``under_mask``: the parts of the formatted text that the mask counts, unescaped, whatever they are.
    ``fits``: whether the mask's parts are the headers, marks and texts of the formatted text, and it counts exactly the trained texts.
    """
    blocks = F.split("formatted", r"<\|end\|>", -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)  # nothing stands behind the last mark

    def parts(block: Column) -> Column:
        """Header or mark, text, ..., and the last mark, as ``role, x``; only texts have a role."""
        head = F.regexp_extract(block, r"^<\|[^|]*\|>", 0)
        role = F.url_decode(F.regexp_extract(block, r"^<\|([^|]*)\|>", 1))
        texts = F.split(F.regexp_replace(block, r"^<\|[^|]*\|>", ""), r"<\|turn\|>", -1)

        def part(who: Column, x: Column) -> Column:
            return F.struct(who.alias("role"), x.alias("x"))

        no = F.lit(None).cast("string")
        each = F.flatten(F.transform(texts, lambda x, i: F.array(part(no, F.when(i == 0, head).otherwise(TURN)), part(role, x))))
        return F.concat(each, F.array(part(no, F.lit(END))))

    found = formatted.select(conv, "formatted", "mask", F.length("formatted").alias("n_chars"), F.flatten(F.transform(blocks, parts)).alias("found"))
    same = F.transform("found", lambda p: F.length(p["x"])) == F.transform("mask", lambda m: m["n_chars"])
    both = found.withColumn("same", F.coalesce(same, F.lit(False)))
    trained = F.transform("found", lambda p: F.coalesce(p["role"] == ASSISTANT, F.lit(False))) == F.transform("mask", lambda m: m["loss"])
    # with equal parts the mask's places are those of the parts; else the text is cut by the running sum of lengths
    by_part = F.transform(F.filter(F.arrays_zip("found", "mask"), lambda z: z["mask"]["loss"]), lambda z: unescape(z["found"]["x"]))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))
    by_place = F.aggregate("mask", start, lambda a, m: F.struct(
        (a["at"] + m["n_chars"]).alias("at"),
        F.when(m["loss"], F.concat(a["out"], F.array(unescape(F.substring("formatted", a["at"], m["n_chars"]))))).otherwise(a["out"]).alias("out")))["out"]
    turns = F.filter("found", lambda p: p["role"].isNotNull())
    return both.select(
        conv, F.transform(turns, lambda t: F.struct(t["role"].alias("role"), unescape(t["x"]).alias("text"))).alias("turns"),
        F.when(F.col("same"), by_part).otherwise(by_place).alias("under_mask"), (F.col("same") & trained).alias("fits"), "n_chars")
