"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted; adjacent turns of
one role are aggregated into a block; blocks are concatenated. The
template's control strings are escaped inside texts and roles, so a formatted
conversation can be read back exactly, by expressions as well.

    <|im_start|>user<|im_sep|>first<|im_next|>second<|im_end|>

A backslash in a text is doubled, and a backslash goes behind the first
character of every control string in it (as in ``<\\|im_end|>``). Taking one
backslash out of each run of one or two, from the left, undoes both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>"

#: Control strings of this template and of common others, all escaped.
CONTROL = (START, SEP, NEXT, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

LOSS_ROLES = ("assistant",)

#: Turns over which offsets are summed one by one.
SLICE = 256


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _with(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns that are generated, so that no later expression computes them
    again for every element of an array."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)


def _before(df: DataFrame, lengths: str, out: str) -> DataFrame:
    """Adds the sum of all earlier elements for each element of ``lengths``:
    inside slices of SLICE elements, on top of the sums of the slices before."""
    n = F.size(lengths)
    cuts = F.sequence(F.lit(0), F.floor((n - 1) / SLICE).cast("int"))
    x = _with(df, _slices=F.transform(cuts, lambda j: F.slice(lengths, j * SLICE + 1, SLICE)))
    x = _with(x, _sums=F.transform("_slices", _sum))
    x = _with(x, _bases=F.transform("_slices", lambda s, j: _sum(F.slice("_sums", 1, j))))
    sums = F.transform("_slices", lambda s, j: F.transform(s, lambda v, i: F.get("_bases", j) + _sum(F.slice(s, 1, i))))
    return _with(x, **{out: F.flatten(sums)}).drop("_slices", "_sums", "_bases")


def format_turns(turns: DataFrame) -> DataFrame:
    """One formatted string per conversation of ``turns(conv_id, turn, role, text)``.

    Returns ``conv_id, formatted, loss_spans`` (array of start and end code
    points, end exclusive, of every turn whose role takes loss, in order).

    Turn structs are collected and sorted by turn (nulls first), then role,
    then text; equal rows stay, each as a turn. Blocks are the runs of one role
    in that array, cut out by their first places, and a block's texts are
    aggregated into one piece. Null roles and texts are empty strings. The null
    conversation is one conversation. Other columns are not read; an empty
    table gives no rows. A conversation is one value, as its formatted string
    is; the work grows with its turns times SLICE at most.
    """
    turn = F.struct("turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    x = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_sorted"))
    role = lambda i: F.get("_sorted", i)["role"]
    places = F.sequence(F.lit(0), F.size("_sorted") - 1)
    x = _with(x, _first=F.filter(places, lambda i: (i == 0) | (role(i) != role(i - 1))), _bodies=F.transform(
        "_sorted", lambda t: escape(t["text"])))
    end = lambda k: F.coalesce(F.get("_first", k + 1), F.size("_sorted"))
    x = _with(x, _blocks=F.transform("_first", lambda at, k: F.struct(
        F.concat(F.lit(START), escape(role(at)), F.lit(SEP)).alias("head"), role(at).isin(*LOSS_ROLES).alias("loss"),
        F.slice("_bodies", at + 1, end(k) - at).alias("texts"))))
    formatted = F.array_join(F.transform("_blocks", lambda b: F.concat(b["head"], F.array_join(b["texts"], NEXT), F.lit(END))), "")
    # what stands before each text, and the text: a head or the mark between two, its length, and an end
    pieces = F.flatten(F.transform("_blocks", lambda b: F.transform(b["texts"], lambda t, i: F.struct(
        F.when(i == 0, F.length(b["head"])).otherwise(len(NEXT)).cast("long").alias("gap"), F.length(t).cast("long").alias("length"),
        F.when(i == F.size(b["texts"]) - 1, len(END)).otherwise(0).cast("long").alias("tail"), b["loss"].alias("loss")))))
    x = _with(x, formatted=formatted, _pieces=pieces).select("conv_id", "formatted", "_pieces")
    x = _with(x, _lengths=F.transform("_pieces", lambda p: p["gap"] + p["length"] + p["tail"]))
    x = _before(x, "_lengths", "_start")
    spans = F.transform("_pieces", lambda p, i: F.when(p["loss"], F.struct(
        (F.get("_start", i) + p["gap"]).alias("start"), (F.get("_start", i) + p["gap"] + p["length"]).alias("end"))))
    return x.select("conv_id", "formatted", F.array_compact(spans).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parses ``formatted`` and applies ``loss_spans``: adds ``turns`` (array of
    role and text) and ``loss_texts`` (array), both unescaped."""
    # every turn is one piece between marks; a block's first piece starts with its role
    block = F.split("formatted", r"\Q" + END + r"\E")
    blocks = F.filter(block, lambda b: b != "")
    body = lambda b: F.substring(b, len(START) + 1, 2 ** 30)

    def turns_of(b: Column) -> Column:
        halves = F.split(body(b), r"\Q" + SEP + r"\E", 2)
        texts = F.split(F.get(halves, 1), r"\Q" + NEXT + r"\E")
        return F.transform(texts, lambda t: F.struct(
            unescape(F.get(halves, 0)).alias("role"), unescape(t).alias("text")))

    loss = F.transform("loss_spans", lambda s: unescape(F.substring(
        F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select("conv_id", "formatted", "loss_spans",
                            F.flatten(F.transform(blocks, turns_of)).alias("turns"), loss.alias("loss_texts"))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the formatted conversations, as digests."""
    x = read_back(formatted)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return x.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
