"""Chat formatting by schema fingerprints, in DataFrame operations only.

A row's layout is the set of nested field paths that hold a value. Its fingerprint,
the hash of those paths in order, selects one of the declarative layouts below: a
layout names required and optional paths and tells how they become turns. Every
combination of its optional paths is a fingerprint of the layout, so one lookup per
row settles which applies, also in a table that mixes layouts. A row that matches
none has no turns and layout null, and is kept out of the formatted table.

Turns are formatted as `### role: text</turn>` and a newline. Inside roles and
texts the characters of the control strings are escaped, `\\` as `\\b`, `#` as `\\h`,
`<` as `\\l`, and in roles `:` as `\\c`, so no text can forge a turn and everything
reads back exactly. The loss mask covers assistant texts: spans of code points.

Roles of messages in lists get canonical names (`human` becomes `user`); a row that is a turn
keeps its role as it is. Null texts count as empty; a null role as `user`; a null conv_id is a conversation
of its own; rows with the same turn are ordered by role, then text; repeated rows
are repeated turns; extra columns, also ones named like fields of other layouts that
hold nulls, are ignored. A conversation becomes one string, so it must fit a task.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

TURN = "array<struct<role:string,text:string>>"
PREFIX, COLON, SUFFIX = "### ", ": ", "</turn>\n"
LEARNED = "assistant"
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Paths a row must and may have; turns as (role or path of a role, path of a text), or a list of messages."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    messages: tuple[str, str, str] | None = None


LAYOUTS = (
    Layout("turn_row", ("turn",), ("role", "text"), (("=role", ("text",)),)),
    Layout("prompt_response", ("prompt", "response"), ("system",), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", ("completion", "prompt"), ("system",), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("instruction", ("instruction", "output"), ("input", "system"), (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question", ("answer", "question"), ("context",), (("user", ("context", "question")), ("assistant", ("answer",)))),
    Layout("messages", ("messages.content", "messages.role"), (), messages=("messages", "role", "content")),
    Layout("share", ("conversations.from", "conversations.value"), (), messages=("conversations", "from", "value")),
)
KNOWN = sorted({p for x in LAYOUTS for p in (*x.required, *x.optional)})


def paths(schema: S.StructType, prefix: str = "") -> dict[str, str]:
    """Nested field paths of a schema, with `.` for fields and elements, and the top column of each."""
    out = {}
    for f in schema:
        kind, path = f.dataType, f"{prefix}{f.name}"
        if isinstance(kind, S.ArrayType):
            kind = kind.elementType
        out |= paths(kind, f"{path}.") if isinstance(kind, S.StructType) else {path: path.split(".")[0]}
    return out


def _held(path: str) -> Column:
    return F.col(f"`{path.split('.')[0]}`").isNotNull()


def fingerprint(schema: S.StructType) -> Column:
    """Hash of the known paths of a row that hold a value, in order."""
    there = paths(schema)
    held = [F.when(_held(p), F.lit(p)) for p in KNOWN if p in there]
    return F.xxhash64(F.array_join(F.array_compact(F.array(F.lit(""), *held)), "|"))


def _of(names) -> Column:
    return F.xxhash64(F.lit("|".join(["", *sorted(names)])))


def layout(schema: S.StructType) -> Column:
    """The name of a row's layout."""
    print_, out = fingerprint(schema), None
    for x in LAYOUTS:
        any_of = [_of((*x.required, *extra)) for n in range(len(x.optional) + 1) for extra in itertools.combinations(x.optional, n)]
        out = F.when(print_.isin(any_of), x.name) if out is None else out.when(print_.isin(any_of), x.name)
    return out


def _role(c: Column) -> Column:
    names = F.create_map(*[F.lit(v) for kv in ROLES.items() for v in kv])
    return F.coalesce(F.try_element_at(names, c), c, F.lit("user"))


def _message(role: str, content: str):
    """A message struct as a turn."""
    return lambda m: F.struct(_role(m[role].cast("string")).alias("role"), F.coalesce(m[content].cast("string"), F.lit("")).alias("text"))


def canonical_turns(rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """key, ord, pos, role, text, layout: the turns of every row whose layout is known."""
    there = paths(rows.schema)
    text = lambda p: F.col(f"`{p}`").cast("string")
    turns = F.lit(None).cast(TURN)
    rows = rows.withColumn("__layout", layout(rows.schema))
    for x in reversed(LAYOUTS):
        if not all(p in there for p in x.required):
            continue
        if x.messages:
            top, role, content = x.messages
            made = F.transform(F.col(f"`{top}`"), _message(role, content))
        else:
            made = F.array_compact(F.array(*[
                F.when(F.lit(r[0] == "=") | F.coalesce(*[text(p) for p in ps if p in there]).isNotNull(), F.struct(
                    (F.coalesce(text(r[1:]), F.lit("user")) if r[0] == "=" else F.lit(r)).alias("role"),
                    F.concat_ws("\n", *[text(p) for p in ps if p in there]).alias("text"),
                ))
                for r, ps in x.turns if any(p in there for p in ps) or r[0] == "="
            ]))
        turns = F.when(F.col("__layout") == x.name, made).otherwise(turns)
    at = F.col(order).cast("long") if order else F.lit(0).cast("long")
    return rows.select(F.col(key).alias("key"), at.alias("ord"), F.col("__layout").alias("layout"), F.posexplode(turns).alias("pos", "t")).select("key", "ord", "pos", "t.role", "t.text", "layout")


def format_conversations(rows: DataFrame) -> DataFrame:
    """key, formatted, loss_spans of conversations with a row per turn; a null turn comes last."""
    last = F.lit((1 << 63) - 1)
    rows = rows.select("conv_id", F.coalesce(F.col("turn").cast("long"), last).alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return format_chats(canonical_turns(rows, "conv_id", "turn"))


def escape(c: Column, role: bool = False) -> Column:
    for a, b in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), *([(":", "\\c")] if role else [])):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in ((":", "\\c"), ("<", "\\l"), ("#", "\\h"), ("\\", "\\b")):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def format_chats(turns: DataFrame) -> DataFrame:
    """key, formatted, loss_spans (start and length in code points, start from 1), from canonical turns."""
    parts = turns.select("key", "ord", "pos", "role", "text", escape(F.col("role"), True).alias("r"), escape(F.col("text")).alias("t"))
    part = F.concat(F.lit(PREFIX), "r", F.lit(COLON), "t", F.lit(SUFFIX))
    order = ["ord", "pos", "role", "text"]
    before = Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("part", part).withColumn("from", F.coalesce(F.sum(F.length("part")).over(before), F.lit(0)))
    span = F.when(F.col("role") == LEARNED, F.struct((F.col("from") + len(PREFIX) + F.length("r") + len(COLON) + 1).cast("int").alias("start"), F.length("t").alias("length")))
    rows = parts.select("key", F.struct("from", "ord", "pos", "role", "part", span.alias("span")).alias("x"))
    got = rows.groupBy("key").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return got.select("key", F.array_join(F.transform("x", lambda x: x["part"]), "").alias("formatted"), F.array_compact(F.transform("x", lambda x: x["span"])).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """key, turns (role, text), loss_texts, formatted: parsed from the formatted string and its spans alone."""
    pieces = F.filter(F.split("formatted", SUFFIX, -1), lambda x: x != "")
    cut = lambda x: F.instr(x, F.lit(COLON))
    turns = F.transform(pieces, lambda x: F.struct(
        unescape(F.substring(x, F.lit(len(PREFIX) + 1), cut(x) - 1 - len(PREFIX))).alias("role"),
        unescape(F.substring(x, cut(x) + len(COLON), F.length(x))).alias("text"),
    ))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"], s["length"])))
    return formatted.select("key", turns.alias("turns"), loss.alias("loss_texts"), "formatted")


def digest(back: DataFrame) -> DataFrame:
    """The digest columns of formatted conversations, from what was read back."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        F.col("key").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
