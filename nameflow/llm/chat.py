r"""Chat formatting with a grammar round trip, in built-in expressions alone.

    conversation := "<conv " level ">\n" turn*
    turn         := "### " role ":\n" text "\n</turn>\n"

Roles have backslashes doubled and line feeds written as \n, so a header is one line.  At level 0 texts stand
as they are; at level 1 a backslash goes before every control string ("</turn>" or "### ") and the
backslashes right before it.  Each conversation is rendered at the lowest level at which no text holds an
unescaped control string and the parser, reading nothing but the rendered text, gives back exactly the
turns; a conversation that no level gives back raises an error.  What is reported of a conversation is read from
its rendered text.

The loss mask is a list of runs of code points of the rendered text, one per turn: so many to skip, then so
many to learn (the text of an assistant's turn; 0 for others).

Defined results: a null text or role is an empty one; turns sort by number (null first), then role and text, so
repeated rows stay repeated turns; rows of a null conversation are one conversation; other columns are ignored;
an empty table gives an empty table.  A conversation is one value, so it must fit a task, as any digest
over it requires; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lines import bound

CLOSE, OPEN = "</turn>", "### "
_CONTROL = f"({CLOSE}|{OPEN})"
LEVELS = (0, 1)


# Matches begin where a run of backslashes does and take it whole, so long runs are read once.
def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)(\\*+)" + _CONTROL, r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)\\(\\*+)" + _CONTROL, "$1$2")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return F.array_join(F.transform(F.split(role, r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def render(turns: Column, level: int) -> Column:
    """turns: array of structs with role and text"""
    text = lambda x: escape(x["text"]) if level else x["text"]
    return F.concat(F.lit(f"<conv {level}>\n"), F.array_join(F.transform(turns, lambda x: F.concat(F.lit(OPEN), escape_role(x["role"]), F.lit(":\n"), text(x), F.lit(f"\n{CLOSE}\n"))), ""))


def parse(rendered: Column) -> Column:
    """array of (role, text, skip, take) of a rendered conversation; null if it isn't one"""

    def turns(parts: Column, level: Column, head: Column) -> Column:
        def turn(s: Column, i: Column) -> Column:
            return bound(
                F.substring_index(s, "\n", 1),
                lambda h: F.struct(
                    unescape_role(F.substr(h, F.lit(len(OPEN) + 1), F.char_length(h) - len(OPEN) - 1)).alias("role"),
                    bound(F.substr(s, F.char_length(h) + 2), lambda t: F.when(level == "1", unescape(t)).otherwise(t)).alias("text"),
                    (F.char_length(h) + 1 + F.when(i == 0, F.char_length(head) + 1).otherwise(len(CLOSE) + 2)).cast("bigint").alias("skip"),
                    (F.char_length(s) - F.char_length(h) - 1).cast("bigint").alias("size"),
                ),
            )

        return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)

    head = F.substring_index(rendered, "\n", 1)
    found = bound(head, lambda h: bound(F.split(F.substr(rendered, F.char_length(h) + 2), f"\\n{CLOSE}\\n"), lambda p: turns(p, F.substr(h, F.lit(7), F.lit(1)), h)))
    return F.when(head.rlike(r"^<conv [01]>$"), found)


def same(parsed: Column, turns: Column) -> Column:
    plain = lambda xs: F.transform(xs, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return F.coalesce(plain(parsed) == plain(turns), F.lit(False))


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted, level, parsed turns and mask, a row per conversation."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    one = F.struct(F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    grouped = rows.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    clear = ~F.exists("turns", lambda x: x["text"].rlike(_CONTROL))
    tries = F.array(*(F.when(F.lit(bool(k)) | clear, render(F.col("turns"), k)) for k in LEVELS))
    good = F.filter(tries, lambda f: f.isNotNull() & same(parse(f), F.col("turns")))
    made = grouped.select("conv_id", F.coalesce(F.try_element_at(good, F.lit(1)), F.raise_error(F.lit("a conversation cannot be read back")).cast("string")).alias("formatted"))
    read = made.select("conv_id", "formatted", parse(F.col("formatted")).alias("read"))
    learnt = lambda x: F.when(x["role"] == "assistant", x["size"]).otherwise(F.lit(0).cast("bigint"))
    # what a turn does not learn is skipped by the next
    gap = lambda x, y: F.struct((x["skip"] + F.when(y["role"] == "assistant", 0).otherwise(F.coalesce(y["size"], F.lit(0)))).alias("skip"), learnt(x).alias("take"))
    before = lambda r: F.concat(F.slice(r, 1, 1), F.slice(r, 1, F.size(r) - 1))
    mask = F.zip_with(F.transform("read", lambda x, i: F.struct(x["role"].alias("role"), x["skip"].alias("skip"), x["size"].alias("size"), i.alias("i"))), before(F.col("read")), lambda x, y: F.when(x["i"] == 0, F.struct(x["skip"].alias("skip"), learnt(x).alias("take"))).otherwise(gap(x, y)))
    return read.select("conv_id", "formatted", F.substr("formatted", F.lit(7), F.lit(1)).cast("int").alias("level"), "read", mask.alias("mask"))


def digest(formatted: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("read", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform(F.filter("read", lambda x: x["role"] == "assistant"), lambda x: x["text"]), "")
    return formatted.select(
        "conv_id", F.size("read").cast("bigint").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.char_length(learnt).cast("bigint").alias("loss_chars"),
        F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("bigint").alias("formatted_chars"), "level",
    )
