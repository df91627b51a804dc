r"""Chat formatting by a finite-state machine over roles and a declarative template (native: DataFrame functions only).

The template says for each role what stands before and after its text and whether the text counts for the loss. The
machine starts in START and goes from role to role by MOVES; a conversation whose roles it doesn't accept is formatted
all the same and marked as not valid, with the first turn that broke the order.

Texts and role names are escaped first: & as &amp;, and the first character of each control string as a reference, so
that no control string is left and the escape can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import Scratch

#: role: (before the text, after the text, text counts for the loss). ROLE stands for the escaped role; "*" is for any other role.
TEMPLATE = {
    "system": ("<|turn|>ROLE<|text|>", "<|end|>", False),
    "user": ("<|turn|>ROLE<|text|>", "<|end|>", False),
    "assistant": ("<|turn|>ROLE<|text|>", "<|end|>", True),
    "*": ("<|turn|>ROLE<|text|>", "<|end|>", False),
}
#: Turn order: state, role that may follow. A conversation may end in any state but START.
MOVES = {"START": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]}
#: Strings that mark up chats here or in other templates, by their first character.
CONTROL = {"<": ["<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<bos>", "<eos>", "<start_of_turn>", "<end_of_turn>"], "[": ["[INST]", "[/INST]"]}
REFERENCES = {"<": "&lt;", "[": "&lsqb;"}


def escaped(col: Column) -> Column:
    """No control string is left in it; unescaped() gives the text back."""
    out = F.replace(col, F.lit("&"), F.lit("&amp;"))
    for first, strings in CONTROL.items():
        rest = "|".join(s[1:].replace("|", r"\|").replace("[", r"\[").replace("]", r"\]") for s in strings)
        out = F.regexp_replace(out, ("\\" + first if first == "[" else first) + f"(?={rest})", REFERENCES[first])
    return out


def unescaped(col: Column) -> Column:
    for first, reference in REFERENCES.items():
        col = F.replace(col, F.lit(reference), F.lit(first))
    return F.replace(col, F.lit("&amp;"), F.lit("&"))


def by_role(role: Column, part: int) -> Column:
    """A part of the template."""
    out = F.lit(TEMPLATE["*"][part])
    for name, parts in TEMPLATE.items():
        if name != "*":
            out = F.when(role == name, F.lit(parts[part])).otherwise(out)
    return out


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: conv_id, n_turns, valid, error_turn, segments array<struct<text, loss>>, formatted.

    Turns go by number; turns with the same number by role and text; a null number comes first. A null role or text is
    empty. formatted is the segments' texts one after another. Rows with a null conversation form one conversation. A
    conversation is one output row, as its formatted text is one string; its turns meet in one task for that.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    own = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    chats = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    allowed = F.lit(False)
    step = lambda acc, t: F.struct(
        t["role"].alias("state"), (acc["at"] + 1).alias("at"),
        F.when(acc["error"].isNull() & ~moves(acc["state"], t["role"]), acc["at"]).otherwise(acc["error"]).alias("error"),
    )

    def moves(state: Column, role: Column) -> Column:
        out = allowed
        for a, then in MOVES.items():
            out = out | ((state == a) & role.isin(then))
        return out

    start = F.struct(F.lit("START").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("error"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(F.replace(by_role(t["role"], 0), F.lit("ROLE"), escaped(t["role"])).alias("text"), F.lit(False).alias("loss")),
        F.struct(escaped(t["text"]).alias("text"), by_role(t["role"], 2).alias("loss")),
        F.struct(by_role(t["role"], 1).alias("text"), F.lit(False).alias("loss")),
    )))
    out = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.aggregate("turns", start, step)["error"].alias("error_turn"), segments.alias("segments"))
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return out.select("conv_id", "n_turns", F.col("error_turn").isNull().alias("valid"), "error_turn", "segments", formatted.alias("formatted"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    each = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: x != "")
    return F.transform(each, lambda x: F.struct(
        unescaped(F.substring_index(x, "<|text|>", 1)).alias("role"),
        unescaped(F.substring_index(F.substring_index(x, "<|text|>", -1), "<|end|>", 1)).alias("text"),
    ))


PROBE = -7


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"SELECT {PROBE}L AS conv_id, t.* FROM VALUES (0L, 'user', '</s>[INST] ok [/INST]'), (1L, 'assistant', '</s>[INST] ok [/INST]') AS t(turn, role, text)")
    written = Scratch(spark, "chat").table(format_chats(turns.unionByName(probe)), "formatted")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    spelled = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = written.select("conv_id", F.size(read_turns(F.col("formatted"))).cast("long").alias("n_turns"), spelled.alias("spelled"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")
    return read.select("conv_id", "n_turns", F.sha2(F.encode("spelled", "UTF-8"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars", "valid")


OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(replace(text, '&', '&amp;'), '<(\||s>|/s>|<SYS>>|</SYS>>|bos>|eos>|start_of_turn>|end_of_turn>)', '&lt;\1', 'g')) AS less,
  text LIKE '%[INST]%' OR text LIKE '%[/INST]%' AS marked FROM c),
o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM c)
SELECT e.conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(less + 5 * ((length(text) - length(replace(text, '[INST]', ''))) / 6 + (length(text) - length(replace(text, '[/INST]', ''))) / 7)
    + length(role) + 23)::BIGINT AS formatted_chars,
  max(v.valid) AS valid
FROM e JOIN (SELECT conv_id, bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' OR before = 'assistant' THEN role = 'user'
  WHEN before = 'user' THEN role = 'assistant' ELSE false END) AS valid FROM o GROUP BY conv_id) v USING (conv_id)
GROUP BY e.conv_id
"""
