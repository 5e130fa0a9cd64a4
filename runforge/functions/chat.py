"""Splitting a chat into system, history, instruction and output.

Each returns null where the chat doesn't have the form it needs; check columns say so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def system_of(messages: Column) -> Column:
    """The content of the first message if that is the system's."""
    first = F.get(messages, F.lit(0))
    return F.when(first["role"] == "system", first["content"])


def history_of(messages: Column) -> Column:
    """User and assistant pairs after the first message; user messages in a row are joined by newlines, users at the end dropped.

    Null if an answer comes without a question or a role is another one.
    """
    empty = F.struct(F.array().cast("array<array<string>>").alias("pairs"), F.lit(None).cast("string").alias("user"), F.lit(False).alias("bad"))

    def step(acc: Column, m: Column) -> Column:
        is_user, is_answer = m["role"] == "user", m["role"] == "assistant"
        return F.struct(
            F.when(is_answer & acc["user"].isNotNull(), F.concat(acc["pairs"], F.array(F.array(acc["user"], m["content"])))).otherwise(acc["pairs"]).alias("pairs"),
            F.when(is_user, F.when(acc["user"].isNull(), m["content"]).otherwise(F.concat(acc["user"], F.lit("\n"), m["content"]))).alias("user"),
            (acc["bad"] | ~(is_user | (is_answer & acc["user"].isNotNull()))).alias("bad"),
        )

    rest = F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))
    return F.aggregate(rest, empty, step, lambda acc: F.when(~acc["bad"], acc["pairs"]))


def instruction_of(messages: Column) -> Column:
    """The messages after the last system or assistant message, joined by newlines; null if there are none or no such message."""
    turns = F.transform(messages, lambda m, i: F.when(m["role"].isin("system", "assistant"), i))
    last = F.array_max(turns)
    said = F.transform(F.slice(messages, last + 2, F.greatest(F.size(messages) - last - 1, F.lit(0))), lambda m: m["content"])
    return F.when(last.isNotNull() & (last + 1 < F.size(messages)), F.array_join(said, "\n"))


def output_of(message: Column) -> Column:
    """The content of an assistant's message."""
    return F.when(message["role"] == "assistant", message["content"])


def render_chat(system: Column, history: Column, instruction: Column, output: Column, template: str = "<|{role}|>\n{content}\n") -> Column:
    """A chat as one text for length checks; template has {role} and {content}."""
    def say(role: str, content: Column) -> Column:
        before, _, after = template.replace("{role}", role).partition("{content}")
        return F.concat(F.lit(before), content, F.lit(after))

    pairs = F.array_join(F.transform(history, lambda p: F.concat(say("user", p[0]), say("assistant", p[1]))), "")
    return F.concat(say("system", system), pairs, say("user", instruction), say("assistant", output))
