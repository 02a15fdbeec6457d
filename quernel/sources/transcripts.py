"""Session transcripts as JSON lines: messages with their text and the tools they call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds of line that are messages; all else is metadata.
MESSAGES = ("user", "assistant")


def parsed(lines: DataFrame, line: str = "line") -> DataFrame:
    """``lines`` with ``record`` (variant), and ``corrupt``: the line itself where it is no JSON. Blank lines go."""
    rows = lines.where(F.col(line).rlike(r"\S"))
    # Generated, so that no filter on what is read from a record goes below and parses the line again.
    rows = rows.withColumn("record", F.explode(F.array(F.try_parse_json(line))))
    return rows.withColumn("corrupt", F.when(F.col("record").isNull(), F.col(line)))


def _parts(content: Column) -> Column:
    """The parts of a content that is an array, null if it is none."""
    return F.try_variant_get(content, "$", "array<variant>")


def _field(part: Column, name: str) -> Column:
    return F.try_variant_get(part, f"$.{name}", "string")


def content_text(content: Column) -> Column:
    """The text of a content: itself if it is a string; of an array the text parts and a mark for each tool call, with
    spaces between; all else has none."""
    shown = F.transform(
        F.filter(_parts(content), lambda p: _field(p, "type").isin("text", "tool_use")),
        lambda p: F.when(_field(p, "type") == "text", F.coalesce(_field(p, "text"), F.lit("")))
        .otherwise(F.concat(F.lit("[tool_use: "), F.coalesce(_field(p, "name"), F.lit("?")), F.lit("]"))),
    )
    plain = F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string"))
    return F.coalesce(F.array_join(shown, " "), plain, F.lit(""))


def content_tools(content: Column) -> Column:
    """Names of the tools that a content calls, in order."""
    calls = F.filter(_parts(content), lambda p: _field(p, "type") == "tool_use")
    return F.coalesce(F.transform(calls, lambda p: F.coalesce(_field(p, "name"), F.lit("?"))), F.array().cast("array<string>"))


def messages(lines: DataFrame, *keys: str, line: str = "line") -> DataFrame:
    """(keys, kind, text, tools, corrupt): user and assistant messages, and the lines that are no JSON with nulls."""
    rows = parsed(lines, line).select(*keys, "corrupt", F.try_variant_get("record", "$.type", "string").alias("kind"),
                                      F.try_variant_get("record", "$.message.content", "variant").alias("content"))
    rows = rows.where(F.col("corrupt").isNotNull() | F.col("kind").isin(*MESSAGES))
    tools = F.when(F.col("kind") == "assistant", content_tools(F.col("content"))).otherwise(F.array().cast("array<string>"))
    good = F.col("corrupt").isNull()
    return rows.select(*keys, "kind", F.when(good, content_text(F.col("content"))).alias("text"), F.when(good, tools).alias("tools"), "corrupt")
