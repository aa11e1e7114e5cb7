"""Lines to typed events: permissive JSON through VARIANT, every later step works on plain columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import SPACE, first_known, known, text

TOOLS = ("function_call", "custom_tool_call", "function_call_output", "custom_tool_call_output")


def parsed(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds v (VARIANT, null if the line is not JSON) and ok; blank lines go. Strict: one value and nothing behind it.

    Duplicate keys are valid, the last counts.
    """
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    held = lines.where(~F.regexp_like(F.col(raw), F.lit(rf"\A{SPACE}*\z")))
    wrapped = F.try_parse_json(F.concat(F.lit('{"v":'), F.col(raw), F.lit("}")))
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), F.col(raw), F.lit("]"))), "$", "array<variant>")
    ok = F.coalesce(F.col("w").isNotNull() & (F.size(listed) == 1), F.lit(False))
    return held.withColumn("w", wrapped).withColumn("ok", ok).withColumn("v", F.when(F.col("ok"), F.try_variant_get("w", "$.v", "variant"))).drop("w")


def _string(v: Column) -> Column:
    """A string value; anything else counts as missing."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def string_at(path: str, v: str = "v") -> Column:
    return _string(F.try_variant_get(F.col(v), f"$.{path}", "variant"))


def _truthy(path: str) -> Column:
    found = F.try_variant_get(F.col("v"), f"$.{path}", "variant")
    return F.coalesce(~F.to_json(found).isin("null", "false", "0", '""'), F.lit(False))


def flatten_content(content: Column) -> Column:
    """A text as it is, an object's text, or the parts of a list with a blank line between."""

    def part(p: Column) -> Column:
        at = lambda key: _string(F.try_variant_get(p, f"$.{key}", "variant"))
        return F.coalesce(_string(p), first_known(at("text"), at("input_text"), at("output_text")))

    parts = F.filter(F.transform(F.try_variant_get(content, "$", "array<variant>"), part), lambda s: s != "")
    kind = F.schema_of_variant(content)
    return text(F.when(kind == "STRING", _string(content)).when(F.startswith(kind, F.lit("ARRAY")), F.array_join(parts, "\n\n")).otherwise(_string(F.try_variant_get(content, "$.text", "variant"))))


def events(lines: DataFrame) -> DataFrame:
    """path, storage, n, ok and what a line says; strings are null where a line does not say them.

    kind: meta, turn, message, tool, prompt or null. raw stays for tool events alone.
    """
    kind, ptype = string_at("type"), string_at("payload.type")
    payload = _truthy("payload")
    item = (kind == "response_item") & payload
    what = (
        F.when((kind == "session_meta") & payload, "meta").when((kind == "turn_context") & payload, "turn").when(item & (ptype == "message"), "message")
        .when(item & ptype.isin(*TOOLS), "tool").when((kind == "event_msg") & (ptype == "user_message"), "prompt")
    )
    is_ = lambda *k: F.col("kind").isin(*k)
    at = lambda key: known(string_at(f"payload.{key}"))
    staged = parsed(lines).withColumn("kind", what)
    body = F.when(is_("message"), flatten_content(F.try_variant_get(F.col("v"), "$.payload.content", "variant"))).when(is_("prompt"), F.coalesce(at("message"), at("text")))
    return staged.select(
        "path", "storage", "n", "ok", "kind", known(string_at("timestamp")).alias("ts"), F.when(is_("meta"), F.coalesce(at("id"), at("session_id"))).alias("meta_id"),
        F.when(is_("meta"), at("timestamp")).alias("meta_ts"), F.when(is_("meta"), at("source")).alias("source"), F.when(is_("meta", "turn"), at("cwd")).alias("cwd"),
        F.when(is_("turn"), at("model")).alias("model"), F.when(is_("message"), at("role")).alias("role"), known(body).alias("body"), F.when(is_("tool"), ptype).alias("tool"),
        F.when(is_("tool"), at("name")).alias("tool_name"), F.when(is_("tool"), F.coalesce(at("arguments"), at("input"), at("output"))).alias("tool_text"), F.when(is_("tool"), F.col("raw")).alias("raw"),
    )
