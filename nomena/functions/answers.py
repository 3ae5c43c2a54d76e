"""Answers of language models as column expressions: JSON objects, ids, tool calls, picks."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of tools that a reasoner may call.
TOOLS = ("search_entities", "find_by_alias_year", "get_entity", "year_active", "name_at_year", "find_family")
#: What of a request makes it the same request.
REQUEST = ("model", "messages", "temperature", "top_p", "max_tokens", "n", "tools", "tool_choice", "response_format", "stop", "seed")

#: Fixed grammar of answers. An object without objects inside that names the field; the field with a number; the name loosely followed by a number.
FIELD = "entity_id"
FLAT = rf'(?s)(\{{[^{{}}]*"{FIELD}"[^{{}}]*\}})'
AFTER_COLON, AFTER_NAME = rf'"{FIELD}"\s*:\s*(\d+)', rf"{FIELD}[=\s]+(\d+)"
#: Fixed grammar of written tool calls: a name, one or more marks, an object that may hold objects one level deep.
MARK, SIGN = r"<[|｜][^<>]*[|｜]>", "§"
NAME, OBJECT = r"[A-Za-z_]\w*", r"\{(?:[^{}]|\{[^{}]*\})*\}"


def json_object(c: Column) -> Column:
    """The text of the answer's JSON object: from the first { to the last } if that parses, else the first flat object that names an entity_id if that parses, else null."""
    t = F.coalesce(c, F.lit(""))
    outer = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    flat = F.regexp_extract(t, FLAT, 1)
    ok = lambda x: F.when((x != "") & F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(ok(outer), ok(flat))


def final_id(c: Column) -> Column:
    """The entity id that an answer ends on: of a flat JSON object, else after "entity_id":, else after entity_id= or a blank; -1 if the object has no id, null if nothing tells one."""
    t = F.coalesce(c, F.lit(""))
    flat = F.regexp_extract(t, FLAT, 1)
    told = F.when((flat != "") & F.try_parse_json(flat).isNotNull(), F.get_json_object(flat, "$.entity_id").try_cast("long"))
    named, loose = F.regexp_extract(t, AFTER_COLON, 1), F.regexp_extract(t, AFTER_NAME, 1)
    return F.coalesce(told, named.try_cast("long"), loose.try_cast("long"))


def pick(c: Column, finalists: Column, fallback: Column) -> Column:
    """struct(id, confidence): the answer's id if it is among the finalists, else the fallback."""
    obj = json_object(c)
    told = F.when(obj.isNotNull(), F.get_json_object(obj, "$.entity_id").try_cast("long")).otherwise(final_id(c))
    good = F.coalesce(F.array_contains(finalists.cast("array<bigint>"), told), F.lit(False))
    return F.struct(F.when(good, told).otherwise(fallback.cast("long")).alias("id"), F.get_json_object(obj, "$.confidence").alias("confidence"))


def tool_calls(c: Column) -> Column:
    """array<struct<name, args>> of tool calls written between marks such as <|...|>: a tool's name, marks, a JSON object (one level of nesting); arguments that don't parse are {}."""
    t = F.coalesce(c, F.lit(""))
    marked = F.regexp_replace(t, MARK, SIGN)
    found = F.regexp_extract_all(marked, F.lit(rf"({NAME}\s*{SIGN}+\s*{OBJECT})"), F.lit(1))
    parts = F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^(\w+)", 1).alias("name"), F.regexp_extract(x, r"(?s)(\{.*\})$", 1).alias("args")))
    known = F.filter(parts, lambda x: x["name"].isin(*TOOLS))
    return F.when(t.contains("<｜") | t.contains("<|"), F.transform(known, lambda x: F.struct(x["name"].alias("name"), F.when(F.try_parse_json(x["args"]).isNotNull(), x["args"]).otherwise("{}").alias("args")))).otherwise(F.array().cast("array<struct<name:string,args:string>>"))


def request_key(request: Column) -> Column:
    """The digest of a request, a struct of the fields of REQUEST in order of name: its canonical JSON by SHA-256."""
    return F.sha2(F.to_json(request), 256)


def request_key_of(**request: object) -> str:
    """The same for one request, as a reasoner in Python makes it: fields sorted, letters as they are."""
    keep = {k: request[k] for k in sorted(REQUEST) if k in request}
    return hashlib.sha256(json.dumps(keep, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()
