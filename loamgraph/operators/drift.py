"""Schemas that drift between files: versioned fingerprints, chained migration rules, every change recorded.

A payload's fingerprint is the hash of its top-level fields with their types; the registry keeps each fingerprint once, with its
fields and the explicit steps that lead from it to the one table. Streams are read in order, and a record is compared with the one before it only
where their fingerprints differ, which the JVM finds. The order is made by range partitions over (stream, time, id), so a stream
with a third of all records spreads over as many tasks as it needs; what one partition must know of the one before, its last
schema, is a row per partition.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.session import materialize, ship, shuffle_partitions

# Migration rules, a canonical field and the names it was given over time, each renamed to the one before it.
RENAMES = {
    "version": ["ver", "schema_version", "cacheVersion", "cache_version"],
    "extractor": ["extractorStamp", "extractor_stamp", "extractor_id", "extractorId", "stamp"],
    "files": ["fileCount", "file_count", "file_total", "fileTotal"],
    "comments": ["commentTokens", "comment_tokens", "comment_count", "commentCount"],
    "partial": ["is_partial", "isPartial"],
    "languages": ["langs", "lang_list"],
    "nodeCount": ["node_count", "nodes", "nodeTotal", "node_total"],
    "edgeCount": ["edge_count", "edges", "edgeTotal", "edge_total"],
    "totalCount": ["total_count", "total"],
    "readyCount": ["ready_count", "ready"],
    "wiringBytes": ["wiring_bytes", "graphBytes", "graph_bytes"],
    "wiringMtimeMs": ["wiring_mtime_ms", "graphMtimeMs", "graph_mtime_ms", "mtime", "mtime_ms", "mtimeMs"],
}
# Name parts that say how a field is written down, not what it means.
FILLER = ["count", "counts", "total", "number", "num", "id", "is", "list", "value"]
# The types of the one consistent table.
TABLE_TYPES = {
    "version": "bigint", "extractor": "string", "files": "bigint", "comments": "bigint", "partial": "boolean", "languages": "array<string>",
    "nodeCount": "bigint", "edgeCount": "bigint", "totalCount": "bigint", "readyCount": "bigint", "wiringBytes": "bigint", "wiringMtimeMs": "double",
}

_CANONICAL = {alias: name for name, aliases in RENAMES.items() for alias in [name, *aliases]}


def meaning(name: str) -> str:
    """What a field name stands for: the canonical field of the migration rules, else its name parts without filler and plural."""
    if name in _CANONICAL:
        return _CANONICAL[name]
    parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", name)
    kept = [p.lower() for p in parts if p.lower() not in FILLER] or [p.lower() for p in parts]
    stem = "_".join(p[:-1] if len(p) > 3 and p.endswith("s") else p for p in kept)
    return next((c for c in RENAMES if stem and stem == "_".join(x[:-1] if len(x) > 3 and x.endswith("s") else x for x in [y.lower() for y in re.findall(r"[A-Z]?[a-z]+|\d+", c)] if x not in FILLER)), stem or name)


def payload_variant(payload: str = "payload") -> Column:
    """The payload as a variant if it is exactly one JSON object, else null (cut, null, no object, text after the object)."""
    whole = F.expr(f"try_parse_json(concat('[', {payload}, ']'))")
    one = F.size(F.try_variant_get(whole, "$", "array<variant>")) == 1
    return F.when(one, F.try_variant_get(whole, "$[0]", "variant"))


def _kind(t: Column) -> Column:
    """Type class of schema_of_variant's text; a decimal of scale 0 beyond 18 digits is a long integer."""
    precision = F.regexp_extract(t, r"^DECIMAL\((\d+),0\)$", 1)
    return (
        F.when(t == "VOID", F.lit(None).cast("string"))
        .when(t.startswith("ARRAY"), "array")
        .when(t.startswith("OBJECT"), "object")
        .when(t == "BOOLEAN", "boolean")
        .when(t == "STRING", "string")
        .when((t == "BIGINT") | (F.coalesce(precision.try_cast("int"), F.lit(0)) > 18), "integer")
        .otherwise("decimal")
    )


def fingerprints(records: DataFrame) -> DataFrame:
    """stream, written_at, record_id, fields (array of name and kind, by name; kind null for a null value), fingerprint.

    Rows of the same record_id are one row; payloads that are no JSON object are skipped; a record without a stream or id has no place and is skipped.
    """
    rows = records.where("stream is not null and record_id is not null").select("stream", "written_at", "record_id", "payload").dropDuplicates(["record_id"])
    rows = rows.withColumn("fields", F.try_variant_get(payload_variant(), "$", "map<string,variant>")).where("fields is not null")
    named = F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.struct(e["key"].alias("name"), _kind(F.schema_of_variant(e["value"])).alias("kind"))))
    rows = rows.select("stream", "written_at", "record_id", named.alias("fields"))
    return rows.withColumn("fingerprint", F.xxhash64(F.to_json("fields")))


def compare(before: dict[str, str | None], now: dict[str, str | None]) -> tuple[list[tuple[str, str]], dict[str, str | None]]:
    """Changes from one schema to the next as (field, kind of change), and the schema to compare the next record with.

    A null value keeps the type the field had; a renamed field keeps it too.
    """
    changes, after = [], dict(now)
    gone, new = [f for f in before if f not in now], [f for f in now if f not in before]
    for field in now:
        if field in before:
            if now[field] is None:
                after[field] = before[field]
            elif before[field] is not None and before[field] != now[field]:
                changes.append((field, "retyped"))
    for field in sorted(new):
        same = [g for g in gone if meaning(g) == meaning(field) and (before[g] == now[field] or None in (before[g], now[field]))]
        if same:
            gone.remove(same[0])
            if now[field] is None:
                after[field] = before[same[0]]
            changes.append((field, "renamed"))
        else:
            changes.append((field, "added"))
    return changes + [(g, "removed") for g in gone], after


def _scan(batches, carry: tuple[str, dict] | None):
    """(stream, changes) of each record in order, and at the end the carry for the next partition."""
    stream, schema = carry or (None, None)
    for b in batches:
        for s, rid, fields in zip(b["stream"], b["record_id"], b["fields"], strict=True):
            now = {f["name"]: f["kind"] for f in fields}
            if s == stream:
                changes, schema = compare(schema, now)
                yield s, rid, changes, schema
            else:
                stream, schema = s, now
                yield s, rid, [], schema


def schema_registry(prints: DataFrame) -> DataFrame:
    """fingerprint, fields of :func:`fingerprints`, each once."""
    return prints.groupBy("fingerprint").agg(F.first("fields").alias("fields"))


def _literal_map(table: dict):
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))]
    return F.create_map(*pairs)


def migration_steps(registry: DataFrame) -> DataFrame:
    """The registry with ``steps``, the migration of each fingerprint to the table: renames, name by name along their chain, then defaults of what is
    missing, then casts; and ``origin``, for each canonical field the name it bears in payloads of that fingerprint (none if it is missing)."""
    chains = {a: [f"rename {x} to {y}" for x, y in zip(names[k:0:-1], names[k - 1 :: -1], strict=True)] for c, aliases in RENAMES.items() for names in [[c, *aliases]] for k, a in enumerate(names) if k}
    names = F.transform("fields", lambda f: f["name"])
    kinds = F.map_from_entries(F.transform("fields", lambda f: F.struct(f["name"], f["kind"])))
    wanted = {"bigint": "integer", "double": "decimal", "string": "string", "boolean": "boolean", "array<string>": "array"}
    origin = F.map_filter(F.create_map(*[x for c in TABLE_TYPES for x in (F.lit(c), F.get(F.filter(F.array(*map(F.lit, [c, *RENAMES[c]])), lambda a: F.array_contains(names, a)), F.lit(0)))]), lambda _, v: v.isNotNull())
    rows = registry.withColumn("origin", F.when(F.size("fields") >= 0, origin)).withColumn("_kinds", kinds)
    renames = F.flatten(F.transform(F.map_values("origin"), lambda a: F.coalesce(F.try_element_at(_literal_map(chains), a), F.array().cast("array<string>"))))
    missing = F.transform(F.filter(F.array(*map(F.lit, TABLE_TYPES)), lambda c: ~F.map_contains_key("origin", c)), lambda c: F.concat(F.lit("default "), c, F.lit(" to null")))
    casts = F.filter(
        F.transform(F.map_entries("origin"), lambda e: F.struct(e["key"].alias("c"), F.try_element_at("_kinds", e["value"]).alias("kind"), F.try_element_at(_literal_map({c: wanted[t] for c, t in TABLE_TYPES.items()}), e["key"]).alias("want"))),
        lambda x: x["kind"].isNotNull() & (x["kind"] != x["want"]),
    )
    casts = F.transform(casts, lambda x: F.concat(F.lit("cast "), x["c"], F.lit(" from "), x["kind"], F.lit(" to "), x["want"]))
    return rows.select("fingerprint", "fields", F.concat(renames, missing, casts).alias("steps"), "origin")


def schema_versions(records: DataFrame) -> DataFrame:
    """stream, fingerprint, first_written_at, first_record_id, n_records, steps: the schemas of each stream, when each came up and how it is migrated."""
    prints = materialize(fingerprints(records), "fingerprints")
    at = F.struct(F.col("written_at").isNotNull().alias("dated"), "written_at", "record_id")
    per = prints.groupBy("stream", "fingerprint").agg(F.min(at).alias("first"), F.count("*").alias("n_records"))
    rows = per.join(migration_steps(schema_registry(prints)).select("fingerprint", "steps"), "fingerprint")
    return rows.select("stream", "fingerprint", F.col("first.written_at").alias("first_written_at"), F.col("first.record_id").alias("first_record_id"), "n_records", "steps")


def _ordered(group):
    """The rows of one range partition in order: stream, then time with null first, then id."""
    group = group.assign(_dated=group["written_at"].notna())
    return group.sort_values(["stream", "_dated", "written_at", "record_id"], kind="stable")


def schema_changes(records: DataFrame) -> DataFrame:
    """stream, record_id, field_name, change_kind: every change between a record and the one before it in its stream.

    Order is written_at (null first), record_id. The first record of a stream shows no change. An empty table gives no rows.
    Records whose fingerprint is that of the record before are dropped before Python sees them.
    """
    import pandas as pd

    spark = records.sparkSession
    ship(spark)
    keys = ["stream", "written_at", "record_id"]
    prints = materialize(fingerprints(records), "fingerprints")  # the range bounds are drawn from it, then it is read
    placed = prints.select(*keys, "fingerprint").repartitionByRange(shuffle_partitions(spark), *keys).withColumn("pid", F.spark_partition_id())
    before = Window.partitionBy("pid").orderBy(*keys)
    turns = placed.withColumn("_s", F.lag("stream").over(before)).withColumn("_f", F.lag("fingerprint").over(before))
    turns = turns.where("_s is null or _s <> stream or _f <> fingerprint").drop("_s", "_f")
    turns = materialize(turns.join(schema_registry(prints), "fingerprint").drop("fingerprint"), "turns")

    def heads(group: pd.DataFrame) -> pd.DataFrame:
        # what a partition does to a carry that arrives from the left: the records of its first stream, folded to one step
        first, last, known, inherit, single, lead = None, None, None, {}, True, {}
        group = _ordered(group)
        for s, fields in zip(group["stream"], group["fields"], strict=True):
            now = {f["name"]: f["kind"] for f in fields}
            if first is None:
                first, inherit = s, {f: f for f in now if now[f] is None}
                known, last, lead = now, s, now
                continue
            if s != last:
                single, last, known, inherit = False, s, now, {}
                continue
            before, (_, known) = known, compare(known, now)
            if single:  # fields whose type is still the one the carry must tell, under the names they have now
                moved = {}
                for f in known:
                    if known[f] is None:
                        if f in inherit and f in before:
                            moved[f] = inherit[f]
                        elif f not in before:
                            src = next((g for g in before if g not in now and g in inherit and meaning(g) == meaning(f)), None)
                            if src:
                                moved[f] = inherit[src]
                inherit = moved
        out = {"first": first, "last": last, "single": single, "lead": lead, "schema": known, "inherit": inherit}
        return pd.DataFrame({"pid": [int(group["pid"].iloc[0])], "summary": [json.dumps(out)]})

    # one row per partition: as many as there are partitions, however large the table
    carries, carry = {}, None
    for pid, text in sorted((r.pid, r.summary) for r in turns.groupBy("pid").applyInPandas(heads, "pid int, summary string").collect()):
        part = json.loads(text)
        if carry and carry[0] == part["first"]:
            carries[pid] = carry
            if part["single"]:
                _, lead = compare(carry[1], part["lead"])
                schema = {f: k if k is not None else lead.get(part["inherit"].get(f)) for f, k in part["schema"].items()}
                carry = (part["last"], schema)
                continue
        carry = (part["last"], part["schema"])

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        rows = [(s, rid, field, kind) for s, rid, changes, _ in _scan([_ordered(group)], carries.get(int(group["pid"].iloc[0]))) for field, kind in changes]
        return pd.DataFrame(rows, columns=["stream", "record_id", "field_name", "change_kind"])

    return turns.groupBy("pid").applyInPandas(scan, "stream string, record_id long, field_name string, change_kind string")


def consistent_table(records: DataFrame) -> DataFrame:
    """One row per readable record with the canonical fields in their table types, and ``extras`` (JSON of all other fields).

    Each record is routed by the steps of its fingerprint (:func:`migration_steps`). Rename: the first present of a field's names, the canonical one first. Default: null. Cast: a value that cannot take
    the table type, such as an object in a number's place, is null in its column and kept in ``extras`` under its own name, and so is one that the cast bends, such as a decimal in an integer's place (cut to its whole part); a single string for a list becomes a list of one.
    """
    prints = materialize(fingerprints(records).select("fingerprint", "fields", "record_id"), "fingerprints")
    routes = migration_steps(schema_registry(prints)).select("fingerprint", "origin")
    route = prints.select("record_id", "fingerprint").join(routes, "fingerprint").drop("fingerprint")
    rows = records.where("stream is not null and record_id is not null").dropDuplicates(["record_id"])
    rows = rows.withColumn("_m", F.try_variant_get(payload_variant(), "$", "map<string,variant>")).where("_m is not null").join(route, "record_id")
    cols = []
    for name, sql_type in TABLE_TYPES.items():
        raw = F.try_element_at("_m", F.try_element_at("origin", F.lit(name)))
        value = F.try_variant_get(raw, "$", sql_type)
        if sql_type.startswith("array"):
            value = F.coalesce(value, F.when(F.schema_of_variant(raw) == "STRING", F.array(F.try_variant_get(raw, "$", "string"))))
        elif sql_type in ("bigint", "double"):
            value = F.coalesce(value, F.try_variant_get(raw, "$", "string").try_cast(sql_type))
        elif sql_type == "string":
            value = F.when(~F.schema_of_variant(raw).rlike("^(ARRAY|OBJECT)"), value)
        cols.append(value.alias(re.sub(r"(?<=[a-z])([A-Z])", lambda m: "_" + m[1].lower(), name)))

    def left_over(k: Column, v: Column) -> Column:
        kind, lost = F.schema_of_variant(v), ~F.array_contains(F.map_values("origin"), k)
        for sql_type in dict.fromkeys(TABLE_TYPES.values()):
            names = [a for c, t in TABLE_TYPES.items() if t == sql_type for a in [c, *RENAMES[c]]]
            if sql_type.startswith("array"):
                cannot = ~kind.startswith("ARRAY") & (kind != "STRING")
            elif sql_type in ("bigint", "double"):
                cannot = F.try_variant_get(v, "$", "string").try_cast(sql_type).isNull()
            else:
                cannot = F.try_variant_get(v, "$", sql_type).isNull() | kind.rlike("^(ARRAY|OBJECT)")
            lost = lost | k.isin(names) & (kind != "VOID") & cannot
        return lost

    extras = F.to_json(F.map_filter("_m", left_over))
    return rows.select("record_id", "stream", "prefix", "written_at", *cols, extras.alias("extras"))
