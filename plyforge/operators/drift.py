"""Records whose schema drifts from file to file (problem 3).

Method: tagged-union inference. Every readable record becomes a VARIANT; exploding it gives (key, value) pairs whose JSON type is
the tag. A profile per version (feed, shard) and key keeps *all* types met, next to each other; nothing is widened to text.

* A field may be carried under different keys. A key belongs to a field by its name, or, for names not known beforehand, if at
  least nine tenths of its self-explaining values (text, list, object) over the whole collection are values of that field.
* Values are split into typed branches (text, whole number, decimal number, list, object), and each branch has its own
  conversion to the canonical value. Number codes are read in the coding of their version (see ``coding``).
* Changes between a version and the one before it come from an equi-join on (feed, shard - 1), not from a window over a feed.
* ``changes`` reports the key and type that most records of a version carry; ``alternatives`` reports *every* (key, type) of a field that appears
  in a version and was not in the one before, also beside others.

Defined results: null, broken and non-object payloads are unreadable: they carry no key, and their row stays in the unified
table with ``readable`` false; a repeated key in one object makes the record unreadable; a shard without any readable record
carries no field; a field whose values in a shard are all null has no type there, so it is neither retyped there nor in the
next shard; between several keys of one field in a shard, and several types, the most frequent counts (ties: the first by
name); repeated records change nothing but counts; records without a feed or shard number belong to no version and keep their row, without the fields; an empty table gives no rows; other columns of the input are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge.operators.skew import salted_join
from plyforge.sources.tables import materialize

#: Names under which a field is known to travel; more are found from their values.
NAMES = {
    "result": ("result", "Result", "gameResult", "game_result", "outcome", "res", "final_score", "score"),
    "termination": ("termination", "Termination", "terminationType", "how_ended", "ended_by", "end_reason", "finish", "term"),
}
#: Keys that look like one of the fields but are their own.
OWN = ("movetext_result",)
TERMINATIONS = ("Normal", "Time forfeit", "Abandoned", "Rules infraction")
KINDS = ("text", "whole", "decimal", "list", "object")


def readable(payload: Column) -> Column:
    """The payload as VARIANT if it is one JSON object, else null."""
    v = F.try_parse_json(payload)
    return F.when(F.rtrim(F.regexp_replace(payload, r"\s+$", "")).endswith("}") & F.schema_of_variant(v).startswith("OBJECT"), v)


def kind_of(value: Column) -> Column:
    """Tag of a VARIANT: ``text``, ``whole``, ``decimal`` (written with a point or an exponent), ``list``, ``object``, ``bool`` or ``null``."""
    s = F.schema_of_variant(value)
    wide = s.rlike(r"^DECIMAL\((19|[23]\d),0\)$")  # whole numbers past 64 bits
    return (
        F.when(s == "STRING", "text")
        .when((s == "BIGINT") | wide, "whole")
        .when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "decimal")
        .when(s.startswith("ARRAY"), "list")
        .when(s.startswith("OBJECT"), "object")
        .when(s == "BOOLEAN", "bool")
        .otherwise("null")
    )


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _score(white: Column) -> Column:
    return F.when(white == 1.0, "1-0").when(white == 0.0, "0-1").when(white == 0.5, "1/2-1/2")


def result_of(value: Column, kind: Column, code: Column) -> Column:
    """Canonical result; ``code`` is the number coding: ``signed`` (1, 0, -1) or ``points`` (2, 1, 0)."""
    text = F.lower(F.trim(_get(value, "$", "string")))
    from_text = F.when(text.isin("1-0", "white", "w", "1", "1.0"), "1-0").when(text.isin("0-1", "black", "b", "0", "0.0"), "0-1").when(text.isin("1/2-1/2", "draw", "d", "½", "½-½", "1/2", "0.5"), "1/2-1/2")
    whole = _get(value, "$", "bigint")
    signed = F.when(whole == 1, "1-0").when(whole == -1, "0-1").when(whole == 0, "1/2-1/2")
    points = F.when(whole == 2, "1-0").when(whole == 0, "0-1").when(whole == 1, "1/2-1/2")
    return (
        F.when(kind == "text", from_text)
        .when(kind == "whole", F.when(code == "signed", signed).otherwise(points))
        .when(kind == "decimal", _score(_get(value, "$", "double")))
        .when(kind == "list", _score(_get(value, "$[0]", "double")))
        .when(kind == "object", _score(_get(value, "$.white", "double")))
    )


def termination_of(value: Column, kind: Column, base: Column) -> Column:
    """Canonical termination; number codes count from ``base`` through ``TERMINATIONS``."""
    raw = F.when(kind == "list", _get(value, "$[0]", "string")).when(kind == "object", _get(value, "$.kind", "string")).when(kind == "text", _get(value, "$", "string"))
    text = F.regexp_replace(F.lower(F.trim(raw)), r"[_\-\s]+", " ")
    named = F.coalesce(*(F.when(text == name.lower(), name) for name in TERMINATIONS))
    numbered = F.get(F.array(*map(F.lit, TERMINATIONS)), (_get(value, "$", "bigint") - base).cast("int"))
    return F.when(kind == "whole", numbered).otherwise(named)


def records(rows: DataFrame) -> DataFrame:
    return rows.select("rec_id", "feed", "shard_no", "written_at", readable(F.col("payload")).alias("v"))


def fields(rows: DataFrame) -> DataFrame:
    """One row per key of every readable record: ``rec_id, feed, shard_no, key, value, kind``."""
    read = records(rows).where("v IS NOT NULL")
    exploded = read.sparkSession.sql("SELECT r.rec_id, r.feed, r.shard_no, e.key, e.value FROM {read} AS r, LATERAL variant_explode(r.v) AS e", read=read)
    return exploded.withColumn("kind", kind_of(F.col("value")))


def profile(rows: DataFrame) -> DataFrame:
    """The tagged union per version: counts per (feed, shard_no, key, kind), how many values each field's conversion knows, and the spread of whole numbers."""
    value, kind = F.col("value"), F.col("kind")
    plain = kind.isin("text", "list", "object")
    whole = F.when(kind == "whole", _get(value, "$", "bigint"))
    return (
        fields(rows)
        .groupBy("feed", "shard_no", "key", "kind")
        .agg(
            F.count("*").alias("n"),
            F.count_if(plain).alias("n_plain"),
            F.count_if(plain & result_of(value, kind, F.lit("signed")).isNotNull()).alias("n_result"),
            F.count_if(plain & termination_of(value, kind, F.lit(0)).isNotNull()).alias("n_termination"),
            F.min(whole).alias("lo"),
            F.max(whole).alias("hi"),
            F.count_if(whole == 0).alias("n_0"),
            F.count_if(whole == 1).alias("n_1"),
        )
    )


def key_fields(found: DataFrame) -> DataFrame:
    """``key, field_name`` of every key that carries one of the fields."""
    k = F.col("key")
    by_name = F.when(k.isin(*NAMES["result"]), "result").when(k.isin(*NAMES["termination"]), "termination")
    by_value = F.when(F.col("r") >= 0.9 * F.col("p"), "result").when(F.col("t") >= 0.9 * F.col("p"), "termination")
    keys = found.groupBy("key").agg(F.sum("n_plain").alias("p"), F.sum("n_result").alias("r"), F.sum("n_termination").alias("t"))
    field = F.when(k.isin(*OWN), None).otherwise(F.coalesce(by_name, F.when(F.col("p") > 0, by_value)))
    return keys.select("key", field.alias("field_name")).where("field_name IS NOT NULL")


def carried(found: DataFrame) -> DataFrame:
    """Per version and field: the key that carries it, its type (null if all values are null), and the coding of its numbers."""
    per_key = (
        found.join(key_fields(found), "key")
        .groupBy("feed", "shard_no", "field_name", "key")
        .agg(
            F.sum("n").alias("n"),
            F.max(F.when(F.col("kind") != "null", F.struct("n", F.translate("kind", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba").alias("back"), "kind"))).alias("top"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.sum("n_0").alias("n_0"),
            F.sum("n_1").alias("n_1"),
        )
    )
    code = F.when(F.col("lo") < 0, "signed").when((F.col("hi") > 1) | (F.col("n_1") <= F.col("n_0")), "points").otherwise("signed")
    best = F.min(F.struct((-F.col("n")).alias("less"), "key", F.col("top.kind").alias("kind"), code.alias("code"), F.col("lo").alias("base")))
    return per_key.groupBy("feed", "shard_no", "field_name").agg(best.alias("b")).select("feed", "shard_no", "field_name", "b.key", "b.kind", "b.code", "b.base")


def changes(rows: DataFrame) -> DataFrame:
    """``feed, shard_no, field_name, change_kind`` with the keys and types before and after."""
    found = materialize(profile(rows), "p3-profile")
    state = carried(found).select("feed", "shard_no", "field_name", "key", "kind")
    shards = rows.select("feed", "shard_no").distinct().withColumn("field_name", F.explode(F.array(*map(F.lit, NAMES))))
    now = shards.join(state, ["feed", "shard_no", "field_name"], "left")
    before = now.select("feed", (F.col("shard_no") + 1).alias("shard_no"), "field_name", F.col("key").alias("key_before"), F.col("kind").alias("kind_before"))
    both = now.join(before, ["feed", "shard_no", "field_name"])
    a, b = F.col("key_before"), F.col("key")
    kept = a.isNotNull() & b.isNotNull()
    kinds = F.array_compact(
        F.array(
            F.when(a.isNull() & b.isNotNull(), "added"),
            F.when(a.isNotNull() & b.isNull(), "removed"),
            F.when(kept & (a != b), "renamed"),
            F.when(kept & (F.col("kind_before") != F.col("kind")), "retyped"),
        )
    )
    return both.select("feed", "shard_no", "field_name", F.explode(kinds).alias("change_kind"), "key_before", "key", "kind_before", "kind")


def alternatives(rows: DataFrame) -> DataFrame:
    """``feed, shard_no, field_name, path, type, n, beside_another``: keys and types of a field that the shard before did not have, with their records, and whether the shard has others too."""
    found = materialize(profile(rows), "p3-profile")
    kinds = found.where("kind <> 'null'").join(key_fields(found), "key").groupBy("feed", "shard_no", "field_name", F.col("key").alias("path"), F.col("kind").alias("type")).agg(F.sum("n").alias("n"))
    others = kinds.groupBy("feed", "shard_no", "field_name").agg(F.count("*").alias("n_alternatives"))
    shards = rows.select("feed", (F.col("shard_no") + 1).alias("shard_no")).distinct()  # those with a shard before
    before = kinds.select("feed", (F.col("shard_no") + 1).alias("shard_no"), "field_name", "path", "type")
    new = kinds.join(shards, ["feed", "shard_no"], "left_semi").join(before, ["feed", "shard_no", "field_name", "path", "type"], "left_anti")
    return new.join(others, ["feed", "shard_no", "field_name"]).select("feed", "shard_no", "field_name", "path", "type", "n", (F.col("n_alternatives") > 1).alias("beside_another"))


def readability(rows: DataFrame) -> DataFrame:
    """Per shard: records, readable ones, and those with a site."""
    v = F.col("v")
    return records(rows).groupBy("feed", "shard_no").agg(F.count("*").alias("n_rows"), F.count(v).alias("n_readable"), F.count(_get(v, "$.site", "string")).alias("n_sites"))


def unified(rows: DataFrame) -> DataFrame:
    """All records in one schema: the stable fields, canonical ``result`` and ``termination``, and for both the tag and the typed branches."""
    found = materialize(profile(rows), "p3-profile")
    state = carried(found).groupBy("feed", "shard_no").pivot("field_name", list(NAMES)).agg(F.first(F.struct("key", "code", "base")))
    # one row per shard, also where it carries neither field; written, so that its true size decides whether it is broadcast
    version = F.struct("feed", "shard_no").alias("_version")
    shards = rows.groupBy("feed", "shard_no").agg(F.count("*").alias("_rows"))
    state = materialize(shards.join(state, ["feed", "shard_no"], "left").select(version, *NAMES), "p3-state")
    # rows without a feed or number belong to no shard and are kept
    own = records(rows).withColumn("_version", F.struct("feed", "shard_no"))
    read = salted_join(own, state, "_version").drop("_version")
    v = F.col("v")
    out = {"rec_id": F.col("rec_id"), "feed": F.col("feed"), "shard_no": F.col("shard_no"), "written_at": F.col("written_at"), "readable": v.isNotNull()}
    for name, kind in (("site", "string"), ("utc_date", "string"), ("white_elo", "int"), ("black_elo", "int"), ("time_control", "string"), ("n_plies", "int"), ("movetext_result", "string")):
        out[name] = _get(v, f"$.{name}", kind)
    for name in NAMES:
        value = _get(v, F.concat(F.lit("$['"), F.col(f"{name}.key"), F.lit("']")), "variant")
        read = read.withColumn(f"{name}_value", value)
        read = read.withColumn(f"{name}_kind", F.when(F.col(f"{name}_value").isNotNull(), kind_of(F.col(f"{name}_value"))))
        x, kind = F.col(f"{name}_value"), F.col(f"{name}_kind")
        out[name] = result_of(x, kind, F.col("result.code")) if name == "result" else termination_of(x, kind, F.col("termination.base"))
        out[f"{name}_kind"] = kind
        out[f"{name}_text"] = F.when(kind == "text", _get(x, "$", "string"))
        out[f"{name}_whole"] = F.when(kind == "whole", _get(x, "$", "bigint"))
        out[f"{name}_decimal"] = F.when(kind == "decimal", _get(x, "$", "double"))
        out[f"{name}_list"] = F.when(kind == "list", F.to_json(x))
        out[f"{name}_object"] = F.when(kind == "object", F.to_json(x))
    return read.select(*(c.alias(n) for n, c in out.items()))
