"""Canonical identity of a profile, keep-first deduplication and display names."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.functions.uri import compact_code, computed, strip
from sluiceway.operators.profiles import alpn_tokens, insecure_flag, param, parse_profiles, static_filter

#: Labels in published names.
PROTOCOL_LABELS = {"vless": "VL", "trojan": "TR", "hysteria2": "HY2"}
TRANSPORT_LABELS = {"raw": "TCP", "tcp": "TCP", "ws": "WS", "websocket": "WS", "grpc": "GRPC", "h2": "H2", "httpupgrade": "HUP", "xhttp": "XHTTP", "udp": "UDP"}


def canonical_material() -> Column:
    """Compact JSON of what a client maps, keys sorted; keys that don't apply are null and so
    are left out. Characters beyond ASCII are escaped as \\uXXXX."""
    hy2, vless = F.col("protocol") == "hysteria2", F.col("protocol") == "vless"
    net = F.when(F.col("transport") == "websocket", "ws").when(F.col("transport") == "raw", "tcp").otherwise(F.col("transport"))
    ws, grpc, upgrade, xhttp, h2 = ((~hy2) & (net == x) for x in ("ws", "grpc", "httpupgrade", "xhttp", "h2"))
    reality = ~hy2 & (F.col("security") == "reality")
    multi = (param("mode") == "multi") | (param("multimode") == "true")
    parts = {
        "address": F.lower("server"),
        "allowInsecure": insecure_flag(),
        "alpn": alpn_tokens(),
        "authority": F.when(grpc, param("authority")),
        "credential": F.coalesce("username", "secret", F.lit("")),
        "encryption": F.when(vless, F.lower(param("encryption", "none"))),
        "extra": F.when(xhttp, param("extra")),
        "fingerprint": param("fp"),
        "flow": F.when(vless, param("flow")),
        "host": F.when(ws | upgrade | xhttp | h2, param("host")),
        "mode": F.when(grpc, F.when(multi, "multi").otherwise("gun")).when(xhttp, param("mode", "auto")),
        "network": F.when(hy2, "quic").otherwise(net),
        "obfs": F.when(hy2, param("obfs")),
        "obfsPassword": F.when(hy2, param("obfs-password")),
        "path": F.when(ws | upgrade, param("path", "/")).when(h2 | xhttp, param("path")),
        "port": F.col("port"),
        "ports": F.when(hy2, F.when(param("mport") != "", param("mport")).otherwise(param("ports"))),
        "protocol": F.col("protocol"),
        "publicKey": F.when(reality, param("pbk")),
        "security": F.when(~hy2, F.col("security")),
        "serviceName": F.when(grpc, param("servicename")),
        "shortId": F.when(reality, param("sid")),
        "sni": param("sni"),
        "spiderX": F.when(reality, param("spx")),
    }
    json = F.to_json(F.struct(*(v.alias(k) for k, v in parts.items())))
    units = F.regexp_extract_all(F.hex(F.encode(json, "UTF-16BE")), F.lit("(.{4})"), 1)
    ascii_only = F.array_join(F.transform(units, lambda u: F.when(u.rlike("^00([0-6]|7[0-9A-E])"), F.decode(F.unhex(u), "UTF-16BE")).otherwise(F.concat(F.lit("\\u"), F.lower(u)))), "")
    return F.when(json.rlike(r"[^\x00-\x7E]"), ascii_only).otherwise(json)


def fingerprint() -> Column:
    return F.sha2(canonical_material(), 256)


#: Above any ordinal: two of them make one decimal, which aggregates in place.
_BASE = 10**19


def keep_first(profiles: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``: a minimum with map-side combining, which is
    deterministic, unlike dropDuplicates. Rows of keys and one or two whole ordinals (from 0) alone
    are aggregated in hash maps; wider ones have to be sorted, so fetch what else is needed for
    the first ones alone (see ``unique_profiles``)."""
    types = dict(profiles.dtypes)
    if set(profiles.columns) == {*keys, *order} and len(order) in (1, 2) and all(types[c] in ("int", "bigint") for c in order):
        if len(order) == 1:
            return profiles.groupBy(*keys).agg(F.min(order[0]).alias(order[0])).select(profiles.columns)
        base = F.lit(Decimal(_BASE)).cast("decimal(20,0)")
        packed = F.col(order[0]).cast("decimal(19,0)") * base + F.col(order[1]).cast("decimal(19,0)")
        best = profiles.groupBy(*keys).agg(F.min(packed.cast("decimal(38,0)")).alias("_p"))
        parts = {order[0]: F.call_function("div", F.col("_p"), base), order[1]: F.col("_p") % base}
        return best.select(*keys, *(parts[c].cast(types[c]).alias(c) for c in order)).select(profiles.columns)
    rest = [c for c in profiles.columns if c not in order]
    best = profiles.groupBy(*keys).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("r"))
    return best.select("r.*").select(profiles.columns)


def accepted_profiles(lines: DataFrame) -> DataFrame:
    """Profiles of lines (doc_idx, line_idx, line) that pass all checks, with their fingerprint."""
    return computed(static_filter(lines).filter("reason is null"), fingerprint=fingerprint())


def unique_profiles(lines: DataFrame) -> DataFrame:
    """The first accepted profile of each fingerprint, in full. Only fingerprints and ordinals go through
    the deduplication; the lines of the first ones are looked up by their ordinals and parsed
    again, and they are few. Lines that share their ordinals are told apart by their fingerprints, and
    where these are equal too, the smallest line stays."""
    first = keep_first(accepted_profiles(lines).select("doc_idx", "line_idx", "fingerprint"), ["fingerprint"], ["doc_idx", "line_idx"])
    again = accepted_profiles(lines.join(first.withColumnRenamed("fingerprint", "_first"), ["doc_idx", "line_idx"]))
    least = Window.partitionBy("fingerprint").orderBy("line")
    return again.filter("fingerprint = _first").withColumn("_k", F.row_number().over(least)).filter("_k = 1").drop("_first", "_k")


def compatibility_groups(profiles: DataFrame) -> DataFrame:
    key = F.lower(strip(F.coalesce("secret", "username", F.lit(""))))
    grouped = profiles.groupBy("protocol", F.lower("server").alias("host"), "port", key.alias("credential"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fingerprint").alias("n_identities"))


def split_by_protocol(profiles: DataFrame) -> DataFrame:
    """Counts of all three protocols, also those without a profile."""
    every = profiles.sparkSession.createDataFrame([(p,) for p in PROTOCOL_LABELS], "protocol string")
    return every.join(profiles.groupBy("protocol").agg(F.count(F.lit(1)).alias("n")), "protocol", "left").select("protocol", F.coalesce("n", F.lit(0)).alias("n"))


def _label(column: Column, labels: dict[str, str], other: str) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, column), F.lit(other))


def named_uri() -> Column:
    """original_uri with a readable fragment: type, security, transport and compact code."""
    transport = F.when(F.col("protocol") == "hysteria2", "UDP").otherwise(_label(F.col("transport"), TRANSPORT_LABELS, "TCP"))
    name = F.concat_ws("-", _label(F.col("protocol"), PROTOCOL_LABELS, ""), F.upper("security"), transport, compact_code(F.col("fingerprint")))
    return F.concat(F.substring_index("original_uri", "#", 1), F.lit("#"), name)
