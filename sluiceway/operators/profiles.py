"""URI lines to profiles, and the ordered checks that accept a profile or name one reason.

A null ``reason`` means accepted. All checks are one CASE chain each: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.uri import UUID, computed, known_parameters, split_uri, strip, unquote, valid_reality_key

#: Fixed values of the checks.
TRANSPORTS = ["tcp", "raw", "ws", "websocket", "grpc", "h2", "httpupgrade", "xhttp", "udp"]
FINGERPRINTS = ["chrome", "firefox", "safari", "ios", "android", "edge", "360", "qq", "random", "randomized"]
ALPN = ["h2", "http/1.1", "h3"]
XHTTP_MODES = ["auto", "packet-up", "stream-up", "stream-one"]
GRPC_MODES = ["gun", "multi"]
FLOWS = ["xtls-rprx-vision"]
DOMAIN = r"^(?!-)[A-Za-z0-9-]{1,63}(?<!-)(\.(?!-)[A-Za-z0-9-]{1,63}(?<!-))+$"
PORTS = r"^\d{1,5}(-\d{1,5})?(,\d{1,5}(-\d{1,5})?)*$"
HANDLE = r"[A-Za-z][A-Za-z0-9_]{4,31}"
PUBLIC_LINK = rf"(?iU)(?<![\w.])(?:https?://)?(?:t\.me/(?:s/)?|telegram\.me/|telegram\.dog/(?:s/)?|telesco\.pe/)(?!(?:joinchat|c)(?:[/?#\s]|$)|\+)({HANDLE})(?=$|[/?#\s,;!])"
DEEP_LINK = rf"(?iU)(?:tg|telegram)://resolve\?[^\s#]*\bdomain=({HANDLE})(?=$|[&#\s])"
#: Parameters that checks, identities and outbounds read, and spellings that are usual for some.
PARAMS = ["allowinsecure", "insecure", "sni", "fp", "encryption", "pbk", "alpn", "path", "mode", "sid", "spx", "mport", "ports", "obfs", "obfs-password", "flow"]
PARAMS += ["type", "security", "host", "servicename", "authority", "multimode", "extra"]
SPELLED = {"allowInsecure": "allowinsecure", "serviceName": "servicename", "multiMode": "multimode"}


def given(name: str) -> Column:
    """A parameter, null where the URI has none of that name."""
    return F.col("params").getField(name)


def param(name: str, default: str = "") -> Column:
    return F.coalesce(given(name), F.lit(default))


def parse_profiles(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds protocol, server, port, username, secret, security, transport, params (a struct of
    PARAMS) and original_uri; all null where the line is no profile."""
    out = split_uri(lines, F.translate(F.col(line), "\t\n\r", ""))
    clean = ~F.col(line).rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")
    supported = F.when(F.col("_scheme") == "hy2", "hysteria2").when(F.col("_scheme").isin("vless", "trojan", "hysteria2"), F.col("_scheme"))
    out = computed(out, protocol=F.when(F.col("_host").isNotNull() & F.col("_port").isNotNull() & clean, supported))
    out = known_parameters(out, "_query", PARAMS, SPELLED, F.col("protocol").isNotNull())
    out = computed(out, _name=unquote(F.coalesce("_user", F.lit(""))))
    vless = F.col("protocol") == "vless"
    out = computed(out, _named=F.when(vless, F.lower(strip(F.col("_name")))), _type=F.lower(strip(param("type", "tcp"))))
    fields = {
        "server": F.col("_host"),
        "port": F.col("_port"),
        "username": F.when(vless & F.col("_named").rlike(UUID), F.col("_named")),
        "secret": F.when(~vless & (F.col("_name") != ""), F.col("_name")),
        "security": F.lower(strip(F.coalesce(given("security"), F.when(vless, "none").otherwise("tls")))),
        "transport": F.when(F.col("protocol") == "hysteria2", "udp").when(F.col("_type") == "", "tcp").otherwise(F.col("_type")),
        "original_uri": F.substring_index(F.col(line), "#", 1),
    }
    out = computed(out, **{k: F.when(F.col("protocol").isNotNull(), v) for k, v in fields.items()})
    return out.drop("_scheme", "_user", "_host", "_port", "_query", "_name", "_named", "_type")


def insecure_flag() -> Column:
    return F.lower(param("allowinsecure")).isin("1", "true", "yes") | F.lower(param("insecure")).isin("1", "true", "yes")


def strict_policy() -> Column:
    """The first of the strict security checks that a profile fails."""
    vless, trojan, hy2 = (F.col("protocol") == x for x in ("vless", "trojan", "hysteria2"))
    no_sni, no_fp = param("sni") == "", param("fp") == ""
    reality, tls = F.col("security") == "reality", F.col("security") == "tls"
    return (
        F.when(insecure_flag(), "insecure_flag")
        .when(~F.col("transport").isin(TRANSPORTS), "unsupported_transport")
        .when(vless & (F.col("username").isNull() | (F.lower(param("encryption")) != "none")), "missing_required_secret")
        .when(~vless & F.col("secret").isNull(), "missing_required_secret")
        .when((vless & ~reality & ~tls) | (~vless & ~tls), "missing_security")
        .when(no_sni, "missing_sni")
        .when((vless | trojan) & no_fp, "missing_fingerprint")
        .when(vless & reality & ~valid_reality_key(param("pbk")), "invalid_reality_key")
        .when(~(vless | trojan | hy2), "unsupported_protocol")
    )


def alpn_tokens() -> Column:
    return F.filter(F.transform(F.split(param("alpn"), ","), strip), lambda t: t != "")


def deep_analysis() -> Column:
    """The first of the client compatibility checks that a profile fails."""
    trimmed = lambda name: strip(param(name))
    low = lambda name: F.lower(trimmed(name))
    transport, hy2, vless = F.col("transport"), F.col("protocol") == "hysteria2", F.col("protocol") == "vless"
    reality = F.col("security") == "reality"
    sni = strip(F.coalesce(given("sni"), F.col("server")))
    ports = strip(F.when(param("mport") != "", param("mport")).otherwise(param("ports")))
    obfs, flow = low("obfs"), low("flow")
    return (
        F.when((low("fp") != "") & ~low("fp").isin(FINGERPRINTS), "unknown_fingerprint")
        .when(F.exists(alpn_tokens(), lambda t: ~F.lower(t).isin(ALPN)), "invalid_alpn")
        .when(transport.isin("ws", "websocket") & (param("path", "/") != "") & ~param("path", "/").startswith("/"), "invalid_ws_path")
        .when((transport == "grpc") & (low("mode") != "") & ~low("mode").isin(GRPC_MODES), "invalid_grpc_mode")
        .when((transport == "xhttp") & (low("mode") != "") & ~low("mode").isin(XHTTP_MODES), "invalid_xhttp_mode")
        .when(reality & ~trimmed("sid").rlike("^[0-9a-fA-F]{0,16}$"), "invalid_short_id")
        .when(reality & (trimmed("spx") != "") & ~trimmed("spx").startswith("/"), "invalid_spider_x")
        .when(reality & ~(sni.rlike(DOMAIN) & sni.rlike("[A-Za-z]")), "invalid_reality_sni")
        .when(hy2 & ~obfs.isin("", "none", "salamander"), "unsupported_obfs")
        .when(hy2 & (obfs == "salamander") & (param("obfs-password") == ""), "missing_obfs_password")
        .when(hy2 & (ports != "") & ~ports.rlike(PORTS), "invalid_port_range")
        .when(vless & (flow != "") & ~flow.isin(FLOWS), "unsupported_flow")
        .when(vless & (flow != "") & (~transport.isin("tcp", "raw") | ~F.col("security").isin("tls", "reality")), "incompatible_flow")
    )


def channel_pointer(rows: DataFrame, uri: str) -> DataFrame:
    """rows with ``pointer``: the channel that the URI's fragment only points to, or null. A
    fragment that begins with @ is a handle as a whole or nothing; others hold a link."""
    out = computed(rows, _raw=F.when(F.instr(F.col(uri), "#") > 0, F.expr(f"substr(`{uri}`, instr(`{uri}`, '#') + 1)")))
    out = computed(out, _text=strip(unquote(F.col("_raw"))))
    linked = F.contains(F.lower("_text"), F.lit("t")) & F.contains("_text", F.lit("/"))
    out = computed(out, _public=F.when(linked, F.regexp_extract("_text", PUBLIC_LINK, 1)), _deep=F.when(linked, F.regexp_extract("_text", DEEP_LINK, 1)))
    named = F.when(F.col("_text").rlike(rf"^@{HANDLE}$"), F.expr("substr(_text, 2)"))
    found = F.when(F.startswith("_text", F.lit("@")), named).when(F.col("_public") != "", F.col("_public")).when(F.col("_deep") != "", F.col("_deep"))
    return computed(out, pointer=F.lower(found)).drop("_raw", "_text", "_public", "_deep")


def static_filter(lines: DataFrame, pointers: bool = True) -> DataFrame:
    """Parsed profiles with ``reason`` and ``parsed``. Pointers come first and count as parsed;
    without ``pointers`` it is the filter for URIs found in channels."""
    out = parse_profiles(channel_pointer(lines, "line") if pointers else lines)
    pointer = F.col("pointer").isNotNull() if pointers else F.lit(False)
    no = F.col("protocol").isNull()
    reason = F.when(pointer, "telegram_channel_reference").when(no, "invalid_or_unsupported").otherwise(F.coalesce(strict_policy(), deep_analysis()))
    return computed(out, parsed=pointer | ~no, reason=reason).drop("pointer")


def tally(filtered: DataFrame) -> DataFrame:
    """parsed, reason and n: the few rows that both counts below can be had from, if n is their column of weights."""
    return filtered.groupBy("parsed", "reason").agg(F.count(F.lit(1)).alias("n"))


def exclusion_counts(filtered: DataFrame, weight: Column | None = None) -> DataFrame:
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return filtered.filter("reason is not null").groupBy("reason").agg(n.alias("n"))


def filter_counts(filtered: DataFrame, weight: Column | None = None) -> DataFrame:
    weight = F.lit(1).cast("long") if weight is None else weight
    kinds = {"candidate_lines": F.lit(True), "parsed": F.col("parsed"), "accepted": F.col("reason").isNull()}
    return filtered.agg(*(F.coalesce(F.sum(F.when(kind, weight)), F.lit(0).cast("long")).alias(k) for k, kind in kinds.items()))
