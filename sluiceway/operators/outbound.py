"""Client outbounds of accepted profiles as JSON, in two dialects.

Each dialect is one struct of all its fields: those that don't apply to a row are null, and
``to_json`` leaves nulls out. A profile that lacks what its outbound can't do without has a null
outbound. Rows need the columns of ``profiles.parse_profiles``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluiceway.operators.profiles import alpn_tokens, given, param


def _given(name: str) -> Column:
    """A parameter that is there and not empty."""
    return F.nullif(param(name), F.lit(""))


def _server_or(name: str) -> Column:
    return F.coalesce(given(name), F.col("server"))


def _object(**fields: Column) -> Column:
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def _extra() -> Column:
    """The parameter ``extra``, if it is a JSON object with fields."""
    parsed = F.try_parse_json(param("extra"))
    shape = F.schema_of_variant(parsed)
    return F.when(shape.startswith("OBJECT<") & (shape != "OBJECT<>"), parsed)


def xray_outbound(tag: Column) -> Column:
    """The first dialect: settings by protocol, and stream settings by security and transport.
    A transport named ``h2`` goes as ``xhttp`` in its mode ``stream-one``."""
    protocol, hy2, vless = F.col("protocol"), F.col("protocol") == "hysteria2", F.col("protocol") == "vless"
    named = F.when(F.col("transport") == "raw", "tcp").otherwise(F.col("transport"))
    kind = F.when(~hy2, named)
    reality = ~hy2 & (F.col("security") == "reality")
    obfuscated = hy2 & (F.lower(param("obfs")) == "salamander")
    hosted = _object(path=param("path", "/"), host=_given("host"))
    multi = (param("mode") == "multi") | (param("multimode") == "true")
    tls = _object(serverName=_server_or("sni"), allowInsecure=F.lit(False), fingerprint=_given("fp"), alpn=F.when(param("alpn") != "", alpn_tokens()))
    user = _object(id=F.col("username"), encryption=param("encryption", "none"), flow=_given("flow"))
    xhttp = _object(
        path=param("path", "/"),
        host=F.when(kind == "h2", _server_or("host")).otherwise(_given("host")),
        mode=F.when(kind == "h2", "stream-one").otherwise(_given("mode")),
        extra=F.when(kind == "xhttp", _extra()),
    )
    stream = _object(
        network=F.when(hy2, "hysteria").when(kind == "h2", "xhttp").otherwise(kind),
        security=F.when(reality, "reality").otherwise("tls"),
        realitySettings=F.when(reality, _object(serverName=_server_or("sni"), fingerprint=_given("fp"), publicKey=_given("pbk"), shortId=param("sid"), spiderX=param("spx"))),
        tlsSettings=F.when(~reality, tls),
        wsSettings=F.when(kind == "ws", _object(path=param("path", "/"), headers=F.when(param("host") != "", _object(Host=param("host"))))),
        grpcSettings=F.when(kind == "grpc", _object(serviceName=param("servicename"), authority=_given("authority"), multiMode=F.when(multi, F.lit(True)))),
        httpupgradeSettings=F.when(kind == "httpupgrade", hosted),
        xhttpSettings=F.when(kind.isin("h2", "xhttp"), xhttp),
        hysteriaSettings=F.when(hy2, _object(version=F.lit(2), auth=F.col("secret"))),
        finalmask=F.when(obfuscated, _object(udp=F.array(_object(type=F.lit("salamander"), settings=_object(password=_given("obfs-password")))))),
    )
    node = {"address": F.col("server"), "port": F.col("port")}
    settings = _object(
        version=F.when(hy2, F.lit(2)),
        address=F.when(hy2, F.col("server")),
        port=F.when(hy2, F.col("port")),
        vnext=F.when(vless, F.array(_object(**node, users=F.array(user)))),
        servers=F.when(protocol == "trojan", F.array(_object(**node, password=F.col("secret")))),
    )
    whole = F.when(vless, F.col("username").isNotNull()).otherwise(F.col("secret").isNotNull())
    whole &= ~reality | (_given("fp").isNotNull() & _given("pbk").isNotNull())
    whole &= ~obfuscated | _given("obfs-password").isNotNull()
    return F.when(protocol.isNotNull() & whole, F.to_json(_object(tag=tag, protocol=F.when(hy2, "hysteria").otherwise(protocol), settings=settings, streamSettings=stream)))


def singbox_outbound(tag: Column) -> Column:
    """The second dialect: one flat object; h2 and xhttp are both its transport ``http``."""
    hy2, vless = F.col("protocol") == "hysteria2", F.col("protocol") == "vless"
    kind, reality = F.when(~hy2, F.col("transport")), F.col("security") == "reality"
    ws = kind.isin("ws", "websocket")
    form = F.when(ws, "ws").when(kind.isin("h2", "xhttp"), "http").when(kind.isin("grpc", "httpupgrade"), kind)
    transport = _object(
        type=form,
        path=F.when(ws | kind.isin("httpupgrade", "xhttp"), param("path", "/")),
        headers=F.when(ws & (param("host") != ""), _object(Host=param("host"))),
        service_name=F.when(kind == "grpc", param("servicename")),
        host=F.when(kind == "h2", F.array(_server_or("host"))),
    )
    tls = _object(
        enabled=F.lit(True),
        server_name=_server_or("sni"),
        insecure=F.lit(False),
        utls=F.when(param("fp") != "", _object(enabled=F.lit(True), fingerprint=param("fp"))),
        reality=F.when(reality, _object(enabled=F.lit(True), public_key=param("pbk"), short_id=param("sid"))),
    )
    obfs = F.coalesce(_given("obfs-password"), _given("obfs"))
    outbound = _object(
        tag=tag,
        server=F.col("server"),
        server_port=F.col("port"),
        type=F.col("protocol"),
        uuid=F.when(vless, F.col("username")),
        password=F.when(~vless, F.col("secret")),
        tls=tls,
        flow=F.when(vless, _given("flow")),
        transport=F.when(form.isNotNull(), transport),
        obfs=F.when(hy2 & obfs.isNotNull(), _object(type=F.lit("salamander"), password=obfs)),
    )
    whole = F.when(vless, F.col("username").isNotNull()).otherwise(F.col("secret").isNotNull())
    whole &= ~reality | given("pbk").isNotNull()
    return F.when(F.col("protocol").isNotNull() & whole, F.to_json(outbound))
