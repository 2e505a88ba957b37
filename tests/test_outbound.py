"""Client outbounds against objects written out by hand."""

import json

from pyspark.sql import functions as F

from sluiceway.operators import outbound, profiles

ID = "0f8fad5b-d9cb-469f-a165-70867728950e"


def _outbounds(spark, lines):
    df = profiles.parse_profiles(spark.createDataFrame(list(enumerate(lines)), "n int, line string"))
    rows = df.select("n", outbound.xray_outbound(F.lit("t")).alias("x"), outbound.singbox_outbound(F.lit("t")).alias("s")).orderBy("n").collect()
    return [tuple(json.loads(v) if v else None for v in (r.x, r.s)) for r in rows]


def test_transports_and_options(spark):
    lines = [
        f"vless://{ID}@h.example:8443?security=tls&type=ws&host=front.example&alpn=h2,%20,h3&sni=",
        f"vless://{ID}@h.example:8443?security=reality&pbk=k&fp=ios&type=raw",
        f"vless://{ID}@h.example:8443?type=xhttp&extra=%7B%7D&mode=packet-up",
        f"vless://{ID}@h.example:8443?type=xhttp&extra=%5B1%5D&host=a.example",
        "trojan://key@h.example:8443?type=grpc&authority=au&multimode=true&servicename=svc",
        "hy2://key@h.example:8443?obfs=salamander&obfs-password=veil&fp=edge",
        "hy2://key@h.example:8443?obfs=plain",
    ]
    (ws, ws2), (raw, raw2), (x1, _), (x2, x3), (grpc, grpc2), (hy, hy2), (_, plain) = _outbounds(spark, lines)
    assert ws["streamSettings"] == {
        "network": "ws",
        "security": "tls",
        "tlsSettings": {"serverName": "", "allowInsecure": False, "alpn": ["h2", "h3"]},
        "wsSettings": {"path": "/", "headers": {"Host": "front.example"}},
    }
    assert ws2["transport"] == {"type": "ws", "path": "/", "headers": {"Host": "front.example"}}
    assert raw["streamSettings"]["network"] == "tcp" and "transport" not in raw2
    assert raw["streamSettings"]["realitySettings"] == {"serverName": "h.example", "fingerprint": "ios", "publicKey": "k", "shortId": "", "spiderX": ""}
    assert x1["streamSettings"]["xhttpSettings"] == {"path": "/", "mode": "packet-up"}
    assert x2["streamSettings"]["xhttpSettings"] == {"path": "/", "host": "a.example"} and x3["transport"] == {"type": "http", "path": "/"}
    assert grpc["streamSettings"]["grpcSettings"] == {"serviceName": "svc", "authority": "au", "multiMode": True}
    assert grpc["settings"] == {"servers": [{"address": "h.example", "port": 8443, "password": "key"}]} and grpc2["transport"] == {"type": "grpc", "service_name": "svc"}
    assert hy["protocol"] == "hysteria" and hy["settings"] == {"version": 2, "address": "h.example", "port": 8443}
    assert hy["streamSettings"]["finalmask"]["udp"][0]["settings"] == {"password": "veil"} and hy2["obfs"]["password"] == "veil"
    assert plain["obfs"] == {"type": "salamander", "password": "plain"}


def test_what_an_outbound_needs(spark):
    lines = [
        "vless://nobody@h.example:8443?security=tls",
        f"vless://{ID}@h.example:8443?security=reality&fp=ios",
        "trojan://@h.example:8443?security=tls",
        "hy2://key@h.example:8443?obfs=salamander",
        "no profile at all",
    ]
    got = _outbounds(spark, lines)
    assert [x for x, _ in got] == [None] * 5
    assert [s is None for _, s in got] == [True, True, True, False, True]
