"""URI lines to reasons, identities and names."""

from pyspark.sql import functions as F

from sluiceway.functions.uri import compact_code
from sluiceway.operators import identity, profiles

UUID = "123e4567-e89b-12d3-a456-426614174000"
TROJAN = "trojan://correct-horse@node.example.org:443?security=tls&sni=www.example.com&fp=chrome&type=tcp"
HY2 = "hy2://hy2-password@hy2.example.org:443?sni=www.example.com"


def _vless(security="tls", **params):
    """A VLESS line of this test's own host, with parameters set or (None) left out."""
    base = {"encryption": "none", "security": security, "sni": "cdn.shop.example", "fp": "safari"} | ({"pbk": "b" * 43} if security == "reality" else {})
    return "vless://0f1e2d3c-4b5a-4978-8796-a5b4c3d2e1f0@[2001:db8::7]:2053?" + "&".join(f"{k}={v}" for k, v in (base | params).items() if v is not None)


def _password(scheme, **params):
    base = {"sni": "cdn.shop.example"} | ({"security": "tls", "fp": "ios"} if scheme == "trojan" else {})
    return f"{scheme}://k%40y@h-1.shop.example:8443?" + "&".join(f"{k}={v}" for k, v in (base | params).items() if v is not None)


#: For each reason lines on both sides of its boundary: what fails, and the nearest that doesn't.
BOUNDARIES = {
    "missing_required_secret": ([_vless(encryption="aes"), _vless().replace("0f1e2d3c", "0f1e2d3"), _password("trojan").replace("k%40y", "")], [_vless(encryption="NONE")]),
    "insecure_flag": ([_password("hysteria2", insecure="TRUE"), _vless(allowInsecure="yes")], [_vless(allowInsecure="0"), _password("hysteria2", insecure="no")]),
    "unsupported_transport": ([_vless(type="quic")], [_vless(type="RAW"), _vless(type="h2"), _vless(type="")]),
    "missing_security": ([_vless("none"), _vless(None), _password("trojan", security="reality")], [_password("trojan", security=None)]),
    "missing_sni": ([_vless(sni=None), _password("hy2", sni="%20")], []),
    "missing_fingerprint": ([_vless(fp=""), _password("trojan", fp=None)], [_password("hy2")]),
    "invalid_reality_key": ([_vless("reality", pbk="b" * 42), _vless("reality", pbk="b" * 43 + "~"), _vless("reality", pbk=None)], [_vless("reality"), _vless("reality", pbk="-_" * 21 + "b%3D"), _vless("reality", pbk="b" * 43 + "~~")]),
    "unknown_fingerprint": ([_vless(fp="opera")], [_vless(fp="RANDOMIZED"), _vless(fp="chrome%0A"), _vless(fp="%C2%A0edge%09")]),
    "invalid_alpn": ([_password("trojan", alpn="h2,,h4")], [_password("trojan", alpn="H2,%20h3")]),
    "invalid_ws_path": ([_vless(type="websocket", path="a%2Fb")], [_vless(type="ws", path="%2F"), _vless(type="ws")]),
    "invalid_grpc_mode": ([_vless(type="grpc", mode="auto")], [_vless(type="grpc", mode="Multi")]),
    "invalid_xhttp_mode": ([_vless(type="xhttp", mode="gun")], [_vless(type="xhttp", mode="packet-up")]),
    "invalid_short_id": ([_vless("reality", sid="0" * 17), _vless("reality", sid="0g")], [_vless("reality", sid="F" * 16)]),
    "invalid_spider_x": ([_vless("reality", spx="a")], [_vless("reality", spx="%2Fa")]),
    "invalid_reality_sni": ([_vless("reality", sni="203.0.113.9"), _vless("reality", sni="-a.example"), _vless("reality", sni="single")], [_vless("reality", sni="9.a")]),
    "unsupported_obfs": ([_password("hy2", obfs="xor")], [_password("hy2", obfs="None")]),
    "missing_obfs_password": ([_password("hy2", obfs="Salamander")], [_password("hy2", **{"obfs": "salamander", "obfs-password": "p"})]),
    "invalid_port_range": ([_password("hy2", ports="5000-"), _password("hy2", mport="123456")], [_password("hy2", ports="5000-5010,7")]),
    "unsupported_flow": ([_vless(flow="vision")], [_vless(flow="xtls-rprx-vision")]),
    "incompatible_flow": ([_vless(flow="xtls-rprx-vision", type="grpc")], [_vless("reality", flow="xtls-rprx-vision", type="raw")]),
    "telegram_channel_reference": (
        [_vless() + x for x in ("#%09@Five5", "#%0A%40Five5%20", "#%40Five5", "#go%20t.me/s/Five5?x", "#telegram://resolve?a=1&domain=Five5", "#telesco.pe/Five5,")],
        [_vless() + x for x in ("#@four", "#@Five5 x", "#t.me/joinchat/abcdef", "#t.me/Five5-x", "#at.me/Five5", "#name")],
    ),
    "invalid_or_unsupported": (["", "vmess://abc", _vless().replace("2053", "65536"), _vless().replace("]", ""), _vless().replace("[2001:db8::7]", "bad host")], [_vless().replace("2053", "65535")]),
}
REASONS = [(x, reason if i == 0 else None) for reason, sides in BOUNDARIES.items() for i, side in enumerate(sides) for x in side]


def _frame(spark, lines):
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")


def _prints(spark, lines):
    out = profiles.parse_profiles(_frame(spark, lines)).select("i", identity.fingerprint().alias("f"))
    return [r["f"] for r in out.orderBy("i").collect()]


def test_reasons(spark):
    got = profiles.static_filter(_frame(spark, [x for x, _ in REASONS])).orderBy("i").select("reason").collect()
    assert [(x, r["reason"]) for (x, _), r in zip(REASONS, got, strict=True)] == REASONS


def test_fields(spark):
    row = profiles.parse_profiles(_frame(spark, ["trojan://a%20b+c:rest@Node.Example.org:8443?SNI=x&sni=y+z&type=#n"])).first()
    assert (row.secret, row.server, row.port, row.params["sni"], row.transport, row.original_uri) == ("a b+c", "node.example.org", 8443, "y z", "tcp", "trojan://a%20b+c:rest@Node.Example.org:8443?SNI=x&sni=y+z&type=")


def test_parameters(spark):
    """Names of any spelling and escape, the last of a name, names without a value."""
    queries = {
        "SNI=a&sni=b": ("b", None), "sni=b&SNI=a": ("a", None), "sni=a&sni": ("", None), "%73ni=x%09&serviceName=y": ("x", "y"), "sni=a%09&ServiceName=z+z": ("a", "z z"),
        "xsni=1&sni2=2": (None, None), "&&sni=%20%C3%A9%20&&": ("é", None), "s+ni=1": (None, None), "sni==": ("=", None), "sni=a&servicename=b&serviceName=c": ("a", "c"), "": (None, None),
    }
    lines = [f"trojan://p@h.example:1?{q}" for q in queries]
    rows = profiles.parse_profiles(_frame(spark, lines)).orderBy("i").collect()
    assert [(r.params.sni, r.params.servicename) for r in rows] == list(queries.values())
    sni = _prints(spark, [TROJAN + "&sni=a%09", TROJAN + "&sni=a", TROJAN + "&sni=%C2%A0a"])
    assert len(set(sni)) == 1


def test_golden_identities(spark):
    grpc = f"vless://{UUID}@edge.example.org:443?encryption=none&security=tls&sni=www.example.com&fp=chrome&type=grpc"
    want = {
        TROJAN: ("4f29776c474d988f45254b13c15c51be75af58ba3a65cf83ce595f8b280c443c", "yyM0Cp"),
        grpc: ("241d4da4cb6d267498fe505ebb004c23f5aebdb1e7e267096074068d5017de87", "5TZKpy"),
        HY2: ("bd5059926bb5460aff017bc7038834578e503f343f8ea744d5f3cac4175b6cd5", "KvscUY"),
    }
    assert _prints(spark, list(want)) == [f for f, _ in want.values()]
    codes = spark.createDataFrame([(f,) for f, _ in want.values()], "f string").select(compact_code(F.col("f")).alias("c"))
    assert [r["c"] for r in codes.collect()] == [c for _, c in want.values()]


def test_equal_and_unequal(spark):
    ws = TROJAN + "&type=ws&path=%2Fa"
    a = _prints(spark, [ws, ws.replace("type=ws", "type=websocket"), TROJAN + "&vendor-tag=1#x", TROJAN.replace("&type=tcp", ""), TROJAN + "&sni=other.example.com", TROJAN])
    assert a[0] == a[1] and a[2] == a[3] == a[5] and len(set(a)) == 3


def test_escapes_beyond_ascii(spark):
    import hashlib
    import json

    row = profiles.parse_profiles(_frame(spark, [TROJAN + "&sni=%C3%A9%F0%9F%98%80"])).select(identity.canonical_material().alias("m")).first()
    assert row.m == json.dumps(json.loads(row.m), sort_keys=True, separators=(",", ":"), ensure_ascii=True)
    assert hashlib.sha256(row.m.encode()).hexdigest() and "\\u00e9\\ud83d\\ude00" in row.m


def test_keep_first_does_not_depend_on_partitions(spark):
    rows = spark.range(1000).selectExpr("id", "id % 37 as k")
    want = {(i, i) for i in range(37)}
    for n in (1, 7, 64):
        assert {tuple(r) for r in identity.keep_first(rows.repartition(n), ["k"], ["id"]).collect()} == want


def test_unique_profiles_equal_keep_first(spark):
    """Late look-up gives what keeping whole rows does, also where lines share their ordinals."""
    lines = [TROJAN + f"&sni=h{i % 5}.example#{i}" for i in range(40)] + ["junk", HY2, _vless(fp="opera"), _vless()]
    df = spark.createDataFrame([(i // 3, (i % 3) // 2, x) for i, x in enumerate(lines)], "doc_idx long, line_idx int, line string").repartition(4)
    df = df.union(df.filter("doc_idx = 0"))  # the same lines once more
    columns = ["fingerprint", "doc_idx", "line_idx", "server", "original_uri"]
    found = identity.accepted_profiles(df).select(columns)
    want = identity.keep_first(found, ["fingerprint"], ["doc_idx", "line_idx"])
    got = identity.unique_profiles(df).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 7
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_keep_first_packs_ordinals(spark):
    big = 9_000_000_000_000_000_000
    rows = [("a", big, 7), ("a", big, 3), ("a", big + 1, 0), ("b", 0, 2_000_000_000), ("b", 1, 0), (None, 4, 4)]
    df = spark.createDataFrame(rows, "k string, doc_idx long, line_idx int")
    assert {tuple(r) for r in identity.keep_first(df, ["k"], ["doc_idx", "line_idx"]).collect()} == {("a", big, 3), ("b", 0, 2_000_000_000), (None, 4, 4)}
