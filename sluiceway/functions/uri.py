"""Columns that take a connection URI apart (RFC 3986) and decode its pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What Python counts as blank at the ends of a text.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Digits of the compact code, and the UUID form that is accepted.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def strip(text: Column) -> Column:
    """text without blanks of any kind at its ends."""
    return F.btrim(text, F.lit(BLANKS))


def unquote(text: Column, plus: bool = False) -> Column:
    """Percent-decoding; malformed input stays as it is. plus: '+' means a space."""
    guarded = text if plus else F.replace(text, F.lit("+"), F.lit("%2B"))
    return F.when(text.contains("%") | (text.contains("+") if plus else F.lit(False)), F.coalesce(F.try_url_decode(guarded), text)).otherwise(text)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, each computed once for a row however often it is used: the
    optimizer doesn't copy expressions through a generator as it does through projections, and
    doesn't push filters on them below it. It also keeps large steps out of generated code, where
    one method has 64 KB at most."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def _after(text: Column, mark: str) -> Column:
    """What follows the first mark; the whole text where there is none."""
    return F.substring(text, F.instr(text, mark) + 1, F.length(text))


def split_uri(df: DataFrame, uri: Column) -> DataFrame:
    """df with _scheme (lower), _user, _host (lower, null if invalid), _port (null if invalid) and
    _query, in steps of plain string functions, so that no piece is taken out twice."""
    out = computed(df, _base=F.substring_index(uri, "#", 1))
    out = computed(out, _main=F.substring_index("_base", "?", 1), _query=F.when(F.contains("_base", F.lit("?")), _after(F.col("_base"), "?")).otherwise(""))
    out = computed(out, _rest=_after(F.col("_main"), ":"))
    slashes = F.startswith("_rest", F.lit("//"))
    out = computed(out, _scheme=F.when(F.contains("_main", F.lit(":")), F.lower(F.substring_index("_main", ":", 1))).otherwise(""), _netloc=F.when(slashes, F.substring_index(F.expr("substr(_rest, 3)"), "/", 1)).otherwise(""))
    out = computed(out, _hostport=F.substring_index("_netloc", "@", -1))
    user = F.when(F.contains("_netloc", F.lit("@")), F.substring_index(F.expr("substr(_netloc, 1, length(_netloc) - length(_hostport) - 1)"), ":", 1))
    bracketed = F.startswith("_hostport", F.lit("["))
    name = F.when(bracketed, F.regexp_extract("_hostport", r"^\[([^\[\]]*)\](?::[^:\]]*)?$", 1)).when(~F.contains("_hostport", F.lit("[")) & ~F.contains("_hostport", F.lit("]")), F.substring_index("_hostport", ":", 1))
    number = F.when(bracketed, F.regexp_extract("_hostport", r"\]:([0-9]+)$", 1)).when(F.contains("_hostport", F.lit(":")), _after(F.col("_hostport"), ":"))
    out = computed(out, _user=user, _name=F.lower(name), _digits=number)
    out = computed(out, _number=F.when(F.col("_digits").rlike("^[0-9]+$"), F.col("_digits").try_cast("int")))
    out = computed(out, _host=F.when(F.col("_name").rlike(r"^[a-z0-9._:-]+$"), F.col("_name")), _port=F.when(F.col("_number").between(1, 65535), F.col("_number")))
    return out.drop("_base", "_main", "_rest", "_netloc", "_hostport", "_name", "_digits", "_number")


def query_entries(query: Column) -> Column:
    """(k, v) of a query's parameters in order: names lower, values decoded and stripped."""
    pieces = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(p.alias("p"), F.instr(p, "=").alias("at")))
    cut = F.transform(pieces, lambda x: F.struct(F.when(x["at"] > 0, F.substring(x["p"], F.lit(1), x["at"] - 1)).otherwise(x["p"]).alias("k"), F.when(x["at"] > 0, F.substring(x["p"], x["at"] + 1, F.length(x["p"]))).otherwise("").alias("v")))
    return F.transform(cut, lambda x: F.struct(F.lower(unquote(x["k"], True)).alias("k"), strip(unquote(x["v"], True)).alias("v")))


def query_map(entries: str) -> Column:
    """Parameters by name from a column of query_entries; the last of a name wins."""
    entry = F.col(entries)
    names = F.array_distinct(entry["k"])
    last = F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entry, lambda e: e["k"] == n), -1)["v"]))
    return F.when(F.size(names) == F.size(entry), F.map_from_entries(entry)).otherwise(last)


#: A parameter that plain string search can't find by its lower-case name: one whose name has capital
#: letters, escapes or anything beyond visible ASCII, or one without a value.
_UNUSUAL = r"(?:^|&)(?:[^=&]*[^!-$'-*,-<>-@\[-~&=]|[^=&]+(?:&|$))"


def known_parameters(df: DataFrame, query: str, names: list[str], spelled: dict[str, str], wanted: Column) -> DataFrame:
    """df with ``params``: a struct of these parameters of a query, each null where it has none of the
    name, the last of which wins; null for rows that are not wanted. Usual queries are searched with plain string functions; only the others are
    taken apart into a map. ``spelled``: usual spellings with capitals, and their names."""
    plain = F.concat(F.lit("&"), F.col(query))
    for usual, name in spelled.items():
        plain = F.replace(plain, F.lit(f"&{usual}="), F.lit(f"&{name}="))
    out = computed(df, _plain=plain)
    out = computed(out, _usual=~F.col("_plain").rlike(_UNUSUAL.replace("(?:^|&)", "&")))
    out = computed(out, _entries=F.when(~F.col("_usual"), query_entries(F.col(query))))
    out = computed(out, _map=F.when(~F.col("_usual"), query_map("_entries")))

    # what plain search finds, as it stands; most values need neither decoding nor stripping
    found = {f"_raw_{i}": F.when(F.contains("_plain", F.lit(f"&{k}=")), F.substring_index(F.substring_index("_plain", f"&{k}=", -1), "&", 1)) for i, k in enumerate(names)}
    out = computed(out, _bare=~F.col("_plain").rlike(r"[%+]|[^!-~]"), **found)

    def field(i: int, name: str) -> Column:
        raw = F.col(f"_raw_{i}")
        return F.when(F.col("_usual"), F.when(F.col("_bare") | raw.isNull(), raw).otherwise(strip(unquote(raw, True)))).otherwise(F.try_element_at("_map", F.lit(name)))

    return computed(out, params=F.when(wanted, F.struct(*(field(i, k).alias(k) for i, k in enumerate(names))))).drop("_plain", "_usual", "_entries", "_map", "_bare", *found)


def valid_reality_key(key: Column) -> Column:
    """Does the key hold 32 bytes of URL-safe base64? Other characters don't count, but the
    padding that is added is that of the whole length, so a stray one can leave it short."""
    padded = F.concat(F.translate(key, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(key), F.lit(4))))
    return F.coalesce(F.regexp_replace(padded, r"[^A-Za-z0-9+/=]", "").rlike(r"^[A-Za-z0-9+/]{43}="), F.lit(False))


def compact_code(fingerprint: Column) -> Column:
    """Six base-62 digits of the first 64 bits of the fingerprint's own SHA-256."""
    value = F.conv(F.substring(F.sha2(fingerprint, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    digits = []
    for power in range(5, -1, -1):
        place = F.floor((value % F.lit(62**6).cast("decimal(20,0)")) / F.lit(62**power).cast("decimal(20,0)")).cast("long") % 62
        digits.append(F.lit(BASE62).substr((place + 1).cast("int"), F.lit(1)))
    return F.concat(*digits)
