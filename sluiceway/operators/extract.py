"""Text to rows: candidate lines, envelopes, handles, posts and URIs."""

from __future__ import annotations

import base64
import binascii
import html
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from html.parser import HTMLParser
from urllib.parse import parse_qsl, unquote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.functions.uri import BLANKS, computed, strip
from sluiceway.operators.profiles import DEEP_LINK, HANDLE, PUBLIC_LINK

#: Schemes, forms of a handle and of packed text, and what channel pages are marked with.
SCHEMES = "vless|trojan|hy2|hysteria2"
AT_HANDLE = rf"(?U)(?<![\w@])@({HANDLE})(?=$|[\s,;!?()\[\]{{}}])"
PACKED = re.compile(r"[A-Za-z0-9_+/=-]{16,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_+/=-])([A-Za-z0-9_+/=-]{24,})(?![A-Za-z0-9_+/=-])")
MESSAGE = "tgme_widget_message"
TEXT_CLASSES = ("tgme_widget_message_text", "tgme_widget_message_caption", "js-message_text")
TEXT_TAGS = ("pre", "code", "blockquote")
LINK_ATTRIBUTES = ("href", "data-url", "data-href", "data-telegram-url", "data-obfuscated-url", "data-link")
DATE_NAMES = re.compile("date|time", re.IGNORECASE)
ISO = r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:?\d\d)"
UNIX = r"(?<!\d)(\d{10}|\d{13})(?!\d)"
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


#: A line whose host is not what brackets may hold: an open or a closing one alone, text around them,
#: or anything but an IPv6 address (or a future form) inside.
BROKEN = r"^[^:/?#]*:(?://(?:[^/?#]*@)?(?=[^/?#@]*[\[\]])(?!\[(?:[0-9A-Fa-f.]*:[0-9A-Fa-f.:]*(?:%[^\]/?#@]*)?|v[0-9A-Fa-f]+\.[^\]/?#@]+)\](?::[^/?#@]*)?(?:[/?#]|$)))"


def _lines_of(text: Column) -> Column:
    """Supported lines of a text in order, each once."""
    clean = F.replace(F.regexp_replace(text, "^\ufeff", ""), F.lit("\r\n"), F.lit("\n"))
    lines = F.transform(F.split(clean, "\n"), strip)
    return F.array_distinct(F.filter(lines, lambda x: F.translate(x, "\t\r", "").rlike(rf"(?i)^[\x00-\x20]*(?:{SCHEMES}):") & ~x.rlike(BROKEN)))


def candidate_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_idx, line_idx, line: supported lines of a document, each once. Uniqueness is found
    with array functions before the explode, so nothing is shuffled."""
    return docs.select("doc_idx", F.posexplode(_lines_of(F.col(text))).alias("line_idx", "line"))


def decode_envelope(text: Column) -> Column:
    """The text inside one base64 envelope, or null."""
    packed = F.translate(F.translate(text, BLANKS, ""), "-_", "+/")
    bare = F.regexp_replace(packed, "=+$", "")
    padded = F.concat(bare, F.repeat(F.lit("="), F.pmod(-F.length(bare), F.lit(4))))
    fine = bare.rlike("^[A-Za-z0-9+/]+$") & (F.length(bare) % 4 != 1)
    return F.try_validate_utf8(F.when(fine, F.unbase64(padded)).cast("string"))


def document_lines(docs: DataFrame) -> DataFrame:
    """Candidate lines of plain documents, or of the envelope where there are none."""
    direct = computed(docs.select("doc_idx", "text"), _direct=_lines_of(F.col("text")))
    lines = F.when(F.size("_direct") > 0, F.col("_direct")).otherwise(_lines_of(decode_envelope(F.col("text"))))
    return direct.select("doc_idx", F.posexplode(lines).alias("line_idx", "line"))


def _base64_text(value: str) -> str | None:
    """The text in a strict base64 string of either alphabet, or null; what doesn't come out
    the same when packed again is not one."""
    token = value.strip()
    bare = token.rstrip("=")
    if len(token) > 1 << 20 or not PACKED.fullmatch(token) or not bare or "=" in bare:
        return None
    packed = bare.translate(str.maketrans("-_", "+/"))
    try:
        data = base64.b64decode(packed + "=" * (-len(packed) % 4), validate=True)
        return data.decode() if base64.b64encode(data).decode().rstrip("=") == packed else None
    except (binascii.Error, UnicodeDecodeError):
        return None


def _plain(text: str) -> str:
    return html.unescape(unquote(text))


def _inside(text: str) -> Iterator[str | None]:
    """What a text holds one level down: parts of a URL, the whole as base64, base64 tokens."""
    try:
        u = urlsplit(text)
    except ValueError:
        pass
    else:
        queries = [u.query, u.fragment.partition("?")[2]]
        yield from map(_plain, (u.path, u.fragment, u.query, *(v for q in queries for _, v in parse_qsl(q, keep_blank_values=True))))
    yield from map(_base64_text, (text, *TOKEN.findall(text)))


def variants_of(text: str, max_depth: int = 2) -> list[tuple[str, int]]:
    """The text without percent and entity escapes and what is decoded from it, breadth first,
    each once with its depth."""
    seen: dict[str, int] = {}
    level = [_plain(text)]
    for depth in range(max_depth + 1):
        fresh = [v for v in dict.fromkeys(level) if v and v not in seen]
        seen.update(dict.fromkeys(fresh, depth))
        if depth < max_depth:
            level = [x for v in fresh for x in _inside(v)]
    return list(seen.items())


#: What can make a variant more than a piece of its text between the text's own marks: escapes, a
#: fragment, blanks that a URL drops or gets, brackets, and base64.
_MORE = r"[%&#+\[\]\t\n\r]|[A-Za-z0-9_+/=-]{24}"


def decoded_variants(rows: DataFrame, text: str = "text", max_depth: int = 2) -> DataFrame:
    """rows with one row for each variant: ``variant`` and ``depth``. Equal texts are decoded once for
    a batch."""
    keep = [c for c in rows.columns if c != text]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != text) + ", variant string, depth int"

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b[text].dictionary_encode()
            each = [variants_of(t, max_depth) if t else [] for t in texts.dictionary.to_pylist()]
            found = [each[i] if i is not None else [] for i in texts.indices.to_pylist()]
            rows = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
            flat = [v for x in found for v in x]
            yield pa.RecordBatch.from_arrays([*(b[c].take(rows) for c in keep), pa.array([v for v, _ in flat], pa.string()), pa.array([d for _, d in flat], pa.int32())], [*keep, "variant", "depth"])

    return rows.mapInArrow(expand, schema)


def handles_in(text: Column) -> Column:
    """Lower-cased handles that a text names in any of the known forms."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(form), 1) for form in (AT_HANDLE, PUBLIC_LINK, DEEP_LINK)))
    return F.array_distinct(F.transform(found, F.lower))


def extract_handles(docs: DataFrame) -> DataFrame:
    """doc_idx, handle: handles in a text and in what is decoded from it. The variants of most short texts
    are the text and pieces of it that begin after ``:``, ``/``, ``?`` or ``=`` and end at ``?`` or
    with the text. Handles end there too and may begin there, so such a text has all of them
    itself; only the others are decoded."""
    own = docs.select("doc_idx", "text")
    more = F.col("text").rlike(_MORE) | strip(F.col("text")).rlike("^[A-Za-z0-9_+/=-]{16,}$")
    plain = own.filter(~more).select("doc_idx", F.explode(handles_in(F.col("text"))).alias("handle"))
    found = decoded_variants(own.filter(more)).select("doc_idx", F.explode(handles_in(F.col("variant"))).alias("handle"))
    return plain.union(found).distinct()


def preview_url(handle: Column) -> Column:
    """Null for an invalid handle."""
    return F.when(handle.rlike(rf"^{HANDLE}$"), F.concat(F.lit("https://t.me/s/"), F.lower(handle)))


def post_datetime(text: Column) -> Column:
    """A timestamp from ISO text with a zone, or else from 10 or 13 digits of Unix time, alone or
    inside a longer text."""
    iso = F.regexp_extract(text, rf"(\d{{4}}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d)?(?:\.\d+)?(?:Z|[+-]\d\d:?\d\d))", 1)
    digits = F.regexp_extract(text, UNIX, 1)
    seconds = F.when(F.length(digits) == 13, digits.try_cast("bigint") / 1000).when(F.length(digits) == 10, digits.try_cast("bigint"))
    return F.coalesce(F.nullif(iso, F.lit("")).try_cast("timestamp"), F.timestamp_seconds(seconds))


class _Post:
    """One message while its page is read. dates: candidates in order, as lists of pieces;
    texts: (selector, pieces); stack: piece lists that are open, by depth."""

    def __init__(self, a: dict[str, str]):
        self.id = a.get("data-post", "").rpartition("/")[2] if "/" in a.get("data-post", "") else ""
        self.first: str | None = None
        self.dates: list[list[str]] = []
        self.texts: list[tuple[int, list[str]]] = []
        self.all: list[str] = []
        self.hrefs: dict[str, None] = {}
        self.stack: list[tuple[int, list[str]]] = []

    def element(self, tag: str, a: dict[str, str], depth: int | None) -> None:
        """An element that begins here; depth: where it is closed again, null if it can't be."""
        if tag == "time" and self.first is None:
            self.first = a.get("datetime")
        self.dates += [[v] for k, v in a.items() if DATE_NAMES.search(k)]
        if depth is not None and tag in ("time", "script"):
            self.dates.append([])
            self.stack.append((depth, self.dates[-1]))
        self.dates += [[a[k]] for k in ("title", "aria-label") if k in a]
        classes = a.get("class", "").split()
        kinds = [i for i, c in enumerate(TEXT_CLASSES) if c in classes] + [len(TEXT_CLASSES) + i for i, t in enumerate(TEXT_TAGS) if t == tag]
        for kind in kinds if depth is not None else []:
            self.texts.append((kind, []))
            self.stack.append((depth, self.texts[-1][1]))

    def text(self) -> str:
        found = [" ".join(pieces) for _, pieces in sorted(self.texts, key=lambda x: x[0])]
        return " ".join(dict.fromkeys(x for x in found if x)) or " ".join(self.all)

    def date(self) -> datetime | None:
        candidates = [*([self.first] if self.first else []), *(" ".join(x) for x in self.dates)]
        return next((d for x in candidates if (d := _when(x))), None)


class _Posts(HTMLParser):
    """Messages of a channel preview page."""

    def __init__(self) -> None:
        super().__init__()
        self.posts: list[_Post] = []
        self.open: list[str] = []
        self.depth: int | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        closed = None if tag in VOID else len(self.open)
        if closed is not None:
            self.open.append(tag)
        if MESSAGE in a.get("class", "").split():
            self.posts.append(_Post(a))
            self.depth = closed
        elif self.depth is not None:
            self.posts[-1].hrefs |= dict.fromkeys(a[k] for k in LINK_ATTRIBUTES if k in a)
        if self.depth is not None:
            self.posts[-1].element(tag, a, closed)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.open:
            return
        while self.open:
            last = self.open.pop()
            if self.depth is not None:
                post = self.posts[-1]
                post.stack = [x for x in post.stack if x[0] < len(self.open)]
                if len(self.open) <= self.depth:
                    self.depth = None
            if last == tag:
                break

    def handle_data(self, data: str) -> None:
        piece = data.strip()
        if self.depth is not None and piece:
            post = self.posts[-1]
            if "script" not in self.open[self.depth :]:
                post.all.append(piece)
            for _, pieces in post.stack:
                pieces.append(piece)


def _when(text: str) -> datetime | None:
    """The first timestamp of a text: the whole of it, ISO inside it, Unix digits inside it."""
    for found in (text, *re.findall(ISO, text)):
        try:
            at = datetime.fromisoformat(found.replace("Z", "+00:00"))
        except ValueError:
            continue
        if at.tzinfo:
            return at.astimezone(UTC)
    for digits in re.findall(UNIX, text):
        try:
            return datetime.fromtimestamp(int(digits) / (1000 if len(digits) == 13 else 1), UTC)
        except (OverflowError, OSError, ValueError):
            continue
    return None


def parse_posts(pages: DataFrame) -> DataFrame:
    """handle, page_no, pos, message_id, published_at, text, hrefs of all messages that have an
    id of digits, a date and a text."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for handle, page, source in zip(b["handle"], b["page_no"], b["html"], strict=True):
                parser = _Posts()
                parser.feed(source or "")
                for pos, p in enumerate(parser.posts):
                    text, at = p.text(), p.date()
                    if p.id.isdigit() and at and text:
                        rows.append((handle, page, pos, p.id, at.replace(tzinfo=None), text, list(p.hrefs)))
            yield pd.DataFrame(rows, columns=["handle", "page_no", "pos", "message_id", "published_at", "text", "hrefs"])

    return pages.select("handle", "page_no", "html").mapInPandas(parse, "handle string, page_no int, pos int, message_id string, published_at timestamp, text string, hrefs array<string>")


def page_walk(pages: DataFrame, posts: DataFrame, now: Column, max_age_hours: int = 72, max_pages: int = 50) -> tuple[DataFrame, DataFrame]:
    """The walk over a channel's landed pages (handle, page_no, reason): in order, until a page failed
    (has a reason), brings no fresh post that no page before it had, or is the last allowed one.
    Posts are those of the pages, wherever they are parsed. Gives the posts of the walk, and for
    each channel ``available`` (its first page was there), how many pages it read and the page
    where it stopped for want of posts or by failure, null if it ended otherwise."""
    fresh = posts.filter(F.col("published_at") >= now - F.expr(f"INTERVAL {int(max_age_hours)} HOURS"))
    first = Window.partitionBy("handle", "message_id")
    new = fresh.withColumn("_first", F.min("page_no").over(first)).filter(F.col("page_no") == F.col("_first")).drop("_first")
    counts = new.groupBy("handle", "page_no").agg(F.count(F.lit(1)).alias("_n"))
    marked = pages.select("handle", "page_no", F.col("reason").isNotNull().alias("_failed")).join(counts, ["handle", "page_no"], "left")
    order = Window.partitionBy("handle").orderBy("page_no")
    stops = F.col("_failed") | F.col("_n").isNull()
    marked = marked.withColumn("_stop", stops).withColumn("_place", F.row_number().over(order))
    before = F.coalesce(F.bool_or("_stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    read = marked.withColumn("_before", before).filter(~F.col("_before") & (F.col("_place") <= max_pages))
    walked = read.groupBy("handle").agg(F.bool_or((F.col("_place") == 1) & ~F.col("_failed")).alias("available"), F.count_if(~F.col("_failed")).alias("pages_read"), F.min(F.when(F.col("_stop"), F.col("page_no"))).alias("stop_page"))
    kept = new.join(read.filter(~F.col("_stop")).select("handle", "page_no"), ["handle", "page_no"])
    return kept, walked


def page_posts(posts: DataFrame, now: Column, max_age_hours: int = 72, max_pages: int = 50) -> DataFrame:
    """The posts of a walk over the pages that have posts, all of them read."""
    pages = posts.select("handle", "page_no").distinct().withColumn("reason", F.lit(None).cast("string"))
    return page_walk(pages, posts, now, max_age_hours, max_pages)[0]


def extract_uris(posts: DataFrame, generic: bool = False, order: tuple[str, ...] = ("page_no", "pos")) -> DataFrame:
    """handle, ordinal, uri: URIs in texts and links and what is decoded from them, unique in a
    channel without regard to case, the first spelling wins; ordinal: place of its first occurrence,
    posts taken in ``order``. generic: any scheme but web and channel links at the start of a match."""
    pattern = r"(?i)((?!https?://|tg://|telegram://)[a-z][a-z0-9+.-]{1,15}://[^\s<>\"']+)" if generic else rf"(?i)((?:{SCHEMES})://[^\s<>\"']+)"
    pieces = posts.select("handle", *order, F.posexplode(F.concat(F.array("text"), F.coalesce("hrefs", F.array()))).alias("piece", "text"))
    found = decoded_variants(pieces).select("handle", *order, "piece", "depth", F.posexplode(F.regexp_extract_all("variant", F.lit(pattern), 1)).alias("at", "raw"))
    found = found.withColumn("uri", F.regexp_replace("raw", r"[.,;!)\]}\"']+$", "")).filter("uri <> ''")
    place = F.struct(*order, "piece", "depth", "at")
    first = found.groupBy("handle", F.lower("uri").alias("_k")).agg(F.min(F.struct(place.alias("place"), "uri")).alias("f")).select("handle", "f.*")
    return first.withColumn("ordinal", F.row_number().over(Window.partitionBy("handle").orderBy("place"))).select("handle", "ordinal", "uri")
