"""BPE encoding by a bounded-lookahead streaming transducer, and incremental decoding.

``sufficient_lookahead`` is computed from the merge list: how far left of the last byte read
the borders between tokens can still change, whatever follows. A border depends on what is to
its right only through a merge of lower rank at a border inside or at the end of the merge's
right half, so the distances add up along chains of falling rank, and one pass over the merges
in rank order gives the longest (after Berglund and van der Merwe, "Formalizing BPE
Tokenization", 2023). For the 50k byte-level list it is 119 bytes.

Encoding keeps the BPE of the bytes read so far: a sequence of tokens that are compatible in
pairs, which is unique. Two tokens are compatible if no merge across their border would have
come before the merges that made them; that is read off the merge list by undoing both edges in
turn. Each step reads the longest token that is compatible with the last, or takes the last one
back where there is none. Whatever lies more than the lookahead behind the end is emitted and
forgotten, so memory is constant however long a pre-token is; at its end the rest follows. Ids of
pre-tokens up to the lookahead are remembered in a cache of bounded size.

Decoding is a state machine from ids to bytes to text: it takes blocks of ids and carries an
incomplete UTF-8 sequence over to the next block; malformed bytes become U+FFFD.

Edge cases: null text encodes as empty; empty text has no ids and decodes to empty text; null
ids decode to empty text. Other columns are not read. Every row is encoded by itself, so ties,
repeated rows, null ids and empty tables need no rule.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.shared import held, slices

#: Fixed value: the pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points below which the same pattern is spelled out for the standard library's engine.
LATIN = 0x250
#: Entries of a worker's caches: pre-tokens in each of two generations (some 45 MB in all), pairs of tokens (20 MB).
CACHE, PAIRS = 150_000, 250_000
#: Characters beyond which a text's pre-tokens are not listed all at once.
LONG = 1 << 20
_FOREVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ranges(category: str) -> str:
    """Code points below LATIN of a general category, as a character class's inside."""
    codes = [c for c in range(LATIN) if unicodedata.category(chr(c))[0] == category]
    return "".join(re.escape(chr(c)) for c in codes)


def pretokenizer():
    """text -> iterable of pre-tokens. Texts of Latin characters take the standard library's engine, which
    is twice as fast with explicit classes; all others take the pattern as it is."""
    letter, number, space = _ranges("L"), _ranges("N"), r"\t-\r \x85\xa0"
    latin = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")
    other, every = re.compile(f"[^\0-{chr(LATIN - 1)}]").search, regex.compile(PATTERN)

    def pretokens(text: str):
        engine = every if other(text) else latin
        return engine.findall(text) if len(text) < LONG else (m.group() for m in engine.finditer(text))

    return pretokens


class Vocabulary:
    """Tokens and merges of a byte-level BPE file (the JSON form of the tokenizers library)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        as_bytes = {t: bytes(letters[c] for c in t) for t in vocab if t not in self.special}
        self.id_of = {b: vocab[t] for t, b in as_bytes.items()}
        self.bytes_of = {i: b for b, i in self.id_of.items()} | {i: t.encode() for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = vocab[left], vocab[right]
            self.rank.setdefault(pair, rank)
            new = vocab[left + right]
            if new not in self.made:
                self.made[new], self.parts[new] = rank, pair
        self.single = np.array([self.id_of[bytes([b])] for b in range(256)], np.int32)
        self.longest = max(map(len, self.id_of))
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pretokens = pretokenizer()

    def pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is it a special token, piece) in order."""
        if self.split_special is None or not any(s in text for s in self.special):
            yield False, text
            return
        for i, piece in enumerate(self.split_special.split(text)):
            if piece:
                yield bool(i % 2), piece


def sufficient_lookahead(v: Vocabulary) -> int:
    """Bytes after which no border between tokens can change any more."""
    rank_of, size, parts, made = v.rank, {i: len(b) for i, b in v.bytes_of.items()}, v.parts, v.made
    reach: dict[int, int] = {}  # by rank: how far left of the end the merge's border can be and still change
    by_left: dict[int, tuple[list[int], list[int]]] = {}  # ranks of a token's merges as left half, and the farthest reach up to each
    inside: dict[int, int] = {}

    def between(token: int, upto: int) -> int:
        """Farthest reach of merges that take the token away after it is made, before ``upto``."""
        ranks, far = by_left.get(token, ((), ()))
        i = bisect_left(ranks, upto)
        return far[i - 1] if i and ranks[i - 1] > made.get(token, -1) else 0

    def edge(token: int, upto: int) -> int:
        """The same for every token along the right edge."""
        far = between(token, upto)
        while token in parts:
            upto, token = made[token], parts[token][1]
            far = max(far, between(token, upto))
        return far

    def within(token: int) -> int:
        """Farthest reach through a border inside the token."""
        if token not in parts:
            return 0
        if token not in inside:
            left, right = parts[token]
            deeper = within(right)
            inside[token] = max(within(left), size[left] + max(reach[made[token]], edge(left, made[token])), size[left] + deeper if deeper else 0)
        return inside[token]

    for (left, right), rank in sorted(rank_of.items(), key=lambda x: x[1]):
        reach[rank] = max(size[right] + edge(right, rank), within(right))
        ranks, far = by_left.setdefault(left, ([], []))
        ranks.append(rank)
        far.append(max(reach[rank], far[-1] if far else 0))
    return max(reach.values(), default=0)


class Transducer:
    """Encoder of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.lookahead = sufficient_lookahead(vocabulary)
        self._fits: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self.tokens = {b: i for b, i in vocabulary.id_of.items() if self._own(i)}
        self.ahead: dict[bytes, int] = {}  # longest token by its first two bytes
        for b in self.tokens:
            self.ahead[b[:2]] = max(self.ahead.get(b[:2], 1), len(b))
        #: by token: the next shorter token that begins it
        self.shorter = {i: next((self.tokens[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.tokens), None) for b, i in self.tokens.items()}

    def _own(self, token: int) -> bool:
        """Is the token the BPE of its own bytes? (Some vocabularies hold tokens that no text gives.)"""
        if token not in self._whole:
            parts = self.v.parts.get(token)
            self._whole[token] = parts is None and len(self.v.bytes_of[token]) == 1 or parts is not None and self._own(parts[0]) and self._own(parts[1]) and self._apart(*parts, self.v.made[token])
        return self._whole[token]

    def _apart(self, a: int, b: int, until: int) -> bool:
        """Does no merge join a's and b's bytes before rank ``until``?"""
        rank, made, parts = self.v.rank, self.v.made, self.v.parts
        end_a = end_b = until
        first = until < _FOREVER
        while True:
            r = rank.get((a, b))
            if r is not None and r < end_a and r <= end_b and not (first and r == until):
                return False
            first = False
            made_a, made_b = made.get(a, -1), made.get(b, -1)
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                end_a, a = made_a, parts[a][1]
            else:
                end_b, b = made_b, parts[b][0]

    def fits(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            known = self._fits[key] = self._apart(a, b, _FOREVER)
        return known

    def stream(self, data: bytes) -> Iterator[int]:
        """Token ids of one pre-token, each once more than the lookahead follows it."""
        tokens, fits, ahead, of, shorter, end = self.tokens, self.fits, self.ahead, self.v.bytes_of, self.shorter, len(data)
        path: list[int] = []  # tokens not emitted yet, the last of which ends at ``at``
        dead: set[int] = set()  # ends of the path from which there is no way on
        at = emitted = 0
        last = token = None
        while at < end or token is not None:
            if token is None:
                stop = min(end, at + ahead.get(data[at : at + 2], 1))
                while (token := tokens.get(data[at:stop])) is None:
                    stop -= 1
            while token is not None and (at + len(of[token]) in dead or last is not None and not fits(last, token)):
                token = shorter[token]
            if token is None:
                if not path:
                    raise ValueError("bytes outside the vocabulary")
                dead.add(at)
                token = path.pop()
                at -= len(of[token])
                last = path[-1] if path else None
                continue
            path.append(token)
            at += len(of[token])
            last, token = token, None
            if len(path) > 4 * self.lookahead:
                n = 0
                while emitted + len(of[path[n]]) < at - self.lookahead:
                    emitted += len(of[path[n]])
                    n += 1
                yield from path[:n]
                del path[:n]
                dead = {x for x in dead if x > emitted}
        yield from path


class _Known(dict):
    """Pre-token to packed ids, in two generations of bounded size."""

    def __init__(self, encoder: Transducer):
        super().__init__()
        self.encoder, self.old = encoder, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        value = self.old.get(piece)
        if value is None:
            data = piece.encode()
            token = self.encoder.tokens.get(data)
            value = token.to_bytes(4, "little") if token is not None else np.fromiter(self.encoder.stream(data), "<u4").tobytes()
        if len(piece) <= self.encoder.lookahead:
            self[piece] = value
        return value


def loaded(spec: str) -> tuple[Vocabulary, _Known]:
    """One vocabulary and its cache for each Python worker."""

    def build() -> tuple[Vocabulary, _Known]:
        vocabulary = Vocabulary(spec)
        return vocabulary, _Known(Transducer(vocabulary))

    return held(("bpe", spec), build)


@lru_cache(maxsize=1)
def token_bytes(spec: str) -> list[bytes]:
    """The bytes of each id, which is all that decoding needs."""
    letters = byte_letters()
    parsed = json.loads(spec)
    special = {t["id"]: t["content"].encode() for t in parsed.get("added_tokens", [])}
    of = {i: special[i] if i in special else bytes(letters[c] for c in t) for t, i in parsed["model"]["vocab"].items()} | special
    return [of.get(i, b"") for i in range(max(of) + 1)]


def encode_text(spec: str, text: str) -> bytes:
    vocabulary, known = loaded(spec)
    out = []
    for special, piece in vocabulary.pieces(text):
        if special:
            out.append(vocabulary.special[piece].to_bytes(4, "little"))
        else:
            out.append(b"".join(map(known.__getitem__, vocabulary.pretokens(piece))))
    return b"".join(out)


def decode_ids(spec: str, packed: bytes, block: int = 65536) -> str:
    of = token_bytes(spec)
    state = codecs.getincrementaldecoder("utf-8")("replace")
    out = [state.decode(b"".join(map(of.__getitem__, np.frombuffer(packed, "<u4", min(block, len(packed) // 4 - at), 4 * at).tolist()))) for at in range(0, len(packed) // 4, block)]
    return "".join([*out, state.decode(b"", True)])


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _encoded(spec: Broadcast):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, keep=True):
            ids = [encode_text(spec.value, t or "") for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return rows


def _decoded(spec: Broadcast):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids", keep=True):
            texts = [decode_ids(spec.value, x or b"") for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return rows


_ENCODED = "doc_id long, n_tokens long, ids binary"


def _sent(docs: DataFrame, tokenizer: str) -> Broadcast:
    """The tokenizer's file as a broadcast, whose size the vocabulary bounds."""
    return docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def bpe_encode(docs: DataFrame, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit). tokenizer: path of a
    byte-level BPE file on the driver."""
    return _own(docs, id_col, text_col).mapInArrow(_encoded(_sent(docs, tokenizer)), _ENCODED)


def bpe_decode(encoded: DataFrame, *, tokenizer: str) -> DataFrame:
    """The rows of bpe_encode with their text: doc_id, n_tokens, ids, text."""
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(_decoded(_sent(encoded, tokenizer)), f"{_ENCODED}, text string")


def bpe_round_trip(docs: DataFrame, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bpe_decode of bpe_encode in one pass, so that a task needs one Python worker, not two."""
    spec = _sent(docs, tokenizer)
    encoded, decoded = _encoded(spec), _decoded(spec)
    return _own(docs, id_col, text_col).mapInArrow(lambda batches: decoded(encoded(batches)), f"{_ENCODED}, text string")
