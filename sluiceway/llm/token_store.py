"""Token-id files: one concatenated id array with Elias-Fano encoded document boundaries.

A shard holds consecutive documents in ascending id order: their ids end to end as unsigned
16-bit (or 32-bit, for larger vocabularies) integers, and the n + 1 boundaries as an
Elias-Fano sequence: the low bits of each boundary packed side by side, the high bits in
unary in a bit vector. ``select`` finds boundaries from the places of every 512th one, looking
into the blocks asked for alone, so no 64-bit offset table is stored: the boundaries take about
2 + log2(ids per document) bits each. All offsets that are read back come from ``select``.

Shards are rows of a Parquet folder with binary columns, so Spark's committers write them
(a lost executor's part is written again) and any store that Spark reaches can hold them.
Order comes from range partitioning by id; only one row of totals for each shard is summed up
to give each shard's place in the whole.

Edge cases: null and empty texts give a document that is only the end id. Rows with a null id
come first; rows with one id keep an order among themselves by text. A very long text is one
document of a shard like any other, which is full with it. An empty table gives an empty folder
and no rows. Only the id and text columns are read. Texts are cut at white space
and pieces remembered only after a test that the tokenizer's pre-tokens end there; under any
other tokenizer whole texts are encoded.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluiceway.llm import words as W
from sluiceway.llm.bpe import read_spec
from sluiceway.llm.shared import SLICE_ROWS, Scratch, held, slices

#: Ones between two kept counts in the high bits.
BLOCK = 512
#: Pieces whose ids a worker remembers, and bytes of them with their ids: the half used last stays where they grow beyond.
CACHE, CACHE_BYTES = 1_000_000, 64 << 20
#: Text bytes that are encoded together: a piece is looked up once in all of them.
ENCODED_BYTES = 2 << 20
#: Text bytes of a range partition, where that makes more of them than the session's number.
PART_BYTES = 64 << 20
#: Starts of shards that are broadcast (8 MB of rows, for a billion documents); more of them are joined.
SENT_STARTS = 250_000
#: Packed ids at which a shard is full before it has its documents.
SHARD_BYTES = 16 << 20
#: Punctuation that may end a word: its ids are looked up apart from the word's.
TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Texts that may compose or hold special strings.
MARKED = r"<\||[^\x00-\x{02ff}]"
SHARD = "part int, block int, n_docs long, n_ids long, width int, doc_ids binary, ids binary, low_bits int, low binary, high binary, marks binary"


class EliasFano:
    """A non-decreasing sequence of integers in about 2 + log2(last / n) bits each."""

    def __init__(self, low_bits: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray):
        self.low_bits, self.low, self.high, self.marks = low_bits, low, high, marks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n, last = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (last // max(n, 1)).bit_length() - 1)
        v = values.astype(np.uint64)
        low = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(low_bits, np.packbits(low.astype(np.uint8).ravel()), np.packbits(high), ones[::BLOCK].astype(np.uint32))

    def select(self, i: int | np.ndarray) -> int | np.ndarray:
        """Values at one place or at many: the place of the i-th one in the high bits gives the
        high part. Only the blocks that hold them are looked into."""
        if np.isscalar(i):
            return int(self.select(np.array([i]))[0])
        i = np.asarray(i, np.int64)
        place = np.zeros(len(i), np.int64)
        block = i // BLOCK
        for b in np.unique(block).tolist():
            begin = int(self.marks[b])
            stop = int(self.marks[b + 1]) if b + 1 < len(self.marks) else 8 * len(self.high)
            ones = np.flatnonzero(np.unpackbits(self.high[begin // 8 : (stop + 7) // 8])[begin % 8 :])
            own = block == b
            place[own] = begin + ones[i[own] - b * BLOCK]
        bit = (i[:, None] * self.low_bits + np.arange(self.low_bits)).ravel()
        low = (self.low[bit // 8] >> (7 - bit % 8).astype(np.uint8) & 1).reshape(len(i), self.low_bits).astype(np.int64)
        return (place - i) << self.low_bits | low @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def values(self, n: int) -> np.ndarray:
        """The first n values."""
        return self.select(np.arange(n))


class _Pieces:
    """Ids of white-space separated pieces: an Arrow array of pieces, their ids end to end with
    their edges, and when each was used last; bounded size. Pieces are found by sorted hashes
    and then compared. ``apart``: do white space and TAIL after a word end a pre-token?"""

    def __init__(self, spec: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.text, self.ids, self.edges = pa.array([""], pa.large_string()), np.zeros(0, dtype), np.zeros(2, np.int64)
        self.used, self.now = np.zeros(1, np.int64), 0
        self.hash, self.key, self.place = (np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64))
        self._sort()
        self.tokenizer, self.dtype = Tokenizer.from_str(spec), dtype
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.lower = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("AbZ") == "abz"
        whole = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.apart = whole(" ab\n12 , \tab.. cd  ") == [i for p in ("ab", "12", ",", "ab..", "cd") for i in whole(p)]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(self.tokenizer.get_vocab_size(True) + 1, bool)
        if suffix and self.apart and all(whole(f"ab{c}{c}") == whole("ab") + whole(c + c) for c in TAIL.decode()):
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.words_end = bool(self.last.any())

    def of(self, pieces: pa.Array) -> np.ndarray:
        """Places of distinct pieces among those known."""
        self._forget()
        self.now += 1
        at = self._places(pieces)
        new = at < 0
        if new.any():
            at[new] = self._learn(pieces.filter(pa.array(new)))
            self._sort()
        self.used[at] = self.now
        return at

    def laid_out(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces at places, end to end, and how many each has."""
        n = self.edges[at + 1] - self.edges[at]
        stop = np.cumsum(n)
        place = np.repeat(self.edges[at] - stop + n, n)
        place += np.arange(len(place))
        return self.ids.take(place, mode="clip") if len(place) else self.ids[:0], n

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Places of pieces among those known, or -1."""
        h = _hashes(pieces)
        order = np.argsort(h)
        at = np.empty(len(h), np.int64)
        at[order] = self.place[np.minimum(np.searchsorted(self.key, h[order]), len(self.key) - 1)]
        same = self.hash[at] == h
        same[same] = np.asarray(pc.equal(self.text.take(pa.array(at[same])), pieces.filter(pa.array(same))))
        return np.where(same, at, -1)

    def _sort(self) -> None:
        """The hashes of all pieces in order: those added since come as a second sorted run."""
        new = _hashes(self.text.slice(len(self.hash)))
        order = np.argsort(new)
        key, place = np.concatenate([self.key, new[order]]), np.concatenate([self.place, len(self.hash) + order])
        self.hash = np.concatenate([self.hash, new])
        order = np.argsort(key, kind="stable")
        self.key, self.place = key[order], place[order]

    def _forget(self) -> None:
        size = np.asarray(pc.binary_length(self.text)) + np.diff(self.edges) * self.ids.itemsize
        if len(size) <= CACHE and size.sum() <= CACHE_BYTES:
            return
        order = np.argsort(-self.used[1:], kind="stable") + 1
        stay = (np.arange(len(order)) < CACHE // 2) & (np.cumsum(size[order]) <= CACHE_BYTES // 2)
        at = np.r_[0, np.sort(order[stay])]  # the empty piece stays the first
        self.ids, n = self.laid_out(at)
        self.text, self.edges, self.used, self.hash = self.text.take(pa.array(at)), np.r_[0, np.cumsum(n)], self.used[at], self.hash[at]
        self.place = np.argsort(self.hash)
        self.key = self.hash[self.place]

    def _add(self, pieces: pa.Array, ids: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        begin = len(self.text)
        self.text = pa.concat_arrays([self.text, pieces])
        self.edges = np.concatenate([self.edges, self.edges[-1] + np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))])
        self.ids = np.concatenate([self.ids, *ids])
        self.used = np.concatenate([self.used, np.full(len(pieces), self.now)])
        return np.arange(begin, len(self.text))

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Places of pieces that are new and distinct."""
        if not self.words_end:
            return self._by_offsets(pieces)
        core = pc.ascii_rtrim(pieces, characters=TAIL.decode())
        letters = pc.ascii_is_alpha(core).to_numpy(zero_copy_only=False)
        other = np.flatnonzero(~pc.string_is_ascii(core).to_numpy(zero_copy_only=False))
        letters[other] = [c.lower().isalpha() for c in core.take(pa.array(other)).to_pylist()]
        size = np.asarray(pc.binary_length(core))
        short = letters & (size < np.asarray(pc.binary_length(pieces)))
        at = np.zeros(len(pieces), np.int64)
        at[~letters] = self._by_offsets(pieces.filter(pa.array(~letters)))
        cut = [p[n:].decode() for p, n in zip(_bytes(pieces.filter(pa.array(short))), size[short].tolist(), strict=True)]
        tail = pa.array(cut, pa.large_string()).dictionary_encode()
        tails = self._places(tail.dictionary)
        new = tails < 0
        tails[new] = self._by_offsets(tail.dictionary.filter(pa.array(new)))
        word = core.filter(pa.array(letters)).dictionary_encode()
        words = self._places(word.dictionary)
        new = words < 0
        words[new] = self._words(word.dictionary.filter(pa.array(new)))
        at[letters] = words[word.indices.to_numpy()]
        both = np.stack([at[short], tails[tail.indices.to_numpy()]], 1)
        ids, n = self.laid_out(both.ravel())
        at[short] = self._add(pieces.filter(pa.array(short)), [ids], [n.reshape(-1, 2).sum(1)])
        return at

    def _words(self, pieces: pa.Array) -> np.ndarray:
        """Pieces of letters alone: each ends with the one token that ends a word."""
        every, sizes = [], []
        for some in _joined(pieces, 2048):
            ids = np.array(self.tokenizer.encode_batch_fast([some], add_special_tokens=False)[0].ids, self.dtype)
            stop = np.flatnonzero(self.last[ids]) + 1
            if len(stop) != some.count(" ") + 1:  # letters that the tokenizer takes apart
                ids, stop = self._offsets(some)
            every.append(ids)
            sizes.append(np.diff(stop, prepend=0))
        return self._add(pieces, every, sizes)

    def _by_offsets(self, pieces: pa.Array) -> np.ndarray:
        got = [self._offsets(some) for some in _joined(pieces, 2048)]
        return self._add(pieces, [ids for ids, _ in got], [np.diff(stop, prepend=0) for _, stop in got])

    def _offsets(self, texts: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces joined by blanks, and where each piece's stop."""
        got = self.tokenizer.encode(texts, add_special_tokens=False)
        ids = np.array(got.ids, self.dtype)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts.split(" "))])[:-1]
        place = np.fromiter((o[0] for o in got.offsets), np.int64, len(ids))
        return ids, np.append(np.searchsorted(place, begins[1:]), len(ids))


def _hashes(pieces: pa.Array) -> np.ndarray:
    buf, offs = W.buffer_of(pieces)
    return W.hashes(W.Words(buf, offs[:-1], offs[1:], offs))


def _joined(pieces: pa.Array, many: int) -> list[str]:
    """Pieces by ``many``, joined by blanks."""
    edges = pa.array([*range(0, len(pieces), many), len(pieces)], pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(edges, pieces), pa.scalar(" ", pa.large_string())).to_pylist() if len(pieces) else []


def _known(spec: str, dtype: str) -> _Pieces:
    return held(("pieces", spec, dtype), lambda: _Pieces(spec, dtype))


def _bytes(strings: pa.Array) -> list[bytes]:
    """An array without nulls as bytes objects, from its buffers."""
    _, edges, data = strings.cast(pa.large_binary()).buffers()
    at = np.frombuffer(edges, np.int64)[strings.offset : strings.offset + len(strings) + 1].tolist()
    whole = data.to_pybytes() if data else b""
    return [whole[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def encoded(spec: str, dtype: str, texts: pa.Array) -> list[bytes]:
    """Packed ids of whole texts (null: empty). Where white space ends every pre-token, a text's ids
    are those of its pieces between blanks and line ends (ASCII), in order: each distinct piece is
    looked up once and its ids are laid out at all its places together."""
    known = _known(spec, dtype)
    texts = pc.fill_null(texts, "")
    if not known.apart:
        return [np.array(x.ids, dtype).tobytes() for x in known.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
    # Where the tokenizer lower-cases anyway, fewer pieces are new if that comes first; not where
    # a mark could compose with the letter before it, nor where special strings may stand.
    if known.lower:
        texts = pc.if_else(pc.match_substring_regex(texts, MARKED), texts, pc.ascii_lower(texts))
    parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat = parts.flatten().dictionary_encode()
    ids, n = known.laid_out(known.of(flat.dictionary)[flat.indices.to_numpy()])
    packed, width = ids.tobytes(), np.dtype(dtype).itemsize
    edges = (np.concatenate([[0], np.cumsum(n)])[np.cumsum([0, *pc.list_value_length(parts).to_pylist()])] * width).tolist()
    return [packed[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def write_shards(docs: DataFrame, where: str, *, tokenizer: str, end_id: int = 1, block_docs: int = 4096, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Writes the shards of docs to the folder ``where``."""
    spark = docs.sparkSession
    text = read_spec(tokenizer)
    from tokenizers import Tokenizer

    dtype = "<u2" if max(Tokenizer.from_str(text).get_vocab_size(True) - 1, end_id) < 1 << 16 else "<u4"
    spec = spark.sparkContext.broadcast(text)
    tail = np.array([end_id], dtype).tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        names, ids = [], []

        def shard() -> pa.RecordBatch:
            bound = np.concatenate([[0], np.cumsum([len(x) // len(tail) for x in ids])])
            ef = EliasFano.of(bound)
            packed = np.array(names, dtype="?,<i8").tobytes()
            return pa.RecordBatch.from_pylist([{"part": part, "block": block, "n_docs": len(ids), "n_ids": int(bound[-1]), "width": len(tail), "doc_ids": packed, "ids": b"".join(ids), "low_bits": ef.low_bits, "low": ef.low.tobytes(), "high": ef.high.tobytes(), "marks": ef.marks.tobytes()}], schema)

        held = 0
        for batch in slices(batches, limit=ENCODED_BYTES, rows=4 * SLICE_ROWS, keep=True):  # a shard goes on from one slice to the next
            new = encoded(spec.value, dtype, batch["text"])
            for name, x in zip(batch["doc_id"].to_pylist(), new, strict=True):
                names.append((name is not None, name or 0))
                ids.append(x + tail)
                held += len(x)
                if len(ids) == block_docs or held >= SHARD_BYTES:
                    yield shard()
                    block, held = block + 1, 0
                    names, ids = [], []
        if ids:
            yield shard()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SHARD))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = own.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    own.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(rows, SHARD).write.parquet(where)


def read_shards(spark: SparkSession, where: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it), n_tokens, ids (packed
    little-endian unsigned 32-bit)."""
    shards = spark.read.schema(SHARD).parquet(where)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("part_start"))
    own = shards.select("part", "block", "n_ids")
    inner = own.select("part", "block", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")).alias("block_start"))
    starts = inner.join(before, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("start"))
    # so the shards themselves need not be shuffled to their starts, of which each takes some 16 bytes
    placed = shards.join(F.broadcast(starts) if own.count() <= SENT_STARTS else starts, ["part", "block"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids", keep=True):
            for s in batch.to_pylist():
                ef = EliasFano(s["low_bits"], *(np.frombuffer(s[k], t) for k, t in (("low", np.uint8), ("high", np.uint8), ("marks", np.uint32))))
                bound = ef.select(np.arange(s["n_docs"] + 1))
                ids = np.frombuffer(s["ids"], f"<u{s['width']}").astype("<u4")
                names = np.frombuffer(s["doc_ids"], dtype="?,<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names["f1"], mask=~names["f0"]), pa.array(bound[:-1] + s["start"]), pa.array(np.diff(bound)), pa.array([ids[a:b].tobytes() for a, b in zip(bound[:-1], bound[1:], strict=True)], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return placed.select("n_docs", "width", "doc_ids", "ids", "low_bits", "low", "high", "marks", "start").mapInArrow(rows, "doc_id long, start long, n_tokens long, ids binary")


def read_documents(spark: SparkSession, where: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, n_tokens and ids (as of ``read_shards``) of the documents asked for; ``select``
    gives their boundaries, and no others are decoded."""
    wanted = np.array(sorted(set(doc_ids)), np.int64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids", keep=True):
            for s in batch.to_pylist():
                names = np.frombuffer(s["doc_ids"], dtype="?,<i8")
                found = np.flatnonzero(names["f0"] & np.isin(names["f1"], wanted))
                ef = EliasFano(s["low_bits"], *(np.frombuffer(s[k], t) for k, t in (("low", np.uint8), ("high", np.uint8), ("marks", np.uint32))))
                ids = np.frombuffer(s["ids"], f"<u{s['width']}")
                own = [ids[a:b].astype("<u4") for a, b in zip(ef.select(found), ef.select(found + 1), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names["f1"][found], pa.int64()), pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["doc_id", "n_tokens", "ids"])

    shards = spark.read.schema(SHARD).parquet(where)
    return shards.select("doc_ids", "ids", "low_bits", "low", "high", "marks", "width").mapInArrow(rows, "doc_id long, n_tokens long, ids binary")


def token_store(docs: DataFrame, *, tokenizer: str, end_id: int = 1, **columns: str) -> DataFrame:
    """docs written as shards to the shared folder and read back: doc_id, start, n_tokens, ids."""
    work = Scratch(docs.sparkSession, "tokens")
    write_shards(docs, f"{work.where}/shards", tokenizer=tokenizer, end_id=end_id, **columns)
    return read_shards(docs.sparkSession, f"{work.where}/shards")
