"""Token-id files with directly addressable codes.

An id is cut into chunks of 8 bits, low ones first, as many as it needs. Level k holds the k-th chunk of every id that
has one, plus a bitmap that says which of them go on, with a rank directory (ones before each 64-bit word), so that the
place of the next chunk is a rank. Any token is reached with one look-up a level and no block is decoded.

File layout (little-endian): magic ``DAC2``; u64 number of documents D, how many of them (the first ones) have a null id,
tokens N, first token's position in the part, levels L; D x i64 doc_ids; (D+1) x u64 starts; for each level u64 n, then
n bytes of chunks padded to 8, ceil(n/64) u64 bitmap words, ceil(n/64) u64 ranks. Parts cover ranges of doc_id and files
ranges of a part, so the order by (part, seq) is the corpus order. A file is one row ``(part, seq, tokens, data)`` of a
Parquet table in a shared folder.

Defined results: null and empty texts have the end id alone. Rows with a null doc_id come first. Repeated ids are a row
each, one after another. A text of any length is whole in one file.
"""

from __future__ import annotations

import json
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, parts, scratch, ship
from .words import slices

MAGIC = b"DAC2"
#: Pieces with their ids that a worker keeps from batch to batch before it starts anew with those in use.
CACHE = 250_000
#: Texts that are encoded together have about so many bytes.
TEXT_BYTES = 4_000_000
#: Sampled ids a range of ids.
SAMPLED = 50
#: A file is closed once it holds so many tokens.
FILE_TOKENS = 2_000_000


# --- directly addressable codes


def pack_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks u8, bitmap u64, ranks u64) a level."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        words = np.packbits(np.pad(more, (0, -len(more) % 64)), bitorder="little").view("<u8")
        ones = np.cumsum(np.bitwise_count(words), dtype=np.uint64)
        out.append((rest.astype(np.uint8), words, np.concatenate(([0], ones[:-1])).astype("<u8") if len(ones) else ones.astype("<u8")))
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            return out


def write_file(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, first: int = 0, null_ids: int = 0) -> bytes:
    levels = pack_levels(ids)
    out = [MAGIC, struct.pack("<QQQQQ", len(doc_ids), null_ids, len(ids), first, len(levels)), doc_ids.astype("<i8").tobytes(), np.concatenate(([0], np.cumsum(counts))).astype("<u8").tobytes()]
    for chunks, words, ranks in levels:
        out += [struct.pack("<Q", len(chunks)), chunks.tobytes(), b"\0" * (-len(chunks) % 8), words.tobytes(), ranks.tobytes()]
    return b"".join(out)


class TokenFile:
    """A view of a file's bytes; nothing is decoded until it is asked for."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        d, self.null_ids, self.n, self.first, levels = struct.unpack_from("<QQQQQ", data, 4)
        at = 44
        self.doc_ids = np.frombuffer(data, "<i8", d, at)
        self.starts = np.frombuffer(data, "<u8", d + 1, at + 8 * d).astype(np.int64)
        at += 8 * (2 * d + 1)
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            w, body = -(-n // 64), at + 8 + n + -n % 8
            self.levels.append((np.frombuffer(data, np.uint8, n, at + 8), np.frombuffer(data, "<u8", w, body), np.frombuffer(data, "<u8", w, body + 8 * w)))
            at = body + 16 * w

    def token(self, i: int) -> int:
        """The i-th token of the file, by one rank a level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k, (chunks, words, ranks) in enumerate(self.levels):
            out |= int(chunks[i]) << (8 * k)
            word, bit = int(words[i >> 6]), i & 63
            if not word >> bit & 1:
                break
            i = int(ranks[i >> 6]) + (word & ((1 << bit) - 1)).bit_count()
        return out

    def tokens(self, begin: int, end: int) -> np.ndarray:
        """Tokens begin..end-1: a range is a range at every level."""
        out, at = np.zeros(max(0, end - begin), np.uint32), np.arange(max(0, end - begin))
        for k, (chunks, words, ranks) in enumerate(self.levels):
            if not len(at):
                break
            out[at] |= chunks[begin:end].astype(np.uint32) << np.uint32(8 * k)
            w0, w1 = begin >> 6, (end + 63) >> 6
            more = np.unpackbits(words[w0:w1].view(np.uint8), bitorder="little")[begin - 64 * w0 : end - 64 * w0].astype(bool)
            at = at[more]
            rank = lambda i: int(ranks[i >> 6]) + (int(words[i >> 6]) & ((1 << (i & 63)) - 1)).bit_count()  # noqa: B023, E731
            if len(at):
                begin = rank(begin)
                end = begin + len(at)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))


# --- documents to files and back


#: The split and the normalisers under which a text's ids are those of its words (fixed values of the tokenizer file).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALISERS = ["NFC", "Replace", "Lowercase"]
#: Words of these characters alone are the same after NFC and are put in lower case alike by Arrow and the library.
_KNOWN = r"^[!-~\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]*$"


#: Classes of the bytes of known words: letters (1), digits (2), others (0).
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_CLASS[48:58] = 2


def _lists(split: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets from 0, values) of a list array."""
    at = np.asarray(split.offsets, np.int64)
    return at - at[0], split.values.slice(at[0], at[-1] - at[0])


def _offsets(sizes) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def _strings(offsets: np.ndarray, data, kind=None) -> pa.Array:
    return pa.Array.from_buffers(kind or pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), data if isinstance(data, pa.Buffer) else pa.py_buffer(data)])


def _bytes_of(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a large string or binary array; the offsets begin at 0."""
    if not len(a):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return at - at[0], data


def split_words(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets of the words in their pieces, pieces): what the tokenizer's pattern makes of lower-case words of known
    characters. Where there is no apostrophe, that is runs of letters, single digits and runs of others."""
    quoted = np.asarray(pc.match_substring(words, "'"), bool)
    at, data = _bytes_of(words.filter(pa.array(~quoted)))
    kind = _CLASS[data]
    first = np.ones(len(data), bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    first[at[:-1]] = True
    starts = np.flatnonzero(first)
    one = _strings(np.append(starts, len(data)), data)
    cut, two = _lists(pc.ascii_split_whitespace(pc.utf8_trim_whitespace(pc.replace_substring_regex(words.filter(pa.array(quoted)), f"({_SPLIT})", r"\1 "))))
    counts = np.zeros(len(words), np.int64)
    counts[~quoted], counts[quoted] = np.diff(np.searchsorted(starts, at)), np.diff(cut)
    offsets = _offsets(counts)
    if not quoted.any():
        return offsets, one
    # Both kinds' pieces in the order of the words.
    from_two = np.repeat(quoted, counts)
    place = np.where(from_two, np.cumsum(from_two) - 1 + len(one), np.cumsum(~from_two) - 1)
    return offsets, pa.concat_arrays([one, two.cast(pa.large_string())]).take(pa.array(place))


class Encoder:
    """Encodes many texts at a time. Where the tokenizer drops white space and no merge crosses it, the distinct
    white-space delimited words of the texts are found first: words of common letters are lower-cased and split into the
    pieces that the tokenizer's pattern makes of them, and the library encodes each distinct piece once; other words are
    the library's from the start. Other tokenizers get whole texts."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.t = Tokenizer.from_str(tokenizer_json)
        spec = json.loads(tokenizer_json)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers") or []]
        self.by_word = kinds == _NORMALISERS and [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": _SPLIT} and not any(x["content"].isascii() and (x["lstrip"] or x["rstrip"]) for x in spec["added_tokens"])
        # Words that hold one of these are left to the whole tokenizer.
        self.special = [x["content"] for x in spec["added_tokens"]]
        # The library's model alone, for pieces that are normalised and split already.
        self.plain = Tokenizer.from_str(tokenizer_json)
        self.plain.normalizer, self.plain.pre_tokenizer = None, Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.plain.encode_special_tokens = True
        # Ids that end a word: the model marks a word's last token, and no other, by a suffix.
        suffix = (spec.get("model") or {}).get("end_of_word_suffix")
        self.ends = np.zeros(self.t.get_vocab_size() + 1, bool)
        if suffix:
            self.ends[[i for w, i in self.t.get_vocab().items() if w.endswith(suffix)]] = True
        self.kind = np.dtype("<u2" if self.t.get_vocab_size() <= 1 << 16 else "<u4")
        # Pieces by number, with their ids.
        self.known: dict[str, int] = {}
        self.blobs = self._blobs(np.zeros(0, np.uint32), [])

    def _blobs(self, ids: np.ndarray, sizes) -> pa.Array:
        return _strings(_offsets(sizes) * self.kind.itemsize, ids.astype(self.kind), pa.large_binary())

    def _whole(self, texts: pa.Array) -> pa.Array:
        ids, sizes = [np.zeros(0, np.uint32)], []
        for k in range(0, len(texts), 4096):
            got = [e.ids for e in self.t.encode_batch_fast(texts.slice(k, 4096).to_pylist(), add_special_tokens=False)]
            ids.append(np.fromiter(chain.from_iterable(got), np.uint32))
            sizes += map(len, got)
        return self._blobs(np.concatenate(ids), sizes)

    def _pieces(self, pieces: pa.Array) -> pa.Array:
        """The ids of distinct pieces. Those that no text before had go to the library's model, many at a time with blanks
        in between."""
        keys = pieces.to_pylist()
        if len(self.known) > CACHE:
            # Pieces that still occur come along.
            old = self.known
            kept = [k for k in keys if k in old]
            self.blobs = self.blobs.take(pa.array([old[k] for k in kept], pa.int64()))
            self.known = dict(zip(kept, range(len(kept)), strict=True))
        fresh = [k for k in keys if k not in self.known]
        new = []
        for k in range(0, len(fresh), 4096):
            some = fresh[k : k + 4096]
            line = " ".join(some)
            got = np.array(self.plain.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.ends[got])
            if len(last) != len(some):
                e = self.plain.encode(line, add_special_tokens=False)
                got, last = np.array(e.ids, np.uint32), np.searchsorted(np.array(e.word_ids, np.int64), np.arange(1, len(some) + 1)) - 1
            new.append(self._blobs(got, np.diff(last, prepend=-1)))
        if fresh:
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
            self.blobs = pa.concat_arrays([self.blobs, *new])
        return self.blobs.take(pa.array(np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, the texts' offsets in them); null texts have none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.by_word:
            at, data = _bytes_of(self._whole(texts))
            return data.view(self.kind), at // self.kind.itemsize
        at, words = _lists(pc.ascii_split_whitespace(texts))
        words = words.dictionary_encode()
        of, words = words.indices, words.dictionary
        # A word with one of the special strings, or with other letters than the known ones, is hard.
        hard = np.asarray(pc.invert(pc.match_substring_regex(words, _KNOWN)), bool)
        for x in self.special:
            hard |= np.asarray(pc.match_substring(words, x), bool)
        # White space at a text's ends leaves an empty word, which is hard and has no ids.
        hard |= np.asarray(pc.binary_length(words), np.int64) == 0
        cut, pieces = split_words(pc.utf8_lower(words.filter(pa.array(~hard))))
        pieces = pieces.dictionary_encode()
        ends, data = _bytes_of(self._pieces(pieces.dictionary).take(pieces.indices))
        easy, whole = _strings(ends[cut], data, pa.large_binary()), self._whole(words.filter(pa.array(hard)))
        # All words' ids, the easy ones' first.
        place = np.where(hard, np.cumsum(hard) - 1 + len(easy), np.cumsum(~hard) - 1)
        ends, data = _bytes_of(pa.concat_arrays([easy, whole]).take(pa.array(place)).take(of))
        return data.view(self.kind), ends[at] // self.kind.itemsize


_ENCODERS: dict[int, Encoder] = {}


def _encoder_of(tokenizer_json: str) -> Encoder:
    """The worker's encoder for this tokenizer, kept from task to task."""
    key = hash(tokenizer_json)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(tokenizer_json)
    return _ENCODERS[key]


def _wide(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if len(blob) == 2 * n else "<u4").astype("<u4")


def bounds(docs: DataFrame, doc_id: str, n: int) -> np.ndarray:
    """At most n - 1 ids that cut docs into n ranges of about equally many rows, from a sample of some SAMPLED ids a
    range. Only the id column is read. An id that fills several ranges is there as often."""
    ids = docs.select(F.col(doc_id).cast("long").alias("d")).where("d IS NOT NULL")
    total = ids.count()
    got = np.sort(ids.sample(min(1.0, SAMPLED * n / max(total, 1)), 1).toArrow().column("d").to_numpy())
    return got[np.arange(1, n) * len(got) // n] if len(got) else got


def encode(docs: DataFrame, tokenizer_path: str, end_id: int | None, doc_id: str = "doc_id", text: str = "text", cuts: np.ndarray | None = None) -> DataFrame:
    """(part, doc_id, n, ids): ids of each whole text, little-endian, of 2 bytes where the vocabulary fits and else of 4, with
    end_id after them; a null text has none. part is the range of cuts that the id is in; null ids come first. Rows of an id
    that fills several ranges are dealt out over them in turn."""
    ship(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    cuts = np.zeros(0, np.int64) if cuts is None else cuts

    def parts_of(ids: pa.Array, row: int) -> np.ndarray:
        d = np.asarray(ids.fill_null(0))
        low, high = np.searchsorted(cuts, d, "left"), np.searchsorted(cuts, d, "right")
        return np.where(np.asarray(ids.is_null()), 0, low + (row + np.arange(len(ids))) % (high - low + 1))

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        row, encoder, tail = 0, _encoder_of(spec.value), np.array([] if end_id is None else [end_id], np.uint32)
        for b in batches:
            for s in slices(b, 1, TEXT_BYTES):
                ids, offsets = encoder.encode(s.column(1))
                if len(tail):
                    ids = np.insert(ids if tail[0] <= np.iinfo(ids.dtype).max else ids.astype("<u4"), offsets[1:], tail[0])
                    offsets = offsets + np.arange(len(offsets))
                blob = pa.Array.from_buffers(pa.large_binary(), s.num_rows, [None, pa.py_buffer(offsets * ids.itemsize), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(parts_of(s.column(0), row), pa.int32()), s.column(0), pa.array(np.diff(offsets), pa.int64()), blob], names=["part", "doc_id", "n", "ids"])
                row += s.num_rows

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(lean(run), "part int, doc_id long, n long, ids binary")


def write_files(encoded: DataFrame, path: str, n_parts: int) -> None:
    """Files in ascending doc_id order, null ids first: rows go to their parts, each is sorted and written as files of
    about FILE_TOKENS tokens that know where in their part they begin."""

    def pack(batches):
        part, seq, ids, n, blobs, held, before = 0, 0, [], [], [], 0, 0

        def flush():
            nonlocal ids, n, blobs, held, seq, before
            none = sum(x is None for x in ids)
            data = write_file(np.array([x or 0 for x in ids], np.int64), np.array(n, np.int64), np.concatenate(blobs), before, none)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([held], pa.int64()), pa.array([data], pa.binary())], names=["part", "seq", "tokens", "data"])
            before += held
            ids, n, blobs, held, seq = [], [], [], 0, seq + 1
            return row

        for b in batches:
            for p, d, k, x in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if ids and (p != part or held + k > FILE_TOKENS):
                    yield flush()
                if p != part:
                    part, seq, before = p, 0, 0
                ids.append(d)
                n.append(k)
                blobs.append(_wide(x, k))
                held += k
        if ids:
            yield flush()

    dealt = encoded.repartitionById(n_parts, F.col("part")).sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "ids")
    files = dealt.mapInArrow(lean(pack), "part int, seq int, tokens long, data binary")
    files.write.option("compression", "zstd").parquet(path)


def read_files(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document, from the files. The driver sees one sum a part."""
    ship(spark)
    files = spark.read.parquet(path)
    sums = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("tokens").alias("n")).toArrow().to_pylist()}
    begin, total = np.zeros(max(sums, default=0) + 1, np.int64), 0
    for p in sorted(sums):
        begin[p] = total
        total += sums[p]
    shared = spark.sparkContext.broadcast(begin)

    def run(batches):
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = TokenFile(data)
                base = int(shared.value[part]) + f.first
                every = f.tokens(0, f.n).astype("<u4")
                for k in range(0, len(f.doc_ids), 512):
                    cut = f.starts[k : k + 513]
                    ids = [every[a:z].tobytes() for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                    nulls = np.arange(k, k + len(ids)) < f.null_ids
                    yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids[k : k + 512], mask=nulls), pa.array(base + cut[:-1]), pa.array(np.diff(cut)), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return files.select("part", "data").mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Encodes docs, writes the files and reads them back: doc_id, start, n_tokens, ids_crc32 (and nothing is lost in
    between). Texts are read and encoded once, in one job with the exchange; rows of equal ids are in the order of their
    parts and ids, and those with a null id come first."""
    spark = docs.sparkSession
    path, n = path or scratch(spark, "tokens"), parts(spark)
    write_files(encode(docs, tokenizer_path, end_id, cuts=bounds(docs, "doc_id", n)), path, n)
    return read_files(spark, path).drop("ids")
