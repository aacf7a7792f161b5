"""Token-id files with a shared zstandard dictionary.

Documents are encoded with a public tokenizer and an end id. A dictionary is
trained on the serialized id arrays of a bounded sample (``SAMPLE_DOCS``
documents of least hash, ``SAMPLE_IDS`` ids of each: documented bounds of the
model, nothing else is sampled). Every document is compressed on its own with
that dictionary, so short documents compress well and any one can be read
alone.

A file (all numbers little-endian)::

    "DFTOK1\\0\\0"  u32 bytes per id  32 bytes sha-256 of the dictionary
    one zstandard frame per document
    index: n x (i64 doc_id, u64 offset, u64 ids, u8 has doc_id)
    u64 offset of the index  u64 n  u32 crc-32 of the index  "DFTOKEND"

A frame ends where the next begins (the last where the index begins). Files
hold ascending doc_ids (null ids first) and are numbered in that order; the
manifest gives their paths and the number of ids before each.

The tokenizer's pre-tokenization always starts a new piece at a space or line
end between two characters that aren't white space, after such a line end, and
at a stop or comma after a letter, so texts are cut there and each different
piece is encoded once by the library; the ids are those of the whole text
(tested against whole-text encoding).

Strings of special tokens in a text get the ids that the library gives them.
Null and empty texts hold the end id alone. Repeated rows are written each
time. An empty table gives no file and no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckflow.llm.common import cut, get_file, new_folder, put_file, slim, small_batches, total_prefix

END_ID = 2
SAMPLE_DOCS, SAMPLE_IDS = 1000, 2048
DICT_BYTES = 64 * 1024
FILE_BYTES = 64 << 20
HEAD, TAIL = b"DFTOK1\0\0", b"DFTOKEND"
ENTRY = [("doc_id", "<i8"), ("offset", "<u8"), ("ids", "<u8"), ("has_id", "u1")]
CACHE = 1_000_000


class Encoder:
    """Whole-text encoding that asks the library once for each piece.

    Pieces are cut and hashed for a whole batch as byte arrays. A known piece has
    a hash, its bytes, its ids and how often it came; every occurrence is compared
    with the bytes, so a hash never decides alone. The ids of all known pieces
    lie in one array, and a batch is put together by index."""

    cut = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=\S\n)(?=\S)|(?<=[A-Za-z0-9])(?=[,.;:!?])")
    # white space beyond ASCII's, and signs that are white space to some: such texts are cut by the expression
    odd = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8-\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\xef\xbb\xbf|[\x1c-\x1f]")
    signs = [b"\xc2\x85", b"\xc2\xa0", b"\xe1", b"\xe2", b"\xe3\x80\x80", b"\xef\xbb\xbf", b"\x1c", b"\x1d", b"\x1e", b"\x1f"]  # a match has one
    # one word, with at most one space before it, of letters and signs that no tokenizer takes for white space
    plain = re.compile("[ ]?[!-~\u00a1-\u024f]+")

    def __init__(self, tokenizer_path: str):
        import numpy as np
        from tokenizers import Tokenizer

        from deckflow.llm.grams import Powers
        self.tok = Tokenizer.from_file(tokenizer_path)
        self.powers = Powers()
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted by hash
        self.bytes, self.begin, self.size = np.zeros(8, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.used = np.zeros(0, np.int64)
        space = np.zeros(256, bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        self.full = ~space
        self.alnum, self.stop = np.zeros(256, bool), np.zeros(256, bool)
        self.alnum[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
        self.stop[list(b",.;:!?")] = True
        self.line = self._line()

    def _line(self) -> int | None:
        """The id of a line end that never joins what stands around it, or None
        if this tokenizer has none."""
        ids = lambda t: self.tok.encode(t, add_special_tokens=False).ids
        probe = ["ab", " cd", ",", " 12", "é", " <x>", "it's"]
        line = ids("\n")
        parts = [x for p in probe for x in (*line, *ids(p))][1:]
        return line[0] if len(line) == 1 and ids("\n".join(probe)) == parts else None

    def _encode(self, pieces: list[str]) -> list:
        """The ids of each piece. Plain pieces go through the library many at a
        time, parted by line ends: the ids between two are those of a piece."""
        import numpy as np
        out: list = [None] * len(pieces)
        plain = [i for i, p in enumerate(pieces) if self.plain.fullmatch(p)] if self.line is not None else []
        for a in range(0, len(plain), 4096):
            some = plain[a:a + 4096]
            ids = np.array(self.tok.encode_batch_fast(["\n".join([pieces[i] for i in some])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.append(np.flatnonzero(ids == self.line), len(ids))
            if len(ends) == len(some):
                for i, x, y in zip(some, [0, *(ends[:-1] + 1).tolist()], ends.tolist()):
                    out[i] = ids[x:y]
        left = [i for i, x in enumerate(out) if x is None]
        for a in range(0, len(left), 20_000):
            some = left[a:a + 20_000]
            for i, e in zip(some, self.tok.encode_batch_fast([pieces[i] for i in some], add_special_tokens=False)):
                out[i] = np.array(e.ids, np.uint32)
        return out

    def _cuts(self, data, raw: list[bytes], starts):
        """Where a piece begins, as truth per byte: at text starts and by ``cut``."""
        import numpy as np
        n = len(data)
        flags = np.zeros(n, bool)
        if n > 2:
            full = self.full[data]
            one = full[:-2] & full[2:] & ((data[1:-1] == 32) | (data[1:-1] == 10))
            flags[1:-1] |= one
            flags[starts[(starts > 0) & (starts < n)] - 1] = False  # the white space that ends a text
            two = full[:-2] & full[2:] & (data[1:-1] == 10)
            after = np.zeros(n, bool)
            after[2:] = two
            inner = starts[starts + 1 < n]
            after[inner + 1] = False  # a line end that begins a text
            flags |= after
            flags[1:] |= self.alnum[data[:-1]] & self.stop[data[1:]]
        flags[starts[starts < n]] = True
        whole = data.tobytes()
        for t, at in zip(raw, starts.tolist()) if any(x in whole for x in self.signs) else ():
            if self.odd.search(t):
                flags[at:at + len(t)] = False
                flags[at + np.cumsum([0, *[len(p.encode()) for p in self.cut.split(t.decode())[:-1]]])] = True
        return flags

    def _thin(self) -> None:
        """Keep the pieces that came more than once, and of those the more
        frequent half of what the cache holds at most."""
        import numpy as np
        least = max(2, int(np.partition(self.used, -CACHE // 2)[-CACHE // 2]) + 1 if len(self.used) > CACHE // 2 else 2)
        stay = np.flatnonzero(self.used >= least)
        new = np.full(len(self.used), -1)
        new[stay] = np.arange(len(stay))
        kept = new[self.numbers] >= 0
        self.hashes, self.numbers = self.hashes[kept], new[self.numbers[kept]]

        def packed(values, begin, size):
            upto = np.concatenate([[0], np.cumsum(size)])
            return values[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])], upto
        data, upto = packed(self.bytes, self.begin[stay], self.size[stay])
        self.bytes, self.begin, self.size = np.append(data, np.zeros(8, np.uint8)), upto[:-1], self.size[stay]
        self.ids, self.ends = packed(self.ids, self.ends[stay], self.ends[stay + 1] - self.ends[stay])
        self.used = self.used[stay] // 2

    def _learn(self, data, begin, size, hashes):
        """Takes new pieces (spans of ``data``) up; returns their numbers. Those
        without a hash are for this batch only."""
        import numpy as np
        raw = data.tobytes()
        ids = self._encode([raw[a:a + n].decode() for a, n in zip(begin.tolist(), size.tolist())])
        numbers = np.arange(len(self.used), len(self.used) + len(begin))
        at = len(self.bytes) - 8
        upto = np.concatenate([[0], np.cumsum(size)])
        self.bytes = np.concatenate([self.bytes[:-8], data[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])], np.zeros(8, np.uint8)])
        self.begin, self.size = np.concatenate([self.begin, at + upto[:-1]]), np.concatenate([self.size, size])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in ids])])
        self.ids = np.concatenate([self.ids, *ids])
        self.used = np.append(self.used, np.zeros(len(begin), np.int64))
        if hashes is not None:
            place = np.searchsorted(self.hashes, hashes)
            self.hashes, self.numbers = np.insert(self.hashes, place, hashes), np.insert(self.numbers, place, numbers)
        return numbers

    def _number(self, data, begin, size, hashes):
        """The number of every piece."""
        import numpy as np

        from deckflow.llm.grams import same_spans
        order = np.argsort(hashes)
        key = hashes[order]
        new = np.ones(len(order), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        key = key[first]
        place = np.minimum(np.searchsorted(self.hashes, key), max(len(self.hashes) - 1, 0))
        known = self.hashes[place] == key if len(self.hashes) else np.zeros(len(key), bool)
        of_key = np.zeros(len(key), np.int64)
        of_key[known] = self.numbers[place[known]]
        if not known.all():
            one = order[first[~known]]
            of_key[~known] = self._learn(data, begin[one], size[one], key[~known])
        number = np.empty(len(order), np.int64)
        number[order] = np.repeat(of_key, np.diff(np.append(first, len(order))))
        # every occurrence against the bytes of its piece
        both = np.concatenate([self.bytes, data, np.zeros(8, np.uint8)])
        alike = self.size[number] == size
        alike[alike] = same_spans(both, self.begin[number[alike]], begin[alike] + len(self.bytes), size[alike])
        if not alike.all():
            other = np.flatnonzero(~alike)
            number[other] = self._learn(data, begin[other], size[other], None)
        self.used += np.bincount(number, minlength=len(self.used))
        return number

    def encode(self, texts: list[str | None], end_id: int = END_ID) -> list:
        import numpy as np

        from deckflow.llm.grams import Fingerprints
        if len(self.used) > CACHE:
            self._thin()
        raw = [t.encode() if t else b"" for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        starts = np.cumsum([0, *[len(t) for t in raw]])
        if not len(data):
            return [np.array([end_id], np.uint32) for _ in texts]
        begin = np.flatnonzero(self._cuts(data, raw, starts[:-1]))
        stop = np.append(begin[1:], len(data))
        hashes = np.empty(len(begin), np.uint64)
        for a in range(0, len(begin), 200_000):  # prefix sums over a stretch at a time
            b = min(len(begin), a + 200_000)
            lo = int(begin[a])
            hashes[a:b] = Fingerprints(data[lo:int(stop[b - 1])], self.powers).of(begin[a:b] - lo, stop[a:b] - lo)
        number = self._number(data, begin, stop - begin, hashes)
        size = self.ends[number + 1] - self.ends[number]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.ends[number] - upto[:-1], size) + np.arange(upto[-1])]
        stops = upto[np.searchsorted(begin, starts)]
        return [np.append(ids[a:b], np.uint32(end_id)) for a, b in zip(stops, stops[1:])]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process; its cache serves all the tasks of the worker."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks take the cores
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def train_dictionary(docs: DataFrame, tokenizer_path: str, width: int) -> bytes:
    """Dictionary bytes; a plain-content one where the sample is too small to train on."""
    import zstandard

    def run(batches):
        import pyarrow as pa
        for b in batches:
            ids = encoder(tokenizer_path).encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([x[:SAMPLE_IDS].astype(f"<u{width}").tobytes() for x in ids], pa.binary())], ["ids"])

    # the hashes alone are ordered first; texts are read up to the last hash
    key = F.xxhash64(F.lit("dictionary"), "doc_id", F.xxhash64("text"))
    own = slim(docs, doc_id="doc_id", text="text").filter("text != ''").withColumn("key", key)
    last = own.select("key").orderBy("key").limit(SAMPLE_DOCS).agg(F.max("key")).first()[0]
    sample = own.filter(F.col("key") <= F.lit(last)).orderBy("key", "doc_id", "text").limit(SAMPLE_DOCS)
    parts = [bytes(r["ids"]) for r in sample.select("text").mapInArrow(run, "ids binary").collect()]  # at most SAMPLE_DOCS * SAMPLE_IDS ids
    try:
        return zstandard.train_dictionary(DICT_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[:DICT_BYTES]


def _dictionary(data: bytes):
    import zstandard
    return zstandard.ZstdCompressionDict(data)


class Writer:
    """One file; frames stream through, only the index is held."""

    def __init__(self, path: str, width: int, sha: bytes):
        self.path, self.index, self.size, self.head = path, [], 0, HEAD + struct.pack("<I", width) + sha
        self.frames: list[bytes] = []

    def add(self, doc_id, ids: int, frame: bytes) -> None:
        self.index.append((doc_id or 0, len(self.head) + self.size, ids, doc_id is not None))
        self.frames.append(frame)
        self.size += len(frame)

    def close(self) -> tuple[str, int, int]:
        import numpy as np
        index = np.array(self.index, ENTRY)
        raw = index.tobytes()
        tail = struct.pack("<QQI", len(self.head) + self.size, len(index), zlib.crc32(raw)) + TAIL
        put_file(self.path, [self.head, *self.frames, raw, tail])
        return self.path, len(index), int(index["ids"].sum())


class Reader:
    """Reads a file whole or one document by its place in the index."""

    def __init__(self, path: str, dictionary: bytes):
        import numpy as np
        import zstandard
        self.file = get_file(path)
        size = self.file.size()
        head = self.file.read_at(44, 0)
        at, n, crc, tail = struct.unpack("<QQI8s", self.file.read_at(28, size - 28))
        raw = self.file.read_at(size - 28 - at, at)
        if head[:8] != HEAD or tail != TAIL or zlib.crc32(raw) != crc:
            raise ValueError(f"{path}: not a whole token file")
        if head[12:44] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path}: made with another dictionary")
        self.width = struct.unpack("<I", head[8:12])[0]
        self.index = np.frombuffer(raw, ENTRY)
        assert len(self.index) == n
        self.ends = np.append(self.index["offset"][1:], at).astype(np.int64)
        self.unzip = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def __len__(self) -> int:
        return len(self.index)

    def ids(self, i: int):
        import numpy as np
        a = int(self.index["offset"][i])
        return np.frombuffer(self.unzip.decompress(self.file.read_at(int(self.ends[i]) - a, a)), f"<u{self.width}")

    def runs(self, documents: int = 2000):
        """All documents in order, read in long stretches."""
        import numpy as np
        for lo in range(0, len(self), documents):
            hi = min(len(self), lo + documents)
            a = int(self.index["offset"][lo])
            block = self.file.read_at(int(self.ends[hi - 1]) - a, a)
            for i in range(lo, hi):
                frame = block[int(self.index["offset"][i]) - a:int(self.ends[i]) - a]
                yield self.index[i], np.frombuffer(self.unzip.decompress(frame), f"<u{self.width}")


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the files below ``folder`` (in the shared store); returns the
    manifest ``(path, dictionary, docs, ids, before)``, before = ids of all
    files in front."""
    from tokenizers import Tokenizer
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    small_batches(spark, 1000, 4)
    vocabulary = Tokenizer.from_file(tokenizer_path).get_vocab_size()
    width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
    words = train_dictionary(docs, tokenizer_path, width)
    sha = hashlib.sha256(words).digest()
    put_file(f"{folder}/{sha.hex()}.dict", [words])

    def encode(batches):
        import pyarrow as pa
        import zstandard
        zip_ = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(words), write_checksum=True, write_content_size=True)
        for b in batches:
            ids = encoder(tokenizer_path).encode(b.column("text").to_pylist(), end_id)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([zip_.compress(x.astype(f"<u{width}").tobytes()) for x in ids], pa.binary())], ["doc_id", "ids", "frame"])

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part, out, done = TaskContext.get().partitionId(), None, []

        def close():
            done.append((part, len(done), *out.close()))

        for b in batches:
            for doc_id, n, frame in zip(*(b.column(c).to_pylist() for c in ("doc_id", "ids", "frame"))):
                out = out or Writer(f"{folder}/part-{part:06d}-{len(done):04d}.tok", width, sha)
                out.add(doc_id, n, frame)
                if out.size >= file_bytes:
                    close()
                    out = None
        if out:
            close()
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "number", "path", "docs", "ids"), x)) for x in done], schema=pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    own = slim(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    frames = cut(own.mapInArrow(encode, "doc_id long, ids long, frame binary"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "ids", F.xxhash64("frame")]  # so one id with many rows is dealt over tasks too
    ordered = frames.repartitionByRange(n, *order).sortWithinPartitions(*order)
    files = cut(ordered.mapInArrow(write, "part int, number int, path string, docs long, ids long"))
    placed = total_prefix(files, ["part", "number"], "ids", ["path", "docs", "ids"])
    return placed.select("path", F.lit(f"{folder}/{sha.hex()}.dict").alias("dictionary"), "docs", "ids", "before")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the files."""
    spark: SparkSession = manifest.sparkSession

    def run(batches):
        import numpy as np
        import pyarrow as pa
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for b in batches:
            for row in b.to_pylist():
                with get_file(row["dictionary"]) as f:
                    words = f.read()
                at, rows = row["before"], []
                for entry, ids in Reader(row["path"], words).runs():
                    if len(ids) != entry["ids"]:
                        raise ValueError(f"{row['path']}: {len(ids)} ids where the index has {entry['ids']}")
                    rows.append((int(entry["doc_id"]) if entry["has_id"] else None, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    small_batches(spark, 1)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
