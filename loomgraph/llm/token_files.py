"""Token ids of a corpus in wavelet-matrix files: one compressed file for each shard, in key order.

A shard's ids are kept as the bit planes of a wavelet matrix: plane 0 holds each id's highest bit in text order, the next
plane the second bit after a stable split by the first, and so on. The planes are cut into chunks, each compressed by
itself, with the number of ones before each chunk in the footer; so rank and select decompress one chunk a plane, and an
id, a count or the places of an id come from a few ranges of the file.

File, little-endian: ``LWM1``; the chunks of all planes (zstd of packed bits); the footer (zstd of an Arrow stream of keys
and token counts, and of the directory); the lengths of its two parts and of the file's id width, then ``LWM1`` again.

Spark deals the documents into ranges of the key and sorts them; a task encodes its range and closes a shard as soon as
that has ``shard_tokens`` ids, so no task holds more than one shard and one batch of texts. Files carry the number of the
task attempt; the manifest, a stored table of the attempts that ended well, names the files that count. Tasks open files by
``pyarrow.fs``, in the folder that the cluster shares (local or mounted paths, hdfs, s3).

An encoder need not see a word twice: byte-level BPE never joins tokens over a single space between two other characters, nor
over the border of a letter and a mark, so texts are cut there, and the tokenizer encodes each distinct piece once in a while;
what is a word already goes straight to its model.

Defined cases: a null text is an empty one, and an empty text has the end id alone; null keys come first; rows with the same
key are ordered by the hash of their texts, null first; a special token's name inside a text is ordinary text; a document longer than a shard is one
shard; an empty table writes no file; other columns, of any name, are ignored.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.columns import quoted
from loomgraph.functions.ranking import wide_running_sums
from loomgraph.functions.storage import shared_folder, stash
from loomgraph.llm.text import by_weight

MAGIC = b"LWM1"
#: Ids of a shard at which it is closed, and bits of a chunk.
SHARD_TOKENS, CHUNK_BITS = 1 << 24, 1 << 18
#: Distinct pieces at which a worker begins to learn them anew.
REMEMBERED = 500_000
END_ID = 2
#: Unicode white space, and the four separators that some engines count as such.
SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CLASS = regex.sub(r"\\u(....)", r"\\x{\1}", SPACE)
_ODD = f"^ | $|[{_CLASS}] | [{_CLASS}]|\\x1f"
_CUT = regex.compile(f"(?<=[^{SPACE}])(?= [^{SPACE}])", regex.V1)
#: Letters of the first 256 code points, and marks beside which no token goes on (the apostrophe may begin one).
_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~\n"
_WORD = f"^ ?[{_LETTER}]+$"
_BORDER = "\x1f"


# ---- the matrix ----


def planes(ids: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, int]]:
    """(bits of the plane as booleans, number of zeros) from the highest bit down."""
    for b in reversed(range(bits)):
        on = (ids & ids.dtype.type(1 << b)) != 0
        yield on, int(len(on) - np.count_nonzero(on))
        ids = np.concatenate([ids[~on], ids[on]])


def write_matrix(out, ids: np.ndarray, bits: int, docs: pa.Table, chunk_bits: int = CHUNK_BITS) -> int:
    """Write one shard to a binary stream; returns its bytes. ``docs``: key and n_tokens of its documents in order."""
    pack = zstandard.ZstdCompressor(level=1)
    at = out.write(MAGIC) or len(MAGIC)
    zeros, offsets, ones = [], [], []
    for on, z in planes(ids, bits):
        zeros.append(z)
        seen = 0
        for s in range(0, len(on), chunk_bits):
            part = on[s : s + chunk_bits]
            data = pack.compress(np.packbits(part, bitorder="little").tobytes())
            out.write(data)
            offsets.append(at)
            ones.append(seen)
            at += len(data)
            seen += int(np.count_nonzero(part))
    offsets.append(at)
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, docs.schema) as w:
        w.write_table(docs)
    head = np.array([len(ids), bits, chunk_bits], dtype="<i8").tobytes()
    directory = head + b"".join(np.array(x, dtype="<i8").tobytes() for x in (zeros, offsets, ones))
    parts = [pack.compress(sink.getvalue()), pack.compress(directory)]
    for p in parts:
        out.write(p)
    out.write(struct.pack("<qq", *map(len, parts)) + MAGIC)
    return at + sum(map(len, parts)) + 16 + len(MAGIC)


class TokenFile:
    """One shard, opened for reading: ``source`` is a seekable binary file. Only the chunks that a call needs are read."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        tail = 16 + len(MAGIC)
        a, b = struct.unpack("<qq", self._read(size - tail, tail)[:16])
        if self._read(size - len(MAGIC), len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        unpack = zstandard.ZstdDecompressor()
        self.docs = pa.ipc.open_stream(unpack.decompress(self._read(size - tail - a - b, a))).read_all()
        words = np.frombuffer(unpack.decompress(self._read(size - tail - b, b)), dtype="<i8")
        self.n, self.bits, self.chunk_bits = (int(x) for x in words[:3])
        self.chunks = -(-self.n // self.chunk_bits)
        self.zeros = words[3 : 3 + self.bits]
        rest = words[3 + self.bits :]
        self.offsets, self.ones = rest[: self.bits * self.chunks + 1], rest[self.bits * self.chunks + 1 :]
        self.starts = np.concatenate([[0], np.cumsum(self.docs.column("n_tokens").to_numpy())]).astype(np.int64)
        self._chunk = lru_cache(64)(self._load)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _load(self, plane: int, chunk: int) -> np.ndarray:
        k = plane * self.chunks + chunk
        n = min(self.chunk_bits, self.n - chunk * self.chunk_bits)
        data = zstandard.ZstdDecompressor().decompress(self._read(int(self.offsets[k]), int(self.offsets[k + 1] - self.offsets[k])))
        return np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n, bitorder="little").view(bool)

    def _rank1(self, plane: int, i: int) -> int:
        """Ones of the plane before place ``i``."""
        c, inside = divmod(i, self.chunk_bits)
        if c == self.chunks:
            return self.n - int(self.zeros[plane])
        return int(self.ones[plane * self.chunks + c]) + int(np.count_nonzero(self._chunk(plane, c)[:inside]))

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        out = 0
        for p in range(self.bits):
            on = bool(self._chunk(p, i // self.chunk_bits)[i % self.chunk_bits])
            r = self._rank1(p, i)
            i = int(self.zeros[p]) + r if on else i - r
            out = out << 1 | on
        return out

    def _span(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the token's occurrences in [lo, hi) stand below the last plane."""
        if token < 0 or token >> self.bits:
            return 0, 0
        for p in range(self.bits):
            a, b = self._rank1(p, lo), self._rank1(p, hi)
            lo, hi = (int(self.zeros[p]) + a, int(self.zeros[p]) + b) if token >> (self.bits - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of the token in [lo, hi)."""
        a, b = self._span(token, lo, self.n if hi is None else hi)
        return b - a

    def _select(self, plane: int, on: bool, ranks: np.ndarray) -> np.ndarray:
        """Places of the ones (or zeros) with the given ascending numbers, from 0."""
        ones = self.ones[plane * self.chunks : (plane + 1) * self.chunks]
        before = ones if on else np.arange(self.chunks) * self.chunk_bits - ones
        chunk = np.searchsorted(before, ranks, side="right") - 1
        out = np.empty(len(ranks), dtype=np.int64)
        for c in np.unique(chunk):
            here = chunk == c
            bits = self._chunk(plane, int(c))
            out[here] = c * self.chunk_bits + np.flatnonzero(bits if on else ~bits)[ranks[here] - before[c]]
        return out

    def occurrences(self, token: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Places of the token in [lo, hi), ascending."""
        a, b = self._span(token, lo, self.n if hi is None else hi)
        at = np.arange(a, b)
        for p in reversed(range(self.bits)):
            on = bool(token >> (self.bits - 1 - p) & 1)
            at = self._select(p, on, at - int(self.zeros[p]) if on else at)
        return at

    def ids(self) -> np.ndarray:
        """All ids in order: the planes are read once each, from the last, and the splits undone."""
        out = np.zeros(self.n, dtype=np.uint32 if self.bits > 16 else np.uint16)
        for p in reversed(range(self.bits)):
            on = np.concatenate([self._load(p, c) for c in range(self.chunks)]) if self.chunks else np.zeros(0, dtype=bool)
            z = int(self.zeros[p])
            back = np.empty_like(out)
            back[~on] = out[:z]
            back[on] = out[z:] | out.dtype.type(1 << (self.bits - 1 - p))
            out = back
        return out


# ---- encoding ----


@lru_cache(2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True  # a special token's name in a text is ordinary text
    return out


@lru_cache(2)
def id_bits(path: str) -> int:
    """Bits of the largest id of a vocabulary file."""
    return max(1, max(_tokenizer(path).get_vocab(with_added_tokens=True).values()).bit_length())


def _byte_names() -> list[str]:
    """The character by which byte-level BPE names each byte: itself where it is printable, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


@lru_cache(2)
def _word_model(path: str):
    """The model of the tokenizer file without its search for words, and the names of what a word may hold."""
    from tokenizers import Tokenizer

    names = _byte_names()
    # the letter that is itself part of other letters' names first
    letters = [0xC3, 32, *(c for c in range(0xC0, 0x100) if c != 0xC3)]
    return Tokenizer(_tokenizer(path).model), [(chr(c), "".join(names[b] for b in chr(c).encode())) for c in letters]


class PieceEncoder:
    """Ids of texts by the tokenizer file at ``path`` (byte-level BPE), each distinct piece encoded once in a while."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.path, self.remembered = path, remembered
        self.known: dict[str, int] = {}
        self.last: tuple[list[str], np.ndarray] = [], np.zeros(0, dtype=np.int64)
        self._forget()

    def _forget(self) -> None:
        """Keeps only what the last texts had."""
        if not self.known:
            self.sizes, self.pool = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint32)]
            return
        pieces, numbers = self.last
        self.known = dict(zip(pieces, range(len(pieces)), strict=True))
        kept = self._lists().take(pa.array(numbers))
        self.sizes, self.pool = [np.diff(np.asarray(kept.offsets, dtype=np.int64))], [np.asarray(kept.flatten())]

    def _lists(self) -> pa.LargeListArray:
        """The ids of all known pieces by their numbers."""
        self.sizes, self.pool = [np.concatenate(self.sizes)], [np.concatenate(self.pool)]
        return pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(self.sizes[0])]), pa.array(self.pool[0]))

    def _learn(self, pieces: list[str], encodings: list) -> None:
        """Number the pieces on and keep their ids."""
        start, ids = len(self.known), [e.ids for e in encodings]
        self.known.update(zip(pieces, range(start, start + len(pieces)), strict=True))
        self.sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
        self.pool.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(self.sizes[-1].sum())))

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """The number of each of different pieces, after the unknown ones were encoded."""
        found = list(map(self.known.get, pieces))
        at = [i for i, n in enumerate(found) if n is None]
        if at:
            new = pa.array([pieces[i] for i in at], pa.large_string())
            word = np.asarray(pc.match_substring_regex(new, _WORD))
            model, names = _word_model(self.path)
            start = len(self.known)
            words, others = new.filter(pa.array(word)).to_pylist(), new.filter(pa.array(~word)).to_pylist()
            for s in range(0, len(words), 20_000):
                part = words[s : s + 20_000]
                named = "\n".join(part)
                for letter, name in names:
                    named = named.replace(letter, name)
                self._learn(part, model.encode_batch_fast(named.split("\n"), add_special_tokens=False))
            for s in range(0, len(others), 20_000):
                part = others[s : s + 20_000]
                self._learn(part, _tokenizer(self.path).encode_batch_fast(part, add_special_tokens=False))
            fresh = np.empty(len(at), dtype=np.int64)
            fresh[word], fresh[~word] = start + np.arange(len(words)), start + len(words) + np.arange(len(others))
            for i, n in zip(at, fresh.tolist(), strict=True):
                found[i] = n
        return np.fromiter(found, np.int64, len(found))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        if len(self.known) > self.remembered:
            self._forget()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.asarray(pc.match_substring_regex(texts, _ODD))
        even = texts.filter(pa.array(~odd)) if odd.any() else texts
        cut = pc.replace_substring_regex(even, f"([{_LETTER}])([{_MARK}])", f"\\1{_BORDER}\\2")
        cut = pc.replace_substring_regex(cut, f"([^{_CLASS}])\n([^{_CLASS}])", f"\\1{_BORDER}\n{_BORDER}\\2")
        split = pc.split_pattern(pc.replace_substring(cut, " ", f"{_BORDER} "), _BORDER)
        coded = pc.dictionary_encode(split.values)
        pieces = coded.dictionary.to_pylist()
        own = self._numbers(pieces)
        self.last = pieces, own
        numbers = pa.array(own).take(coded.indices)
        counts = np.zeros(len(texts), dtype=np.int64)
        counts[~odd] = np.diff(np.asarray(split.offsets, dtype=np.int64))
        if odd.any():  # other white space beside a space: these texts are cut at the safe spaces alone
            rows = [_CUT.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
            counts[odd] = [len(r) for r in rows]
            of_odd = np.repeat(odd, counts)
            seq = np.empty(len(of_odd), dtype=np.int64)
            loose = [p for r in rows for p in r]
            place = {p: i for i, p in enumerate(dict.fromkeys(loose))}
            seq[~of_odd], seq[of_odd] = np.asarray(numbers), self._numbers(list(place))[[place[p] for p in loose]] if loose else 0
            numbers = pa.array(seq)
        taken = self._lists().take(numbers)
        upto = np.asarray(taken.offsets, dtype=np.int64)
        ends = np.cumsum(counts)
        return np.asarray(taken.values), upto[ends] - upto[ends - counts]


@lru_cache(2)
def _encoder(path: str) -> PieceEncoder:
    """A worker's encoder: what one task has learned serves the next."""
    return PieceEncoder(path)


# ---- files of a corpus ----


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI as Spark writes it."""
    for old, new in (("s3a://", "s3://"), ("s3n://", "s3://")):
        path = path.replace(old, new, 1) if path.startswith(old) else path
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def write_files(docs: DataFrame, tokenizer: str, folder: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = END_ID,
                shard_tokens: int = SHARD_TOKENS, partitions: int | None = None) -> DataFrame:
    """Encode ``docs`` into files of ``folder`` (in the shared folder unless named) in ascending order of the key.

    Returns the manifest, one row for each file in order: path, part, seq, n_docs, n_tokens, bytes, and ``start``, the ids
    of all files before it."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    bits = max(id_bits(tokenizer), int(end_id).bit_length())
    fs, at = opened(folder)
    fs.create_dir(at, recursive=True)
    kind = docs.schema[key].dataType
    arrow_kind = _arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get(), 0
        encoder = _encoder(tokenizer)
        held, keys, sizes, total = [], [], [], 0

        def close() -> pa.RecordBatch:
            path = f"{folder}/part-{task.partitionId():06d}-{seq:04d}-{task.taskAttemptId()}.lwm"
            fs, at = opened(path)
            table = pa.table({"key": pa.chunked_array(keys, arrow_kind), "n_tokens": np.concatenate(sizes)})
            ids = np.concatenate(held).astype(np.uint32 if bits > 16 else np.uint16)
            with fs.open_output_stream(at) as out:
                n = write_matrix(out, ids, bits, table)
            return pa.RecordBatch.from_pydict({"path": [path], "part": [task.partitionId()], "seq": [seq], "n_docs": [table.num_rows], "n_tokens": [len(ids)], "bytes": [n]}, schema=MANIFEST_ARROW)

        for batch in by_weight(batches, "text", 8_000_000):
            ids, counts = encoder.encode(batch.column("text"))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id)
            counts = counts + 1
            ends = np.cumsum(counts)
            i = 0
            while i < len(counts):  # up to the document that fills the shard
                before = ends[i - 1] if i else 0
                j = min(int(np.searchsorted(ends, before + shard_tokens - total)), len(counts) - 1) + 1
                held.append(ids[before : ends[j - 1]])
                keys.append(batch.column("key").slice(i, j - i))
                sizes.append(counts[i:j])
                total += int(ends[j - 1] - before)
                i = j
                if total >= shard_tokens:
                    yield close()
                    seq += 1
                    held, keys, sizes, total = [], [], [], 0
        if sizes:
            yield close()

    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(*[q.alias(n) for q, n in zip(quoted([key, text]), ("key", "text"), strict=True)])
    # the range bounds are sampled on the driver, so they are of hashes, not of texts
    by = [F.col("key").asc_nulls_first(), F.col("h").asc_nulls_first()]
    hashed = plain.withColumn("h", F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    ordered = hashed.repartitionByRange(parts, *by).sortWithinPartitions(*by, F.col("text"))
    found = stash(ordered.select("key", "text").mapInArrow(run, MANIFEST), "manifest")
    one = wide_running_sums(found, [], [F.col("part"), F.col("seq")], {"upto": "n_tokens"})
    return stash(one.select("path", "part", "seq", "n_docs", "n_tokens", "bytes", (F.col("upto") - F.col("n_tokens")).alias("start")), "manifest")


MANIFEST = "path string, part int, seq int, n_docs long, n_tokens long, bytes long"
MANIFEST_ARROW = pa.schema([("path", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("bytes", pa.int64())])


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def over_files(manifest: DataFrame, read: Callable[[TokenFile, int], pa.RecordBatch], schema: T.StructType | str) -> DataFrame:
    """Rows of ``read(file, start)`` for every file of the manifest, each file in a task of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, at = opened(path)
                with fs.open_input_file(at) as source:
                    yield read(TokenFile(source), start)

    files = manifest.select("path", "start")
    return files.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(run, schema)


def read_documents(manifest: DataFrame, key_type: T.DataType, with_ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, decoded from the files; ``with_ids`` adds its ids."""
    kind = _arrow_type(key_type)
    fields = [("key", kind), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int64()))] if with_ids else []
    out = T.StructType([T.StructField("key", key_type), *[T.StructField(n, T.LongType()) for n, _ in fields[1:4]]])
    if with_ids:
        out.add("ids", T.ArrayType(T.LongType()))

    def read(file: TokenFile, start: int) -> pa.RecordBatch:
        ids = file.ids().astype("<u4")
        raw, at = memoryview(ids).cast("B"), file.starts
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        cols = [file.docs.column("key").combine_chunks().cast(kind), pa.array(start + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())]
        if with_ids:
            cols.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int64))))
        return pa.RecordBatch.from_arrays(cols, schema=pa.schema(fields))

    return over_files(manifest, read, out)


def count_tokens(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): how often each of a few ids occurs, by two ranks a plane in every file."""
    tokens = sorted(set(tokens))

    def read(file: TokenFile, start: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"token": pa.array(tokens, pa.int64()), "n": pa.array([file.count(t) for t in tokens], pa.int64())})

    return over_files(manifest, read, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def find_tokens(manifest: DataFrame, tokens: list[int], key_type: T.DataType) -> DataFrame:
    """(token, key, place): every occurrence of a few ids, with its place in the corpus."""
    tokens = sorted(set(tokens))
    kind = _arrow_type(key_type)

    def read(file: TokenFile, start: int) -> pa.RecordBatch:
        at = [file.occurrences(t) for t in tokens]
        places = np.concatenate(at) if at else np.zeros(0, dtype=np.int64)
        doc = np.searchsorted(file.starts, places, side="right") - 1
        keys = file.docs.column("key").combine_chunks().take(pa.array(doc)).cast(kind)
        names = np.repeat(np.array(tokens, dtype=np.int64), [len(a) for a in at])
        return pa.RecordBatch.from_arrays([pa.array(names), keys, pa.array(places + start)], names=["token", "key", "place"])

    out = T.StructType([T.StructField("token", T.LongType()), T.StructField("key", key_type), T.StructField("place", T.LongType())])
    return over_files(manifest, read, out)


def token_file_path(spark: SparkSession) -> str:
    """The vocabulary file of the query: the session's ``loom.tokenizer``, else that of the public package."""
    named = spark.conf.get("loom.tokenizer", None)
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op11(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from its files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    manifest = write_files(docs, token_file_path(spark))
    return read_documents(manifest, docs.schema["doc_id"].dataType).withColumnRenamed("key", "doc_id")
