"""Token-ID output: fixed-width bit packing with block offsets.

File image (little endian)::

    magic b"BPK1" | bits u32 | n_docs u64 | n_tokens u64 | block u64 | bytes_per_block u64
    doc_id i64[n_docs] | doc_end u64[n_docs] | block_at u64[n_blocks + 1] | packed blocks

Every id takes ``bits`` = the fewest bits that hold the largest id of the vocabulary. Ids are packed in blocks of
``block`` ids; ``block_at`` holds each block's byte offset in the payload, so any range of ids is read by unpacking only
the blocks it touches, with numpy and without a loop over ids.

On a cluster the images are rows of a Parquet table (part, image, n_tokens, payload): Spark's commit protocol makes a
retried or speculative task leave exactly one copy, and any file system that Spark reads will do.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.store import new_path
from arbora.llm.words import powers, span_hashes

MAGIC, BLOCK, IMAGE_TOKENS = b"BPK1", 65536, 4_000_000
_HEAD = struct.Struct("<4sIQQQQ")
END_ID = 0


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in ``bits`` bits each, lowest bit first."""
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id doesn't fit in {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits((ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1 != 0, bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    if bits in (8, 16, 32):
        return raw[: n * bits // 8].view(f"<u{bits // 8}").astype(np.uint32)
    flags = np.unpackbits(raw, count=n * bits, bitorder="little").reshape(n, bits)
    return flags.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def write_image(doc_ids: list[int], counts: list[int], ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    """One file: the documents' ids, in the order given."""
    block += -block % 8  # a block ends on a whole byte
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    at = np.cumsum([0, *map(len, blocks)], dtype="<u8")
    head = _HEAD.pack(MAGIC, bits, len(doc_ids), len(ids), block, block * bits // 8)
    return b"".join([head, np.array(doc_ids, "<i8").tobytes(), np.cumsum(counts, dtype="<u8").tobytes(), at.tobytes(), *blocks])


class Image:
    """Reads a file image; ``ids(a, b)`` unpacks only the blocks that hold ids a to b."""

    def __init__(self, data: bytes) -> None:
        magic, self.bits, docs, self.n_tokens, self.block, _ = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a packed token file")
        self.data, at = memoryview(data), _HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.doc_end = np.frombuffer(data, "<u8", docs, at + 8 * docs).astype(np.int64)
        blocks = -(-self.n_tokens // self.block)
        self.block_at = np.frombuffer(data, "<u8", blocks + 1, at + 16 * docs).astype(np.int64)
        self.payload = at + 16 * docs + 8 * (blocks + 1)

    def ids(self, start: int, end: int) -> np.ndarray:
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        out = np.empty(end - start, np.uint32)
        for k in range(first, last + 1):  # block by block: unpacking takes several times a block's ids
            base = k * self.block
            a, b = max(start, base), min(end, base + self.block)
            part = unpack(self.data[self.payload + self.block_at[k] : self.payload + self.block_at[k + 1]], min(self.block, self.n_tokens - base), self.bits)
            out[a - start : b - start] = part[a - base : b - base]
        return out

    def doc(self, k: int) -> np.ndarray:
        return self.ids(int(self.doc_end[k - 1]) if k else 0, int(self.doc_end[k]))


# --- encoding whole texts -------------------------------------------------------------------------------------------

_L, _N, _O, _S, _ODD = range(5)
_FAST = 0x3000  # code points above go to the library with their whole text


class Encoder:
    """Encodes texts with the tokenizers library, calling it once for each distinct pre-token.

    Byte-level BPE works within pre-tokens, so a text's ids are its pre-tokens' ids in a row. The texts are cut into
    pre-tokens with numpy; each code point's class comes from the library's own pre-tokenizer. A text with a code point
    from U+3000 or with an added token's string goes to the library as a whole, as do all texts of another tokenizer
    than a plain byte-level one.
    """

    KEEP = 2_000_000  # distinct pre-tokens kept by a worker; then it starts anew

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.vocabulary = self.tok.get_vocab_size(with_added_tokens=True)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        pre = self.tok.pre_tokenizer
        plain = isinstance(pre, pre_tokenizers.ByteLevel) and not pre.add_prefix_space and pre.use_regex
        self.classes = self._classes(pre) if plain and self.tok.normalizer is None else None
        self._forget()

    def _classes(self, pre) -> np.ndarray:  # noqa: ANN001
        out = np.full(_FAST + 1, _ODD, np.uint8)
        for c in range(_FAST):
            kinds = [k for k, before in ((_L, "a"), (_N, "1"), (_O, "!")) if len(pre.pre_tokenize_str(before + chr(c))) == 1]
            spaces = not kinds and len(pre.pre_tokenize_str(" " + chr(c))) == 1
            out[c] = kinds[0] if len(kinds) == 1 else _S if spaces else _ODD
        return out

    def _forget(self) -> None:
        self.keys, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, and their rows
        self.size, self.used = np.zeros(1 << 16, np.int64), 0
        self.at = np.zeros(1 << 16, np.int64)
        self.flat, self.filled = np.zeros(1 << 18, np.uint32), 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        if self.classes is None:
            parts = self.whole(texts)
            return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), np.array([len(p) for p in parts], np.int64)
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) for t in texts], np.int64)
        edge = np.concatenate([[0], np.cumsum(lengths)])
        kind = self.classes[np.minimum(codes, _FAST)]
        odd = np.add.reduceat(np.append(kind == _ODD, False).astype(np.int64), edge[:-1]) * (lengths > 0) > 0 if len(texts) else np.zeros(0, bool)
        for word in self.added:
            if word in joined:
                odd |= np.array([word in t for t in texts])
        if odd.any():
            slow = iter(self.whole([t for t, o in zip(texts, odd, strict=True) if o]))
            ids, counts = self.encode([t for t, o in zip(texts, odd, strict=True) if not o])
            fast = iter(np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else [])
            parts = [next(slow) if o else next(fast) for o in odd]
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        start = np.flatnonzero(self._starts(codes, kind, edge, joined))
        keys, inverse = np.unique(span_hashes(codes.astype(np.uint64) + np.uint64(1), start, np.append(start[1:], len(codes))), return_inverse=True)
        rows = self._rows(keys, inverse, start, joined)[inverse]
        n, at = self.size[rows], self.at[rows]
        ends = np.cumsum(n)
        ids = self.flat[np.arange(ends[-1]) + np.repeat(at - (ends - n), n)]
        bounds = np.concatenate([[0], ends])[np.searchsorted(start, edge)]
        return ids, np.diff(bounds)

    def _starts(self, codes: np.ndarray, kind: np.ndarray, edge: np.ndarray, joined: str) -> np.ndarray:
        """Where a pre-token starts."""
        fresh = np.ones(len(codes), bool)
        fresh[1:] = kind[1:] != kind[:-1]
        heads = edge[:-1][edge[:-1] < len(codes)]
        fresh[heads] = True
        head = np.zeros(len(codes), bool)
        head[heads] = True
        space = kind == _S
        start = fresh.copy()
        run = np.flatnonzero(fresh[1:] & ~head[1:] & space[:-1]) + 1  # other characters after white space
        start[run - 1] = True
        start[run] = codes[run - 1] != 32
        for i in np.flatnonzero((codes == 39) & start).tolist():
            to = int(edge[np.searchsorted(edge, i, side="right")])
            two = joined[i + 1 : min(i + 3, to)]
            n = 2 if two[:1] in ("s", "t", "m", "d") and two else 3 if two in ("re", "ve", "ll") else 0
            if n:
                start[i + 1 : i + n] = False
                if i + n < to:
                    start[i + n] = True
        return start

    def _rows(self, keys: np.ndarray, inverse: np.ndarray, start: np.ndarray, joined: str) -> np.ndarray:
        """Row of each distinct pre-token in the table of known ones."""
        if len(self.keys) + len(keys) > self.KEEP:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != keys
        if new.any():
            where = np.zeros(len(keys), np.int64)
            where[inverse] = np.arange(len(inverse))
            end = np.append(start[1:], len(joined))
            places = where[new]
            ids = self.whole([joined[a:b] for a, b in zip(start[places].tolist(), end[places].tolist(), strict=True)])
            flat, n = np.concatenate(ids), np.array([len(x) for x in ids], np.int64)
            to = self.used + len(n)
            while to > len(self.size):
                self.size, self.at = np.resize(self.size, 2 * len(self.size)), np.resize(self.at, 2 * len(self.at))
            while self.filled + len(flat) > len(self.flat):
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            self.size[self.used : to], self.at[self.used : to] = n, self.filled + np.cumsum(n) - n
            self.flat[self.filled : self.filled + len(flat)] = flat
            self.keys, self.row = np.insert(self.keys, at[new], keys[new]), np.insert(self.row, at[new], np.arange(self.used, to))
            self.used, self.filled = to, self.filled + len(flat)
            at = np.searchsorted(self.keys, keys)
        return self.row[at]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def groups(texts: list[str], limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` characters."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield first, k
            first, size = k, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


# --- tables of images -----------------------------------------------------------------------------------------------

_IMAGES = "image long, first_id long, n_docs long, n_tokens long, payload binary"


def _imager(resolve: Callable[[], str], end_id: int, image_tokens: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def images(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(resolve())
        bits, held, number = bits_for(enc.vocabulary), [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, number
            doc_ids = [x for part in held for x in part[0]]
            counts = np.concatenate([part[1] for part in held])
            ids = np.concatenate([part[2] for part in held])
            out = pa.RecordBatch.from_pydict({"image": pa.array([number], pa.int64()), "first_id": pa.array(doc_ids[:1], pa.int64()), "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_tokens": pa.array([len(ids)], pa.int64()), "payload": pa.array([write_image(doc_ids, counts.tolist(), ids, bits)], pa.binary())})
            held, number = [], number + 1
            return out

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).fill_null("").to_pylist()
            for a, b in groups(texts):
                ids, counts = enc.encode(texts[a:b])
                ends = np.cumsum(counts + 1)
                out = np.full(len(ids) + b - a, end_id, np.uint32)
                keep = np.ones(len(out), bool)
                keep[ends - 1] = False
                out[keep] = ids
                held.append((doc_ids[a:b], counts + 1, out))
                if sum(len(x[2]) for x in held) >= image_tokens:
                    yield flush()
        if held:
            yield flush()

    return images


def public_tokenizer(name: str) -> Callable[[], str]:
    """Finds a public tokenizer's file on whichever machine runs the task."""

    def resolve() -> str:
        import public_tokenizers

        return public_tokenizers.path(name)

    return resolve


def write_token_files(docs: DataFrame, resolve: Callable[[], str], path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, image_tokens: int = IMAGE_TOKENS) -> str:
    """Encode every whole text, append ``end_id`` to each, and write images in ascending order of id under ``path``.

    One range shuffle by id orders the documents; each task encodes its range and writes one image after the other, so
    a task holds one image at most. Null texts count as empty: their document is the end id alone. A null id comes
    first and is written as the least 64-bit integer. Rows with equal ids each keep their ids, ordered by text. An empty
    table writes no image. ``resolve`` gives the tokenizer file's path on the executor.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(key.alias("doc_id"), F.col(text_col).cast("string").alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    made = ordered.mapInArrow(_imager(resolve, end_id, image_tokens), _IMAGES)
    made.select(F.spark_partition_id().alias("part"), "*").write.parquet(path)
    return path


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        for part, image, payload in zip(*(batch.column(names.index(c)) for c in ("part", "image", "payload")), strict=True):
            file = Image(payload.as_py())
            n, ids = len(file.doc_ids), file.ids(0, file.n_tokens)
            begin = np.concatenate([[0], file.doc_end[:-1]]) if n else file.doc_end
            crc = [zlib.crc32(ids[a:b].astype("<u4").data) for a, b in zip(begin.tolist(), file.doc_end.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"part": pa.array([part.as_py()] * n, pa.int32()), "image": pa.array([image.as_py()] * n, pa.int64()), "doc_id": pa.array(file.doc_ids), "begin": pa.array(begin), "n_tokens": pa.array(file.doc_end - begin), "ids_crc32": pa.array(crc, pa.int64())})


def read_token_digests(spark, path: str) -> DataFrame:  # noqa: ANN001
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Images' starts come from their sizes alone (the payload column isn't read for that): first the sizes of the parts,
    one row for each write task, then a window over the images of each part.
    """
    from pyspark.sql import Window

    schema = f"part int, {_IMAGES}"
    files = spark.read.schema(schema).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.withColumn("base", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", F.coalesce("base", F.lit(0)).alias("base"))
    inner = Window.partitionBy("part").orderBy("image").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "image", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)).alias("within")).join(before, "part")
    docs = files.select("part", "image", "payload").mapInArrow(_read, "part int, image long, doc_id long, begin long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "image"]).select("doc_id", (F.col("base") + F.col("within") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def read_range(spark, path: str, start: int, end: int) -> np.ndarray:  # noqa: ANN001
    """Ids start to end of the whole collection; only the images that hold them are fetched, one after the other.

    A range beyond the collection gives what there is of it; an empty collection gives nothing.
    """
    files = spark.read.schema(f"part int, {_IMAGES}").parquet(path)
    at, wanted = 0, []
    for row in files.select("part", "image", "n_tokens").orderBy("part", "image").toLocalIterator():
        if max(start, at) < min(end, at + row.n_tokens):
            wanted.append((row.part, row.image, at))
        at += row.n_tokens
        if at >= end:
            break
    if not wanted:
        return np.zeros(0, np.uint32)
    place = F.struct("part", "image")
    low, high = (F.struct(F.lit(p).alias("part"), F.lit(i).cast("long").alias("image")) for p, i, _ in (wanted[0], wanted[-1]))
    images = files.filter((place >= low) & (place <= high)).orderBy("part", "image").select("payload").toLocalIterator()
    parts = []
    for (_, _, begin), row in zip(wanted, images, strict=True):
        image = Image(bytes(row.payload))
        parts.append(image.ids(max(start - begin, 0), min(end - begin, image.n_tokens)))
    return np.concatenate(parts)


def token_digests(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read the digests back from them."""
    spark = docs.sparkSession
    return read_token_digests(spark, write_token_files(docs, public_tokenizer(tokenizer), new_path(spark, "tokens")))
