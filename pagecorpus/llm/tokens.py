"""Operator 4, token ids in frequency-ranked, byte-aligned variable-length coding.

Texts are encoded by a public tokenizer.  Ids are ranked by their frequency in the whole corpus
and the ranks are written with 1 to 4 bytes each, the least significant byte first; the lengths
(2 bits each, four to a control byte) stand apart from the data bytes, so that a block is decoded
by numpy table lookup without a loop over values.

File format: a folder of Parquet shards, one row for each block of at most about
``BLOCK_TOKENS`` tokens: shard number (ascending with doc_id), block number in the shard, ids
and token counts of the block's documents, the control bytes and the data bytes.  The rank table
(one row for each used id) stands beside them.  Parquet is the container since Spark writes it to
any shared store; the payload is decoded from the two byte strings alone.

The tokenizer cuts texts into words and encodes each alone, so a distinct word is encoded once by
the tokenizer's model and remembered in a table of bounded size.  Texts with other signs go to the
tokenizer in pieces that it cuts anyway, texts with unusual white space or special-token strings whole.

Defined results: a null text is empty and has only the end id; documents stand in ascending
doc_id order (nulls first), equal ids by text; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagecorpus.llm import common as C
from pagecorpus.llm.common import CodeTable
from pagecorpus.session import checkpoint_dir, materialize

END = 0
TARGET = 32 * C.MB
BLOCK_TOKENS = 1 << 15
#: Distinct words kept by a process before its table is emptied (about 40 bytes each).
CACHE_WORDS = 1_200_000
#: Text cut at a time.
CUT_BYTES = 1 << 19
#: Letters and signs that every Unicode version classes alike.
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(rf"[^ \n{_LETTERS}0-9{_SIGNS}]")
#: The tokenizer's own cut of such a text into words.
_WORD = re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+| ?[{_SIGNS}]+|[ \n]+(?![^ \n])|[ \n]+")
_PIECE = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
_UNUSUAL = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")


#: Kind of each byte of such a text: 0 space, 1 line feed, 2 letter, 3 digit, 4 sign.
_KIND = np.full(256, 4, np.uint8)
_KIND[[0x20, 0x0A]] = 0, 1
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 2
_KIND[0x30:0x3A] = 3
_BASE = 0x2545F4914F6CDD1D
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0 to n of the hash base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) <= n:
        for i, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 18) + 1, x, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def cut_words(a: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the words that the tokenizer's pattern (``_WORD``) cuts out of the bytes of plain
    texts that begin at the places ``first``: a space goes with the run of letters, digits or signs after
    it, all but the last white space before a word stand together, and a line feed alone."""
    kind = _KIND[a]
    white = kind < 2
    before = np.empty(len(a), np.uint8)
    before[1:] = kind[:-1]
    after_white = np.empty(len(a), bool)
    after_white[1:] = white[:-1]
    after_white[first] = False
    solid_next = np.zeros(len(a), bool)
    solid_next[:-1] = ~white[1:]
    solid_next[first[1:] - 1] = False  # the next text's
    start = np.where(white, ~after_white | solid_next, np.where(after_white, before == 1, kind != before))
    start[first] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of whole texts, equal to ``encode(text, add_special_tokens=False)``.

    The tokenizer cuts a text into words and encodes each alone.  Plain texts (letters, digits, signs,
    spaces and line feeds that every Unicode version classes alike) are cut with whole arrays, and each
    distinct word, named by a 64-bit hash, is encoded once by the tokenizer's model and kept in a table of
    bounded size.  In other texts, pieces of white space and what follows it go to the tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        #: Two bytes for each id if the vocabulary allows it.
        self.type = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        cut = ByteLevel(add_prefix_space=False, use_regex=False)
        # bytes as the vocabulary writes them
        self.letters = str.maketrans({chr(b): cut.pre_tokenize_str(chr(b))[0][0] for b in range(128)})
        for b in range(128, 0xE0):  # second bytes of two-byte characters, and their first bytes
            two = cut.pre_tokenize_str(chr(0x80 + (b & 0x3F)) if b < 0xC0 else chr(max(0x80, (b & 0x1F) << 6)))[0][0]
            self.letters[b] = two[1] if b < 0xC0 else two[0]
        self.clear()

    def clear(self) -> None:
        self.table = CodeTable(1 << 18)
        self.flat, self.used = np.empty(1 << 20, self.type), 0
        self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int32)

    def word(self, piece: bytes) -> list[int]:
        """Ids of one plain word: the tokenizer's model alone, without its cutting."""
        return [t.id for t in self.tok.model.tokenize(piece.decode("latin-1").translate(self.letters))]

    def learn(self, codes: np.ndarray, pieces: list[bytes]) -> None:
        ids = [self.word(p) for p in pieces]
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        new = np.fromiter((i for x in ids for i in x), self.type, int(sizes.sum()))
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used:self.used + len(new)] = new
        self.starts = np.concatenate([self.starts, (self.used + np.cumsum(sizes) - sizes).astype(np.int32)])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used += len(new)
        self.table.add(codes)

    def plain(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of plain texts, none of them empty."""
        if len(self.sizes) > CACHE_WORDS:
            self.clear()
        a = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        first = np.concatenate([[0], ends[:-1]])
        start = cut_words(a, first)
        stop = np.append(start[1:], len(a))
        power, inverse = _powers(len(a))
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[:len(a)], out=sums[1:])
        codes = C.mix64((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64))
        at = self.table.find(codes)
        new, where = np.unique(codes[at < 0], return_index=True)
        if len(new):
            where = np.flatnonzero(at < 0)[where]
            whole = a.tobytes()
            self.learn(new, [whole[i:j] for i, j in zip(start[where].tolist(), stop[where].tolist(), strict=True)])
            at = self.table.find(codes)
        n = self.sizes[at].astype(np.int64)
        ids = self.flat[C.concat_ranges(self.starts[at].astype(np.int64), n)]
        per = np.add.reduceat(n, np.searchsorted(start, first))
        return np.split(ids, np.cumsum(per)[:-1])

    def other(self, text: str) -> np.ndarray:
        whole = _UNUSUAL.search(text) or any(s in text for s in self.special)
        pieces = [text] if whole else _PIECE.findall(text)
        return np.array([i for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False) for i in e.ids], self.type)

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        held: list[int] = []
        size = 0

        def flush():
            for i, x in zip(held, self.plain([texts[i].encode() for i in held]), strict=True):
                out[i] = x
        for i, t in enumerate(texts):
            if not t:
                out[i] = np.empty(0, self.type)
            elif _PLAIN.search(t) or any(s in t for s in self.special):
                out[i] = self.other(t)
            else:
                held.append(i)
                size += len(t)
                if size > CUT_BYTES:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def drop_encoders() -> None:
    """Give back the encoders' tables.  Workers are reused: what one task after another of the encoding stage
    shares would else stay through all later stages of a session."""
    if _ENCODERS:
        _ENCODERS.clear()
        _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
        C.release()


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    return public_tokenizers.path(name)


# ---- the byte coding -------------------------------------------------------------------------
#: Lengths of the four values that a control byte describes.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint64)


def encode_values(v: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    most = int(v.max()) if len(v) else 0
    width = 2 if most <= 0xFFFF else 4
    v = v.astype(f"<u{width}")
    extra = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    extra[:len(v)] = v > 0xFF
    if width > 2:
        extra[:len(v)] += (v > 0xFFFF).view(np.uint8) + (v > 0xFFFFFF).view(np.uint8)
    control = extra[0::4] | extra[1::4] << 2 | extra[2::4] << 4 | extra[3::4] << 6
    used = np.arange(width, dtype=np.uint8) <= extra[:len(v), None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, width)[used].tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    width = int(lengths.max()) if n else 1
    d = np.frombuffer(data + b"\0\0\0", np.uint8)
    runs = d[:len(data)].astype(np.uint16 if width <= 2 else np.uint32)  # the bytes from each place on as one number
    for j in range(1, width):
        runs |= d[j:len(data) + j].astype(runs.dtype) << runs.dtype.type(8 * j)
    return (runs[at] & _MASKS.astype(runs.dtype)[lengths]).astype(np.uint32)


# ---- writing ---------------------------------------------------------------------------------
_BLOCK = "shard int, block int, doc_ids binary, counts binary, ids binary"
_BLOCK_COLUMNS = [c.split()[0] for c in _BLOCK.split(", ")]
_NULL = np.iinfo(np.int64).min


_SQUEEZE, _RESTORE = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _narrow(ids: np.ndarray) -> bytes:
    """Ids in 2 (or 4) bytes each, compressed; the last byte tells which."""
    wide = ids.itemsize > 2 and len(ids) > 0 and ids.max() > 0xFFFF
    return _SQUEEZE.compress(ids.astype("<u4" if wide else "<u2").tobytes()) + (b"4" if wide else b"2")


def _wide(b: bytes) -> np.ndarray:
    return np.frombuffer(_RESTORE.decompress(b[:-1]), "<u4" if b[-1:] == b"4" else "<u2")


def encoded(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """Blocks of ids in ascending doc_id order.  Text is encoded where it is read; only
    compressed ids are shuffled."""
    d = docs.select("doc_id", "text")
    cuts = C.id_cuts(d, C.blocks_for(C.total_bytes(d), TARGET))
    n = len(cuts) + 2

    def run(batches):
        enc = encoder(path)
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            ids = [_narrow(np.append(x, x.dtype.type(end))) for x in enc.texts(texts)]
            yield pd.DataFrame({"shard": C.buckets_of(pdf["doc_id"], cuts), "doc_id": pdf["doc_id"].astype("Int64"), "tie": texts_hash(texts), "ids": ids})
        C.release()

    def blocks(batches):
        drop_encoders()
        held: list = []
        size, shard, block = 0, None, 0

        def flush():
            return (shard, block, np.array([h[0] for h in held], "<i8").tobytes(), np.array([len(h[1]) for h in held], "<i8").tobytes(),
                    _narrow(np.concatenate([h[1] for h in held])))
        for pdf in batches:
            done = []
            for s, doc_id, b in zip(pdf["shard"], pdf["doc_id"], pdf["ids"], strict=True):
                x = _wide(b)
                if held and (s != shard or size + len(x) > BLOCK_TOKENS):
                    done.append(flush())
                    block, held, size = (block + 1 if s == shard else 0), [], 0
                shard = s
                held.append((_NULL if pd.isna(doc_id) else int(doc_id), x))
                size += len(x)
            if done:
                yield pd.DataFrame(done, columns=_BLOCK_COLUMNS)
        if held:
            yield pd.DataFrame([flush()], columns=_BLOCK_COLUMNS)
        C.release()
    rows = d.mapInPandas(run, "shard int, doc_id long, tie string, ids binary")
    return (rows.repartition(n, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "tie")
            .mapInPandas(blocks, _BLOCK))


def texts_hash(texts: list[str]) -> list[str]:
    """Order among rows of the same id: the head of the text and a hash of all of it."""
    import xxhash

    return [xxhash.xxh64_hexdigest(t.encode("utf-8", "surrogatepass")) for t in texts]


def rank_table(blocks: DataFrame) -> DataFrame:
    """(id, n, rank): ids by falling frequency in the whole corpus, equal ones by id."""
    def run(batches):
        total: dict[int, int] = {}
        for pdf in batches:
            for b in pdf["ids"]:
                c = np.bincount(_wide(b))
                for i in np.flatnonzero(c):
                    total[int(i)] = total.get(int(i), 0) + int(c[i])
        yield pd.DataFrame({"id": list(total), "n": list(total.values())}, dtype="int64")
    counts = blocks.select("ids").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # bounded by the vocabulary
    return counts.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).cast("int"))


def write(docs: DataFrame, out: str, path: str | None = None, end: int = END) -> None:
    """Write the token files of ``docs`` (doc_id, text) under ``out``: ``ranks`` and ``blocks``."""
    blocks = materialize(encoded(docs, path or tokenizer_path(), end), "token_blocks")
    table = rank_table(blocks)
    table.write.mode("overwrite").parquet(f"{out}/ranks")
    got = docs.sparkSession.read.parquet(f"{out}/ranks").select("id", "rank").collect()  # at most the vocabulary
    rank = np.zeros(max([r["id"] for r in got], default=0) + 1, np.uint32)
    for r in got:
        rank[r["id"]] = r["rank"]

    def code(batches):
        drop_encoders()
        for pdf in batches:
            made = [encode_values(rank[_wide(x)]) for x in pdf["ids"]]
            yield pdf[["shard", "block", "doc_ids", "counts"]].assign(control=[m[0] for m in made], data=[m[1] for m in made])
        C.release()
    (blocks.mapInPandas(code, "shard int, block int, doc_ids binary, counts binary, control binary, data binary")
     .write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/blocks"))


def read(spark, out: str) -> DataFrame:
    """Per document, decoded from the files: doc_id, start, n_tokens, ids_crc32."""
    ranks = spark.read.parquet(f"{out}/ranks").select("id", "rank").collect()  # at most the vocabulary
    ids = np.zeros(len(ranks), "<u4")
    for r in ranks:
        ids[r["rank"]] = r["id"]
    files = spark.read.parquet(f"{out}/blocks")

    def decode(batches):
        drop_encoders()
        for pdf in batches:
            out: list = []
            for s, b, doc_ids, counts, control, data in pdf[["shard", "block", "doc_ids", "counts", "control", "data"]].itertuples(index=False):
                d, n = np.frombuffer(doc_ids, "<i8"), np.frombuffer(counts, "<i8")
                x = ids[decode_values(control, data, int(n.sum()))]
                ends = np.cumsum(n)
                out.extend((s, b, i, e - k, k, zlib.crc32(x[e - k:e])) for i, e, k in zip(d.tolist(), ends.tolist(), n.tolist(), strict=True))
            made = pd.DataFrame(out, columns=["shard", "block", "doc_id", "within", "n_tokens", "ids_crc32"])
            made["doc_id"] = made["doc_id"].astype("Int64").mask(made["doc_id"] == _NULL)
            yield made

    def size(batches):
        for pdf in batches:
            yield pd.DataFrame({"shard": pdf["shard"], "block": pdf["block"], "n": [int(np.frombuffer(c, "<i8").sum()) for c in pdf["counts"]]})
    sizes = files.select("shard", "block", "counts").mapInPandas(size, "shard int, block int, n long")
    per_shard = sizes.groupBy("shard").agg(F.sum("n").alias("n"))  # a row for each shard
    shards = per_shard.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s0"))
    blocks = sizes.select("shard", "block", F.coalesce(F.sum("n").over(
        Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b0"))
    at = blocks.join(shards, "shard").select("shard", "block", (F.col("s0") + F.col("b0")).alias("b_start"))
    rows = files.mapInPandas(decode, "shard int, block int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return (rows.join(at, ["shard", "block"])
            .select("doc_id", (F.col("b_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"))


def token_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the token files to the shared folder and read them back."""
    import uuid

    out = f"{checkpoint_dir(docs.sparkSession)}/tokens/{uuid.uuid4().hex}"
    write(docs, out, path)
    return read(docs.sparkSession, out)
