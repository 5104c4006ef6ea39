"""Operator 13, alignment of two tokenizers' tokens by an associative fragment monoid.

A fragment describes a byte range of a document: an open prefix (tokens up to the first offset where
tokens of both tokenizers end), closed groups, and an open suffix (tokens after the last such offset).
Two neighbours compose by cutting the left one's suffix and the right one's prefix at the offsets
where both end, so composition is associative and any tree of it gives the groups of the document.

Short documents are composed where they are read.  Their smallest fragments are words with the white
space before them: both tokenizers end a token at a word's end, so these have no open parts, and a
distinct word is encoded once.  A long document is cut into byte ranges, for each tokenizer at the
first place where its tokens cannot cross: the ranges of the two differ, which leaves open parts.
Its chunks are spread over the tasks and their fragments composed level by level, ``FAN`` at a time.

Counts of linked id pairs need all documents.  Documents stand in blocks of bounded size with a
dictionary of their words' links; the blocks' pair counts are summed over the corpus, joined to the
best count of their B id, and go back to the blocks that hold them.

Defined results: null and empty texts, and texts whose joined tokens differ from space and text, have
no tokens (zeros, empty digest); rows that repeat are documents of their own; ties for the best count
are all best; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecorpus.llm import common as C
from pagecorpus.session import materialize

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Documents of more bytes are cut into chunks of about this size.
CHUNK = 256 << 10
#: Fragments that are composed at a time.
FAN = 16
#: Text of a block, and distinct words that a task remembers, in bytes and words.
BLOCK = 16 * C.MB
CACHE_WORDS = 400_000
#: Text worked on at a time.
BATCH = C.MB

_WORDS = re.compile(r"(?<=[!-~\w])(?=[ \n])")
_SAFE_END = re.compile(r"[!-~\w]\Z")
#: Words that are encoded at a time as one text, and the first sign that sends a word through the whole tokenizer.
JOINED = 2000
_OTHER = "\u0250"
#: Before white space, and between a letter and a sign: tokens of A never cross these.
_A_CUTS = re.compile(r"(?<=[!-~\w])(?=[ \n])|(?<=[^\W\d_])(?=[!-&(-/:-@\[-`{-~、。，！？])")

Tokens = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # ids and byte ends of A, of B


class Coders:
    """The two tokenizers, and the bytes of their ids."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        # byte-level entries: visible signs stand for their byte, the others for signs from 256 on, in order
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(sorted(set(range(256)) - set(shown)))}
        entries = self.a.get_vocab()
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(byte_of.get(x, 0) for x in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.quick_a = self._ranked(entries)
        self.a_len, self.b_len = (np.array([len(x) for x in xs], np.int64) for xs in (self.a_bytes, self.b_bytes))
        #: Neighbouring signs of B's pieces; its tokens never cross any other two.
        self.pairs = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}

    def _ranked(self, entries: dict[str, int]):
        """A's merges as ranks, a faster form of the same; None if its ids do not stand in the order of its merges."""
        import json

        import tiktoken

        spec = json.loads(self.a.to_str())
        merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
        ids = [entries.get(m.replace(" ", ""), -1) for m in merges]
        level = spec.get("pre_tokenizer") or {}
        if ids != sorted(ids) or (level.get("type"), level.get("use_regex", True), level.get("add_prefix_space")) != ("ByteLevel", True, False) or spec.get("normalizer"):
            return None
        ranks = {self.a_bytes[i]: i for i in {*ids, *(i for e, i in entries.items() if len(e) == 1)}}
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode_joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of A and of B of words that end where tokens of both end, and the number of each word's;
        None if the words' bytes are not those of the tokens."""
        out, raws = ([], []), [w.encode() for w in words]
        for i in range(0, len(words), JOINED):
            text = "".join(words[i:i + JOINED])
            a, b = self.quick_a.encode_ordinary(text), self.b.encode("\n" + text, num_threads=1)[2:]
            if not b"".join(map(self.a_bytes.__getitem__, a)) == b"".join(map(self.b_bytes.__getitem__, b)) == text.encode():
                return None
            out[0].append(np.array(a, np.int64))
            out[1].append(np.array(b, np.int64))
        ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)))
        a, b = (np.concatenate(x) for x in out)
        return a, *(np.diff(np.searchsorted(np.cumsum(lens[ids]), ends, "right"), prepend=0) for ids, lens in ((a, self.a_len), (b, self.b_len))), b

    def encode(self, a_texts: list[str], b_texts: list[str]) -> tuple[list, list]:
        """Ids of each text by A, and of each by B as the middle of a longer text."""
        a = [e.ids for e in self.a.encode_batch_fast(a_texts, add_special_tokens=False)]
        # a line break never merges, so what follows it is encoded as it is; the space that B adds goes with it
        return a, [x[2:] for x in self.b.encode(["\n" + t for t in b_texts], num_threads=1)]

    def same(self, text: str, a: list[int], b: list[int]) -> bool:
        """Whether both tokens' bytes are the text's."""
        raw = text.encode()
        return b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw


def _join(xs: Iterator[list], lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids = np.fromiter((i for x in xs for i in x), np.int64)
    return ids, np.cumsum(lens[ids]) if len(ids) else ids


def commons(t: Tokens) -> np.ndarray:
    """Offsets where tokens of both end."""
    return np.intersect1d(t[1], t[3], assume_unique=True)


def _until(t: Tokens, end: int) -> tuple[Tokens, Tokens]:
    """Tokens that end up to an offset, and the others."""
    i, j = np.searchsorted(t[1], end, "right"), np.searchsorted(t[3], end, "right")
    return (t[0][:i], t[1][:i], t[2][:j], t[3][:j]), (t[0][i:], t[1][i:], t[2][j:], t[3][j:])


def _after(x: Tokens, y: Tokens) -> Tokens:
    return tuple(np.concatenate(p) for p in zip(x, y))


_NO = np.empty(0, np.int64)
EMPTY: Tokens = (_NO, _NO, _NO, _NO)


def pack_tokens(t: Tokens) -> bytes:
    return C.pack(np.concatenate([np.array([len(t[0])], np.int64), *t]))


def unpack_tokens(b: bytes) -> Tokens:
    x = C.unpack(b, np.int64)
    n, rest = int(x[0]), x[1:]
    m = (len(rest) - 2 * n) // 2
    return rest[:n], rest[n:2 * n], rest[2 * n:2 * n + m], rest[2 * n + m:]


def pack_groups(t: Tokens) -> bytes:
    """Closed groups; the tokens end in a common offset."""
    ends = commons(t)
    return C.pack(np.concatenate([np.array([len(ends), len(t[0])], np.int32),
                                  *(np.diff(np.searchsorted(x, ends, "right"), prepend=0).astype(np.int32) for x in (t[1], t[3])),
                                  t[0].astype(np.int32), t[2].astype(np.int32)]))


def unpack_groups(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of A, their number in each group, ids of B, their number in each group."""
    x = C.unpack(b, np.int32)
    g, n = int(x[0]), int(x[1])
    a, b_ids = x[2 + 2 * g:2 + 2 * g + n], x[2 + 2 * g + n:]
    return a, x[2:2 + g], b_ids, x[2 + g:2 + 2 * g]


class Fragment:
    """An element of the monoid.  ``open`` means that no offset is common: all tokens stand in the head."""

    def __init__(self, head: Tokens, closed: list[bytes], tail: Tokens, is_open: bool, ok: bool = True):
        self.head, self.closed, self.tail, self.open, self.ok = head, closed, tail, is_open, ok

    @classmethod
    def of(cls, t: Tokens, ok: bool = True) -> Fragment:
        ends = commons(t)
        if not len(ends):
            return cls(t, [], EMPTY, True, ok)
        head, rest = _until(t, ends[0])
        closed, tail = _until(rest, ends[-1])
        return cls(head, [pack_groups(closed)] if len(ends) > 1 else [], tail, False, ok)

    def then(self, right: Fragment) -> Fragment:
        """This fragment followed by ``right``."""
        ok = self.ok and right.ok
        mid = Fragment.of(_after(self.head if self.open else self.tail, right.head), ok)
        if mid.open:  # no offset is common at the seam; then one side at least is open
            if self.open:
                return Fragment(mid.head, right.closed, right.tail, right.open, ok)
            return Fragment(self.head, self.closed, mid.head, False, ok)
        # the groups that the seam closes; its first one belongs to the head where nothing was closed before
        if self.open:
            return Fragment(mid.head, mid.closed + right.closed, mid.tail if right.open else right.tail, False, ok)
        closed = self.closed + [pack_groups(mid.head)] + mid.closed
        return Fragment(self.head, closed + right.closed, mid.tail if right.open else right.tail, False, ok)

    def pieces(self) -> list[bytes]:
        """All groups of a whole document, in order."""
        return [pack_groups(self.head), *self.closed]


def group_text(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> list[str]:
    """Each group as ``a1,a2|b1``."""
    sa, sb = list(map(str, a.tolist())), list(map(str, b.tolist()))
    out, i, j = [], 0, 0
    for x, y in zip(na.tolist(), nb.tolist()):
        if x == 1 and y == 1:
            out.append(f"{sa[i]}|{sb[j]}")
        else:
            out.append(f"{','.join(sa[i:i + x])}|{','.join(sb[j:j + y])}")
        i, j = i + x, j + y
    return out


def link_codes(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The id pair that closes each group: no token is empty, so one of each ends at a common offset."""
    return a[np.cumsum(na) - 1].astype(np.int64) << 16 | b[np.cumsum(nb) - 1].astype(np.int64)


class _Words:
    """Links and group texts of the distinct words that a task has met."""

    def __init__(self, coders: Coders):
        self.coders = coders
        # each id with what may follow it in the text of groups
        self.a_names, self.b_names = (np.array([f"{i}{end}" for end in ends for i in range(n)], object)
                                      for n, ends in ((len(coders.a_bytes), ",|"), (len(coders.b_bytes), ",;")))
        self.a_name_len, self.b_name_len = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_names, self.b_names))
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.texts: list[str] = []
        self.codes = np.empty(0, np.int64)
        self.starts = np.empty(0, np.int64)  # of each word's links
        self.sizes = np.empty((0, 4), np.int64)  # tokens of A, of B, groups, whether the bytes differ

    def learn(self, words: set[str], ends: set[str]) -> None:
        """New words; ``ends`` are the last ones of documents, which may end anywhere."""
        odd = [w for w in ends if not _SAFE_END.search(w)]
        rest = (words | ends).difference(odd)
        quick = [w for w in rest if w.isascii() or max(w) < _OTHER] if self.coders.quick_a else []
        odd += rest.difference(quick)
        got = self.coders.encode_joined(quick) if quick else None
        if got:
            a, na, nb, b = got
            self._add(quick, a, na, b, nb, np.zeros(len(quick), bool))
        else:
            odd += quick
        for i in range(0, len(odd), JOINED):
            self._learn_odd(odd[i:i + JOINED])

    def _learn_odd(self, words: list[str]) -> None:
        a, b = self.coders.encode(words, words)
        ok = [self.coders.same(w, x, y) for w, x, y in zip(words, a, b)]
        a, b = ([x if o else [] for x, o in zip(xs, ok)] for xs in (a, b))
        (na, ai), (nb, bi) = ((np.fromiter(map(len, x), np.int64, len(x)), np.fromiter((i for y in x for i in y), np.int64)) for x in (a, b))
        self._add(words, ai, na, bi, nb, ~np.array(ok, bool))

    def _add(self, words: list[str], a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, bad: np.ndarray) -> None:
        ae, be = np.cumsum(self.coders.a_len[a]), np.cumsum(self.coders.b_len[b])
        ends = np.intersect1d(ae, be, assume_unique=True)  # a word's end is one
        last_a, last_b = np.searchsorted(ae, ends), np.searchsorted(be, ends)
        word_ends = np.concatenate([[0], ae])[np.cumsum(na)]
        groups = np.diff(np.searchsorted(ends, word_ends, "right"), prepend=0)
        # the groups' text: A's ids of a group, then B's, each with its sign
        closes_a, closes_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        closes_a[last_a], closes_b[last_b] = 1, 1
        group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        names = np.concatenate([self.a_names[a + closes_a * len(self.coders.a_bytes)], self.b_names[b + closes_b * len(self.coders.b_bytes)]])
        size = np.concatenate([self.a_name_len[a + closes_a * len(self.coders.a_bytes)], self.b_name_len[b + closes_b * len(self.coders.b_bytes)]])
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        text = "".join(names[order].tolist())
        until = np.cumsum(size[order])[np.cumsum(na + nb) - 1] if len(order) else np.zeros(len(words), np.int64)
        until = np.where(np.cumsum(na + nb) > 0, until, 0).tolist()
        at = 0
        for e in until:
            self.texts.append(text[at:e - 1] if e > at else "")
            at = e
        codes = a[last_a] << 16 | b[last_b]
        self.starts = np.concatenate([self.starts, len(self.codes) + np.cumsum(groups) - groups])
        self.codes = np.concatenate([self.codes, codes])
        self.sizes = np.concatenate([self.sizes, np.stack([na, nb, groups, bad], axis=1)])
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words))))


_ROWS = ("block long, is_words boolean, doc_id string, n_a long, n_b long, n_groups long, groups_sha256 string, data binary, groups string")
_COLS = [x.split()[0] for x in _ROWS.split(", ")]


def _words_row(block: int, lens: np.ndarray, codes: np.ndarray, counts: np.ndarray, used: np.ndarray) -> tuple:
    """The dictionary of a block: how many links each word has and how often it stands in the block; the
    links and how often each stands in its word."""
    data = np.concatenate([np.array([len(lens)], np.int64), lens, used, codes, counts])
    return (block, True, None, 0, 0, 0, None, C.pack(data), None)


def _dictionary(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of a block's words, the word of each, their number in it, and the words' occurrences."""
    x = C.unpack(b, np.int64)
    n = int(x[0])
    lens, used, rest = x[1:1 + n], x[1 + n:1 + 2 * n], x[1 + 2 * n:]
    codes, counts = rest[:len(rest) // 2], rest[len(rest) // 2:]
    return codes, np.repeat(np.arange(n), lens), counts, used


def _align_short(a_path: str, b_path: str, keep: bool):
    """Rows of documents that are composed in one place, in blocks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words(Coders(a_path, b_path))
        block = TaskContext.get().partitionId() << 32
        docs: list[tuple] = []  # of the block: row and its words
        size = 0
        held: list[tuple] = []
        held_size = 0

        def work() -> None:
            nonlocal size, held, held_size
            if not held:
                return
            parts = [_WORDS.split(" " + t) if t else [] for _, t in held]
            flat = [w for p in parts for w in p]
            words.learn({w for p in parts for w in p[:-1] if w not in words.index}, {p[-1] for p in parts if p and p[-1] not in words.index})
            every = np.fromiter(map(words.index.__getitem__, flat), np.int64, len(flat))
            lens = np.fromiter(map(len, parts), np.int64, len(parts))
            sums = np.zeros((len(parts), 4), np.int64)
            some = lens > 0
            if len(every):
                sums[some] = np.add.reduceat(words.sizes[every], (np.cumsum(lens) - lens)[some], axis=0)
            at = 0
            for (doc_id, _), n, (n_a, n_b, n_groups, bad) in zip(held, lens.tolist(), sums.tolist()):
                own = every[at:at + n]
                at += n
                if bad or not n:
                    docs.append(((doc_id, 0, 0, 0, "", None), _NO))
                else:
                    text = ";".join(map(words.texts.__getitem__, own.tolist()))
                    docs.append(((doc_id, n_a, n_b, n_groups, hashlib.sha256(text.encode()).hexdigest(), text if keep else None), own))
            size += held_size
            held, held_size = [], 0

        def close() -> pd.DataFrame:
            nonlocal block, docs, size
            distinct, local = np.unique(np.concatenate([at for _, at in docs]), return_inverse=True)
            used = np.bincount(local, minlength=len(distinct))
            lens = words.sizes[distinct, 2]
            codes = words.codes[C.concat_ranges(words.starts[distinct], lens)]
            rows = [_words_row(block, lens, codes, np.ones(len(codes), np.int64), used)]
            local = local.astype(np.int32)
            ends = np.cumsum([len(at) for _, at in docs])
            for ((doc_id, n_a, n_b, n_groups, sha, text), at), e in zip(docs, ends.tolist()):
                rows.append((block, False, doc_id, n_a, n_b, n_groups, sha, C.pack(local[e - len(at):e]), text))
            block, docs, size = block + 1, [], 0
            if len(words.index) > CACHE_WORDS:
                words.clear()
            return _frame(rows)

        for df in frames:
            for row in zip(df["doc_id"], df["text"]):
                held.append(row)
                held_size += len(row[1]) if row[1] else 1
                if held_size >= BATCH:
                    work()
                    if size >= BLOCK or len(words.index) > CACHE_WORDS:
                        yield close()
        work()
        if docs:
            yield close()
        C.release()

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLS)


def _place(raw: bytes, at: int, find) -> int:
    """The first offset from ``at`` on, at a sign's begin, that ``find`` accepts in a window; else the end."""
    width = 1 << 10
    while at < len(raw):
        while at < len(raw) and raw[at] & 0xC0 == 0x80:
            at += 1
        first, last = max(at - 1, 0), min(at + width, len(raw))
        while first and raw[first] & 0xC0 == 0x80:
            first -= 1
        while last < len(raw) and raw[last] & 0xC0 == 0x80:
            last += 1
        window = raw[first:last].decode()
        i = find(window, len(raw[first:at].decode()))
        if i is not None:
            return first + len(window[:i].encode())
        if last == len(raw):
            break
        at, width = last, width * 2
    return len(raw)


def _cut(chunk: int, a_path: str, b_path: str):
    """Rows (key, k, doc_id, a_text, a_at, b_text, b_at): the chunks of each document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = Coders(a_path, b_path).pairs
        key = TaskContext.get().partitionId() << 32

        def a_find(window: str, start: int) -> int | None:
            m = _A_CUTS.search(window, start)
            return m.start() if m else None

        def b_find(window: str, start: int) -> int | None:
            seen = window.replace(" ", "▁")
            return next((i for i in range(max(start, 1), len(seen)) if seen[i - 1:i + 1] not in pairs), None)

        for df in frames:
            for doc_id, text in zip(df["doc_id"], df["text"]):
                raw = (" " + text).encode()
                rows, a, b = [], 0, 0
                for k, end in enumerate(range(chunk, len(raw) + chunk, chunk)):
                    a2, b2 = _place(raw, max(a, end), a_find), _place(raw, max(b, end), b_find)
                    rows.append((key, k, doc_id, raw[a:a2].decode(), a, raw[b:b2].decode(), b))
                    a, b = a2, b2
                key += 1
                yield pd.DataFrame(rows, columns=["key", "k", "doc_id", "a_text", "a_at", "b_text", "b_at"])

    return run


_FRAGMENT = "key long, k long, doc_id string, ok boolean, is_open boolean, head binary, closed array<binary>, tail binary"


def _fragment_frame(key: int, k: int, doc_id, f: Fragment) -> pd.DataFrame:
    return pd.DataFrame({"key": [key], "k": [k], "doc_id": [doc_id], "ok": [f.ok], "is_open": [f.open], "head": [pack_tokens(f.head)],
                         "closed": [f.closed], "tail": [pack_tokens(f.tail)]})


def _fragments(a_path: str, b_path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        co = Coders(a_path, b_path)
        for df in frames:
            for r in df.itertuples():
                a, b = co.encode([r.a_text], [r.b_text])
                ok = (b"".join(map(co.a_bytes.__getitem__, a[0])) == r.a_text.encode()
                      and b"".join(map(co.b_bytes.__getitem__, b[0])) == r.b_text.encode())
                ai, ae = _join(iter(a), co.a_len)
                bi, be = _join(iter(b), co.b_len)
                yield _fragment_frame(r.key, r.k, r.doc_id, Fragment.of((ai, ae + r.a_at, bi, be + r.b_at), ok) if ok else Fragment(EMPTY, [], EMPTY, True, False))
        C.release()

    return run


def _compose(df: pd.DataFrame) -> pd.DataFrame:
    """The fragments of one group in order, as one fragment of the next level."""
    df = df.sort_values("k")
    out = None
    for r in df.itertuples():
        f = Fragment(unpack_tokens(r.head), list(r.closed), unpack_tokens(r.tail), r.is_open, r.ok)
        out = f if out is None else out.then(f)
    if not out.ok:
        out = Fragment(EMPTY, [], EMPTY, True, False)
    return _fragment_frame(df["key"].iat[0], df["k"].iat[0] // FAN, df["doc_id"].iat[0], out)


def _finish(keep: bool):
    """The document rows of composed fragments; each is a block with one word."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for r in df.itertuples():
                block = -1 - r.key
                if not r.ok:
                    rows = [_words_row(block, _NO, _NO, _NO, _NO), (block, False, r.doc_id, 0, 0, 0, "", C.pack(_NO.astype(np.int32)), None)]
                else:
                    whole = Fragment(unpack_tokens(r.head), list(r.closed), unpack_tokens(r.tail), r.is_open)
                    digest, texts, codes, sizes = hashlib.sha256(), [], [], np.zeros(3, np.int64)
                    for piece in map(unpack_groups, whole.pieces()):
                        text = ";".join(group_text(*piece))
                        digest.update((";" if codes else "").encode() + text.encode())
                        texts += [text] if keep else []
                        codes.append(link_codes(*piece))
                        sizes += [len(piece[0]), len(piece[2]), len(piece[1])]
                    distinct, counts = np.unique(np.concatenate(codes), return_counts=True)
                    rows = [_words_row(block, np.array([len(distinct)]), distinct, counts, np.ones(1, np.int64)),
                            (block, False, r.doc_id, *sizes.tolist(), digest.hexdigest(), C.pack(np.zeros(1, np.int32)), ";".join(texts) if keep else None)]
                yield _frame(rows)

    return run


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, chunk: int = CHUNK, keep: bool = False) -> DataFrame:
    """Documents and block dictionaries (``is_words``), written to the shared folder.  With ``keep``, ``groups``
    holds each document's groups as text."""
    a_path, b_path = a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE)
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # as text: pandas has no whole numbers beside nulls
    is_long = F.coalesce(F.octet_length("text") > chunk, F.lit(False))
    rows = docs.where(~is_long).mapInPandas(_align_short(a_path, b_path, keep), _ROWS)
    chunks = materialize(docs.where(is_long).mapInPandas(
        _cut(chunk, a_path, b_path), "key long, k long, doc_id string, a_text string, a_at long, b_text string, b_at long"), "align_chunks")
    most = chunks.agg(F.max("k")).first()[0]
    if most is not None:
        tree = materialize(chunks.repartition("key", "k").mapInPandas(_fragments(a_path, b_path), _FRAGMENT), "align_fragments")
        while most > 0:
            tree = materialize(tree.groupBy("key", F.floor(F.col("k") / FAN).alias("up")).applyInPandas(_compose, _FRAGMENT), "align_fragments")
            most //= FAN
        rows = rows.unionByName(tree.mapInPandas(_finish(keep), _ROWS))
    return materialize(rows, "aligned")


def _pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in frames:
        for block, data in zip(df["block"], df["data"]):
            codes, word, counts, used = _dictionary(data)
            distinct, at = np.unique(codes, return_inverse=True)
            n = np.bincount(at, counts * used[word], len(distinct)).astype(np.int64) if len(codes) else _NO
            yield pd.DataFrame({"block": np.repeat(np.int64(block), len(distinct)), "code": distinct, "n": n})


_REPORT = ("doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _report(rows: pd.DataFrame, scores: pd.DataFrame) -> pd.DataFrame:
    """Documents of a block with the sums of their links' counts."""
    scores = scores.sort_values("code")
    known, total, best = (scores[c].to_numpy() for c in ("code", "total", "best"))
    words = rows[rows["is_words"]]
    docs = rows[~rows["is_words"]]
    codes, word, counts, used = _dictionary(words["data"].iat[0])
    at = np.searchsorted(known, codes)
    of_word = np.zeros((len(used), 3), np.int64)
    if len(codes):
        for i, x in enumerate((counts, counts * best[at], counts * total[at])):
            np.add.at(of_word[:, i], word, x)
    sums = np.array([of_word[C.unpack(d, np.int32)].sum(axis=0) for d in docs["data"]], np.int64).reshape(-1, 3)
    out = docs[["doc_id", "n_a", "n_b", "n_groups"]].copy()
    out["n_links"], out["n_best"], out["count_sum"] = sums.T
    out["groups_sha256"] = docs["groups_sha256"]
    return out


def alignment_report(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = aligned(docs, a_path, b_path, chunk)
    pairs = materialize(rows.where("is_words").select("block", "data").mapInPandas(_pairs, "block long, code long, n long"), "align_pairs")
    totals = materialize(pairs.groupBy("code").agg(F.sum("n").alias("total")), "align_totals")
    b_id = F.col("code").bitwiseAND(0xFFFF)
    top = totals.groupBy(b_id.alias("b")).agg(F.max("total").alias("top"))
    scored = (totals.withColumn("b", b_id).join(top, "b")
              .select("code", "total", (F.col("total") == F.col("top")).cast("long").alias("best")))
    scores = pairs.select("block", "code").join(scored, "code").select("block", "code", "total", "best")
    return (rows.drop("groups").groupBy("block").cogroup(scores.groupBy("block"))
            .applyInPandas(_report, _REPORT).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)))


def groups(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Rows (doc_id, groups): the groups of each document as ``a1,a2|b1;a3|b2,b3``, empty without tokens."""
    rows = aligned(docs, a_path, b_path, chunk, keep=True)
    return rows.where("not is_words").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"),
                                             F.coalesce("groups", F.lit("")).alias("groups"))
