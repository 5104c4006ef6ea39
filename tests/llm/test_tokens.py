import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from pagecorpus.llm import tokens as K


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(K.tokenizer_path())


def _expected(rows, tok):
    import xxhash
    rows = sorted(((r[0] is not None, r[0] or 0, xxhash.xxh64_hexdigest((r[1] or "").encode()), r[1] or "") for r in rows))
    out, start = [], 0
    for has, doc_id, _, text in rows:
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id if has else None, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


def test_round_trip_equals_tokenizer(odd, documents, tokenizer, monkeypatch):
    monkeypatch.setattr(K, "TARGET", 100_000)
    monkeypatch.setattr(K, "BLOCK_TOKENS", 5_000)
    for df in (odd, documents.limit(300)):
        df = df.cache()
        got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in K.token_report(df).collect()), key=repr)
        assert got == _expected([(r.doc_id, r.text) for r in df.collect()], tokenizer)


def test_pieces_equal_whole_texts(tokenizer):
    enc = K.encoder(K.tokenizer_path())
    texts = ["", " ", "  a  b ", "a\n\n b\t\tc \n", "It's  we'll\r\nx", "éè 中文  中", "1234  56,78", "trailing   ", "a  b", "x<|endoftext|> y", "\n \n", "a ́b"]
    for t, ids in zip(texts, enc.texts(texts), strict=True):
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_cut_equals_pattern():
    import random

    rng = random.Random(4)
    signs = ["a", "é", "Z", "7", ".", "-", "(", " ", " ", "\n", "  ", "\n\n", "ß9"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 30))) for _ in range(500)] + [" ", "\n", "  ", " a", "a ", "\n a"]
    raw = [t.encode() for t in texts]
    first = np.concatenate([[0], np.cumsum([len(t) for t in raw])[:-1]])
    whole = b"".join(raw)
    start = K.cut_words(np.frombuffer(whole, np.uint8), first)
    got = [whole[i:j].decode() for i, j in zip(start, [*start[1:], len(whole)], strict=True)]
    assert got == [w for t in texts for w in K._WORD.findall(t)]
    enc, tok = K.encoder(K.tokenizer_path()), Tokenizer.from_file(K.tokenizer_path())
    for t, ids in zip(texts, enc.texts(texts), strict=True):
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_byte_coding_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        v = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        assert (K.decode_values(*K.encode_values(v), n) == v).all()
    edges = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], np.uint32)
    control, data = K.encode_values(edges)
    assert len(control) == 2 and len(data) == 1 + 1 + 2 + 2 + 3 + 3 + 4 + 4
    assert (K.decode_values(control, data, 8) == edges).all()


def test_ranks_follow_frequency(spark, documents, tmp_path):
    out = str(tmp_path / "t")
    K.write(documents.limit(50), out)
    r = spark.read.parquet(f"{out}/ranks").orderBy("rank").collect()
    assert [x.n for x in r] == sorted((x.n for x in r), reverse=True) and [x["rank"] for x in r] == list(range(len(r)))


def test_empty(nothing):
    assert K.token_report(nothing).count() == 0
