import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tallyworks.llm import bpe, token_files

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(JSON)
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def ranked():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def texts():
    rng, letters = random.Random(1), list("a b'sB1.\n\t  é　中!?,\0\x1c") + ["the", "ing ", "'ll", "<|endoftext|>", "\U0001d400", " %%"]
    yield from ("".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(4000))
    yield from (f"a{c}b {c} 1{c}  {c}{c} {c}," for c in map(chr, [*range(0, 0x3000), *range(0x3000, 0x110000, 41)]) if not 0xD800 <= ord(c) < 0xE000)
    yield "x" * 5000 + " " + "ab" * 4000


def test_perfect_hash_is_minimal_and_exact():
    keys = [str(i * 7919).encode() for i in range(5000)]
    ph = bpe.PerfectHash(keys)
    assert len(ph.slots) == len(keys) and [ph.get(k) for k in keys] == list(range(len(keys)))
    assert all(ph.get(b"no" + k) == -1 for k in keys)


def test_both_encoders_match_their_libraries(library, ranked):
    own = bpe.Bpe(bpe.load_ranks(open(RANKS, "rb").read()), P.PATTERN)
    lib = token_files.LibraryEncoder(open(JSON, encoding="utf-8").read(), P.PATTERN)
    for t in texts():
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ranked(t), repr(t)
        assert np.frombuffer(lib.encode(t), "<u2").tolist() == library(t), repr(t)
        assert own.decode(own.encode(t)) == t.encode()


def test_special_string_is_the_special_token(library):
    lib = token_files.LibraryEncoder(open(JSON, encoding="utf-8").read(), P.PATTERN)
    text = "hello <|endoftext|> world"
    assert np.frombuffer(lib.encode(text), "<u2").tolist() == library(text) == [31373, 220, 50256, 995]


@pytest.mark.parametrize("pattern", [r"\p{L}+|\s+|[^\s\p{L}]+", r"(\p{L}+)|\s+|[^\s\p{L}]+", r"\s?\p{L}+|\s+|."])
def test_other_patterns_are_matched_as_they_are(pattern):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    own = bpe.Bpe(bpe.load_ranks(open(RANKS, "rb").read()), pattern)
    for t in ("hello world again", " a  b\tc\n", "x1 y2"):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == other(t)


def rows():
    return [(5, "hello world", "x"), (2, None, "x"), (9, "", "x"), (None, "no id", "x"), (5, "hello world", "x"), (7, "thequick " * 9000, "x")]


def test_encode_decode_rows(spark, ranked):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, ids string")
    got = bpe.encode_decode(docs, RANKS, P.PATTERN, digests=True).collect()
    expect = sorted((str(d), len(i := ranked(t or "")), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, _ in rows())
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == expect
    assert {r.decoded for r in bpe.encode_decode(docs, RANKS, P.PATTERN).collect()} == {t or "" for _, t, _ in rows()}
    assert bpe.encode_decode(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_token_files_round_trip(spark, library):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, start string")
    manifest, folder = token_files.write_token_files(docs, JSON, P.PATTERN, seq_len=16, n_files=3)
    got = token_files.read_documents(manifest, folder, seq_len=16).orderBy("start").collect()
    ordered = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for r, (doc_id, text, _) in zip(got, ordered, strict=True):
        ids = library(text or "") + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    for m in manifest.collect():
        f = token_files.TokenFile(folder, m.path, 16, m.data_offset, m.batch_bytes, m.width)
        masks = [np.unpackbits(f.sequence(i)[1]) for i in range(m.n_rows)]
        assert sum(int(x.sum()) for x in masks) == m.n_tokens and all(len(f.sequence(i)[0]) == 16 for i in range(m.n_rows))
        assert not f.sequence(0)[0].flags.owndata
    empty, folder = token_files.write_token_files(docs.limit(0), JSON, P.PATTERN, n_files=3)
    assert token_files.read_documents(empty, folder).count() == 0


def test_files_that_normalise_or_split_otherwise_follow_the_library():
    path = P.path("word_bpe_49k.json")
    lib, library = token_files.LibraryEncoder(open(path, encoding="utf-8").read(), P.PATTERN), Tokenizer.from_file(path)
    other = token_files.LibraryEncoder(open(JSON, encoding="utf-8").read(), r"\S+|\s+")
    plain = Tokenizer.from_file(JSON)
    assert not lib.by_pieces and not other.by_pieces
    for t in ["The  QUICK bro\u0301wn\nfox's", "", "1234 caf\u00e9!", *list(texts())[:200]]:
        assert np.frombuffer(lib.encode(t), "<u2").tolist() == library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(other.encode(t), "<u2").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_copies_without_doc_id_go_to_several_files(spark):
    docs = spark.createDataFrame([(None, "one text")] * 400 + [(7, "other")] * 400, "doc_id long, text string").repartition(8)
    manifest, folder = token_files.write_token_files(docs, JSON, P.PATTERN, n_files=8, seq_len=64)
    rows = manifest.collect()
    assert sum(r.n_docs for r in rows) == 800 and max(r.n_docs for r in rows) <= 300
    got = token_files.read_documents(manifest, folder, seq_len=64).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 400 + [7] * 400
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(800)]
