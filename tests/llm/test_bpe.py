import base64
import random
import time

import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken

from tessel.llm import bpe

FILE = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    lines = open(FILE, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    return bpe.Codec(lines, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_code_point_in_context(both):
    codec, ref = both
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(chars), 997):
        text = "a1 ".join(chars[k : k + 997])
        assert codec.encode(text) == ref.encode_ordinary(text), hex(k)


def test_random_and_long_texts(both):
    codec, ref = both
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 7, 50, 3000):
        for alphabet in ("ab", "the  \n\t'sé1!", "aaaaaaaaaab", "日本語 ñß"):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            ids = codec.encode(text)
            assert ids == ref.encode_ordinary(text)
            assert codec.decode(ids) == text.encode()
    for text in ("a" * 100_000, "Ab0" * 5_000, " " * 50_000, "<|endoftext|> I'll don't"):
        assert codec.encode(text) == ref.encode_ordinary(text)


def test_tables(spark, both):
    codec, _ = both
    v = bpe.default_vocabulary(spark)
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "The same", "z"), (3, "The same", "z")], "doc_id long, text string, ids string")
    rows = sorted(bpe.decode(bpe.encode(docs, v), v).collect())
    assert [(r[0], bytes(r[1])) for r in rows] == [(1, b""), (2, b""), (3, b"The same"), (3, b"The same")]
    got = bpe.digests(docs, v).collect()
    assert all(r.round_trip for r in got) and {r.doc_id: r.n_tokens for r in got} == {1: 0, 2: 0, 3: len(codec.encode("The same"))}
    assert bpe.digests(docs.limit(0), v).count() == 0


def test_texts_of_one_array(both):
    codec, ref = both
    rng = random.Random(11)
    parts = ["'", "'s", "'ll", "'re", "'v", "e", "l", "L", " ", "  ", "\n", " ", "　", "7", "٣", "é", "日", "😀", "́", "!", "", "𐐀", "\U00016ea0"]
    for _ in range(40):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(200)] + [None, ""]
        ids, ends = codec.encode_all(pa.array(texts, pa.string())[1:])
        assert len(ends) == len(texts)
        for text, a, b in zip(texts[1:], ends[:-1], ends[1:]):
            assert ids[a:b].tolist() == ref.encode_ordinary(text or ""), text


def test_other_patterns():
    lines = open(FILE, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    pattern = r"\p{N}{1,3}|\p{L}+|\s+"
    ref = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for text in ("12345 abc  é!", "", "a!b", "\U00016ea0a"):  # what no match holds is left out
        assert bpe.Codec(lines, pattern).encode(text) == ref.encode_ordinary(text)


def test_kept_pieces_are_given_up(both, monkeypatch):
    codec, ref = bpe.Codec(open(FILE, "rb").read(), P.PATTERN), both[1]
    monkeypatch.setattr(bpe, "CACHED", 50)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 90))) for _ in range(150)]
    for _ in range(60):
        texts = [" ".join(rng.choices(words, k=10)) for _ in range(3)]
        ids, ends = codec.encode_all(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [ref.encode_ordinary(t) for t in texts]
        assert len(codec.pieces.place) < 50 + 2 * 30 and max(map(len, codec.pieces.place)) <= bpe.CACHED_BYTES


def test_slices(monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_BYTES", 10)
    lengths = [0, 4, 6, 1, 30, 0, 10, 3]
    rows = [(s.start, s.stop) for s in bpe._slices(pa.array([None if n == 0 else "x" * n for n in lengths]))]
    assert rows == [(0, 3), (3, 4), (4, 5), (5, 7), (7, 8)]
    assert list(bpe._slices(pa.array([], pa.string()))) == []


def test_takes_less_cpu_than_the_pattern_engine(both):
    codec, _ = both
    rng = random.Random(1)
    words = ["".join(rng.choice("etaoinshrdlué") for _ in range(rng.randrange(2, 14))) for _ in range(20_000)]
    text = " ".join(rng.choice(words) for _ in range(300_000))
    find = regex.compile(P.PATTERN).findall

    def cpu(f):
        times = []
        for _ in range(3):
            t = time.process_time()
            f(text)
            times.append(time.process_time() - t)
        return min(times)

    assert cpu(codec.encode) < cpu(find)
