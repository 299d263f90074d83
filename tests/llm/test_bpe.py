import gc
import hashlib
import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cambium.llm import bpe
from cambium.llm.queries import TOKENIZERS

PATH = f"{TOKENIZERS}/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return bpe.Transducer(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(own, text):
    return [i for run, _ in own.encode(text) for i in run]


def same(own, library, text):
    got = ids(own, text)
    want = library.encode(text, add_special_tokens=False).ids
    return got == want and "".join(own.decode(got)) == library.decode(want, skip_special_tokens=False)


def test_random_texts(own, library):
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "1", "é", "ß", "中", "　", "\x1c", "\x85", "​", "!", "...", "'s", "'ll", "the", "ing", "<|endoftext|>", "<|endof", "😀", "́", "\xa0", "-----", "aaaa", "İ", "\x00"]
    assert all(same(own, library, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for _ in range(4000))


@pytest.mark.parametrize("text", ["a" * 5000, "abcab" * 2000, "-" * 3333, " " * 5000, "é" * 3000, "theing" * 2000, "\x00\x01" * 900, "=-" * 4000, "", "\n", "x" * 257])
def test_long_pieces_are_streamed(own, library, text):
    assert same(own, library, text)


def test_stream_in_blocks_is_bounded(own, library):
    rng = random.Random(3)
    text = "".join(rng.choice(["the", "ing", "ation", "er", "q", "zx"]) for _ in range(6000))
    raw = text.encode()
    blocks = [raw[i : i + 7] for i in range(0, len(raw), 7)]
    assert list(own.stream(blocks)) == library.encode(text, add_special_tokens=False).ids
    assert own.lookahead < 1000
    first = own.stream(iter(lambda: b"abcd", None))  # an endless piece gives tokens while it is read
    assert len([next(first) for _ in range(500)]) == 500


def test_neighbours_against_the_merge_list(own):
    rng = random.Random(5)
    every = list(own.whole)
    for _ in range(5000):
        a, b = rng.choice(every), rng.choice(every)
        if len(a) + len(b) < 40:
            assert own._fits(a, b) == (own.merged(a + b) == [a, b])


def test_decoding_of_any_ids(own, library):
    rng = random.Random(7)
    for _ in range(50):
        some = [rng.randrange(50257) for _ in range(200)]
        want = library.decode(some, skip_special_tokens=False)
        assert "".join(own.decode(some)) == want and "".join(own.decode(some, block=3)) == want


def test_query_edges(spark, library):
    rows = [(1, None), (2, ""), (3, "Hello<|endoftext|> world é"), (3, "Hello<|endoftext|> world é"), (None, "x " * 50_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as n_tokens")
    got = bpe.tokenize(frame, PATH, ids=True).collect()
    assert len(got) == 5
    for r in got:
        text = next(t or "" for d, t in rows if d == r["doc_id"])
        want = library.encode(text, add_special_tokens=False).ids
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.tokenize(frame.limit(0), PATH).count() == 0


def test_documents(own, library, spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert [ids(own, t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_a_piece_is_decoded_once(own, library):
    """Bytes and digits are kept with a piece's ids, not gathered token by token of each text; the collector rests meanwhile and is as before afterwards."""
    text = "Straße, it's 42　é \U0001f600 " * 3 + "thenedes ofaninenon"
    pieces = [p for run in own.segments(text) for p in run]
    want = library.encode(text, add_special_tokens=False).ids
    assert [i for ids, _, _ in pieces for i in ids] == want and b"".join(d for _, d, _ in pieces)[:-1].decode() == ",".join(map(str, want))
    assert b"".join(raw for _, _, raw in pieces) == text.encode()
    asked = []

    def batches():
        for _ in range(2):
            asked.append(gc.isenabled())
            yield pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["doc_id", "text"])

    with open(PATH, "rb") as f:
        assert [b.column(1)[0].as_py() for b in bpe._tokens(batches(), f.read(), False)] == [len(want)] * 2
    assert asked == [False, False] and gc.isenabled()
