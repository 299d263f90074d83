import random

import pytest
from tokenizers import Tokenizer, models

from cambium.llm import unigram
from cambium.llm.queries import TOKENIZERS

PATH = f"{TOKENIZERS}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def vocabulary():
    return unigram.vocabulary(PATH)


@pytest.fixture(scope="module")
def library(vocabulary):
    """The tokenizers library's unigram model over the same pieces; byte rows only stand in for unknown characters."""
    own = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary[0], *((f"<0x{b:02X}>", -2e9) for b in range(256))], 0, True))
    return lambda s: len(own.encode("▁" + s.replace(" ", "▁"), add_special_tokens=False).ids) if s else 0


def test_random_texts(vocabulary, library):
    own, rng = unigram.Counter(*vocabulary), random.Random(5)
    parts = ["a", "b", "the", "ing", " ", "  ", "é", "中", "😀", "1", ".", "er", "th", "in", "▁", "tion", "\n", "\t", "́"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert own.count(text)[0] == library(text)


def test_documents_whole_and_in_runs(spark, sf, vocabulary, library):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    own, whole = unigram.Counter(*vocabulary), unigram.Counter(*vocabulary)
    whole.runs = None
    for t in texts:
        assert own.count(t) == whole.count(t) and own.count(t)[0] == library(t)


def brute(text, pieces, penalty):
    """Best score and its count, the earliest last piece first, by trying all ways."""
    best = {0: (0.0, 0)}
    for end in range(1, len(text) + 1):
        for start in range(end):
            own = pieces.get(text[start:end], penalty if end - start == 1 else None)
            if own is not None and (end not in best or best[start][0] + own > best[end][0]):
                best[end] = best[start][0] + own, best[start][1] + 1
    return best[len(text)][::-1]


def test_ties_against_brute_force():
    rng = random.Random(11)
    for _ in range(500):
        pieces = {"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))): -float(rng.randint(1, 4)) for _ in range(8)}
        own = unigram.Counter(list(pieces.items()), False)
        text = "".join(rng.choice("abc▁") for _ in range(rng.randint(1, 12)))
        assert own.best(text) == brute(text, pieces, min(pieces.values()) - unigram.PENALTY)


def test_table_edges(spark, vocabulary):
    frame = spark.createDataFrame([(1, None), (2, ""), (3, "ab ab"), (3, "ab ab"), (None, "word " * 40_000)], "doc_id long, text string").selectExpr("*", "7 as score")
    got = {r["doc_id"]: r for r in unigram.token_counts(frame, *vocabulary, ["doc_id"]).collect()}
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == 0 and got[3]["n_tokens"] > 0 and got[None]["n_tokens"] >= 40_000
    assert unigram.token_counts(frame.limit(0), *vocabulary, ["doc_id"]).count() == 0
    assert unigram.Counter([], False).count("ab") == (3, -30.0)
