"""Every occurrence of a word draws its own merges."""

import public_tokenizers
import pytest

from lexiloom.llm import sentencepiece_dropout
from lexiloom.llm.sentencepiece_dropout import Encoder


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece_dropout.Pieces(public_tokenizers.path("piece_bpe_32k.model"))


def test_no_cap_on_a_words_segmentations(spark, pieces):
    docs = spark.createDataFrame([(k, "segmentations " * 30) for k in range(40)], "doc_id long, text string")
    rows = sentencepiece_dropout.encode_texts(docs, pieces).collect()
    assert all(r.lossless for r in rows)
    whole = Encoder(pieces, 0.0)
    parts = lambda ids: "|".join(pieces.plain[i].decode() for i in ids).replace("| ", "\n ").split("\n")
    several = {w for r in rows for w in parts(r.ids)}
    assert len(several) > 8
    assert len({tuple(r.ids) for r in rows}) == 40
    # equal rows, another worker, another batch: the same ids
    again = Encoder(pieces)
    assert [again.encode(docs.first().text, r.doc_id).tolist() for r in rows] == [r.ids for r in rows]
    assert Encoder(pieces, 0.0).encode("segmentations").tolist() == whole.encode("segmentations").tolist()


def test_draws_are_those_of_single_words(pieces, monkeypatch):
    """What is remembered gives what a word segmented by itself gives, and skips have their share."""
    encoder = Encoder(pieces, 0.4)
    text = "a segmentation of words, int▁ernational▁ \U0001f600é " + "x" * 50 + " " + "theirs" * 20
    for key in range(200):
        own = [w or None for ws, _ in encoder._words(text, key) for w in ws]
        keys = [int(k) for _, ks in encoder._words(text, key) for k in ks]
        alone = b"".join(encoder.known[0] if w is None else encoder.word(w, k) for w, k in zip(own, keys))
        assert encoder.encode(text, key).tobytes() == alone
    one = Encoder(pieces, 0.1)
    keys = one._words("the " * 20_000, 1).__next__()[1]
    first, second = one.gaps(keys, 0), one.gaps(keys, 1)
    for k in (1, 3, 7):
        assert abs((first >= k).mean() - 0.9**k) < 0.015 and abs((second[first < 3] >= k).mean() - 0.9**k) < 0.02
    ids = one.encode("the " * 20_000, 1)
    monkeypatch.setattr(sentencepiece_dropout, "REMEMBERED", 5)
    assert (one.encode("the " * 20_000, 1) == ids).all()
