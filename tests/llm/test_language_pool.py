"""Pooling of a document's positions, against a plain forward pass of the network."""
import numpy as np

from facetwise.llm import language_id as L


def plain(network, word):
    """Summed log-probabilities of a word's positions, piece by piece, one word at a time."""
    out = 0
    for piece in L.pieces_of(word):
        out = out + network.log_probabilities(np.frombuffer(piece, np.uint8).reshape(1, len(piece))).reshape(len(piece), -1).sum(0)
    return out


def test_unspaced_texts_vote_with_every_position():
    network = L.ByteNetwork(3)
    words = [b"the", b"x" * 1000, "日本語テスト".encode() * 60, b"ab12" * 100, b"http://a.b/" + b"c" * 300, b"1234", b"don't"]
    out = L._label(network, words)
    for row, word in zip(out, words):
        pos = sum(len(p) for p in L.pieces_of(word))
        lettered = any(b >= 0x80 or chr(b).isalpha() for b in word)
        weight = 0 if not lettered else min(pos, L.LONGEST) if set(word) & set(b"0123456789/:") and pos else pos
        assert row[-1] == (0 if not lettered else weight)
        if lettered:
            np.testing.assert_allclose(row[:3], plain(network, word) * weight / pos, rtol=1e-5)
    assert out[1, -1] >= 1000 and out[3, -1] == L.LONGEST
