"""How much work ids take: rounds of the coder, and pieces that are encoded again."""

import random

import numpy as np
import public_tokenizers
import pytest

from sparkloom.llm import tokenids

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("kind", ["Encoder", "Decoder"])
def test_rounds_of_the_coder(monkeypatch, kind):
    rounds, renew = [], getattr(tokenids, kind).renew
    ids = np.random.default_rng(1).zipf(1.2, 4 * 4096 + 7) % 900
    monkeypatch.setattr(getattr(tokenids, kind), "renew", lambda self, a: rounds.append(1) or renew(self, a))
    assert (tokenids.decode_blocks(tokenids.code_blocks(ids, 4096)) == ids).all()
    assert len(rounds) < 4096 / 2


def test_blocks_do_not_depend_on_those_beside():
    rng = np.random.default_rng(2)
    ids = np.concatenate([rng.integers(0, 50_000, 4096), rng.zipf(1.3, 4096) % 50, np.full(4096, 9), np.tile([3, 1, 2], 1400)[:4096]])
    together = tokenids.code_blocks(ids, 4096)
    assert together == [tokenids.code_blocks(ids[i : i + 4096], 4096)[0] for i in range(0, len(ids), 4096)]
    assert all((tokenids.decode_blocks([b]) == ids[4096 * i : 4096 * (i + 1)]).all() for i, b in enumerate(together))


def test_pieces_that_come_again_are_kept(monkeypatch):
    pieces = tokenids.Pieces(PATH, most=100, spell_special=False)
    text = " ".join(f"word{i}" for i in range(150))
    want = pieces.ids([text], 0)[0].tolist()
    monkeypatch.setattr(pieces, "_encode", lambda texts: [] if not texts else pytest.fail("encoded again"))
    assert pieces.ids([text], 0)[0].tolist() == want and not pieces.older.keys() - pieces.known.keys()


def test_pieces_with_any_white_space():
    pieces, r = tokenids.Pieces(PATH, most=500, spell_special=False), random.Random(4)
    parts = ["a", "b", " ", "  ", "\n", "\t", ",", "é", "日", "<|endoftext|>", "'s", "1", "　", "\x1c", " \n"]
    texts = ["".join(r.choices(parts, k=r.randrange(14))) for _ in range(3000)] + [" a", "a ", "\na b", "a b\n c", "a b\n"]
    for low in range(0, len(texts), 7):
        part = texts[low : low + 7]
        want = [pieces.tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in part]
        ids, counts = pieces.ids(part, 0)
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
