"""A coder holds what its ids take, not what they might take."""

import numpy as np

from sparkloom.llm import tokenids


def test_room_grows_with_the_digits(monkeypatch):
    made, init, sizes, numbers = [], tokenids.Encoder.__init__, [], tokenids._numbers
    monkeypatch.setattr(tokenids.Encoder, "__init__", lambda self, *a: (init(self, *a), made.append((self, self.out.shape[1])))[0])
    monkeypatch.setattr(tokenids, "_numbers", lambda g: sizes.append(len(g)) or numbers(g))
    ids = np.random.default_rng(3).integers(0, 1 << 31, 3000).astype(np.int32)
    assert (tokenids.decode_blocks(tokenids.code_blocks(ids, 2000)) == ids).all()
    coder, start = made[0]
    assert start <= 1024 < coder.out.shape[1]
    flat = np.zeros(6000, np.int32)
    assert (tokenids.decode_blocks(tokenids.code_blocks(flat, 100)) == flat).all()
    assert made[1][0].out.shape[1] <= 1024 and max(sizes) <= 32
