"""Packing looks units up in arrays: each is encoded once, whatever the number of ids."""

from __future__ import annotations

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from seatledger.llm import _units, packing

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_units_are_encoded_once(monkeypatch):
    """More unlike words than a table of 150,000 units held: none is encoded a second time."""
    units, learned = packing.table(TOKENIZER)[0], []
    learn = units.learn
    monkeypatch.setattr(units, "learn", lambda raw: (learned.append(len(raw)), learn(raw))[1])
    text = " ".join(f"w{i:x}" for i in range(200_000))
    first = packing.token_bytes(text, TOKENIZER)
    assert sum(learned) >= 199_000
    learned.clear()
    assert packing.token_bytes(text, TOKENIZER) == first and sum(learned) == 0


def test_a_long_text_is_looked_up_in_runs(monkeypatch):
    monkeypatch.setattr(_units, "SLICE", 100)
    monkeypatch.setattr(_units, "KNOWN", 20)
    tokenizer = Tokenizer.from_file(TOKENIZER)
    units, most = _units.byte_level(tokenizer, np.uint32), []
    look_up = units.look_up
    monkeypatch.setattr(units, "look_up", lambda data, x, y: (most.append(int(y[-1] - x[0])), look_up(data, x, y))[1])
    whole = lambda s: tokenizer.encode(s, add_special_tokens=False).ids
    texts = [" ".join(f"word{i % 37}, É{i}.\nend" for i in range(200)), "short one", "x" * 900 + " y"]
    got = [own.tolist() for (own,) in _units.encoded(texts, b"", [(units, whole)])]
    assert got == [whole(t) for t in texts] and len(most) > 20 and sorted(most)[-2] <= 200


def test_ids_of_a_large_vocabulary():
    """Ids beyond 16 bits stay as they are."""
    units = _units.Units(_units.words, lambda raw: [[70_000 + len(x)] for x in raw], np.uint32)
    ((ids,),) = _units.encoded(["ab cde"], b"", [(units, None)])
    assert ids.tolist() == [70_002, 70_004] and ids.dtype == np.uint32
