import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from helpers import awkward, frame
from tokenizers import Tokenizer

from fenceline.llm import packing, tokens


def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_tokenizer(monkeypatch):
    t, raw, rng = tokenizer(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(1)
    monkeypatch.setattr(tokens, "STRETCH", 20)
    parts = [" ", "  ", "\n", "the", "\t", "é", "1", "!", "\xa0", "don't", "日本", "😀", " ", "<|endoftext|>", "ɐ", "　", "\x85", "\x1c", "\r\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(tokens.encode(text, special=True), "<u4").tolist() == raw.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tokens.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_hilbert_neighbours_are_adjacent():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert((grid + 0.5) / 8, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_every_id_once_without_padding(spark):
    rows = [(i, t) for i, t in awkward() if t is None or "\x00" not in t] + [(500, "hello world " * 4000), (501, "a <|endoftext|> b")]
    pieces, t = packing.pack(frame(spark, rows)).collect(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sequences, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append(p)
        docs[p["doc_id"]].append(p)
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024 and at & (at - 1) == 0
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        copies = sum(r[0] == i for r in rows)
        assert sum(p["length"] for p in docs[i]) == copies * len(ids)
        for p in docs[i]:
            part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4")
            assert p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(part.tobytes())
    assert packing.pack(frame(spark, []).limit(0)).count() == 0
