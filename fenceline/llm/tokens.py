"""Token ids of a public byte-level vocabulary, whole texts at once.

Two installed libraries read the same vocabulary. The faster one encodes every text whose characters both
classify alike; only stretches with other characters go to the slower one. A single space between two
characters that are not white space always begins a new piece of the vocabulary's split pattern, so a text may
be cut there, and only there, without changing an id.
"""

import base64
import functools
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

#: Longer texts are encoded in stretches of about this many characters.
STRETCH = 200_000
#: From this character on the libraries' Unicode tables may differ.
HIGH = "ɐ"
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
_CUT = re.compile(r"(?<=\S)(?= \S)")


@functools.cache
def _ranks(name: str) -> tiktoken.Encoding:
    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _tokenizer(name: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True  # a special token's string in a text is ordinary text
    return tokenizer


def _stretches(text: str) -> Iterator[str]:
    """A long text cut where that changes no id."""
    at = 0
    while len(text) - at > STRETCH and (cut := _CUT.search(text, at + STRETCH)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _ids(text: str, name: str) -> Iterator[list[int]]:
    for stretch in _stretches(text):
        if stretch.isascii() or max(stretch) < HIGH:
            yield _ranks(f"{name}.tiktoken").encode_ordinary(stretch)
            continue
        for high, parts in groupby(_CUT.split(stretch), lambda part: bool(part) and max(part) >= HIGH):
            run = "".join(parts)
            if high:
                yield _tokenizer(f"{name}.json").encode(run, add_special_tokens=False).ids
            else:
                yield _ranks(f"{name}.tiktoken").encode_ordinary(run)


def encode(text: str, name: str = "byte_bpe_50k", special: bool = False) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit integers. ``name`` is the vocabulary's file without its
    ending. The special token's string is ordinary text, or with ``special`` its own id."""
    if not text:
        return b""
    out = []
    for k, part in enumerate(text.split(SPECIAL) if special else [text]):
        if k:
            out.append([SPECIAL_ID])
        if part:
            out += _ids(part, name)
    return b"".join(np.array(ids, dtype="<u4").tobytes() for ids in out)


def decode(ids: np.ndarray, name: str = "byte_bpe_50k") -> str:
    return _ranks(f"{name}.tiktoken").decode_bytes(ids.tolist()).decode()
