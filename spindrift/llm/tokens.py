"""Encoders that tasks build from tokenizer files; nothing is trained here and no file is copied.

Texts are cut where a tokenizer never joins (white space), and what a piece encodes to is remembered for a
bounded number of pieces, since most words of a corpus recur. Vocabularies below 65,536 fit 16 bits a token.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np
import regex

from .common import Memo


def place(name: str) -> str:
    """Where a public tokenizer's file lies on this machine; a path is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


#: Text for which the lower-casing and the letter classes of all libraries agree.
_LATIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-įĲ-ňŊ-ž]+")
#: Signs that stay together behind letters; the apostrophe may begin a part with letters.
_SIGNS = ".,;:!?|%$&*#()[]-"
#: White space for Python but not for the tokenizer, and the opening of special tokens.
_UNUSUAL = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "<|")


def unusual(text: str) -> bool:
    """Whether a text holds one of ``_UNUSUAL``: a search for each runs at the speed of memory, a pattern of all does not."""
    return any([sign in text for sign in _UNUSUAL])


@cache
def word_encoder(name: str = "word_bpe_49k.json") -> Callable[[str], bytes]:
    """text -> the ids of a lower-casing word-level BPE, as little-endian 16-bit numbers.

    The ids are those of the ``tokenizers`` library. Words of Latin letters, digits and signs take a shorter
    way: their merges run in ``tiktoken`` on a table made from the same file, in which the end of a word is
    the byte FF (never part of UTF-8) and joins its letter before all other merges. All else goes to
    ``tokenizers`` itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    path = place(name)
    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
    end = b"\xff"

    def raw(token: str) -> bytes:
        closed = token.endswith("</w>")
        return bytes(byte_of[c] for c in (token[:-4] if closed else token)) + end * closed

    keys = [bytes([b]) for b in range(256)] + [bytes([b]) + end for b in range(255)]
    for merge in model["merges"]:
        left, right = merge if isinstance(merge, list) else merge.split(" ")
        keys.append(raw(left) + raw(right))
    rank = {k: n for n, k in enumerate(keys)}
    number = np.zeros(len(keys), "<u2")
    for token, k in model["vocab"].items():
        if not token.startswith("<|") and raw(token) in rank:
            number[rank[raw(token)]] = k
    merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=rank, special_tokens={})._core_bpe.encode_single_piece
    parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall

    def whole(text: str) -> bytes:
        return np.array(library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    of = [n.tobytes() for n in number]

    def piece(word: str) -> bytes:
        if not word.isascii():
            if not _LATIN.fullmatch(word):
                return whole(word)
            word = unicodedata.normalize("NFC", word)
        elif not word.isprintable():
            return whole(word)
        word = word.lower()
        letters = word.rstrip(_SIGNS)
        if letters.isalpha():  # letters and signs are parts of their own
            ids = seen(letters)  # capitals or signs may be all that is new in a word
            if ids is None:
                ids = b"".join([of[k] for k in merge(letters.encode() + end)])
            return ids if letters == word else ids + signs[word[len(letters) :]]
        return b"".join([of[k] for part in parts(word) for k in merge(part.encode() + end)])

    known, signs = Memo(piece), Memo(piece, 10_000)
    seen = known.get

    def encode(text: str) -> bytes:
        return whole(text) if unusual(text) else b"".join(known.of_all(text.split()))

    return encode
