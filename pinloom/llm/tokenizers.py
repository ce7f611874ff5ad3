"""Counting and cutting by public tokenizers.

``byt5`` makes each UTF-8 byte one token and needs no file. The others are vocabulary files, whose folder is a parameter or
the setting PINLOOM_TOKENIZERS.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable

FOLDER = os.environ.get("PINLOOM_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: how byte-level BPE of that family cuts text into pieces.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Texts are handed to the tokenizer in blocks of this many characters, cut before white space where there is any.
BLOCK = 1 << 16

_LOADED: dict[tuple[str, str], Callable[[str], int]] = {}


def blocks(text: str, size: int = BLOCK) -> list[str]:
    """The text in blocks of about ``size`` characters; a cut stands before a space or line end, where pieces end anyway."""
    out, start = [], 0
    while len(text) - start > size:
        cut = max(text.rfind(" ", start + 1, start + size), text.rfind("\n", start + 1, start + size))
        cut = start + size if cut <= start else cut
        out.append(text[start:cut])
        start = cut
    out.append(text[start:])
    return out


def counter(name: str, folder: str = FOLDER) -> Callable[[str], int]:
    """A function that counts the tokens of a text; loaded once per worker."""
    if (key := (name, folder)) not in _LOADED:
        if name == "byt5":
            _LOADED[key] = lambda text: len(text.encode("utf-8", "replace"))
        else:
            import tiktoken

            with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            encode = tiktoken.Encoding(name, pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            _LOADED[key] = lambda text: sum(len(encode(b)) for b in blocks(text))
    return _LOADED[key]
