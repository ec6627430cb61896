"""Byte-level BPE ids for many texts at once.

A vocabulary's path is a parameter. ``*.json`` files are read by ``tokenizers``,
``*.tiktoken`` rank files by ``tiktoken``. The two installed files of the 50,257-id
vocabulary give the same ids (tests compare them); the rank file takes a fifth of
the CPU time, so the queries use it by default. ``tiktoken`` can't match white space of about a million
characters, so long runs of it are cut out by the pattern's own rule: all but the last
character of a run is one piece, or all of it at a text's end. The string ``<|endoftext|>`` in a
text becomes the vocabulary's special id with either file.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable

import numpy as np

VOCABULARY = "byte_bpe_50k.tiktoken"
END_STRING, END_ID = "<|endoftext|>", 50256
#: White space as the vocabularies' pattern knows it (Unicode's White_Space), in runs that are cut out.
LONG_RUN = 50_000
_LONG = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Bpe:
    """Encodes texts to arrays of little-endian unsigned 32-bit ids; null counts as empty."""

    def __init__(self, path: str):
        self.ranks = path.endswith(".tiktoken")
        if self.ranks:
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: Iterable[str | None], special: bool = True) -> list[np.ndarray]:
        """Without ``special``, the special string in a text is ordinary text."""
        if not self.ranks:
            self.tokenizer.encode_special_tokens = not special
            return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        encode = self._by_ranks if special else self._ordinary
        return [np.array(encode(t or ""), "<u4") for t in texts]

    def _by_ranks(self, text: str) -> list[int]:
        if END_STRING not in text:
            return self._ordinary(text)
        out: list[int] = []
        for i, part in enumerate(text.split(END_STRING)):
            out += [END_ID] * (i > 0) + self._ordinary(part)
        return out

    def _ordinary(self, text: str) -> list[int]:
        if len(text) < LONG_RUN:
            return self.encoding.encode_ordinary(text)
        out, at = [], 0
        for m in _LONG.finditer(text):
            end = m.end() - (m.end() < len(text))
            out += self.encoding.encode_ordinary(text[at : m.start()]) + self.encoding._encode_single_piece(text[m.start() : end])
            at = end
        return out + self.encoding.encode_ordinary(text[at:])


_OPEN: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    """The vocabulary at ``path``, loaded once in each Python worker."""
    if path not in _OPEN:
        _OPEN[path] = Bpe(path)
    return _OPEN[path]
