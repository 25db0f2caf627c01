"""Exact token ids of a tokenizer that never joins text across a space or a newline.

The vocabulary ``word_bpe_49k.json`` drops white space and encodes each word on
its own, so the ids of a text are the ids of its space- and newline-separated
chunks in order. Chunks repeat; each distinct one is encoded once and kept in a
bounded cache that lives as long as the worker.

A chunk of printable Latin-1 characters, most of them in practice, is split
here and merged by a byte-pair core built from the same file: the word-end mark
is one byte (0xFF, which UTF-8 never uses), and every vocabulary entry has one
merge that makes it, so merging by the rank of the joined bytes is merging by
the file's list. All other chunks, and those that may hold a special token, go
through the tokenizer itself. Tests hold the two against each other.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

from lorespark.llm.common import single_thread, tokenizer_file

CACHE_CHUNKS = 250_000
CACHE_CHARS = 64  # longer chunks are encoded each time

LATIN = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x100))]
_letters = re.escape("".join(c for c in LATIN if unicodedata.category(c)[0] == "L"))
_digits = re.escape("".join(c for c in LATIN if unicodedata.category(c)[0] == "N"))
PLAIN = re.compile("[!-~\xa1-\xff]+")
#: The file's own pre-tokenizer pattern, its classes spelled out for Latin-1.
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_letters}]+|[{_digits}]|[^\\s{_letters}{_digits}]+")
END_MARK, END = b"\xff", "</w>"


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as is, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def _merge_core(path: str):
    """(a function from a word's bytes to ranks, the id of each rank), or None where the file's form is another."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters, vocab = byte_letters(), model["vocab"]
    if model.get("end_of_word_suffix") != END or not all(x in vocab for x in letters):
        return None

    def spelled(token: str) -> bytes:
        end = token.endswith(END)
        return bytes(letters[c] for c in (token[: -len(END)] if end else token)) + END_MARK * end

    order = sorted(letters, key=letters.get)
    made = [*order, *(x + END for x in order)] + ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    made.remove(chr(0xFF) + END)  # the mark itself ends nothing
    ranks = {spelled(token): i for i, token in enumerate(made)}
    if len(ranks) != len(made):
        return None  # an entry with two merges: ranks of joined bytes would not be the list
    core = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
    return core.encode_single_piece, np.array([vocab[t] for t in made], "<u4")


class WordEncoder(dict):
    """``encode(texts)`` gives one ``bytes`` of little-endian unsigned 32-bit ids per text. Itself the cache of chunks."""

    def __init__(self, tokenizer: str):
        super().__init__()
        single_thread()
        from tokenizers import Tokenizer

        path = tokenizer_file(tokenizer)
        self._tok = Tokenizer.from_file(path)
        self._core = _merge_core(path)

    def __missing__(self, chunk: str) -> bytes:
        if self._core and "<|" not in chunk and PLAIN.fullmatch(chunk):
            merge, ids = self._core
            found: list[int] = []
            for word in WORDS.findall(chunk.lower()):
                found += merge(word.encode() + END_MARK)
            out = ids[found].tobytes() if found else b""
        else:
            out = np.array(self._tok.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_CHUNKS:
                self.clear()
            self[chunk] = out
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        get = self.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").split(" "))) for t in texts]


_encoders: dict[str, WordEncoder] = {}


def encoder(tokenizer: str) -> WordEncoder:
    """This worker's encoder for ``tokenizer``."""
    if tokenizer not in _encoders:
        _encoders[tokenizer] = WordEncoder(tokenizer)
    return _encoders[tokenizer]
