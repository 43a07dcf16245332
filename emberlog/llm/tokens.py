"""Token ids of texts, with a cache of pieces.

The byte-level BPE of the tokenizer file never crosses the pieces into which its pattern cuts a text, so
the ids of a text are those of its pieces. Frequent pieces are kept in a bounded cache; texts that hold an added
token (as <|endoftext|>) or characters outside the ranges that the fast pattern covers go through the tokenizer
itself, in its default settings.
"""

from __future__ import annotations

import json
import os
import re

from .common import trim, worker_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces kept by one Python worker at most.
CACHE = 50_000
#: The tokenizer's pattern for texts whose letters are ASCII or Latin-1 and Latin Extended,
#: whose digits are ASCII and whose white space is space, tab and line ends.
SAFE = re.compile(r"[\t\n\r\x20-\x7e¡-©«-±´¶-¸»¿-ɏ‐-‧‰-⁞₠-₿]*")
LETTER = r"A-Za-zÀ-ÖØ-öø-ɏ"
PIECE = re.compile(
    rf" ?[{LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s{LETTER}0-9]+|\s+(?!\S)|\s+"
)
_WORKER: dict[str, Encoder] = {}


class Encoder:
    """Callable: text -> list of ids, as the tokenizer file gives them without special tokens."""

    def __init__(self, path: str):
        known = worker_cache("tokens", _WORKER).get(path)
        if known is not None:
            self.__dict__ = known.__dict__
            return
        self.path, self._tokenizer = path, None
        self.cache: dict[str, tuple[int, ...]] = {}
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        self.added = tuple(t["content"] for t in content.get("added_tokens", ()))
        self.bpe = self._ranks(content["model"])
        _WORKER[path] = self
        del content
        trim()  # the parsed file is several times the vocabulary

    @property
    def tokenizer(self):
        """The file in its own library, read when a text first needs it."""
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
            trim()
        return self._tokenizer

    @staticmethod
    def _ranks(model: dict):
        """The same vocabulary in the faster library; None where the file is not a byte-level BPE."""
        if model.get("type") != "BPE" or model.get("end_of_word_suffix") or model.get("byte_fallback"):
            return None
        import tiktoken

        chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(c): c for c in chars} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in set(chars))}
        try:
            ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if not token.startswith("<|")}
        except KeyError:
            return None
        return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def piece(self, text: str) -> tuple[int, ...]:
        ids = tuple(self.bpe._encode_single_piece(text))
        if len(self.cache) < CACHE:
            self.cache[text] = ids
        return ids

    def __call__(self, text: str) -> list[int]:
        if self.bpe is None or any(t in text for t in self.added) or not SAFE.fullmatch(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        cache, piece, out = self.cache, self.piece, []
        for p in PIECE.findall(text):
            out += cache.get(p) or piece(p)
        return out
