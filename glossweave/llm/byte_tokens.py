"""Token ids of the byte-level BPE tokenizer, for batches of whole texts.

Two public libraries read this vocabulary.  ``tokenizers`` defines the ids; ``tiktoken``
gives the same ones several times faster, since both split a text by the same pattern and merge
by the same ranks (a test compares them on every code point).  A text in which ``tokenizers``
would find a special token is left to ``tokenizers`` itself.
"""

from __future__ import annotations

import json
from functools import cached_property, lru_cache

import numpy as np


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, to that byte.

    Printable bytes of Latin-1 stand for themselves; the others, in order, for the code
    points from 256 on.
    """
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteTokenizer:
    """``encode`` gives ids; ``token_bytes`` the bytes of each id."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        self.path = path
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.special = [t["content"] for t in file["added_tokens"]]
        letters = byte_letters()
        added = set(self.special)
        ranks = {bytes(letters[c] for c in t): i for t, i in file["model"]["vocab"].items() if t not in added}
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = max(*ranks.values(), *(t["id"] for t in file["added_tokens"])) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in ranks.items():
            self.token_bytes[i] = token
        for t in file["added_tokens"]:
            self.token_bytes[t["id"]] = t["content"].encode()

    @cached_property
    def library(self):
        """Loaded only by workers that meet a special token."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, texts: list[str], plain: bool) -> list[np.ndarray]:
        """Ids of each text.  ``plain``: strings of special tokens are ordinary text."""
        out = []
        for text in texts:
            if not plain and any(s in text for s in self.special):
                ids = self.library.encode(text, add_special_tokens=False).ids
                out.append(np.array(ids, np.int32))
            else:
                out.append(self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int32))
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteTokenizer:
    """One tokenizer per worker process."""
    return ByteTokenizer(path)
