"""Pre-tokens of the piece model: units whose encodings can be put side by side.

No piece holds a space after another character, and none holds a line feed, so a text
(with the space that the model puts in front) may be cut before every run of spaces and
before every line feed: the encoding of the text is that of its pre-tokens in order.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: The model writes a space as U+2581 and does not tell the two apart.
PRE_TOKEN = re.compile("[ ▁]+[^ ▁\n]*|\n[^ ▁\n]*")

#: Longer pre-tokens are never cached, so that the size of a cache is bounded.
LONGEST_CACHED = 64


def pre_tokens(text: str | None) -> list[str]:
    """Pre-tokens of a whole text, in order; none for a null or empty text.

    One that starts with a space is given without it, so only those after a line feed
    start with one.
    """
    if not text:
        return []
    if text[0] != " " and "▁" not in text:
        marked = text.replace("\n", " \n")
        if "  " not in marked:
            return marked.split(" ")
    return [t if t[0] == "\n" else t[1:] for t in PRE_TOKEN.findall(" " + text)]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def checked_model(path: str) -> str:
    """``path``, if its model reads texts as the operators here do: the only change to a text is a space
    in front and U+2581 for spaces, pieces are merged pairs, and characters without one become bytes.
    """
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    rules, training = model.normalizer_spec, model.trainer_spec
    plain = not rules.precompiled_charsmap and not rules.normalization_rule_tsv
    spaces = rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
    if not (plain and spaces) or training.treat_whitespace_as_suffix:
        raise ValueError(f"{path}: a normaliser that changes more than spaces is not supported")
    if training.model_type != training.BPE or not training.byte_fallback:
        raise ValueError(f"{path}: only BPE models with byte fallback are supported")
    return path


@lru_cache(maxsize=2)
def processor(path: str):
    """The library's processor, once per worker process."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def library_lengths(path: str, tokens: list[str]) -> list[int]:
    """Lengths of the library's encodings of pre-tokens.

    The library puts a space in front of what it encodes.  That is the one a pre-token is
    given without; before a line feed it stays alone and is taken off again.
    """
    ids = processor(path).encode(tokens, num_threads=1)
    return [len(x) - 1 if t[:1] == "\n" else max(1, len(x)) for t, x in zip(tokens, ids)]
