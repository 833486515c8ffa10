"""Token ids of texts by the public byte-level vocabularies, whose files' place is a parameter."""

from __future__ import annotations

import base64
import os
import re

import numpy as np

NAME = "byte_bpe_50k"
# Latin text, whose letter and white-space classes are the same in every release of Unicode.
LATIN = "\t-\r -~\xa0-ɏ"


def default_folder() -> str:
    import public_tokenizers

    return os.path.dirname(public_tokenizers.path(f"{NAME}.json"))


class Encoder:
    """Ids as the tokenizer file gives them with add_special_tokens=False.

    No special token is added; the name of one that stands in a text is read as
    that token, as the file has it.  The same vocabulary as ranks gives the same ids
    for Latin text in a fifth of the time; a text with other characters or with the
    name of an added token goes to the tokenizer itself.
    """

    def __init__(self, folder: str | None = None, name: str = NAME):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        folder = folder or default_folder()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.exact = Tokenizer.from_file(f"{folder}/{name}.json")
        added = [re.escape(t.content) for t in self.exact.get_added_tokens_decoder().values()]
        self.other = re.compile("|".join([f"[^{LATIN}]", *added]))
        with open(f"{folder}/{name}.tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype="<u4")
        if self.other.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


_encoders: dict[tuple, Encoder] = {}


def encoder(folder: str | None = None, name: str = NAME) -> Encoder:
    """One per worker process: loading the vocabulary takes longer than a small task."""
    if (folder, name) not in _encoders:
        _encoders[folder, name] = Encoder(folder, name)
    return _encoders[folder, name]
