"""Token ids of public byte-level BPE vocabularies. Vocabulary paths are parameters."""

from __future__ import annotations

import os
from array import array
from base64 import b64decode
from functools import lru_cache

import numpy as np

#: Runs of visible bytes or of white space beyond this go to the general tokenizer, whose time doesn't grow with their square.
LONGEST_RUN = 1000


def _longest_run(text: str) -> int:
    """Length in bytes of the longest run without, or of nothing but, ASCII white space and control characters."""
    blank = np.frombuffer(text.encode(), dtype=np.uint8) <= 32
    turns = np.flatnonzero(blank[1:] != blank[:-1])
    ends = np.concatenate([[-1], turns, [len(blank) - 1]])
    return int(np.diff(ends).max())


class Encoder:
    """Ids of whole texts, special tokens neither added nor recognised.

    `path` is a vocabulary of `tokenizers`. With `ranks`, the same vocabulary as ranks,
    texts without overlong runs are encoded by `tiktoken`, which gives the same ids in
    a fraction of the time; the others still go to `tokenizers`.
    """

    def __init__(self, path: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._fast = None
        if ranks:
            import public_tokenizers
            from tiktoken import Encoding

            with open(ranks, "rb") as lines:
                table = {b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
            self._fast = Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def _general(self, text: str) -> np.ndarray:
        found = self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.frombuffer(array("I", found).tobytes(), dtype="<u4")

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """One array of unsigned 32-bit ids per text; None counts as empty."""
        out = []
        for text in texts:
            if not text:
                out.append(np.zeros(0, dtype="<u4"))
            elif self._fast and _longest_run(text) <= LONGEST_RUN:
                out.append(self._fast.encode_to_numpy(text).astype("<u4", copy=False))
            else:
                out.append(self._general(text))
        return out


@lru_cache(maxsize=2)
def encoder(path: str, ranks: str | None = None) -> Encoder:
    """The encoder of this Python worker."""
    return Encoder(path, ranks)


def default_paths() -> tuple[str, str]:
    """The vocabulary and its ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
