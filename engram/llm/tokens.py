"""Token ids of texts on the executors."""

from __future__ import annotations

import base64
import json
import os
from functools import cached_property, lru_cache

import numpy as np

#: Longer runs without a break go through the library whose time grows least with them.
LONG_RUN = 2000


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids that the ``tokenizers`` file gives, without special tokens around a text.

    If the same vocabulary lies beside it as ranks, ordinary texts take the faster library; texts that hold the string of a
    special token, or a long run without white space, always take ``tokenizers``.

    plain: the string of a special token is text like any other, so no text can give a special token's id.
    """

    def __init__(self, path: str, plain: bool = False):
        self.path, self.plain = path, plain
        with open(path, encoding="utf-8") as f:
            table = json.load(f)
        added = {t["content"]: t["id"] for t in table.get("added_tokens", [])}
        self.special = () if plain else tuple(added)
        self.size = max([*added.values(), *table["model"]["vocab"].values()]) + 1
        self.fast = None
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    @cached_property
    def slow(self):
        """Loaded when the first text needs it, as it takes its share of memory."""
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if not self.plain:
            return Tokenizer.from_file(self.path)
        with open(self.path, encoding="utf-8") as f:
            return Tokenizer.from_str(json.dumps(json.load(f) | {"added_tokens": []}))

    def ids(self, text: str) -> np.ndarray:
        if self.fast and len(text) >= LONG_RUN and (_spaceless(text) or "  " * 50 in text):
            return self._slow(text)
        if not self.fast or any(s in text for s in self.special):
            return self._slow(text)
        return np.array(self.fast.encode_ordinary(text), np.uint32)

    def _slow(self, text: str) -> np.ndarray:
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def _spaceless(text: str) -> bool:
    """Whether some LONG_RUN characters follow one another without an ASCII space; looks at few of them."""
    at = 0
    while at + LONG_RUN <= len(text):
        last = text.rfind(" ", at, at + LONG_RUN)
        if last < 0:
            return True
        at = last + 1
    return False


@lru_cache(maxsize=2)
def encoder(path: str, plain: bool = False) -> Encoder:
    """One encoder a worker process, file and kind."""
    return Encoder(path, plain)
