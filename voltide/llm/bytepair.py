"""Byte-pair encoding with a public byte-level vocabulary file of the tokenizers library.

The file's vocabulary is in the order of its merges, so an id is a rank, and tiktoken's faster encoder
gives the same ids. It is told how to cut a text into chunks by the pattern of such vocabularies; texts
without two white space characters in a row are cut by it without its look-ahead, which changes
nothing for them and takes half the time.
"""

from __future__ import annotations

import json
import re
from array import array

# The pattern by which byte-level vocabularies of this kind cut texts, before and after
# the part that looks ahead.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
AHEAD = r"|\s+(?!\S)"
BLANK = r"|\s+"

_RUN = re.compile(r"\s\s")


def byte_of() -> dict[str, int]:
    """The character by which a byte-level vocabulary writes each byte: printable bytes of Latin-1 as
    themselves, the others from U+0100 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairs:
    """Encoder for the vocabulary in a tokenizers file, given as its text. `specials` tells whether
    the special tokens' strings in a text stand for these tokens or are ordinary text."""

    def __init__(self, source: str, specials: bool):
        import tiktoken

        said = json.loads(source)
        own = byte_of()
        added = {t["content"]: t["id"] for t in said["added_tokens"]}
        #: the bytes of every token
        self.tokens = {i: bytes(own[c] for c in piece) for piece, i in said["model"]["vocab"].items() if piece not in added}
        joined = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in said["model"]["merges"]]
        if [said["model"]["vocab"][a + b] for a, b in joined] != sorted(i for i, t in self.tokens.items() if len(t) > 1):
            raise ValueError("the vocabulary is not in the order of its merges")
        ranks = {t: i for i, t in self.tokens.items()}
        self.near = tiktoken.Encoding("near", pat_str=WORDS + BLANK, mergeable_ranks=ranks, special_tokens={})
        self.far = tiktoken.Encoding("far", pat_str=WORDS + AHEAD + BLANK, mergeable_ranks=ranks, special_tokens={})
        self.added = added if specials else {}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def _plain(self, text: str) -> list[int]:
        return (self.far if _RUN.search(text) else self.near).encode_ordinary(text)

    def encode(self, text: str) -> array:
        """The ids of a text, without tokens of the library's own before or after."""
        if not self.cut or not any(s in text for s in self.added):
            return array("I", self._plain(text))
        out = array("I")
        for part in self.cut.split(text):
            out.extend([self.added[part]] if part in self.added else self._plain(part))
        return out
