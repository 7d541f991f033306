"""Byte-level BPE with public rank files, exactly, one byte at a time.

The encoding of a prefix ends with the one token that is a suffix of it and
compatible with the last token of what lies before: two tokens are compatible
when their joined bytes are encoded as just these two.  So the state of a
prefix is its last token and its number of tokens, and a longer prefix is
reached from the states of its own prefixes without encoding anything again.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import regex
import tiktoken

#: Splits text into pieces before any merge; fixed by the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_split_any = regex.compile(PATTERN).findall
#: The same for ASCII text, for the faster matcher.
_split_ascii = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\x0b\x0cA-Za-z0-9]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+""").findall
#: A piece always begins at a space that stands before another sign, whatever lies before it.
split_chunks = re.compile(r" (?=\S)").split
#: Where the public rank file lies; each function takes another path.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def load(path: str) -> tuple[tiktoken.Encoding, dict[bytes, int], int]:
    """The encoding, its ranks and the length of its longest token; once per worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks, max(map(len, ranks))


def split_pieces(text: str) -> list[str]:
    """The pieces of a text; joined they are the text again."""
    return _split_ascii(text) if text.isascii() else _split_any(text)


class PrefixStates:
    """Token counts of sorted pieces, walking their trie depth first.

    Only the states along the current piece are kept; what it shares with the
    next one stays, the rest is dropped.
    """

    def __init__(self, path: str = RANKS, keep: int = 2_000_000) -> None:
        self.encoding, self.ranks, self.longest = load(path)
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.keep = keep
        self.piece = b""
        self.last: list[bytes] = [b""]
        self.count: list[int] = [0]

    def compatible(self, left: bytes, right: bytes) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            whole = left + right
            known = self.encoding._encode_single_piece(whole) == ([self.ranks[left], self.ranks[right]] if left else [self.ranks[right]])
            if len(self.pairs) >= self.keep:
                self.pairs.clear()
            self.pairs[(left, right)] = known
        return known

    def tokens(self, piece: bytes) -> int:
        """Number of tokens of a piece; cheapest when pieces come sorted."""
        shared, most = 0, min(len(piece), len(self.piece))
        while shared < most and piece[shared] == self.piece[shared]:
            shared += 1
        del self.last[shared + 1 :], self.count[shared + 1 :]
        self.piece = piece
        ranks, last, count, compatible = self.ranks, self.last, self.count, self.compatible
        for end in range(shared + 1, len(piece) + 1):
            for start in range(max(0, end - self.longest), end):
                token = piece[start:end]
                if token in ranks and compatible(last[start], token):
                    last.append(token)
                    count.append(count[start] + 1)
                    break
            else:
                raise ValueError(f"no token ends {piece[:end]!r}")
        return count[-1]

    def counts(self, pieces: Iterable[str]) -> Iterator[int]:
        for piece in pieces:
            yield self.tokens(piece.encode("utf-8", "surrogatepass"))


class Chunks:
    """Numbers the stretches of text that lie between spaces; what a stretch consists of is worked out once.

    No piece reaches over the border of two chunks, so a text is the sum of
    its chunks.  ``describe`` gets the pieces of new chunks, each a list, and
    is called once a batch.  Short chunks stay known until there are ``keep``
    of them; then all are forgotten, which changes nothing but the time.
    """

    def __init__(self, describe: Callable[[list[list[str]]], None], forget: Callable[[], None], keep: int = 300_000) -> None:
        self.describe, self.forget, self.keep = describe, forget, keep
        self.heads: dict[str, int] = {}  # the first chunk of a text has no space before it
        self.rest: dict[str, int] = {}

    def number(self, texts: list[str | None]) -> list[list[int]]:
        """The chunks of each text, by number."""
        if len(self.heads) + len(self.rest) >= self.keep:
            self.heads.clear()
            self.rest.clear()
            self.forget()
        heads, rest, new, out = self.heads, self.rest, [], []
        count = len(heads) + len(rest)
        for text in texts:
            if not text:
                out.append([])
                continue
            first, *others = split_chunks(text)
            if first and first not in heads:
                heads[first] = count
                count += 1
                new.append(split_pieces(first))
            try:
                ids = list(map(rest.__getitem__, others))
            except KeyError:
                for chunk in set(others).difference(rest):
                    rest[chunk] = count
                    count += 1
                    new.append(split_pieces(" " + chunk))
                ids = list(map(rest.__getitem__, others))
            if first:
                ids.append(heads[first])
            out.append(ids)
        self.describe(new)
        return out
