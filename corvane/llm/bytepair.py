"""Byte-pair encoding by walking a trie of distinct words.

For every prefix of a word exactly one token can end its encoding: the one that suits the last token
of what stands before it, in the sense that no merge across their border would have come first. So
the last token of each prefix follows from those of shorter prefixes, and words that share a prefix
share those states. Distinct words are visited in byte order, which is the depth-first order of
their trie; a stack holds the states of the current branch and each trie node is worked out once.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterable

import regex

#: The pattern that cuts text into words before the merges of this kind of vocabulary.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the machine keeps the public vocabulary `name`."""
    return importlib.import_module("public_tokenizers").path(name)


def _byte_letters() -> dict[str, int]:
    """The letter by which such vocabularies write each byte: printable ones stand for themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairTrie:
    """Encoder of one byte-level vocabulary.

    Words seen before are remembered, up to `remember` of them; then the memory starts anew, which
    changes no result.
    """

    def __init__(self, path: str, remember: int = 400_000) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = _byte_letters()
        as_bytes = lambda word: bytes(byte_of[c] for c in word)
        # Added tokens such as an end mark hold letters of the byte alphabet too, but come from no merge.
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        vocab = model["vocab"]
        self.made_of: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.ids: dict[bytes, int] = {}
        self.rank: dict[int, int] = {}
        for letter, byte in byte_of.items():
            if letter in vocab:
                self.ids[bytes([byte])] = vocab[letter]
                self.rank[vocab[letter]] = -1
        for rank, (a, b) in enumerate(merges):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.pairs[left, right] = rank
            if whole not in self.made_of:
                self.made_of[whole] = (left, right)
                self.rank[whole] = rank
                self.ids[as_bytes(a + b)] = whole
        self.length = {i: len(t) for t, i in self.ids.items()}
        ends: dict[bytes, set[int]] = {}
        for t in self.ids:
            if len(t) > 1:
                ends.setdefault(t[-2:], set()).add(len(t))
        self.ends = {pair: sorted(sizes, reverse=True) for pair, sizes in ends.items()}
        self.suits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.remember = remember
        self.find = regex.compile(WORD_PATTERN).findall

    def _suit(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens stay apart when their joined bytes are encoded.

        Undoes the merges of both, the latest first, and asks at each border whether it would have
        been closed before the merge that was undone last.
        """
        key = (left, right)
        known = self.suits.get(key)
        if known is not None:
            return known
        rank, made_of, pairs = self.rank, self.made_of, self.pairs
        # Everything merged earlier than `limit` may still happen at the border.
        limit_rank, limit_side = len(pairs), 0
        suits = True
        while True:
            at = pairs.get((left, right))
            if at is not None and (at < limit_rank or (at == limit_rank and limit_side == 1)):
                suits = False
                break
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                break
            if a > b or (a == b):
                # On the same merge the left occurrence closes first, so the right is undone first.
                if a == b:
                    right, limit_rank, limit_side = made_of[right][0], b, 1
                else:
                    left, limit_rank, limit_side = made_of[left][1], a, 0
            else:
                right, limit_rank, limit_side = made_of[right][0], b, 1
        if len(self.suits) > 2_000_000:
            self.suits.clear()
        self.suits[key] = suits
        return suits

    def _learn(self, words: Iterable[str]) -> None:
        """Encode distinct words, each shared prefix once."""
        ids, ends, length, suit = self.ids, self.ends, self.length, self._suit
        states: list[int] = []  # the last token of each prefix of the branch
        before = b""
        for word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            data, text = word
            size = len(data)
            shared, most = 0, min(size, len(before))
            if before[:most] == data[:most]:
                shared = most
            else:
                while before[shared] == data[shared]:
                    shared += 1
            del states[shared:]
            for end in range(shared + 1, size + 1):
                found = -1
                if end > 1:
                    for n in ends.get(data[end - 2 : end], ()):
                        if n > end:
                            continue
                        token = ids.get(data[end - n : end])
                        if token is not None and (n == end or suit(states[end - n - 1], token)):
                            found = token
                            break
                states.append(found if found >= 0 else ids[data[end - 1 : end]])
            out, end = [], size
            while end:
                token = states[end - 1]
                out.append(token)
                end -= length[token]
            out.reverse()
            self.words[text] = tuple(out)
            before = data

    def encode_batch(self, texts: Iterable[str | None]) -> list[list[int]]:
        """Token ids of each text; an empty list for empty and missing texts."""
        cut = [self.find(t) if t else [] for t in texts]
        if len(self.words) > self.remember:
            self.words.clear()
        known = self.words
        new = {w for words in cut for w in words if w not in known}
        if new:
            self._learn(new)
        out = []
        for words in cut:
            ids: list[int] = []
            for w in words:
                ids += known[w]
            out.append(ids)
        return out
