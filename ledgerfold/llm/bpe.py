"""Byte-level BPE in linear time, for vocabularies with a merge list.

A text is cut into words by the vocabulary's pattern. The tokens of a word are found by backtracking over the longest
matches of an Aho-Corasick automaton: two tokens may stand side by side only if the merges, applied to the
bytes of both, would end in just these two; a sequence in which all neighbours may stand so is the one that the merges
make. Both the words' tokens and the answers about neighbours are remembered.
"""

from __future__ import annotations

import json
from itertools import chain

#: The place of the vocabularies, if the caller names none.
DEFAULT_DIR = "/opt/tokenizers"

#: Remembered words and neighbours are forgotten beyond this many, so a worker's memory is bounded.
WORDS, NEIGHBOURS = 400_000, 1_000_000


def byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest
    follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def word_pattern():
    """The vocabulary's own pattern, for any text."""
    import regex

    return regex.compile(r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def ascii_pattern():
    """The same for texts of ASCII characters only, on which the standard library is faster."""
    import re

    return re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


class Encoder:
    """Token ids of texts by one vocabulary. Strings that look like special tokens are ordinary text."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        to_byte = byte_of_char()
        latin = str.maketrans({c: chr(b) for c, b in to_byte.items()})
        ids = {word.translate(latin): i for word, i in model["vocab"].items() if all(c in to_byte for c in word)}
        self.parts: dict[int, tuple[int, int]] = {}
        self.whole: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            a, b = (merge.split(" ") if isinstance(merge, str) else merge)
            a, b = a.translate(latin), b.translate(latin)
            made = ids[a + b]
            self.whole[ids[a], ids[b]] = made
            self.parts.setdefault(made, (ids[a], ids[b]))
        # The order of the merges decides; a token's rank is its merge's place, and single bytes come before all.
        self.rank = dict.fromkeys(ids.values(), -1)
        for place, made in enumerate(self.parts):
            self.rank[made] = place
        self.ids, self.length = ids, {i: len(w) for w, i in ids.items()}
        self.automaton = ahocorasick.Automaton()
        for word, i in ids.items():
            self.automaton.add_word(word, i)
        self.automaton.make_automaton()
        self.beside: dict[tuple[int, int], bool] = {}
        self.words = _Words(self)
        self.ascii_words, self.any_words = ascii_pattern().findall, word_pattern().findall

    def may_stand_beside(self, left: int, right: int) -> bool:
        """True if the merges leave left and right apart, given that each is what the merges make of its own bytes.

        The seam is followed back through the merges that built the two sides, the latest first. At each step the
        tokens that meet at the seam must not have a merge that would have come before the one just undone.
        """
        known = self.beside.get((left, right))
        if known is not None:
            return known
        if len(self.beside) >= NEIGHBOURS:
            self.beside.clear()
        rank, parts, whole = self.rank, self.parts, self.whole
        a, b, undone, from_left = left, right, None, False
        answer = True
        while True:
            made = whole.get((a, b))
            if made is not None and (undone is None or rank[made] < undone or (rank[made] == undone and not from_left)):
                answer = False
                break
            # Undo the later of the two sides' last merges; of equal ones the right side's, as merges go from left to right.
            if rank[a] > rank[b]:
                undone, from_left = rank[a], True
                a = parts[a][1]
            elif rank[b] >= 0:
                undone, from_left = rank[b], False
                b = parts[b][0]
            else:
                break
        self.beside[left, right] = answer
        return answer

    def encode_word(self, word: str) -> list[int]:
        """The ids of one word of the pattern."""
        text = word.encode("utf-8").decode("latin-1")
        known = self.ids.get(text)
        if known is not None and (len(text) == 1 or known in self.parts):
            return [known]
        size, length, may = len(text), self.length, self.may_stand_beside
        # Tokens that start at each place, from short to long; the longest is tried first.
        at: list[list[int]] = [[] for _ in range(size)]
        for end, token in self.automaton.iter(text):
            at[end + 1 - length[token]].append(token)
        path: list[tuple[int, int, int]] = []  # place, token, how many shorter ones are left to try
        dead = bytearray(size + 1)  # places from which the rest can't be encoded
        place, choice = 0, len(at[0]) - 1
        while place < size:
            last = path[-1][1] if path else None
            options = at[place]
            while choice >= 0:
                token = options[choice]
                if not dead[place + length[token]] and (last is None or may(last, token)):
                    break
                choice -= 1
            if choice >= 0:
                path.append((place, token, choice))
                place += length[token]
                choice = len(at[place]) - 1 if place < size else 0
            else:
                dead[place] = 1
                place, _, choice = path.pop()
                choice -= 1
        return [token for _, token, _ in path]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; null and empty texts have none."""
        if not text:
            return []
        words = self.ascii_words(text) if text.isascii() else self.any_words(text)
        if len(self.words) > WORDS:
            self.words.clear()
        return list(chain.from_iterable(map(self.words.__getitem__, words)))


class _Words(dict):
    """The ids of words, worked out when first asked for. Long words aren't kept."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> list[int]:
        ids = self.encoder.encode_word(word)
        if len(word) <= 64:
            self[word] = ids
        return ids
