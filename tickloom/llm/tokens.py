"""Token ids of a public byte-level BPE, a word at a time.

This tokenizer always cuts a text before a single space between two characters that are no white space, so a word
with the space before it is encoded apart and remembered: most words of a corpus come again. Unseen words go to the
tokenizer joined, and its ids are cut again where the bytes of a word end. A text with other white space beside a
space is cut only where the rule holds. What a worker remembers is bounded and only saves time.
"""

from __future__ import annotations

import os
import re

import numpy as np

REMEMBERED = 600_000
LONGEST = 64
#: Unseen words joined for one call.
JOINED = 500
_CUT = re.compile(r"(?<=\S)(?= \S)")


class Encoder:
    """One tokenizer file and the words already met, without their leading space."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, number in vocabulary.items():
            self.bytes_of[number] = len(token)
        self.known: dict[str, bytes | None] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Remember ``words`` as they are encoded after a space; None for those that other white space touches."""
        plain = []
        for word in words:
            if not word or word[0].isspace() or word[-1].isspace():
                self.known[word] = None
            else:
                plain.append(word)
        parts = [plain[at:at + JOINED] for at in range(0, len(plain), JOINED)]
        # The fast form leaves out offsets and token texts; the bytes of each id tell where a word ends.
        for part, found in zip(parts, self.tokenizer.encode_batch_fast([" " + " ".join(part) for part in parts], add_special_tokens=False)):
            ids = np.array(found.ids, dtype="<u4")
            ends = np.cumsum([len(w.encode()) + 1 for w in part])
            stops = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1
            held, last = ids.tobytes(), 0
            for word, stop in zip(part, stops.tolist()):
                self.known[word] = held[4 * last:4 * stop]
                last = stop

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        split = [text.split(" ") for text in texts]
        heads = [words.pop(0) for words in split]
        unseen = set().union(*split).difference(known)
        self.learn(list(unseen))
        out = []
        for text, head, words in zip(texts, heads, split):
            try:
                if words and (not head or head[-1].isspace()):
                    raise TypeError
                out.append(self.whole(head) + b"".join(map(known.__getitem__, words)))
            except TypeError:
                out.append(b"".join([self.whole(c) for c in _CUT.split(text)]))
        for word in unseen:
            if len(word) > LONGEST:
                del known[word]
        return out


_encoders: dict[str, Encoder] = {}


def encoded(texts: list[str], path: str) -> list[bytes]:
    """Each text's ids without special tokens added, as little-endian unsigned 32-bit numbers."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path].encode(texts)
