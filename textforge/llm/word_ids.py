"""Token ids of whole texts by a tokenizers file that drops white space, one word at a time.

The file's splitter has no pattern that looks across white space, its normaliser joins nothing across a space, and
its two added tokens hold none, so a text's ids are those of its space-separated words in order. Each worker asks the
library, with its default settings, once for each word it has not met, for words of letters many at once. Tests hold this against whole texts.
"""

from __future__ import annotations

import itertools
import os
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

#: Bytes of words and ids in a generation, with ENTRY bytes besides for each. A worker remembers two: words that are met
#: again while a new generation fills are taken over, the others are forgotten.
HELD, ENTRY = 80 << 20, 160
#: Characters of texts that are split at once.
BLOCK = 1 << 19
_MARKS = ".,;:!?"
#: What the tokens that end a word end in. Words of letters that are asked for as one text, and such texts at once.
SUFFIX, TOGETHER, ASKED = "</w>", 64, 64


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        #: For each id, whether it ends a word.
        self.last = bytearray(max(vocabulary.values(), default=0) + 1)
        for token, i in vocabulary.items():
            self.last[i] = token.endswith(SUFFIX)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, null as empty; words are looked up for about BLOCK characters at once."""
        held, size = [], 0
        for text in texts:
            held.append(text := text or "")
            size += len(text)
            if size > BLOCK:
                yield from self._encode(held)
                held, size = [], 0
        yield from self._encode(held)

    def _encode(self, texts: list[str]) -> list[bytes]:
        lists = []
        for text in texts:
            # lower() is then the library's own, letter by letter; added tokens are found before it, as they stand
            if _is_latin(text) and "<|" not in text:
                text = text.lower()
            lists.append(text.replace("\n", " ").split(" "))
        try:
            return [b"".join(map(self.known.__getitem__, words)) for words in lists]
        except KeyError:
            self._learn(set().union(*lists))
            return [b"".join(map(self.known.__getitem__, words)) for words in lists]

    def _learn(self, words: set[str]) -> None:
        if self.held > HELD:
            self.known, self.older, self.held = {}, self.known, 0
        known = self.known
        met = words.difference(known)
        older = self.older
        known.update((w, older[w]) for w in met if w in older)  # an intersection would go through all of older for each block
        new = met.difference(known)
        # letters before one mark are split from it by the file's pattern; beyond Latin-1, lower case may end in a mark
        marked = [w for w in new if w[-1:] in _MARKS and w[:-1].isalpha() and _is_latin(w)]
        asked = new.difference(marked).union([w[:-1] for w in marked], _MARKS).difference(known)
        letters = [w for w in asked if w.isalpha() and _is_latin(w)]
        # such a word is one match of the file's pattern, so its last id, and no other, is one that ends a word
        for at in range(0, len(letters), ASKED * TOGETHER):
            self._learn_letters(letters[at : at + ASKED * TOGETHER])
        asked = list(asked.difference(known))
        for w, e in zip(asked, self.tokenizer.encode_batch_fast(asked, add_special_tokens=False), strict=True):
            known[w] = array("I", e.ids).tobytes()
        for w in marked:
            known[w] = known[w[:-1]] + known[w[-1]]
        self.held += sum(map(len, met)) + sum(map(len, map(known.__getitem__, met))) + ENTRY * len(met)

    def _learn_letters(self, words: list[str]) -> None:
        """Learns words of Latin letters, TOGETHER in one text; if their ends are not found, none is learnt."""
        texts = [" ".join(words[k : k + TOGETHER]) for k in range(0, len(words), TOGETHER)]
        ids = array("I", itertools.chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)))
        ends = [4 * at for at in itertools.compress(range(1, len(ids) + 1), map(self.last.__getitem__, ids))]
        if len(ends) == len(words):
            raw = ids.tobytes()
            self.known.update(zip(words, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker."""
    return WordEncoder(path)
