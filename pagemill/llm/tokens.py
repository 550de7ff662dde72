"""Token ids of whole texts, with a bounded cache of words.

The vocabulary drops white space and never joins characters across it, so a
text's ids are those of its words in turn. Texts in Latin-1, whose characters
are composed already and change case one by one, are lower-cased and split
first, and the ids of a word are found once; other texts go through the
tokenizer whole.
"""

from __future__ import annotations

from array import array
from functools import cache

import numpy as np

VOCABULARY, END = "word_bpe_49k.json", 2
#: Words that a worker's cache holds before it starts anew.
CACHED = 1_000_000


class Words(dict):
    """Word -> its ids as little-endian 16-bit words."""

    def __init__(self, tokenizer) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.model = tokenizer, tokenizer.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {i: level.pre_tokenize_str(chr(i))[0][0] for i in range(256) if chr(i).isalpha()}

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():  # letters are never parted: straight to the model
            found = array("H", [t.id for t in self.model.tokenize(word.translate(self.letters))]).tobytes()
        elif word[-1] in ".," and word[:-1].isalpha():
            found = self[word[:-1]] + self[word[-1]]
        else:
            found = encode(self.tokenizer, word)
        if len(self) >= CACHED:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


@cache
def load(path: str) -> Words:
    """The tokenizer at ``path``, one for each worker process."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if tokenizer.get_vocab_size() > 1 << 16:
        raise ValueError("ids are kept in 16 bits")
    return Words(tokenizer)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(tokenizer, text: str) -> bytes:
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()


def token_ids(words: Words, text: str | None) -> bytes:
    """A text's ids and the end id, as little-endian 16-bit words. Null is an empty text."""
    text = text or ""
    plain = True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        plain = False
    # what str.split() parts at, but the tokenizer doesn't; and strings of special tokens
    if plain and not any(c in text for c in "\x1c\x1d\x1e\x1f") and "<|" not in text:
        found = b"".join(map(words.__getitem__, text.lower().split()))
    else:
        found = encode(words.tokenizer, text)
    return found + END.to_bytes(2, "little")
