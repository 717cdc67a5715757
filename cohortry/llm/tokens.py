"""Token ids of whole texts by a public tokenizer, each distinct word encoded once.

``Encoder.encode(text)`` gives exactly what ``tokenizers`` gives for the text.  Both kinds of
pre-tokenisation used here never join characters across a single space or line break, so a
text's ids are those of its words in a row, and most words of a corpus recur.  Texts for
which that reasoning doesn't hold (runs of spaces, rare kinds of space, strings of added
tokens, which the library takes for those tokens) are encoded whole.
"""

from __future__ import annotations

import json
import struct
from functools import lru_cache

import public_tokenizers

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Words that one worker remembers (twice that at most); about 200 bytes each.
REMEMBERED = 800_000
#: Marks that often follow a word; neither letters, digits nor spaces.
MARKS = ".,;:!?*%&$#|()"
#: Python splits at these, or may, and the tokenizers' patterns don't.
ODD_SPACES = "\x1c\x1d\x1e\x1f᠎"


#: All that Python splits at, but for the space and the line break.
OTHER_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]


def tokenizer_path(name: str) -> str:
    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level models write for bytes which aren't printable Latin-1."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()


class _Words(dict):
    """Ids of words, as little-endian unsigned 32-bit integers; forgets what is long unused.

    A word of Latin letters is one piece to the pre-tokeniser, so it goes to the tokenizer's
    model at once; marks after it are a piece of their own.  Other words take the whole way.
    """

    def __init__(self, tokenizer, whole, prefix: str, lower: bool, limit: int):
        self.model, self.whole, self.prefix, self.lower, self.limit = tokenizer.model, whole, prefix, lower, limit
        self.space = " ".translate(BYTE_LETTERS) if prefix else ""
        self.old, self.marks = {}, {}

    def letters(self, word: str) -> bytes:
        if self.lower:
            word = word.lower()
        text = self.space + word.encode().decode("latin-1").translate(BYTE_LETTERS)
        ids = [t.id for t in self.model.tokenize(text)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            core = word.rstrip(MARKS)
            if not core.isalpha() or max(core) > "\xff":
                ids = self.whole(self.prefix + word)
            elif core == word:
                ids = self.letters(word)
            else:
                marks = word[len(core) :]
                after = self.marks.get(marks) or self.marks.setdefault(marks, self.whole(marks))
                ids = self[core] + after
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
                self.marks.clear()
            self[word] = ids
        return ids


class Encoder:
    """One tokenizer of a worker process."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 2**16 else "<u4"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, self.added = spec["pre_tokenizer"], [t["content"] for t in spec["added_tokens"]]
        split = (pre.get("pretokenizers") or [{}])[0]
        if pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            self.encode = self._spaces_kept
        elif split.get("behavior") == "Removed" and split.get("invert") and r"[^\s\p{L}\p{N}]+" in split["pattern"].get("Regex", ""):
            self.encode = self._spaces_dropped
        else:
            self.encode = self.whole
        lower = self.encode == self._spaces_dropped
        self.first = _Words(self.tokenizer, self.whole, "", lower, remembered)
        self.later = _Words(self.tokenizer, self.whole, " ", lower, remembered)
        self.line_break = self.whole("\n")

    def whole(self, text: str) -> bytes:
        """Ids straight from the library."""
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _spaces_kept(self, text: str) -> bytes:
        # Each space or line break must stand alone between words, without spaces of other kinds;
        # then the pattern never takes two.
        if len(text.split()) != text.count(" ") + text.count("\n") + 1 or any(map(text.__contains__, OTHER_SPACES)) or any(map(text.__contains__, self.added)):
            return self.whole(text)
        first, later, out = self.first, self.later.__getitem__, []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            out.append(first[head] + b"".join(map(later, rest)))
        return self.line_break.join(out)

    def _spaces_dropped(self, text: str) -> bytes:
        if any(map(text.__contains__, ODD_SPACES)) or any(map(text.__contains__, self.added)):
            return self.whole(text)
        return b"".join(map(self.first.__getitem__, text.split()))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of this worker process; workers are used again by later tasks."""
    return Encoder(path)
