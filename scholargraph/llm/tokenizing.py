"""Pre-tokens of a word-end BPE tokenizer file, exactly as the tokenizers library makes them.

The library spends most of its time in normalising and splitting. Texts of plain Latin characters are
split here by an equal pattern; any other text (other scripts, control characters, special strings)
goes through the library's own normaliser and splitter.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

#: Letters of the plain range, as a character class body.
_LETTERS = "a-zªµºß-öø-įı-ňŊ-ž"
#: Anything but TAB..CR, printable ASCII and Latin letters and signs whose case and form are stable.
_UNUSUAL = re.compile("[^\t-\r -~¡-±´-¸º»¿-įı-ňŊ-ž]|<\\|")
_PIECES = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9]|[^\t-\r 0-9{_LETTERS}]+")
#: The split pattern for which the plain path holds.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Characters of the longest pre-token that is kept, and bytes of an entry besides its own.
LONGEST_KEPT, ENTRY_BYTES = 64, 200


class Words:
    """Splits texts into pre-tokens and encodes single pre-tokens, with a memo of ids bounded by bytes.

    Long pre-tokens, as of scripts without spaces or of runs of letters, are seldom met again and not kept.
    """

    def __init__(self, path: str, most_bytes: int = 120_000_000):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        spec = json.load(open(path, encoding="utf-8"))
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._split = pre_tokenizers.Split(Regex(PATTERN), "removed", invert=True)
        if PATTERN not in json.dumps(spec["pre_tokenizer"]).replace("\\\\", "\\"):
            raise ValueError(f"{path} splits words by another pattern")
        self.most_bytes, self._bytes, self._ids = most_bytes, 0, {}

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text; a special string inside it is one pre-token of its own."""
        if _UNUSUAL.search(text) is None:
            return _PIECES.findall(text.lower())
        out: list[str] = []
        for part in self._cut.split(text) if self._cut else [text]:
            if part in self.special:
                out.append(part)
            elif part:
                out += [w for w, _ in self._split.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part))]
        return out

    def learn(self, words) -> dict[str, bytes]:
        """Ids of those of ``words`` that are not kept. Short ones are kept from now on; a full memo starts afresh."""
        new = [w for w in words if w not in self._ids]
        made = {w: array("I", e.ids).tobytes() for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False) if new else [])}
        for w, ids in made.items():
            if len(w) <= LONGEST_KEPT:
                if self._bytes > self.most_bytes:
                    self._ids.clear()
                    self._bytes = 0
                self._ids[w] = ids
                self._bytes += ENTRY_BYTES + 4 * len(w) + len(ids)
        return made

    def ids(self, text: str) -> bytes:
        """A text's ids as little-endian unsigned 32-bit numbers."""
        words = self.split(text)
        try:
            return b"".join(map(self._ids.__getitem__, words))
        except KeyError:
            kept = {w: self._ids[w] for w in dict.fromkeys(words) if w in self._ids}
            return b"".join(map((kept | self.learn(w for w in dict.fromkeys(words) if w not in kept)).__getitem__, words))

    def counts(self, words: list[str]) -> list[int]:
        """The number of ids of each of some distinct pre-tokens."""
        return [len(e) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    """One per Python worker and file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Words(path)
