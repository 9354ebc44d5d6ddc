"""Token ids of a lower-casing BPE vocabulary with word ends, for whole texts.

What stands between spaces and line feeds is encoded on its own, as the vocabulary drops white space. The usual case, a
pre-token of ASCII and Latin-1 letters, digits and marks, is encoded by a merge-by-rank library over an alphabet in which
a byte that ends a word is another symbol; everything else, special strings included, by the tokenizers library itself.
Ids are kept per worker for the first pre-tokens seen, and per batch of texts for the others.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

from tableload.llm.token_counts import library_tokenizer

#: Pre-tokens whose ids a worker keeps, and characters of a text that are encoded at a time.
CACHED, STRETCH = 400_000, 1 << 20

# The word pattern of the vocabulary file, and its suffix of word ends.
FILE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

_LETTERS = "a-zß-öø-ÿ"
_PLAIN = "!-~À-ÖØ-öø-ÿ"
_OTHER = re.compile(f"[^ {_PLAIN}]+")
#: ``FILE_PATTERN`` for lower-cased plain pre-tokens.
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s0-9{_LETTERS}]+")
_END = "\x01"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Known(dict):
    """Indices of pre-tokens; a new one gets the next index and waits to be encoded."""

    def __init__(self):
        super().__init__()
        self.waiting: list[str] = []

    def __missing__(self, token: str) -> int:
        index = self[token] = len(self)
        self.waiting.append(token)
        return index


class WordIds:
    """Ids of texts by a vocabulary file; one per Python worker and file."""

    def __init__(self, vocabulary: str):
        self.library = library_tokenizer(vocabulary)
        with open(vocabulary, encoding="utf-8") as file:
            declared = json.load(file)
        words = declared["model"].get("end_of_word_suffix")
        if words != WORD_END or FILE_PATTERN not in json.dumps(declared["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\"):
            raise ValueError(f"{vocabulary} is no vocabulary of lower-cased words with word ends")
        letters, ranks = byte_letters(), {}
        for token, rank in declared["model"]["vocab"].items():
            ends = token.endswith(WORD_END) and token != WORD_END
            body = token.removesuffix(WORD_END) if ends else token
            ranks[bytes(letters[c] for c in body) + _END.encode() * ends] = rank
        self.encoder = tiktoken.Encoding(
            vocabulary, pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={}
        )
        self.size = self.library.get_vocab_size()
        self.ends = np.zeros(self.size, bool)
        self.ends[[rank for token, rank in ranks.items() if token.endswith(_END.encode())]] = True
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known = Known()
        self.first, self.count = np.zeros(CACHED, np.int64), np.zeros(CACHED, np.int64)
        self.ids, self.used = np.zeros(4 * CACHED, np.uint32), 0

    def others(self, tokens: list[str]) -> set[str]:
        """Those pre-tokens that are not plain, or hold a special string."""
        row, end, found = " ".join(tokens), -1, set()
        for m in _OTHER.finditer(row):
            if m.start() > end:
                end = row.find(" ", m.end())
                end = len(row) if end < 0 else end
                found.add(row[row.rfind(" ", 0, m.start()) + 1 : end])
        special = [s for s in self.special if s in row]
        return found | {t for t in tokens if any(s in t for s in special)} if special else found

    def encode_tokens(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each pre-token has, and all ids in a row."""
        others = self.others(tokens)
        plain = [t not in others for t in tokens]
        marked = _PIECE.sub(rf"\g<0>{_END}", " ".join([t for t, p in zip(tokens, plain, strict=True) if p]).lower())
        found = self.encoder.encode_to_numpy(marked.replace(" ", ""))
        # plain pre-tokens in lower case are Latin-1: the word ends before each space
        row = np.frombuffer(marked.encode("latin-1") + b" ", np.uint8)
        pieces = np.cumsum(row == ord(_END))[row == ord(" ")]
        last = np.concatenate([[0], np.flatnonzero(self.ends[found]) + 1])[pieces]
        if all(plain):
            return np.diff(last, prepend=0), found
        begin, out = np.concatenate([[0], last[:-1]]), []
        own = iter(zip(begin, last, strict=True))
        for token, p in zip(tokens, plain, strict=True):
            if p:
                a, b = next(own)
                out.append(found[a:b])
            else:
                out.append(np.array(self.library.encode(token, add_special_tokens=False).ids, np.uint32))
        return np.array([len(i) for i in out]), np.concatenate(out)

    def _learn(self) -> None:
        tokens = self.known.waiting
        if not tokens:
            return
        count, ids = self.encode_tokens(tokens)
        at = len(self.known) - len(tokens)
        if len(self.known) > len(self.first):
            more = np.zeros(2 * len(self.known) - len(self.first), np.int64)
            self.first, self.count = np.append(self.first, more), np.append(self.count, more)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(self.used + 2 * len(ids) - len(self.ids), np.uint32))
        self.first[at : len(self.known)] = self.used + np.cumsum(count) - count
        self.count[at : len(self.known)] = count
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _forget(self) -> None:
        """Keep the first pre-tokens only, so that a worker's memory is bounded whatever it has seen."""
        tokens, self.known.waiting = self.known.waiting, []
        if len(self.known) <= CACHED:
            return
        kept = max(0, CACHED - (len(self.known) - len(tokens)))
        for token in tokens[kept:]:
            del self.known[token]
        at = len(self.known)
        self.used = int(self.first[at - 1] + self.count[at - 1]) if at else 0

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text, unsigned 32-bit. Pre-tokens are cut and told apart by Arrow, and each looked up once."""
        if not len(texts):
            return []
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        tokens = coded.dictionary.to_numpy(zero_copy_only=False)
        index = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))[coded.indices.to_numpy()]
        self._learn()
        count = self.count[index]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.first[index] - (ends - count), count) + np.arange(total)]
        self._forget()
        bounds = np.concatenate([[0], ends])[words.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode_long(self, text: str) -> np.ndarray:
        """The ids of one text of any length, by stretches that end at a space."""
        found = [self.encode([s])[0] for s in stretches(text)]
        return found[0] if len(found) == 1 else np.concatenate(found)


def stretches(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > STRETCH:
        cut = max(text.rfind(" ", at, at + STRETCH), text.rfind("\n", at, at + STRETCH))
        if cut < at:
            cuts = [c for c in (text.find(" ", at + STRETCH), text.find("\n", at + STRETCH)) if c >= 0]
            if not cuts:
                break
            cut = min(cuts)
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


_encoders: dict[str, WordIds] = {}


def word_ids(vocabulary: str) -> WordIds:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = WordIds(vocabulary)
    return _encoders[vocabulary]
