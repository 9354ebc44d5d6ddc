"""Byte-level BPE by segment trees, and decoding (operator 5).

A pre-token is a row of symbols; neighbours that the vocabulary can merge have a rank. A complete binary tree over the
neighbour pairs keeps, in every node, the smallest ``(rank, position)`` below it, so the root is the leftmost pair of
lowest rank. A merge changes two pairs at most, and each change is carried up one path: O(log n) per merge, until the root
has no rank left. All pre-tokens of a batch that need as many leaves are held as the rows of one numpy array, one tree per
row, and every step merges once in each of them.

A pre-token never spans a space that follows another character than white space, so texts are cut there and the ids of
each piece are kept in a bounded cache per Python worker; nothing is shuffled.

Defined cases: a null text is the empty text, which has no ids; the vocabulary's special strings inside a text become
their ids, as the tokenizers library does by default; repeated rows and ids stay separate rows.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import regex
from pyspark.sql import DataFrame

from tableload.llm.rows import map_texts

#: Pre-tokens of byte-level BPE, a fixed value of the vocabulary's published format.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = np.int64(2**62)
#: Cached pieces per Python worker, and the longest piece that is cached.
CACHED = 200_000
CACHED_BYTES = 64


def byte_alphabet() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else 256 + k for the k-th."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, others = {b: chr(b) for b in printable}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + others)
            others += 1
    return [letters[b] for b in range(256)]


class Merges:
    """Which two neighbouring symbols merge, at what rank, and into which symbol."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray, symbols: int):
        self.symbols = np.int64(symbols)
        key = left.astype(np.int64) * self.symbols + right
        order = np.argsort(key)
        self.keys, self.ranks, self.merged = key[order], np.arange(len(key))[order], merged.astype(np.int64)
        # a table of the pairs, open addressing by doubling: most probes end at the first place
        bits = max(4, int(len(key) * 8).bit_length())
        self.shift = np.uint64(64 - bits)
        self.size = 1 << bits
        self.table_keys = np.full(self.size, -1, np.int64)
        self.table_ranks = np.full(self.size, NO_RANK, np.int64)
        self._fill(key)

    def _place(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _fill(self, key: np.ndarray) -> None:
        rest, at = np.arange(len(key)), self._place(key)
        self.probes = 0
        while len(rest):
            self.probes += 1
            free = self.table_keys[at] == -1
            _, first = np.unique(at, return_index=True)
            wins = np.zeros(len(rest), bool)
            wins[first] = True
            wins &= free
            self.table_keys[at[wins]], self.table_ranks[at[wins]] = key[rest[wins]], rest[wins]
            rest, at = rest[~wins], (at[~wins] + 1) % self.size

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NO_RANK where the two don't merge or one is missing (negative)."""
        key = np.where((left < 0) | (right < 0), np.int64(-2), left * self.symbols + right)
        at = self._place(key)
        out = np.full(len(key), NO_RANK, np.int64)
        rest = np.arange(len(key))
        for _ in range(self.probes):
            held = self.table_keys[at]
            same = held == key[rest]
            out[rest[same]] = self.table_ranks[at[same]]
            go = ~same & (held != -1)
            if not go.any():
                break
            rest, at = rest[go], (at[go] + 1) % self.size
        return out


def merge_all(merges: Merges, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of symbols, one after the other, after all their merges, leftmost lowest rank first; and their new lengths."""
    starts = np.cumsum(lengths) - lengths
    widths = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
    counts = np.zeros(len(lengths), np.int64)
    done = []
    for width in np.unique(widths):
        group = np.flatnonzero(widths == width)
        step = max(1, int(2**21 // width))
        for start in range(0, len(group), step):
            some = group[start : start + step]
            merged, counts[some] = _merge_group(merges, symbols, starts[some], lengths[some], int(width))
            done.append((some, merged))
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    for some, merged in done:
        n = counts[some]
        out[np.repeat(ends[some] - np.cumsum(n), n) + np.arange(len(merged))] = merged
    return out, counts


def _merge_group(
    merges: Merges, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    n = len(starts)
    place = np.arange(width)
    inside = place < lengths[:, None]
    symbol = np.where(inside, flat[np.minimum(starts[:, None] + place, len(flat) - 1)], -1)
    after = np.where(place + 1 < lengths[:, None], place + 1, -1)
    before = np.broadcast_to(place - 1, (n, width)).copy()
    # node 1 is the root, leaves are width .. 2 * width - 1; a node holds rank * width + position
    tree = np.full((n, 2 * width), NO_RANK, np.int64)
    right = np.where(after >= 0, np.roll(symbol, -1, axis=1), -1)
    rank = merges.rank(symbol.ravel(), right.ravel()).reshape(n, width)
    tree[:, width:] = np.where(rank < NO_RANK, rank * width + place, NO_RANK)
    half = width // 2
    while half:
        tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
        half //= 2

    def carry(who: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        node = at + width
        tree[who, node] = value
        while node[0] > 1:
            node = node >> 1
            tree[who, node] = np.minimum(tree[who, 2 * node], tree[who, 2 * node + 1])

    live = np.flatnonzero(tree[:, 1] < NO_RANK)
    while len(live):
        best = tree[live, 1]
        at, which = best % width, best // width
        gone = after[live, at]
        symbol[live, at] = merges.merged[which]
        symbol[live, gone] = -1
        following = after[live, gone]
        after[live, at] = following
        linked = following >= 0
        before[live[linked], following[linked]] = at[linked]
        carry(live, gone, np.full(len(live), NO_RANK))
        next_symbol = np.where(linked, symbol[live, np.maximum(following, 0)], -1)
        own = merges.rank(symbol[live, at], next_symbol)
        carry(live, at, np.where(own < NO_RANK, own * width + at, NO_RANK))
        ahead = before[live, at]
        has = ahead >= 0
        if has.any():
            who, where = live[has], ahead[has]
            left = merges.rank(symbol[who, where], symbol[who, at[has]])
            carry(who, where, np.where(left < NO_RANK, left * width + where, NO_RANK))
        live = live[tree[live, 1] < NO_RANK]
    rest = symbol >= 0
    return symbol[rest], rest.sum(axis=1)


class ByteBpe:
    """Encoder and decoder for a byte-level BPE vocabulary file of the tokenizers library."""

    _open: dict[str, ByteBpe] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary, pairs = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in pairs]
        letters = byte_alphabet()
        value = {letter: b for b, letter in enumerate(letters)}
        self.byte_ids = np.array([vocabulary[c] for c in letters], np.int64)
        size = 1 + max([*vocabulary.values(), *(a["id"] for a in spec["added_tokens"])])
        self.merges = Merges(
            np.array([vocabulary[a] for a, _ in pairs]),
            np.array([vocabulary[b] for _, b in pairs]),
            np.array([vocabulary[a + b] for a, b in pairs]),
            size,
        )
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.bytes_of = [b""] * size
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(value[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self._pre_token = regex.compile(PRE_TOKEN)
        names = sorted(map(re.escape, self.special), key=len, reverse=True)
        self._special = re.compile(f"({'|'.join(names)})") if names else None
        self._pieces: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> ByteBpe:
        """One encoder, with its cache, per Python worker and file."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        pieces = [cut(t) for t in texts]
        if len(self._pieces) > CACHED:
            self._older, self._pieces = self._pieces, {}
        cache, older = self._pieces, self._older
        new = {p for ps in pieces for p in ps if p not in cache}
        for p in [p for p in new if p in older]:
            cache[p] = older[p]
            new.discard(p)
        self._encode_pieces(list(new), cache)
        out = [b"".join([cache[p] for p in ps]) for ps in pieces]
        for p in [p for p in new if len(p) > CACHED_BYTES]:
            del cache[p]
        return out

    def _encode_pieces(self, pieces: list[str], into: dict[str, bytes]) -> None:
        """Add the ids of each piece to ``into``."""
        if not pieces:
            return
        tokens, parts, special = [], [], []
        for piece in pieces:
            before = len(tokens)
            if self._special and "<" in piece:
                for k, part in enumerate(self._special.split(piece)):
                    if k % 2:
                        special.append((len(tokens), self.special[part]))
                        tokens.append(" ")  # one symbol, put right below
                    else:
                        tokens += self._pre_token.findall(part)
            elif piece[0] == " " and piece[1:].isalpha():
                tokens.append(piece)
            else:
                tokens += self._pre_token.findall(piece)
            parts.append(len(tokens) - before)
        raw = [t.encode("utf-8", "surrogatepass") for t in tokens]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        for k, symbol in special:
            symbols[lengths[:k].sum()] = symbol
        ids, counts = merge_all(self.merges, symbols, lengths)
        packed, size = ids.astype("<u4").tobytes(), 4 * np.cumsum(counts)
        start = 0
        for piece, end in zip(pieces, size[np.cumsum(parts) - 1].tolist(), strict=True):
            into[piece] = packed[start:end]
            start = end

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special ones included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_ODD_SPACE = re.compile(r"[^\S ] |  ")
_CUT = re.compile(r"(?<=\S)(?= )")


def cut(text: str) -> list[str]:
    """Pieces of a text that no pre-token spans: before each space that follows another character than white space."""
    if not text:
        return []
    if _ODD_SPACE.search(text):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    if not first:  # the text begins with a space, which belongs to what follows
        return [" " + p for p in rest]
    return [first, *[" " + p for p in rest]]


def encode_ids(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens long, ids binary`` (little-endian unsigned 32-bit integers) of every whole text."""

    def make():
        bpe = ByteBpe.of(vocabulary)
        return lambda texts: [(len(i) // 4, i) for i in bpe.encode(texts)]

    return map_texts(docs, make, "n_tokens long, ids binary", id_col, text_col)


def decode_ids(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, text`` of what :func:`encode_ids` returned."""
    import pyarrow as pa
    from pyspark.sql.types import StringType, StructField, StructType

    from tableload.llm.rows import ship, slices

    ship(encoded.sparkSession)
    schema = StructType([encoded.schema["doc_id"], StructField("text", StringType())])

    def run(batches):
        bpe = ByteBpe.of(vocabulary)
        for part in slices(batches):
            texts = [bpe.decode(np.frombuffer(i or b"", "<u4")) for i in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of the ids and of the text decoded from them."""

    def make():
        bpe = ByteBpe.of(vocabulary)

        def work(texts):
            out = []
            for ids in bpe.encode(texts):
                decoded = bpe.decode(np.frombuffer(ids, "<u4"))
                text_digest = hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), text_digest))
            return out

        return work

    return map_texts(docs, make, "n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col)
