"""Secrets by fixed patterns and a linear-chain conditional random field (operator 2).

The patterns find assignments to secret-like names, access keys and long hexadecimal runs. The field then tags every
token of the text as outside, begin or inside of a secret, from the token's shape (kinds of letters, length, how often
they change), its neighbours' shapes and words, and the whole text (its length, and how dense digits are in it), and the
best path over the text, by Viterbi, gives further spans. It is trained on a bounded sample of documents, whose pattern
matches are its labels, by gradient steps on the log-likelihood; so it finds what stands and looks like a secret but has
another name or form. Its spans that do not lie inside the patterns' are added under the kind ``model``.

Most tokens lie so clearly outside that no path through another tag could win: where outside is better by more than the
neighbours' tags, whatever they may still be, can make up for, the tag is fixed. That bounds the neighbours anew, and after
some rounds of it Viterbi runs over what is left between fixed tokens. All of this is exact. Texts are scanned whole where they lie; nothing is shuffled.

Defined cases: a null text is the empty text, with no spans; a match below its kind's length is dropped after matching;
repeated rows and ids stay separate rows; without a sample, or without any match in it, only the patterns find spans.
Spans are in code points, their end exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableload.llm.rows import map_texts, ship, slices, two_columns, written

# The patterns, in the order of their kinds, and the fewest characters of a match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "model")

#: Documents that the field is trained on at most, tokens kept on either side of a match, windows without one per document.
SAMPLE_DOCS, AROUND, QUIET_WINDOWS = 20_000, 8, 1
#: Training windows at most (distinct ones; half of them each with and without a secret, or what the other kind leaves), passes over them and gradient steps at least, and the penalty on weights.
MOST_WINDOWS, PASSES, STEPS, PENALTY = 20_000, 12, 800, 1e-4
WORD_BUCKETS, SHAPES, FILES = 1 << 14, 1 << 12, 64
CACHED = 200_000
OUT, BEGIN, INSIDE = 0, 1, 2

_TOKEN = re.compile(r"[\w+/.-]+|=+|[^\w\s+/.=-]+")
#: Only a run as long as asked for can be a match, so shorter ones are passed over at once.
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")


Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Spans of the patterns, by start and then kind; and the secrets inside them, without the names they are given to."""
    found, values = [], []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST_ASSIGN:
            found.append((m.start(), 0, m.end()))
            values.append((m.start(2), 0, m.end(2)))
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= LEAST_ACCESS:
            found.append((m.start(), 1, m.end()))
    for m in _LONG_HEX.finditer(text):
        found.append((m.start(), 2, m.end()))
    values += [s for s in found if s[1]]
    return sorted(found), sorted(values)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# --- Features -------------------------------------------------------------------------------------------------------


class Tokens(dict):
    """Two numbers per token: its shape and a hash of its word, as shape * WORD_BUCKETS + word."""

    def __missing__(self, token: str) -> int:
        found = shape(token) * WORD_BUCKETS + xxhash.xxh3_64_intdigest(token.lower().encode("utf-8", "surrogatepass")) % WORD_BUCKETS
        if len(token) <= 64:
            self[token] = found
        return found


_tokens = Tokens()


#: One letter per kind of character: hexadecimal and other lower-case letters, capitals, digits, signs.
_KIND = "".join(
    "h" if "a" <= c <= "f" else "l" if "g" <= c <= "z" else "U" if "A" <= c <= "Z" else "9" if "0" <= c <= "9" else "s"
    for c in map(chr, range(128))
)
_BEYOND = re.compile(r"[^\x00-\x7f]")
_RUNS = re.compile(r"9+|U+|[^9U]+")


def shape(token: str) -> int:
    """Which kinds of characters a token has, its length and how often letters and digits alternate, as one number."""
    ascii_only = token.isascii()
    kinds = (token if ascii_only else _BEYOND.sub("", token)).translate(_KIND)
    bits = sum(1 << k for k, c in enumerate("hlU9s") if c in kinds) + 32 * (not ascii_only)
    turns = min(3, max(0, len(_RUNS.findall(kinds)) - 1).bit_length())
    size = bisect.bisect_left((3, 5, 8, 12, 16, 20, 24, 32), len(token))
    return bits + 64 * (turns + 4 * min(size, 7)) + 2048 * (size == 8)


def features(codes: np.ndarray) -> np.ndarray:
    """Weight rows of every token: own shape, shape and word on each side, the word before that, and the file."""
    shapes, words = codes // WORD_BUCKETS, codes % WORD_BUCKETS
    n = len(codes)
    digits = float((shapes >> 3 & 1).mean()) if n else 0.0
    file = min(7, n.bit_length() // 2) * 8 + min(7, int(digits * 32))
    out = np.empty((n, 7), np.int64)
    at = SHAPES
    out[:, 0] = shapes
    for column, values, size, shift in ((1, shapes, SHAPES, 1), (2, shapes, SHAPES, -1), (3, words, WORD_BUCKETS, 1), (4, words, WORD_BUCKETS, -1), (5, words, WORD_BUCKETS, 2)):
        moved = np.full(n, size, np.int64)  # beyond the text
        if shift > 0:
            moved[shift:] = values[:-shift] if n > shift else values[:0]
        else:
            moved[:shift] = values[-shift:]
        out[:, column] = at + moved
        at += size + 1
    out[:, 6] = at + file
    return out


ROWS = SHAPES + 2 * (SHAPES + 1) + 3 * (WORD_BUCKETS + 1) + FILES


# --- The field ------------------------------------------------------------------------------------------------------


class Field:
    """Emission weights by feature and tag, transition weights by tag before and tag."""

    def __init__(self):
        self.emit = np.zeros((ROWS, 3), np.float32)
        self.move = np.zeros((3, 3), np.float32)
        self.first = np.zeros(3, np.float32)

    def train(self, windows: list[tuple[np.ndarray, np.ndarray]], passes: int = PASSES, seed: int = 3) -> None:
        """Adagrad on the log-likelihood of the tags of each window (features, tags)."""
        rng = np.random.default_rng(seed)
        squares = [np.full_like(p, 1e-2) for p in (self.emit, self.move, self.first)]
        by_length: dict[int, list[int]] = {}
        for k, (rows, _) in enumerate(windows):
            by_length.setdefault(len(rows), []).append(k)
        batches = [ks[i : i + 256] for _, ks in sorted(by_length.items()) for i in range(0, len(ks), 256)]
        for _ in range(max(passes, -(-STEPS // max(1, len(batches))))):
            for b in rng.permutation(len(batches)):
                rows = np.stack([windows[k][0] for k in batches[b]])
                tags = np.stack([windows[k][1] for k in batches[b]])
                self._step(rows, tags, squares)

    def _step(self, rows: np.ndarray, tags: np.ndarray, squares: list[np.ndarray]) -> None:
        n, length, _ = rows.shape
        emit = self.emit[rows].sum(axis=2)
        ahead = np.zeros((n, length, 3), np.float32)
        ahead[:, 0] = emit[:, 0] + self.first
        for t in range(1, length):
            ahead[:, t] = emit[:, t] + _sum_exp(ahead[:, t - 1, :, None] + self.move, 1)
        back = np.zeros((n, length, 3), np.float32)
        for t in range(length - 2, -1, -1):
            back[:, t] = _sum_exp(self.move + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        whole = _sum_exp(ahead[:, -1], 1)
        gold = np.eye(3, dtype=np.float32)[tags]
        tag_error = np.exp(ahead + back - whole[:, None, None]) - gold
        moves = np.zeros((3, 3), np.float32)
        for t in range(1, length):
            both = ahead[:, t - 1, :, None] + self.move + (emit[:, t] + back[:, t])[:, None, :] - whole[:, None, None]
            moves += np.exp(both).sum(axis=0) - np.einsum("na,nb->ab", gold[:, t - 1], gold[:, t])
        place, inverse = np.unique(rows.ravel(), return_inverse=True)
        grad = np.zeros((len(place), 3), np.float32)
        np.add.at(grad, inverse, np.repeat(tag_error.reshape(-1, 3), rows.shape[2], axis=0))
        grad = grad / n + PENALTY * self.emit[place]
        squares[0][place] += grad**2
        self.emit[place] -= 0.3 * grad / np.sqrt(squares[0][place])
        for p, square, g in ((self.move, squares[1], moves / n + PENALTY * self.move), (self.first, squares[2], tag_error[:, 0].mean(axis=0))):
            square += g**2
            p -= 0.3 * g / np.sqrt(square)

    def tags(self, codes: np.ndarray) -> np.ndarray:
        """The best path over a whole text."""
        out = np.zeros(len(codes), np.int64)
        if not len(codes):
            return out
        emit = self.emit[features(codes)].sum(axis=1)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], ~self._outside(emit), [0]])))
        for start, end in zip(edges[::2], edges[1::2], strict=True):
            out[start:end] = self._viterbi(emit[start:end], start == 0, end == len(codes))
        return out

    def _outside(self, emit: np.ndarray, rounds: int = 16) -> np.ndarray:
        """Which tokens every best path has outside: none of their other tags can win, however their neighbours turn out."""
        fixed = np.zeros(len(emit), bool)
        # what another tag gains over outside by the step before and after it: at most, and beside a fixed token
        most_before = (self.move - self.move[:, [OUT]]).max(axis=0)
        most_after = (self.move - self.move[OUT]).max(axis=1)
        for _ in range(rounds):
            sure = np.ones(len(emit), bool)
            for tag in (BEGIN, INSIDE):
                before = np.where(np.append(False, fixed[:-1]), self.move[OUT, tag] - self.move[OUT, OUT], most_before[tag])
                before[0] = self.first[tag] - self.first[OUT]
                after = np.where(np.append(fixed[1:], False), self.move[tag, OUT] - self.move[OUT, OUT], most_after[tag])
                after[-1] = 0
                sure &= emit[:, OUT] - emit[:, tag] > before + after + 1e-4
            if (sure == fixed).all():
                break
            fixed |= sure
        return fixed

    def _viterbi(self, emit: np.ndarray, at_start: bool, at_end: bool) -> np.ndarray:
        """The best path of a run whose neighbours, if any, are outside."""
        best = emit[0] + (self.first if at_start else self.move[OUT])
        came = np.zeros((len(emit), 3), np.int64)
        for t in range(1, len(emit)):
            options = best[:, None] + self.move
            came[t] = options.argmax(axis=0)
            best = options.max(axis=0) + emit[t]
        if not at_end:
            best = best + self.move[:, OUT]
        path = [int(best.argmax())]
        for t in range(len(emit) - 1, 0, -1):
            path.append(int(came[t, path[-1]]))
        return np.array(path[::-1])

    def spans(self, text: str) -> list[Span]:
        """Spans of the best path: from each begin to the last inside that follows it."""
        tokens = _TOKEN.findall(text)
        codes = np.fromiter(map(_tokens.__getitem__, tokens), np.int64, len(tokens))
        tags = self.tags(codes)
        if not tags.any():
            return []
        found: list[Span] = []
        for m, tag, last in zip(_TOKEN.finditer(text), tags, [OUT, *tags], strict=False):
            if tag == INSIDE and last != OUT and found:
                found[-1] = (found[-1][0], 3, m.end())
            elif tag != OUT:
                found.append((m.start(), 3, m.end()))
        return found


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


# --- Training windows -----------------------------------------------------------------------------------------------


def windows_of(text: str, quiet: int = QUIET_WINDOWS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, tags) of the tokens around each secret the patterns find, and of some windows without any."""
    tokens = list(_TOKEN.finditer(text))
    if not tokens:
        return []
    rows = features(np.fromiter((_tokens[m.group()] for m in tokens), np.int64, len(tokens)))
    tags = np.zeros(len(tokens), np.int64)
    _, values = base_spans(text)
    starts = np.array([m.start() for m in tokens])
    ends = np.array([m.end() for m in tokens])
    held = []
    for a, _, b in values:
        inside = np.flatnonzero((starts < b) & (ends > a))
        if len(inside) and not tags[inside].any():
            tags[inside], tags[inside[0]] = INSIDE, BEGIN
            held.append((inside[0], inside[-1] + 1))
    out = []
    for a, b in held:
        low, high = max(0, a - AROUND), min(len(tokens), b + AROUND)
        out.append((rows[low:high], tags[low:high]))
    for k in range(quiet):
        low = xxhash.xxh3_64_intdigest(text[:64].encode("utf-8", "surrogatepass"), seed=k) % len(tokens)
        if not tags[low : low + 2 * AROUND].any():
            out.append((rows[low : low + 2 * AROUND], tags[low : low + 2 * AROUND]))
    return out


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text") -> Field | None:
    """A field trained on a bounded sample of documents, drawn by a hash of the id; None without any match in it."""
    ship(docs.sparkSession)
    source = two_columns(docs, id_col, text_col)
    scale = 1 << 30
    share = int(min(1.0, sample_docs / max(1, source.count())) * scale) + 1
    drawn = source.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < share)

    def run(batches):
        for part in slices(batches):
            found = [w for t in part.column(1).to_pylist() for w in windows_of(t or "")]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([bool(tags.any()) for _, tags in found], pa.bool_()),
                    pa.array([rows.astype("<i4").tobytes() for rows, _ in found], pa.binary()),
                    pa.array([tags.astype("u1").tobytes() for _, tags in found], pa.binary()),
                ],
                names=["secret", "rows", "tags"],
            )

    windows = written(drawn.mapInArrow(run, "secret boolean, rows binary, tags binary").distinct(), "windows")
    size = {r.secret: min(r["count"], MOST_WINDOWS) for r in windows.groupBy("secret").count().collect()}
    if not size.get(True):
        return None
    # by content, so that the same rows are drawn in any order of the input
    kept = [
        windows.where(F.col("secret") == x)
        .orderBy(F.xxhash64("rows"), "rows", "tags")
        .limit(max(MOST_WINDOWS // 2, MOST_WINDOWS - size.get(not x, 0)))
        .select("rows", "tags")
        for x in (True, False)
    ]
    # no more rows than are trained on, and as Arrow columns, since Python objects weigh on a driver; arrays share their memory
    found = kept[0].unionByName(kept[1]).toArrow()
    field = Field()
    field.train([(np.frombuffer(a.as_buffer(), "<i4").reshape(-1, 7), np.frombuffer(b.as_buffer(), "u1")) for a, b in zip(found["rows"], found["tags"], strict=True)])
    return field


def all_spans(text: str, field: Field | None) -> tuple[list[Span], list[Span]]:
    """The patterns' spans, and those with the model's further ones, each by start and then kind.

    A span of the model that reaches beyond the patterns' spans is kept whole, as these may end before the secret does.
    """
    base, _ = base_spans(text)
    further, covered = [], merged(base)
    for span in field.spans(text) if field else []:
        at = bisect.bisect_right(covered, (span[0], len(text))) - 1
        if at < 0 or covered[at][1] < span[2]:
            further.append(span)
    return base, sorted(base + further)


def merged(spans: list[Span]) -> list[tuple[int, int]]:
    """What sorted spans cover, as runs that neither overlap nor touch."""
    out: list[tuple[int, int]] = []
    for a, _, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model`` of every whole text."""
    field = docs.sparkSession.sparkContext.broadcast(fit(docs, sample_docs, id_col, text_col))

    def make():
        model = field.value

        def work(texts):
            if len(_tokens) > CACHED:
                _tokens.clear()
            out = []
            for text in texts:
                base, every = all_spans(text, model)
                *counts, further = [sum(k == kind for _, k, _ in every) for kind in range(len(KINDS))]
                out.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), further))
            return out

        return work

    fields = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long"
    return map_texts(docs, make, fields, id_col, text_col)


def redact(docs: DataFrame, mark: str = "[secret]", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The documents with ``mark`` in place of every span, and their new length in ``size_col``; other columns as they are.

    Overlapping spans are replaced by one mark. A null text stays null.
    """
    field = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col=text_col))
    names = docs.columns
    at = names.index(text_col)
    size_at = names.index(size_col) if size_col in names else -1

    def clean(text: str) -> str:
        out, end = [], 0
        for a, _, b in all_spans(text, field.value)[1]:
            if a >= end:
                out += [text[end:a], mark]
            end = max(end, b)
        return "".join([*out, text[end:]])

    def run(batches):
        for part in slices(batches):
            if len(_tokens) > CACHED:
                _tokens.clear()
            texts = [None if t is None else clean(t) for t in part.column(at).to_pylist()]
            columns = list(part.columns)
            columns[at] = pa.array(texts, part.schema.field(at).type)
            if size_at >= 0:
                columns[size_at] = pa.array([None if t is None else len(t) for t in texts], part.schema.field(size_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
