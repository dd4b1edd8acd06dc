"""SentencePiece encoding and decoding with a batched Viterbi over numpy arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegraph.llm.common import spread_rows

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words that a worker remembers before it starts anew.
CACHE = 200_000
#: Codes of single characters without a piece start here, after all piece numbers.
LOOSE = 1 << 22
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Merges never cross from another character to a space mark, so these pieces of a text are encoded apart.
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def read_model(path: str) -> dict:
    """Pieces of a model file: ``text``, ``score`` and ``kind`` (normal, byte or other), by number.

    The library only reads the file here.  Read on the driver, sent to tasks with the code (about 0.5 MB).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    kinds = ["byte" if model.is_byte(i) else "other" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "normal"
             for i in range(len(pieces))]
    return {"text": pieces, "score": [model.get_score(i) for i in range(len(pieces))], "kind": kinds, "unk": model.unk_id()}


class Codec:
    """Encoder and decoder of one vocabulary, with the memory of one worker.

    The encoding is that of the library: the best-scored pair of neighbours whose concatenation is a piece is merged
    first, leftmost first among equals.  Such a segmentation is the only one in which every two neighbours stay as
    they are when encoded together.  So a forward pass suffices: a piece may end at a position if it can follow the
    piece on the best path to its start, and the longest such piece is kept as the backpointer.
    """

    def __init__(self, model: dict) -> None:
        self.number = {t: i for i, (t, k) in enumerate(zip(model["text"], model["kind"], strict=True)) if k == "normal"}
        self.rank = {t: -model["score"][i] for t, i in self.number.items()}
        self.halves: dict[str, tuple[float, str, str] | None] = {}
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(model["text"], model["kind"], strict=True)) if k == "byte"}
        self.unk, self.texts = model["unk"], model["text"]
        self.longest = max(map(len, self.number), default=1)
        texts = list(self.number)
        letters = np.zeros((len(texts), self.longest), np.uint32)
        for i, t in enumerate(texts):
            letters[i, : len(t)] = list(map(ord, t))
        sizes = np.array([len(t) for t in texts], np.int64)
        hashes = np.zeros(len(texts), np.uint64)
        for place in range(self.longest):
            hashes = np.where(sizes > place, hashes * _BASE + letters[:, place] + np.uint64(1), hashes)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.ids = hashes[order], np.array(list(self.number.values()), np.int64)[order]
        self.letters, self.sizes = letters[order], sizes[order]
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces share a hash; choose another base")
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.hashes >> np.uint64(42)] = True
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.raw = [b""] * len(model["text"])
        for t, i in self.number.items():
            self.raw[i] = t.replace(SPACE, " ").encode("utf-8", "surrogatepass")
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        if 0 <= self.unk < len(self.raw):
            self.raw[self.unk] = " ⁇ ".encode()

    def name(self, code: int) -> str:
        return chr(code - LOOSE) if code >= LOOSE else self.texts[code]

    def merge(self, text: str) -> tuple[list[str], dict[str, tuple[str, str]], bool]:
        """The merges themselves: the parts that stay, the two halves of every merged one, and whether later merges
        always had lower scores."""
        parts, halves, steady, last = list(text), {}, True, -np.inf
        while len(parts) > 1:
            rank, i = min((self.rank.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == np.inf:
                break
            steady &= rank >= last
            last = rank
            halves[parts[i] + parts[i + 1]] = (parts[i], parts[i + 1])
            parts[i: i + 2] = [parts[i] + parts[i + 1]]
        return parts, halves, steady

    def split(self, piece: str) -> tuple[float, str, str] | None:
        """Rank and halves of a piece that results from merges of falling score; rank -1 for a character."""
        if len(piece) == 1:
            return -1.0, piece, piece
        if piece not in self.halves:
            parts, halves, steady = self.merge(piece)
            fine = steady and parts == [piece] and all(self.split(h) for h in halves[piece])
            self.halves[piece] = (self.rank[piece], *halves[piece]) if fine else None
        return self.halves[piece]

    def apart(self, left: str, right: str) -> bool:
        """Whether two pieces that are encoded together stay as they are.

        Merges are undone from the last to the first; a pair across the border that ranks before the merge just
        undone would have been merged first.  Pieces with an unusual history are encoded anew.
        """
        a, b = self.split(left), self.split(right)
        if not a or not b:
            return self.merge(left + right)[0] == [left, right]
        limit = np.inf
        while True:
            if self.rank.get(left + right, np.inf) < limit:
                return False
            if a[0] > b[0]:
                limit, left = a[0], a[2]
                a = self.split(left)
            elif b[0] >= 0:
                limit, right = b[0] + 0.5, b[1]
                b = self.split(right)
            else:
                return True

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each ``right`` stays apart from ``left``, and both stay whole; ``left`` -1 is a word's start."""
        keys, back = np.unique((left + 1) << 24 | right, return_inverse=True)
        known = self.pairs
        out = np.empty(len(keys), bool)
        for n, key in enumerate(keys.tolist()):
            hit = known.get(key)
            if hit is None:
                a, b = key >> 24, self.name(key & 0xFFFFFF)
                hit = known[key] = self.apart(self.name(a - 1), b) if a else self.merge(b)[0] == [b]
            out[n] = hit
        return out[back]

    def find(self, hashes: np.ndarray, letters: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose substring is a piece or one character, and its code.

        A bit per hash prefix spares most searches of the sorted keys; equal hashes are checked letter by letter.
        """
        length = letters.shape[1]
        rows = np.flatnonzero(wanted & self.maybe[hashes >> np.uint64(42)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[rows]), len(self.hashes) - 1)
        same = (self.hashes[at] == hashes[rows]) & (self.sizes[at] == length)
        rows, at = rows[same], at[same]
        same = (self.letters[at, :length] == letters[rows]).all(1)
        rows, codes = rows[same], self.ids[at[same]]
        if length == 1:
            loose = wanted.copy()
            loose[rows] = False
            more = np.flatnonzero(loose)
            rows, codes = np.concatenate((rows, more)), np.concatenate((codes, letters[more, 0].astype(np.int64) + LOOSE))
        return rows, codes

    def viterbi(self, words: list[str]) -> list[bytes]:
        """Token numbers (32-bit) of words of one length, which advance together; shorter ones are padded."""
        n, size = len(words), max(map(len, words))
        letters = np.frombuffer("".join(w.ljust(size, chr(0)) for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size)
        prefix = np.zeros((n, size + 1), np.uint64)
        power = np.ones(self.longest + 1, np.uint64)
        for i in range(size):
            prefix[:, i + 1] = prefix[:, i] * _BASE + letters[:, i] + np.uint64(1)
        for i in range(self.longest):
            power[i + 1: i + 2] = power[i: i + 1] * _BASE
        last = np.full((n, size + 1), -1, np.int64)
        back = np.zeros((n, size + 1), np.int64)
        for end in range(1, size + 1):
            best = np.zeros(n, np.int64)
            code = np.full(n, -1, np.int64)
            for length in range(min(end, self.longest), 0, -1):  # one piece fits, so shorter ones are not tried after it
                start = end - length
                live, found = self.find(prefix[:, end] - prefix[:, start] * power[length], letters[:, start:end], best == 0)
                if not len(live):
                    continue
                fits = self.may_follow(last[live, start], found)
                best[live[fits]] = np.maximum(best[live[fits]], length)
                code[live[fits]] = found[fits]
            back[:, end], last[:, end] = best, code
        end = np.array([len(w) for w in words])
        row, steps = np.arange(n), []
        while (end > 0).any():  # all words step back together
            steps.append(np.where(end > 0, last[row, end], -1))
            end = end - back[row, end]
        codes = np.stack(steps[::-1], axis=1)
        plain = (codes < LOOSE).all(1)
        kept = codes >= 0
        flat = codes[kept].astype("<i4").tobytes()
        stops = np.cumsum(kept.sum(1)) * 4
        out = [flat[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]
        for i in np.flatnonzero(~plain).tolist():
            ids: list[int] = []
            for code in codes[i][kept[i]].tolist():
                ids.extend([code] if code < LOOSE else self.fallback(code))
            out[i] = np.array(ids, "<i4").tobytes()
        return out

    def fallback(self, code: int) -> list[int]:
        """A character without a piece: its bytes if the vocabulary has them, else the unknown piece."""
        return [self.bytes[b] for b in chr(code - LOOSE).encode("utf-8", "surrogatepass")] if self.bytes else [self.unk]

    def learn(self, words: set[str]) -> None:
        """Put the tokens of new words into memory."""
        if len(self.pairs) > 3 * CACHE:
            self.pairs.clear()
        by_size: dict[int, list[str]] = {}
        for word in words:
            size = len(word)
            by_size.setdefault(size if size < 12 else 1 << (2 * size - 1).bit_length() if size > 64 else -(-size // 4) * 4, []).append(word)
        for size, same in by_size.items():
            step = max(1, min(8192, (1 << 20) // size))
            for at in range(0, len(same), step):
                part = same[at: at + step]
                self.words.update(zip(part, self.viterbi(part), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token numbers of whole texts; an empty text has none."""
        cut = [_WORDS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.words) > CACHE:
            self.words.clear()
        self.learn(set().union(*cut).difference(self.words))
        get = self.words.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), "<i4") for words in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text; the space that the encoder puts in front is taken off again."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def pieces(sizes: list[int | None], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text."""
    start, size = 0, 0
    for i, own in enumerate(sizes):
        size += own or 0
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


_CODECS: dict[str, Codec] = {}


def worker_codec(name: str, model: dict) -> Codec:
    """One codec a worker process, kept between tasks."""
    if name not in _CODECS:
        _CODECS.clear()
        _CODECS[name] = Codec(model)
    return _CODECS[name]


def round_trip(docs: DataFrame, model_path: str = MODEL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, token_ids, n_tokens, decoded, exact)``, one row per row of ``docs``.

    ``decoded`` is the text decoded from ``token_ids``; ``exact`` tells whether it equals the input.  It does but for
    texts that hold U+2581 themselves, which the vocabulary cannot tell from a space.  A null text has no tokens and
    decodes to null (``exact`` true); an empty one has no tokens.  Other columns are ignored.
    """
    model = read_model(model_path)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(model_path, model)
        for whole in batches:
            for at, stop in pieces(pc.binary_length(whole.column(1)).to_pylist()):
                batch = whole.slice(at, stop - at)
                texts = batch.column(1).to_pylist()
                coded = codec.encode([t or "" for t in texts])
                decoded = [None if t is None else codec.decode(ids) for t, ids in zip(texts, coded, strict=True)]
                sizes = np.array([len(c) for c in coded], np.int32)
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                flat = np.concatenate(coded)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(sizes),
                     pa.array(decoded, pa.string()), pa.array([a == b for a, b in zip(texts, decoded, strict=True)])],
                    ["doc_id", "token_ids", "n_tokens", "decoded", "exact"])

    slim = spread_rows(docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")))
    return slim.mapInArrow(run, f"doc_id {kind}, token_ids array<int>, n_tokens int, decoded string, exact boolean")
