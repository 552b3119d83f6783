"""N-best segmentation into the pieces of a SentencePiece model, and decoding.

Every way to write a text as pieces is a path through a lattice; a path scores the sum of its pieces' scores. Forward Viterbi gives
the best score up to each place, and these are exact estimates for a search from the end backward: A* then yields paths from the
best on. No piece crosses from a letter to a blank or to one of the marks below (the vocabulary is asked for that), so the lattice of a text is a chain
of small ones: each stretch is segmented once and remembered, and the best combinations for the text take other than the best
segmentation only in the stretches where that costs least.

Text is normalised as the model says: blanks become the blank sign, one is put in front, nothing is removed. Characters without a piece are written as bytes.

Nulls: a null text counts as empty and has one segmentation, without pieces. A null id is kept. Repeated rows give equal results. Very long texts are segmented whole. Equal scores are ordered by the search, alike in
every run. An empty table gives an empty result. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows, text_of
from .tokens import path_of

SIGN = "▁"
MARKS = ".,;:!?"
N = 4
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _codes(strings: list[str]) -> np.ndarray:
    """Code points of strings of one length, a row for each."""
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(strings), -1).astype(np.uint64)


def _mixed(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of strings that go on by the columns of codes."""
    for k in range(codes.shape[1]):
        h = (h ^ codes[:, k]) * FACTOR
        h = h ^ (h >> np.uint64(29))
    return h


class Pieces:
    """A model's pieces with ids and scores, and where a text may be cut."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        kinds = [(i, model.id_to_piece(i)) for i in range(model.get_piece_size())]
        self.bytes = {int(p[3:5], 16): i for i, p in kinds if model.is_byte(i)}
        self.back = {i: b for b, i in self.bytes.items()}
        normal = [(p, i) for i, p in kinds if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {p: (i, model.get_score(i)) for p, i in normal}
        self.text = {i: p for p, i in normal}
        #: What pieces begin with -> the piece's id and score; None where it is only the beginning of longer ones.
        self.starts = dict.fromkeys(p[:k] for p in self.ids for k in range(1, len(p))) | {p: (i.to_bytes(4, "little"), score) for p, (i, score) in self.ids.items()}
        hashes = np.concatenate([_mixed(np.zeros(1, np.uint64), _codes([p])) for p in self.ids])
        order = np.argsort(hashes)
        self.hashes, self.by_hash = hashes[order], [list(self.ids.values())[k] for k in order]
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces have one hash")
        self.scores = np.array([*(score for _, score in self.by_hash), -np.inf])
        self.longest = max(map(len, self.ids))
        self.unknown = -2.0 * model.get_piece_size()  # score of a character written as bytes: below any single piece with a rank
        pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        if any(p[1] == SIGN != p[0] for p in pairs):
            raise ValueError("a piece has a blank after another character")
        marks = "".join(m for m in MARKS if not any((p[0] == m) != (p[1] == m) and p[0] != SIGN for p in pairs if m in p))
        line = "" if any("\n" in p for p in self.ids) else "\n"
        inner = re.escape(SIGN + line + marks)
        self.stretch = re.compile(rf"{SIGN}*[^{inner}]+" + (rf"|{SIGN}*[{re.escape(marks)}]+" if marks else "") + rf"|{SIGN}+" + ("|\n" if line else "")).findall

    def arcs(self, s: str) -> list[list[tuple[int, bytes, float]]]:
        """For each end, the arcs (start, ids, score) that end there."""
        out: list[list[tuple[int, bytes, float]]] = [[] for _ in range(len(s) + 1)]
        get, n = self.starts.get, len(s)
        for i in range(n):
            for j in range(i + 1, n + 1):
                found = get(s[i:j], 0)
                if found:
                    out[j].append((i, found[0], found[1]))
                elif found == 0:  # no piece begins so
                    break
            if s[i] not in self.ids:
                out[i + 1].append((i, self.written(s[i]), self.unknown))
        return out

    def written(self, character: str) -> bytes:
        """The ids of a character without a piece: its bytes."""
        return b"".join(self.bytes[b].to_bytes(4, "little") for b in character.encode("utf-8", "surrogatepass"))

    def two_best(self, stretches: list[str]) -> list[tuple[float, bytes, float]]:
        """For each of some stretches of one length: its best score, the ids of that segmentation, and how much less the second best scores (infinite where there is none).

        Forward Viterbi with the two best scores up to each place, over all the stretches at once.
        """
        codes, m, n = _codes(stretches), len(stretches), len(stretches[0])
        first, second = np.full((n + 1, m), -np.inf), np.full((n + 1, m), -np.inf)
        back, piece = np.zeros((n + 1, m), np.int32), np.zeros((n + 1, m), np.int32)
        first[0], every = 0.0, np.arange(m)
        for i in range(n):
            h = np.zeros(m, np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = _mixed(h, codes[:, j - 1 : j])
                at = self.hashes.searchsorted(h)
                at[self.hashes.take(at, mode="clip") != h] = -1
                rows = np.flatnonzero(at >= 0) if j > i + 1 else every
                if not len(rows):
                    continue
                at = at[rows]
                score = np.where(at < 0, self.unknown, self.scores[at])
                one, two, was = first[i][rows] + score, second[i][rows] + score, first[j][rows]
                second[j][rows] = np.maximum(np.minimum(was, one), np.maximum(second[j][rows], two))
                better = one > was
                rows = rows[better]
                first[j][rows], back[j][rows], piece[j][rows] = one[better], i, at[better]
        out, back, piece = [], back.T.tolist(), piece.T.tolist()
        for s, b, p, score, next_score in zip(stretches, back, piece, first[n].tolist(), second[n].tolist(), strict=True):
            ids, j = [], n
            while j:
                ids.append(self.written(s[b[j]]) if p[j] < 0 else self.by_hash[p[j]][0].to_bytes(4, "little"))
                j = b[j]
            out.append((score, b"".join(reversed(ids)), score - next_score))
        return out

    def best(self, s: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of s: (score, ids), best first."""
        arcs = self.arcs(s)
        ahead = [0.0] + [float("-inf")] * len(s)
        for j in range(1, len(s) + 1):
            ahead[j] = max(ahead[i] + score for i, _, score in arcs[j])
        out, ties = [], itertools.count()
        # Among equal estimates the path that is furthest goes on, so ties don't fan out.
        queue = [(-ahead[len(s)], len(s), next(ties), 0.0, None)]
        while queue and len(out) < n:
            _, at, _, behind, path = heapq.heappop(queue)
            if at == 0:
                ids = []
                while path:
                    ids.append(path[0])
                    path = path[1]
                out.append((behind, b"".join(ids)))
                continue
            for i, ids, score in arcs[at]:
                heapq.heappush(queue, (-(ahead[i] + score + behind), i, next(ties), score + behind, (ids, path)))
        return out

    def normal(self, text: str) -> str:
        return SIGN + text.replace(" ", SIGN) if text else ""

    def decode(self, ids) -> str:
        """The text of ids; the blank in front goes."""
        parts = list(map(self.text.get, ids))
        if None in parts:  # bytes
            out, run = [], bytearray()
            for i, part in zip(ids, parts, strict=True):
                if part is None:
                    run.append(self.back[i])
                    continue
                if run:
                    out.append(run.decode("utf-8", "surrogatepass"))
                    run = bytearray()
                out.append(part)
            parts = [*out, run.decode("utf-8", "surrogatepass")]
        return "".join(parts).replace(SIGN, " ")[1:]


class _Memo:
    """stretch -> best score, its ids, what the second best costs; two generations, so that its size is bounded and frequent stretches stay."""

    def __init__(self, pieces: Pieces, keep: int = 600_000):
        self.pieces, self.keep, self.young, self.old = pieces, keep, {}, {}

    def of(self, stretches: list[str]) -> list[tuple[float, bytes, float]]:
        """The stretches' entries. What is not remembered is segmented by length, thousands at once."""
        if len(self.young) >= self.keep:
            self.old, self.young = self.young, {}
        young, new, long = self.young, {}, {}
        for s in set(stretches):
            if s not in young:
                if found := self.old.get(s):
                    young[s] = found
                elif len(s) <= 64:
                    new.setdefault(len(s), []).append(s)
                else:  # not remembered
                    long[s] = self.pieces.two_best([s])[0]
        for same in new.values():
            for k in range(0, len(same), 4000):
                young.update(zip(same[k : k + 4000], self.pieces.two_best(same[k : k + 4000]), strict=True))
        return [long[s] if s in long else young[s] for s in stretches] if long else list(map(young.__getitem__, stretches))


@lru_cache(maxsize=2)
def pieces_of(model: str) -> Pieces:
    return Pieces(path_of(model))


@lru_cache(maxsize=2)
def _memo(model: str) -> _Memo:
    return _Memo(pieces_of(model))


@lru_cache(maxsize=4096)
def _choices(sizes: tuple[int, ...], n: int) -> list[tuple[int, ...]]:
    """Which segmentation to take of each stretch: a way with more better ones than n isn't among the n best."""
    return [c for c in itertools.product(*map(range, sizes)) if math.prod(k + 1 for k in c) <= n]


def _of_text(pieces: Pieces, stretches: list[str], parts: list[tuple[float, bytes, float]], n: int) -> list[tuple[float, bytes]]:
    ids, score = [p[1] for p in parts], sum(p[0] for p in parts)
    gaps = np.fromiter((p[2] for p in parts), np.float64, len(parts))
    # n segmentations can differ from the best only in the n - 1 stretches where the second best costs least.
    few = sorted(np.argpartition(gaps, n - 1)[: n - 1].tolist() if len(gaps) > n - 1 else range(len(gaps)), key=lambda k: (gaps[k], k))
    best = {k: pieces.best(stretches[k], n) for k in few}
    ways = []
    for choice in _choices(tuple(len(best[k]) for k in few), n):
        ways.append((sum(parts[k][0] - best[k][c][0] for k, c in zip(few, choice, strict=True)), choice))
    out = []
    for cost, choice in sorted(ways)[:n]:
        row = ids
        if any(choice):
            row = list(ids)
            for k, c in zip(few, choice, strict=True):
                row[k] = best[k][c][1]
        out.append((score - cost, b"".join(row)))
    return out


def segments(texts: list[str], model: str, n: int, most: int = 4_000_000):
    """For each whole text its n best segmentations: (score, ids as little-endian 32-bit integers). Texts of `most` characters or so go together."""
    memo, at = _memo(model), 0
    while at < len(texts):
        lines, size = [], 0
        while at < len(texts) and (not lines or size + len(texts[at]) <= most):
            lines.append(memo.pieces.stretch(memo.pieces.normal(texts[at])))
            at, size = at + 1, size + len(texts[at])
        parts, start = memo.of([s for line in lines for s in line]), 0
        for line in lines:
            yield _of_text(memo.pieces, line, parts[start : start + len(line)], n)
            start += len(line)


def encode(docs: DataFrame, n: int = N, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, rank (1 is best), score, ids: one row for each of the n best segmentations."""

    def start():
        def body(rows):
            found = segments([text for _, text in rows], model, n)
            return [(doc, k + 1, s, np.frombuffer(ids, "<i4").tolist()) for (doc, _), best in zip(rows, found, strict=True) for k, (s, ids) in enumerate(best)]

        return body

    return map_rows(docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")), start, "doc_id long, rank int, score double, ids array<int>")


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, rank, text of encode()'s rows."""

    def start():
        pieces = pieces_of(model)
        return lambda rows: [(doc, rank, pieces.decode(ids)) for doc, rank, ids in rows]

    return map_rows(encoded.select("doc_id", "rank", "ids"), start, "doc_id long, rank int, text string")


def digests(docs: DataFrame, n: int = N, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_pieces, scores, ids_crc32 (of each segmentation), decoded_sha256 (of the best, decoded), decoded_same (it is the text)."""

    def start():
        pieces = pieces_of(model)

        def body(rows):
            out = []
            for (doc, text), best in zip(rows, segments([text for _, text in rows], model, n), strict=True):
                back = pieces.decode(np.frombuffer(best[0][1], "<i4").tolist())
                out.append((doc, len(best[0][1]) // 4, [s for s, _ in best], [zlib.crc32(ids) for _, ids in best], hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text))
            return out

        return body

    return map_rows(docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")), start, "doc_id long, n_pieces long, scores array<double>, ids_crc32 array<long>, decoded_sha256 string, decoded_same boolean")
