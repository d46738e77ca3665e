"""Per-document kernels of chunkers whose state is sequential."""

from __future__ import annotations

import json
import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

_END = re.compile(r"(?<=[.!?])\s+")
Embed = Callable[[list[str]], np.ndarray]


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Spans of sentences, white space around them left out."""
    cuts = [0, *(p for m in _END.finditer(text) for p in (m.start(), m.end())), len(text)]
    out = []
    for a, b in zip(cuts[::2], cuts[1::2], strict=True):
        part = text[a:b]
        if part.strip():
            lead = len(part) - len(part.lstrip())
            out.append((a + lead, a + len(part.rstrip())))
    return out


def sentence_list(text: str) -> list[str]:
    return [text[a:b] for a, b in sentence_spans(text)]


def hashing_embedder(texts: list[str], dim: int = 64) -> np.ndarray:
    """A deterministic stand-in for a model: signed counts of hashed words."""
    out = np.zeros((len(texts), dim))
    for row, text in zip(out, texts, strict=True):
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            row[h % dim] += 1 if h >> 16 & 1 else -1
    return out


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row products of unit rows; a zero row is like nothing."""
    na, nb = (np.linalg.norm(x, axis=-1, keepdims=True) for x in (a, b))
    return (a / np.where(na == 0, 1, na)) @ (b / np.where(nb == 0, 1, nb)).T


def unit_rows(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n == 0, 1, n)


def neighbours(v: np.ndarray) -> np.ndarray:
    """Cosines of each row and the next."""
    u = unit_rows(v)
    return np.einsum("ij,ij->i", u[:-1], u[1:])


def group_spans(text: str, spans: list[tuple[int, int]], size: int) -> list[dict]:
    out = []
    for at in range(0, len(spans), size):
        some = spans[at : at + size]
        out.append({"text": " ".join(text[a:b] for a, b in some), "start_char": some[0][0], "end_char": some[-1][1], "start_sentence": at, "end_sentence": at + len(some)})
    return out


# -- lexical cohesion ---------------------------------------------------------


@dataclass
class Tiling:
    """Text tiling with sentence ends as the places where a cut may fall."""

    w: int
    k: int
    smoothing_width: int
    smoothing_rounds: int
    policy: str
    stopwords: frozenset
    splitter: Callable
    _drop: re.Pattern = field(default=re.compile(r"[^a-z\-' \n\t]"))

    def scores(self, words: list[str]) -> list[float]:
        """Cosine of the word counts on both sides of each gap; sides shrink near the ends."""
        blocks = [Counter(x for x in words[i : i + self.w] if x not in self.stopwords) for i in range(0, len(words), self.w)]
        gaps = len(blocks) - 1
        sides, bounds, squares, common = (Counter(), Counter()), [[0, 0], [0, 0]], [0, 0], 0
        out = []
        for g in range(gaps):
            reach = min(self.k, g + 1, gaps - g)
            for side, wanted in enumerate(((g + 1 - reach, g + 1), (g + 1, g + 1 + reach))):
                own, other = sides[side], sides[1 - side]
                # from one gap to the next few blocks come and go; counts, squares and products follow them
                for sign, moved in ((1, range(bounds[side][1], wanted[1])), (-1, range(bounds[side][0], wanted[0]))):
                    for word, n in (x for b in moved for x in blocks[b].items()):
                        common += sign * n * other[word]
                        squares[side] += n * (2 * sign * own[word] + n)
                        own[word] += sign * n
                bounds[side] = list(wanted)
            size = squares[0] * squares[1]
            out.append(common / math.sqrt(size) if size else 0.0)
        return out

    def smooth(self, scores: list[float]) -> list[float]:
        """Flat window of smoothing_width + 1 over the mirrored ends."""
        x, n = np.array(scores), self.smoothing_width + 1
        mirrored = np.r_[2 * x[0] - x[n:1:-1], x, 2 * x[-1] - x[-1:-n:-1]]
        y = np.convolve(np.ones(n) / n, mirrored, mode="same")
        return y[n - 1 : -n + 1].tolist()

    def depths(self, scores: list[float]) -> np.ndarray:
        """How far a gap lies below the peaks that rise from it to either side; nothing near the ends."""
        x = np.array(scores)
        left, right = x.copy(), x.copy()
        for i in range(1, len(x)):
            left[i] = max(left[i], left[i - 1]) if x[i - 1] >= x[i] else x[i]
        for i in range(len(x) - 2, -1, -1):
            right[i] = max(right[i], right[i + 1]) if x[i + 1] >= x[i] else x[i]
        out = left + right - 2 * x
        clip = min(max(len(x) // 10, 2), 5)
        out[:clip] = 0
        out[-clip:] = 0
        return out

    def cuts(self, text: str) -> list[int]:
        ends = [0, *dict.fromkeys(b for _, b in self.splitter(text))]
        words = re.findall(r"[\w'\-]+", self._drop.sub("", text.lower()))
        if len(ends) < 2 or len(words) <= self.w:
            return []
        scores = self.scores(words)
        if len(scores) < self.smoothing_width + 1:
            return []
        depth = self.depths(self.smooth(scores))
        limit = depth.mean() - depth.std() / (1 if self.policy == "lc" else 2)
        found: list[int] = []
        gap = 0
        for count, end in enumerate((m.end() for m in re.finditer(r"[^ \t\n]+(?=[ \t\n])", text)), 1):
            # a gap is reached with the white space after more words than it has before it
            if gap < len(depth) and count > max(gap * self.w, self.w):
                if depth[gap] > limit:
                    i = min(bisect_left(ends, end + 1), len(ends) - 1)
                    near = ends[i - 1] if i and end + 1 - ends[i - 1] <= ends[i] - end - 1 else ends[i]
                    found.append(near)
                gap += 1
        return [x for x in dict.fromkeys(found) if x]

    def chunks(self, text: str) -> list[dict]:
        marks = self.cuts(text)
        parts = [text[a:b] for a, b in zip([0, *marks], [*marks, len(text)], strict=True) if a < b or not marks]
        return [{"text": p.strip(), "segment_index": i} for i, p in enumerate(parts) if p.strip()]


# -- embeddings ---------------------------------------------------------------


def max_min_chunks(sentences: list[str], embed: Embed, c: float, hard: float, init: float) -> list[dict]:
    """A sentence joins while its best likeness to the chunk passes a limit that grows with the chunk's worst."""
    if not sentences:
        return []
    unit = unit_rows(np.asarray(embed(sentences), float))
    groups, first, worst = [], 0, -math.inf
    for i in range(1, len(sentences)):
        own, size = unit[first:i] @ unit[i], i - first
        if size == 1:
            limit, best, worst = 0.0, init * own[0], own[0]
        else:
            limit, best = worst * c / (1 + math.exp(1 - size)), own.max()
            worst = min(worst, own.min())
        if best <= max(limit, hard):
            groups.append((first, i))
            first, worst = i, -math.inf
    return [{"text": " ".join(sentences[a:b])} for a, b in [*groups, (first, len(sentences))]]


def chain_chunks(sentences: list[str], embed: Embed, threshold: float) -> list[dict]:
    if not sentences:
        return []
    far = np.round(1 - neighbours(np.asarray(embed(sentences), float)), 12)  # distances at the threshold stay there
    cuts = [0, *(np.flatnonzero(far >= threshold) + 1).tolist(), len(sentences)]
    return [{"text": " ".join(sentences[a:b])} for a, b in zip(cuts, cuts[1:], strict=False)]


def chain_by_merging(vectors: np.ndarray, threshold: float) -> list[list[int]]:
    """Brute force for tests: merge the closest neighbours until none is closer than the threshold."""
    groups = [[i] for i in range(len(vectors))]
    while len(groups) > 1:
        near = [min(1 - cosines(vectors[a : a + 1], vectors[b : b + 1])[0, 0] for a in x for b in y if abs(a - b) == 1) for x, y in zip(groups, groups[1:], strict=False)]
        at = int(np.argmin(near))
        if near[at] >= threshold:
            break
        groups[at : at + 2] = [groups[at] + groups[at + 1]]
    return groups


@dataclass
class Recursive:
    """Semantic splits, taken further where pieces are long, joined where they are short, then sized."""

    max_chunk_size: int
    recursive_threshold: int
    delta: float
    merge_threshold: int
    final_threshold: int
    breakpoint_percentile: float
    embed: Embed
    splitter: Callable

    def segments(self, text: str) -> list[str]:
        if len(text) <= self.max_chunk_size:
            return [text]
        out, held, size = [], [], 0
        for s in self.splitter(text):
            if held and (len(s) > self.max_chunk_size or size + len(s) > self.max_chunk_size):
                out.append(" ".join(held))
                held, size = [], 0
            if len(s) > self.max_chunk_size:
                out += [s[i : i + self.max_chunk_size] for i in range(0, len(s), self.max_chunk_size)]
            else:
                held.append(s)
                size += len(s) + 1
        return [*out, " ".join(held)] if held else out

    def split(self, text: str) -> list[str]:
        """Cut where neighbouring sentences (each with one to either side) are unlike beyond the percentile."""
        s = [x for x in re.split(r"(?<=[.?!])\s+", text)]
        if len(s) < 2:
            return [text] if text.strip() else []
        v = np.asarray(self.embed([" ".join(s[max(0, i - 1) : i + 2]) for i in range(len(s))]), float)
        far = 1 - neighbours(v)
        cuts = [0, *(np.flatnonzero(far > np.percentile(far, self.breakpoint_percentile)) + 1).tolist(), len(s)]
        return [p for p in (" ".join(s[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)) if p.strip()]

    def deepen(self, text: str, limit: float) -> list[str]:
        if len(text) <= limit:
            return [text]
        parts = self.split(text)
        if len(parts) == 1 and len(parts[0]) >= len(text):
            return [text]
        return [x for p in parts for x in self.deepen(p, max(limit - self.delta, 1.0))]

    def join_short(self, parts: list[str]) -> list[str]:
        """A short piece goes to the more similar neighbour, of equals to the one before."""
        parts = list(parts)
        if len(parts) < 2:
            return parts
        v = [*np.asarray(self.embed(parts), float)]
        i = 0
        while i < len(parts):
            if len(parts[i]) > self.merge_threshold or len(parts) == 1:
                i += 1
                continue
            before = cosines(v[i - 1][None], v[i][None])[0, 0] if i else -math.inf
            after = cosines(v[i][None], v[i + 1][None])[0, 0] if i + 1 < len(parts) else -math.inf
            a = i - 1 if i and before >= after else i
            parts[a : a + 2] = [parts[a] + parts[a + 1]]
            v[a : a + 2] = [np.asarray(self.embed([parts[a]]), float)[0]]
            i = max(0, a)
        return parts

    def sized(self, text: str, separators: tuple = ("\n\n", "\n", " ", "")) -> list[str]:
        """Pieces of at most the final size, cut at the coarsest separator that helps."""
        if len(text) <= self.final_threshold:
            return [text]
        sep = next((s for s in separators if s == "" or s in text), "")
        rest = separators[separators.index(sep) + 1 :]
        if sep == "":
            return [text[i : i + self.final_threshold] for i in range(0, len(text), self.final_threshold)]
        out, held = [], ""
        for i, piece in enumerate(text.split(sep)):
            piece = piece if i == 0 else sep + piece
            if len(held) + len(piece) <= self.final_threshold:
                held += piece
                continue
            out.append(held)
            held = piece
            if len(piece) > self.final_threshold:
                *whole, held = self.sized(piece, rest)
                out += whole
        return [x.strip() for x in [*out, held] if x.strip()]

    def chunks(self, text: str) -> list[dict]:
        if not text.strip():
            return []
        parts = []
        for segment in self.segments(text):
            deep = [x for p in self.split(segment) for x in (self.deepen(p, float(self.recursive_threshold)) if len(p) > self.recursive_threshold else [p])]
            parts += self.join_short(deep)
        parts = [x for p in parts for x in self.sized(p)]
        return [{"text": p, "start_char": a, "end_char": b} for p, (a, b) in zip(parts, offsets(text, parts), strict=True) if p]


def offsets(text: str, parts: list[str]) -> list[tuple[int, int]]:
    """Where the parts lie in the text, white space disregarded; a part not found is placed at the last end."""
    where = [i for i, c in enumerate(text) if not c.isspace()]
    dense = "".join(text[i] for i in where)
    out, seen, last = [], 0, 0
    for p in parts:
        own = "".join(p.split())
        at = dense.find(own, seen) if own else -1
        if at < 0:
            out.append((last, min(last + len(p), len(text))))
            continue
        seen = at + len(own)
        last = where[seen - 1] + 1
        out.append((where[at], last))
    return out


# -- models -------------------------------------------------------------------


def lumber_chunks(sentences: list[str], ask: Callable[[str], str], threshold: int, tail: int = 5) -> list[dict]:
    """Windows of numbered sentences go to the model, which names the one where the content shifts."""
    named = [f"ID {i}: {s}" for i, s in enumerate(sentences)]
    tokens = lambda a, b: round(1.2 * sum(len(x.split()) for x in named[a:b]))
    cuts, at = [], 0
    while at < len(named) - tail:
        n = 0
        while (n == 0 or tokens(at, at + n) < threshold) and at + n < len(named) - 1:
            n += 1
        prompt = "\nDocument:\n" + "\n".join(named[at : at + max(1, n - 1)])
        here = at + n - 1
        try:
            answer = re.search(r"Answer: ID (\w+)", ask(prompt) or "")
        except RuntimeError:
            answer = None
        number = re.search(r"\d+", answer[1]) if answer else None
        found = int(number[0]) if number else None
        if found is not None and found >= at and found < len(named):  # an earlier one would go round in circles
            cuts.append(found)
            at = found + 1
        else:
            at = here + 1
    marks = [0, *cuts, len(named)]
    return [{"text": "\n".join(sentences[a:b])} for a, b in zip(marks, marks[1:], strict=False)]


def json_payload(text: str):
    """The first JSON value in the text, alone or amid other text."""
    decoder, text = json.JSONDecoder(), text.strip()
    for at in [0, *(m.start() for m in re.finditer(r"[{\[]", text))]:
        try:
            return decoder.raw_decode(text, at)[0]
        except ValueError:
            continue
    raise ValueError("no JSON value")


def proposition_list(output: str) -> list[str]:
    """Propositions of a model's output: a JSON list, an object that holds one, or else its lines."""
    if not output.strip():
        return []
    try:
        found = json_payload(output)
        found = found.get("propositions") if isinstance(found, dict) else found
        if not isinstance(found, list):
            raise ValueError("no list of propositions")
    except ValueError:
        found = [line.lstrip("-*• ") for line in output.splitlines()]
    return [x for x in (str(p).strip() for p in found) if x]


def token_windows(tokens: int, window: int, overlap_ratio: float) -> list[tuple[int, int]]:
    step = window - math.ceil(window * overlap_ratio)
    out = []
    for a in range(0, tokens, step):
        out.append((a, min(a + window, tokens)))
        if a + window >= tokens:
            break
    return out


def propositions(text: str, propose: Callable[[str], str], budget: int, overlap_ratio: float) -> list[dict]:
    words = text.split()
    parts = [text] if len(words) <= budget else [" ".join(words[a:b]) for a, b in token_windows(len(words), budget, overlap_ratio)]
    return [{"text": p, "window_segment_index": i, "total_window_segments": len(parts)} for i, part in enumerate(parts) for p in proposition_list(propose(part))]


# -- graph segmentation -------------------------------------------------------


#: Rows of a block of products.
BLOCK = 1024


def related(left: np.ndarray, right: np.ndarray, threshold: float) -> bool:
    """Whether any row of one is like any row of the other beyond the threshold; blocks bound the memory."""
    return any((left[i : i + BLOCK] @ right[j : j + BLOCK].T > threshold).any() for i in range(0, len(left), BLOCK) for j in range(0, len(right), BLOCK))


def graph_segments(v: np.ndarray, threshold: float, least: int) -> list[tuple[int, int]]:
    """Segments of sentences: neighbours in a clique of related sentences join, then those that share a clique, then the small ones.

    Two sentences share some maximal clique exactly where they are related, so cliques need not be listed.
    """
    if not len(v):
        return []
    u = unit_rows(v)
    marks = [0, *(np.flatnonzero(neighbours(v) <= threshold) + 1).tolist(), len(v)]
    merged: list[tuple[int, int]] = []
    for a, b in zip(marks, marks[1:], strict=False):
        if merged and related(u[slice(*merged[-1])], u[a:b], threshold):
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    centre = lambda s: u[slice(*s)].mean(axis=0)  # noqa: E731  (the mean likeness of two segments is the product of their centres)
    i = 0
    while len(merged) > 1 and i < len(merged):
        if merged[i][1] - merged[i][0] >= least:
            i += 1
            continue
        own = centre(merged[i])
        left = float(centre(merged[i - 1]) @ own) if i else -math.inf
        right = float(own @ centre(merged[i + 1])) if i + 1 < len(merged) else -math.inf
        a = i - 1 if left >= right else i
        merged[a : a + 2] = [(merged[a][0], merged[a + 1][1])]
        i = a
    return merged


def graph_chunks(text: str, spans: list[tuple[int, int]], embed: Embed, threshold: float, least: int) -> list[dict]:
    if not spans:
        return []
    v = np.asarray(embed([text[a:b] for a, b in spans]), float)
    out = []
    for a, b in graph_segments(v, threshold, least):
        begin, end = spans[a][0], spans[b - 1][1]
        out.append({"text": text[begin:end], "start_char": begin, "end_char": end, "start_sentence": a, "end_sentence": b})
    return out
