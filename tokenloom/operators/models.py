"""Models: a word to tokens ``(id, token, start, end)``, places in code points of the word.

Each model object is small, read-only and sent to the workers once; the words
that a worker has met are kept in a bounded cache. Word lookups that are plain
joins (WordLevel, vocabulary access) are in :mod:`tokenloom.operators.lookup`.
"""

from __future__ import annotations

import heapq
import math
import random
from itertools import chain
from typing import Any, NamedTuple

import numpy as np

from tokenloom.sources.registry import component


class Token(NamedTuple):
    id: int
    value: str
    start: int
    end: int


class Many(NamedTuple):
    """Tokens of many words: each word's number of them, and their fields one after the other; values by their places in ``names``."""

    sizes: np.ndarray
    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    values: np.ndarray
    names: list[str]


def vocab_pairs(data: Any) -> dict[str, int]:
    """A vocabulary whose ids may be numbers or numeric strings."""
    return {str(k): int(v) for k, v in dict(data).items()}


class Model:
    """``tokens`` of a word; ``cacheable`` is false where chance decides."""

    cacheable = True
    #: Whether every word is one token, which is as long as the word.
    whole = False
    seed = None

    def begin(self, text: str) -> None:
        """Called with each text before its words: with a seed, chance hangs on it and the text alone, not on other rows."""
        if not self.cacheable and self.seed is not None:
            self.chance.seed(f"{self.seed}:{text}")

    def tokens(self, word: str) -> list[Token]:
        raise NotImplementedError

    def tokens_many(self, words: list[str]) -> Many:
        found = [self.tokens(w) for w in words]
        flat = list(chain.from_iterable(found))
        names = {v: k for k, v in enumerate(dict.fromkeys(t.value for t in flat))}
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return Many(sizes, *(np.fromiter((t[k] for t in flat), np.int64, len(flat)) for k in (0, 2, 3)), np.fromiter((names[t.value] for t in flat), np.int64, len(flat)), list(names))

    def vocabulary(self) -> dict[str, int]:
        return self.vocab

    def id_of(self, token: str) -> int | None:
        return self.vocabulary().get(token)

    def token_of(self, id_: int) -> str | None:
        if not hasattr(self, "_reverse"):
            self._reverse = {i: t for t, i in self.vocabulary().items()}
        return self._reverse.get(id_)

    def size(self) -> int:
        return len(self.vocabulary())


def byte_token(b: int) -> str:
    return f"<0x{b:02X}>"


@component("model", "WordLevel", vocab=None, unk_token="<unk>")
class WordLevel(Model):
    needed = ("vocab",)

    def prepare(self) -> None:
        self.vocab = vocab_pairs(self.vocab)
        self.whole = self.unk_token in self.vocab and type(self).tokens is WordLevel.tokens

    def tokens(self, word: str) -> list[Token]:
        found = self.vocab.get(word)
        if found is not None:
            return [Token(found, word, 0, len(word))]
        unk = self.vocab.get(self.unk_token)
        return [] if unk is None else [Token(unk, self.unk_token, 0, len(word))]

    def tokens_many(self, words: list[str]) -> Many:
        unk = self.vocab.get(self.unk_token)
        found = [self.vocab.get(w, unk) for w in words]
        kept = words if unk is not None else [w for w, i in zip(words, found) if i is not None]
        known = [w for w in kept if w in self.vocab]
        isin = np.fromiter((w in self.vocab for w in kept), bool, len(kept))
        ids = np.fromiter((i for i in found if i is not None), np.int64, len(kept))
        lengths = np.fromiter(map(len, kept), np.int64, len(kept))
        return Many(np.fromiter((i is not None for i in found), np.int64, len(words)), ids, np.zeros_like(ids), lengths, np.where(isin, np.cumsum(isin), 0), [self.unk_token, *known])


@component("model", "WordPiece", vocab=None, unk_token="[UNK]", continuing_subword_prefix="##", max_input_chars_per_word=100)
class WordPiece(Model):
    """Longest match first; a word that can't be covered is one unknown token."""

    needed = ("vocab",)

    def prepare(self) -> None:
        self.vocab = vocab_pairs(self.vocab)
        self.longest = max(map(len, self.vocab), default=0)

    @classmethod
    def from_bpe(cls, bpe: BPE, unk_token: str = "[UNK]") -> WordPiece:
        vocab = dict(bpe.vocab)
        vocab.setdefault(unk_token, max(vocab.values(), default=-1) + 1)
        return cls(vocab=vocab, unk_token=unk_token, continuing_subword_prefix=bpe.continuing_subword_prefix or "##")

    def unknown(self, word: str) -> list[Token]:
        unk = self.vocab.get(self.unk_token)
        return [] if unk is None else [Token(unk, self.unk_token, 0, len(word))]

    def tokens(self, word: str) -> list[Token]:
        if len(word) > self.max_input_chars_per_word:
            return self.unknown(word)
        out, start = [], 0
        while start < len(word):
            prefix = self.continuing_subword_prefix if start else ""
            for end in range(min(len(word), start + self.longest), start, -1):
                value = prefix + word[start:end]
                found = self.vocab.get(value)
                if found is not None:
                    out.append(Token(found, value, start, end))
                    start = end
                    break
            else:
                return self.unknown(word)
        return out


#: Symbols of a word beyond which it is merged alone.
LONG_WORD = 128


@component(
    "model", "BPE", vocab=None, merges=(), unk_token=None, continuing_subword_prefix=None, end_of_word_suffix=None, fuse_unk=False, byte_fallback=False, ignore_merges=False, dropout=None, cache_capacity=10_000, merge_on_miss=False, seed=None
)
class BPE(Model):
    """Merges by least rank, then place. ``ignore_merges`` takes whole words from the vocabulary and merges nothing else unless ``merge_on_miss`` is set."""

    needed = ("vocab",)

    def prepare(self) -> None:
        self.vocab = vocab_pairs(self.vocab)
        self.merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in self.merges or ()]
        cut = len(self.continuing_subword_prefix or "")
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(self.merges):
            made = self.vocab.get(a + b[cut:])
            if a in self.vocab and b in self.vocab and made is not None:
                self.ranks.setdefault((self.vocab[a], self.vocab[b]), (rank, made))
        self.cacheable = not self.dropout
        self.chance = random.Random(self.seed)

    def symbols(self, word: str) -> list[tuple[int, int, int]]:
        """``(id, start, end)`` of each code point, unknown ones replaced, spelled as bytes, or dropped."""
        out: list[tuple[int, int, int]] = []
        unk = self.vocab.get(self.unk_token) if self.unk_token is not None else None
        pending = False
        for i, c in enumerate(word):
            key = c
            if i and self.continuing_subword_prefix:
                key = self.continuing_subword_prefix + key
            if i == len(word) - 1 and self.end_of_word_suffix:
                key += self.end_of_word_suffix
            found = self.vocab.get(key)
            if found is not None:
                out.append((found, i, i + 1))
                pending = False
                continue
            if self.byte_fallback:
                spelled = [self.vocab.get(byte_token(b)) for b in c.encode("utf-8", "replace")]
                if None not in spelled:
                    out += [(s, i, i + 1) for s in spelled if s is not None]
                    pending = False
                    continue
            if unk is None:
                continue
            if pending and self.fuse_unk:
                out[-1] = (unk, out[-1][1], i + 1)
            else:
                out.append((unk, i, i + 1))
            pending = True
        return out

    def tokens(self, word: str) -> list[Token]:
        if self.ignore_merges:
            whole = self.vocab.get(word)
            if whole is not None:
                return [Token(whole, word, 0, len(word))]
        parts = self.symbols(word)
        if not self.ignore_merges or self.merge_on_miss:
            parts = self.merged(parts)
        return [Token(i, self.token_of(i) or "", s, e) for i, s, e in parts]

    def tokens_many(self, words: list[str]) -> Many:
        bound = max(self.vocab.values(), default=0) + 1
        if not words or self.dropout or self.continuing_subword_prefix or min(self.vocab.values(), default=0) < 0 or bound > 1 << 31:
            return super().tokens_many(words)
        parts = self.symbols_many(words)
        if self.ranks and (not self.ignore_merges or self.merge_on_miss):
            parts = self.merged_many(*parts, bound)
        word, ids, begins, ends = parts
        different, values = np.unique(ids, return_inverse=True)
        return Many(np.bincount(word, minlength=len(words)), ids, begins, ends, values, [self.token_of(i) or "" for i in different.tolist()])

    def symbols_many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word, id, start and end of the symbols of many words: code points are spelled once for all their places."""
        whole = [self.vocab.get(w) for w in words] if self.ignore_merges else [None] * len(words)
        if self.end_of_word_suffix or self.fuse_unk or self.ignore_merges:
            found = [self.symbols(w) if x is None else [(x, 0, len(w))] for w, x in zip(words, whole)]
            made = np.fromiter(chain.from_iterable(chain.from_iterable(found)), np.int64).reshape(-1, 3)
            return np.repeat(np.arange(len(words)), [len(x) for x in found]), *(np.ascontiguousarray(made[:, k]) for k in range(3))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        seen = np.zeros(int(codes.max(initial=0)) + 1, np.int64)
        seen[codes] = 1
        spelled = [[i for i, _, _ in self.symbols(chr(c))] for c in np.flatnonzero(seen)]
        seen = np.cumsum(seen) - 1
        kind = seen[codes]
        sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
        pool, first = np.fromiter(chain.from_iterable(spelled), np.int64), np.cumsum(sizes) - sizes
        each = sizes[kind]
        place = np.repeat(first[kind] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        begin = np.repeat(np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths), each)
        return np.repeat(np.repeat(np.arange(len(words)), lengths), each), pool[place], begin, begin + 1

    def merged_many(self, word: np.ndarray, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Merged symbols of many words, which are in order; each pass makes the next merge of every word that has one."""
        ordered = sorted((rank, a * bound + b, made) for (a, b), (rank, made) in self.ranks.items())
        keys, products, none = np.array([k for _, k, _ in ordered], np.int64), np.array([m for _, _, m in ordered], np.int64), len(ordered)
        order = np.argsort(keys)
        keys = keys[order]

        def rank_pairs(at: np.ndarray) -> None:
            at = at[(at >= 0) & (at < len(ids) - 1)]
            at = at[word[at] == word[at + 1]]
            pair = ids[at] * bound + ids[at + 1]
            k = np.minimum(np.searchsorted(keys, pair), none - 1)
            rank[at] = np.where(keys[k] == pair, order[k], none)

        done = []
        long = np.bincount(word, minlength=1)[word] > LONG_WORD
        if long.any():
            at = np.flatnonzero(long)
            for part in np.split(at, np.flatnonzero(np.diff(word[at])) + 1):
                made = np.array(self.merged(list(zip(ids[part].tolist(), begins[part].tolist(), ends[part].tolist()))), np.int64)
                done.append((np.full(len(made), word[part[0]]), made[:, 0], made[:, 1], made[:, 2]))
            word, ids, begins, ends = (x[~long] for x in (word, ids, begins, ends))
        rank = np.full(len(ids), none)
        rank_pairs(np.arange(len(ids)))
        while len(ids):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least, size = np.minimum.reduceat(rank, first), np.diff(np.append(first, len(ids)))
            more = least < none
            live = np.repeat(more, size)
            if not live.all():
                done.append(tuple(x[~live] for x in (word, ids, begins, ends)))
                word, ids, begins, ends, rank = (x[live] for x in (word, ids, begins, ends, rank))
                least, size = least[more], size[more]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            hit = hit[np.append(True, word[hit[1:]] != word[hit[:-1]])]
            ids[hit], ends[hit], rank[hit] = products[rank[hit]], ends[hit + 1], none
            stay = np.ones(len(ids), bool)
            stay[hit + 1] = False
            word, ids, begins, ends, rank = (x[stay] for x in (word, ids, begins, ends, rank))
            hit -= np.arange(len(hit))
            rank_pairs(hit)
            rank_pairs(hit - 1)
        if not done:
            return word, ids, begins, ends
        word, ids, begins, ends = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return word[order], ids[order], begins[order], ends[order]

    def merged(self, parts: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        n = len(parts)
        ids: list[int | None] = [p[0] for p in parts]
        ends = [p[2] for p in parts]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            if j < n:
                found = self.ranks.get((ids[i], ids[j]))  # type: ignore[arg-type]
                if found is not None:
                    heapq.heappush(heap, (found[0], i, found[1]))

        for i in range(n - 1):
            push(i)
        skipped: list[tuple[int, int, int]] = []
        while heap:
            top = heapq.heappop(heap)
            if self.dropout and self.chance.random() < self.dropout:
                skipped.append(top)
                continue
            for s in skipped:
                heapq.heappush(heap, s)
            skipped.clear()
            _, i, made = top
            j = after[i]
            if ids[i] is None or j >= n or self.ranks.get((ids[i], ids[j]), (0, None))[1] != made:  # type: ignore[arg-type]
                continue
            ids[i], ends[i] = made, ends[j]
            ids[j] = None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return [(x, parts[i][1], ends[i]) for i, x in enumerate(ids) if x is not None]


class Lattice:
    """Segmentations of a sentence: nodes ``(start, end, score, id)``, best paths, samples, marginals."""

    def __init__(self, text: str):
        self.text, self.n = text, len(text)
        self.nodes: list[tuple[int, int, float, int]] = []
        self.starts: list[list[int]] = [[] for _ in range(self.n + 1)]
        self.ends: list[list[int]] = [[] for _ in range(self.n + 1)]

    def insert(self, start: int, length: int, score: float, id_: int) -> None:
        k = len(self.nodes)
        self.nodes.append((start, start + length, score, id_))
        self.starts[start].append(k)
        self.ends[start + length].append(k)

    def forward_best(self) -> tuple[list[float], list[int]]:
        best, back = [-math.inf] * (self.n + 1), [-1] * (self.n + 1)
        best[0] = 0.0
        for at in range(self.n):
            if best[at] == -math.inf:
                continue
            for k in self.starts[at]:
                _, end, score, _ = self.nodes[k]
                if best[at] + score > best[end]:
                    best[end], back[end] = best[at] + score, k
        return best, back

    def viterbi(self) -> list[int]:
        """Nodes of the best path; none if no path covers the sentence."""
        best, back = self.forward_best()
        if self.n and best[self.n] == -math.inf:
            return []
        path, at = [], self.n
        while at:
            path.append(back[at])
            at = self.nodes[back[at]][0]
        return path[::-1]

    def nbest(self, count: int) -> list[tuple[list[int], float]]:
        """The best paths in order, by A* from the end with exact rest scores."""
        best, _ = self.forward_best()
        if best[self.n] == -math.inf:
            return []
        out: list[tuple[list[int], float]] = []
        heap: list[tuple[float, int, int, float, tuple[int, ...]]] = [(-best[self.n], 0, self.n, 0.0, ())]
        order = 0
        while heap and len(out) < count:
            _, _, at, score, path = heapq.heappop(heap)
            if at == 0:
                out.append((list(path), score))
                continue
            for k in self.ends[at]:
                start, _, s, _ = self.nodes[k]
                if best[start] > -math.inf:
                    order += 1
                    heapq.heappush(heap, (-(score + s + best[start]), order, start, score + s, (k, *path)))
        return out

    def alphas(self, theta: float = 1.0) -> list[float]:
        out = [-math.inf] * (self.n + 1)
        out[0] = 0.0
        for at in range(self.n):
            for k in self.starts[at]:
                _, end, score, _ = self.nodes[k]
                out[end] = log_add(out[end], theta * score + out[at])
        return out

    def sample(self, theta: float, chance: random.Random) -> list[int]:
        """A path with probability in proportion to ``exp(theta * score)``."""
        alpha = self.alphas(theta)
        if self.n and alpha[self.n] == -math.inf:
            return []
        path, at = [], self.n
        while at:
            r, pick = chance.random(), None
            for k in self.ends[at]:
                start, _, score, _ = self.nodes[k]
                if alpha[start] == -math.inf:
                    continue
                pick = k
                r -= math.exp(alpha[start] + theta * score - alpha[at])
                if r <= 0:
                    break
            path.append(pick)
            at = self.nodes[pick][0]
        return path[::-1]

    def marginals(self) -> tuple[list[float], float]:
        """Probability of each node, and the log of the sum over all paths."""
        alpha = self.alphas()
        beta = [-math.inf] * (self.n + 1)
        beta[self.n] = 0.0
        for at in range(self.n, 0, -1):
            for k in self.ends[at]:
                start, _, score, _ = self.nodes[k]
                beta[start] = log_add(beta[start], score + beta[at])
        z = alpha[self.n]
        return [math.exp(alpha[s] + x + beta[e] - z) if alpha[s] > -math.inf and beta[e] > -math.inf else 0.0 for s, e, x, _ in self.nodes], z

    def pieces(self, path: list[int]) -> list[str]:
        return [self.text[self.nodes[k][0] : self.nodes[k][1]] for k in path]


def log_add(a: float, b: float) -> float:
    if a == -math.inf:
        return b
    if b == -math.inf:
        return a
    hi, lo = max(a, b), min(a, b)
    return hi if hi - lo > 50 else hi + math.log1p(math.exp(lo - hi))


@component("model", "Unigram", vocab=None, unk_id=None, byte_fallback=False, fuse_unk=True, alpha=0.0, nbest=0, seed=None)
class Unigram(Model):
    """Best segmentation by scores; unknown code points cost ten below the least score."""

    needed = ("vocab",)

    def prepare(self) -> None:
        self.scores = [(str(t), float(s)) for t, s in self.vocab]
        self.vocab = [[t, s] for t, s in self.scores]
        self.index: dict[str, int] = {}
        for i, (t, _) in enumerate(self.scores):
            self.index.setdefault(t, i)
        self.score_of = [s for _, s in self.scores]
        self._trie: dict | None = None
        self.unk_score = min((s for _, s in self.scores), default=-10.0) - 10.0
        self.cacheable = not (self.alpha > 0 and self.nbest > 0)
        self.chance = random.Random(self.seed)

    def vocabulary(self) -> dict[str, int]:
        return self.index

    def token_of(self, id_: int) -> str | None:
        return self.scores[id_][0] if 0 <= id_ < len(self.scores) else None

    def size(self) -> int:
        return len(self.scores)

    @property
    def trie(self) -> dict:
        """The pieces by their characters; the id of the piece that ends at a node is under the empty string."""
        if self._trie is None:
            self._trie = {}
            for piece, i in self.index.items():
                node = self._trie
                for c in piece:
                    node = node.setdefault(c, {})
                if piece:
                    node[""] = i
        return self._trie

    def prefixes(self, text: str, at: int) -> list[tuple[int, int]]:
        """``(end, id)`` of the pieces that begin at a place, short ones first."""
        out, node = [], self.trie
        for e in range(at, len(text)):
            node = node.get(text[e])
            if node is None:
                break
            if "" in node:
                out.append((e + 1, node[""]))
        return out

    def best(self, text: str) -> list[tuple[int, int, int]]:
        """``(start, end, id)`` along the best path, -1 for unknown code points: the lattice's Viterbi path, without a lattice."""
        n, trie, scores = len(text), self.trie, self.score_of
        score, back, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        score[0] = 0.0
        for at in range(n):
            here, node, single = score[at], trie, False
            for e in range(at, n):
                node = node.get(text[e])
                if node is None:
                    break
                i = node.get("")
                if i is not None:
                    single |= e == at
                    made = here + scores[i]
                    if made > score[e + 1]:
                        score[e + 1], back[e + 1], piece[e + 1] = made, at, i
            if not single and here + self.unk_score > score[at + 1]:
                score[at + 1], back[at + 1], piece[at + 1] = here + self.unk_score, at, -1
        out, at = [], n
        while at:
            out.append((back[at], at, piece[at]))
            at = back[at]
        return out[::-1]

    def lattice(self, text: str) -> Lattice:
        out = Lattice(text)
        for at in range(len(text)):
            single = False
            for end, i in self.prefixes(text, at):
                out.insert(at, end - at, self.scores[i][1], i)
                single |= end == at + 1
            if not single:
                out.insert(at, 1, self.unk_score, -1)
        return out

    def tokens(self, word: str) -> list[Token]:
        if self.cacheable:
            return self.finished(word, self.best(word))
        lattice = self.lattice(word)
        return self.finished(word, [(lattice.nodes[k][0], lattice.nodes[k][1], lattice.nodes[k][3]) for k in lattice.sample(self.alpha, self.chance)])

    def finished(self, word: str, parts: list[tuple[int, int, int]]) -> list[Token]:
        """Fuse unknown neighbours, spell them as bytes where asked and possible, and give ids."""
        if self.fuse_unk:
            fused: list[tuple[int, int, int]] = []
            for s, e, i in parts:
                if i < 0 and fused and fused[-1][2] < 0:
                    fused[-1] = (fused[-1][0], e, -1)
                else:
                    fused.append((s, e, i))
            parts = fused
        out = []
        for s, e, i in parts:
            if i >= 0:
                out.append(Token(i, self.scores[i][0], s, e))
                continue
            if self.byte_fallback:
                spelled = [(c, byte_token(b)) for c in range(s, e) for b in word[c].encode("utf-8", "replace")]
                if all(t in self.index for _, t in spelled):
                    out += [Token(self.index[t], t, c, c + 1) for c, t in spelled]
                    continue
            out.append(Token(self.unk_id or 0, word[s:e], s, e))
        return out

    def nbest_pieces(self, text: str, count: int) -> list[tuple[list[str], float]]:
        lattice = self.lattice(text)
        return [(lattice.pieces(path), score) for path, score in lattice.nbest(count)]

    def to_json(self) -> dict[str, Any]:
        return {"type": "Unigram", "unk_id": self.unk_id, "vocab": self.vocab, "byte_fallback": self.byte_fallback, "fuse_unk": self.fuse_unk, "alpha": self.alpha, "nbest": self.nbest, "seed": self.seed}


def detect_model(data: dict[str, Any]) -> str:
    """The model type of a definition that doesn't name one."""
    if data.get("type"):
        return data["type"]
    if isinstance(data.get("vocab"), list):
        return "Unigram"
    if "merges" in data:
        return "BPE"
    return "WordPiece" if "continuing_subword_prefix" in data or "max_input_chars_per_word" in data else "WordLevel"
