"""Subword segmentations sampled by Gumbel top-k without replacement.

The lattice of a text has a node at each character boundary and an edge for
each vocabulary piece that matches there; its paths are the segmentations. A
piece weighs (2 + rank) ** -alpha, its rank being its place in the vocabulary,
and a path's probability is the product of its weights over the sum for all
paths. The k distinct segmentations are the ones of largest Gumbel-perturbed
log-probability, found by perturbed A* search: the root stands for all paths
and its perturbed maximum; the path that attains it is drawn edge by edge from
exact backward sums; the rest falls apart into the sets of paths that leave it
first at a given node, and each set gets the maximum of its members' perturbed
log-probabilities as a Gumbel truncated at its parent's. The largest set on the
queue yields the next segmentation, and so on. No path is listed in vain: a
sample costs one walk through the text.

A piece never goes from a letter to a word mark, so the lattice is the product
of the words' lattices. Backward sums are worked out once per distinct word of
a block of texts, all in numpy, and kept for the task's next blocks: of a bounded
number of edges, those of the words that most blocks use. What is kept only
saves time; samples are the same without it.

Each sample comes with its log-probability, its perturbed value and its
inclusion score 1 - exp(-exp(log_prob - kappa)), kappa being the (k+1)th
perturbed value: the chance of being among the samples given that threshold,
by which sums over samples are weighted. All random numbers are hashes of the
row's key and the place in its text: results don't depend on batches or retries.

Cases: a null or empty text has no pieces and no samples; text in characters
that no piece has falls back to bytes; texts with fewer than k segmentations
give all of them, with inclusion 1; long texts and long words are sampled
whole; rows with equal keys and texts give equal samples, a null key counts as
an empty one. Ties: of equal perturbed values the set that was put on the queue
first yields its path first; a lone surrogate can't be in a Spark string, and a
text that held one would not count as a round trip. An empty table gives an empty result; extra columns are ignored.
The literal mark U+2581 decodes as a space, as it does in the tokenizer itself.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glanage.llm.common import chunks, mapped, process_cache

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_END = 0xFF  # stands behind each word; no UTF-8 text has it


@dataclass(frozen=True)
class SampleParams:
    k: int = 2
    #: Sharpness of the piece weights: at 0 all paths of equal length weigh alike.
    alpha: float = 1.0
    seed: int = 23
    #: Characters of text that are sampled together.
    block: int = 500_000


def words_of(text: str | None) -> list[str]:
    """The words of a text, each without the mark it begins with; further marks stay."""
    if not text:
        return []
    if text[0] != " " and text[-1] != " " and "  " not in text and MARK not in text:
        return text.split(" ")
    return [w[1:] for w in _WORDS.findall(MARK + text.replace(" ", MARK))]


class Vocabulary:
    """Pieces as a byte trie with a dense transition table."""

    def __init__(self, model: bytes, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        self.byte_ids = np.full(256, sp.unk_id(), np.int32)
        self.weight = np.zeros(n)
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        rank = 0
        self.pieces: list[bytes] = [b""] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.pieces[i] = bytes([int(piece[3:5], 16)])
                self.weight[i] = -alpha * np.log(2 + n)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.pieces[i] = piece.encode()
                self.weight[i] = -alpha * np.log(2 + rank)
                rank += 1
                node = 0
                for b in self.pieces[i]:
                    if b not in children[node]:
                        children[node][b] = len(children)
                        children.append({})
                    node = children[node][b]
                ends[node] = i
        inner = [i for i, c in enumerate(children) if c]
        outer = [i for i, c in enumerate(children) if not c]
        new = np.empty(len(children), np.int32)
        new[inner + outer] = np.arange(len(children))
        self.inner = len(inner)
        self.next = np.zeros((self.inner, 256), np.int32)
        for i in inner:
            for b, j in children[i].items():
                self.next[new[i], b] = new[j]
        self.piece = np.full(len(children), -1, np.int32)
        for node, i in ends.items():
            self.piece[new[node]] = i

        self.blob = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.size = np.array([len(x) for x in self.pieces], np.int64)
        self.place = np.cumsum(self.size) - self.size

    def spelled(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of the pieces ids[offsets[i]:offsets[i + 1]] for each i."""
        size = self.size[ids]
        stop = np.cumsum(size)
        flat = self.blob[np.repeat(self.place[ids] - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)].tobytes()
        ends = np.concatenate([[0], stop])[offsets].tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if ids else ""


def vocabulary(model: bytes, alpha: float) -> Vocabulary:
    cache, key = process_cache(), f"vocabulary/{alpha}/{hashlib.sha256(model).hexdigest()}"
    if key not in cache:
        cache[key] = Vocabulary(model, alpha)
    return cache[key]


class Lattice:
    """The edges of the words' lattices, by start; probabilities of an edge given its start."""

    def __init__(self, words: list[bytes], voc: Vocabulary):
        data = np.frombuffer(bytes([_END]).join(words) + bytes([_END]), np.uint8)
        sizes = np.array([len(w) for w in words], np.int64)
        self.end = np.cumsum(sizes + 1) - 1
        self.start = self.end - sizes
        letter = (data & 0xC0) != 0x80
        letter[self.end] = False
        at = np.flatnonzero(letter)
        node, here = voc.next[0, data[at]], at
        begins, stops, ids, depth = [], [], [], 1
        while True:
            piece = voc.piece[node]
            hit = (node > 0) & (piece >= 0)
            begins.append(here[hit])
            stops.append(here[hit] + depth)
            ids.append(piece[hit])
            go = (node > 0) & (node < voc.inner)
            here, node = here[go], node[go]
            if not len(here):
                break
            node = voc.next[node, data[here + depth]]
            go = node > 0
            here, node = here[go], node[go]
            depth += 1
        # Characters without a piece of their own are spelled in bytes.
        bounds = np.append(np.flatnonzero(letter | (data == _END)), len(data))
        follow = np.zeros(len(data) + 1, np.int64)
        follow[bounds[:-1]] = bounds[1:]
        own = np.zeros(len(data) + 1, bool)
        for b, s in zip(begins, stops, strict=True):
            own[b[s == follow[b]]] = True
        lone = at[~own[at]]
        if len(lone):
            size = follow[lone] - lone
            spelled = np.repeat(lone, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            begins.insert(0, spelled)
            stops.insert(0, spelled + 1)
            ids.insert(0, voc.byte_ids[data[spelled]])
        # Edges go to their start's place, the longest first: likely ones are found early then.
        # No list names a start twice, so each is placed at once.
        count = np.bincount(np.concatenate(begins), minlength=len(data) + 1)
        self.first = np.cumsum(count) - count
        fill, total = self.first.copy(), int(count.sum())
        self.begin, self.stop, self.piece = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total, np.int32)
        for b, s, piece in zip(reversed(begins), reversed(stops), reversed(ids), strict=True):
            to = fill[b]
            fill[b] += 1
            self.begin[to], self.stop[to], self.piece[to] = b, s, piece
        # Paths only meet at positions that no edge spans; sums start anew there.
        spans = np.bincount(self.begin + 1, minlength=len(data) + 2) - np.bincount(self.stop, minlength=len(data) + 2)
        cuts = np.where(np.cumsum(spans)[: len(data)] == 0, np.arange(len(data)), len(data))
        stop = np.minimum.accumulate(cuts[::-1])[::-1][self.begin + 1]
        left = stop - self.begin
        order = np.argsort(left.astype(np.uint16) if total and left.max() < 1 << 16 else left, kind="stable")
        b, s, left = self.begin[order], self.stop[order], left[order]
        beta = np.zeros(len(data) + 1)
        value = voc.weight[self.piece[order]]
        inside = s != stop[order]
        level = np.flatnonzero(np.r_[True, left[1:] != left[:-1]]) if total else np.zeros(0, np.int64)
        first = np.r_[True, b[1:] != b[:-1]] if total else np.zeros(0, bool)
        for lo, hi in zip(level, np.append(level[1:], total), strict=True):
            value[lo:hi] += np.where(inside[lo:hi], beta[s[lo:hi]], 0)
            v, f = value[lo:hi], np.flatnonzero(first[lo:hi])
            top = np.maximum.reduceat(v, f)
            sums = np.add.reduceat(np.exp(v - np.repeat(top, np.diff(np.append(f, hi - lo)))), f)
            beta[b[lo:hi][f]] = top + np.log(sums)
        self.share = np.empty(total)
        self.share[order] = np.exp(value - beta[b])
        starts = np.flatnonzero(count)
        head, sizes = self.first[starts], count[starts]
        within = np.cumsum(self.share)
        within -= np.repeat(within[head] - self.share[head], sizes)
        self.reach = np.round(within, 9)  # the sum runs over the batch: drop what depends on it
        self.reach[head + sizes - 1] = 1.0
        self.count = count


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... of size[i] numbers, for each i in turn."""
    stop = np.cumsum(size)
    return np.repeat(first - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)


#: Edges of words that are kept from block to block, at 48 bytes each.
KEPT = 2_000_000


class Lattices:
    """The lattices of a block's words and of words that were met before."""

    _WORD = {"start": np.int64, "end": np.int64, "seen": np.int64}
    _PLACE = {"first": np.int64, "count": np.int32}
    _EDGE = {"begin": np.int32, "stop": np.int32, "piece": np.int32, "share": float, "reach": float, "log_share": float, "log_other": float}

    def __init__(self, voc: Vocabulary, most: int = KEPT):
        self.voc, self.most = voc, most
        self.places = self.total = 0
        self._named([])
        for name, kind in (self._WORD | self._PLACE | self._EDGE).items():
            setattr(self, name, np.empty(most // 2, kind))  # memory is taken as it is filled

    def _named(self, words: list[str]) -> None:
        self.index: defaultdict[str, int] = defaultdict(None, zip(words, range(len(words))))  # words without their first mark, numbered as they come
        self.index.default_factory = self.index.__len__

    def _put(self, at: int, **columns: np.ndarray) -> None:
        for name, values in columns.items():
            own, need = getattr(self, name), at + len(values)
            if need > len(own):
                more = np.empty(max(need, 2 * len(own)), own.dtype)
                more[:at] = own[:at]
                setattr(self, name, more)
            getattr(self, name)[at:need] = values

    def number(self, texts: list[str | None]) -> list[np.ndarray]:
        """The numbers of each text's words, whose lattices are there then."""
        if self.total > self.most:
            self._forget()
        known = len(self.index)
        out = [np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)) for words in map(words_of, texts)]
        new = list(islice(self.index, known, None))
        if new:
            joined = "".join(new)
            lat = Lattice((MARK + f"\0{MARK}".join(new)).encode("utf-8", "replace").split(b"\0") if "\0" not in joined else [(MARK + w).encode("utf-8", "replace") for w in new], self.voc)
            log_other = np.log1p(-np.minimum(lat.share, 1.0), where=lat.share < 1 - 1e-12, out=np.full(len(lat.share), -np.inf))
            self._put(known, start=lat.start + self.places, end=lat.end + self.places, seen=np.zeros(len(new), np.int64))
            self._put(self.places, first=lat.first[:-1] + self.total, count=lat.count[:-1])
            self._put(self.total, begin=lat.begin + self.places, stop=lat.stop + self.places, piece=lat.piece)
            self._put(self.total, share=lat.share, reach=lat.reach, log_share=np.log(lat.share), log_other=log_other)
            self.places += len(lat.first) - 1
            self.total += len(lat.share)
        if out:
            self.seen[np.concatenate(out)] += 1  # once for a block, however often a word is in it
        return out

    def _forget(self) -> None:
        """Keeps the words that most blocks used, up to half of the edges."""
        n = len(self.index)
        start, end = self.start[:n], self.end[:n]
        size = self.first[end] - self.first[start]
        order = np.argsort(-self.seen[:n], kind="stable")
        kept = np.sort(order[np.cumsum(size[order]) <= self.most // 2])
        start, size, length = start[kept], size[kept], end[kept] - start[kept] + 1
        shift = np.cumsum(length) - length - start
        edges, places = _ranges(self.first[start], size), _ranges(start, length)
        shifts = np.repeat(shift, size)
        for name in self._EDGE:
            values = getattr(self, name)[edges]
            getattr(self, name)[: len(edges)] = values + shifts if name in ("begin", "stop") else values
        self.count[: len(places)] = count = self.count[places]
        self.first[: len(places)] = np.cumsum(count, dtype=np.int64) - count
        self._put(0, start=start + shift, end=end[kept] + shift, seen=self.seen[kept] // 2)
        self.places, self.total = len(places), len(edges)
        words = list(self.index)
        self._named([words[i] for i in kept.tolist()])

    def edges(self, node: int) -> list[int]:
        lo = int(self.first[node])
        return list(range(lo, lo + int(self.count[node])))

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge out of each node, by the edges' shares."""
        edge = self.first[node]
        more = np.flatnonzero(u >= self.reach[edge])
        while len(more):
            edge[more] += 1
            more = more[u[more] >= self.reach[edge[more]]]
        return edge


def uniform(seed: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1): a hash of seed and counter."""
    with np.errstate(over="ignore"):
        x = seed + (counter.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


#: Streams of random numbers: the round and its use in the upper bits of the counter.
_ROUND, _USE, _STEP = 1 << 56, 1 << 55, 1 << 22


def _walk(lat: Lattices, at: np.ndarray, end: np.ndarray, seed: np.ndarray, counter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Draws paths from ``at`` to ``end``: how many edges each has, and the edges one path after the other."""
    live, steps = np.flatnonzero(at < end), []
    at = at.copy()
    count = np.zeros(len(at), np.int64)
    step = 0
    while len(live):
        e = lat.draw(at[live], uniform(seed[live], counter[live] + step))
        steps.append((live, e))
        count[live] += 1
        at[live] = lat.stop[e]
        live = live[at[live] < end[live]]
        step += 1
    offset = np.cumsum(count) - count
    out = np.empty(count.sum(), np.int64)
    for step, (who, e) in enumerate(steps):
        out[offset[who] + step] = e
    return count, out


@dataclass
class _Path:
    edges: np.ndarray
    word: np.ndarray  # of each edge, counted in its text
    prefix: np.ndarray  # log-probability before each edge
    fork: int  # the first edge that this path doesn't share with its parent
    banned: list[int]  # edges that its set excludes there
    gumbel: float
    log_prob: float


def sample(
    texts: list[str | None], keys: list[object], voc: Vocabulary, params: SampleParams, lat: Lattices | None = None
) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its samples, best perturbed value first: ids, log_prob, gumbel, inclusion.

    ``lat`` holds lattices of earlier calls with this vocabulary.
    """
    lat = lat or Lattices(voc)
    number = lat.number(texts)
    results: list[list[tuple[np.ndarray, float, float, float]]] = [[] for _ in texts]
    docs = [i for i, x in enumerate(number) if len(x)]
    if not docs:
        return results
    seeds = {i: np.uint64(xxhash.xxh3_64_intdigest(str("" if keys[i] is None else keys[i]).encode(), params.seed)) for i in docs}
    # Parts of the coming walk: text, first word, node to go on from, edges before it, and so on.
    todo = [(i, 0, int(lat.start[number[i][0]]), np.zeros(0, np.int64), np.zeros(0, np.int64), 0.0, []) for i in docs]
    root = uniform(np.array([seeds[i] for i in docs], np.uint64), np.full(len(docs), 7, np.int64))
    gumbels = dict(zip(docs, -np.log(-np.log(root)), strict=True))
    queue: dict[int, list[tuple[float, int, int]]] = {i: [] for i in docs}
    paths: dict[int, list[_Path]] = {i: [] for i in docs}
    for turn in range(params.k):
        if not todo:
            break
        at = np.concatenate([np.concatenate([[node], lat.start[number[i][w + 1 :]]]) for i, w, node, *_ in todo])
        end = np.concatenate([lat.end[number[i][w:]] for i, w, *_ in todo])
        sizes = np.array([len(number[i]) - w for i, w, *_ in todo])
        word = np.concatenate([np.arange(w, len(number[i])) for i, w, *_ in todo])
        seed = np.repeat(np.array([seeds[i] for i, *_ in todo], np.uint64), sizes)
        count, edges = _walk(lat, at, end, seed, word * _STEP + turn * _ROUND)
        words = np.repeat(word, count)
        per_doc = np.add.reduceat(count, np.cumsum(sizes) - sizes)
        stops = np.cumsum(per_doc)
        news = []
        for (i, w, _, before, words_before, log_before, banned), stop, n in zip(todo, stops, per_doc, strict=True):
            own = np.concatenate([before, edges[stop - n : stop]])
            steps = np.cumsum(lat.log_share[own])
            fork = max(0, len(before) - 1)
            # At the fork the chosen edge is ``before``'s last one; what its set excludes is banned.
            prefix = np.concatenate([[0.0], steps[:-1]])
            path = _Path(own, np.concatenate([words_before, words[stop - n : stop]]), prefix, fork if banned else 0, banned, gumbels[i], float(steps[-1]))
            paths[i].append(path)
            phi = prefix[path.fork :] + lat.log_other[own[path.fork :]]
            if banned:
                left = 1.0 - lat.share[banned].sum() - lat.share[own[fork]]
                rest = [e for e in lat.edges(int(lat.begin[own[fork]])) if e not in banned and e != own[fork]]
                phi[0] = prefix[fork] + (np.log(max(left, lat.share[rest].sum())) if rest else -np.inf)
            news.append((i, path, phi))
        # All new sets of this turn get their truncated maxima together.
        phi = np.concatenate([x[2] for x in news])
        bound = np.concatenate([np.full(len(x[2]), x[1].gumbel) for x in news])
        places = np.concatenate([np.arange(x[1].fork, x[1].fork + len(x[2])) for x in news])
        seed = np.concatenate([np.full(len(x[2]), seeds[x[0]], np.uint64) for x in news])
        with np.errstate(divide="ignore", over="ignore"):
            value = phi - np.log(np.exp(phi - bound) - np.log(uniform(seed, places + turn * _ROUND + _USE)))
        value[~np.isfinite(phi)] = -np.inf
        todo, lo = [], 0
        for i, path, own in news:
            v = value[lo : lo + len(own)]
            lo += len(own)
            most = min(len(v), params.k + 1 - turn)
            best = np.argpartition(-v, most - 1)[:most] if most < len(v) else np.arange(len(v))
            queue[i] += [(float(v[j]), turn, int(path.fork + j)) for j in best if v[j] > -np.inf]
            queue[i].sort(reverse=True)
            if turn + 1 == params.k or not queue[i]:
                continue
            gumbel, of, place = queue[i].pop(0)
            parent = paths[i][of]
            banned = [int(parent.edges[place])] + (parent.banned if place == parent.fork else [])
            open_ = [e for e in lat.edges(int(lat.begin[parent.edges[place]])) if e not in banned]
            share = np.cumsum(lat.share[open_])
            u = uniform(np.array([seeds[i]], np.uint64), np.array([place + (turn + 1) * _ROUND + _USE // 2]))[0]
            chosen = open_[min(int(np.searchsorted(share, u * share[-1], side="right")), len(open_) - 1)]
            gumbels[i] = gumbel
            w = int(parent.word[place])
            todo.append((i, w, int(lat.stop[chosen]), np.append(parent.edges[:place], chosen), np.append(parent.word[:place], w), 0.0, banned))
    for i in docs:
        kappa = queue[i][0][0] if queue[i] else -np.inf
        for p in paths[i]:
            inclusion = 1.0 if kappa == -np.inf else float(-np.expm1(-np.exp(min(p.log_prob - kappa, 700.0))))
            results[i].append((lat.piece[p.edges], p.log_prob, p.gumbel, inclusion))
    return results


SCHEMA = "doc_id long, rank int, log_prob double, gumbel double, inclusion double, n_pieces int, ids array<int>, round_trip boolean"


def segmentations(docs: DataFrame, model_path: str = MODEL, params: SampleParams = SampleParams()) -> DataFrame:
    """Up to k rows for each row of ``docs`` (doc_id is the key): ids, and whether they decode to the text."""
    with open(model_path, "rb") as f:  # read by the driver and sent along: half a megabyte
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(model, params.alpha)
        lat = Lattices(voc)
        for b in batches:
            keys, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for part in chunks([len(t or "") for t in texts], params.block):
                own = sample(texts[part], keys[part], voc, params, lat)
                rows = [(key, rank, *s, text) for key, text, found in zip(keys[part], texts[part], own, strict=True) for rank, s in enumerate(found)]
                if not rows:
                    continue
                ids = [r[2] for r in rows]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32)
                back = [x == (MARK + r[6]).replace(" ", MARK).encode("utf-8", "surrogatepass") for x, r in zip(voc.spelled(flat, offsets), rows, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[1] for r in rows], pa.int32()),
                        *(pa.array([r[j] for r in rows], pa.float64()) for j in (3, 4, 5)),
                        pa.array(np.diff(offsets), pa.int32()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                        pa.array(back, pa.bool_()),
                    ],
                    names=["doc_id", "rank", "log_prob", "gumbel", "inclusion", "n_pieces", "ids", "round_trip"],
                )

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA, arrow=True)


def op8_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage_segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled segmentations of every document."""
    return segmentations(docs)
