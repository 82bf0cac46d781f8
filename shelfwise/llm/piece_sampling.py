"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text's lattice holds every way to cut it into pieces of the vocabulary; pieces weigh as
their rank does under Zipf's law, evened out by a power. Backward sums turn it into a chain of choices whose
products are the segmentations' probabilities. Pieces never cross the start of a word, so
the lattice is a chain of word lattices, and each task keeps those of the words it met.

Perturbed A-star search, top down: the root draws the largest Gumbel value of all
segmentations; a node hands its value to one child, drawn by probability, and the other
children together get the largest of theirs, a Gumbel value cut off at the node's own.
Following the first child to the end is the best segmentation; the open node of largest
value anywhere is where the next one branches off. So k distinct segmentations come out
in order, a sample without replacement, and the largest value still open is the
threshold that inclusion scores (logs of probabilities) refer to.

Random numbers are hashes of (row key, sample, word, step): a row's sample does not depend
on partitions, batches or retries.

Defined cases: a null or empty text has one segmentation, the empty one; texts with fewer
than k segmentations give all of them; a null key is a key of its own; repeated rows get
equal samples; characters outside the vocabulary fall back to bytes; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import bound_batches

#: Segmentations of a text, and the power that piece weights are raised to (less: more even).
SAMPLES, ALPHA = 8, 0.4
#: Edges of word lattices a task keeps before it starts anew, and words walked side by side.
KEPT_EDGES, TOGETHER = 6_000_000, 40_000
SEED = 17
#: Choices of a chain whose open values are found at first; and more than a Gumbel value of a 53-bit number can be.
EARLY, LARGEST = 200, 36.8
STEP = 0xD1342543DE82EF95
UNUSED = -1e8

SCHEMA = "doc_id long, sample int, n_pieces long, log_prob double, gumbel double, log_inclusion double, ids array<int>, ids_crc32 long, round_trip boolean"


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattices:
    """Word lattices as flat arrays: nodes with their edges, likeliest first."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        scores = [self.model.get_score(i) for i in range(n)]
        usable = [i for i in range(n) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)) and scores[i] > UNUSED]
        total = sum(1 / (1 - scores[i]) for i in usable)
        self.byte = {int(self.model.id_to_piece(i)[3:5], 16): i for i in range(n) if self.model.is_byte(i)}
        self.rare = 1 / (2 - min(scores[i] for i in usable)) / total
        weights = {self.model.id_to_piece(i): (i, (1 / (1 - scores[i]) / total) ** ALPHA) for i in usable}
        self.rare = self.rare**ALPHA
        # single characters that merges never score, the word mark among them
        for i in range(n):
            piece = self.model.id_to_piece(i)
            if len(piece) == 1 and scores[i] <= UNUSED:
                weights[piece] = (i, self.rare)
        self._trie(weights)
        self._reset()

    def _trie(self, weights: dict[str, tuple[int, float]]) -> None:
        """The pieces' prefixes as states; (state, character) pairs lie in an open hash table."""
        import numpy as np

        states = {"": 0}
        for piece in weights:
            for j in range(1, len(piece) + 1):
                states.setdefault(piece[:j], len(states))
        self.state_id = np.full(len(states), -1, np.int64)
        self.state_weight = np.full(len(states), -np.inf)
        keys = np.zeros(len(states) - 1, np.int64)
        values = np.zeros(len(states) - 1, np.int64)
        for at, (prefix, state) in enumerate(list(states.items())[1:]):
            keys[at], values[at] = states[prefix[:-1]] << 21 | ord(prefix[-1]), state
            if prefix in weights:
                self.state_id[state], self.state_weight[state] = weights[prefix][0], math.log(weights[prefix][1])
        self.longest = max(map(len, weights))
        self._spelling()
        bits = 2 + (len(keys) - 1).bit_length()
        self.shift = np.uint64(64 - bits)
        self.slot_key, self.slot_state = np.full((1 << bits) + 64, -1, np.int64), np.zeros((1 << bits) + 64, np.int64)
        for key, value, slot in zip(keys.tolist(), values.tolist(), self._slots(keys).tolist()):
            while self.slot_key[slot] >= 0:
                slot += 1
            self.slot_key[slot], self.slot_state[slot] = key, value

    def _spelling(self) -> None:
        """Each piece's bytes, the word mark as a space, in columns of eight, and masks of as many bytes."""
        import numpy as np

        n, of_byte = self.model.vocab_size(), {i: bytes([b]) for b, i in self.byte.items()}
        spelt = [of_byte.get(i) or self.model.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.size = np.array([len(x) for x in spelt], np.int64)
        self.mask = np.array([(1 << 8 * min(j, 8)) - 1 for j in range(int(self.size.max()) + 1)], np.uint64)
        columns = -(-int(self.size.max()) // 8)
        self.bytes_of = np.frombuffer(b"".join(x.ljust(8 * columns, b"\0") for x in spelt), "<u8").reshape(n, columns).T.copy()

    def spells(self, ids, bounds, norms: list[bytes]):
        """Whether ids[bounds[i]:bounds[i + 1]] spell norms[i], the normalised text with spaces for word marks; equal ``norms`` may follow each other."""
        import numpy as np

        places, raw, size = [], [], 0
        for i, norm in enumerate(norms):
            if i and norm is norms[i - 1]:
                places.append(places[-1])
                continue
            places.append(size)
            raw.append(norm)
            size += len(norm)
        columns = len(self.bytes_of)
        buffer = np.frombuffer(b"".join([*raw, bytes(8 * columns)]), np.uint8)
        # eight bytes from each byte on
        windows = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,)).copy()
        ids = ids.astype(np.int64)
        counts, sizes = np.diff(bounds), self.size.take(ids)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        whole = upto[bounds[1:]] - upto[bounds[:-1]] == [len(x) for x in norms]
        at = upto[:-1]
        at += np.repeat(np.array(places, np.int64) - upto[bounds[:-1]], counts)
        np.minimum(at, size, out=at)
        wrong = windows.take(at)
        wrong ^= self.bytes_of[0].take(ids)
        wrong &= self.mask.take(sizes)
        wrong = wrong != 0
        more = np.flatnonzero(sizes > 8)
        for column in range(1, columns):
            wrong[more] |= ((windows[at[more] + 8 * column] ^ self.bytes_of[column][ids[more]]) & self.mask[sizes[more] - 8 * column]) != 0
            more = more[sizes[more] > 8 * (column + 1)]
        if wrong.any():
            wrong = np.concatenate([[0], np.cumsum(wrong)])
            whole &= wrong[bounds[1:]] == wrong[bounds[:-1]]
        return whole

    def _slots(self, keys):
        import numpy as np

        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _next(self, state, char):
        """States after one more character, -1 where no piece goes on like that."""
        import numpy as np

        key = state << 21 | char
        slot = self._slots(key)
        out = np.full(len(key), -1, np.int64)
        open_keys = np.arange(len(key))
        while len(open_keys):
            held = self.slot_key[slot[open_keys]]
            hit = held == key[open_keys]
            out[open_keys[hit]] = self.slot_state[slot[open_keys[hit]]]
            open_keys = open_keys[~hit & (held >= 0)]
            slot[open_keys] += 1
        return out

    def _reset(self) -> None:
        import numpy as np

        self.roots: dict[str, int] = {"": -1}
        self.nodes = self.edges = 0
        self.several: list[list[int]] = []
        self.first = np.zeros(1 << 16, np.int64)  # of each node's edges
        # an edge is left for the next one where a number's first 53 bits reach its limit; it leads to its target's first edge
        self.limit, self.prob, self.log_prob = np.zeros(1 << 18, np.uint64), np.zeros(1 << 18), np.zeros(1 << 18)
        self.target, self.piece = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32)

    def words(self, text: str | None) -> list[str]:
        """The words of the normalised text, each with the mark that starts it."""
        norm = self.model.normalize(text) if text else ""
        parts = norm.split("▁")
        return ([parts[0]] if parts[0] else []) + ["▁" + p for p in parts[1:]]

    def add(self, words: list[str]) -> None:
        """Builds the lattices of words not met yet, all together."""
        import numpy as np

        if self.edges > KEPT_EDGES:
            self._reset()
        new = list(dict.fromkeys([w for w in words if w not in self.roots]))
        if not new:
            return
        text = "".join(new)
        chars = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        ends = np.cumsum([len(w) for w in new])
        self.roots.update(zip(new, (self.nodes + ends - [len(w) for w in new]).tolist()))
        n = len(chars)
        left = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - np.arange(n)  # characters to the word's end
        # edges by length: follow the trie from every character
        at, state = np.arange(n), np.zeros(n, np.int64)
        source, size, piece, weight = [], [], [], []
        for length in range(1, self.longest + 1):
            state = self._next(state, chars[at + length - 1])
            is_piece = np.zeros(len(at), bool)
            known = state >= 0
            is_piece[known] = self.state_id[state[known]] >= 0
            found = at[is_piece]
            source.append(found), size.append(np.full(len(found), length)), piece.append(self.state_id[state[is_piece]]), weight.append(self.state_weight[state[is_piece]])
            if length == 1:
                lone = at[~is_piece]
                source.append(lone), size.append(np.ones(len(lone), np.int64)), piece.append(-1 - len(self.several) - np.arange(len(lone)))
                raw = [text[i].encode() for i in lone.tolist()]
                weight.append(math.log(self.rare) * np.array([len(r) for r in raw], float))
                # one byte is a piece like any other
                piece[-1] = np.array([self.byte[r[0]] if len(r) == 1 else x for r, x in zip(raw, piece[-1].tolist())], np.int64)
                self.several += [[self.byte[b] for b in r] for r in raw]
            on = known & (left[at] > length)
            at, state = at[on], state[on]
        source, size, piece, weight = (np.concatenate(x) for x in (source, size, piece, weight))
        # log mass of all cuts from each character on, by distance from the word's end
        distance = left[source]
        by = np.argsort(distance * n + source)
        source, size, piece, weight = source[by], size[by], piece[by], weight[by]
        bounds = np.searchsorted(distance[by], np.arange(1, int(left.max()) + 2))
        mass = np.zeros(n + 1)
        value = np.empty(len(source))
        last = size == left[source]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own = source[a:b]
            v = weight[a:b] + np.where(last[a:b], 0.0, mass[own + size[a:b]])
            value[a:b] = v
            start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if b > a else np.zeros(0, np.int64)
            if not len(start):
                continue
            top = np.maximum.reduceat(v, start)
            mass[own[start]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, np.diff(np.append(start, b - a)))), start))
        prob = np.exp(value - mass[source])
        by = np.argsort(source - 0.5 * prob)
        source, size, piece, prob, last = source[by], size[by], piece[by], prob[by], last[by]
        first = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]]))
        sums = np.cumsum(prob)
        counts = np.diff(np.append(first, len(source)))
        upto = sums - np.repeat(sums[first] - prob[first], counts)
        upto[first + counts - 1] = 2.0  # the last edge takes what is left
        self.first = _grown(self.first, self.nodes, np.append(first, len(source)) + self.edges)
        self.limit = _grown(self.limit, self.edges, np.ceil(upto * 2.0**53 - 0.5).astype(np.uint64))
        self.prob, self.log_prob = _grown(self.prob, self.edges, prob), _grown(self.log_prob, self.edges, np.log(prob))
        self.target = _grown(self.target, self.edges, np.where(last, -1, np.append(first, 0)[np.where(last, 0, source + size)] + self.edges))
        self.piece = _grown(self.piece, self.edges, piece)
        self.nodes, self.edges = self.nodes + n, self.edges + len(source)


def _grown(array, used: int, more):
    import numpy as np

    if used + len(more) > len(array):
        array = np.concatenate([array, np.zeros(max(len(array), used + len(more) - len(array)), array.dtype)])
    array[used : used + len(more)] = more
    return array


def _stream(seed, sample: int, purpose: int):
    """The random stream of each seed (uint64 array) for one purpose of one sample."""
    import numpy as np

    from shelfwise.llm.words import mix

    return mix(mix(seed) ^ np.uint64((sample << 8 | purpose) * 0x9E3779B97F4A7C15 & (2**64 - 1)))


def _uniform(stream, word, step):
    """Numbers in (0, 1) from streams, one for each word and step."""
    import numpy as np

    from shelfwise.llm.words import mix

    x = mix(stream + _key(word, step))
    # below 1, so that its logarithm is not 0
    return np.minimum(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53, 1 - 2.0**-53)


class _Chain:
    """One segmentation: its edges up to the one that branched off and those walked from there on."""

    __slots__ = ("head", "walk", "gumbel", "log_prob")

    def __init__(self, head, walk, gumbel: float, log_prob: float) -> None:
        self.head, self.walk, self.gumbel, self.log_prob = head, walk, gumbel, log_prob


def _key(word, step):
    """What a word and a step add to a stream."""
    import numpy as np

    return ((word << 24) + step).astype(np.uint64) * np.uint64(STEP)


def _ranges(start, stop):
    """All numbers from start to stop - 1, range after range."""
    import numpy as np

    size = stop - start
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def _numbers(key):
    """The first 53 bits of each key's number, as ``_uniform`` draws it."""
    import numpy as np

    x = key >> np.uint64(30)
    x ^= key
    x *= np.uint64(0xBF58476D1CE4E5B9)
    y = x >> np.uint64(27)
    x ^= y
    x *= np.uint64(0x94D049BB133111EB)
    np.right_shift(x, np.uint64(31), out=y)
    x ^= y
    x >>= np.uint64(11)
    return x


def _walk(lattices: Lattices, edge, key):
    """From each start (a node's first edge, its stream's key), choices to the end of the word: edges in order, and each start's first."""
    import numpy as np

    count, own, rounds = np.zeros(len(edge), np.int64), np.arange(len(edge)), []
    while len(own):
        x = _numbers(key)
        late = np.flatnonzero(x >= lattices.limit.take(edge))
        u, e = x.take(late), edge.take(late)
        while len(late):
            e += 1
            on = np.flatnonzero(u >= lattices.limit.take(e))
            edge[late] = e
            late, u, e = late.take(on), u.take(on), e.take(on)
        rounds.append((own, edge))
        target = lattices.target.take(edge)
        on = np.flatnonzero(target >= 0)
        if len(rounds) == 1:
            count += 1
        else:
            count[own] += 1
        edge, own, key = target.take(on), own.take(on), key.take(on)
        key += np.uint64(STEP)
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(first[-1], np.int64)
    for r, (own, edge) in enumerate(rounds):
        at = first.take(own)
        at += r
        out[at] = edge
    return out, first


def _open_values(before, rest, gumbel, uniform):
    """Largest Gumbel value among the children not taken: location before + log(rest), cut off at ``gumbel``."""
    import numpy as np

    with np.errstate(divide="ignore"):
        location = before + np.log(rest)
        e = -np.log(uniform)
        return -np.logaddexp(-gumbel, np.log(e) - location)


def _largest_open(lattices: Lattices, edges, first, text_first, base, gumbel, streams, word, step, few: int):
    """For each text the ``few`` largest open values of a walk, as lists of (-value, place, edge, word, step, log of the probability before).

    ``first``: each start's first edge; ``text_first``: each text's first start. The logs fall with every choice, so that
    late choices can't be among the largest: more than EARLY are looked at only if they could be.
    """
    import numpy as np

    begin, end = first[text_first[:-1]], first[text_first[1:]]
    out: list[list[tuple]] = [[] for _ in begin]
    width, texts, wider = EARLY, np.flatnonzero(end > begin), []
    while len(texts):
        # so many texts side by side that a long one's table stays small
        side = max(1, 5_000_000 // width)
        group, texts = texts[:side], texts[side:]
        b, e = begin[group], end[group]
        cells = max(1, min(width, int((e - b).max())))
        at = b[:, None] + np.arange(cells)
        inside = at < e[:, None]
        at[~inside] = b[0]
        edge, start = edges.take(at), np.searchsorted(first, at, side="right") - 1
        w, t = word.take(start), step.take(start) + at - first.take(start)
        log_p, left = np.where(inside, lattices.log_prob.take(edge), 0.0), np.where(inside, 1 - lattices.prob.take(edge), 0.0)
        before = base[group][:, None] + np.cumsum(log_p, axis=1)
        later = before[:, -1]
        before = np.concatenate([base[group][:, None], before[:, :-1]], axis=1)
        value = _open_values(before, np.maximum(left, 0.0), gumbel[group][:, None], _uniform(streams[group][:, None], w, t))
        value[left <= 0] = -np.inf
        take = min(few, cells)
        best = np.argpartition(-value, take - 1, axis=1)[:, :take] if take < cells else np.broadcast_to(np.arange(cells), value.shape)
        top = np.take_along_axis(value, best, axis=1)
        least = top.min(axis=1) if take == few else np.full(len(group), -np.inf)
        more = (e - b > cells) & (-np.logaddexp(-gumbel[group], -(later + LARGEST)) >= least)
        pick = np.arange(len(group))[:, None], best
        found = zip(group.tolist(), more.tolist(), (-top).tolist(), best.tolist(), edge[pick].tolist(), w[pick].tolist(), t[pick].tolist(), before[pick].tolist())
        for text, again, *columns in found:
            if not again:
                out[text] = [x for x in zip(*columns) if x[0] < math.inf]
        wider.append(group[more])
        if not len(texts):
            width, texts, wider = 4 * width, np.concatenate(wider), []
    return out


def _sampled(lattices: Lattices, texts: list[str | None], keys: list[int], k: int):
    """The chains of each text, largest Gumbel value first, the largest value still open, and the words of the texts."""
    import heapq

    import numpy as np

    words = [lattices.words(t) for t in texts]
    lattices.add([w for own in words for w in own])
    sizes = np.array([len(own) for own in words], np.int64)
    upto = np.cumsum(sizes)
    roots = lattices.first[np.array([lattices.roots[w] for own in words for w in own], np.int64)].astype(np.int64)
    word = np.arange(len(roots)) - np.repeat(upto - sizes, sizes)
    of_word = _key(word, np.int64(0))
    seeds = np.array([x & (2**64 - 1) for x in keys], np.uint64)
    chains: list[list[_Chain]] = [[] for _ in texts]
    branches: list[list[tuple]] = [[] for _ in texts]  # heaps of (-value, -chain, place or -1, edge, word, step, log before, edges taken)
    none = np.zeros(0, np.int64)
    for sample in range(k):
        if not sample:
            own = np.arange(len(texts))
            zero = np.zeros(len(texts), np.int64)
            gumbel = -np.log(-np.log(_uniform(_stream(seeds, 0, 2), zero, zero)))
            base, start = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            heads = [none] * len(texts)
        else:
            own = np.array([d for d, heap in enumerate(branches) if heap], np.int64)
            if not len(own):
                break
            cut = [heapq.heappop(branches[d]) for d in own.tolist()]
            at_word, at_step = np.array([x[4] for x in cut], np.int64), np.array([x[5] for x in cut], np.int64)
            # the node's edges lie together; its first is found from the edge taken
            node = np.searchsorted(lattices.first[: lattices.nodes + 1], np.array([x[3] for x in cut], np.int64), side="right") - 1
            bounds = zip(lattices.first[node].tolist(), lattices.first[node + 1].tolist())
            draw = _uniform(_stream(seeds[own], sample, 3), at_word, at_step).tolist()
            heads, chosen, rests, bases = [], [], [], []
            for d, (_, chain, place, e0, _, _, before, taken), (a, b), x in zip(own.tolist(), cut, bounds, draw):
                probs = lattices.prob[a:b].tolist()
                choices = [e for e in range(a, b) if e != e0 and e not in taken]
                weights = [probs[e - a] for e in choices]
                total = sum(weights)
                x *= total
                pick = len(choices) - 1
                for i, w in enumerate(weights):
                    x -= w
                    if x < 0:
                        pick = i
                        break
                c = chains[d][-chain]
                edge = choices[pick]
                chosen.append(edge)
                rests.append(max(total - weights[pick], 0.0) if len(choices) > 1 else 0.0)
                bases.append(before + math.log(probs[edge - a]))
                heads.append(np.concatenate([c.head[:-1] if place < 0 else c.head, c.walk[: max(place, 0)], np.array([edge], np.int64)]))
            gumbel, base = -np.array([x[0] for x in cut]), np.array(bases)
            target = lattices.target[np.array(chosen, np.int64)]
            # a choice inside a word goes on in the place of its word
            start = at_word + (target < 0)
        place_of = _ranges((upto - sizes)[own] + start, upto[own])
        count = sizes[own] - start
        text_first = np.concatenate([[0], np.cumsum(count)])
        edge, step = roots[place_of], np.zeros(len(place_of), np.int64)
        stream = _stream(seeds[own], sample, 0)
        if sample:
            inside = np.flatnonzero(target >= 0)
            edge[text_first[inside]], step[text_first[inside]] = target[inside], at_step[inside] + 1
        key = of_word[place_of]
        key += step.astype(np.uint64) * np.uint64(STEP)
        key += np.repeat(stream, count)
        edges, first = _walk(lattices, edge, key)
        begin, end = first[text_first[:-1]], first[text_first[1:]]
        sums = np.zeros(len(own))
        some = np.flatnonzero(end > begin)
        if len(some):
            sums[some] = np.add.reduceat(lattices.log_prob[edges], begin[some])
        opened = _largest_open(lattices, edges, first, text_first, base, gumbel, _stream(seeds[own], sample, 1), word[place_of], step, k - sample)
        if sample:
            # below the branch's value, as the siblings left behind are
            rest = np.array(rests)
            here = _open_values(np.array([x[6] for x in cut]), rest, gumbel, _uniform(_stream(seeds[own], sample, 1), at_word, at_step)).tolist()
        found = zip(own.tolist(), begin.tolist(), end.tolist(), gumbel.tolist(), (base + sums).tolist(), heads, opened)
        for i, (d, a, b, g, log_prob, head, values) in enumerate(found):
            chain = -len(chains[d])
            chains[d].append(_Chain(head, edges[a:b], g, log_prob))
            for x in values:
                heapq.heappush(branches[d], (x[0], chain, *x[1:], ()))
            if sample and rests[i] > 0 and here[i] > -math.inf:
                _, _, _, e0, w, t, before, taken = cut[i]
                heapq.heappush(branches[d], (-here[i], chain, -1, chosen[i], w, t, before, (e0, *taken)))
    return chains, [-heap[0][0] if heap else -math.inf for heap in branches], words


def _inclusion(log_prob: float, threshold: float) -> float:
    """Log of 1 - exp(-exp(x)): of drawing a value above the threshold."""
    x = log_prob - threshold
    return x if x < -30 else 0.0 if x > 5 else math.log(-math.expm1(-math.exp(x)))


def _ids(lattices: Lattices, chains: list[list[_Chain]]):
    """Piece ids of all chains after each other, as int32, and where each chain's begin; fallbacks become their bytes' ids."""
    import numpy as np

    parts = [x for own in chains for c in own for x in (c.head, c.walk)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)])[::2]
    ids = lattices.piece.take(np.concatenate([np.zeros(0, np.int64), *parts]))
    fallback = np.flatnonzero(ids < 0)
    if not len(fallback):
        return ids, bounds
    several = [lattices.several[-1 - i] for i in ids[fallback].tolist()]
    counts = np.ones(len(ids), np.int64)
    counts[fallback] = [len(x) for x in several]
    out = np.repeat(ids, counts)
    out[np.repeat(ids < 0, counts)] = [x for own in several for x in own]
    return out, np.concatenate([[0], np.cumsum(counts)])[bounds]


def sample_texts(lattices: Lattices, texts: list[str | None], keys: list[int], k: int) -> list[list[tuple]]:
    """For each text, up to k of (ids, log_prob, gumbel, log_inclusion), largest Gumbel value first."""
    if not texts:
        return []
    chains, thresholds, _ = _sampled(lattices, texts, keys, k)
    ids, bounds = _ids(lattices, chains)
    spans = iter(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
    return [[(ids[slice(*next(spans))], c.log_prob, c.gumbel, _inclusion(c.log_prob, t)) for c in own] for own, t in zip(chains, thresholds)]


def _round_trips(lattices: Lattices, texts: list[str | None], words: list[list[str]], chains: list[list[_Chain]], ids, bounds) -> list[bool]:
    """Whether each chain's ids decode to its text: by the bytes that they spell, whose first mark is no part of the text, or else by the model."""
    norms = ["".join(own).replace("▁", " ").encode() for own in words]
    spelt = iter(lattices.spells(ids, bounds, [norm for norm, own in zip(norms, chains) for _ in own]).tolist())
    spans, out = iter(zip(bounds[:-1].tolist(), bounds[1:].tolist())), []
    for text, norm, own in zip(texts, norms, chains):
        text = text or ""
        plain = norm[:1] == b" " and norm[1:] == text.encode()
        for _ in own:
            a, b = next(spans)
            out.append(next(spelt) and plain or lattices.model.decode(ids[a:b].tolist()) == text)
    return out


def sample(docs: DataFrame, k: int = SAMPLES, model_path: str | None = None, seed: int = SEED) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) up to k distinct segmentations: columns as in SCHEMA, sample from 1; round_trip: whether the ids decode to the text."""
    path = model_path or piece_path()
    bound_batches(docs.sparkSession)

    def draw(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        lattices = _lattices(path)
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            at = 0
            while at < len(rows):
                # a few texts together, by their length in words
                end, size = at, 0
                while end < len(rows) and (end == at or size < TOGETHER):
                    size += 1 + len(rows[end][1] or "") // 5
                    end += 1
                some = rows[at:end]
                at = end
                texts = [r[1] for r in some]
                chains, thresholds, words = _sampled(lattices, texts, [r[2] for r in some], k)
                ids, bounds = _ids(lattices, chains)
                trips = _round_trips(lattices, texts, words, chains, ids, bounds)
                raw, spans = memoryview(ids.astype("<i4", copy=False)).cast("B"), (4 * bounds).tolist()
                crcs = [zlib.crc32(raw[a:b]) for a, b in zip(spans[:-1], spans[1:])]
                out = [(r[0], i + 1, c.log_prob, c.gumbel, _inclusion(c.log_prob, t)) for r, own, t in zip(some, chains, thresholds) for i, c in enumerate(own)]
                doc_id, number, p, g, q = zip(*out)
                arrays = [
                    pa.array(doc_id, pa.int64()), pa.array(number, pa.int32()), pa.array(np.diff(bounds)), pa.array(p, pa.float64()), pa.array(g, pa.float64()), pa.array(q, pa.float64()),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)), pa.array(crcs, pa.int64()), pa.array(trips, pa.bool_()),
                ]
                names = ["doc_id", "sample", "n_pieces", "log_prob", "gumbel", "log_inclusion", "ids", "ids_crc32", "round_trip"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    key = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")).alias("key")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), key).mapInArrow(draw, SCHEMA)


@lru_cache(maxsize=1)
def _lattices(path: str) -> Lattices:
    return Lattices(path)


@lru_cache(maxsize=1)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def decode(rows: DataFrame, model_path: str | None = None) -> DataFrame:
    """``rows`` (with ids: array<int>) with column decoded: their text. Null ids give null; ``rows`` must not have the column yet."""
    path = model_path or piece_path()

    @F.pandas_udf("string")
    def text(ids):
        import pandas as pd

        model = _model(path)
        return pd.Series([None if x is None else model.decode([int(i) for i in x]) for x in ids], dtype=object)

    return rows.withColumn("decoded", text("ids"))


def op6(spark, sf_dir: str) -> DataFrame:
    from shelfwise.llm.common import table

    return sample(table(spark, sf_dir, "documents", "doc_id", "text"))
