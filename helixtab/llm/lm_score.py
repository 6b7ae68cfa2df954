"""Language-model scores of texts: word counts as the base, and a causal self-attention model over subword ids.

Texts are encoded once: their subword ids go to a scratch table, from which words are counted, the model is trained and texts are scored.
Counting covers every training text: word counts, the number of tokens and subword counts are summed by Spark and grow with the
corpus. The attention model (one causal head over windows of WINDOW subwords) is trained in numpy on every training text, once: in each of
ROUNDS rounds, every task trains a model of its own on its texts of that round, and Spark averages what the tasks changed, weighted by tokens; the driver
sees at most MEANS of these averages. So the score depends slightly on how the table is split. The model predicts the next subword itself: the probability of an id is a
product along its way in a tree of all ids, at whose every node the attention's output decides between the children. Frequent ids are children of the root; the tree
is made from the subword counts, and an untrained node gives the shares of the corpus. Every id has an input vector of its own.

A text is scored in windows that overlap by CONTEXT: a window's first CONTEXT positions serve as context only, so that every token is
scored exactly once; all windows of a batch go through masked attention together.

The words with most counts (HOT of them, a table of fixed size) are known to every task; the rest of a text's words meet their
counts in a join. Subword ids come from a public byte-pair vocabulary, whose path is a parameter; each distinct word is encoded once
a task. The ids of a word name it.

Null text is the empty text: one token, the end. Rows with a null id are not learned from and count as held out. Repeated rows are
scored each. Empty training data: every count is 0 and the score is that of the untrained model. Empty table: empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import math
import os
import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, most_frequent, only
from .textnum import chunks, mix, powers, spans_hash, words

#: A byte-pair vocabulary as ranks, at the same path on the driver and every executor; the session's SETTING or score()'s parameter names another.
VOCABULARY, SETTING = "/opt/tokenizers/byte_bpe_50k.tiktoken", "spark.helixtab.vocabulary"
IDS, END = 50257, 50256
WINDOW, CONTEXT = 32, 8
STRIDE = WINDOW - CONTEXT
DIM, CLASSES, ALONE, FAN, INPUTS = 16, 32, 20, 16, IDS + 2
#: Inner nodes below the root, at most; rows of one node that are multiplied at once.
NODES, BLOCK = -(-IDS // (FAN - 1)) + CLASSES, 16
#: Most frequent words known to every task, this many at most: more mean fewer rows in a join, whatever is known the counts are the same.
HOT = 1 << 18
BATCH, RATE = 256, 4e-3
#: Windows whose ids below the root are scored at once.
GROUP = 512
#: Times that the tasks' models are averaged, tokens below which a task isn't split off, and averages that the driver sees a round.
ROUNDS, TASK_TOKENS, MEANS = 4, 800_000, 16
#: Distinct words a process holds at once.
CACHE = 500_000
#: Tokens taken at once from stored ids, and a random 64-bit value for each id.
TOKENS = 400_000
KEY = np.random.Generator(np.random.PCG64(20250310)).integers(1, 2**63, IDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(2)
def encoder(path: str):
    """The encoding, and which of its ids begin with a blank."""
    import public_tokenizers
    import tiktoken

    if not os.path.isfile(path):
        raise FileNotFoundError(f"{path}: the subword vocabulary must be on the driver and every executor; {SETTING} names its path")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    opens = np.zeros(IDS, bool)
    opens[[k for word, k in ranks.items() if word[:1] == b" "]] = True
    return tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), opens


@lru_cache(1)
def known_words(path: str) -> Words:
    """The words that this process has met, over all of its tasks."""
    return Words(path)


class Words:
    """Subword ids of words, each distinct word encoded once."""

    def __init__(self, path: str):
        encoding, self.opens = encoder(path)
        self.encode = encoding.encode_ordinary
        self.clear()

    def clear(self) -> None:
        self.known, self.row = np.empty(0, np.uint64), np.empty(0, np.int64)  # hashes in order, and the row of each
        self.first, self.count, self.flat, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.int32), 0

    def rows(self, hashes: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Row of each distinct word; `hashes` are in order, `starts` and `ends` give one place of each."""
        if len(self.known) + len(hashes) > CACHE:
            self.clear()
        place = np.searchsorted(self.known, hashes)
        out = np.full(len(hashes), -1)
        if len(self.known):
            at = np.minimum(place, len(self.known) - 1)
            out = np.where(self.known.take(at) == hashes, self.row.take(at), -1)
        new = np.flatnonzero(out < 0)
        if not len(new):
            return out
        # all new words in one text: a word has no blank of its own, so ids that begin with one begin a word
        low = _LOWER[buf].tobytes()
        parts = [low[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
        ids = np.array(self.encode((b" " + b" ".join(parts)).decode("utf-8", "replace")), np.int32)
        begin = np.flatnonzero(self.opens[ids])
        if len(begin) != len(new):  # other white space inside words may join them: one at a time then
            each = [self.encode((b" " + w).decode("utf-8", "replace")) for w in parts]
            ids = np.array([x for y in each for x in y], np.int32)
            begin = np.cumsum([0, *map(len, each)])[:-1]
        row, size = len(self.known), len(new)
        if row + size > len(self.first):
            self.first, self.count = np.resize(self.first, 2 * (row + size)), np.resize(self.count, 2 * (row + size))
        if self.n + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.n + len(ids)))
        self.first[row : row + size] = self.n + begin
        self.count[row : row + size] = np.diff(np.r_[begin, len(ids)])
        self.flat[self.n : self.n + len(ids)] = ids
        self.n += len(ids)
        out[new] = np.arange(row, row + size)
        self.known, self.row = np.insert(self.known, place[new], hashes[new]), np.insert(self.row, place[new], out[new])
        return out


def subwords(table: Words, buf: np.ndarray, offsets: np.ndarray):
    """Of a chunk: distinct word hashes, the row of texts and index of each word; subword ids of all texts, each closed by END, and the
    offsets of the texts within."""
    n = len(offsets) - 1
    starts, ends, rows = words(buf, offsets)
    h, at, inverse = np.unique(spans_hash(buf, starts, ends), return_index=True, return_inverse=True)
    mine = table.rows(h, buf, starts[at], ends[at])
    first, count = table.first[mine][inverse], table.count[mine][inverse]
    # words and one end a text, in order of text
    unit_first, unit_count = np.full(len(rows) + n, -1, np.int64), np.ones(len(rows) + n, np.int64)
    place = np.arange(len(rows)) + rows
    unit_first[place], unit_count[place] = first, count
    total = np.r_[0, np.cumsum(unit_count)]
    inside = np.arange(total[-1]) - np.repeat(total[:-1], unit_count)
    source = np.repeat(unit_first, unit_count)
    ids = np.where(source < 0, END, table.flat[np.maximum(0, source) + inside]).astype(np.int64)
    ends_at = np.cumsum(np.bincount(rows, minlength=n)) + np.arange(n)  # place of each end
    bounds = np.r_[0, total[ends_at + 1]]
    return h, rows, inverse, ids, bounds


def stored(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, subword ids, offsets of the texts and the end within the ids) of encoded texts, at most TOKENS or one text at once."""
    column, n, at = column.cast(pa.large_binary()), len(column), 0
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8) // 2
    ids = np.frombuffer(data, np.uint16, offsets[-1])
    while at < n:
        end = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + TOKENS, side="right")) - 1))
        yield at, end, ids[offsets[at] : offsets[end]].astype(np.int64), offsets[at : end + 1] - offsets[at]
        at = end


def word_keys(ids: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and text of each word: a word runs from an id that begins with a blank to the next one or END."""
    close = ids == END
    units = np.flatnonzero(opens[ids] | close)
    is_word = ~close[units]
    starts, ends = units[is_word], units[1:][is_word[:-1]]  # the last unit is an END
    up, down = powers(len(ids) + 1)
    total = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(KEY[ids] * up[: len(ids)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), (np.cumsum(~is_word) - ~is_word)[is_word]


def classes(counts: np.ndarray) -> dict[str, np.ndarray]:
    """The tree of all subword ids, from counts over the corpus: class of an id at the root, its log share within the class, and its way from
    the class downwards, as the (node, child) pairs at `begin`, `depth` of them. `share` has the log shares of each node's children; below the root, the tree is
    Huffman's with FAN children. Also the input row of every id."""
    order = np.lexsort((np.arange(IDS), -counts))
    smooth = counts + 1.0
    of = np.empty(IDS, np.int64)
    of[order[:ALONE]] = np.arange(ALONE)
    rest = order[ALONE:]
    mass = np.cumsum(smooth[rest])
    of[rest] = ALONE + np.minimum(CLASSES - ALONE - 1, (mass / mass[-1] * (CLASSES - ALONE)).astype(np.int64))
    sums = np.bincount(of, smooth, minlength=CLASSES)
    parts, above, place = [], {}, {}  # children's masses of each node; (node, child) that a node, an id hangs from
    for c in range(CLASSES):
        heap = [(smooth[k], int(k), None) for k in np.flatnonzero(of == c)]
        if len(heap) < 2:
            continue
        heap += [(0.0, IDS + k, None) for k in range(-(len(heap) - 1) % (FAN - 1))]  # so that every node is full; nothing comes here
        heapq.heapify(heap)
        while len(heap) > 1:
            node, children = len(parts), [heapq.heappop(heap) for _ in range(FAN)]
            for child, (_, k, inner) in enumerate(children):
                if inner is not None:
                    above[inner] = (node, child)
                else:
                    place[k] = (node, child)
            parts.append([m for m, _, _ in children])
            heapq.heappush(heap, (sum(parts[-1]), IDS + FAN + node, node))
    ways: list[list[tuple[int, int]]] = [[] for _ in range(IDS)]
    for k, at in place.items():
        while at and k < IDS:
            ways[k].append(at)
            at = above.get(at[0])
    depth = np.array([len(w) for w in ways])
    flat = np.array([at for w in ways for at in w], np.int64).reshape(-1, 2)
    masses = np.array(parts, float).reshape(-1, FAN)
    with np.errstate(divide="ignore"):
        share = np.maximum(np.log(masses / masses.sum(1, keepdims=True)), -60).astype(np.float32)
    return {"of": of, "within": np.log(smooth / sums[of]).astype(np.float32), "row": np.arange(IDS), "begin": np.cumsum(depth) - depth, "depth": depth, "node": flat[:, 0].astype(np.uint16), "child": flat[:, 1].astype(np.uint8), "share": share}


def windows(ids: np.ndarray, bounds: np.ndarray, maps: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input rows (windows, WINDOW), positions of the tokens that each scores (windows, STRIDE; -1: none), and which windows begin a text."""
    length = np.diff(bounds)
    n = -(-length // STRIDE)
    text = np.repeat(np.arange(len(length)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    begin = (bounds[:-1][text] + k * STRIDE).astype(np.int32)
    score = begin[:, None] + np.arange(STRIDE, dtype=np.int32)
    last = np.flatnonzero(np.r_[text[1:] != text[:-1], np.ones(min(1, len(text)), bool)])  # the only windows that may end beyond their text
    score[last] = np.where(score[last] < bounds[1:][text[last]][:, None], score[last], -1)
    see = begin[:, None] + np.arange(-CONTEXT - 1, STRIDE - 1, dtype=np.int32)  # the input at a position is the token before
    x, opening = maps["row"].astype(np.int32).take(ids).take(see, mode="clip"), np.flatnonzero(k == 0)
    x[opening, : CONTEXT + 1] = INPUTS - 2  # begin of text
    return x, score, k == 0


#: 1 where a scored position may look, 0 elsewhere: zeros stay zeros, where very small numbers would make every product slow.
MASK = (np.arange(WINDOW)[None, :] <= np.arange(CONTEXT, WINDOW)[:, None]).astype(np.float32)
FIRST = MASK * (np.arange(WINDOW)[None, :] >= CONTEXT).astype(np.float32)


def initial(maps: dict[str, np.ndarray], counts: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    f = lambda *s: (rng.standard_normal(s) / math.sqrt(s[0])).astype(np.float32)
    mass = np.bincount(maps["of"], counts + 1.0, minlength=CLASSES)
    p = {"E": (0.5 * rng.standard_normal((INPUTS, DIM))).astype(np.float32), "P": 0.1 * f(WINDOW, DIM), "Q": f(DIM, DIM), "K": f(DIM, DIM), "V": 0.3 * f(DIM, DIM), "U": 0.3 * f(DIM, CLASSES), "b": np.log(mass / mass.sum()).astype(np.float32)}
    return p | {"W": np.zeros((NODES, DIM, FAN), np.float32)}  # within a class, the corpus' shares to begin with


def forward(p: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hidden states of the scored positions, and what the gradients need. Keys and values are linear in the inputs, so both products go to the queries' side."""
    e = p["E"].take(x, 0)
    e += p["P"]
    xq = np.ascontiguousarray(e[:, CONTEXT:])
    q = (xq.reshape(-1, DIM) @ (p["Q"] @ p["K"].T / np.float32(math.sqrt(DIM)))).reshape(xq.shape)
    a = q @ e.transpose(0, 2, 1)
    np.clip(a, -60, 60, out=a)
    np.exp(a, out=a)
    a *= MASK
    if first.any():
        a[first] *= FIRST
    s = (a.reshape(-1, WINDOW) @ np.ones(WINDOW, a.dtype)).reshape(*a.shape[:2], 1)
    c = a @ e
    c /= s
    h = (c.reshape(-1, DIM) @ p["V"]).reshape(c.shape)
    h += xq
    return h, (e, xq, q, a, s, c)


def runs_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return np.flatnonzero(new)


def sums_by(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; two columns are added at once as one complex number."""
    return np.add.reduceat(values.view(np.result_type(values.dtype, np.complex64)), begin, axis=0).view(values.dtype)


def inner(p, maps: dict[str, np.ndarray], h: np.ndarray, ids: np.ndarray, valid: np.ndarray | None = None, gradient: bool = True):
    """Log probability of ids (tokens) below the root, given their classes and the hidden states h (tokens, DIM); 0 where not valid. With gradient also
    that of the loss by h, and rows and gradients of W."""
    n = maps["depth"].take(ids)
    if valid is not None:
        n *= valid
    some = np.flatnonzero(n)
    n, out, dh = n[some], np.zeros(len(ids)), np.zeros_like(h)
    if not len(some):
        return (out, dh, some, np.empty((0, DIM, FAN), h.dtype)) if gradient else out
    ends = np.cumsum(n)
    begin = ends - n
    at = np.repeat(maps["begin"].take(ids.take(some)) - begin, n)
    at += np.arange(ends[-1])
    node = maps["node"].take(at)
    # visits of a node fill blocks of BLOCK rows, each block is multiplied by its node's matrix
    order = np.argsort(node, kind="stable")
    runs = node.take(order)
    start = runs_of(runs)
    size = np.diff(start, append=len(runs))
    blocks = -(-size // BLOCK)
    block = np.cumsum(blocks) - blocks
    slot = np.empty(len(node), np.int64)
    slot[order] = np.arange(len(runs)) + np.repeat(block * BLOCK - start, size)
    rows = runs[start].astype(np.int64)
    of = np.repeat(rows, blocks)
    source = np.full(len(of) * BLOCK, len(h))  # the row of zeros below fills the blocks
    source[slot] = np.repeat(some, n)
    held = np.concatenate([h, np.zeros((1, DIM), h.dtype)]).take(source, 0).reshape(-1, BLOCK, DIM)
    w = p["W"].take(of, 0)
    z = held @ w
    z += maps["share"].take(of, 0)[:, None]
    np.clip(z, -60, 60, out=z)
    np.exp(z, out=z)
    s = (z.reshape(-1, FAN) @ np.ones(FAN, z.dtype)).reshape(-1, BLOCK, 1)
    flat, own = z.ravel(), slot * FAN + maps["child"].take(at)
    share = flat.take(own) / s.ravel().take(slot)
    out[some] = np.add.reduceat(np.log(share), begin)
    if not gradient:
        return out
    z /= s
    flat[own] = share - 1
    back = (z @ w.transpose(0, 2, 1)).reshape(-1, DIM)
    more = back.take(slot.take(begin), 0)
    deep = np.flatnonzero(n > 1)
    for level in range(1, int(n.max())):
        deep = deep[n.take(deep) > level]
        more[deep] += back.take(slot.take(begin.take(deep) + level), 0)
    dh[some] = more
    return out, dh, rows, sums_by((held.transpose(0, 2, 1) @ z).reshape(-1, DIM * FAN), block).reshape(-1, DIM, FAN)


def gradients(p, x, first, target, valid, ids=None, maps=None) -> tuple[float, int, dict[str, np.ndarray], dict[str, tuple[np.ndarray, np.ndarray]]]:
    """Sums over the tokens: loss, number, gradients but for E and W, and of these the rows that occur and their gradients. Without ids, the loss is that of the classes."""
    h, (e, xq, q, a, s, c) = forward(p, x, first)
    flat, valid = h.reshape(-1, DIM), valid.ravel()
    at = np.flatnonzero(valid)
    z = flat @ p["U"]
    z += p["b"]
    np.clip(z, -60, 60, out=z)
    np.exp(z, out=z)
    z /= (z @ np.ones(CLASSES, z.dtype))[:, None]
    place = at * CLASSES + target.ravel().take(at)
    own = z.ravel().take(place)
    loss = -float(np.log(own).sum())
    z.ravel()[place] = own - 1
    if len(at) < len(z):
        z[~valid] = 0
    g, sparse = {"U": flat.T @ z, "b": np.ones(len(z), z.dtype) @ z}, {}
    dh = z @ p["U"].T
    if ids is not None:
        below, more, rows, dw = inner(p, maps, flat, ids.ravel(), valid)
        loss -= float(below.sum())
        dh += more
        sparse["W"] = (rows, dw)
    cf, xf = c.reshape(-1, DIM), xq.reshape(-1, DIM)
    g["V"] = cf.T @ dh
    dc = (dh @ p["V"].T).reshape(c.shape)
    dc /= s
    da = dc @ e.transpose(0, 2, 1)
    da -= ((dc.reshape(-1, DIM) * cf) @ np.ones(DIM, dc.dtype)).reshape(s.shape)
    da *= a
    scale = np.float32(1 / math.sqrt(DIM))
    dq = (da @ e).reshape(-1, DIM)
    dm = xf.T @ dq * scale
    g["Q"], g["K"] = dm @ p["K"], dm.T @ p["Q"]
    de = da.transpose(0, 2, 1) @ q
    de += a.transpose(0, 2, 1) @ dc
    dh += dq @ (p["K"] @ p["Q"].T * scale)
    de[:, CONTEXT:] += dh.reshape(c.shape)
    g["P"] = de.sum(0)
    rows = x.ravel().astype(np.uint16)
    order = np.argsort(rows, kind="stable")
    rows = rows.take(order)
    begin = runs_of(rows)
    sparse["E"] = (rows[begin].astype(np.int64), sums_by(de.reshape(-1, DIM).take(order, 0), begin))
    return loss, len(at), g, sparse


def train_step(p, x, first, target, valid, ids=None, maps=None):
    """Mean loss per token and its gradients; ids and maps as in gradients()."""
    loss, n, g, sparse = gradients(p, x, first, target, valid, ids, maps)
    for name, (rows, v) in sparse.items():
        g[name] = np.zeros_like(p[name])
        g[name][rows] = v
    return loss / max(1, n), {k: g[k] / np.float32(max(1, n)) if k in g else np.zeros_like(p[k]) for k in p}


def update(p, g, m, s, step: int, rate: float) -> None:
    """One step of Adam, in place; gradients are arrays, or rows and the gradients of these alone."""
    rate *= min(1, step / 20) / (1 - 0.9**step) * math.sqrt(1 - 0.98**step)
    for k, v in g.items():
        at, v = v if isinstance(v, tuple) else (None, v)
        one, two, now = (d[k] if at is None else d[k].take(at, 0) for d in (m, s, p))
        change = v - one
        change *= 0.1
        one += change
        np.multiply(v, v, out=change)
        change -= two
        change *= 0.02
        two += change
        np.sqrt(two, out=change)
        change += np.float32(1e-8)
        np.divide(one, change, out=change)
        change *= np.float32(rate)
        now -= change
        if at is not None:
            m[k][at], s[k][at], p[k][at] = one, two, now


def train_on(p: dict[str, np.ndarray], chunked: Iterator[tuple[np.ndarray, np.ndarray]], maps: dict[str, np.ndarray], rate: float, seed: int = 5) -> tuple[int, list[float]]:
    """Adam over the windows of (ids, bounds), shuffled within a chunk, at most a chunk and a batch held at once; changes p, gives the number of tokens and the mean loss of each step."""
    rng = np.random.Generator(np.random.PCG64(seed))
    m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    losses, tokens, left = [], 0, None

    def learn(x: np.ndarray, first: np.ndarray, own: np.ndarray, valid: np.ndarray) -> None:
        nonlocal tokens
        loss, n, g, sparse = gradients(p, x, first, maps["of"].take(own), valid, own, maps)
        scale = np.float32(1 / max(1, n))
        losses.append(loss * scale)
        tokens += n
        update(p, {k: v * scale for k, v in g.items()} | {k: (rows, v * scale) for k, (rows, v) in sparse.items()}, m, s, len(losses), rate)

    for ids, bounds in chunked:
        x, score, first = windows(ids, bounds, maps)
        order = rng.permutation(len(x))
        new = [v.take(order, 0) for v in (x, first, ids.take(score, mode="clip"), score >= 0)]
        rows = new if left is None else [np.concatenate(v) for v in zip(left, new, strict=True)]
        whole = len(rows[0]) // BATCH * BATCH
        for a in range(0, whole, BATCH):
            learn(*(v[a : a + BATCH] for v in rows))
        left = [v[whole:].copy() for v in rows]
    if left is not None and len(left[0]):
        learn(*left)
    return tokens, losses


def train(ids: np.ndarray, bounds: np.ndarray, maps: dict[str, np.ndarray], counts: np.ndarray, seed: int = 5) -> tuple[dict[str, np.ndarray], float]:
    """Parameters after one pass over shuffled windows, and the mean loss of the last tenth of the steps."""
    p = initial(maps, counts)
    if len(bounds) < 2:
        return p, 0.0
    _, losses = train_on(p, [(ids, bounds)], maps, RATE, seed)
    return p, float(np.mean(losses[-max(1, len(losses) // 10) :]))


def fit(learn: DataFrame, maps: dict[str, np.ndarray], counts: np.ndarray, path: str) -> tuple[dict[str, np.ndarray], int]:
    """learn(doc_id, text), or with ids as of encoded(), -> parameters, and the number of tokens that they were trained on: all of them, once."""
    context, p, seen = learn.sparkSession.sparkContext, initial(maps, counts), 0
    if "ids" not in learn.columns:
        learn = encoded(learn.withColumn("held_out", F.lit(False)), path)
    learn = learn.coalesce(max(1, int(counts.sum()) // TASK_TOKENS))
    fields = "slot int, task int, n bigint, p binary"

    def row(slot: int, task: int, n: int, change: dict[str, np.ndarray]) -> pa.RecordBatch:
        """Of what changed, the rows that aren't zero."""
        some = {k: (at, v[at].astype(np.float32)) for k, v in change.items() for at in [np.flatnonzero(v.reshape(len(v), -1).any(1))]}
        return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([task], pa.int32()), pa.array([n]), pa.array([pickle.dumps(some)], pa.binary())], ["slot", "task", "n", "p"])

    for turn in range(ROUNDS):
        shared, rate = context.broadcast((p, maps)), RATE * (1 - 0.9 * turn / ROUNDS)

        def own(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:
            start, maps = shared.value
            p, task = {k: v.copy() for k, v in start.items()}, TaskContext.get().partitionId()
            n, _ = train_on(p, (part[2:] for b in batches for part in stored(b.column(0))), maps, rate)
            if n:
                yield row(task % MEANS, task, n, {k: v - start[k] for k, v in p.items()})

        def mean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total, sums = 0, {k: np.zeros(v.shape) for k, v in shared.value[0].items()}
            for b in batches:
                for n, q in zip(b.column(2).to_pylist(), b.column(3), strict=True):
                    total += n
                    for k, (at, v) in pickle.loads(q.as_py()).items():
                        sums[k][at] += n * v.astype(np.float64)
            if total:
                yield row(0, 0, total, {k: v / total for k, v in sums.items()})

        part = learn.filter(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == turn).select("ids")
        models = part.mapInArrow(own, fields).repartition(MEANS, "slot").sortWithinPartitions("task")
        means = [(r["n"], pickle.loads(r["p"])) for r in models.mapInArrow(mean, fields).collect()]
        n = sum(k for k, _ in means)
        p = {name: v.copy() for name, v in p.items()}
        for k, change in means:
            for name, (at, v) in change.items():
                p[name][at] += np.float32(k / n) * v
        seen += n
    return p, seen


def log_probability(p: dict[str, np.ndarray], maps: dict[str, np.ndarray], ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Natural log probability of each text; every token is scored once."""
    x, score, first = windows(ids, bounds, maps)
    token, ones = np.zeros(len(ids)), np.ones(CLASSES, np.float32)
    for a in range(0, len(x), GROUP):
        h = np.concatenate([forward(p, x[b : b + BATCH], first[b : b + BATCH])[0] for b in range(a, min(a + GROUP, len(x)), BATCH)])
        at, h = score[a : a + GROUP].ravel(), h.reshape(-1, DIM)
        if (keep := np.flatnonzero(at >= 0)).size < len(at):
            at, h = at.take(keep), h.take(keep, 0)
        now = ids.take(at)
        z = h @ p["U"]
        z += p["b"]
        own = z.ravel().take(np.arange(len(at)) * CLASSES + maps["of"].take(now))
        token[at] = own - np.log(np.exp(z, out=z) @ ones) + inner(p, maps, h, now, gradient=False)
    return np.add.reduceat(token, bounds[:-1]) if len(bounds) > 1 else np.empty(0)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text, held_out) -> doc_id, held_out, ids: subword ids of the text and END, two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known_words(path)
        for b in batches:
            for first, end, buf, offsets in chunks(b.column(1)):
                *_, ids, bounds = subwords(table, buf, offsets)
                lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), end - first, [None, pa.py_buffer(2 * bounds), pa.py_buffer(ids.astype(np.uint16))])
                yield pa.RecordBatch.from_arrays([b.column(0)[first:end], b.column(2)[first:end], lists.cast(pa.binary())], ["doc_id", "held_out", "ids"])

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id bigint, held_out boolean, ids binary")


def count(texts: DataFrame, path: str) -> DataFrame:
    """texts(ids) -> (kind, key, n): word hashes (0), subword ids (1) and, under key 0, texts (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opens, subs, texts = encoder(path)[1], np.zeros(IDS, np.int64), 0
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> pa.RecordBatch:
            keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([v for _, v in held])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(keys), np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], ["kind", "key", "n"])

        for b in batches:
            for first, end, ids, _ in stored(b.column(0)):
                held.append(np.unique(word_keys(ids, opens)[0], return_counts=True))
                subs += np.bincount(ids, minlength=IDS)
                texts += end - first
                if sum(len(k) for k, _ in held) > 1_000_000:
                    yield merged()
                    held = []
        if held:
            yield merged()
        at = np.flatnonzero(subs)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.ones(len(at), np.int32), 2], pa.int32()), pa.array(np.r_[at, 0]), pa.array(np.r_[subs[at], texts])], ["kind", "key", "n"])

    return texts.select("ids").mapInArrow(run, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, held_out_of: int = 7, held_out: int = 2, vocabulary: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. FileNotFoundError before any job where the driver has no vocabulary."""
    spark = docs.sparkSession
    vocabulary = vocabulary or spark.conf.get(SETTING, VOCABULARY)
    encoder(vocabulary)
    scratch = Scratch(spark)
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % held_out_of == held_out, F.lit(True))
    rows = scratch.write(encoded(only(docs, doc_id="bigint", text="string").withColumn("held_out", out), vocabulary), "encoded")
    learn = rows.filter(~F.col("held_out"))
    counts = scratch.write(count(learn, vocabulary), "counts")
    told = counts.filter("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    texts = counts.filter("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    n, v = told["n"] + texts, told["v"] + (texts > 0)
    subs = np.zeros(IDS)
    for r in counts.filter("kind = 1").collect():  # at most IDS rows
        subs[r["key"]] = r["n"]
    maps = classes(subs)
    hot = most_frequent(counts.filter("kind = 0"), HOT).select("key", "n").toPandas()
    hot_keys = hot["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hot_keys)
    hot_keys, hot_n = hot_keys[order], hot["n"].to_numpy(np.int64)[order]

    p, _ = fit(learn, maps, subs, vocabulary)
    shared = spark.sparkContext.broadcast((p, maps, hot_keys, np.log10(hot_n + 1.0), texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, maps, keys, logs, ends = shared.value
        opens, at, part = encoder(vocabulary)[1], 0, TaskContext.get().partitionId() << 40
        for b in batches:
            for first, end, ids, bounds in stored(b.column(1)):
                keys_, rows_ = word_keys(ids, opens)
                h, inverse = np.unique(keys_, return_inverse=True)
                m = end - first
                lm = log_probability(p, maps, ids, bounds) / math.log(10)
                place = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                known = keys[place] == h if len(keys) else np.zeros(len(h), bool)
                k, value = known[inverse], np.where(known, logs[place] if len(keys) else 0.0, 0.0)[inverse]
                tokens = np.bincount(rows_, minlength=m) + 1
                n_known = np.bincount(rows_, k, minlength=m).astype(np.int64) + (ends > 0)
                base = np.bincount(rows_, value, minlength=m) + math.log10(ends + 1)
                rare, rare_row = h[inverse[~k]].view(np.int64), rows_[~k]
                cuts = np.searchsorted(rare_row, np.arange(m + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(rare))
                yield pa.RecordBatch.from_arrays([pa.array(part + at + np.arange(m)), b.column(0)[first:end], b.column(2)[first:end], pa.array(tokens), pa.array(n_known), pa.array(base), pa.array(lm), lists], ["rk", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"])
                at += m

    scored = scratch.write(rows.select("doc_id", "ids", "held_out").mapInArrow(run, "rk bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, rare array<bigint>"), "scored")
    scratch.drop(rows)
    rare = scored.select("rk", F.explode("rare").alias("key")).join(counts.filter("kind = 0").select("key", "n"), "key")
    more = rare.groupBy("rk").agg(F.count("*").alias("k"), F.sum(F.log10(F.col("n") + F.lit(1.0))).alias("s"))
    both = scored.drop("rare").join(more, "rk", "left")
    lost = math.log10(n + v + 1)
    return both.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"), (F.col("base") + F.coalesce("s", F.lit(0.0)) - F.col("n_tokens") * F.lit(lost)).alias("base_score"), "score")
