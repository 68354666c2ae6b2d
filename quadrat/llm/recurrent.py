"""Language-model scoring with a gated recurrent network in numpy.

Shards: documents are dealt by a hash of doc_id and text into shards of about ``SHARD_BYTES`` of text, and
sorted in them by another, so what a shard holds does not depend on how the table is partitioned. Each shard is split into
words once, all of its texts together, and kept as places in its own table of distinct words, with their counts.

Counting: the shards' counts over all training documents are summed by a shuffle. A shard is sent back the
totals that differ from its own, but for the commonest words, ``BROADCAST`` at most, which go to every task.
The ``FREQUENT`` commonest words form equal classes by frequency; all other words fall into
``RARE_CLASSES`` classes by their ending, inside which a word has its smoothed unigram share, so every
word, seen or not, has a probability. The end is a class of its own. The output softmax is factored:
class first, then the word within its class.

Training: every shard trains its own copy from the common start (the unigram model) on all of its training
documents, by truncated backpropagation through windows of ``WINDOW`` steps with the state carried from
window to window; parameters are averaged, weighted by tokens, in the order of shards.

Scoring: the documents of a shard are packed into lanes, state carried across windows from the first word of a
document to its end.

Defined cases: a null text is empty (the end alone); a null doc_id is a training document; repeated
rows are scored each and count each (rows equal in doc_id and text share a shard, which is written in parts of ``PART_BYTES``); texts are read whole in windows; without training documents every
count is 0 and all words share one rare mass; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.shared import small_batches, staged
from quadrat.llm.simhash import LOWER

FREQUENT, CLASS_WORDS, RARE_CLASSES, HIDDEN = 1024, 64, 32, 24
CLASSES = FREQUENT // CLASS_WORDS
END_CLASS = CLASSES + RARE_CLASSES
INPUTS = FREQUENT + RARE_CLASSES + 1
WINDOW, LANES, SCORE_LANES, RATE = 16, 512, 256, 0.02
LEAST_STEPS = 256
#: Bytes of text in a shard, as dealt, and at which a shard goes on in another part; most shards a partition is made for.
SHARD_BYTES, PART_BYTES, MOST_PARTITIONS = 1 << 24, 1 << 26, 100_000
BROADCAST = 1 << 18
#: Steps whose scores are computed at a time.
BLOCK = 1024
REAL = np.float32
PART = 1000
SHAPES = {"G": (INPUTS, 3 * HIDDEN), "U": (HIDDEN, 3 * HIDDEN), "Wc": (HIDDEN, END_CLASS + 1), "bc": (END_CLASS + 1,), "Ww": (CLASSES, HIDDEN, CLASS_WORDS), "bw": (CLASSES, CLASS_WORDS)}


def tokens(text: str | bytes | None) -> list[bytes]:
    plain = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    return plain.translate(LOWER).split()


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts as ``tokens`` gives them, one after another, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    # white space at either end of a text leaves an empty word
    full = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return words.filter(full), np.diff(before[offsets])


def as_bytes(words: pa.Array) -> list[bytes]:
    """The words as bytes, valid UTF-8 or not."""
    data, wide = words.buffers()[2], pa.types.is_large_string(words.type)
    ends = np.frombuffer(words.buffers()[1], np.int64 if wide else np.int32)[words.offset : words.offset + len(words) + 1].tolist()
    data = data.to_pybytes() if data else b""
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def word_keys(words: list[bytes]) -> np.ndarray:
    """Of each word 59 hash bits and, in the low five, the rare class (by the word's last two bytes), as signed longs."""
    import xxhash

    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    sizes = np.fromiter(map(len, words), np.int64, n)
    last = np.cumsum(sizes) - 1
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
    ends = flat[last] * np.uint64(7) + np.where(sizes > 1, flat[np.maximum(last - 1, 0)], np.uint64(0))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    return ((hashes & ~np.uint64(RARE_CLASSES - 1)) | (ends % np.uint64(RARE_CLASSES))).view(np.int64)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def shards(docs: DataFrame, n: int) -> DataFrame:
    """unit, doc_ids, held, sizes (words of each document), places (of all words), keys and counts (of training words) of each part of a shard."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("shard"), F.xxhash64("doc_id", "text", F.lit(5)).alias("h"))
    dealt = rows.repartitionById(min(n, MOST_PARTITIONS), "shard").sortWithinPartitions("shard", "h", "doc_id").drop("h")
    names = ["unit", "doc_ids", "held", "sizes", "places", "keys", "counts"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, now = [], 0, (-1, 0)

        def out() -> pa.RecordBatch:
            ids, held, sizes, words = zip(*rows)
            rows.clear()
            ids, held, sizes = pa.concat_arrays(ids), pa.concat_arrays(held), np.concatenate(sizes)
            coded = pa.chunked_array(words).dictionary_encode()
            places = np.concatenate([c.indices.to_numpy() for c in coded.chunks])
            table = as_bytes(coded.chunk(0).dictionary)
            seen = np.bincount(places[~np.repeat(held.to_numpy(zero_copy_only=False), sizes)], minlength=len(table))
            pack = lambda x, t: pa.array([x.astype(t).tobytes()], pa.binary())
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            cols = [pa.array([now[0] << 20 | now[1]], pa.int64()), one(ids), one(held), pack(sizes, np.int32), pack(places, np.int32), pack(word_keys(table), np.int64), pack(seen, np.int64)]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            words, sizes = split(batch.column(1))
            ends, begin = np.concatenate([[0], np.cumsum(sizes)]), 0

            def cut(i: int, j: int) -> None:
                if i < j:
                    rows.append((batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), sizes[i:j], words.slice(ends[i], ends[j] - ends[i])))  # noqa: B023

            for i, (shard, n) in enumerate(zip(batch.column(3).to_pylist(), pc.binary_length(batch.column(1)).to_pylist())):
                if now[0] >= 0 and (shard != now[0] or size > PART_BYTES):
                    cut(begin, i)
                    yield out()
                    begin, size, now = i, 0, (shard, now[1] + 1 if shard == now[0] else 0)
                now = (shard, now[1] if shard == now[0] else 0)
                size += n or 0
            cut(begin, batch.num_rows)
        if rows:
            yield out()

    return dealt.select("doc_id", "text", "held", "shard").mapInArrow(work, f"unit long, doc_ids array<{kind}>, held array<boolean>, sizes binary, places binary, keys binary, counts binary")


def words_of(units: DataFrame) -> DataFrame:
    """(unit, key, c) of every distinct word of a part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, keys, counts in zip(*[c.to_pylist() for c in batch.columns]):
                k, c = np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64)
                for at in range(0, len(k), 100_000):
                    some = k[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), unit)), pa.array(some), pa.array(c[at : at + 100_000])], names=["unit", "key", "c"])

    return units.select("unit", "keys", "counts").mapInArrow(work, "unit long, key long, c long")


class Lexicon:
    """What the network and the base score know of the corpus; of bounded size."""

    def __init__(self, frequent: list[tuple[int, int]], rare: list[float], total: int, kinds: int, n_docs: int):
        keys = np.array([k for k, _ in frequent], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.count = np.array([c for _, c in frequent], float)
        self.rare = np.array(rare)
        self.n, self.v, self.n_docs = total, kinds, n_docs
        self.base_floor = math.log10(total + 0.1 * (kinds + 1))

    def start(self) -> dict[str, np.ndarray]:
        rng = np.random.default_rng(11)
        p = {name: rng.normal(0, 0.1, shape) for name, shape in SHAPES.items()}
        freq = np.full(FREQUENT, -30.0)
        freq[: len(self.count)] = np.log(self.count)
        inside = np.exp(freq).reshape(CLASSES, -1).sum(1)
        p["bw"] = freq.reshape(CLASSES, CLASS_WORDS) - np.log(inside)[:, None]
        mass = np.concatenate([inside, self.rare, [self.n_docs + 0.1]])
        p["bc"] = np.log(mass / mass.sum() + 1e-30)
        p["Ww"] *= 0.3
        p["Wc"] *= 0.3
        return p


def lexicon(counts: DataFrame, n_docs: int) -> Lexicon:
    counts = counts.where("c > 0")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    top = [(r[0], r[1]) for r in counts.orderBy(F.desc("c"), "key").limit(FREQUENT).collect()]
    rare = np.full(RARE_CLASSES, 0.1)
    for r in counts.groupBy(F.col("key").bitwiseAND(RARE_CLASSES - 1).alias("r")).agg(F.sum("c").alias("s"), F.count("*").alias("n")).collect():
        rare[r["r"]] += r["s"] + 0.1 * r["n"]
    for k, c in top:
        rare[k & (RARE_CLASSES - 1)] -= c + 0.1
    return Lexicon(top, list(np.maximum(rare, 0.1)), (total["n"] or 0) + n_docs, total["v"] + (n_docs > 0), n_docs)


def commonest(counts: DataFrame) -> DataFrame:
    """(key, c) of the commonest words, BROADCAST at most: all of the grades (256 to a doubling of the count) that fit."""
    graded = counts.where("c > 0").select("key", "c", F.floor(F.log2("c") * 256).cast("int").alias("g"))
    # a few thousand grades
    tally = graded.groupBy("g").agg(F.count("*").alias("n")).collect()
    size, least = 0, 1 << 20
    for r in sorted(tally, key=lambda r: -r["g"]):
        size += r["n"]
        if size > BROADCAST:
            break
        least = r["g"]
    return graded.where(F.col("g") >= least).select("key", "c")


def lanes(lengths: np.ndarray, n: int) -> list[list[int]]:
    """Documents dealt to lanes, the longest first, each to the shortest lane."""
    heap = [(0, k) for k in range(n)]
    out: list[list[int]] = [[] for _ in range(n)]
    for i in np.argsort(-lengths, kind="stable"):
        size, k = heapq.heappop(heap)
        out[k].append(int(i))
        heapq.heappush(heap, (size + int(lengths[i]), k))
    return [x for x in out if x]


def pack(lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lane matrices (step, lane), the longest lane first: document number (-1: none), place in the flat array of all steps, first step of a document."""
    dealt = sorted(lanes(lengths, min(n, len(lengths))), key=lambda lane: -int(lengths[lane].sum()))
    width = int(lengths[dealt[0]].sum())
    starts = np.cumsum(lengths) - lengths
    owner, place, first = np.full((width, len(dealt)), -1, np.int32), np.zeros((width, len(dealt)), np.int32), np.zeros((width, len(dealt)), bool)
    for k, lane in enumerate(dealt):
        m = lengths[lane]
        before, size = np.cumsum(m) - m, int(m.sum())
        owner[:size, k] = np.repeat(lane, m)
        place[:size, k] = np.arange(size) - np.repeat(before, m) + np.repeat(starts[lane], m)
        first[before, k] = True
    return owner, place, first


def by_gate(x: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Columns of the gates z, r and the candidate c as (c, z, r; row, hidden): what a step computes lies together for each."""
    return np.ascontiguousarray(x.reshape(len(x), 3, HIDDEN).transpose(1, 0, 2)[[2, 0, 1]], kind)


def forward(p: dict, rows: np.ndarray, first: np.ndarray, h: np.ndarray, keep: bool = False):
    """States (step, lane, hidden) of one window; rows (of G) and first are (step, lane). Gates take half of their argument's scale.

    With ``keep``, also the state before each step, and (step, 5, lane, hidden): (1 - c^2) (1 - z), the gates z and r,
    r (1 - r) times the candidate's recurrent part, and z (1 - z) (h - c).
    """
    steps, n = rows.shape
    G, U = by_gate(p["G"], h.dtype), by_gate(p["U"], h.dtype)
    hs, u, fresh = np.empty((steps, n, HIDDEN), h.dtype), np.empty((3, n, HIDDEN), h.dtype), first.any(1)
    kept, befores = np.empty((steps if keep else 1, 5, n, HIDDEN), h.dtype), np.empty((steps if keep else 1, n, HIDDEN), h.dtype)
    for t in range(steps):
        now, before = kept[t if keep else 0], befores[t if keep else 0]
        before[...] = h
        if fresh[t]:
            before[first[t]] = 0
        np.take(G, rows[t], axis=1, out=now[:3], mode="clip")
        np.matmul(before, U, out=u)
        (c, z, r, to_r, to_z), zr, h = now, now[1:3], hs[t]
        zr += u[1:]
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        np.multiply(r, u[0], out=to_r)
        c += to_r
        np.tanh(c, out=c)
        np.subtract(before, c, out=h)
        h *= z
        if keep:
            np.subtract(1, now[1:3], out=u[1:])
            np.multiply(h, u[1], out=to_z)
            to_r *= u[2]
        h += c
        if keep:
            c *= c
            np.subtract(1, c, out=c)
            c *= u[1]
    return hs, h, (befores, kept)


def softmax(w: np.ndarray, b: np.ndarray, h: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """exp of the scores (output, step) of states h, shifted by their maximum where that is needed to keep the sums finite; the sums; flat places of outputs k; their ln P."""
    at = k.astype(np.intp)
    at *= len(k)
    at += np.arange(len(k))
    for shift in (False, True):
        x = w.T @ h.T
        x += b[:, None]
        if shift:
            x -= x.max(0)
        own = x.ravel()[at]
        with np.errstate(over="ignore"):
            np.exp(x, out=x)
        total = x.sum(0)
        if total.min() > 1e-30 and total.max() < np.inf:
            break
    return x, total, at, own - np.log(total)


def blocks(n: int) -> list[slice]:
    """BLOCK steps at a time, so that their scores stay in a core's cache."""
    return [slice(at, min(at + BLOCK, n)) for at in range(0, n, BLOCK)]


def by_class(out_class: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """Steps in the order of their targets' classes; where those of each class of frequent words stand there."""
    order = np.argsort(out_class.astype(np.uint8), kind="stable")
    cut = np.searchsorted(out_class[order], np.arange(CLASSES + 1))
    return order, [(k, slice(cut[k], cut[k + 1])) for k in range(CLASSES) if cut[k] < cut[k + 1]]


def word_log_probability(p: dict, h: np.ndarray, out_class: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """ln P of class and, for frequent words, of the word in its class."""
    order, parts = by_class(out_class)
    h, oc, sl = h.take(order, axis=0), out_class[order], slot[order]
    lp = np.empty(len(h), np.result_type(h, p["Wc"]))
    for s in blocks(len(h)):
        lp[s] = softmax(p["Wc"], p["bc"], h[s], oc[s])[3]
    for k, s in parts:
        lp[s] += softmax(p["Ww"][k], p["bw"][k], h[s], sl[s])[3]
    out = np.empty_like(lp)
    out[order] = lp
    return out


def gradients(p: dict, rows, first, out_class, slot, live, h0):
    """Mean loss, gradients and last state of one window (arrays are (step, lane)), by backpropagation inside it."""
    steps, n = rows.shape
    hs, last, (befores, kept) = forward(p, rows, first, h0, keep=True)
    w = live.ravel().astype(REAL)
    total = max(1.0, w.sum())
    order, parts = by_class(out_class.ravel())
    h, oc, sl, share = hs.reshape(-1, HIDDEN).take(order, axis=0), out_class.ravel()[order], slot.ravel()[order], w[order] / REAL(total)
    g = {k: np.zeros(s, REAL) for k, s in SHAPES.items()}
    loss, dh = 0.0, np.empty_like(h)

    def back(weights: np.ndarray, bias: np.ndarray, s: slice, k: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of steps s, summed -ln P of outputs k, and the gradients of weights, bias and states."""
        d, sums, at, lp = softmax(weights, bias, h[s], k[s])
        d *= share[s] / sums
        d.ravel()[at] -= share[s]
        return -(lp * share[s]).sum(), h[s].T @ d.T, d.sum(1), d.T @ weights.T

    for s in blocks(len(h)):
        x, to_w, to_b, dh[s] = back(p["Wc"], p["bc"], s, oc)
        g["Wc"] += to_w
        g["bc"] += to_b
        loss += x
    for k, s in parts:
        x, g["Ww"][k], g["bw"][k], more = back(p["Ww"][k], p["bw"][k], s, sl)
        dh[s] += more
        loss += x
    spot = np.empty(len(order), np.intp)
    spot[order] = np.arange(len(order))
    dh_out = dh.take(spot, axis=0).reshape(steps, n, HIDDEN)
    # the gates' argument is halved, so their slope is twice s (1 - s)
    twice = np.array([1, 2, 2], REAL)[:, None, None]
    dh, fresh = np.zeros((n, HIDDEN), REAL), first.any(1)
    ups, turn = np.empty((3, n, HIDDEN), REAL), np.ascontiguousarray((by_gate(p["U"], REAL) * twice)[[0, 2, 1]].transpose(0, 2, 1))
    for t in range(steps - 1, -1, -1):
        dh += dh_out[t]
        # in place: what was kept turns into the gradients of c, of its recurrent part, of r and of z
        c, z, r, to_r, to_z = kept[t]
        c *= dh
        to_z *= dh
        to_r *= c
        r *= c
        dh *= z
        for up in np.matmul(kept[t, 2:], turn, out=ups):
            dh += up
        if fresh[t]:
            dh[first[t]] = 0
    u = np.matmul(befores.transpose(0, 2, 1)[:, None], kept[:, 2:]).sum(0)
    g["U"] = np.concatenate([2 * u[2], 2 * u[1], u[0]], axis=1)
    flat_rows = rows.ravel()
    order = np.argsort(flat_rows.astype(np.uint16), kind="stable")
    ranked = flat_rows[order]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(ranked)) + 1])
    place = order + order // n * (4 * n)
    for k, (gate, scale) in enumerate(((4, 2), (3, 2), (0, 1))):
        some = kept.reshape(-1, HIDDEN).take(place + gate * n, axis=0)
        # sums two numbers at a time, as complex ones
        sums = np.add.reduceat(some.view(np.result_type(REAL, np.complex64)), starts, axis=0).view(REAL)
        g["G"][ranked[starts], k * HIDDEN : (k + 1) * HIDDEN] = sums * REAL(scale)
    return loss, g, last


def train(p: dict, rows: np.ndarray, first: np.ndarray, out_class: np.ndarray, slot: np.ndarray) -> dict:
    """One pass over a stream of steps (input row; whether a document begins; class and slot of the target) with Adam.

    The stream is cut into lanes of equal length, fewer where that leaves under ``LEAST_STEPS`` windows; state is carried along a lane and is zero where a document begins.
    """
    p = {k: v.astype(REAL) for k, v in p.items()}
    n = max(1, min(LANES, max(8, len(rows) // (WINDOW * LEAST_STEPS)), len(rows) // WINDOW))
    width = -(-len(rows) // n)
    pad = n * width - len(rows)
    lay = lambda x, fill: np.ascontiguousarray(np.concatenate([x, np.full(pad, fill, x.dtype)]).reshape(n, width).T)
    live = lay(np.ones(len(rows), bool), False)
    rows, first, out_class, slot = lay(rows, 0), lay(first, False), lay(out_class, END_CLASS), lay(slot, 0)
    m, v, step = {k: np.zeros(s, REAL) for k, s in SHAPES.items()}, {k: np.zeros(s, REAL) for k, s in SHAPES.items()}, 0
    h = np.zeros((n, HIDDEN), REAL)
    for at in range(0, width, WINDOW):
        w = slice(at, at + WINDOW)
        _, g, h = gradients(p, rows[w], first[w], out_class[w], slot[w], live[w], h)
        norm = math.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale, step = REAL(min(1.0, 1.0 / (norm + 1e-12))), step + 1
        rate, fix = REAL(RATE / (1 - 0.9**step)), REAL(1 / (1 - 0.99**step))
        for k in SHAPES:
            x = g[k]
            x *= scale
            m[k] *= REAL(0.9)
            m[k] += REAL(0.1) * x
            x *= x
            v[k] *= REAL(0.99)
            v[k] += REAL(0.01) * x
            np.multiply(v[k], fix, out=x)
            np.sqrt(x, out=x)
            x += REAL(1e-6)
            np.divide(m[k], x, out=x)
            x *= rate
            p[k] -= x
    return p


def flatten(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def unflatten(x: np.ndarray) -> dict:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k], at = x[at : at + n].reshape(s), at + n
    return out


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of ``keys`` in a sorted array, whether they are there)."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def codes(keys: np.ndarray, lex: Lexicon) -> np.ndarray:
    """Input row, output class and slot of each key."""
    at, common = find(lex.keys, keys)
    row = lex.order[at] if len(lex.order) else at
    rare = keys & (RARE_CLASSES - 1)
    return np.stack([np.where(common, row, FREQUENT + rare), np.where(common, row // CLASS_WORDS, CLASSES + rare), np.where(common, row % CLASS_WORDS, 0)], axis=1).astype(np.int32)


def unigrams(keys: np.ndarray, lex: Lexicon, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base log10 probability, log10 share in its rare class or 0, whether trained on) of each key, from its count."""
    _, common = find(lex.keys, keys)
    base = np.log10(counts + 0.1)
    return base - lex.base_floor, np.where(common, 0.0, base - np.log10(lex.rare[keys & (RARE_CLASSES - 1)])), counts > 0


class Part:
    """The documents of a part of a shard as arrays."""

    def __init__(self, held: list[bool], sizes: bytes, places: bytes, keys: bytes):
        self.held, self.sizes = np.array(held, bool), np.frombuffer(sizes, np.int32).astype(np.int64)
        self.places, self.keys = np.frombuffer(places, np.int32), np.frombuffer(keys, np.int64)

    def steps(self, lex: Lexicon, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(input row; whether a document begins; class and slot of the target) of each step of documents ``docs`` (a mask): words, then the end."""
        # one or two bytes a step and number
        row, kind_, slot_ = (c.astype(t) for c, t in zip(codes(self.keys, lex).T, (np.uint16, np.uint8, np.uint8)))
        sizes = self.sizes[docs]
        places = self.places if docs.all() else self.places[np.repeat(docs, self.sizes)]
        last = np.cumsum(sizes + 1) - 1
        n = len(places) + len(sizes)
        first, is_word = np.zeros(n, bool), np.ones(n, bool)
        first[last - sizes], is_word[last] = True, False
        rows, kind, slot = np.empty(n, np.uint16), np.full(n, END_CLASS, np.uint8), np.zeros(n, np.uint8)
        kind[is_word], slot[is_word] = kind_[places], slot_[places]
        rows[~first], rows[first] = row[places], INPUTS - 1
        return rows, first, kind, slot


def fit_network(units: DataFrame, lex: Lexicon) -> dict:
    """Train in every part of a shard on its training documents; average the parameters by tokens."""
    start = lex.start()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                unit, *row = [c[i].as_py() for c in batch.columns]
                part = Part(*row)
                if part.held.all():
                    continue
                steps = part.steps(lex, ~part.held)
                seen = float(len(steps[0]))
                x = flatten(train(start, *steps)).astype(float) * seen
                k = range(0, len(x), PART)
                yield pa.RecordBatch.from_arrays([pa.array([a // PART for a in k], pa.int32()), pa.array([unit] * len(k), pa.int64()), pa.array([seen] * len(k)), pa.array([x[a : a + PART] for a in k], pa.list_(pa.float64()))], names=["block", "unit", "w", "x"])

    def total(t: pa.Table) -> pa.Table:
        t = t.sort_by("unit")
        x = np.cumsum(np.array(t.column("x").to_pylist()), axis=0)[-1]
        return pa.table([t.column("block").slice(0, 1), t.column("unit").slice(0, 1), pa.array([float(np.cumsum(t.column("w").to_numpy())[-1])]), pa.array([x], pa.list_(pa.float64()))], names=["block", "unit", "w", "x"])

    schema = "block int, unit long, w double, x array<double>"
    trained = units.select("unit", "held", "sizes", "places", "keys").mapInArrow(work, schema)
    # hundreds are summed at a time, so a sum holds a bounded number of vectors for up to a hundred thousand shards
    parts = trained.groupBy("block", F.shiftright("unit", 28)).applyInArrow(lambda t: total(t), schema).groupBy("block").applyInArrow(lambda t: total(t), schema)
    # as many rows as the network has blocks of parameters
    rows = sorted(parts.collect(), key=lambda r: r["block"])
    return unflatten(np.concatenate([np.array(r["x"]) / r["w"] for r in rows])) if rows else start


def score_part(p: dict, lex: Lexicon, part: Part, totals: np.ndarray) -> list[np.ndarray]:
    """n_tokens, n_known, base score and score of each document; ``totals`` are the words' counts in all training documents."""
    n = len(part.sizes)
    owner = np.repeat(np.arange(n), part.sizes)
    base, inside, known = unigrams(part.keys, lex, totals)
    sums = lambda x: np.bincount(owner, x[part.places].astype(float), n)
    rows, _, kind, slot = part.steps(lex, np.ones(n, bool))
    end_base = math.log10(lex.n_docs + 0.1) - lex.base_floor
    lp = np.zeros(n)
    who, place, first = pack(part.sizes + 1, SCORE_LANES)
    h = np.zeros((who.shape[1], HIDDEN), np.float32)
    ends = (who >= 0).sum(0)
    for at in range(0, len(who), 2 * WINDOW):
        k = int((ends > at).sum())
        w = slice(at, at + 2 * WINDOW)
        hs, h, _ = forward(p, rows[place[w, :k]], first[w, :k], h[:k])
        own = who[w, :k].ravel()
        live = own >= 0
        spot = place[w, :k].ravel()[live]
        got = word_log_probability(p, hs.reshape(-1, HIDDEN)[live], kind[spot], slot[spot])
        lp += np.bincount(own[live], got.astype(float), n)
    return [part.sizes + 1, sums(known).astype(np.int64) + (lex.n_docs > 0), sums(base) + end_base, lp / math.log(10) + sums(inside)]


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    n_shards = max(1, math.ceil((docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) / SHARD_BYTES))
    with small_batches(spark):
        units = staged(shards(docs, n_shards), "shards")
    words = words_of(units).repartition("key")
    counts = staged(words.groupBy("key").agg(F.sum("c").alias("c"), F.count("*").alias("parts")), "word-counts")
    n_docs = docs.where(~held_out(F.col("doc_id"))).select("doc_id").count()
    lex = lexicon(counts, n_docs)
    network = fit_network(units, lex)
    common = commonest(counts.where("parts > 1")).toPandas().sort_values("key")
    known = spark.sparkContext.broadcast((lex, {k: v.astype(np.float32) for k, v in network.items()}, common["key"].to_numpy(), common["c"].to_numpy()))
    few = spark.createDataFrame(common[["key"]], "key long") if len(common) else None
    # what a part cannot know by itself: totals of words that others have too
    others = counts.where("parts > 1").select("key", F.col("c").alias("total"))
    others = others.join(F.broadcast(few), "key", "left_anti") if few is not None else others
    fetched = words.join(others, "key").where("c != total").select("unit", "key", "total")

    def packed(t: pa.Table) -> pa.Table:
        keys, values = sorted_pairs(t)
        return pa.table([t.column("unit").slice(0, 1), pa.array([keys.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=["unit", "keys", "counts"])

    # a part of a shard holds a bounded number of words; its totals come before it
    sent = fetched.groupBy("unit").applyInArrow(packed, "unit long, keys binary, counts binary")
    both = sent.withColumn("kind", F.lit(0)).unionByName(units.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    names = ["kind", "unit", "doc_ids", "held", "sizes", "places", "keys", "counts"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, p, common_keys, common_counts = known.value
        own = (-1, np.empty(0, np.int64), np.empty(0, np.int64))
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                get = lambda c: row.column(names.index(c))[0]  # noqa: E731, B023
                keys, counts_ = (np.frombuffer(get(c).as_py(), np.int64) for c in ("keys", "counts"))
                if get("kind").as_py() == 0:
                    own = get("unit").as_py(), keys, counts_
                    continue
                part = Part(*[get(c).as_py() for c in ("held", "sizes", "places", "keys")])
                totals = counts_.copy()
                for k, values in ((common_keys, common_counts), own[1:] if own[0] == get("unit").as_py() else ((), ())):
                    at, there = find(k, part.keys)
                    totals[there] = values[at[there]] if len(values) else 0
                cols = score_part(p, lex, part, totals)
                yield pa.RecordBatch.from_arrays([get("doc_ids").values, pa.array(part.held), *map(pa.array, cols)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    dealt = both.withColumn("shard", F.shiftright("unit", 20).cast("int")).repartitionById(min(n_shards, MOST_PARTITIONS), "shard").sortWithinPartitions("unit", "kind")
    scored = dealt.select(*names).mapInArrow(work, schema)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(lex.n).cast("long").alias("train_tokens"), "base_score", "score")


def sorted_pairs(words: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, values = words.column("key").to_numpy(), words.column("total").to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]
