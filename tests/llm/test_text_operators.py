"""Pieces, quality rules, SimHash, lines, language model and mixing against plain versions, with the hard cases."""

import collections
import hashlib
import math
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quadrat.llm import lines, mixing, pieces, quality, recurrent, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, kept int"


def docs_of(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "w", 1) for i, t in zip(ids, texts)], SCHEMA)


def vocabulary(seed=1, n=300):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n)]


def prose(r, words, n):
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Prose with nulls, empty, very long and repeated texts, near copies, and a null and a repeated doc_id."""
    r, words = random.Random(5), vocabulary()
    texts = ["\n".join(prose(r, words, r.randint(8, 60)) for _ in range(r.randint(1, 6))) for _ in range(60)]
    texts += [None, "", " \t\n ", "x", prose(r, words, 20000), texts[0], texts[0], texts[1].replace(" ", "  ", 1), texts[2][:-1] + "!", "Ünï çødé\n" * 3]
    ids = list(range(len(texts)))
    texts, ids = texts + [texts[3], texts[3]], ids + [None, 3]
    return texts, ids, docs_of(spark, texts, ids).repartition(3)


# --- pieces


def test_pieces_equal_the_library(corpus):
    texts, ids, docs = corpus
    sp = pieces.codec(pieces.default_model()).sp
    extra = ["  a", "a  ", " ", "\n\n b", "▁a ▁", "a\x00b", "\r\n x", "<s> </s> <0x0A>", "ﬁ 　 日本 𝕏", "a" * 700, " " * 300]
    r = random.Random(2)
    extra += ["".join(r.choice(" \n▁abé日𝕏\t<>x0.") for _ in range(r.randint(1, 25))) for _ in range(800)]
    for t in [*texts, *extra]:
        want = [*sp.encode(t or ""), sp.eos_id()]
        n, as_text, decoded = pieces.codec(pieces.default_model()).run(t)
        assert (n, as_text.decode(), decoded.decode()) == (len(want), " ".join(map(str, want)), sp.decode(want))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.encode(docs, digests=True).collect())
    want = []
    for t, i in zip(texts, ids):
        x = [*sp.encode(t or ""), sp.eos_id()]
        want.append((i is None, i or 0, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(sp.decode(x).encode()).hexdigest()))
    assert got == sorted(want)


def test_piece_tables_stay_bounded_and_round_trip(spark, corpus, monkeypatch):
    texts, _, docs = corpus
    c = pieces.PieceCodec(pieces.default_model())
    monkeypatch.setattr(pieces, "TABLE_CHUNKS", 10)
    for t in texts:
        c.run(t)
    assert len(c.marked) <= 10
    back = pieces.decode(pieces.encode(docs.where("doc_id < 60"))).collect()
    assert {r.doc_id: r.text for r in back if r.doc_id != 3} == {i: texts[i] for i in range(60) if i != 3}
    tokens = pieces.token_documents(docs)
    assert tokens.columns == [*docs.columns, "ids", "n_tokens"] and tokens.count() == docs.count()


# --- quality rules


def plain_quality(t):
    words = (t or "").encode().split()
    w = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    c = collections.Counter(w)
    covered = {i + k for i, g in enumerate(w) if c[g] > 1 for k in range(3)}
    ls = [x for x in (t or "").split("\n") if x.encode().split()]
    return len(words), sum(len(x.decode()) for x in words), sum(ch in "#*$%&|<>" for ch in t or ""), len(ls) - len(set(ls)), len(covered)


def test_cascade_counts_and_verdicts(corpus):
    texts, ids, docs = corpus
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    order = [n for n, _ in quality.RULES]
    rows = quality.annotate(docs, names, order=order).collect()
    want = collections.Counter((i, *plain_quality(t)) for t, i in zip(texts, ids))
    assert collections.Counter((r.doc_id, *[r[n] for n in names]) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    back = quality.annotate(docs, names, order=order[::-1]).collect()
    assert sorted(map(str, ((r.doc_id, r.kept) for r in rows))) == sorted(map(str, ((r.doc_id, r.kept) for r in back)))


def test_cascade_prefers_cheap_rejecting_rules():
    def slow(f):
        return sum(i for i in range(20000)) < 0

    order = quality.cascade_order(["abc def"] * 20, [("slow", slow), ("cheap", lambda f: True), ("useless", lambda f: False)])
    assert order[0] == "cheap" and order[-1] == "slow"


def test_quality_filter_keeps_columns(spark, corpus):
    _, _, docs = corpus
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert quality.keep(docs.limit(0)).count() == 0 and quality.annotate(docs.limit(0)).count() == 0
    junk = docs_of(spark, ["word### " * 80, " ".join(vocabulary()) + " end."])
    assert [r.doc_id for r in quality.keep(junk).collect()] == [1]


# --- SimHash


def plain_fingerprint(t):
    import xxhash

    w = (t or "").encode().translate(simhash.LOWER).split()
    g = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(x, seed=42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_classes(fps, radius=3):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_simhash_classes_equal_brute_force(corpus):
    texts, ids, docs = corpus
    fps = [plain_fingerprint(t) for t in texts]
    group = plain_classes(fps)
    least = {}
    for i, g in zip(ids, group):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = collections.Counter((i, f"{f:016x}", least.get(g)) for i, f, g in zip(ids, fps, group))
    assert collections.Counter(map(tuple, simhash.classes_report(docs).collect())) == want
    assert simhash.classes_report(docs.limit(0)).count() == 0


def test_ball_hashing_finds_every_pair(spark):
    r = random.Random(3)
    fps = []
    for _ in range(40):
        f = r.getrandbits(64)
        fps.append(f)
        for d in range(1, 6):
            fps.append(f ^ sum(1 << b for b in r.sample(range(64), d)))
    for b in range(12):
        fps.append(fps[0] ^ (0b111 << b))
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = [(a & (2**64 - 1), b & (2**64 - 1)) for a, b in map(tuple, simhash.links(df).collect())]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in links)
    at = {f: i for i, f in enumerate(fps)}
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = find(at[a]), find(at[b])
        parent[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(fps))] == plain_classes(fps)


def test_simhash_keeps_one_of_each_class(spark, corpus):
    texts, ids, docs = corpus
    left = simhash.deduplicate(docs)
    assert left.columns == docs.columns
    kept = collections.Counter(r.doc_id for r in left.collect())
    want = {r.doc_id for r in simhash.classes(docs).collect() if r.doc_id is not None and r.doc_id == r.component_id}
    assert {k: v for k, v in kept.items() if k is not None} == {k: 1 for k in want}


# --- lines


def edits(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j - 1] + (x != y), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return prev[-1]


def test_banded_automaton_equals_edit_distance(spark):
    r = random.Random(9)
    pairs = []
    for _ in range(250):
        a = "".join(r.choice("abcé") for _ in range(r.randint(0, 14)))
        b = list(a)
        for _ in range(r.randint(0, 4)):
            k = r.randint(0, len(b))
            b[k : k + r.randint(0, 1)] = r.choice(["", "x", "a"])
        pairs.append((a, "".join(b)))
    for t in (1, 2, 3):
        got = spark.createDataFrame(pairs, "a string, b string").coalesce(1).select("a", "b", lines.within(F.col("a"), F.col("b"), t).alias("w")).collect()
        for x in got:
            assert x.w == (edits(x.a, x.b) <= t) or not x.a or not x.b, (x.a, x.b, t)


def plain_line_classes(texts, ids):
    """(first place and number of texts of the class) of every line, by comparing all lines."""
    first = {}
    for i, t in zip(ids, texts):
        for p, x in enumerate((t or "").split("\n")):
            if x.strip(" "):
                first.setdefault(x, (i, p))
    ks = sorted(first, key=first.get)
    root = {x: x for x in ks}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    by_size = collections.defaultdict(list)
    for x in ks:
        by_size[len(x)].append(x)
    for n in by_size:
        for d in (0, 1, 2):
            for a in by_size[n] if n >= 10 else ():
                for b in by_size.get(n + d, ()):
                    if find(a) != find(b) and edits(a, b) <= 2:
                        x, y = sorted((find(a), find(b)), key=first.get)
                        root[y] = x
    size = collections.Counter(map(find, ks))
    return {x: (first[find(x)], size[find(x)]) for x in ks}


def check_lines(docs, texts, ids):
    classes = plain_line_classes(texts, ids)
    got = {x.doc_id: x for x in lines.line_report(docs).collect()}
    assert len(got) == len(texts)
    for i, t in zip(ids, texts):
        ls = (t or "").split("\n")
        late = [(p, classes[x][0][0]) for p, x in enumerate(ls) if x in classes and classes[x][0] != (i, p)]
        assert list(zip(got[i].dropped, got[i].first_docs)) == late
        assert got[i].n_links == sum(classes[x][1] - 1 for x in ls if x in classes) and got[i].n_dropped == len(late)
    return got


def test_lines_equal_brute_force(spark):
    r, words = random.Random(4), vocabulary(2)
    base = [prose(r, words, 12) + " tail." for _ in range(30)] + ["ten chars!", "nine char", "eleven char", "a b"]

    def mutate(s):
        s = list(s)
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(s))
            s[k : k + r.randint(0, 1)] = r.choice(["", "q", "é", "𝄞"])
        return "".join(s)

    texts = ["\n".join(mutate(r.choice(base)) if r.random() < 0.8 else "short" for _ in range(r.randint(1, 5))) for _ in range(60)] + [None, "", "\n\n", base[0], base[0]]
    ids = [i - 20 for i in range(len(texts))]
    docs = docs_of(spark, texts, ids)
    got = check_lines(docs, texts, ids)
    assert sum(x.n_links for x in got.values())
    out = {x.doc_id: x for x in lines.deduplicate_lines(docs).collect()}
    for i, t in zip(ids, texts):
        want = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in got[i].dropped)
        assert out[i].text == want and (t is None or out[i].n_chars == len(want))
    assert lines.deduplicate_lines(docs).columns == docs.columns
    assert lines.line_report(docs.limit(0)).count() == 0


def test_lines_of_crowded_keys_equal_brute_force(spark):
    """Templates whose lines share most segments: some are linked, most are not, and lengths differ."""
    r = random.Random(8)
    head, tail = "the quick brown fox jumps over the lazy dog near ", " and then walks home along the river bank at night."
    texts = [f"{head}{r.randrange(10 ** r.choice((4, 5))):0{r.choice((4, 5))}d}{tail}" for _ in range(150)]
    texts += [f"{head}{''.join(r.choice('abcdefghij') for _ in range(9))}{tail}" for _ in range(60)]
    texts += [f"{r.choice('abcdef') * r.randint(1, 3)}{head}{r.choice('xyz')}{tail}{'.' * r.randint(0, 3)}" for _ in range(60)]
    texts += ["-" * n + r.choice("+*") + "-" * (40 - n) for n in range(0, 40, 3)] + ["-" * n for n in range(30, 45)]
    got = check_lines(docs_of(spark, texts).repartition(3), texts, list(range(len(texts))))
    assert any(x.n_links > 50 for x in got.values()) and any(x.n_links == 0 for x in got.values())


def test_one_key_of_five_thousand_variants(spark):
    """Numbers of six digits in one line: linked where two digits differ at most, told from Hamming distance."""
    r = random.Random(3)
    numbers = r.sample(range(10**6), 5000)
    texts = [f"all of these lines agree in very many characters {n:06d} and go on in the same way" for n in numbers]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    seen = {}
    for i, n in enumerate(numbers):
        s = f"{n:06d}"
        keys = [(a, b, s[:a] + s[a + 1 : b] + s[b + 1 :]) for a in range(6) for b in range(a + 1, 6)]
        # one digit out and another in
        keys += [("d", s[:a] + s[a + 1 :]) for a in range(6)]
        for k in keys:
            a, b = find(i), find(seen.setdefault(k, i))
            root[max(a, b)] = min(a, b)
    got = lines.line_report(docs_of(spark, texts).repartition(4)).collect()
    assert len(got) == 5000
    for x in got:
        assert x.dropped == ([0] if find(x.doc_id) != x.doc_id else [])


def test_long_lines_and_text_ids(spark):
    r = random.Random(6)
    long = prose(r, vocabulary(3), 20000)
    texts = [long, long[:50000] + "x" + long[50000:], long + "yyy", "z" + long[1:]]
    got = {x.doc_id: x for x in lines.line_report(docs_of(spark, texts)).collect()}
    assert [got[i].n_dropped for i in range(4)] == [0, 1, 0, 1]
    with pytest.raises(ValueError):
        lines.line_report(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_lines_with_null_and_repeated_ids(corpus):
    texts, ids, docs = corpus
    rows = lines.line_report(docs).collect()
    assert len(rows) == len(texts)
    again = {(r.doc_id, tuple(r.dropped)) for r in rows if r.doc_id == 3}
    assert len(again) == 1  # the repeated row is the same document
    late = [r for r in rows if r.doc_id is None]
    assert late[0].n_dropped == len(texts[3].split("\n"))  # a null id ranks last


# --- language model


def test_gradients_match_differences():
    import numpy as np

    rng = np.random.default_rng(0)
    real, recurrent.REAL = recurrent.REAL, np.float64
    try:
        p = {k: rng.normal(0, 0.3, s) for k, s in recurrent.SHAPES.items()}
        ids, first = rng.integers(0, recurrent.INPUTS, (5, 3)), np.zeros((5, 3), bool)
        first[0], first[3, 1] = True, True
        oc = rng.integers(0, recurrent.END_CLASS + 1, (5, 3))
        sl = np.where(oc < recurrent.CLASSES, rng.integers(0, recurrent.CLASS_WORDS, (5, 3)), 0)
        live = np.ones((5, 3), bool)
        live[4, 2] = False
        h0 = rng.normal(0, 0.2, (3, recurrent.HIDDEN))
        _, g, _ = recurrent.gradients(p, ids, first, oc, sl, live, h0)
        for k in recurrent.SHAPES:
            for _ in range(6):
                at = tuple(rng.integers(0, s) for s in recurrent.SHAPES[k])
                if k == "G":
                    at = (int(rng.choice(ids.ravel())), at[1])
                old, e = p[k][at], 1e-5
                p[k][at] = old + e
                up = recurrent.gradients(p, ids, first, oc, sl, live, h0)[0]
                p[k][at] = old - e
                down = recurrent.gradients(p, ids, first, oc, sl, live, h0)[0]
                p[k][at] = old
                assert abs((up - down) / (2 * e) - g[k][at]) < 1e-6
    finally:
        recurrent.REAL = real


def part_of(texts, held=None):
    import numpy as np

    words = [recurrent.tokens(t) for t in texts]
    place = {}
    flat = np.array([place.setdefault(w, len(place)) for x in words for w in x], np.int32)
    sizes = np.array([len(x) for x in words], np.int32)
    return recurrent.Part(held or [False] * len(texts), sizes.tobytes(), flat.tobytes(), recurrent.word_keys(list(place)).tobytes()), list(place)


def test_lane_packing_and_windows_do_not_change_scores():
    import numpy as np

    keys = recurrent.word_keys([b"%d" % k for k in range(20)])
    lex = recurrent.Lexicon([(int(k), 50 - i) for i, k in enumerate(keys)], [1.0] * recurrent.RARE_CLASSES, 1000, 60, 10)
    rng = np.random.default_rng(1)
    p = {k: rng.normal(0, 0.3, s) for k, s in recurrent.SHAPES.items()}

    def score(ts):
        part, place = part_of(ts)
        return list(zip(*recurrent.score_part(p, lex, part, np.full(len(place), 5))))

    texts = [" ".join(str(x) for x in rng.integers(0, 20, n)) for n in (0, 1, 5, 40, 200, 3)] + [None]
    together, alone = score(texts), [score([t])[0] for t in texts]
    assert [x[:2] for x in together] == [x[:2] for x in alone] and np.allclose([x[3] for x in together], [x[3] for x in alone], rtol=1e-4)
    # one by one, without windows or lanes
    t, h, total = texts[3].split(), np.zeros((1, recurrent.HIDDEN)), 0.0
    for i, target in zip([recurrent.INPUTS - 1, *[int(w) for w in t]], [*[(0, int(w)) for w in t], (recurrent.END_CLASS, 0)]):
        _, h, _ = recurrent.forward(p, np.array([[i]]), np.array([[False]]), h)
        total += recurrent.word_log_probability(p, h, np.array([target[0]]), np.array([target[1]]))[0]
    assert abs(total / math.log(10) - alone[3][3]) < 1e-3


def test_scores(spark, corpus):
    texts, ids, docs = corpus
    rows = recurrent.score(docs).collect()
    train = [t for t, i in zip(texts, ids) if i is None or zlib.crc32(str(i).encode()) % 10]
    c = collections.Counter(w for t in train for w in recurrent.tokens(t))
    n, v = sum(c.values()) + len(train), len(c) + 1
    assert len(rows) == len(texts) and all(r.train_tokens == n for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for t, i in zip(texts, ids):
        ws = recurrent.tokens(t)
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws) + math.log10((len(train) + 0.1) / (n + 0.1 * (v + 1)))
        hit = [r for r in by[i] if r.n_tokens == len(ws) + 1]
        assert hit and abs(hit[0].base_score - base) < 1e-6 * max(1, abs(base)) and hit[0].n_known == 1 + sum(w in c for w in ws) and hit[0].score < 0
        assert hit[0].held_out == (i is not None and zlib.crc32(str(i).encode()) % 10 == 0)
    assert recurrent.score(docs.limit(0)).count() == 0


def test_words_of_many_texts_at_once_equal_those_of_each():
    import time

    import pyarrow as pa

    texts = ["  a  B\n", None, "", "\x0b\x0c", " \x1c \x85\u00a0 x", "Ünï ÇØdé İ\r\n", "a\x00b \x00", "x" * 1000, "last\t"]
    raw = pa.array([*[t and t.encode() for t in texts], b"\xff\xfe A \xc3", b" \xed\xa0\x80 Q "], pa.binary())
    column = pa.Array.from_buffers(pa.string(), len(raw), raw.buffers())
    for some in (column, column[3:], column[1:4], column[:0]):
        words, sizes = recurrent.split(some)
        want = [recurrent.tokens(t) for t in some.cast(pa.binary()).to_pylist()]
        assert recurrent.as_bytes(words) == [w for x in want for w in x] and sizes.tolist() == [len(x) for x in want]
    r, spoken = random.Random(3), vocabulary(7, 3000)
    texts = [prose(r, spoken, 500) for _ in range(200)]

    def seconds(f):
        out = []
        for _ in range(5):
            t = time.thread_time()
            f()
            out.append(time.thread_time() - t)
        return min(out)

    def one_by_one():
        place = {}
        return [[place.setdefault(w, len(place)) for w in recurrent.tokens(t)] for t in texts]

    column = pa.array(texts)
    assert seconds(lambda: recurrent.split(column)[0].dictionary_encode()) < seconds(one_by_one)


def test_large_shards_are_written_in_parts(spark):
    import numpy as np

    n = recurrent.PART_BYTES * 4 // 10
    docs = spark.range(5).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("A b "), F.repeat(F.lit("x"), n)).alias("text"))
    rows = recurrent.shards(docs, 1).orderBy("unit").collect()
    assert [len(x.doc_ids) for x in rows] == [3, 2] and [x.unit for x in rows] == [0, 1]
    assert all(np.frombuffer(x.sizes, np.int32).tolist() == [3] * len(x.doc_ids) and len(x.keys) == 3 * 8 for x in rows)
    assert [np.frombuffer(x.places, np.int32).tolist() for x in rows] == [[0, 1, 2] * 3, [0, 1, 2] * 2]


def test_scores_far_apart_are_shifted():
    import numpy as np

    h, k = np.eye(2, dtype=np.float32), np.array([0, 1], np.uint8)
    for scale in (1, 200, -200):
        w = np.array([[1, 2, 3], [4, 5, 7]], np.float32) * scale
        b = np.zeros(3, np.float32)
        x = w.astype(float)
        want = x[[0, 1], k] - x.max(1) - np.log(np.exp(x - x.max(1, keepdims=True)).sum(1))
        e, total, at, lp = recurrent.softmax(w, b, h, k)
        assert np.allclose(lp, want, rtol=1e-5) and np.allclose((e / total).sum(0), 1) and at.tolist() == [0, 3]


def test_model_learns_what_the_base_cannot(spark):
    """Two languages in one corpus: the state tells them apart."""
    r = random.Random(1)
    a, b = vocabulary(11, 60), vocabulary(12, 60)
    docs = docs_of(spark, [prose(r, (a, b)[i % 2], 80) for i in range(400)])
    held = recurrent.score(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert held["s"] > held["b"] + 0.05 * held["n"]


def test_scores_equal_a_plain_run_over_every_training_document(spark):
    """One shard: counts, training stream and scores are made without Spark."""
    import numpy as np

    r = random.Random(8)
    words = vocabulary(4, 60)
    texts = [" ".join(r.choices(words, k=6)) for _ in range(5500)]
    docs = docs_of(spark, texts)
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text", F.lit(5)).alias("h"), recurrent.held_out(F.col("doc_id")).alias("held")).orderBy("h").collect()
    part, place = part_of([x.text for x in rows], [x.held for x in rows])
    counts = collections.Counter(w for x in rows if not x.held for w in x.text.encode().split())
    n = sum(not x.held for x in rows)
    key = dict(zip(place, recurrent.word_keys(place).tolist()))
    top = sorted(((key[w], c) for w, c in counts.items()), key=lambda x: (-x[1], x[0]))
    rare = [0.1] * recurrent.RARE_CLASSES
    lex = recurrent.Lexicon(top, rare, sum(counts.values()) + n, len(counts) + 1, n)
    p = {k: v.astype(np.float32) for k, v in recurrent.train(lex.start(), *part.steps(lex, ~part.held)).items()}
    want = recurrent.score_part(p, lex, part, np.array([counts[w] for w in place]))
    got = {x.doc_id: x for x in recurrent.score(docs.repartition(5)).collect()}
    assert n > 4500 and all(abs(got[x.doc_id].score - s) < 1e-6 * abs(s) and abs(got[x.doc_id].base_score - b) < 1e-9 * abs(b) for x, b, s in zip(rows, want[2], want[3]))


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    r = random.Random(9)
    texts = [prose(r, vocabulary(5), r.randint(0, 120)) for _ in range(500)]
    docs = docs_of(spark, texts)
    monkeypatch.setattr(recurrent, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(recurrent, "MOST_PARTITIONS", 4)
    monkeypatch.setattr(recurrent, "BROADCAST", 50)
    runs = []
    for n in (3, 37):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        runs.append(sorted(map(tuple, recurrent.score(docs.repartition(n)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert runs[0] == runs[1]


# --- mixing


@pytest.fixture(scope="module")
def mixed(spark):
    r, words, bad = random.Random(6), vocabulary(3), ["vile", "awful", "nasty", "rotten"]
    texts, labels = [], []
    for i in range(600):
        kind = i % 5
        n = r.randint(60, 120)
        if kind == 0:
            texts.append(" ".join(w + "###" for w in prose(r, words, n).split()))
        elif kind == 1:
            texts.append(prose(r, [*words, *bad * 12], n))
        else:
            texts.append(prose(r, words, n))
        labels.append((i, int(kind != 0), int(kind == 1)))
    texts += [None, "", "one", prose(r, words, 5000)]
    docs = docs_of(spark, texts)
    lab = spark.createDataFrame([x for x in labels if x[0] % 2] + [(None, 1, 0), (1, None, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, lab


def test_mixing_meets_targets_and_keeps_clean(mixed):
    docs, lab = mixed
    rows = mixing.mixing_report(docs, lab).collect()
    assert len(rows) == docs.count()
    kind = lambda r: r.doc_id % 5
    body = [r for r in rows if r.doc_id < 600]
    right = sum((r.p_clean, r.p_low, r.p_toxic).index(max(r.p_clean, r.p_low, r.p_toxic)) == {0: 1, 1: 2}.get(kind(r), 0) for r in body)
    assert right > 0.95 * len(body)
    assert all(abs(r.p_clean + r.p_low + r.p_toxic - 1) < 1e-9 and 0 <= r.rate for r in rows)
    clean = [r for r in body if kind(r) > 1]
    assert sum(r.copies >= 1 for r in clean) > 0.97 * len(clean)
    # what the rates, and the copies, bring of each domain, against the targets
    total = lambda p, c: sum(r.tokens * r[p] * r[c] for r in rows)
    before = sum(r.tokens * r.p_clean for r in rows)
    for p, want in (("p_clean", before), ("p_low", before * 0.02 / 0.98), ("p_toxic", 0.0)):
        # rates are rounded to copies by chance: four standard deviations
        chance = 4 * math.sqrt(sum((r.tokens * r[p]) ** 2 * (r.rate % 1) * (1 - r.rate % 1) for r in rows))
        assert abs(total(p, "rate") - want) < 0.001 * before and abs(total(p, "copies") - want) < 0.001 * before + chance
    told = {r.domain: r for r in mixing.mixing_totals(docs, lab).collect()}
    assert abs(told["low"].expected - total("p_low", "rate")) < 1e-6 * before and abs(told["low"].copied - total("p_low", "copies")) < 1e-6 * before


def test_posteriors_and_rates_equal_plain_ones(mixed):
    """Naive Bayes and projected descent by loops, from the features that the operator counted."""
    import numpy as np

    docs, lab = mixed
    bins = mixing.feature_bins(docs, mixing.lexicons(docs, lab)).collect()
    domain = {r.doc_id: 2 if r.toxic == 1 else 1 - r.quality for r in lab.collect() if r.doc_id is not None and r.quality is not None}
    known = [r for r in bins if r.doc_id in domain]
    size = [sum(domain[r.doc_id] == d for r in known) for d in range(3)]
    hits = collections.Counter((domain[r.doc_id], f, b) for r in known for f, b in enumerate(r.bins))
    want = {}
    for r in bins:
        s = [math.log((size[d] + 0.5) / (sum(size) + 1.5)) + sum(math.log((hits[d, f, b] + 0.05) / (size[d] + 0.05 * mixing.BINS)) for f, b in enumerate(r.bins)) for d in range(3)]
        e = np.exp(np.array(s) - max(s))
        want[r.doc_id] = e / e.sum()
    got = {r.doc_id: r for r in mixing.mixing_report(docs, lab).collect()}
    assert all(np.allclose([got[i].p_clean, got[i].p_low, got[i].p_toxic], p, atol=1e-9) for i, p in want.items())
    ids = sorted(want)
    p, w = np.array([want[i] for i in ids]), np.array([got[i].tokens for i in ids], float)
    s0 = w @ p
    target = s0[0] / mixing.WEIGHTS[0] * np.array(mixing.WEIGHTS)

    def descend(rate, move, held):
        def look(r):
            live = move & (r > 0)
            return w[move] @ (p[move] * r[move, None]) + held - target, (p[live] * w[live, None]).T @ p[live]

        (gap, gram), scale = look(rate), 1.0
        for _ in range(mixing.STEPS):
            if np.abs(gap).max() <= mixing.TOLERANCE * target.sum() or scale < mixing.LEAST_SCALE:
                break
            trial = rate.copy()
            trial[move] = np.maximum(0, rate[move] - p[move] @ (scale * np.linalg.solve(gram + mixing.DAMP * np.trace(gram) * np.eye(3), gap)))
            after, gram_after = look(trial)
            if after @ after < mixing.GAIN * (gap @ gap):
                rate, gap, gram, scale = trial, after, gram_after, 1.0
            else:
                scale /= 2
        return rate

    rate = descend(np.ones(len(ids)), np.ones(len(ids), bool), np.zeros(3))
    near = np.abs(rate - 1) <= mixing.SLACK
    rate = np.where(near, 1.0, rate)
    rate = descend(rate, ~near, w[near] @ p[near])
    assert np.allclose([got[i].rate for i in ids], rate, atol=1e-4)


def test_mix_stage_follows_copies(mixed):
    docs, lab = mixed
    want = {r.doc_id: r.copies for r in mixing.mixing_report(docs, lab).collect() if r.copies}
    out = mixing.mix(docs, lab)
    assert out.columns == docs.columns and dict(collections.Counter(r.doc_id for r in out.collect())) == want


def test_mixing_without_labels_or_rows(mixed):
    docs, lab = mixed
    rows = mixing.mixing_report(docs.limit(20), lab.limit(0)).collect()
    assert len(rows) == 20 and all(abs(r.p_clean - 1 / 3) < 1e-9 for r in rows)
    assert mixing.mixing_report(docs.limit(0), lab).count() == 0 and mixing.mix(docs.limit(0), lab).count() == 0


# --- the pipeline


def test_pipeline_equals_plain_stages(spark, tmp_path):
    """Every stage by loops on a small corpus with nulls, empties, copies, near copies, repeated rows and clashing column names."""
    import sentencepiece

    import corpus_pipeline

    r, words = random.Random(21), vocabulary(9, 500)
    texts = ["\n".join(prose(r, words, r.randint(20, 60)) for _ in range(r.randint(2, 4))) for _ in range(60)]
    texts += [texts[0], texts[1][:-1] + "x", texts[2] + "\n" + texts[3].split("\n")[0], None, "", "few words", "### $$$ " * 60, prose(r, words, 6000)]
    texts += [texts[4].replace(words[0], words[1], 1), "\n".join([texts[5].split("\n")[0]] * 9)]
    ids = [3 * i + 1 for i in range(len(texts))]
    extra = ["_qd", "_qk", "_qx", "_qc", "_qr", "_gone", "_often", "_l", "_k", "col", "words", "kept", "key", "id", "pos", "line", "place"]
    # the second row repeats a document; a document without id stays one
    rows = [(i, t, "en", "s", len(t or ""), *[f"{c}{i}" for c in extra]) for i, t in zip([*ids, ids[1], None], [*texts, texts[1], texts[6]])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 9 != 1), 0) for i in ids[:40]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    by_name = dict(quality.RULES)
    left = [x for x in rows if all(not by_name[n](quality.Features(x[1])) for n in by_name)]
    kept = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, left)) and len(left) < len(rows)

    order = sorted(left, key=lambda x: (x[0] is None, x[0] or 0))
    classes = plain_line_classes([x[1] for x in order], [(x[0] is None, x[0] or 0) for x in order])
    lined = []
    for x in left:
        place = (x[0] is None, x[0] or 0)
        text = "\n".join(y for p, y in enumerate(x[1].split("\n")) if y not in classes or classes[y][0] == (place, p))
        lined.append((x[0], text, x[2], x[3], len(text), *x[5:]))
    kept = corpus_pipeline.line_dedup(spark, spark.createDataFrame(left, schema), str(tmp_path))
    assert kept.columns == docs.columns and sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, lined)) and [x[1] for x in lined] != [x[1] for x in left]

    group = plain_classes([simhash.fingerprint(x[1]) for x in lined])
    least = {}
    for x, g in zip(lined, group):
        if x[0] is not None:
            least[g] = min(least.get(g, x[0]), x[0])
    once, single = set(), []
    for x, g in zip(lined, group):
        if x[0] is None or x[0] == least[g] and x[0] not in once:
            once.add(x[0])
            single.append(x)
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(lined, schema), str(tmp_path))
    assert kept.columns == docs.columns and sorted(str(tuple(x)) for x in kept.collect()) == sorted(map(str, single)) and len(single) < len(lined)

    dealt = spark.createDataFrame(single, schema)
    times = {x.doc_id: x.copies for x in mixing.mixing_report(dealt, spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()}
    mixed_rows = [x for x in single for _ in range(times[x[0]])]
    kept = corpus_pipeline.target_mix(spark, dealt, str(tmp_path))
    assert kept.columns == docs.columns and sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, mixed_rows))

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(x.doc_id), x.text, tuple(x.ids), x.n_tokens) for x in got) == sorted((str(x[0]), x[1], (*sp.encode(x[1]), sp.eos_id()), len(sp.encode(x[1])) + 1) for x in mixed_rows)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_queries_equal_their_sql(spark):
    import duckdb

    from quadrat.llm import queries

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for name in ("documents", "embeddings", "pages"):
        con.execute(f"create view {name} as select * from read_parquet('{d}/{name}.parquet')")
    cell = lambda v: round(v, 12) if isinstance(v, float) else v
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, d)
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(df.columns), name
        assert sorted(str([cell(r[c]) for c in columns]) for r in df.collect()) == sorted(str([cell(v) for v in r]) for r in want.fetchall()), name


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    want = {(r.doc_id, r.n_tokens) for r in pieces.encode(docs).collect()}
    got = corpus_pipeline.run(spark, d)
    assert got.columns == [*docs.columns, "ids", "n_tokens"] and {(r.doc_id, r.n_tokens) for r in got.collect()} == want and 0 < len(want) < before
