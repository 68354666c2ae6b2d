"""Line deduplication by a segment-partition edit join.

Every line with a character that is no space takes part: equal lines are merged (pre-aggregated in every
task), so copies never meet each other. Lines of ``min_chars`` characters or more also link to lines within
``threshold`` edits; at the least, 10 characters, two edits leave 0.8 of a line. A line indexes ``threshold`` + 1 segments under its
length; it probes, for each length not above its own by ``threshold`` at most, the substrings that a
segment can have become (multi-match-aware positions). Two lines within ``threshold`` edits always meet.
Segments are cut from UTF-32, where characters have one width. What meets is verified by a banded
bit-parallel edit automaton: one word of 2 * threshold + 1 diagonals per number of errors, stepped once a
character. All of it is DataFrame and SQL code.

A key that more than ``FEW`` lines index is crowded. Up to ``PAIRED`` of them meet its other members in pairs; of more, all members are verified
against the first; if all are linked to it, the key is done. Pairs whose signatures rule a link out are left out in the join. Otherwise the matched segment is taken
out and what is left of each line is cut again, now into four pieces of which two edits leave two intact, so members part by two more
pieces; of keys with the same members one goes on. This repeats until ``SHORT`` characters are left,
where members meet by what remains after two characters are masked or deleted: those that agree in it are
all within two edits of one of them, so one link each joins them. A member costs a bounded number of rows at each
level, whatever the size of its group.

Lines linked directly or through others are a class. Of each class the first occurrence in the corpus, by (doc_id, line
number), stays; all others go.

Defined cases: a null text has no lines and stays null; a null doc_id ranks after all others; doc_id must be
an integer column (else ValueError); rows with the same doc_id and text are one document, with the same decision; an empty
table gives an empty result; extra columns pass through ``deduplicate_lines`` and are ignored by reports;
blank lines are never touched; line feeds part lines, nothing is trimmed; a document may lose all its lines and then has an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.shared import components, shuffle_width, staged

THRESHOLD = 2
MIN_CHARS = 10
#: Lines that index a key up to which its members meet in pairs: least, largest and exclusive-or name three.
FEW = 3
#: Of a crowded key, the same where all members are listed; more are led by the first.
PAIRED = 256
#: Characters left of a line at which members of a crowded key meet by masks.
SHORT = 12
PIECES = 4
#: What parts the rests of a line where a piece was taken out: four bytes that are no character.
GAP = "X'FFFFFFFF'"


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def document_key(docs: DataFrame) -> DataFrame:
    """doc_id, _k (hash of the text) and lines."""
    return docs.select("doc_id", F.xxhash64("text").alias("_k"), split_lines(F.col("text")).alias("lines"))


def rank(doc_id: Column, pos: Column) -> Column:
    """Place in the corpus as one decimal: doc_id, then line number."""
    return F.coalesce(doc_id.cast("decimal(19,0)"), F.lit(9223372036854775807).cast("decimal(19,0)")) * F.lit(2147483648).cast("decimal(10,0)") + pos


def line_number(line: Column) -> Column:
    return F.xxhash64(line)


def identity(line: Column) -> tuple[Column, Column]:
    """Two hashes that stand for a line."""
    return F.xxhash64(line), F.xxhash64(line, F.lit(7))


def occurrences(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """doc_id, _k, pos, line for every line that is not blank and has ``min_chars`` characters or more."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"doc_id must be an integer column, not {kind}")
    rows = document_key(docs).select("doc_id", "_k", F.posexplode("lines").alias("pos", "line"))
    return rows.where((F.trim("line") != "") & ((F.octet_length("line") >= 4 * min_chars) | (F.length("line") >= min_chars)))


def units(line: Column) -> Column:
    return F.encode(line, "UTF-32")


def cut(x: str, start: str, size: str) -> str:
    """SQL for ``size`` characters of UTF-32 column ``x`` behind the first ``start``."""
    return f"substring({x}, 4 * ({start}) + 1, 4 * ({size}))"


def segment_start(i: str, n: str, parts: int) -> str:
    """SQL for where segment ``i`` (from 0) of ``n`` characters begins; later ones take the remainder."""
    return f"(({i}) * (({n}) div {parts}) + greatest(0, ({i}) - ({parts} - ({n}) % {parts})))"


def probe_plan(threshold: int) -> list[tuple[int, int, int]]:
    """(length above the indexed line's, segment, shift) of every probe; the first of each segment, without either, is its index key."""
    return [(d, i, s) for d in range(threshold + 1) for i in range(threshold + 1)
            for s in range(max(-i, d - (threshold - i)), min(i, d + (threshold - i)) + 1)]


def plan_column(plan: list[tuple[int, ...]], names: str) -> Column:
    return F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names.split(), row)]) for row in plan])


def keyed(lines: DataFrame, plan: list[tuple[int, int, int]], threshold: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row with key for each line (id, u: UTF-32) and entry of the plan, with d, i, s, start and size."""
    rows = lines.select("id", "u", *keep, F.expr("cast(octet_length(u) div 4 as int)").alias("n"))
    rows = rows.select("*", F.explode(plan_column(plan, "d i s")).alias("x")).select("id", "u", *keep, "n", "x.d", "x.i", "x.s")
    rows = rows.select("*", F.expr("n - d").alias("m")).select("*", F.expr(segment_start("i", "m", threshold + 1)).alias("a"), F.expr(segment_start("i + 1", "m", threshold + 1)).alias("e"))
    return rows.select("*", F.expr(f"xxhash64({cut('u', 'a + s', 'e - a')}, i, m)").alias("key"))


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether two texts are within ``threshold`` edits, by a banded bit-parallel automaton.

    Word d holds the diagonals (characters of a less characters of b) that d errors reach; each character
    of b moves all diagonals of all words at once.
    """
    width = 2 * threshold + 1
    full = (1 << width) - 1

    def step(s: Column, e: Column) -> Column:
        now = [s["r0"].bitwiseAND(e)]
        for d in range(1, threshold + 1):
            old, less = s[f"r{d}"], s[f"r{d - 1}"]
            now.append(old.bitwiseAND(e).bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(now[-1], 1)).bitwiseAND(full))
        return F.struct(*[w.alias(f"r{d}") for d, w in enumerate(now)])

    start = F.struct(*[F.lit(sum(1 << (threshold + k) for k in range(d + 1))).alias(f"r{d}") for d in range(threshold + 1)])
    goal = F.pow(F.lit(2), F.length(a) - F.length(b) + threshold).cast("int")

    def run(left: Column) -> Column:
        """``left`` is bound by a lambda, so the text is taken apart once."""
        match = lambda c, j: sum((F.when(F.get(left, j + k - threshold) == c, 1 << k).otherwise(0) for k in range(width)), F.lit(0))
        masks = F.transform(F.split(b, ""), match)
        return F.aggregate(masks, start, step, lambda s: s[f"r{threshold}"].bitwiseAND(goal) > 0)

    last = F.get(F.transform(F.array(F.split(a, "")), run), 0)
    return F.when(F.abs(F.length(a) - F.length(b)) > threshold, False).when((F.length(a) == 0) | (F.length(b) == 0), True).otherwise(last)


def picked(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``lines`` whose hash may be among ``ids``: a bitmap of 16 bits an id, of 8 MB at most, is broadcast.

    It only spares the joins behind it rows; where it is full it spares none.
    """
    bits = 1 << min(26, max(15, (16 * ids.count()).bit_length()))
    spot = lambda x: F.pmod(F.xxhash64(x), F.lit(bits)) + 1
    maps = ids.select(spot(F.col("id")).alias("x")).groupBy(F.bitmap_bucket_number("x").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("_bits"))
    at = F.bitmap_bit_position("_x")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(bitmap_bit_position(_x) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    joined = lines.withColumn("_x", spot(line_number(F.col("line")))).join(F.broadcast(maps), F.bitmap_bucket_number("_x") == F.col("_bucket"))
    return joined.where(F.pmod(F.floor(byte / F.pow(F.lit(2), at % 8)), F.lit(2)) == 1).select(*lines.columns)


def pieces_plan(threshold: int = THRESHOLD) -> list[tuple[int, int, int, int]]:
    """(length above, first touched piece, last touched piece, shift between them) of every way that two edits leave the others intact."""
    shifts = {0: (0, -1, 1), 1: (0, 1), 2: (0, 1, 2)}
    return [(d, p, q, s) for d in range(threshold + 1) for p in range(PIECES) for q in range(p + 1, PIECES) for s in shifts[d]]


def cut_again(rows: DataFrame) -> DataFrame:
    """Members (key, id, own, d, sig, u: what is left) under the keys of the next level, two pieces left of each."""
    by = {d: [x[1:] for x in pieces_plan() if x[0] == d] for d in range(THRESHOLD + 1)}
    plans = F.when(F.col("d") == 0, plan_column(by[0], "p q s")).when(F.col("d") == 1, plan_column(by[1], "p q s")).otherwise(plan_column(by[2], "p q s"))
    rows = rows.drop("s").select("*", F.expr("cast(octet_length(u) div 4 as int) - d").alias("m"), F.explode(plans).alias("x")).select("*", "x.p", "x.q", "x.s").drop("x")
    at = lambda i: F.expr(segment_start(i, "m", PIECES))
    rows = rows.select("*", at("p").alias("a"), at("p + 1").alias("b"), at("q").alias("e"), at("q + 1").alias("f"))
    kept = f"{cut('u', '0', 'a')}, p, {cut('u', 'b + s', 'e - b')}, q, {cut('u', 'f + d', 'm - f')}"
    left = f"concat({cut('u', 'a', 'b - a + s')}, {GAP}, {cut('u', 'e + s', 'f - e + d - s')})"
    return rows.select(F.expr(f"xxhash64(key, m, {kept})").alias("key"), "id", F.expr("own and s = 0").alias("own"), "d", "s", "sig", F.expr(left).alias("u"))


def masked(rows: DataFrame) -> DataFrame:
    """Members under what remains of them after two characters go; ``own`` marks those that may be the shorter of a link."""
    n = "cast(octet_length(u) div 4 as int)"
    solid = f"filter(sequence(0, {n} - 1), i -> {cut('u', 'i', '1')} != {GAP})"
    rows = rows.where(f"{n} > 0").select("*", F.expr(solid).alias("at"))
    one = lambda i: f"concat({cut('u', '0', i)}, {cut('u', f'{i} + 1', f'{n} - {i} - 1')})"
    two = f"concat({cut('u', '0', 'i')}, {cut('u', 'i + 1', 'j - i - 1')}, {cut('u', 'j + 1', f'{n} - j - 1')})"
    pairs = lambda made: f"flatten(transform(at, i -> transform(filter(at, j -> j > i), j -> {made})))"
    same = f"concat(transform(at, i -> xxhash64(key, 'deleted', {one('i')})), {pairs(f'xxhash64(key, 0, i, j, {two})')}, array(xxhash64(key, 'whole', u)))"
    mine = f"concat({same}, transform(at, i -> xxhash64(key, 1, i, {one('i')})))"
    longer = f"concat({pairs(f'xxhash64(key, 1, j - 1, {two})')}, {pairs(f'xxhash64(key, 1, i, {two})')}, transform(at, i -> xxhash64(key, 'whole', {one('i')})))"
    longest = pairs(f"xxhash64(key, 'whole', {two})")
    keys = F.expr(f"array_distinct(case when own then {mine} when d = 0 then {same} when d = 1 then {longer} else {longest} end)")
    return rows.select(F.explode(keys).alias("key"), "id", "own")


def signature(line: Column) -> Column:
    """Parities of the counts of 61 kinds of characters (one) and of 64 kinds of neighbouring characters (two)."""
    flip = lambda s, k: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int")))
    start = F.struct(F.lit(0).cast("long").alias("one"), F.lit(0).cast("long").alias("two"), F.lit(0).alias("last"))
    step = lambda s, c: F.struct(flip(s["one"], c % 61).alias("one"), flip(s["two"], F.pmod(31 * s["last"] + c, F.lit(64))).alias("two"), c.alias("last"))
    return F.aggregate(F.transform(F.split(line, ""), F.ascii), start, step, lambda s: F.struct(s["one"], s["two"]))


def alike(a: Column, b: Column, threshold: int) -> Column:
    """Whether signatures allow a link: an edit changes two characters and four neighbours at most."""
    differ = lambda k: F.bit_count(a[k].bitwiseXOR(b[k]))
    return (differ("one") <= 2 * threshold) & (differ("two") <= 4 * threshold)


def verified(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that are linked; ``texts`` has id and line of each."""
    side = lambda c: texts.select(F.col("id").alias(c), F.col("line").alias("l" + c))
    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b").repartition(shuffle_width(pairs.sparkSession))
    return both.where(within(F.col("la"), F.col("lb"), threshold)).select("a", "b")


def crowded_links(members: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) that connect every two linked lines which meet under a crowded key.

    ``members`` has key, id, sig, own (indexed the key), d (length above the indexed lines'), s (shift), i (segment),
    n (characters); ``texts`` has id, line, u (UTF-32), sig.
    """
    out: list[DataFrame] = []
    rows, left, first = staged(members, "crowd"), F.col("n") - F.col("d"), True
    while not rows.isEmpty():
        mark = F.xxhash64("id", "d", "s", "own")
        sign = F.struct(F.bit_xor(mark), F.sum(F.shiftright(mark, 31)))
        groups = rows.groupBy("key").agg(F.count_if("own").alias("mine"), F.count("*").alias("all"), sign.alias("sign"), F.min(F.when(F.col("own"), F.col("id"))).alias("head"), F.max(left).alias("left"))
        # a key whose members are those of another key says nothing new
        groups = groups.where("mine > 0 and all > 1").groupBy("sign", "mine", "all", "head").agg(F.min(F.struct("left", "key")).alias("k")).select("k.key", "k.left", "mine", "head")
        groups = staged(groups, "crowd-keys")
        few, many = groups.where(f"mine <= {PAIRED}"), groups.where(f"mine > {PAIRED}")
        here = rows.join(few.select("key"), "key")
        pairs = here.where("own").select("key", F.col("id").alias("a"), F.col("sig").alias("sa")).join(here.select("key", "own", F.col("id").alias("b"), F.col("sig").alias("sb")), "key")
        pairs = pairs.where(alike(F.col("sa"), F.col("sb"), threshold) & (F.col("a") != F.col("b")) & (~F.col("own") | (F.col("a") < F.col("b"))))
        heads = many.join(texts.select(F.col("id").alias("head"), F.col("sig").alias("sa")), "head")
        led = rows.join(heads.select("key", F.col("head").alias("a"), "sa"), "key").where((F.col("id") != F.col("a")) & alike(F.col("sa"), F.col("sig"), threshold))
        tried = pairs.select("a", "b").unionByName(led.select("a", F.col("id").alias("b")))
        hits = staged(verified(tried, texts, threshold), "crowd-links")
        out.append(hits)
        if many.isEmpty():
            break
        open_ = rows.join(many, "key").where("id != head").join(hits.select(F.col("a").alias("head"), F.col("b").alias("id"), F.lit(1).alias("hit")), ["head", "id"], "left")
        open_ = open_.groupBy("key", "left").agg(F.count("hit").alias("hits"), F.count("*").alias("all")).where("hits < all").select("key", "left")
        todo = rows.join(open_, "key")
        if first:
            # the matched segment is taken out
            start, end = segment_start("i", "n - d", threshold + 1), segment_start("i + 1", "n - d", threshold + 1)
            rest = f"concat({cut('u', '0', f'{start} + s')}, {GAP}, {cut('u', f'{end} + s', f'n - {end} - s')})"
            todo = todo.join(texts.select("id", "u"), "id").select("key", "id", "sig", "own", "d", "left", F.expr(rest).alias("u"))
        todo = staged(todo.withColumn("left", F.expr("cast(octet_length(u) div 4 as int) - d")), "crowd-open")
        stars = masked(todo.where(f"left <= {SHORT}"))
        centres = stars.where("own").groupBy("key").agg(F.min("id").alias("a"))
        ends = stars.join(centres, "key").where("id != a").select("a", F.col("id").alias("b"))
        out.append(staged(verified(ends, texts, threshold), "crowd-links"))
        rows, left, first = staged(cut_again(todo.where(f"left > {SHORT}").drop("left")), "crowd"), F.expr("cast(octet_length(u) div 4 as int) - d"), False
    made = out[0] if out else members.select(F.col("id").alias("a"), F.col("id").alias("b"))
    for x in out[1:]:
        made = made.unionByName(x)
    return made


def line_links(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """Links between different lines, enough to connect every two lines within ``threshold`` edits.

    a and b, each a struct of place (of the first occurrence), id and id2; every two lines that meet under
    a key that is not crowded have their own link.
    """
    if threshold != THRESHOLD or min_chars < 3 * (threshold + 1):
        raise ValueError("two edits, and lines longer than their segments' shifts")
    lines = occurrences(docs, min_chars).select("line").distinct().select(line_number(F.col("line")).alias("id"), units(F.col("line")).alias("u"))
    plan = probe_plan(threshold)
    index = keyed(lines, [x for x in plan if x[0] == x[2] == 0], threshold).groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.bit_xor("id").alias("x"))
    met = keyed(lines, plan, threshold).select("key", F.col("id").alias("b")).join(index.hint("shuffle_hash"), "key").where("c > 1 or lo != b")
    known = F.when(F.col("c") == 1, F.array("lo")).when(F.col("c") == 2, F.array("lo", "hi")).when(F.col("c") == 3, F.array("lo", "hi", F.expr("x ^ lo ^ hi"))).otherwise(F.array(F.lit(None).cast("long")))
    met = met.select(F.when(F.col("c") > FEW, F.col("key")).alias("key"), F.explode(known).alias("a"), "b").where("a is null or a != b")
    found = staged(met.select("key", F.least("a", F.when(F.col("a").isNotNull(), F.col("b"))).alias("a"), F.when(F.col("a").isNull(), F.col("b")).otherwise(F.greatest("a", "b")).alias("b")), "meetings")
    pairs = staged(found.where("key is null").select("a", "b").distinct(), "pairs")
    crowd = found.where("key is not null")
    if not crowd.isEmpty():
        texts = picked(occurrences(docs, min_chars), crowd.select(F.col("b").alias("id")).distinct()).select("line").distinct()
        texts = staged(texts.select(line_number(F.col("line")).alias("id"), "line", units(F.col("line")).alias("u"), signature(F.col("line")).alias("sig")), "crowd-lines")
        rows = keyed(texts, plan, threshold, ("sig",)).select("key", "id", "sig", F.expr("d = 0 and s = 0").alias("own"), "d", "s", "i", "n")
        rows = rows.join(crowd.select("key").distinct(), "key", "left_semi")
        links = crowded_links(rows, texts, threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = staged(pairs.unionByName(links).distinct(), "pairs")
    texts = picked(occurrences(docs, min_chars), pairs.select(F.explode(F.array("a", "b")).alias("id")))
    texts = texts.select("line", rank(F.col("doc_id"), F.col("pos")).alias("place")).groupBy("line").agg(F.min("place").alias("place"))
    one, two = identity(F.col("line"))
    texts = staged(texts.select("line", "place", line_number(F.col("line")).alias("n"), one.alias("id"), two.alias("id2")), "pair-lines")
    side = lambda p: texts.select(F.col("n").alias(p + "n"), F.col("line").alias(p + "line"), F.struct("place", "id", "id2").alias(p + "node"))
    both = pairs.join(side("l_"), F.col("a") == F.col("l_n")).join(side("r_"), F.col("b") == F.col("r_n"))
    # few bytes but much work, so the rows are spread over all partitions
    both = both.repartition(shuffle_width(docs.sparkSession))
    return both.where(within(F.col("l_line"), F.col("r_line"), threshold)).select(F.col("l_node").alias("a"), F.col("r_node").alias("b"))


def line_classes(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """id, id2 (identity of a line), place (of its class's first occurrence), head (whether that is this line), others (texts of its class less one).

    Lines that occur once and are linked to none are left out.
    """
    root = staged(components(line_links(docs, threshold, min_chars)), "line-classes")
    size = root.groupBy("root").agg((F.count("*") - 1).alias("others"))
    linked = root.join(size, "root").select("node.id", "node.id2", F.col("root.place").cast("decimal(38,0)").alias("place"), (F.col("node") == F.col("root")).alias("head"), "others")
    one, two = identity(F.col("line"))
    seen = occurrences(docs).select(one.alias("id"), two.alias("id2"), rank(F.col("doc_id"), F.col("pos")).cast("decimal(38,0)").alias("place"))
    repeated = seen.groupBy("id", "id2").agg(F.min("place").alias("place"), F.count("*").alias("n")).where("n > 1").select("id", "id2", "place", F.lit(None).cast("boolean").alias("head"), F.lit(0).cast("long").alias("others"))
    both = repeated.unionByName(linked).groupBy("id", "id2").agg(F.min("place").alias("place"), F.max("head").alias("head"), F.max("others").alias("others"))
    return both.withColumn("head", F.coalesce("head", F.lit(True)))


def decisions(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, _k, late (line number and the document of the line that stays, sorted), n_links for documents with something to say."""
    one, two = identity(F.col("line"))
    where = occurrences(docs).select("doc_id", "_k", "pos", one.alias("id"), two.alias("id2"))
    # written, so that the join below deals both sides out itself and AQE may split the rows of a common line
    flags = staged(line_classes(docs, threshold, min_chars), "line-flags")
    hit = where.join(flags, ["id", "id2"])
    late = ~F.col("head") | (rank(F.col("doc_id"), F.col("pos")) != F.col("place"))
    first = F.expr("(place - pmod(place, 2147483648BD)) div 2147483648BD")
    doc = F.when(first != 9223372036854775807, first)
    return hit.groupBy("doc_id", "_k").agg(F.array_sort(F.collect_set(F.when(late, F.struct("pos", doc.alias("doc"))))).alias("late"), F.sum("others").alias("n_links"))


def line_report(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, dropped (line numbers), first_docs (for each, the document of the line that stays), n_links.

    n_links counts the different texts that its lines are linked to, directly or through others.
    """
    made = decisions(docs, threshold, min_chars)
    rows = document_key(docs).select("doc_id", "_k", F.coalesce(F.size("lines"), F.lit(0)).alias("n"))
    rows = rows.withColumn("n", F.greatest(F.lit(0), "n"))
    joined = rows.join(made.select(F.col("doc_id").alias("_d"), F.col("_k").alias("_h"), "late", "n_links"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_k") == F.col("_h")), "left")
    joined = joined.withColumn("late", F.coalesce("late", F.array().cast("array<struct<pos: int, doc: bigint>>")))
    return joined.select("doc_id", F.col("n").cast("long").alias("n_lines"), F.size("late").cast("long").alias("n_dropped"), F.col("late.pos").alias("dropped"), F.col("late.doc").alias("first_docs"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def deduplicate_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the dropped lines; n_chars follows the text where it exists; other columns as they were."""
    made = decisions(docs, threshold, min_chars).where(F.size("late") > 0)
    made = made.select(F.col("doc_id").alias("_qd"), F.col("_k").alias("_qk"), F.col("late.pos").alias("_qx"))
    joined = docs.join(made, docs.doc_id.eqNullSafe(made._qd) & (F.xxhash64(docs.text) == made._qk), "left")
    kept = F.array_join(F.filter(split_lines(docs.text), lambda x, i: ~F.array_contains(made._qx, i)), "\n")
    text = F.when(made._qx.isNull(), docs.text).otherwise(kept)
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[changed.get(c, docs[c]).alias(c) for c in docs.columns])
