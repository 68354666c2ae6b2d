"""Quality rules as a short-circuit cascade.

Every rule reads lazily computed features of one text and says whether it rejects. On a bounded
sample the cascade measures what each rule still has to compute and how many of the texts that
earlier rules left it rejects, and orders the rules by rejection per second. A text is dropped by the
first rule that fails it, so later, dearer rules never look at it.

Defined cases: a null text is an empty one (no words, fails ``few_words``); an empty table gives an
empty result; repeated rows are judged alike; extra columns pass through filters untouched and are
ignored by reports; a null doc_id stays null.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.shared import WHITE

SYMBOLS = "#*$%&|<>"
#: Rows that order the cascade, and their most bytes; they affect speed only, never a verdict.
SAMPLE_ROWS, SAMPLE_BYTES = 256, 1 << 16


class Features:
    """Features of one text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(self.text.count(c) for c in WHITE)

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.text.count(c) for c in SYMBOLS)

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(WHITE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def dup_line_chars(self) -> int:
        return sum(map(len, self.lines)) - sum(map(len, set(self.lines))) if self.n_dup_lines else 0

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(windows) == len(set(windows)):
            return 0
        often = Counter(windows)
        total, upto = 0, 0
        for i, g in enumerate(windows):
            if often[g] > 1:
                total += i + 3 - max(i, upto)
                upto = i + 3
        return total

    @cached_property
    def n_loud_words(self) -> int:
        """Words that end in a run of exclamation or question marks."""
        return sum(w.endswith((b"!!", b"??", b"!?", b"?!")) for w in self.words) if "!" in self.text or "?" in self.text else 0

    @cached_property
    def n_letter_words(self) -> int:
        return sum(not w.isascii() or any(65 <= c <= 90 or 97 <= c <= 122 for c in w) for w in self.words)


Rule = tuple[str, Callable[[Features], bool]]

#: The two rules of the base verdict.
BASE: list[Rule] = [
    ("few_words", lambda f: f.n_words < 50),
    ("repeated_windows", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
]
RULES: list[Rule] = [
    *BASE,
    ("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    ("loud", lambda f: 10 * f.n_loud_words > f.n_words),
    ("word_length", lambda f: not 2 * f.n_words <= f.word_chars <= 15 * f.n_words),
    ("repeated_lines", lambda f: 10 * f.dup_line_chars > 3 * len(f.text)),
    ("few_letters", lambda f: 10 * f.n_letter_words < 8 * f.n_words),
]
BASE_NAMES = [name for name, _ in BASE]


def cascade_order(texts: list[str], rules: list[Rule] = RULES) -> list[str]:
    """Greedy order by measured rejection per second among the texts that earlier rules left."""
    left, todo, order = [Features(t) for t in texts], list(rules), []
    while todo:
        best = None
        for name, rule in todo:
            trial = [Features(f.text) for f in left]
            for fresh, f in zip(trial, left):
                fresh.__dict__.update(f.__dict__)
            t = time.perf_counter()
            failed = [rule(f) for f in trial]
            cost = (time.perf_counter() - t) / max(1, len(trial)) + 1e-9
            gain = (sum(failed) + 0.5) / (len(failed) + 1) / cost
            if best is None or gain > best[0]:
                best = gain, name, [f for f, bad in zip(trial, failed) if not bad]
        order.append(best[1])
        left, todo = best[2], [r for r in todo if r[0] != best[1]]
    return order


def plan_cascade(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    short = F.octet_length(F.coalesce("text", F.lit(""))) <= SAMPLE_BYTES
    near = docs.select("text").where(short & (F.pmod(F.xxhash64("text"), F.lit(4)) == 0)).limit(sample_rows)
    return cascade_order([r[0] or "" for r in near.collect()], rules)


def first_failure(f: Features, order: list[str], by_name: dict[str, Callable]) -> str | None:
    for name in order:
        if by_name[name](f):
            return name
    return None


def slices(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Small batches, since the features of all texts of a batch are held together."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def annotate(docs: DataFrame, report: tuple[str, ...] = (), rules: list[Rule] = RULES, order: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, the features named in ``report``, base_failed, failed_rule (null if none), kept."""
    order = order or plan_cascade(docs, rules)
    by_name = dict(rules)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fs = [Features(t) for t in batch.column(1).to_pylist()]
            cols = [batch.column(0)]
            cols += [pa.array([getattr(f, name) for f in fs], pa.int64()) for name in report]
            failed = [first_failure(f, order, by_name) for f in fs]
            cols.append(pa.array([any(by_name[n](f) for n in BASE_NAMES) for f in fs], pa.bool_()))
            cols.append(pa.array(failed, pa.string()))
            cols.append(pa.array([x is None for x in failed], pa.bool_()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *report, "base_failed", "failed_rule", "kept"])

    schema = f"doc_id {id_type}, " + "".join(f"{n} long, " for n in report) + "base_failed boolean, failed_rule string, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(judge, schema)


def keep(docs: DataFrame, rules: list[Rule] = RULES, order: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` that pass every rule, all columns as they were."""
    order = order or plan_cascade(docs, rules)
    by_name, at = dict(rules), docs.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ok = [first_failure(Features(t), order, by_name) is None for t in batch.column(at).to_pylist()]
            yield batch.filter(pc.fill_null(pa.array(ok, pa.bool_()), False))

    return docs.mapInArrow(judge, docs.schema)
