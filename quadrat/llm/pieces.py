"""SentencePiece encoding and decoding over a table of distinct chunks.

No piece of the model has a whitespace marker after another character, and none holds a line feed, so
no merge crosses the place before a marker run or beside a line feed. A text therefore falls into
chunks (a marked word, or a line feed) whose segmentations are independent. Each task segments every
distinct chunk once, keeps its ids in a table, and joins them back by position. The table is emptied when it holds
``TABLE_CHUNKS`` chunks, so memory is bounded while results stay the same. A text with a chunk that
decoding would alter, and any text under a model without these properties, is segmented whole.

Defined cases: a null text is empty (the end id alone, decoded to nothing); texts of any length are
processed whole; repeated rows give repeated results; an empty table gives an empty result; extra
columns are ignored by reports.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
TABLE_CHUNKS = 400_000
#: Longer chunks are segmented each time instead of being kept.
KEPT_CHARS = 200
#: Marked words of a text, each without its first space.
RUNS = re.compile(" ( *[^ ]*)")

_codecs: dict[str, "PieceCodec"] = {}


class PieceCodec:
    def __init__(self, model_path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.end = self.sp.eos_id()
        n = self.sp.get_piece_size()
        pieces = (self.sp.id_to_piece(i) for i in range(n))
        self.lead = self.sp.encode("\n")
        self.chunked = (
            not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces)
            and len(self.lead) == 2
            and self.sp.id_to_piece(self.lead[0]) == MARK
            and self.sp.decode(self.sp.encode("  a  ﬁ\n")) == "  a  ﬁ\n"
        )
        self.marked: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {"": b"", "\n": b"%d" % self.lead[1]}

    def _chunk(self, table: dict[str, bytes], chunk: str, mark: str) -> bytes | None:
        """Decimal ids of one chunk, found behind a line feed; None if decoding alters the chunk."""
        ids = self.sp.encode("\n" + mark + chunk)
        if self.sp.decode(ids) != "\n" + mark.replace(MARK, " ") + chunk:
            return None
        got = " ".join(map(str, ids[2:])).encode()
        if len(chunk) <= KEPT_CHARS:
            if len(table) >= TABLE_CHUNKS:
                table.clear()
            table[chunk] = got
        return got

    def _word(self, word: str) -> bytes | None:
        """Ids of a marked word that the table lacks; line feeds in it part it further."""
        if "\n" not in word:
            return self._chunk(self.marked, word, MARK)
        head, *rest = word.split("\n")
        out = [self.marked.get(head) or self._chunk(self.marked, head, MARK)]
        for part in rest:
            out.append(b"%d" % self.lead[1])
            if part:
                out.append(self.bare.get(part) or self._chunk(self.bare, part, ""))
        return None if None in out else b" ".join(out)

    def run(self, text: str | None) -> tuple[int, bytes, bytes]:
        """(number of ids, decimal ids joined by one space, decoded text), end id included."""
        text = text or ""
        if not text:
            return 1, b"%d" % self.end, b""
        parts = None
        if self.chunked and MARK not in text:
            # a run of spaces belongs to the word behind it
            words = text.split(" ") if "  " not in text and text[-1] != " " and text[0] != " " else RUNS.findall(" " + text)
            found = self.marked.get
            parts = [found(w) or self._word(w) for w in words]
        if parts is None or None in parts:
            ids = [*self.sp.encode(text), self.end]
            return len(ids), " ".join(map(str, ids)).encode(), self.sp.decode(ids).encode()
        joined = b" ".join(parts) + b" %d" % self.end
        return joined.count(b" ") + 1, joined, text.encode()


def codec(model_path: str) -> PieceCodec:
    if model_path not in _codecs:
        _codecs[model_path] = PieceCodec(model_path)
    return _codecs[model_path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model_path: str | None = None, ids: bool = True, decoded: bool = False, digests: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, and on request ids (array), decoded (text), and both SHA-256 digests."""
    path = model_path or default_model()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens long" + ", ids array<int>" * ids + ", decoded string" * decoded + ", ids_sha256 string, decoded_sha256 string" * digests
    names = [f.split()[0] for f in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = [c.run(t) for t in part.column(1).to_pylist()]
                cols = [part.column(0), pa.array([g[0] for g in got], pa.int64())]
                if ids:
                    cols.append(pa.array([list(map(int, g[1].split())) for g in got], pa.list_(pa.int32())))
                if decoded:
                    cols.append(pa.array([g[2].decode() for g in got], pa.string()))
                if digests:
                    cols += [pa.array([hashlib.sha256(g[k]).hexdigest() for g in got], pa.string()) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select("doc_id", "text").mapInArrow(work, schema)


def token_documents(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """The documents with ids and n_tokens added (existing columns of these names are replaced)."""
    path = model_path or default_model()
    kept = [c for c in docs.columns if c not in ("ids", "n_tokens")]
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])
    at = kept.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                got = [c.run(t) for t in part.column(at).to_pylist()]
                ids = pa.array([list(map(int, g[1].split())) for g in got], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array([g[0] for g in got], pa.int64())], names=[*kept, "ids", "n_tokens"])

    return docs.select(*kept).mapInArrow(work, schema)


def decode(tokens: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    path = model_path or default_model()
    id_type = tokens.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = codec(path).sp
        for batch in batches:
            text = [sp.decode(list(x or [])) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", F.col("ids").cast("array<int>")).mapInArrow(work, f"doc_id {id_type}, text string")
