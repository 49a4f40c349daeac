"""Operator 10: SentencePiece (BPE with byte fallback) encoding and decoding by a prefix table.

For every prefix of a chunk the table holds the unique last token of the prefix's encoding. A
token that ends at a position is that last token exactly if it follows the last token of the
prefix before it as a compatible pair, one that the merges leave alone. An Aho-Corasick
automaton yields the tokens that end at each position, the pair test is remembered, and the ids
are read backwards from the last prefix.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, read_table

SPACE = "▁"
#: Bytes (about) that each of a worker's two memos of spans may hold, and entries of its memo of pairs;
#: a full memo starts anew, and longer spans than `MEMO_SPAN` are never kept. Memos last for one task, as
#: workers stay for later stages, whose memory they would take.
MEMO_CHARS, MEMO_SPAN, MEMO_PAIRS = 32_000_000, 200, 300_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceBpe:
    """Encoder and decoder for one model with identity normalisation and a dummy prefix."""

    def __init__(self, model_path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = sp.get_piece_size()
        self.eos, self.unk = sp.eos_id(), sp.unk_id()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.surface = [p.replace(SPACE, " ") for p in self.pieces]
        self.byte_id, self.byte_of, self.silent = {}, {}, set()
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.byte_of[i] = int(piece[3:5], 16)
            elif sp.is_control(i):
                self.silent.add(i)
            elif not sp.is_unknown(i) and not sp.is_unused(i):
                self.ids[piece] = i
                self.scores[piece] = sp.get_score(i)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("the model has pieces that hold a space after other characters")
        self.unusual = {*self.byte_of, *self.silent, self.unk}
        # What single ids decode to whatever is beside them; ASCII bytes are characters of their own.
        self.plain = {str(i): x for i, x in enumerate(self.surface) if i not in self.unusual} | {str(i): chr(b) for i, b in self.byte_of.items() if b < 128}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if self._merge(piece) == [piece]:
                self.automaton.add_word(piece, (i, len(piece) - 1))
        self.automaton.make_automaton()
        self.known = {p for p in self.ids if len(p) == 1}
        self.pairs: dict[int, bool] = {}
        self.width = [len(p) for p in self.pieces]
        self.words, self.spans = Memo(self, SPACE), Memo(self, "")
        self.newline = self.spans["\n"]

    def _merge(self, text: str) -> list[str]:
        """BPE by definition: the best-scored adjacent pair merges first, the leftmost of equals."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, first: int, second: int) -> bool:
        key = first << 32 | second
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            a, b = self.pieces[first], self.pieces[second]
            ok = self.pairs[key] = self._merge(a + b) == [a, b]
        return ok

    def encode_chunk(self, chunk: str) -> list[int]:
        """The ids of a chunk whose characters are all pieces."""
        n = len(chunk)
        last: list = [None] * (n + 1)
        pairs, compatible = self.pairs, self.compatible
        for end, (token, less) in self.automaton.iter(chunk):
            if last[end + 1] is None:
                if end != less:
                    before = last[end - less]
                    if before is None:
                        continue
                    ok = pairs.get(before << 32 | token)
                    if not ok and (ok is False or not compatible(before, token)):
                        continue
                last[end + 1] = token
        ids, width = [], self.width
        while n:
            ids.append(last[n])
            n -= width[last[n]]
        return ids[::-1]

    def encode_span(self, span: str) -> list[int]:
        """The ids of any span that no merge crosses; characters without a piece become bytes."""
        known = self.known
        if known.issuperset(span):
            return self.encode_chunk(span)
        ids, at, n = [], 0, len(span)
        while at < n:
            end = at
            while end < n and span[end] in known:
                end += 1
            if end > at:
                ids += self.encode_chunk(span[at:end])
            if end < n:
                ids += [self.byte_id.get(b, self.unk) for b in span[end].encode("utf-8", "surrogatepass")] if self.byte_id else [self.unk]
                end += 1
            at = end
        return ids

    def decode(self, ids: list[int]) -> str:
        """The library's decode(ids): control ids are silent, and the dummy prefix goes."""
        out, held = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            if i is not None and i not in self.silent:
                out.append(" ⁇ " if i == self.unk else self.surface[i])
        text = "".join(out)
        return text[1:] if text.startswith(" ") else text

    def decode_ids(self, ids: str) -> str:
        """decode() of ids joined by spaces."""
        tokens = ids.split(" ")
        last = tokens.pop() if tokens[-1] == str(self.eos) else None
        try:
            text = "".join(map(self.plain.__getitem__, tokens))
        except KeyError:  # parts of characters, unknown or control ids
            return self.decode([int(i) for i in (tokens if last is None else [*tokens, last])])
        return text[1:] if text.startswith(" ") else text

    def encode_text(self, text: str | None) -> tuple[str, str]:
        """The ids of a whole text with the end id, joined by spaces, and what these ids decode to.

        Ids are put together from spans that no merge crosses, each encoded once for as long as
        the memo holds it.
        """
        if not text:
            return str(self.eos), ""
        if text[0] == " " or "  " in text or SPACE in text:
            spans = _SPANS.findall(SPACE + text.replace(" ", SPACE))
            out = map(self.spans.__getitem__, spans)
        else:
            first, *lines = text.split("\n")
            out = list(map(self.words.__getitem__, first.split(" ")))
            for line in lines:
                out.append(self.newline)
                head, *words = line.split(" ")
                out.append(self.spans[head])
                out += map(self.words.__getitem__, words)
        ids = f"{''.join(out)}{self.eos}"
        return ids, self.decode_ids(ids)

    def forget(self) -> None:
        """Empties the memos."""
        for memo in (self.words, self.spans, self.pairs):
            memo.clear()
        self.words.held = self.spans.held = 0

    def encode(self, text: str | None) -> list[int]:
        """All ids with the end id, as the library gives them."""
        return [int(i) for i in self.encode_text(text)[0].split()]


class Memo(dict):
    """Ids, each followed by a space, of spans with `prefix` in front."""

    def __init__(self, bpe: PieceBpe, prefix: str):
        super().__init__()
        self.bpe, self.prefix, self.held = bpe, prefix, 0

    def __missing__(self, span: str) -> str:
        value = "".join([f"{i} " for i in self.bpe.encode_span(self.prefix + span)])
        if len(span) <= MEMO_SPAN:
            self.held += len(span) + len(value) + 150  # and about what an entry takes
            if self.held > MEMO_CHARS:
                self.clear()
                self.held = len(span) + len(value) + 150
            self[span] = value
        return value


#: No piece holds a space mark after another character, so no merge crosses from such a character
#: to a space mark; line feeds are a span of their own because they repeat the words otherwise.
_SPANS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


def _utf8(data: bytes) -> str:
    """Bytes as text; each byte outside a valid sequence gives one replacement character."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                at += 1
        return "".join(out)


_loaded: dict[str, PieceBpe] = {}


def load(model_path: str) -> PieceBpe:
    """One encoder for each worker process."""
    if model_path not in _loaded:
        _loaded[model_path] = PieceBpe(model_path)
    return _loaded[model_path]


def encode_batches(bpe: PieceBpe, batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns `names` of a task's batches (id, text), of which there are four, or six with the ids; memos are empty afterwards."""
    ids, kinds = len(names) > 4, [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
    try:
        for batch in batches:
            for part in pieces(batch, 1, 200):
                rows = []
                for t in part.column(1):
                    id_text, decoded = bpe.encode_text(t.as_py())
                    decoded = decoded.encode("utf-8", "surrogatepass")
                    row = [id_text.count(" ") + 1, hashlib.sha256(id_text.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()]
                    rows.append(row + ([list(map(int, id_text.split())), decoded.decode()] if ids else []))
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names)
    finally:
        bpe.forget()


def piece_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, ids: bool = False) -> DataFrame:
    """Every row of `docs` (id, then) n_tokens, ids_sha256, decoded_sha256, with `ids` also ids, decoded.

    A null text counts as empty, which encodes to the end id alone. Rows stay apart even if they
    repeat an id. Long texts are encoded whole; memory is a few times one text, and the memos
    are bounded and go when a task ends. `model_path` must exist on every executor.
    """
    path = model_path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encode_batches(load(path), batches, names)

    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    names = [f.name for f in fields]
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, T.StructType(fields))


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return piece_tokens(read_table(spark, sf_dir, "documents"))
