"""Operator 4: SentencePiece encoding and decoding with shared prefixes.

Words are marked (blanks become U+2581, one is put in front) and distinct words
of a batch, sorted, form a trie; a depth-first walk keeps one forward state per letter on its
path, so words with a common prefix share the states of that prefix.

Unigram models: the state is the best score of any segmentation that ends there, and
the piece that ends it (Viterbi).  BPE models have no additive score, but have a forward state too:
the BPE encoding of a prefix is fixed, and the encoding of a longer one is the
encoding of a shorter one plus one piece p exactly if the pair (last piece, p) stays as it is when
encoded alone, since a merge across the boundary would show in the pair.  So the state is
the last piece, exactly one piece fits at each letter, and the walk gives the library's own result.

No piece crosses from a letter to a blank (checked when the model is read), so words are
independent; punctuation ends a word too where no piece holds it after the character before.  A worker keeps at most ``CACHE`` encoded words; texts of any length are cut into words first
and a word of any length is walked letter by letter, with one reference to a piece held for each letter.

Defined cases.  A null text encodes to null ids and decodes to null; an empty one to no ids and an empty text.
U+2581 in a text decodes to a blank, as in the library; any other text comes back
exactly.  Characters without a piece become byte pieces, or the unknown id where the
model has none.  Ids are not read, repeated rows are rows of their own; an empty table gives an
empty result.  Extra columns stay with ``encode``, in front, save that a clashing ``ids`` is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Encoded words that a worker keeps, and the longest of them.
CACHE, LONGEST = 150_000, 64
#: Pairs that a worker keeps.
PAIRS = 300_000
#: Texts and letters that are encoded together.
ROWS, LETTERS = 1024, 4_000_000
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_models: dict = {}


def shared_letters(a: str, b: str) -> int:
    """How many letters two words begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


class Pieces:
    """A unigram or BPE model with identity normalisation."""

    def __init__(self, blob: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        p = pb.ModelProto()
        p.ParseFromString(blob)
        spec, norm = p.trainer_spec, p.normalizer_spec
        if {x.type for x in p.pieces} & {4, 5}:
            raise ValueError("models with user-defined or unused pieces aren't read: they cut texts by other rules")
        if spec.model_type not in (1, 2) or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.treat_whitespace_as_suffix:
            raise ValueError("only unigram and BPE models with identity normalisation are read")
        self.bpe, self.dummy = spec.model_type == 2, norm.add_dummy_prefix
        self.text = [x.piece for x in p.pieces]
        self.ids = {x.piece: i for i, x in enumerate(p.pieces) if x.type == 1}
        self.score = {x.piece: x.score for x in p.pieces if x.type == 1}
        self.bytes = {int(x.piece[1:-1], 16): i for i, x in enumerate(p.pieces) if x.type == 6}
        self.unknown = next(i for i, x in enumerate(p.pieces) if x.type == 2)
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.control = {i for i, x in enumerate(p.pieces) if x.type == 3}
        if any(re.search(f"[^{MARK}]{MARK}", x) for x in self.ids):
            raise ValueError("a piece crosses from a letter to a blank")
        self.longest = max(map(len, self.ids))
        # a word also ends before punctuation, and around line ends, where no piece holds the two characters together
        held = {(a, b) for x in self.ids for a, b in pairwise(x)}
        lines = "".join(c for c in "\n\t\r" if not any(c in h for h in held))
        marks, was = set(PUNCTUATION), None
        while marks != was:  # leaving a mark out puts it among the characters before others
            was = set(marks)
            ahead = {c: {x for x, y in held if y == c and x != MARK and x not in was} for c in was}
            marks = {c for c in was if len(ahead[c]) <= 20}
        risky = {x for c in marks for x in ahead[c]}
        marks = "".join(sorted(marks))
        e, m = re.escape(lines), re.escape(marks)
        ends = f"[{e}]|" if e else ""
        self.plain = re.compile(f"{ends}{MARK}+[^{MARK}{e}]*|[^{MARK}{e}]+")
        self.fast = re.compile(f"{ends}{MARK}*[{m}]*[^{MARK}{e}{m}]+|{MARK}*[{m}]+|{MARK}+") if m else self.plain
        #: Characters that a piece holds before punctuation; texts with one are cut at blanks only.
        self.risky = re.compile(f"[{re.escape(''.join(sorted(risky)))}]" if risky else "(?!)")
        #: Text of each id by itself; ids of bytes beyond ASCII must be joined before they are text.
        self.shown = [" ⁇ " if i == self.unknown else "" if i in self.control else x.replace(MARK, " ") for i, x in enumerate(self.text)]
        for b, i in self.bytes.items():
            self.shown[i] = chr(b) if b < 128 else "\ufffd"
        self.joined = frozenset(i for b, i in self.bytes.items() if b >= 128)
        self.codes = {x: (i,) for x, i in self.ids.items()}
        self.floor = min(self.score.values()) - 10
        #: Every beginning of a piece, so that a search for longer pieces can end early; by last letters.
        self.endings = {x[i:] for x in self.ids for i in range(len(x))}
        self.kept: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def marked(self, text: str) -> str:
        return (MARK if self.dummy else "") + text.replace(" ", MARK)

    def cut(self, marked: str) -> list[str]:
        """The words of a marked text; together they are the text."""
        return (self.plain if self.plain is self.fast or self.risky.search(marked) else self.fast).findall(marked)

    def merged(self, word: str) -> list[str]:
        """BPE by its definition: merge the best-scored pair, leftmost first, until none is a piece. For short strings."""
        parts, score = list(word), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stays(self, last: str, piece: str) -> bool:
        """Whether piece follows last in an encoding ('' begins one)."""
        key = last, piece
        if (found := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(last + piece) == ([last, piece] if last else [piece])
        return found

    def walk(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """(word, pieces) of sorted distinct words under a unigram model: forward scores of a shared prefix are computed once."""
        ends: list[tuple[float, str]] = [(0.0, "")]  # after i letters: best score and its last piece
        ids, score, top, endings = self.ids, self.score, self.longest, self.endings
        before = ""
        for word in words:
            n = shared_letters(word, before)
            del ends[n + 1 :]
            for i in range(n + 1, len(word) + 1):
                best = None
                for j in range(i - 1, max(0, i - top) - 1, -1):
                    piece = word[j:i]
                    if piece in ids or j == i - 1:
                        s = ends[j][0] + score.get(piece, self.floor)
                        if best is None or s >= best[0]:  # of equal scores the longest last piece, as in the library
                            best = s, piece
                    elif piece not in endings:
                        break  # no longer piece ends like this
                ends.append(best)
            before = word
            out, i = [], len(word)
            while i:
                out.append(ends[i][1])
                i -= len(ends[i][1])
            yield word, out[::-1]

    def bpe_walk(self, words: list[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """(word, ids) of sorted distinct words under a BPE model: the last pieces of a shared prefix are computed once.

        A letter's state is one piece; ids are gathered backwards from the word's end, a piece at a time.
        """
        last: list[str] = [""]  # after i letters: the encoding's last piece
        ids, code, pair, stays = self.ids, self.codes.get, self.pairs.get, self.stays
        before = ""
        for word in words:
            n = shared_letters(word, before)
            del last[n + 1 :]
            for i in range(n + 1, len(word) + 1):
                j = i - 1
                piece = word[j]  # a letter may stand alone; longer ones must be pieces, and exactly one of all fits
                while True:
                    ok = pair((last[j], piece))
                    if ok or (ok is None and stays(last[j], piece)):
                        break
                    j -= 1
                    while j >= 0 and (piece := word[j:i]) not in ids:
                        j -= 1
                    if j < 0:
                        raise ValueError(f"no piece ends {word[:i][-80:]!r}: not a BPE vocabulary")
                last.append(piece)
            before = word
            i, out = len(word), []
            while i:
                piece = last[i]
                out.append(code(piece) or self.numbered([piece]))
                i -= len(piece)
            yield word, tuple(chain.from_iterable(reversed(out)))

    def coded(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of sorted distinct words."""
        if self.bpe and self.bytes:
            return dict(self.bpe_walk(words))
        if self.bpe:
            return {w: self.numbered(self.merged(w)) for w in words}
        return {w: self.numbered(ps) for w, ps in self.walk(words)}

    def numbered(self, pieces: list[str]) -> tuple[int, ...]:
        out: list[int] = []
        for x in pieces:
            if (i := self.ids.get(x)) is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in x.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:  # a run of unknown characters is one id
                out.append(self.unknown)
        return tuple(out)

    def encode_batch(self, texts: list[str | None]) -> list[list[int] | None]:
        """Words that are known are looked up; the rest of the batch is walked once, sorted. Words seen at least twice in it are kept."""
        out: list[list[int] | None] = []
        open_: list[tuple[int, list[str], list]] = []
        fresh: Counter = Counter()
        known = self.kept.get
        for t in texts:
            if not t:
                out.append(None if t is None else [])
                continue
            ws = self.cut(self.marked(t))
            got = list(map(known, ws))
            if None in got:
                fresh.update([w for w, x in zip(ws, got, strict=True) if x is None])
                open_.append((len(out), ws, got))
                out.append(None)
            else:
                out.append(list(chain.from_iterable(got)))
        own = self.coded(sorted(fresh))
        for i, ws, got in open_:
            out[i] = list(chain.from_iterable([own[w] if x is None else x for w, x in zip(ws, got, strict=True)]))
        again = {w: own[w] for w, n in fresh.items() if n > 1 and len(w) <= LONGEST}
        if len(self.kept) + len(again) > CACHE:
            self.kept.clear()
        if len(again) <= CACHE:
            self.kept.update(again)
        return out

    def decode(self, ids: list[int] | None) -> str | None:
        """The text of ids: control pieces vanish, byte pieces join to UTF-8."""
        if ids is None:
            return None
        if self.joined.isdisjoint(ids):
            done = "".join(map(self.shown.__getitem__, ids))
        else:
            out, raw, of_byte = [], bytearray(), self.of_byte
            for i in ids:
                if (b := of_byte.get(i)) is not None:
                    raw.append(b)
                    continue
                if raw:
                    out.append(raw.decode("utf-8", "replace"))
                    raw.clear()
                out.append(self.shown[i])
            if raw:
                out.append(raw.decode("utf-8", "replace"))
            done = "".join(out).replace(MARK, " ")
        return done[1:] if self.dummy and done.startswith(" ") else done


def batches_of(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of at most ROWS texts and about LETTERS letters (or one longer text)."""
    held, letters = [], 0
    for t in texts:
        n = len(t or "")
        if held and (len(held) >= ROWS or letters + n > LETTERS):
            yield held
            held, letters = [], 0
        held.append(t)
        letters += n
    if held:
        yield held


def model(blob: bytes) -> Pieces:
    key = hash(blob)
    if key not in _models:
        _models[key] = Pieces(blob)
    return _models[key]


def _blob(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


IDS = T.ArrayType(T.IntegerType())


def encode(docs: DataFrame, text_col: str = "text", model_path: str = MODEL) -> DataFrame:
    """docs with a column ``ids``, the model's encoding of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(_blob(model_path))
    rest = docs.drop("ids")
    out = T.StructType([*rest.schema.fields, T.StructField("ids", IDS)])
    at = rest.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(shared.value)
        for b in batches:
            i = 0
            for texts in batches_of(b.column(at).cast(pa.string()).to_pylist()):
                part = b.slice(i, len(texts))
                i += len(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(m.encode_batch(texts), pa.list_(pa.int32()))], out.names)

    return rest.mapInArrow(run, out)


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model_path: str = MODEL) -> DataFrame:
    """df with the text of the ids as ``out_col``."""
    shared = df.sparkSession.sparkContext.broadcast(_blob(model_path))
    rest = df.drop(out_col)
    out = T.StructType([*rest.schema.fields, T.StructField(out_col, T.StringType())])
    at = rest.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(shared.value)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([m.decode(x) for x in part.column(at).to_pylist()], pa.string())], out.names)

    return rest.mapInArrow(run, out)


def round_trips(docs: DataFrame, text_col: str = "text", model_path: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_ids, round_trip): each text's encoding, its length, and whether decoding it gives the text again.

    Encodes and decodes in one pass, so that ids needn't go through the JVM twice.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_blob(model_path))
    kind = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(shared.value)
        for b in batches:
            i = 0
            for texts in batches_of(b.column(1).to_pylist()):
                ids = m.encode_batch(texts)
                back = [m.decode(x) == (t if t is None else t.replace(MARK, " ")) for x, t in zip(ids, texts, strict=True)]
                own = b.column(0).slice(i, len(texts))
                i += len(texts)
                n = [None if x is None else len(x) for x in ids]
                yield pa.RecordBatch.from_arrays([own, pa.array(ids, kind.field(1).type), pa.array(n, pa.int64()), pa.array(back, pa.bool_())], schema=kind)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_ids long, round_trip boolean")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(spark.read.parquet(f"{sf_dir}/documents.parquet"))
