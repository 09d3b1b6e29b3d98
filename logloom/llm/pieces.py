"""SentencePiece encoding and decoding by shared-prefix Viterbi.

The distinct marked words of a batch, sorted, are a trie walked depth first: a word keeps the forward scores of the prefix that it shares
with the word before. At each character an automaton of all pieces gives those that end there, longest first.

A vocabulary of scored pieces (unigram): the forward score of a prefix is the greatest of any piece's score and the
forward score of what precedes it, a character without a piece counting as an unknown one; each prefix keeps its best path. Of paths of
equal scores the one whose last piece is the longest is taken (the library's own choice among them depends on how its 32-bit sums are rounded).

A merge vocabulary (BPE): the encoding of a prefix ends in one piece, the piece p for which the encoding of what precedes p ends in
a piece that p may follow, where q may be followed by p if merging alone turns the text q + p into q, p. All other paths score
nothing, so that the forward score is the last piece alone.
"""

import re
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from .common import quoted, release_memory, table

MARK = "▁"
#: The vocabulary file of op6 and the pipeline; a parameter of everything below.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
_CHUNK = 1 << 20  # characters whose distinct words are sorted at a time
_ROWS = 512  # rows encoded and passed on at a time
_WORDS, _PAIRS, _STEPS = 60_000, 1 << 18, 1 << 16  # words that a task, and pairs of pieces and steps of the automaton that a Python worker remembers at most
UNIGRAM, BPE = 1, 2  # model types
_UNKNOWN_COST = 10.0  # what an unknown character scores less than the worst piece


def _fields(data: bytes) -> dict[int, int | bytes]:
    """Fields of a protocol buffer by their numbers, the last of repeated ones: integers and bytes."""
    out, at = {}, 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            n |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return n

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            out[key >> 3] = number()
            continue
        size = number() if kind == 2 else 8 if kind == 1 else 4
        out[key >> 3] = data[at : at + size]
        at += size
    return out


class Vocabulary:
    """Pieces with their scores; read on the driver and broadcast: a few MB for any vocabulary of 100,000 pieces.

    Taken are unigram and merge vocabularies whose text is only marked: a mark before it, spaces as marks, nothing normalised.
    Others raise ValueError, rather than be encoded wrongly.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = m.get_piece_size()
        proto = _fields(m.serialized_model_proto())
        trainer, norm = _fields(proto.get(2, b"")), _fields(proto.get(3, b""))
        self.type = trainer.get(3, UNIGRAM)
        self.pieces = [m.id_to_piece(i) for i in range(n)]
        special = [m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i) for i in range(n)]
        self.id = {p: i for i, (p, s) in enumerate(zip(self.pieces, special, strict=True)) if not s}
        wrong = [
            (self.type not in (UNIGRAM, BPE), f"model type {self.type}: neither unigram nor BPE"), (bool(norm.get(2)), "it normalises characters"), (not norm.get(3, 1), "no mark before the text"),
            (bool(norm.get(4, 1)), "it removes spaces"), (not norm.get(5, 1), "spaces aren't marked"), (bool(trainer.get(24)), "marks end words"), (any(MARK in p.lstrip(MARK) for p in self.id), "pieces go from one word to the next"),
        ]
        if any(bad for bad, _ in wrong):
            raise ValueError(f"{model_file}: " + "; ".join(why for bad, why in wrong if bad))
        self.score = {p: m.get_score(i) for p, i in self.id.items()}
        self.scores = [m.get_score(i) for i in range(n)]
        self.worst = min(self.score.values(), default=0.0) - _UNKNOWN_COST
        self.unknown = m.unk_id()
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(n) if m.is_byte(i)}
        self.utf8 = [b"" if m.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.utf8[self.unknown] = " \u2047 ".encode()
        for b, i in self.byte.items():
            self.utf8[i] = bytes([b])
        self.as_bytes = [array("i", [i]).tobytes() for i in range(n)]
        self._automaton()
        joined = {c for p in self.id if len(p) > 1 for c in p}
        alone = "".join(re.escape(c) for c in "\n\t\r\x0b\x0c" if c not in joined)
        #: Nothing goes from a character that is no mark to a mark, nor over a character that stands alone.
        self.words = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else ""))
        #: Whether a piece may follow another, as learnt in this process; serves a worker's later tasks too.
        self.follows: dict[int, bool] = {}

    def _automaton(self) -> None:
        """step: state and character to state, for the trie of the pieces; fail: where to go on else; ends: (length, id) of the pieces that end at a state, longest first."""
        self.step, own, parent = {}, [None], [(0, 0)]
        for p, i in self.id.items():
            at = 0
            for c in p:
                key = at << 21 | ord(c)
                if key not in self.step:
                    self.step[key] = len(own)
                    own.append(None)
                    parent.append((at, ord(c)))
                at = self.step[key]
            own[at] = (len(p), i)
        depth, self.fail = [0] * len(own), [0] * len(own)
        for x in range(1, len(own)):  # a child comes after its parent
            depth[x] = depth[parent[x][0]] + 1
        self.ends: list[tuple] = [()] * len(own)
        for x in sorted(range(1, len(own)), key=depth.__getitem__):
            up, c = parent[x]
            if up:
                self.fail[x] = self._go(self.fail[up], c)
            self.ends[x] = ((own[x],) if own[x] else ()) + self.ends[self.fail[x]]
        self.trie = len(self.step)

    def _go(self, state: int, c: int) -> int:
        while True:
            nxt = self.step.get(state << 21 | c)
            if nxt is not None or not state:
                return nxt or 0
            state = self.fail[state]

    def __getstate__(self):
        return self.__dict__ | {"follows": {}}


def merge(v: Vocabulary, text: str) -> list[str]:
    """Plain merging: the best-ranked pair of neighbours, the leftmost of equals, becomes one piece, until none does."""
    s = list(text)
    while len(s) > 1:
        best, at = None, -1
        for i in range(len(s) - 1):
            r = v.score.get(s[i] + s[i + 1])
            if r is not None and (best is None or r > best):
                best, at = r, i
        if at < 0:
            break
        s[at : at + 2] = [s[at] + s[at + 1]]
    return s


class Encoder:
    def __init__(self, v: Vocabulary):
        self.v = v
        self.none = len(v.pieces)  # stands for the start of a word and for a character without a piece: neither merges with what follows
        self.follows = v.follows
        self.known: dict[str, bytes] = {}  # ids of 32 bits

    def _ids(self, c: str) -> bytes:
        """Ids of a character without a piece."""
        return array("i", [self.v.byte[b] for b in c.encode("utf-8", "replace")] if self.v.byte else [self.v.unknown]).tobytes()

    def _may_follow(self, q: int, p: int) -> bool:
        pieces = self.v.pieces
        ok = merge(self.v, pieces[p]) == [pieces[p]] if q == self.none else merge(self.v, pieces[q] + pieces[p]) == [pieces[q], pieces[p]]
        if len(self.follows) > _PAIRS:
            self.follows.clear()
        self.follows[q << 20 | p] = ok
        return ok

    def words(self, words: list[str]) -> None:
        """Encode sorted distinct words, depth first."""
        v, step, ends, none, known, unigram = self.v, self.v.step, self.v.ends, self.none, self.known, self.v.type == UNIGRAM
        room, as_bytes, follows = v.trie + _STEPS, v.as_bytes, self.follows.get
        # of each prefix: the automaton's state, its best path's last piece, score and ids
        states, last, score, paths = [0], [none], [0.0], [b""]
        before = ""
        for w in words:
            k, top = 0, min(len(w), len(before))
            while k < top and w[k] == before[k]:
                k += 1
            del states[k + 1 :], last[k + 1 :], score[k + 1 :], paths[k + 1 :]
            state = states[-1]
            for c in w[k:]:
                key = state << 21 | ord(c)
                state = step.get(key)
                if state is None:
                    state = v._go(key >> 21, ord(c))
                    if len(step) < room:
                        step[key] = state
                states.append(state)
                found = ends[state]
                if unigram:
                    n, p, best = self._best(found, score)
                    score.append(best)
                else:
                    for n, p in found:
                        at = last[-n] << 20 | p
                        ok = follows(at)
                        if ok or ok is None and self._may_follow(last[-n], p):
                            break
                    else:
                        n, p = 1, none
                last.append(p)
                paths.append(paths[-n] + (as_bytes[p] if p != none else self._ids(c)))
            before = w
            known[w] = paths[-1]

    def _best(self, ends: tuple, score: list[float]) -> tuple[int, int, float]:
        """(length, piece, forward score) of the best path that ends here; an unknown character where no piece here is one character. Of equals the longest."""
        scores, length, piece, best = self.v.scores, 0, self.none, -np.inf
        for n, p in ends:
            s = score[-n] + scores[p]
            if s > best:
                length, piece, best = n, p, s
        s = score[-1] + self.v.worst
        if (not ends or ends[-1][0] > 1) and s > best:
            return 1, self.none, s
        return length, piece, best

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; an empty text has none. Without byte pieces, unknown characters in a row are one id."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            end = size = 0
            for end in range(at, len(texts)):  # noqa: B007
                size += len(texts[end])
                if size >= _CHUNK:
                    break
            split = [self.v.words.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts[at : end + 1]]
            if len(self.known) > _WORDS:
                self.known.clear()
            self.words(sorted({w for words in split for w in words} - self.known.keys()))
            known = self.known.__getitem__
            for words in split:
                ids = np.frombuffer(b"".join(map(known, words)), np.int32)
                if not self.v.byte and len(ids):
                    un = ids == self.v.unknown
                    ids = ids[~np.r_[False, un[1:] & un[:-1]]]
                out.append(ids)
            at = end + 1
        return out


def decode(v: Vocabulary, ids) -> str:
    """The text of ids: marks are spaces, bytes are put together (U+FFFD where they are not UTF-8), the first mark goes, control ids are nothing."""
    text = b"".join(map(v.utf8.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def vocabulary(spark: SparkSession, model_file: str = MODEL_FILE):
    return spark.sparkContext.broadcast(Vocabulary(model_file))


def encode(docs: DataFrame, vocab, text_col: str = "text", ids_col: str = "ids", check_col: str = "round_trip", keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs, or its columns `keep`, with `ids` (array of int) and `round_trip`, whether decoding gives the text again, a mark in a text being a space; in place of columns of these names.

    Null and empty texts have no ids. A row for each row; no shuffle. A broken task starts anew from its
    input; its memory is one Arrow batch of its input, _ROWS rows of its output, and what it remembers of words.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (ids_col, check_col)]
    rows = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(kept)], quoted(text_col).alias("text"))
    schema = StructType([*[StructField(f.name, f.dataType) for f in rows.schema.fields[:-1]], StructField("ids", ArrayType(IntegerType(), False)), StructField("same", BooleanType())])

    def run(batches):
        import pyarrow as pa

        release_memory()
        v = vocab.value
        e = Encoder(v)  # keeps what is learnt about words from batch to batch
        for batch in batches:
            for k in range(0, batch.num_rows, _ROWS):
                part = batch.slice(k, _ROWS)
                texts = [t or "" for t in part.column(len(kept)).to_pylist()]
                ids = e.texts(texts)
                same = [decode(v, i.tolist()) == t.replace(MARK, " ") for i, t in zip(ids, texts, strict=True)]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(kept))], lists, pa.array(same, pa.bool_())], names=[*[f"c{i}" for i in range(len(kept))], "ids", "same"])

    return rows.mapInArrow(run, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.col("ids").alias(ids_col), F.col("same").alias(check_col))


def decoded(rows: DataFrame, vocab, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with the text of their ids; null ids give null."""

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        return pd.Series([None if i is None else decode(vocab.value, i.tolist()) for i in ids], dtype=object)

    return rows.withColumn(text_col, run(quoted(ids_col)))


def op6(spark, sf_dir, model_file: str = MODEL_FILE):
    """(doc_id, n_ids, ids, round_trip), a row for each row of documents, null ids and repeated rows included; null and empty texts: no ids."""
    vocab = vocabulary(spark, model_file)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, vocab, keep=("doc_id",)).select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")
