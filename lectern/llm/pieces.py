"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A chunk of text starts as single characters. All adjacent pairs that spell a vocabulary piece wait in an agenda ordered by
score, then from the left; the best is merged, pairs that no longer stand are passed over, and new neighbours enter, until the
agenda is empty. What is left and not in the vocabulary falls back to its bytes.
Texts are cut into chunks only where no piece of the vocabulary can reach across (which is looked up in the vocabulary when it
is loaded: between other text and a blank, and around control characters), so chunks are encoded on their own and
remembered, up to a fixed number of characters (a longer chunk than KEPT is not). In every slice of an Arrow batch each chunk not remembered, and one whole text, is held
against the library; a difference fails the query.

Defined cases: null is the empty text, which has no ids and decodes to the empty text; U+2581 in a text counts as a blank, as
in the library; repeated rows give equal rows. The vocabulary file must lie at the same path on every executor.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, repeat
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import slices, table

BLANK = "▁"
#: Characters of the chunks remembered in one of two generations (some 30 bytes of memory each), and of the longest such chunk.
REMEMBERED, KEPT = 800_000, 256
#: Up to so many characters an agenda is a list, beyond a heap.
SHORT = 48
NEVER = float("inf")


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kind = model.normalizer_spec, pb2.ModelProto.SentencePiece
        normal = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        if model.trainer_spec.model_type != pb2.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError(f"{path}: not a merge-type vocabulary with byte fallback")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces or any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError(f"{path}: it normalises text or has pieces of its own kind")
        self.ids = {p: i for p, (i, _) in normal.items()}
        self.costs = {p: -score for p, (_, score) in normal.items() if len(p) > 1}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(a != BLANK and b == BLANK for p in normal for a, b in zip(p, p[1:], strict=False)):
            raise ValueError(f"{path}: a piece reaches across a blank")
        inner = set(chain.from_iterable(self.costs))
        apart = re.escape("".join(c for c in map(chr, range(32)) if c not in inner))
        self.cut = re.compile(f"{BLANK}+[^{BLANK}{apart}]*|[{apart}]|[^{BLANK}{apart}]+").findall
        self.digits = [str(i) for i in range(len(model.pieces))]

    def merged(self, chunk: str) -> tuple[int, ...]:
        """The ids of one chunk."""
        sym = self._by_list(chunk) if len(chunk) <= SHORT else self._by_heap(chunk)
        out = list(map(self.ids.get, sym))
        if None in out:
            out = list(chain.from_iterable([i] if i is not None else [self.bytes[b] for b in s.encode()] for s, i in zip(sym, out, strict=True)))
        return tuple(out)

    def _by_list(self, chunk: str) -> list[str]:
        """The agenda as a plain list, one cost for each adjacent pair; the first of the least ones is next."""
        get, sym = self.costs.get, list(chunk)
        agenda = list(map(get, map(add, sym, sym[1:]), repeat(NEVER)))
        while agenda and (least := min(agenda)) != NEVER:
            i = agenda.index(least)
            sym[i] = a = sym[i] + sym.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = get(a + sym[i + 1], NEVER)
            if i:
                agenda[i - 1] = get(sym[i - 1] + a, NEVER)
        return sym

    def _by_heap(self, chunk: str) -> list[str]:
        """The agenda as a heap of (cost, place, length); symbols are linked, a merged one leaves an empty one behind."""
        costs, sym, n = self.costs, list(chunk), len(chunk)
        agenda = [(c, i, 2) for i in range(n - 1) if (c := costs.get(chunk[i : i + 2])) is not None]
        heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            _, i, size = heappop(agenda)
            a, j = sym[i], after[i]
            if not a or j >= n or len(a) + len(sym[j]) != size:
                continue
            sym[i] = a = a + sym[j]
            sym[j], after[i] = "", (k := after[j])
            if k < n:
                before[k] = i
                if (c := costs.get(a + sym[k])) is not None:
                    heappush(agenda, (c, i, len(a) + len(sym[k])))
            if (h := before[i]) >= 0 and (c := costs.get(sym[h] + a)) is not None:
                heappush(agenda, (c, h, len(sym[h]) + len(a)))
        return [s for s in sym if s]


class Encoder:
    """Encodes texts; remembers the chunks of late, in two generations of bounded size."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.vocabulary, self.remembered = Vocabulary(path), remembered
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.held = 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        v = self.vocabulary
        cut = [v.cut(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        fresh, long = [], []
        for c in set(chain.from_iterable(cut)):
            if c not in self.young:
                if (known := self.old.get(c)) is None:
                    known = v.merged(c)
                    fresh.append(c)
                self.young[c] = known
                if len(c) > KEPT:
                    long.append(c)
                else:
                    self.held += len(c)
        self._check(fresh)
        get = self.young.__getitem__
        out = [list(chain.from_iterable(map(get, x))) for x in cut]
        for c in long:
            del self.young[c]
        if self.held > self.remembered:
            self.old, self.young, self.held = self.young, {}, 0
        return out

    def _check(self, chunks: list[str]) -> None:
        """Inside a text a chunk follows a control character or starts with a blank; either way the library can be asked for it alone."""
        lead = len(self.vocabulary.library.encode("\n", num_threads=1))
        blank = [c[0] == BLANK for c in chunks]
        said = self.vocabulary.library.encode([c.replace(BLANK, " ")[1:] if b else "\n" + c for c, b in zip(chunks, blank, strict=True)], num_threads=1)
        for c, b, ids in zip(chunks, blank, said, strict=True):
            if c != BLANK and tuple(ids if b else ids[lead:]) != self.young[c]:
                raise ValueError(f"the library encodes {c!r} otherwise")


@lru_cache(maxsize=2)
def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    return Encoder(path, remembered)


def _encoded(path: str, column: str, names: list[str], keep: bool, remembered: int = REMEMBERED):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, remembered)
        library, digits = e.vocabulary.library, e.vocabulary.digits
        for batch in slices(batches, column):
            texts = [t or "" for t in batch.column(column).to_pylist()]
            ids = e.encode(texts)
            if library.encode(texts[0], num_threads=1) != ids[0]:
                raise ValueError("the library encodes a text otherwise")
            back = library.decode(ids, num_threads=1) if ids else []
            sha = [hashlib.sha256(",".join(map(digits.__getitem__, x)).encode()).hexdigest() for x in ids]
            more = [pa.array(map(len, ids), pa.int64()), pa.array(sha), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back])]
            if keep:
                more += [pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())]
            rest = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != column]
            yield pa.RecordBatch.from_arrays([*rest, *more], names=names)

    return run


def encode_decode(docs: DataFrame, model: str, text: str = "text", keep: bool = True, remembered: int = REMEMBERED) -> DataFrame:
    """docs without the text, with n_tokens, ids_sha256, decoded_sha256 and, if keep, ids and decoded; columns of these names give way.

    remembered: characters of encoded chunks that a worker keeps; it changes the time, not the result."""
    made = ["n_tokens bigint", "ids_sha256 string", "decoded_sha256 string", *["ids array<int>", "decoded string"] * keep]
    names = [x.split()[0] for x in made]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in names])
    rest = [f for f in docs.schema.fields if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), *made])
    return docs.mapInArrow(_encoded(model, text, [*(f.name for f in rest), *names], keep, remembered), schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, model or default_model(), keep=False, remembered=8 * REMEMBERED)
