"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies with a score-ordered agenda.

A text is cut where no piece of the vocabulary can span (before a space, around a line feed). Each distinct cut is
encoded once per worker by an agenda of adjacent symbol pairs: the best-scored pair, leftmost among equals, is merged
until no pair is a piece; symbols that are no piece become bytes. The decoded text is put together from the ids. All new
cuts of an Arrow batch are encoded and decoded by the sentencepiece library too, and any difference stops the job. The
cache of cuts is bounded (the half that came last goes when it is full), so memory does not grow with the corpus.

Nulls count as empty texts: no ids. Very long words take n log n time. Extra columns are ignored; an empty table gives
an empty result; repeated rows are repeated in the result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches

META = "▁"
#: Most cuts that a worker keeps, about 250 bytes each; when full, the half that came last goes.
CACHE_CUTS = 400_000
#: New cuts that are compared with the library at once.
CHECKED_CUTS = 4096
#: Cuts up to this many symbols keep their agenda in a list.
FEW = 40
NEVER = float("-inf")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A merge-type vocabulary read from a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.surface: list[bytes | str] = []
        self.byte = [0] * 256
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.surface.append("")
            else:
                self.ids[piece], self.scores[piece] = i, sp.get_score(i)
                self.surface.append(piece.replace(META, " "))
        spans = [p for p in self.ids if len(p) > 1 and ("\n" in p or re.search(f"[^{META}]{META}", p))]
        if spans:
            raise ValueError(f"pieces span the cuts of a text: {spans[:3]}")
        before: dict[str, set[str]] = {}
        for p in self.ids:
            for x, y in zip(p, p[1:]):
                before.setdefault(y, set()).add(x)
        #: Marks at the end of a word that no piece joins to a letter: the word is cut before them.
        self.marks = "".join(c for c in ".,!%*&$#|;:?" if not any(x.isalpha() for x in before.get(c, ())))
        self.known, self.bare = Cuts(self, META), Cuts(self, "")
        self.fresh: list[str] = []
        #: The bytes that each id, written in decimals, stands for.
        self.bytes_of = {str(i): s if isinstance(s, bytes) else s.encode() for i, s in enumerate(self.surface)}

    def encode_cut(self, cut: str) -> list[int]:
        """Ids of a stretch of escaped text (spaces as U+2581)."""
        out: list[int] = []
        for s in self._merge_few(cut) if len(cut) <= FEW else self._merge_many(cut):
            if (i := self.ids.get(s)) is not None:
                out.append(i)
            else:
                out += [self.byte[b] for b in s.encode()]
        return out

    def _merge_few(self, cut: str) -> list[str]:
        """The agenda as a list in text order: its best entry is found by looking at all."""
        score, sym = self.scores.get, list(cut)
        agenda = [score(a + b, NEVER) for a, b in zip(sym, sym[1:])]
        while agenda and (best := max(agenda)) > NEVER:
            i = agenda.index(best)
            sym[i] = pair = sym[i] + sym.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = score(sym[i - 1] + pair, NEVER)
            if i < len(agenda):
                agenda[i] = score(pair + sym[i + 1], NEVER)
        return sym

    def _merge_many(self, cut: str) -> list[str]:
        """The agenda as a heap over linked symbols."""
        scores = self.scores
        sym: list[str | None] = list(cut)
        n = len(sym)
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = []
        for i in range(n - 1):
            if (s := scores.get(pair := sym[i] + sym[i + 1])) is not None:
                agenda.append((-s, i, i + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, pair = heapq.heappop(agenda)
            if sym[i] is None or sym[j] is None or nxt[i] != j or len(sym[i]) + len(sym[j]) != len(pair):
                continue
            sym[i], sym[j] = pair, None
            nxt[i] = k = nxt[j]
            if k >= 0:
                prev[k] = i
                if (s := scores.get(more := pair + sym[k])) is not None:
                    heapq.heappush(agenda, (-s, i, k, more))
            if (h := prev[i]) >= 0 and (s := scores.get(more := sym[h] + pair)) is not None:
                heapq.heappush(agenda, (-s, h, i, more))
        return [s for s in sym if s is not None]

    def decode_ids(self, ids: str) -> str:
        """The text of ids (decimals joined by commas) with every leading space kept."""
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""

    def _learn(self, cut: str) -> str:
        self.fresh.append(cut)
        return ",".join(map(str, self.encode_cut(cut)))

    def encode_decode(self, text: str) -> tuple[str, str]:
        """Ids joined by commas, and the decoded text."""
        if not text:
            return "", ""
        known, bare, ids = self.known.__getitem__, self.bare.__getitem__, []
        for k, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if k:
                ids.append(bare("\n"))
            if "" in words or META in line:
                escaped = (META if k == 0 else "") + line.replace(" ", META)
                ids += map(bare, re.findall(f"{META}*[^{META}]+|{META}+", escaped))
            elif k == 0:
                ids += map(known, words)
            else:
                ids.append(bare(words[0]))
                ids += map(known, words[1:])
        joined = ",".join(ids)
        return joined, self.decode_ids(joined)[1:]  # the space before the text is dropped

    def check(self) -> None:
        """Compare the new cuts with the library, then shorten the cache if it is full."""
        fresh, self.fresh = [c for c in self.fresh if c != "\n"], []
        for at in range(0, len(fresh), CHECKED_CUTS):
            some = fresh[at : at + CHECKED_CUTS]
            ids = self.library.encode("\n" + "\n".join(some).replace(META, " "), num_threads=1)
            if ids[1:] != self._own(some) or self.library.decode(ids) != self.decode_ids(",".join(map(str, ids)))[1:]:
                raise RuntimeError(f"not as the library encodes one of {some[:20]!r}")
        for held in (self.known, self.bare):
            if len(held) > CACHE_CUTS:  # frequent cuts came early
                first = list(islice(held.items(), CACHE_CUTS // 2))
                held.clear()
                held.update(first)

    def _own(self, fresh: list[str]) -> list[int]:
        feed = self.byte[10]
        got = [self.known.get(c[1:]) if c[0] == META and c[1:] in self.known else self.bare[c] for c in fresh]
        return [int(i) for x in got for i in (feed, *x.split(","))]


class Cuts(dict):
    """Ids of cuts, joined by commas, worked out when first asked for. lead stands before every key."""

    def __init__(self, pieces: Pieces, lead: str):
        super().__init__()
        self.pieces, self.lead = pieces, lead

    def __missing__(self, key: str) -> str:
        stem = key.rstrip(self.pieces.marks)
        if stem and len(stem) < len(key) and stem[-1].isalpha():
            got = f"{self[stem]},{self.pieces.bare[key[len(stem) :]]}"
        else:
            got = self.pieces._learn(self.lead + key)
        self[key] = got
        return got


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_decode(docs: DataFrame, model: str | None = None, digests: bool = True) -> DataFrame:
    """doc_id, n_tokens and either digests (ids_sha256, decoded_sha256) or ids (array of int) and decoded text.

    model is the path of a SentencePiece file that every worker can read (default: the installed public one)."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pieces(model or default_model())
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, a, b = [], [], []
                for text in part.column(1):
                    ids, back = vocab.encode_decode(text.as_py() or "")
                    n.append(ids.count(",") + 1 if ids else 0)
                    if digests:
                        a.append(hashlib.sha256(ids.encode()).hexdigest())
                        b.append(hashlib.sha256(back.encode("utf-8", "replace")).hexdigest())
                    else:
                        a.append([int(i) for i in ids.split(",")] if ids else [])
                        b.append(back)
                vocab.check()
                first = pa.array(a, pa.string() if digests else pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), first, pa.array(b, pa.string())], names=["k", "n", "a", "b"])

    rows = docs.select("doc_id", "text").mapInArrow(run, f"k {kind}, n bigint, a {'string' if digests else 'array<int>'}, b string")
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    return rows.select(F.col("k").alias("doc_id"), F.col("n").alias("n_tokens"), F.col("a").alias(names[0]), F.col("b").alias(names[1]))
