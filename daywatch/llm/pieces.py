"""SentencePiece merges with a score-ordered agenda, in Arrow batches.

The agenda holds the adjacent pairs whose joined string is a piece, best score first,
then leftmost.  For a long text it is a heap over a linked list of symbols, and a popped
pair is merged when both nodes still hold what they held when it was pushed; for a short
one it is a list that is searched.  Symbols that are no piece fall back to byte pieces.

A text is cut where no merge can cross: between two characters that are neighbours in
no piece (`cuts` derives such places from the vocabulary).  Cuts repeat a lot: their ids are kept in a bounded table, and
each batch's new cuts are checked with the sentencepiece library before use.
"""

from __future__ import annotations

import hashlib
import re
import string
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from daywatch.llm.common import text_of

MARK = "▁"
SHORT, NEVER = 24, float("inf")      # cuts whose agenda is a list; the score of no piece
SCHEMA = ("doc_id bigint, n_tokens bigint, ids array<int>, decoded string, n_corrected int")


def model_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces, scores and byte pieces of a merge-type model."""

    def __init__(self, path: str | None = None):
        import sentencepiece
        self.library = p = sentencepiece.SentencePieceProcessor(model_file=model_path(path))
        n = p.get_piece_size()
        self.unknown = p.unk_id()
        self.rank: dict[str, tuple[float, int]] = {}
        self.bytes: dict[int, int] = {}
        for i in range(n):
            s = p.id_to_piece(i)
            if p.is_byte(i):
                self.bytes[int(s[3:5], 16)] = i
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                self.rank[s] = (-p.get_score(i), i)
        self.cost = {s: score for s, (score, _) in self.rank.items()}
        self.cut = re.compile(self.cuts())

    def cuts(self) -> str:
        """Where no merge can cross: between characters that are neighbours in no piece.

        Used are line feeds, places before a run of blank marks, and places between a
        word and the punctuation that touches no letter in any piece.
        """
        near = {pair for s in self.rank for pair in zip(s, s[1:])}
        if any(b == MARK and a != MARK for a, b in near):
            return r"(?s).+"
        if any("\n" in pair for pair in near):
            return f"(?s){MARK}+[^{MARK}]*|[^{MARK}]+"
        touching = {a for a, b in near if b.isalnum()} | {b for a, b in near if a.isalnum()}
        alone = "".join(re.escape(c) for c in string.punctuation if c != "_" and c not in touching)
        rest = f"{MARK}*[^{MARK}\n]+|{MARK}+"
        if not alone:
            return rf"\n|{rest}"
        word = r"[^\W_]"
        # a whole run of either kind, when what follows cannot merge with it
        return (rf"\n|{MARK}*{word}+(?![^{MARK}\n{alone}])|[{alone}]+(?![^{MARK}\n\w]|_)|{rest}")

    def fallback(self, symbol: str) -> list[int]:
        if len(self.bytes) < 256:
            return [self.unknown]
        return [self.bytes[b] for b in symbol.encode("utf-8", "surrogatepass")]

    def encode_cut(self, text: str) -> tuple[int, ...]:
        """Ids of one cut, blanks already written as marks."""
        find, n = self.rank.get, len(text)
        symbols = self.merged(text) if n <= SHORT else self.merged_by_heap(text)
        ids = []
        for s in symbols:
            found = find(s)
            if found:
                ids.append(found[1])
            else:
                ids.extend(self.fallback(s))
        return tuple(ids)

    def merged(self, text: str) -> list[str]:
        """The symbols of a short cut: its agenda is a list of scores, one per adjacent pair,
        whose least entry (the leftmost of equals) is next."""
        cost, none = self.cost.get, NEVER
        symbols = list(text)
        agenda = [cost(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == none:
                break
            i = agenda.index(best)
            symbols[i] += symbols[i + 1]
            del symbols[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = cost(symbols[i] + symbols[i + 1], none)
            if i:
                agenda[i - 1] = cost(symbols[i - 1] + symbols[i], none)
        return symbols

    def merged_by_heap(self, text: str) -> list[str]:
        """The symbols of a cut of any length: the agenda is a heap over a linked list."""
        find, n = self.rank.get, len(text)
        symbols = list(text)
        right = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        agenda = [(found[0], i, pair) for i in range(n - 1)
                  if (found := find(pair := text[i:i + 2]))]
        heapify(agenda)
        while agenda:
            _, i, pair = heappop(agenda)
            a = symbols[i]
            j = right[i]
            if a is None or j >= n or len(a) >= len(pair) or a + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                joined = pair + symbols[k]
                found = find(joined)
                if found:
                    heappush(agenda, (found[0], i, joined))
            h = left[i]
            if h >= 0:
                joined = symbols[h] + pair
                found = find(joined)
                if found:
                    heappush(agenda, (found[0], h, joined))
        return [s for s in symbols if s is not None]


class Encoder:
    """Encodes texts cut by cut.

    Known cuts lie in two tables of at most `keep` entries: when the younger is full it
    becomes the older, and cuts met again move on, so frequent ones stay.
    """

    def __init__(self, path: str | None = None, keep: int = 500_000, short: int = 48):
        self.vocabulary, self.keep, self.short = Vocabulary(path), keep, short
        self.known: dict[str, str] = {}      # ids as text, joined by commas
        self.older: dict[str, str] = {}
        self.corrected = 0

    def learn(self, cuts: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of new cuts, each compared with the library's; the library's ids win."""
        v = self.vocabulary
        new = {c: v.encode_cut(c) for c in cuts}
        # the library writes a mark before a text, so a cut that starts with one drops it;
        # other cuts follow a line feed, whose ids (mark, line feed) are dropped again
        marked = [c for c in new if c[0] == MARK]
        other = [c for c in new if c[0] != MARK]
        theirs = v.library.encode([c[1:].replace(MARK, " ") or "" for c in marked], num_threads=1)
        for c, ids in zip(marked, theirs):
            if len(c) > 1 and tuple(ids) != new[c]:
                self.corrected, new[c] = self.corrected + 1, tuple(ids)
        lead = v.library.encode("\n")
        theirs = v.library.encode(["\n" + c for c in other], num_threads=1)
        for c, ids in zip(other, theirs):
            if tuple(ids[:len(lead)]) == tuple(lead) and tuple(ids[len(lead):]) != new[c]:
                self.corrected, new[c] = self.corrected + 1, tuple(ids[len(lead):])
        return new

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [numbers(line).tolist() for line in self.lines(texts)]

    def lines(self, texts: list[str]) -> list[str]:
        """Each text's ids, joined by commas."""
        find = self.vocabulary.cut.findall
        if len(self.known) > self.keep:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        rows, extra, step = [], {}, 256
        for at in range(0, len(texts), step):
            cut = [find(MARK + t.replace(" ", MARK)) if t else [] for t in texts[at:at + step]]
            new = set(chain.from_iterable(cut)).difference(known)
            if new:
                old = {c: older[c] for c in new if c in older}
                known.update(old)
                got = self.learn(new.difference(old))
                for c, ids in got.items():
                    (extra if len(c) > self.short else known)[c] = ",".join(map(str, ids))
            if extra:
                rows.extend(",".join([extra[c] if len(c) > self.short else known[c] for c in cuts])
                            for cuts in cut)
                extra = {}
            else:
                rows.extend(",".join(map(known.__getitem__, cuts)) for cuts in cut)
        return rows

    def decode(self, ids: list[int]) -> str:
        return self.decode_all([ids])[0]

    def decode_all(self, rows: list[list[int]]) -> list[str]:
        return self.vocabulary.library.decode(rows, num_threads=1) if rows else []


def numbers(line: str) -> np.ndarray:
    """The ids of a line."""
    return np.fromstring(line, np.int32, sep=",") if line else np.empty(0, np.int32)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str | None, keep: int) -> Encoder:
    """One encoder per worker process; workers are reused."""
    if (path, keep) not in _ENCODERS:
        _ENCODERS[path, keep] = Encoder(path, keep)
    return _ENCODERS[path, keep]


def _batches(batches, path, keep, digest, release=False):
    enc = Encoder(path, keep) if release else encoder(path, keep)
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            before = enc.corrected
            lines = enc.lines(batch.column(1).to_pylist())
            ids = list(map(numbers, lines))
            size = np.array([len(x) for x in ids], np.int64)
            decoded = enc.decode_all([x.tolist() for x in ids])
            out = {"doc_id": batch.column(0), "n_tokens": pa.array(size)}
            if digest:
                out["ids_sha256"] = pa.array(map(_sha, lines), pa.string())
                out["decoded_sha256"] = pa.array(map(_sha, decoded), pa.string())
            else:
                out["ids"] = pa.ListArray.from_arrays(
                    np.concatenate(([0], np.cumsum(size))).astype(np.int32), pa.array(np.concatenate(ids)))
                out["decoded"] = pa.array(decoded, pa.string())
            n = enc.corrected - before
            out["n_corrected"] = pa.array([n if i == 0 else 0 for i in range(len(lines))], pa.int32())
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     path: str | None = None, keep: int = 500_000,
                     digest: bool = False, release: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids, decoded (or their SHA-256), n_corrected.

    Whole texts; a null or empty text has no ids and decodes to an empty text.  No
    begin or end ids.  A map without a shuffle: rows stay where they are, repeated rows
    and null ids included.  n_corrected counts, on the first row of a batch, the new
    cuts whose ids the library would not give: 0 unless the agenda is wrong.

    A worker process keeps its vocabulary and its table of known cuts for its next task;
    with `release` both go with the task, for jobs whose other stages use the same workers.
    """
    schema = ("doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, "
              "n_corrected int") if digest else SCHEMA
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _batches(it, path, keep, digest, release), schema)
