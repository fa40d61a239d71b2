"""SentencePiece encoding and decoding with a public BPE model, as a max-plus parallel scan.

A sequence of pieces is what byte-pair merging yields for its text exactly when each piece merges to itself and each
two neighbours merge to themselves. So encoding is a best-path problem: from piece to following piece the weight is 0
if they may stand side by side, and minus infinity if not. One path is left, and it is found without merging.

A giant document is split into chunks. At a border that a piece could span, the states are the pieces that may hold
the border; where none can (before a word mark, at a character of no piece) there is one. A chunk yields a max-plus
transfer matrix from the states of its left border to those of its right one, matrices are combined associatively
along the document, and each chunk is traced back on its own once the states of its borders are known. Chunks are
tasks' rows, matrices are all that meets; other documents are encoded whole in one pass, by the same path rule, where
words that repeat are looked up in a bounded cache.

Pieces, scores and text normalisation come from the model file, whose path is a parameter; nothing is trained.
Characters of no piece become byte pieces. Decoding joins pieces and bytes, and drops the one leading blank that
encoding adds. Null texts give null ids, empty texts no ids. Texts with U+2581, which the format reads as a blank,
do not come back the same. Repeated rows are encoded each; other columns pass through, but token_ids and n_tokens
are replaced, and decoded where the decoded text is asked for.
"""

from __future__ import annotations

import re
from itertools import accumulate
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from loomery.runtime import Scratch, released, unused

MARK = "▁"
GIANT = 65_536
CHUNK = 16_384
#: Words in the cache at most, characters of a word that it may hold, and bits of the pairs' slots.
_CACHE = 200_000
WORD = 40
_PAIR_BITS = 20
_loaded: dict[str, Codec] = {}


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words as rows (0 behind their ends), plus one, and their lengths."""
    lens = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.zeros((len(words), int(lens.max(initial=0))), dtype=np.uint64)
    out[np.arange(out.shape[1])[None, :] < lens[:, None]] = flat + np.uint64(1)
    return out, lens


_BASE = 0x9E3779B97F4A7C15


class _Lookup:
    """Pieces' numbers by hash of their characters, for whole arrays: each piece lies in one of two slots."""

    BITS = 19

    def __init__(self, pieces: list[str]):
        self.up = np.array([pow(_BASE, k, 1 << 64) for k in range(WORD + 1)], dtype=np.uint64)
        inverse = pow(_BASE, -1, 1 << 64)
        self.down = np.array([pow(inverse, k, 1 << 64) for k in range(WORD + 1)], dtype=np.uint64)
        x, lens = _matrix(pieces)
        h = (x * self.up[: x.shape[1]]).sum(axis=1, dtype=np.uint64)
        for seed in range(1, 100):
            self.mul = [np.uint64((0xD6E8FEB86659FD93 * (2 * seed + k) | 1) & (2**64 - 1)) for k in (0, 1)]
            self.keys, self.numbers = np.zeros(2 << self.BITS, dtype=np.uint64), np.full(2 << self.BITS, -1, dtype=np.int32)
            rest = np.arange(len(pieces))
            for k in (0, 1):
                at = self._slot(h[rest], k)
                _, first = np.unique(at, return_index=True)
                self.keys[at[first]], self.numbers[at[first]] = h[rest[first]], rest[first]
                rest = np.delete(rest, first)
            if not len(rest):
                return
        raise ValueError("no slots for the pieces")

    def _slot(self, h: np.ndarray, k: int) -> np.ndarray:
        return ((h * self.mul[k]) >> np.uint64(64 - self.BITS)).astype(np.int64) + (k << self.BITS)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, -1 where there is none."""
        a, b = self._slot(h, 0), self._slot(h, 1)
        out = np.where(self.keys[a] == h, self.numbers[a], -1)
        return np.where((out < 0) & (self.keys[b] == h), self.numbers[b], out)


class _Words(dict):
    """Ids of words as bytes; longer words than WORD are worked out and not kept."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        c = self.codec
        return np.array([i for p in c.path(word) for i in c.piece_ids(p)], dtype=np.int32).tobytes()


class Codec:
    """A model's pieces, and the path rule over them."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.vocab_size()
        plain = [i for i in range(n) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))]
        self.ids = {self.sp.id_to_piece(i): i for i in plain}
        self.rank = {p: -self.sp.get_score(i) for p, i in self.ids.items()}
        self.byte = {int(self.sp.id_to_piece(i)[3:5], 16): i for i in range(n) if self.sp.is_byte(i)}
        self.unknown = self.sp.unk_id()
        self.longest = max(map(len, self.ids), default=1)
        self.safe = not any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.atoms = re.compile(rf"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if self.safe else r"(?s).+").findall
        self.cut = re.compile(rf"(?<=\n)|(?=\n)|(?<=[^{MARK}])(?={MARK})")
        # pieces numbered in the order in which merging makes them, single characters first
        order = sorted(self.ids, key=lambda p: (len(p) > 1, self.rank[p], p))
        self.number = {p: k for k, p in enumerate(order)}
        self.text, self.size = order, len(order)
        self.sizes: dict[str, tuple[int, ...]] = {}
        ends: dict[str, set[int]] = {}
        for p in order:
            if len(p) > 2:
                ends.setdefault(p[-3:], set()).add(len(p))
        self.sizes = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.cache = _Words(self)
        self.table = _Lookup(order)
        self.id_of = np.array([self.ids[p] for p in order] or [0], dtype=np.int32)
        #: Whether merging reaches a piece (-1: not looked at yet), and a cache of pairs by slot.
        self.reached = np.full(max(1, self.size), -1, dtype=np.int8)
        self.pair_key, self.pair_ok = np.full(1 << _PAIR_BITS, -1, dtype=np.int64), np.zeros(1 << _PAIR_BITS, dtype=bool)
        text = {i: self.sp.id_to_piece(i).replace(MARK, " ").encode() for i in plain}
        self.bytes_of = [text.get(i, b"") for i in range(n)]
        for b, i in self.byte.items():
            self.bytes_of[i] = bytes([b])
        if self.unknown >= 0 and not self.byte:
            self.bytes_of[self.unknown] = " ⁇ ".encode()

    def normal(self, text: str) -> str:
        return self.sp.normalize(text)

    def merged(self, text: str) -> list[str]:
        """What merging yields for a short text: the best-ranked neighbours first, the leftmost among equals."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def split_of(self, k: int) -> tuple[int, int] | None:
        """The two pieces whose merging makes piece k last; itself twice for one character, None if merging never makes it."""
        found = self.halves.get(k, 0)
        if found == 0:
            piece = self.text[k]
            if len(piece) == 1:
                found = (k, k)
            else:
                rank, parts, found = self.rank, list(piece), None
                while len(parts) > 2:
                    ranks = [rank.get(parts[i] + parts[i + 1], np.inf) for i in range(len(parts) - 1)]
                    best = min(ranks)
                    if best == np.inf:
                        break
                    at = ranks.index(best)
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if len(parts) == 2:
                    found = (self.number[parts[0]], self.number[parts[1]])
            self.halves[k] = found
        return found

    def usable(self, piece: str) -> bool:
        """Whether a substring may be a piece of a path: one character, or a piece that merging reaches."""
        return len(piece) == 1 or ((k := self.number.get(piece)) is not None and self.split_of(k) is not None)

    def _beside(self, a: int, b: int) -> bool:
        """Whether merging leaves pieces a and b as they are side by side.

        Undoes merges from the latest on: what lies at the border must not have been merged before it was used up.
        Of equal merges the left one comes first, hence the + 1 on the right side.
        """
        text, number, limit = self.text, self.number, 1 << 60
        while True:
            c = number.get(text[a] + text[b])
            if c is not None and c < limit:
                return False
            if a > b:
                right = self.split_of(a)[1]
                if right != a:
                    limit, a = a, right
                    continue
                left = self.split_of(b)[0]
                if left == b:
                    return True
                limit, b = b + 1, left
            else:
                left = self.split_of(b)[0]
                if left != b:
                    limit, b = b + 1, left
                    continue
                right = self.split_of(a)[1]
                if right == a:
                    return True
                limit, a = a, right

    def side_by_side(self, a: str, b: str) -> bool:
        """As _beside for usable pieces as text; characters of no piece never merge."""
        x, y = self.number.get(a), self.number.get(b)
        if x is None or y is None:
            return True
        key = x * self.size + y
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > 4 * _CACHE:
                self.pairs.clear()
            found = self.pairs[key] = self._beside(x, y)
        return found

    def piece_ids(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        if not self.byte:
            return [self.unknown]
        return [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")]

    def path(self, text: str) -> list[str]:
        """The path through a text from its start: for each prefix, the piece that ends its encoding."""
        number, pairs, sizes, size, halves = self.number, self.pairs, self.sizes, self.size, self.halves
        if len(pairs) > 4 * _CACHE:
            pairs.clear()
        # of each prefix the last piece's number (-1: the start or a character of no piece) and length
        last, length = [-1], [0]
        for end in range(1, len(text) + 1):
            for n in (*(sizes.get(text[end - 3 : end], ()) if end > 2 else ()), 2):
                if n > end:
                    continue
                k = number.get(text[end - n : end])
                if k is None or (halves.get(k) or self.split_of(k)) is None:
                    continue
                before = last[end - n]
                if before >= 0:
                    key = before * size + k
                    ok = pairs.get(key)
                    if ok is None:
                        ok = pairs[key] = self._beside(before, k)
                    if not ok:
                        continue
                last.append(k)
                length.append(n)
                break
            else:
                last.append(number.get(text[end - 1], -1))
                length.append(1)
        out, end = [], len(text)
        while end:
            out.append(text[end - length[end] : end])
            end -= length[end]
        return out[::-1]

    def _besides(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """side_by_side for arrays of numbers."""
        key = a.astype(np.int64) * self.size + b
        slot = ((key.astype(np.uint64) * np.uint64(_BASE)) >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)
        ok, new = self.pair_ok[slot], np.flatnonzero(self.pair_key[slot] != key)
        if len(new):
            keys, back = np.unique(key[new], return_inverse=True)
            found = np.array([self._beside(k // self.size, k % self.size) for k in keys.tolist()], dtype=bool)
            ok[new] = found[back]
            self.pair_key[slot[new]], self.pair_ok[slot[new]] = key[new], ok[new]
        return ok

    def _usables(self, k: np.ndarray) -> np.ndarray:
        state = self.reached[k]
        for i in np.unique(k[state < 0]).tolist():
            self.reached[i] = self.split_of(i) is not None
        return self.reached[k] == 1

    def paths(self, words: list[str]) -> list[bytes]:
        """Ids (int32 bytes) of many words of at most WORD characters: ``path`` for all of them in step."""
        by = sorted(range(len(words)), key=lambda i: -len(words[i]))
        x, lens = _matrix([words[i] for i in by])
        rows, longest = x.shape
        total = np.zeros((rows, longest + 1), dtype=np.uint64)
        np.cumsum(x * self.table.up[:longest], axis=1, out=total[:, 1:])
        last, size = np.full((rows, longest + 1), -1, dtype=np.int32), np.ones((rows, longest + 1), dtype=np.int8)
        for end in range(1, longest + 1):
            open_ = np.arange(int(np.searchsorted(-lens, -end, side="right")))
            # a prefix has one encoding, so one size fits at most and any order of sizes finds it; short pieces are frequent
            for n in range(2, min(self.longest, end) + 1):
                k = self.table((total[open_, end] - total[open_, end - n]) * self.table.down[end - n])
                hit = np.flatnonzero(k >= 0)
                if not len(hit):
                    continue
                hit = hit[self._usables(k[hit])]
                before = last[open_[hit], end - n]
                ok = before < 0
                ok[~ok] = self._besides(before[~ok], k[hit][~ok])
                hit = hit[ok]
                if len(hit):
                    last[open_[hit], end], size[open_[hit], end] = k[hit], n
                    keep = np.ones(len(open_), dtype=bool)
                    keep[hit] = False
                    open_ = open_[keep]
            last[open_, end] = self.table((total[open_, end] - total[open_, end - 1]) * self.table.down[end - 1])
        ends = np.zeros((rows, longest + 1), dtype=bool)
        row, at = np.arange(rows), lens.copy()
        while len(row):
            ends[row, at] = True
            at = at - size[row, at]
            row, at = row[at > 0], at[at > 0]
        r, e = np.nonzero(ends)
        piece = last[r, e]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=rows))]) * 4
        whole = self.id_of[piece].tobytes()
        odd = set(r[piece < 0].tolist())
        out: list[bytes] = [b""] * rows
        for k, i in enumerate(by):
            # words with characters of no piece need bytes
            out[i] = whole[cuts[k] : cuts[k + 1]] if k not in odd else np.array([t for p in self.path(words[i]) for t in self.piece_ids(p)], dtype=np.int32).tobytes()
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of normalised texts; words that repeat are looked up, new ones go through ``paths`` together."""
        atoms = [self.atoms(t) for t in texts]
        if len(self.cache) > _CACHE:
            self.cache.clear()
        new = [a for a in set().union(*atoms).difference(self.cache) if len(a) <= WORD]
        for k in range(0, len(new), 10_000):
            part = new[k : k + 10_000]
            self.cache.update(zip(part, self.paths(part), strict=True))
        return [np.frombuffer(b"".join(map(self.cache.__getitem__, own)), dtype=np.int32) for own in atoms]

    def encode_normal(self, text: str) -> np.ndarray:
        """Ids of one normalised text."""
        return self.encode_batch([text])[0]

    def encode(self, text: str) -> list[int]:
        return self.encode_normal(self.normal(text)).tolist() if text else []

    def decode(self, ids) -> str:
        of = self.bytes_of
        out = b"".join([of[i] for i in ids]).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out

    def split(self, text: str, size: int = CHUNK) -> list[tuple[int, int, bool]]:
        """(start, end, whether no piece can span the end) of chunks of a normalised text."""
        out, at = [], 0
        while at < len(text):
            end = min(len(text), at + size)
            free = end == len(text)
            if not free and self.safe:
                cuts = [m.start() for m in self.cut.finditer(text, max(at + 1, end - 512), end + 1)]
                cuts = [c for c in cuts if at < c < len(text) and (text[c] == "\n" or text[c - 1] == "\n" or (text[c] == MARK and text[c - 1] != MARK))]
                if cuts:
                    end, free = cuts[-1], True
            out.append((at, end, free))
            at = end
        return out

    def states(self, left: str, right: str) -> list[tuple[str, int]]:
        """Pieces that may hold or end at a border, and how far they reach beyond it; left and right surround it."""
        out = []
        for back in range(1, min(self.longest, len(left)) + 1):
            for on in range(0, min(self.longest - back, len(right)) + 1):
                piece = left[len(left) - back :] + right[:on]
                if self.usable(piece):
                    out.append((piece, on))
        return sorted(out)

    def transfer(self, left: str, text: str, right: str, first: bool, free_in: bool, free_out: bool) -> np.ndarray:
        """The chunk's max-plus matrix, from states of its left border to those of its right one."""
        into = [("", 0)] if first or free_in else self.states(left, text + right)
        onto = [("", 0)] if free_out else self.states(left + text, right)
        if (first or free_in) and free_out:
            return np.zeros((1, 1))
        nodes = self._reach(text, right, into, free_out)
        out = np.full((len(into), len(onto)), -np.inf)
        for (piece, beyond), from_ in nodes.items():
            k = 0 if free_out else onto.index((piece, beyond))
            for e in range(len(into)):
                if from_ >> e & 1:
                    out[e, k] = 0.0
        return out

    def _reach(self, text: str, right: str, into: list[tuple[str, int]], free_out: bool, trace: dict | None = None) -> dict[tuple[str, int], int]:
        """Last pieces of paths over a chunk, and as bits the entries they are reached from."""
        n, ahead = len(text), text + ("" if free_out else right[: self.longest])
        at: list[dict[str, int]] = [{} for _ in range(n + self.longest + 1)]
        done: dict[tuple[str, int], int] = {}
        for e, (piece, on) in enumerate(into):
            at[on][piece] = at[on].get(piece, 0) | 1 << e
            if trace is not None:
                trace[(on, piece)] = None
        for p in range(n):
            for piece, from_ in at[p].items():
                for size in range(1, min(self.longest, len(ahead) - p) + 1):
                    nxt = ahead[p : p + size]
                    if self.usable(nxt) and (not piece or self.side_by_side(piece, nxt)):
                        had = at[p + size].get(nxt, 0)
                        at[p + size][nxt] = had | from_
                        if trace is not None and (p + size, nxt) not in trace:
                            trace[(p + size, nxt)] = (p, piece)
            if not trace:
                at[p] = {} if p else at[p]
        for p in range(n, n + self.longest + 1):
            for piece, from_ in at[p].items():
                if p - len(piece) < n or p == n:
                    key = ("", 0) if free_out else (piece, p - n)
                    if not free_out or p == n:
                        done[key] = done.get(key, 0) | from_
        return done

    def trace_back(self, left: str, text: str, right: str, entry: tuple[str, int], exit_: tuple[str, int], free_out: bool) -> list[int]:
        """Ids of the pieces that begin in a chunk, its borders' states being known."""
        if not entry[0] and free_out:
            return self.encode_normal(text).tolist()
        n, trace = len(text), {}
        self._reach(text, right, [entry], free_out, trace)
        if free_out:
            at = next((p, q) for p, q in trace if p == n)
        else:
            at = (n + exit_[1], exit_[0])
        out = []
        while trace[at] is not None:
            out.append(at[1])
            at = trace[at]
        return [i for p in reversed(out) for i in self.piece_ids(p)]


def codec(path: str | None = None) -> Codec:
    """The codec of a model file, loaded once in each process."""
    path = path or default_model()
    if path not in _loaded:
        if not Path(path).exists():
            raise FileNotFoundError(path)
        _loaded[path] = Codec(path)
    return _loaded[path]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two transfer matrices."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def borders(matrices: list[np.ndarray]) -> list[int]:
    """The states of all borders of a document, from its start to its end, given its chunks' matrices."""
    ahead = list(accumulate([np.zeros((1, 1)), *matrices], combine))
    at = [int(ahead[-1][0].argmax())]
    for k in range(len(matrices) - 1, -1, -1):
        at.append(int((ahead[k][0] + matrices[k][:, at[-1]]).argmax()))
    return at[::-1]


def _pieces(batch: pa.RecordBatch, column: str, most: int):
    """Slices of a batch whose column holds at most about ``most`` bytes, so that memory does not follow Arrow's batches."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)) if pa.types.is_string(batch.schema.field(column).type) or pa.types.is_large_string(batch.schema.field(column).type) else pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        yield batch.slice(i, j - i)
        i = j


def _encoder(path: str, back: bool):
    @released
    def run(batches):
        c = codec(path)
        for whole in batches:
            for batch in _pieces(whole, "text", 1 << 20):
                texts = batch.column("text").to_pylist()
                done = iter(c.encode_batch([c.normal(t) for t in texts if t]))
                ids = [None if t is None else next(done) if t else np.empty(0, np.int32) for t in texts]
                more = [pa.array(ids, pa.list_(pa.int32()))]
                if back:
                    more.append(pa.array([None if i is None else c.decode(i.tolist()) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "token_ids", "decoded"][: batch.num_columns + len(more)])
        # workers go on to other stages
        c.cache.clear()

    return run


def _chunker(path: str):
    @released
    def run(batches):
        c = codec(path)
        for batch in batches:
            for key, t in zip(batch.column("_key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                s = c.normal(t)
                free_in = True
                for k, (a, b, free) in enumerate(c.split(s)):
                    yield pa.RecordBatch.from_pylist(
                        [{"_key": key, "chunk": k, "before": s[max(0, a - c.longest) : a], "body": s[a:b], "after": s[b : b + 2 * c.longest], "free_in": free_in, "free_out": free}],
                        pa.schema([("_key", pa.int64()), ("chunk", pa.int32()), ("before", pa.string()), ("body", pa.string()), ("after", pa.string()), ("free_in", pa.bool_()), ("free_out", pa.bool_())]),
                    )
                    free_in = free

    return run


def _transferrer(path: str):
    @released
    def run(batches):
        c = codec(path)
        for batch in batches:
            rows, shape = [], []
            for r in batch.to_pylist():
                m = c.transfer(r["before"], r["body"], r["after"], r["chunk"] == 0, r["free_in"], r["free_out"])
                rows.append(m.ravel())
                shape.append(m.shape[0])
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("chunk"), pa.array(shape, pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["_key", "chunk", "rows", "matrix"])

    return run


def _scan(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("chunk")
    at = borders([np.asarray(m, dtype=float).reshape(r, -1) for m, r in zip(pdf["matrix"], pdf["rows"], strict=True)])
    return pd.DataFrame({"_key": pdf["_key"], "chunk": pdf["chunk"], "entry": at[:-1], "exit": at[1:]})


def _tracer(path: str):
    @released
    def run(batches):
        c = codec(path)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                entry = ("", 0) if r["chunk"] == 0 or r["free_in"] else c.states(r["before"], r["body"] + r["after"])[r["entry"]]
                exit_ = ("", 0) if r["free_out"] else c.states(r["before"] + r["body"], r["after"])[r["exit"]]
                out.append(np.array(c.trace_back(r["before"], r["body"], r["after"], entry, exit_, r["free_out"]), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("chunk"), pa.array(out, pa.list_(pa.int32()))], ["_key", "chunk", "ids"])

    return run


def encode(docs: DataFrame, path: str | None = None, giant: int = GIANT, decoded: bool = False) -> DataFrame:
    """docs with token_ids and n_tokens; texts of more than ``giant`` characters go through the chunked scan.

    With decoded, also the text that the ids decode to, in the same pass.
    """
    path = path or default_model()
    scratch = Scratch(docs.sparkSession, "pieces")
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("token_ids", "n_tokens", *(["decoded"] if decoded else []))])
    whole = StructType([*docs.schema.fields]).add("token_ids", ArrayType(IntegerType()))
    if decoded:
        whole = whole.add("decoded", StringType())
    small = docs.where(F.col("text").isNull() | (F.length("text") <= giant)).mapInArrow(_encoder(path, decoded), whole)
    (own,) = unused(docs, "key")
    large = scratch.keep(docs.where(F.length("text") > giant).withColumn(own, F.monotonically_increasing_id()), "giants")
    chunks = scratch.keep(large.select(F.col(own).alias("_key"), "text").mapInArrow(_chunker(path), "_key bigint, chunk int, before string, body string, after string, free_in boolean, free_out boolean"), "chunks")
    dealt = chunks.repartition("_key", "chunk")
    # what meets by document: one small matrix for each chunk
    matrices = dealt.mapInArrow(_transferrer(path), "_key bigint, chunk int, rows int, matrix array<double>")
    states = scratch.keep(matrices.groupBy("_key").applyInPandas(_scan, "_key bigint, chunk int, entry int, exit int"), "states")
    traced = chunks.join(states, ["_key", "chunk"]).mapInArrow(_tracer(path), "_key bigint, chunk int, ids array<int>")
    ids = traced.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts")).select(F.col("_key").alias(own), F.flatten(F.col("parts.ids")).alias("token_ids"))
    long = scratch.keep(large.join(ids, own).drop(own), "long")
    scratch.keep_only(long)
    out = small.unionByName(decode(long, path) if decoded else long)
    return out.withColumn("n_tokens", F.when(F.col("token_ids").isNotNull(), F.size("token_ids").cast("bigint")))


def _decoder(path: str):
    @released
    def run(batches):
        c = codec(path)
        for whole in batches:
            for batch in _pieces(whole, "token_ids", 1 << 20):
                col = batch.column("token_ids")
                off, flat = col.offsets.to_numpy(), col.values.to_numpy()
                texts = [c.decode(flat[off[k] : off[k + 1]].tolist()) if ok else None for k, ok in enumerate(col.is_valid().to_pylist())]
                keep = [(x, n) for x, n in zip(batch.columns, batch.schema.names, strict=True) if n != "decoded"]
                yield pa.RecordBatch.from_arrays([*[x for x, _ in keep], pa.array(texts, pa.string())], [*[n for _, n in keep], "decoded"])

    return run


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded (with token_ids) and the decoded text."""
    encoded = encoded.select(*[c for c in encoded.columns if c.lower() != "decoded"])
    whole = StructType([*encoded.schema.fields]).add("decoded", StringType())
    return encoded.mapInArrow(_decoder(path or default_model()), whole)
