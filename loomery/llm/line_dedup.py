"""Near-duplicate lines: an exact set-similarity join over lines as sets of words, later matches removed.

A line's set holds its distinct lower-cased words (see ``words``). Lines with fewer than ``min_words`` distinct
words stay; by default only lines without words do. Two lines match when 10 * overlap >= 8 * union.
Lines are ordered by (doc_id, line number), a null doc_id last, then by their words' hash; a line is removed when any
line before it matches it, whether or not that earlier line is itself removed.

Lines with equal sets first become one class. Words are put in order of rarity; a class is posted under each word of
its prefix (the first n - ceil(0.8 n) + 1 words), but for sets of up to three words, which match equal sets alone.
Where such a word is one of ``HOT`` lines or more, the class is posted under pairs of it and another word of the prefix
that is one word longer, since sets that match and share a prefix word share two words of the longer prefixes: so no
frequent word gathers all its lines in one task. Classes that meet are pruned by length, by the word's positions and by
an upper bound from 128 parity bits, and the pairs that are left are confirmed on their whole sets.
One earlier match decides about a line, so under each word a class names only its ``FIRST`` earliest partners that
pass, which keeps large groups of near copies linear; a class with more partners than that, none of which was
confirmed, is matched again with 4096 times as many, among the postings of its words alone, until none is open. Rarity
comes from counts over all lines in ``BUCKETS`` hashed counters: any fixed order gives exact results, the counts only
make prefixes rare, and the table's size is fixed.

Null and empty texts pass unchanged. A document all of whose text was removed goes, since earlier documents hold it;
one that had no text to begin with stays. Rows that repeat a doc_id are one document to the order: lines of theirs
with one number and equal sets are treated alike. Other columns pass through; n_chars, where present, is brought up to date.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm import words
from loomery.runtime import Scratch, checked_broadcast, released, unused

#: Fewest distinct words of a line that takes part.
MIN_WORDS = 1
#: Fewest distinct words of a set that matches sets other than its equals (four words of five).
POSTED = 4
BUCKETS = 1 << 20
RANGES = 64
#: Postings that one task matches, about.
PART = 160_000
#: Earliest partners that a class names under one word in the first round.
FIRST = 8
#: Lines from which on a word is posted in pairs with others.
HOT = 100_000
_NO_ID = (1 << 63) - 1
_LINES = "kind int, bucket int, packed binary, sig_a bigint, sig_b bigint, n int, doc bigint, doc_hash bigint, line int"
_COLUMNS = ("token", "sig", "size_pos", "bits_a", "bits_b", "doc", "line")
_KINDS = ("i8", "i8", "i8", "i8", "i8", "i8", "i4")
_POSTS = "token bigint, sig bigint, size_pos bigint, bits_a bigint, bits_b bigint, doc bigint, line int"


def _lines(texts: pa.Array):
    """Parts of a batch: (first document, line offsets into the part, documents' first lines, word hashes, word offsets)."""
    data, offsets = words.raw(texts)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (1 << 20), side="right")) - 1)
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts = np.sort(np.concatenate([off[:-1], np.flatnonzero(part == 10) + 1]), kind="stable")
        # a newline that ends a document starts an empty last line there; the next document starts at the same byte
        first = np.searchsorted(np.flatnonzero(part == 10), off[:-1]) + np.arange(j - i)
        h, w_off = words.hashed(part, np.append(starts, len(part)))
        yield i, first, h, w_off
        i = j


def _distinct(keys: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each segment's distinct keys, ascending, and their offsets."""
    keys = keys.copy()
    words.sort_segments(keys, off[:-1], np.diff(off))
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    new[off[:-1][off[:-1] < len(keys)]] = True
    return keys[new], np.concatenate([[0], np.cumsum(new)])[off]


def _rank(counts: np.ndarray) -> np.ndarray:
    """Eighths of powers of two of hashed counters, 0 for words of one line at most."""
    return np.minimum(255, np.log2(np.maximum(counts, 1)) * 8).astype(np.uint8)


def _sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    return total[off[1:]] - total[off[:-1]]


def _signature(keys: np.ndarray, off: np.ndarray, which: int = 0) -> np.ndarray:
    """One of two 64-bit sums over each set's words."""
    return _sums(words.mix(keys ^ np.uint64(0x5851F42D4C957F2D * which)), off).view(np.int64)


def _scanner(min_words: int):
    """A row for each line of min_words words or more, and at the end each task's word counts."""

    @released
    def run(batches):
        counts = np.zeros(BUCKETS, dtype=np.int64)
        schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("packed", pa.binary()), ("sig_a", pa.int64()), ("sig_b", pa.int64()), ("n", pa.int32()), ("doc", pa.int64()), ("doc_hash", pa.int64()), ("line", pa.int32())])
        for batch in batches:
            ids, hashes = batch.column("doc"), batch.column("doc_hash")
            for start, first, h, off in _lines(batch.column("text")):
                keys, k_off = _distinct(h, off)
                n = np.diff(k_off)
                use = np.flatnonzero(n >= min_words)
                a, b = _signature(keys, k_off), _signature(keys, k_off, 1)
                np.add.at(counts, (keys >> np.uint64(20) & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
                doc = np.searchsorted(first, use, side="right") - 1
                at = pa.array(start + doc)
                none = pa.nulls(len(use), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(len(use), np.int32)), none.cast(pa.int32()), pa.nulls(len(use), pa.binary()), pa.array(a[use]), pa.array(b[use]), pa.array(n[use].astype(np.int32)), ids.take(at), hashes.take(at), pa.array((use - first[doc]).astype(np.int32))],
                    schema=schema,
                )
        # the task's counts leave as one packed row for each range of counters
        for k in range(RANGES):
            part = counts[k * (BUCKETS // RANGES) : (k + 1) * (BUCKETS // RANGES)]
            hit = np.flatnonzero(part)
            blob = hit.astype(np.uint32).tobytes() + part[hit].astype(np.uint64).tobytes()
            yield pa.RecordBatch.from_pylist([{"kind": 0, "bucket": k, "packed": blob}], schema=schema)

    return run


@released
def _sum_counts(batches):
    """Counters of the ranges dealt to a task, added up row by row."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, blob in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            n = len(blob) // 12
            at = np.frombuffer(blob, np.uint32, n)
            total.setdefault(k, np.zeros(BUCKETS // RANGES, np.uint64))[at] += np.frombuffer(blob, np.uint64, n, 4 * n)
    for k, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["bucket", "packed"])


def _prefixes(keys: np.ndarray, k_off: np.ndarray, use: np.ndarray, rank: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the chosen sets are posted under, which of the chosen sets each posting is of, and the word's position.

    A word stands as its rarity above 56 bits of its hash. A counter of one means that no other line has the word. Words
    of a rank of ``hot`` or more stand in pairs with each other word of the prefix that is one word longer.
    """
    order = (rank[(keys >> np.uint64(20) & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (keys >> np.uint64(8))
    begin, size = k_off[use], np.diff(k_off)[use]
    words.sort_segments(order, begin, size)
    take = size - (8 * size + 9) // 10 + 1
    row = np.repeat(np.arange(len(use)), take)
    pos = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
    token = order[begin[row] + pos]
    rarity = token >> np.uint64(56)
    hit = np.flatnonzero((rarity > 0) & (rarity < hot))
    many = np.flatnonzero(rarity >= hot)
    if not len(many):
        return token[hit], row[hit], pos[hit]
    others = take[row[many]]
    at = np.repeat(many, others)
    second = np.arange(others.sum()) - np.repeat(np.cumsum(others) - others, others)
    second += second >= pos[at]
    second = order[begin[row[at]] + second]
    shared = np.flatnonzero(second >> np.uint64(56))
    at, second = at[shared], second[shared]
    return np.concatenate([token[hit], words.mix(token[at] ^ words.mix(second))]), np.concatenate([row[hit], row[at]]), np.concatenate([pos[hit], pos[at]])


def _words_of(rarity, hot: int):
    """What whole sets are posted under."""

    @released
    def run(batches):
        for batch in batches:
            col = batch.column("tokens")
            off = col.offsets.to_numpy().astype(np.int64)
            keys = col.values.to_numpy().view(np.uint64)
            token, _, _ = _prefixes(keys, off, np.arange(len(col)), rarity.value, hot)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(token).view(np.int64))], ["token"])

    return run


def _poster(rarity, min_words: int, hot: int):
    """Prefix postings of each distinct set that may match others. rarity: broadcast ranks of the hashed counters."""

    @released
    def run(batches):
        rank, seen = rarity.value, {}
        schema = pa.schema([("token", pa.int64()), ("sig", pa.int64()), ("size_pos", pa.int64()), ("bits_a", pa.int64()), ("bits_b", pa.int64()), ("doc", pa.int64()), ("line", pa.int32())])
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for start, first, h, off in _lines(batch.column("text")):
                keys, k_off = _distinct(h, off)
                sig = _signature(keys, k_off)
                n = np.diff(k_off)
                use = np.flatnonzero(n >= max(min_words, POSTED))
                d = np.searchsorted(first, use, side="right") - 1
                doc, line = ids[start + d], use - first[d]
                # a set that this task has posted from an earlier line needs no second posting; the memory is bounded
                if len(seen) > 100_000:
                    seen.clear()
                fresh = []
                for i, place in enumerate(zip(sig[use].tolist(), doc.tolist(), line.tolist(), strict=True)):
                    had = seen.get(place[0])
                    if had is None or place[1:] < had:
                        seen[place[0]] = place[1:]
                        fresh.append(i)
                if not fresh:
                    continue
                use, doc, line = use[fresh], doc[fresh], line[fresh]
                one = np.uint64(1)
                flag = np.left_shift(one, keys & np.uint64(63))
                low = (keys >> np.uint64(6)) & one
                at = np.minimum(k_off[:-1], len(flag) - 1)
                bits = [np.bitwise_xor.reduceat(np.where(low == half, flag, np.uint64(0)), at)[use].view(np.int64) for half in (0, 1)]
                size = n[use]
                token, row, pos = _prefixes(keys, k_off, use, rank, hot)
                cols = (token.view(np.int64), sig[use][row], (size[row].astype(np.int64) << 32) | pos, bits[0][row], bits[1][row], doc[row], line[row].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=schema)

    return run


def _packer(rarity, parts: int, min_words: int, hot: int):
    """Postings packed by the part that a hash of their word falls in: a row for each part and few hundred thousand postings."""

    @released
    def run(batches):
        inner, held, rows = _poster(rarity, min_words, hot), [], 0

        def flush():
            t = pa.Table.from_batches(held)
            token = t["token"].to_numpy()
            part = (words.mix(token.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[by], np.arange(parts + 1))
            cols = [t[c].to_numpy()[by] for c in _COLUMNS]
            full = np.flatnonzero(np.diff(cuts))
            blobs = [b"".join(c[cuts[k] : cuts[k + 1]].tobytes() for c in cols) for k in full.tolist()]
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.diff(cuts)[full]), pa.array(blobs, pa.binary())], ["part", "n", "packed"])

        for batch in inner(batches):
            held.append(batch)
            rows += batch.num_rows
            if rows > PART:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()

    return run


def _unpacked(n: int, blob: bytes) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, kind in zip(_COLUMNS, _KINDS, strict=True):
        out[name] = np.frombuffer(blob, kind, n, at)
        at += n * np.dtype(kind).itemsize
    return out


def _part_matcher(first: int):
    """Candidate pairs out of packed postings that are sorted by part within their partition."""

    @released
    def run(batches):
        part, held = None, []

        def done():
            if held:
                x, y, more = _pairs_of({k: np.concatenate([h[k] for h in held]) for k in _COLUMNS}, first)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(more)], ["x", "y", "more"])

        for batch in batches:
            for p, n, blob in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if p != part:
                    yield from done()
                    part, held = p, []
                held.append(_unpacked(n, blob))
        yield from done()

    return run


def _pairs_of(t: dict[str, np.ndarray], first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of postings: (class, earlier partner, whether it may have more partners) that pass the filters.

    Postings are put in order of token, place and sig, each class once under a token, at its first place.
    """
    by = np.argsort(t["token"])
    token = t["token"][by]
    # a word that one posting alone has joins nothing
    same = np.concatenate([[False], token[1:] == token[:-1], [False]])
    by, new = by[same[1:] | same[:-1]], ~same[:-1][same[1:] | same[:-1]]
    group = np.cumsum(new) - 1
    sig, doc, line = t["sig"][by], t["doc"][by], t["line"][by]
    if len(by) and doc.min() >= 0 and doc.max() < 1 << 40 and line.max() < 1 << 22:
        at = doc << 22 | line
        order = np.argsort(at)
        tied = (at[order[1:]] == at[order[:-1]]) & (sig[order[1:]] != sig[order[:-1]])
        order = np.lexsort((sig, at)) if tied.any() else order
    else:
        order = np.lexsort((sig, line, doc))
    rank = np.empty(len(by), dtype=np.int64)
    rank[order] = np.arange(len(by))
    order = np.argsort(group << 32 | rank)
    by, group = by[order], group[order]
    _, once = np.unique(words.mix(t["sig"][by].view(np.uint64) ^ words.mix(group.astype(np.uint64))), return_index=True)
    once.sort()
    by, group = by[once], group[once]
    t = {k: v[by] for k, v in t.items()}
    ask = t.get("ask", True)
    at = np.flatnonzero(np.diff(group, prepend=-1))
    begin = np.repeat(at, np.diff(np.append(at, len(by))))
    place = np.arange(len(by)) - begin
    n, pos = t["size_pos"] >> 32, t["size_pos"] & 0xFFFFFFFF
    found = np.zeros(len(by), dtype=np.int32)
    open_ = np.flatnonzero((place > 0) & ask)
    xs, ys, k = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    while len(open_):
        x, y = open_, begin[open_] + k
        total = n[x] + n[y]
        ok = (10 * np.minimum(n[x], n[y]) >= 8 * np.maximum(n[x], n[y])) & (9 * np.minimum(n[x] - pos[x], n[y] - pos[y]) >= 4 * total)
        x, y, total = x[ok], y[ok], total[ok]
        differ = np.bitwise_count((t["bits_a"][x] ^ t["bits_a"][y]).view(np.uint64)).astype(np.int64) + np.bitwise_count((t["bits_b"][x] ^ t["bits_b"][y]).view(np.uint64))
        ok = 9 * differ <= total
        xs.append(x[ok])
        ys.append(y[ok])
        found[x[ok]] += 1
        k += 1
        open_ = open_[(place[open_] > k) & (found[open_] < first)]
    x, y = np.concatenate(xs), np.concatenate(ys)
    return t["sig"][x], t["sig"][y], found[x] >= first


def _matcher(first: int):
    """Candidate pairs out of postings that are sorted by token within their partition."""
    names = ("token", "sig", "size_pos", "bits_a", "bits_b", "doc", "line", "ask")

    @released
    def run(batches):
        held: list[dict[str, np.ndarray]] = []
        rows = 0

        def flush(keep_last: bool):
            nonlocal held, rows
            t = {k: np.concatenate([h[k] for h in held]) for k in names}
            held, rows = [], 0
            if not len(t["token"]):
                return
            end = len(t["token"])
            if keep_last:
                end = int(np.searchsorted(t["token"], t["token"][-1], side="left"))
            x, y, more = _pairs_of({k: v[:end] for k, v in t.items()}, first)
            held = [{k: v[end:] for k, v in t.items()}]
            rows = len(t["token"]) - end
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(more)], ["x", "y", "more"])

        limit = 200_000
        for batch in batches:
            held.append({k: batch.column(k).to_numpy(zero_copy_only=False) for k in names})
            rows += batch.num_rows
            if rows > limit:
                yield from flush(True)
                # a word's postings are kept together: where they alone exceed the limit, wait for more
                limit = max(200_000, 2 * rows)
        if rows:
            yield from flush(False)

    return run


@released
def _fetch(batches):
    """The whole sets of the lines asked for: column want lists line numbers."""
    for batch in batches:
        want = batch.column("want")
        w_off, wanted = want.offsets.to_numpy(), want.values.to_numpy()
        data, offsets = words.raw(batch.column("text"))
        lines = []
        for k in range(batch.num_rows):
            text = data[offsets[k] : offsets[k + 1]]
            cuts = np.concatenate([[0], np.flatnonzero(text == 10) + 1, [len(text) + 1]])
            lines += [text[a : b - 1] for a, b in ((cuts[i], cuts[i + 1]) for i in wanted[w_off[k] : w_off[k + 1]].tolist())]
        off = np.concatenate([[0], np.cumsum([len(x) for x in lines], dtype=np.int64)]).astype(np.int64)
        keys, k_off = _distinct(*words.hashed(np.concatenate(lines) if lines else np.empty(0, np.uint8), off))
        sets = pa.ListArray.from_arrays(pa.array(k_off.astype(np.int32)), pa.array(keys.view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(_signature(keys, k_off)), sets], ["sig", "tokens"])


def removed_lines(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS, hot: int = HOT) -> DataFrame:
    """doc, doc_hash and the sorted numbers of the lines to remove, for each document that loses any."""
    spark = docs.sparkSession
    src = docs.select("doc", "doc_hash", F.col("text").cast("string").alias("text"))
    scanned = scratch.keep(src.mapInArrow(_scanner(max(min_words, 1)), _LINES), "scanned")
    # BUCKETS counters at most come to the driver and are broadcast, whatever the input's size
    rank = np.zeros(BUCKETS, dtype=np.uint8)
    total = scanned.where("kind = 0").select("bucket", "packed").repartition(RANGES, "bucket").mapInArrow(_sum_counts, "bucket int, packed binary").toArrow()
    for k, blob in zip(total["bucket"].to_pylist(), total["packed"].to_pylist(), strict=True):
        own = np.frombuffer(blob, np.uint64).astype(float)
        rank[k * len(own) : (k + 1) * len(own)] = _rank(own)
    rarity, hot = spark.sparkContext.broadcast(rank), max(1, int(_rank(np.array([hot]))[0]))
    lines = scanned.where("kind = 1").select("sig_a", "sig_b", "n", "doc", "doc_hash", "line")
    place = F.struct("doc", "line", "doc_hash")
    classes = scratch.keep(lines.groupBy("sig_a", "sig_b").agg(F.min(place).alias("first"), F.count("*").alias("lines"), F.first("n").alias("n")), "classes")
    # a fifth of the distinct words of each set, and one more
    parts = max(1, int(classes.where(f"n >= {POSTED}").agg(F.sum(F.col("n") / 5 + 1)).first()[0] or 0) // PART)

    beaten, tested, sets, width, open_ = None, None, None, FIRST, None
    while True:
        if open_ is None:
            packed = src.select("doc", "text").mapInArrow(_packer(rarity, parts, min_words, hot), "part int, n bigint, packed binary")
            found = packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_part_matcher(width), "x bigint, y bigint, more boolean")
        else:
            # only the open classes' words matter now
            posts = src.select("doc", "text").mapInArrow(_poster(rarity, min_words, hot), _POSTS)
            asked = scratch.keep(sets.join(open_, "sig", "left_semi").mapInArrow(_words_of(rarity, hot), "token bigint").distinct(), "words")
            posts = posts.join(checked_broadcast(asked), "token", "left_semi").join(checked_broadcast(open_), "sig", "left").withColumn("ask", F.coalesce("ask", F.lit(False)))
            found = posts.repartition("token").sortWithinPartitions("token").mapInArrow(_matcher(width), "x bigint, y bigint, more boolean")
        pairs = scratch.keep(found.groupBy("x", "y").agg(F.max("more").alias("more")), "pairs")
        if not pairs.take(1):
            break
        fresh = pairs if tested is None else pairs.join(tested, ["x", "y"], "left_anti")
        ends = fresh.select(F.col("x").alias("sig_a")).union(fresh.select("y")).distinct()
        want = classes.join(ends, "sig_a").select("first.*").groupBy("doc", "doc_hash").agg(F.collect_set("line").alias("want"))
        want = scratch.keep(want, "want")
        texts = src.join(checked_broadcast(want), ["doc", "doc_hash"]).select("text", "want")
        got = texts.mapInArrow(_fetch, "sig bigint, tokens array<bigint>").dropDuplicates(["sig", "tokens"])
        # signatures of 64 bits name candidates; should two sets share one, both are compared
        sets = scratch.keep(got if sets is None else got.union(sets).dropDuplicates(["sig", "tokens"]), "sets")
        side = lambda c: sets.select(F.col("sig").alias(c), F.col("tokens").alias(f"{c}_tokens"))
        both = fresh.join(side("x"), "x").join(side("y"), "y")
        both = both.where("9 * size(array_intersect(x_tokens, y_tokens)) >= 4 * (size(x_tokens) + size(y_tokens))").select("x", "y").distinct()
        hit = scratch.keep(both.select(F.col("x").alias("sig")).distinct(), "hit")
        beaten = hit if beaten is None else scratch.keep(beaten.union(hit).distinct(), "beaten")
        tested = pairs.select("x", "y")
        open_ = scratch.keep(pairs.where("more").select(F.col("x").alias("sig")).distinct().join(hit, "sig", "left_anti").withColumn("ask", F.lit(True)), "open")
        if not open_.take(1):
            break
        width *= 4096
    # the classes that lose lines: those of more than one line, and those with an earlier match
    losing = classes.withColumn("beaten", F.lit(False)) if beaten is None else classes.join(checked_broadcast(beaten.select(F.col("sig").alias("sig_a"), F.lit(True).alias("beaten"))), "sig_a", "left").withColumn("beaten", F.coalesce("beaten", F.lit(False)))
    losing = scratch.keep(losing.where("lines > 1 or beaten").select("sig_a", "sig_b", "first", "beaten"), "losing")
    later = (F.col("doc") != F.col("first.doc")) | (F.col("line") != F.col("first.line"))
    out = lines.join(checked_broadcast(losing), ["sig_a", "sig_b"]).where(later | F.col("beaten"))
    out = scratch.keep(out.groupBy("doc", "doc_hash").agg(F.array_sort(F.collect_set("line")).alias("removed")), "removed")
    rarity.unpersist()
    scratch.keep_only(out)
    return out


def dedup_lines(docs: DataFrame, details: bool = False, min_words: int = MIN_WORDS, hot: int = HOT) -> DataFrame:
    """docs without later near-duplicate lines; columns unchanged, or with details also lines_removed."""
    scratch = Scratch(docs.sparkSession, "lines")
    hash_, doc, removed, text = unused(docs, "hash", "doc", "removed", "text")
    hashed = docs.withColumns({hash_: F.xxhash64("text"), doc: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID))})
    gone = removed_lines(hashed.select(F.col(doc).alias("doc"), F.col(hash_).alias("doc_hash"), "text"), scratch, min_words, hot)
    gone = gone.withColumnsRenamed({"doc": doc, "doc_hash": hash_, "removed": removed})
    out = hashed.join(checked_broadcast(gone), [doc, hash_], "left")
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(removed, i))
    out = out.withColumn(text, F.when(F.col(removed).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    out = out.where(F.col(removed).isNull() | (F.btrim(F.col(text), F.lit(" \t\r\n")) != ""))
    new = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(removed).isNull(), F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    columns = [new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns if not (details and c.lower() == "lines_removed")]
    return out.select(*columns, *([F.coalesce(F.size(removed), F.lit(0)).alias("lines_removed")] if details else []))
