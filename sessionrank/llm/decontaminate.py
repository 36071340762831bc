"""Benchmark decontamination by winnowed k-gram fingerprints."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from sessionrank.llm.common import carried, fresh, stage, utf8

SPAN, K = 10, 5
BLOCK_BYTES = 16 << 20
RESULT = "struct<n_words:long,starts:array<int>,stops:array<int>,items:array<long>>"

#: Bytes of words keep their value, A-Z become a-z, all others 0.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint8)
_RNG = np.random.default_rng(7)
BYTE = _RNG.integers(1, 2**63, 256).astype(np.uint64)
BASE, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
GROUP = 1 << 18


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.full(n, base)]).cumprod()


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, first and last-plus-one byte of each word, a 64-bit hash of it, and the n + 1 limits of the texts in words."""
    data, cut = utf8(texts)
    code = FOLD[data]
    inside = code != 0
    first, last = inside.copy(), inside.copy()
    if len(code):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = cut[(cut > 0) & (cut < len(code))]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    value = np.empty(len(start), np.uint64)
    up = down = _powers(BASE, 0)
    for g in range(0, len(start), GROUP):  # a group of words at a time bounds the 8-byte arrays
        a, b = start[g : g + GROUP], stop[g : g + GROUP]
        lo, n = a[0], b[-1] - a[0]
        if len(up) <= n:
            up, down = _powers(BASE, n), _powers(np.uint64(pow(int(BASE), -1, 2**64)), n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[code[lo : lo + n]] * up[:n], out=total[1:])
        h = (total[b - lo] - total[a - lo]) * down[a - lo]
        h ^= h >> np.uint64(32)
        value[g : g + GROUP] = h * STEP
    return code, start, stop, value, np.searchsorted(start, cut)


def grams(value: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, also across texts."""
    n = len(value) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * BASE + value[j : j + n]
    h ^= h >> np.uint64(29)
    return h * STEP


def _slide(x: np.ndarray, n: int, f) -> np.ndarray:
    out = x[: len(x) - n + 1].copy()
    for j in range(1, n):
        f(out, x[j : j + len(out)], out=out)
    return out


def winnow(value: np.ndarray, limits: np.ndarray, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that are smallest in some window of span - k + 1 of them.

    A window lies in one text. What it selects depends on its words alone, so every shared
    run of ``span`` words has a selected k-gram in common.
    """
    w, n = span - k + 1, len(value) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = grams(value, k)
    least = _slide(h, w, np.minimum)
    # a window that crosses the end of a text selects nothing
    crosses = np.zeros(n + 1, np.int32)
    ends = limits[1:-1]
    np.add.at(crosses, np.clip(ends - span + 1, 0, n), 1)
    np.add.at(crosses, np.clip(ends, 0, n), -1)
    least[np.cumsum(crosses[:-1]) > 0] = 0
    padded = np.zeros(len(h) + w - 1, np.uint64)
    padded[w - 1 : w - 1 + n] = least
    at = np.flatnonzero(_slide(padded, w, np.maximum) == h)
    return at, h[at]


class Index:
    """Fingerprints and windows of a block of items, with the items of each window."""

    def __init__(self, ids: list, texts: list, span: int, k: int):
        self.span, self.k = span, k
        folded = [[w for w in t.encode().translate(FOLD.tobytes()).split(b"\0") if w] for t in texts]
        found: dict[bytes, list] = {}
        for i, ws in zip(ids, folded, strict=True):
            n = min(span, len(ws))
            for a in range(len(ws) - n + 1 if n else 0):
                own = found.setdefault(b" ".join(ws[a : a + n]), [])
                if i is not None and (not own or own[-1] != i):
                    own.append(i)
        self.lengths = sorted({x.count(b" ") + 1 for x in found})
        self.windows: dict[int, tuple] = {}
        for n in self.lengths:
            mine = [x for x in found if x.count(b" ") + 1 == n]
            _, _, _, value, limits = words(pa.array([x.decode() for x in mine], pa.large_string()))
            h = grams(value, n)[limits[:-1]]
            order = np.argsort(h)
            at = np.concatenate([[0], np.cumsum([len(mine[o]) for o in order])])
            items = [found[mine[o]] for o in order]
            self.windows[n] = (
                h[order],
                b"".join(mine[o] for o in order),
                at,
                np.array([i for x in items for i in x], np.int64),
                np.concatenate([[0], np.cumsum([len(x) for x in items])]),
            )
            if n == span:
                self.prints = np.unique(winnow(value, limits, k, span)[1])
                self.screen = np.zeros(1 << 20, bool)
                self.screen[self.prints >> np.uint64(44)] = True

    def hits(self, value: np.ndarray, limits: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Word positions of runs of n words whose hash is that of a window, and the windows' numbers."""
        if len(value) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = self.windows[n][0]
        if n == self.span:
            at, h = winnow(value, limits, self.k, n)
            near = self.screen[h >> np.uint64(44)]
            at, h = at[near], h[near]
            at = at[np.isin(h, self.prints)]
            # a hit is extended to all runs around it
            reach = np.arange(self.k - n, 1)
            at = np.unique(at[:, None] + reach[None, :])
            at = at[(at >= 0) & (at + n <= len(value))]
            h = np.zeros(len(at), np.uint64)
            for j in range(n):
                h = h * BASE + value[at + j]
            h ^= h >> np.uint64(29)
            h *= STEP
        else:  # an item of n words is its own fingerprint
            h, at = grams(value, n), np.arange(len(value) - n + 1)
        text = np.searchsorted(limits, at, side="right")
        inside = at + n <= limits[text]
        at, h = at[inside], h[inside]
        place = np.minimum(np.searchsorted(known, h), len(known) - 1)
        same = known[place] == h
        return at[same], place[same]

    def match(self, texts: pa.Array) -> list[dict]:
        code, start, stop, value, limits = words(texts)
        n_texts = len(limits) - 1
        found: list[list] = [[] for _ in range(n_texts)]
        for n in self.lengths:
            known, flat, cut, items, item_at = self.windows[n]
            at, place = self.hits(value, limits, n)
            owner = np.searchsorted(limits, at, side="right") - 1
            for a, p, o in zip(at.tolist(), place.tolist(), owner.tolist(), strict=True):
                own = b" ".join(x for x in code[start[a] : stop[a + n - 1]].tobytes().split(b"\0") if x)
                while p < len(known) and flat[cut[p] : cut[p + 1]] != own:  # beyond only where two windows have one hash
                    p = p + 1 if p + 1 < len(known) and known[p + 1] == known[p] else len(known)
                if p < len(known):
                    found[o].append((a, a + n, p, n))
        out = []
        for o in range(n_texts):
            spans: list[list[int]] = []
            for a, b, _, _ in sorted(found[o]):
                if spans and a - limits[o] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], int(b - limits[o]))
                else:
                    spans.append([int(a - limits[o]), int(b - limits[o])])
            ids = [self.windows[n][3][self.windows[n][4][p] : self.windows[n][4][p + 1]] for p, n in {(x[2], x[3]) for x in found[o]}]
            out.append(
                {
                    "n_words": int(limits[o + 1] - limits[o]),
                    "starts": [s[0] for s in spans],
                    "stops": [s[1] for s in spans],
                    "items": np.unique(np.concatenate(ids)).tolist() if ids else [],
                }
            )
        return out


def _blocks(bench: DataFrame, block_bytes: int):
    """The items in blocks of bounded size, dealt by a hash of the text; one block where they are few."""
    rows = bench.select(F.col("item_id").cast("long"), "text").where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes)
    for b in range(n):
        yield rows.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == b) if n > 1 else rows


def _matcher(spark, block: DataFrame, span: int, k: int):
    got = block.collect()
    index = carried(spark, Index([r[0] for r in got], [r[1] for r in got], span, k))

    @arrow_udf(RESULT)
    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct(
            [("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("stops", pa.list_(pa.int32())), ("items", pa.list_(pa.int64()))]
        )
        for texts in batches:
            parts = [pa.array(index().match(texts.slice(a, 1000)), kind) for a in range(0, len(texts), 1000)]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    return match


def _merged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for rows in batches:
        out = []
        for parts in rows.to_pylist():
            spans: list[list[int]] = []
            for a, b in sorted((a, b) for p in parts for a, b in zip(p["starts"], p["stops"], strict=True)):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            items = sorted({i for p in parts for i in p["items"]})
            out.append({"n_words": parts[0]["n_words"], "starts": [s[0] for s in spans], "stops": [s[1] for s in spans], "items": items})
        yield pa.array(out, rows.type.value_type)


def contamination(docs: DataFrame, bench: DataFrame, span: int = SPAN, k: int = K, block_bytes: int = BLOCK_BYTES, name: str = "leak") -> DataFrame:
    """Adds a struct: number of words, word ranges shared with the benchmark, and the items they come from.

    ``docs`` has text, ``bench`` item_id and text. Words are runs of ASCII letters and digits
    and of other non-ASCII characters, in ASCII lower case. A window is ``span`` consecutive
    words of an item, or all of a shorter one. A k-gram that is the smallest in a run of
    span - k + 1 k-grams is a fingerprint, on both sides; documents' fingerprints are joined
    with those of the benchmark inside the task, and each hit is extended to the windows
    around it, which are compared word for word. Shorter items are fingerprints as a whole.

    The benchmark is the stated query set: it goes through the documents in blocks of
    ``block_bytes`` of text, each broadcast by itself. One block is one pass without a
    shuffle; of several, hits alone are brought together by row.

    Null or empty texts have no words and share nothing; null or empty items match nothing;
    words shared with an item without an id count, though no item is named. Repeated items
    and rows are as they are; columns of any name pass through; no rows give no rows.
    ``name`` gets underscores before it where the table has such a column.
    """
    spark, name = docs.sparkSession, fresh(docs, name)
    blocks = list(_blocks(bench, block_bytes)) or [bench.select(F.col("item_id").cast("long"), "text").limit(0)]
    if len(blocks) == 1:
        return docs.withColumn(name, _matcher(spark, blocks[0], span, k)("text"))
    row = fresh(docs, "row_no")
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()))
    hits = None
    for block in blocks:
        own = rows.select(row, _matcher(spark, block, span, k)("text").alias(name))
        hits = own if hits is None else hits.union(own.where(F.size(f"{name}.starts") > 0))
    merged = hits.groupBy(row).agg(F.collect_list(name).alias("parts"))
    return rows.join(merged.select(row, arrow_udf(_merged, RESULT)("parts").alias(name)), row).drop(row)


def clean(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The documents that share no window with the benchmark, with their own columns."""
    found = contamination(docs, bench, **options)
    name = found.columns[-1]
    return found.where(F.size(f"{name}.starts") == 0).drop(name)
