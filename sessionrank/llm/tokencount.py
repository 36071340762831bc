"""Token counts that follow edits: a segment tree of pre-tokens for each document."""

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from sessionrank.llm.common import fresh, stage

CONTEXT = 2
CACHE = 500_000
LEAVES = pa.struct([("pieces", pa.list_(pa.string())), ("tokens", pa.list_(pa.int32()))])
RESULT = "struct<before:long,after:long,pretokens:long,reencoded:long>"


class Counter:
    """Numbers of ids of pre-tokens. Some ``CACHE`` of them are remembered, then it begins anew."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = public_tokenizers.PATTERN
        self.coding = tiktoken.Encoding("counting", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern).findall
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> np.ndarray:
        """Of all pieces of a text; those that are not known are counted first."""
        if len(self.known) >= CACHE:
            self.known.clear()
        for p in set(pieces).difference(self.known):
            self.known[p] = len(self.coding.encode_ordinary(p))
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def count(self, piece: str) -> int:
        if (n := self.known.get(piece)) is None:
            n = self.known[piece] = len(self.coding.encode_ordinary(piece))
        return n


class Tree:
    """Leaves are pre-tokens, nodes hold the sums of characters and ids below them."""

    def __init__(self, text: str, counter: Counter):
        pieces: list[str] = counter.split(text)
        self._grow(counter, pieces, counter.counts(pieces))

    @classmethod
    def of(cls, pieces: list[str], tokens: np.ndarray, counter: Counter) -> "Tree":
        """A tree from its leaves, without encoding."""
        tree = cls.__new__(cls)
        tree._grow(counter, pieces, tokens)
        return tree

    def _grow(self, counter: Counter, pieces: list[str], tokens: np.ndarray) -> None:
        self.counter, self.pieces, self.n = counter, pieces, len(pieces)
        self.parts: dict[int, list[str]] = {}  # the pre-tokens of a leaf that an edit has made
        self.width = 1 << max(0, self.n - 1).bit_length()
        sums = np.zeros((self.width, 2), np.int64)
        if self.n:
            sums[: self.n, 0] = np.fromiter(map(len, self.pieces), np.int64, self.n)
            sums[: self.n, 1] = tokens
        levels = [sums]
        while len(levels[-1]) > 1:
            levels.append(levels[-1].reshape(-1, 2, 2).sum(axis=1))
        self.sums = np.concatenate([np.zeros((1, 2), np.int64), *levels[::-1]])  # node 1 is the root, i has 2 i and 2 i + 1
        self.reencoded = 0

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    def leaf_at(self, offset: int) -> tuple[int, int]:
        """The leaf that holds a character, and the offset of its first one."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            left = int(self.sums[node, 0])
            if offset - start >= left:
                start, node = start + left, node + 1
        return node - self.width, start

    def _set(self, first: int, stop: int, text: str, tokens: int) -> None:
        """Leaf ``first`` holds a text, those up to ``stop`` nothing; sums follow up to the root."""
        self.pieces[first:stop] = [text] + [""] * (stop - first - 1)
        a, b = first + self.width, stop + self.width
        self.sums[a:b] = 0
        self.sums[a] = len(text), tokens
        while a > 1:
            a, b = a // 2, (b - 1) // 2 + 1
            self.sums[a:b] = self.sums[2 * a : 2 * b].reshape(-1, 2, 2).sum(axis=1)

    def _before(self, leaf: int, steps: int) -> int:
        while leaf > 0 and steps:
            leaf -= 1
            steps -= bool(self.pieces[leaf])
        return leaf

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace characters start..stop.

        The split is made anew from two pre-tokens before the edit, since whether a pre-token
        ends where it does depends on the next one at most, up to the first old limit behind
        the edit at which the new split ends a pre-token as well; from there on both agree.
        """
        start = min(max(start, 0), self.chars)
        stop = min(max(stop, start), self.chars)
        if not self.n:
            self.__init__(new, self.counter)
            self.reencoded += self.n
            return
        first, at = self.leaf_at(min(start, self.chars - 1)) if self.chars else (0, 0)
        last, last_at = self.leaf_at(max(start, stop - 1)) if stop < self.chars else (self.n - 1, 0)
        last = min(last, self.n - 1)
        low = self._before(first, CONTEXT)
        at -= sum(len(p) for p in self.pieces[low:first])
        head = "".join(self.pieces[low : last + 1])
        head = head[: start - at] + new + head[stop - at :]
        reach = 8
        while True:
            high = min(self.n, last + 1 + reach)
            found = self.counter.split(head + "".join(self.pieces[last + 1 : high]))
            limits, total = {}, 0
            for k, p in enumerate(found):
                limits[total] = k
                total += len(p)
            pos, leaf, meet = len(head), last + 1, None
            # behind the meeting point, CONTEXT pre-tokens or the end must be in sight
            while leaf < high and (high == self.n or high - leaf > CONTEXT):
                if self.pieces[leaf] and pos in limits:
                    meet = leaf
                    break
                pos += len(self.pieces[leaf])
                leaf += 1
            if meet is not None or high == self.n:
                break
            reach *= 2
        kept = found[: limits[pos]] if meet is not None else found
        meet = self.n if meet is None else meet
        self.reencoded += len(kept)
        self.parts[low] = kept
        self._set(low, meet, "".join(kept), sum(map(self.counter.count, kept)))

    def text(self) -> str:
        return "".join(self.pieces)

    def leaves(self) -> tuple[list[str], list[int]]:
        """The pre-tokens and their numbers of ids; those that edits made are looked up, no others."""
        pieces, tokens = [], []
        known = self.sums[self.width : self.width + self.n, 1].tolist()
        for i, piece in enumerate(self.pieces):
            if piece:
                own = self.parts.get(i)
                pieces += own or [piece]
                tokens += map(self.counter.count, own) if own else [known[i]]
        return pieces, tokens


def recount(docs: DataFrame, edits: str = "edits", path: str | None = None, name: str = "tokens") -> DataFrame:
    """Adds token counts before and after edits: before, after, pretokens (of the old text), reencoded.

    ``docs`` has text and an array of struct<start, stop, new> in ``edits``, applied in their order; a
    start or stop counts characters of the text as it is then, and is moved into it if outside.
    Each document is split and counted once; an edit re-encodes the pre-tokens that it
    touches with their boundary, and the sums on the path to the root.

    Null texts are empty; null edits, and edits without start, stop or new, change nothing.
    Columns of any name pass through; ``name`` gets underscores where the table has it. A
    document is held by one task; no rows give no rows.
    """
    name, path = fresh(docs, name), path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def counted(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([(c, pa.int64()) for c in ("before", "after", "pretokens", "reencoded")])
        counter = Counter(path)
        for texts, lists in batches:
            out = []
            for text, own in zip(texts, lists, strict=True):
                tree = Tree(text.as_py() or "", counter)
                before, n = tree.tokens, tree.n
                for e in own.as_py() or ():
                    if e is not None and None not in e.values():
                        tree.edit(e["start"], e["stop"], e["new"])
                out.append({"before": before, "after": tree.tokens, "pretokens": n, "reencoded": tree.reencoded})
            yield pa.array(out, kind)

    return docs.withColumn(name, arrow_udf(counted, RESULT)("text", edits))


def plant(docs: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, pieces, tokens): the leaves of each document's tree, to be kept as a table.

    ``pieces`` are the pre-tokens in their order, ``tokens`` the numbers of ids of each. Null and
    empty texts have none; rows without a key and repeated rows have a row each; no rows
    give no rows; other columns are not read.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def planted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(path)
        for texts in batches:
            split = [counter.split(t.as_py() or "") for t in texts]
            yield pa.array([{"pieces": p, "tokens": counter.counts(p)} for p in split], LEAVES)

    leaves = arrow_udf(planted, "struct<pieces:array<string>,tokens:array<int>>")("text")
    return docs.select(key, leaves.alias("_leaves")).select(key, "_leaves.*")


def apply_edits(trees: DataFrame, edits: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, pieces, tokens, reencoded): the kept trees after a batch of edits.

    ``trees`` is a table of ``plant`` or of an earlier batch, ``edits`` has the key and an array of
    struct<start, stop, new> in ``edits``. Only edited documents are opened, from their
    leaves; the others pass as they are, with nothing re-encoded. In an edited document the
    pre-tokens that edits touch are encoded with their boundary, as in ``recount``.

    Several rows of a key in ``edits`` are applied in the order of their arrays; rows of a key that
    ``trees`` lacks, without a key, or with null edits change nothing. Rows of ``trees`` that share a key are all
    edited; those without one stay. No rows give no rows; other columns are not read.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def edited(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        counter = Counter(path)
        for pieces, tokens, lists in batches:
            out = []
            for own, ids, changes in zip(pieces, tokens, lists, strict=True):
                tree = Tree.of(own.as_py(), np.array(ids.as_py(), np.int64), counter)
                for e in changes.as_py():
                    if e is not None and None not in e.values():
                        tree.edit(e["start"], e["stop"], e["new"])
                pieces_now, tokens_now = tree.leaves()
                out.append({"pieces": pieces_now, "tokens": tokens_now, "reencoded": tree.reencoded})
            yield pa.array(out, pa.struct([*LEAVES, pa.field("reencoded", pa.int64())]))

    kept = trees.select(key, "pieces", "tokens")
    batch = edits.where(F.col(key).isNotNull() & F.col("edits").isNotNull()).groupBy(key)
    batch = stage(batch.agg(F.flatten(F.sort_array(F.collect_list("edits"))).alias("_edits")))
    result = "struct<pieces:array<string>,tokens:array<int>,reencoded:long>"
    new = kept.join(batch, key).select(key, arrow_udf(edited, result)("pieces", "tokens", "_edits").alias("_now"))
    same = kept.join(batch, key, "left_anti").withColumn("reencoded", F.lit(0).cast("long"))
    return same.unionByName(new.select(key, "_now.*"))


def count_of(tokens: str = "tokens") -> Column:
    """A document's number of ids, from its leaves."""
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda a, b: a + b)


def review_edits() -> Column:
    """Three edits of each text, by its length: a passage deleted, a mark set in, a passage replaced."""
    n = F.length(F.coalesce("text", F.lit("")))

    def edit(start, size, new):
        at = start.cast("long")
        return F.struct(at.alias("start"), (at + size).cast("long").alias("stop"), F.lit(new).alias("new"))

    return F.array(
        edit(F.floor(n / 4), 17, ""), edit(F.floor(n / 2), 0, " [see note 12] "), edit(F.floor(3 * n / 4), 40, "It's been re-written;\n\n  twice")
    )
