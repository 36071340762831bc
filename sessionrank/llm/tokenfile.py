"""Token ids in grammar-compressed files (Re-Pair), with random access."""

import itertools
import json
import sys
import types
import unicodedata
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from sessionrank.llm.common import bounded, utf8

END = 1
BLOCK_TOKENS = 1 << 19
MIN_COUNT, RULES = 24, 4_096
CACHE_WORDS = 800_000
FEW_PARTS = 1_000_000
SCHEMA = (
    "part int, block int, before long, n long, doc_ids array<long>, tokens array<long>, symbols array<long>,"
    " terminals int, rules binary, lengths binary, body binary"
)


#: How the vocabulary marks the last id of a pre-token.
WORD_END = "</w>"
END_MARK = "\x00"
#: Pre-tokens of lower-case text without apostrophes, as the tokenizer's own pattern has them.
PRE_TOKEN = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_REST = [b for b in range(256) if b not in _KEPT]
#: Bytes as the characters of a byte-level vocabulary: printable ones stand for themselves.
BYTE_LEVEL = {b: b for b in _KEPT} | {b: 256 + i for i, b in enumerate(_REST)}


def word_ranks(path: str) -> tuple[tiktoken.Encoding, np.ndarray, np.ndarray]:
    """The vocabulary's merges as ranks of byte strings, for pre-tokens that end in ``END_MARK``: encoder, ids of ranks, and which of them end one.

    The mark stands for the vocabulary's own: it joins the last byte before any merge.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    back, mark = {chr(c): b for b, c in BYTE_LEVEL.items()}, END_MARK.encode()

    def spelt(token: str) -> bytes:
        core = token.removesuffix(WORD_END)
        return bytes(back[c] for c in core) + (mark if core != token else b"")

    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {bytes([b]) + mark: 256 + b for b in range(256)}
    for i, (a, b) in enumerate(model["merges"]):
        ranks.setdefault(spelt(a + b), 512 + i)
    ids = np.full(512 + len(model["merges"]), -1, np.int32)
    for token, i in model["vocab"].items():
        if all(c in back for c in token.removesuffix(WORD_END)) and (r := ranks.get(spelt(token))) is not None:
            ids[r] = i
    ends = np.zeros(len(ids), bool)
    ends[[r for t, r in ranks.items() if t.endswith(mark) and t != mark]] = True
    return tiktoken.Encoding("words", pat_str=rf"[^{END_MARK}]+{END_MARK}", mergeable_ranks=ranks, special_tokens={}), ids, ends


class Encoder:
    """Ids of whole texts, word by word: the tokenizer never joins what ASCII white space parts.

    A process keeps the ids of the words that it has met last, in two halves of at most about
    ``CACHE_WORDS``: when the younger half is full, the older one is dropped, and words that
    come back move to the younger. ASCII capitals are folded as the tokenizer does it. Plain Latin words are parted into
    their pre-tokens, and those of a text that are new are merged together by the vocabulary's ranks; any other word goes through
    the whole tokenizer.
    """

    def __init__(self, path: str):
        kept = sys.modules.setdefault("_ids_of_words", types.ModuleType("_ids_of_words")).__dict__
        if path not in kept:  # a process takes many tasks
            kept[path] = [[{}, {}], Tokenizer.from_file(path), *word_ranks(path)]
        self.halves: list[dict[bytes, bytes]] = kept[path][0]
        self.tokenizer, self.bare, self.ids, self.ends = kept[path][1:]

    def _encode(self, word: bytes) -> bytes:
        return array("i", self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def _parts(self, word: bytes) -> list[bytes]:
        """The pre-tokens of a plain lower-case Latin word; none for any other word."""
        text = word.decode("utf-8", "replace")
        plain = max(text) < "\u0250" and END_MARK not in text and "'" not in text and "<|" not in text and text == text.lower()
        return [x.encode() for x in PRE_TOKEN.findall(text)] if plain and unicodedata.is_normalized("NFC", text) else []

    def _learn(self, words: list[bytes]) -> None:
        """Ids of new words: their pre-tokens are encoded in one call, whose ids part where a pre-token ends."""
        young, old = self.halves
        headed, parted, wanted = [], [], set()
        for w in words:
            if w.isalpha():  # in lower case: ASCII letters are one pre-token
                wanted.add(w)
            elif w[-1] in b".," and w[:-1].isalpha():
                headed.append(w)
                wanted.add(w[:-1])
                wanted.add(w[-1:])
            elif parts := self._parts(w):
                parted.append((w, parts))
                wanted.update(parts)
        new = [x for x in wanted if x not in young and x not in old]
        if new:
            found = np.array(self.bare.encode_ordinary(END_MARK.join([x.decode() for x in new]) + END_MARK), np.int64)
            ids = self.ids[found]
            cut = np.flatnonzero(self.ends[found]) + 1
            if len(cut) != len(new) or (ids < 0).any():
                raise ValueError("a pre-token has no ids in this vocabulary")
            flat, cut = ids.tobytes(), [0, *(4 * cut).tolist()]
            young.update(zip(new, [flat[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)], strict=True))
        for w in headed:
            h = w[:-1]
            young[w] = (young.get(h) or old[h]) + (young.get(w[-1:]) or old[w[-1:]])
        for w, parts in parted:
            if len(parts) > 1:
                young[w] = b"".join([young.get(x) or old[x] for x in parts])

    def encode(self, text: bytes) -> np.ndarray:
        if b"<|" in text:  # special tokens are told apart by their case
            return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.int32)
        words = text.lower().split()
        if len(self.halves[0]) > CACHE_WORDS // 2:
            self.halves[:] = {}, self.halves[0]
        young, old = self.halves
        missing = set(words).difference(young)
        if missing:
            new = []
            for w in missing:
                if (got := old.get(w)) is None:
                    new.append(w)
                else:
                    young[w] = got
            if new:
                self._learn(new)
                for w in new:
                    if w not in young:
                        young[w] = self._encode(w)
        return np.frombuffer(b"".join(map(young.__getitem__, words)), np.int32)


def repair(seq: np.ndarray, last: np.ndarray, terminals: int, rounds: int | None = None, min_count: int = MIN_COUNT, rules: int = RULES):
    """(symbols, their number up to each document's end, rules as pairs) of a block.

    ``last`` marks the last id of each document; no rule crosses it. A round counts the pairs,
    and the most frequent ones (``min_count`` times at least, ``rules`` at most) become
    nonterminals; where chosen pairs overlap, every other one from the left is replaced. It ends when no
    pair is that frequent, or after ``rounds``.
    Hashed counts, never below the true ones, leave few pairs to be counted exactly.
    """
    seq, last, made = seq.astype(np.int64), last.copy(), [np.zeros((0, 2), np.int64)]
    top = terminals
    for _ in itertools.count() if rounds is None else range(rounds):
        if len(seq) < 2:
            break
        key = seq[:-1] << 24 | seq[1:]
        open_ = ~last[:-1]
        bucket = (key * np.int64(-7046029254386353131)) >> np.int64(44) & np.int64(0xFFFFF)
        often = np.flatnonzero((np.bincount(bucket, open_, 1 << 20) >= min_count)[bucket] & open_)
        pairs, which, count = np.unique(key[often], return_inverse=True, return_counts=True)
        good = np.flatnonzero(count >= min_count)
        if not len(good):
            break
        good = np.sort(good[np.lexsort((pairs[good], -count[good]))][:rules])
        number = np.full(len(pairs), -1, np.int64)
        number[good] = np.arange(len(good)) + top
        symbol = number[which]
        at, symbol = often[symbol >= 0], symbol[symbol >= 0]
        new_run = np.concatenate([[True], np.diff(at) > 1])
        first = at[np.flatnonzero(new_run)][np.cumsum(new_run) - 1]
        even = (at - first) % 2 == 0
        at, symbol = at[even], symbol[even]
        seq[at] = symbol
        last[at] |= last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
        made.append(np.stack([pairs[good] >> 24, pairs[good] & 0xFFFFFF], axis=1))
        top += len(good)
    return seq, np.flatnonzero(last) + 1, np.concatenate(made)


def expansions(rules: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray]:
    """Length of every symbol, and the ids of all symbols one after another."""
    lengths = np.ones(terminals + len(rules), np.int64)
    parts = [np.arange(terminals)]
    own: dict[int, np.ndarray] = {}
    for i, (a, b) in enumerate(rules.tolist()):
        own[terminals + i] = np.concatenate([own[x] if x >= terminals else np.array([x]) for x in (a, b)])
        lengths[terminals + i] = len(own[terminals + i])
        parts.append(own[terminals + i])
    return lengths, np.concatenate(parts)


class Block:
    """One row of the file, opened."""

    def __init__(self, row: dict):
        self.terminals = row["terminals"]
        self.rules = np.frombuffer(row["rules"], np.int32).reshape(-1, 2)
        body = np.frombuffer(row["body"], np.uint16 if self.terminals + len(self.rules) <= 1 << 16 else np.int32)
        self.body = body.astype(np.int64)
        self.lengths = np.ones(self.terminals + len(self.rules), np.int64)
        self.lengths[self.terminals :] = np.frombuffer(row["lengths"], np.int32)

    def ids(self) -> np.ndarray:
        """All ids of the block."""
        lengths, flat = expansions(self.rules, self.terminals)
        start = np.cumsum(lengths) - lengths
        n = lengths[self.body]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[self.body], n)
        return flat[at]

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of the block; the lengths lead to them, and only what overlaps is expanded."""
        ends = np.cumsum(self.lengths[self.body])
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop)
        base = ends[a] - self.lengths[self.body[a]] if a < len(ends) else 0
        out: list[int] = []
        todo = [(int(s)) for s in self.body[a : b + 1][::-1]]
        at = int(base)
        while todo and at < stop:
            s = todo.pop()
            n = int(self.lengths[s])
            if at + n <= start:
                at += n
            elif s >= self.terminals:
                x, y = self.rules[s - self.terminals]
                todo += [int(y), int(x)]
            else:
                out.append(s)
                at += 1
        return np.array(out, np.int64)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, block_tokens: int = BLOCK_TOKENS, **options) -> None:
    """Write the ids of all texts, each followed by ``end``, in ascending order of doc_id.

    Rows are dealt by ranges of doc_id (null first; a third of all rows may share one), and
    every task cuts its range into blocks of whole documents, ``block_tokens`` or more ids
    each, so memory is bounded by a block and the longest document. A file row is a block:
    ids before it in its part, its documents with their numbers of ids and where their
    symbols end, the grammar's rules with the lengths of their expansions, and the symbols.
    The files are Parquet, written through Spark's committer. Null texts are empty: they have
    the end id alone. Other columns are not read; no rows give no blocks.
    """
    path_ = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def packed(batches):
        encoder = Encoder(path_)
        terminals = encoder.tokenizer.get_vocab_size()
        part, block, before = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        names: list = []
        held = 0

        def row():
            counts = np.array([len(x) for x in ids], np.int64)
            seq = np.concatenate(ids)
            last = np.zeros(len(seq), bool)
            last[np.cumsum(counts) - 1] = True
            body, ends, rules = repair(seq, last, terminals, **options)
            lengths = expansions(rules, terminals)[0][terminals:]
            width = np.uint16 if terminals + len(rules) <= 1 << 16 else np.int32
            values = {
                "part": part, "block": block, "before": before, "n": len(seq), "doc_ids": names, "tokens": counts, "symbols": ends,
                "terminals": terminals, "rules": rules.astype(np.int32).tobytes(), "lengths": lengths.astype(np.int32).tobytes(), "body": body.astype(width).tobytes(),
            }
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values.values(), KINDS, strict=True)], list(values))

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            data, cut = utf8(batch.column(1))
            for i, doc_id in enumerate(doc_ids):
                own = np.append(encoder.encode(data[cut[i] : cut[i + 1]].tobytes()), np.int32(end))
                ids.append(own)
                names.append(doc_id)
                held += len(own)
                if held >= block_tokens:
                    yield row()
                    block, before, held = block + 1, before + held, 0
                    ids, names = [], []
        if ids:
            yield row()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    narrow = docs.select(F.col("doc_id").cast("long"), "text", order[1].alias("h"), order[2].alias("row"))
    keys = [order[0], F.col("h"), F.col("row")]
    ranged = narrow.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    ranged.mapInArrow(packed, SCHEMA).write.parquet(path)


KINDS = [
    pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()),
    pa.int32(), pa.binary(), pa.binary(), pa.binary(),
]


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a file with ``start``, the number of ids before each in the whole file."""
    table = spark.read.schema(SCHEMA).parquet(path)
    parts = table.groupBy("part").agg(F.sum("n").alias("own"))
    parts = parts.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("first"))
    parts = F.broadcast(parts) if bounded(parts, FEW_PARTS) else parts  # a row for each writing task
    return table.join(parts, "part").withColumn("start", F.col("first") + F.col("before"))


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from its decoded ids."""

    def decoded(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = Block(row).ids().astype("<u4")
                cut = np.concatenate([[0], np.cumsum(row["tokens"])])
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(cut[:-1] + row["start"]), pa.array(np.diff(cut)), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    few = blocks(spark, path).select("start", "doc_ids", "tokens", "terminals", "rules", "lengths", "body")
    return few.mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids_crc32 long")
