"""Alignment of the tokens of two tokenizers in Arrow: byte ends joined within blocks, pair counts merged by Spark."""

import base64
import json
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from sessionrank.llm.common import utf8
from sessionrank.llm.tokenfile import BYTE_LEVEL
from sessionrank.settings import shared_dir, stage

BLOCK_BYTES = 4 << 20
SLICE_BYTES = 1 << 20
#: Longer texts go through the tokenizer itself: the faster encoder's stack does not hold runs of millions of blanks.
LONG = 100_000
FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Vocabulary:
    """The bytes of every id."""

    def __init__(self, table: list[bytes]):
        self.bytes = pa.array(table, pa.binary())
        self.sizes = np.array([len(t) for t in table], np.int64)

    def packed(self, ids: np.ndarray) -> bytes:
        return pa.compress(ids.astype(self._kind()).tobytes(), "zstd", asbytes=True)

    def opened(self, data: bytes, n: int) -> np.ndarray:
        kind = np.dtype(self._kind())
        return np.frombuffer(pa.decompress(data, n * kind.itemsize, "zstd", asbytes=True), kind).astype(np.int32)

    def _kind(self) -> str:
        return "<u2" if len(self.sizes) <= 1 << 16 else "<i4"


def byte_level(path: str) -> Vocabulary:
    """Of a byte-level BPE, whose entries spell bytes as printable characters."""
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    entries = dict(own["model"]["vocab"])
    special = {t["content"]: t["id"] for t in own.get("added_tokens", ())}
    back = {chr(c): b for b, c in BYTE_LEVEL.items()}
    table = [b""] * (max([*entries.values(), *special.values()]) + 1)
    for text, i in entries.items():
        table[i] = text.encode() if text in special else bytes(back[c] for c in text)
    for text, i in special.items():
        table[i] = text.encode()
    return Vocabulary(table)


def pieces(path: str) -> Vocabulary:
    """Of a model of pieces, with U+2581 for the space and <0xHH> for bytes."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return Vocabulary([bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(names)])


def encoders(first: str, ranks: str | None, second: str):
    """Functions from texts to lists of ids, for both tokenizers."""
    if ranks:
        with open(ranks, "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
        slow: list[Tokenizer] = []

        def one(text: str) -> list[int]:
            if len(text) <= LONG:
                return fast.encode_ordinary(text)
            if not slow:
                slow.append(_tokenizer(first))
            return slow[0].encode(text, add_special_tokens=False).ids

        a = lambda texts: [one(t) for t in texts]
    else:
        tokenizer = _tokenizer(first)
        a = lambda texts: [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    model = sentencepiece.SentencePieceProcessor(model_file=second)
    return a, lambda texts: model.encode(texts, num_threads=1)


def _tokenizer(path: str) -> Tokenizer:
    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


def _lists(sizes: np.ndarray, flat: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), flat)


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return np.diff(np.asarray(lists.offsets))


def _ends(lists: pa.ListArray, own: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat ids, the list of each, and where each ends in its list's bytes: cumulative sums by segments."""
    flat = pc.list_flatten(lists).to_numpy()
    parent = pc.list_parent_indices(lists).to_numpy()
    total = np.concatenate([[0], np.cumsum(own.sizes[flat])])
    first = np.cumsum(_sizes(lists)) - _sizes(lists)
    return flat, parent, total[1:] - total[first][parent]


def _part(lists: pa.ListArray, good: np.ndarray) -> pa.ListArray:
    """The lists, emptied where not good."""
    return _lists(np.where(good, _sizes(lists), 0), lists.filter(pa.array(good)).flatten())


def _spelt(lists: pa.ListArray, own: Vocabulary, text: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Which of the lists spell their text, from the texts' bytes one after another."""
    _, parent, ends = _ends(lists, own)
    length = np.zeros(len(lists), np.int64)
    np.maximum.at(length, parent, ends)
    good = length == np.diff(limits)
    if good.any():
        got, _ = utf8(own.bytes.take(lists.filter(pa.array(good)).flatten()))
        differs = np.zeros(len(got) + 1, np.int64)
        np.cumsum(got != text[np.repeat(good, np.diff(limits))], out=differs[1:])
        cut = np.concatenate([[0], np.cumsum(length[good])])
        good[good] = differs[cut[1:]] == differs[cut[:-1]]
    return good


def _encoded(texts: pa.Array, run, words: tuple[Vocabulary, Vocabulary]) -> list[pa.ListArray]:
    """Ids of both for each text: none for texts that are null, empty or not spelt by the tokens of both."""
    whole = [t or "" for t in texts.to_pylist()]
    there = np.array([bool(t) for t in whole])
    spaced = [" " + t if t else "" for t in whole]
    raw = [t.encode() for t in spaced]
    limits = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    text = np.frombuffer(b"".join(raw), np.uint8)
    both = [_part(pa.array(f(t), pa.list_(pa.int32())), there) for f, t in zip(run, (spaced, whole), strict=True)]
    good = there & _spelt(both[0], words[0], text, limits) & _spelt(both[1], words[1], text, limits)
    return [_part(x, good) for x in both]


def _met(both: list[pa.ListArray], words: tuple[Vocabulary, Vocabulary]) -> pa.Table:
    """Byte ends of the tokens of both by an Acero join on (doc, end): doc, end, places a and b in the flat ids, null where only one ends."""
    sides = []
    for lists, own, name in zip(both, words, "ab", strict=True):
        flat, parent, ends = _ends(lists, own)
        sides.append(pa.table({"doc": parent, "end": ends, name: np.arange(len(flat))}))
    met = sides[0].join(sides[1], keys=["doc", "end"], join_type="full outer", use_threads=False)
    return met.take(pc.sort_indices(met, [("doc", "ascending"), ("end", "ascending")])).combine_chunks()


def _links(both: list[pa.ListArray], met: pa.Table) -> pa.Table:
    """All overlapping pairs of tokens in order: doc, and a and b as ids.

    Between two neighbouring ends lie bytes of one token of each side, and no two such
    stretches have the same two tokens: there is a link for each distinct end.
    """
    out = {"doc": met.column("doc").to_numpy()}
    for lists, name in zip(both, "ab", strict=True):
        place = pc.fill_null_backward(met.column(name)).to_numpy()  # the token that holds the bytes before an end ends there or next
        out[name] = pc.list_flatten(lists).to_numpy()[place]
    return pa.table(out)


def _groups(both: list[pa.ListArray], met: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """Number of groups of each document, and the groups spelt as ``a1,a2|b1;a3|b2``."""
    common = met.filter(pc.and_(pc.is_valid(met.column("a")), pc.is_valid(met.column("b")))).combine_chunks()
    n = np.bincount(common.column("doc").to_numpy(), minlength=len(both[0]))
    sides = []
    for lists, name in zip(both, "ab", strict=True):
        cut = np.concatenate([[0], common.column(name).to_numpy() + 1]).astype(np.int32)
        sides.append(pc.binary_join(pa.ListArray.from_arrays(cut, pc.list_flatten(lists).cast(pa.string())), ","))
    return n, pc.binary_join(_lists(n, pc.binary_join_element_wise(*sides, "|")), ";")


def _slices(both: list[pa.ListArray], own: Vocabulary) -> Iterator[tuple[int, list[pa.ListArray]]]:
    """The documents of a block in slices of some ``SLICE_BYTES`` (or one document): first number and lists, so that a join stays small."""
    flat = pc.list_flatten(both[0]).to_numpy()
    ends = np.concatenate([[0], np.cumsum(_sizes(both[0]))])
    total = np.concatenate([[0], np.cumsum(own.sizes[flat])])[ends]
    at, n = 0, len(both[0])
    while at < n:
        stop = min(n, max(at + 1, int(np.searchsorted(total, total[at] + SLICE_BYTES, side="right")) - 1))
        yield at, [_lists(_sizes(x)[at:stop], pc.list_flatten(x.slice(at, stop - at))) for x in both]
        at = stop


def aligned(
    docs: DataFrame, first: str | None = None, second: str | None = None, ranks: str | None = None, column: str = "text",
    id_column: str = "doc_id", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """For each document how the tokens of a byte-level BPE (A) and of a model of pieces (B) lie to each other.

    (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups). The text of A has a space before it, as the model of pieces
    adds one. Byte offsets at which a token of both ends cut it into groups, which ``groups`` spells as ids
    (``a1,a2|b1;a3|b2``). A link is a token of A and one of B whose bytes overlap. The count of a pair of ids is the
    number of documents that hold it linked; ``count_sum`` adds it up over a document's links, and ``n_best``
    are the links whose count is the highest of their A id. ``ranks`` is A's vocabulary for a faster encoder, if there is one.

    Documents go into blocks of ``block_bytes`` of text (a longer document is a block). A block's tokens are flattened Arrow
    lists with parent indices, their ends segmented cumulative sums, met by an Acero join on document and end.
    Links are counted inside a block by Table.group_by, so what Spark shuffles is a row for each pair and block:
    once to add them up, once to bring the sums back to the blocks, which are a bucketed table and do not
    move. A pair that all blocks have is added up before the shuffle, and split by the skew join behind it.

    Texts that are null or empty, or that the joined tokens of A or B do not spell (some models normalise), have no tokens: zeros and an empty
    string. Repeated rows are documents of their own; null ids pass through; other columns are not read; no rows give no rows.
    """
    spark = docs.sparkSession
    ranks = ranks or (None if first else public_tokenizers.path("byte_bpe_50k.tiktoken"))
    first, second = first or public_tokenizers.path("byte_bpe_50k.json"), second or public_tokenizers.path("piece_bpe_32k.model")
    words = byte_level(first), pieces(second)
    id_type = docs.schema[id_column].dataType.simpleString()
    schema = f"block long, a int, b int, n long, ids array<{id_type}>, sizes_a array<int>, sizes_b array<int>, tokens_a binary, tokens_b binary"
    names = [part.split()[0] for part in schema.split(", ")]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = encoders(first, ranks, second)
        number, size = TaskContext.get().partitionId() << 33, 0
        held: list[tuple] = []

        def rows():
            ids = pa.concat_arrays([h[0] for h in held])
            both = [pa.concat_arrays([h[1][k] for h in held]) for k in (0, 1)]
            ints = pa.list_(pa.int32())
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(ids.type), ints, ints, pa.binary(), pa.binary()]
            partial = []
            for _, own in _slices(both, words[0]):
                each = _links(own, _met(own, words)).group_by(["doc", "a", "b"], use_threads=False).aggregate([])
                partial.append(each.group_by(["a", "b"], use_threads=False).aggregate([("doc", "count")]))
            pairs = pa.concat_tables(partial).group_by(["a", "b"], use_threads=False).aggregate([("doc_count", "sum")]).combine_chunks()
            n = pairs.num_rows
            if n:
                counted = [pairs.column(c).chunk(0) for c in ("a", "b", "doc_count_sum")]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), *counted, *(pa.nulls(n, k) for k in kinds[4:])], names)
            flat = [own.packed(pc.list_flatten(x).to_numpy()) for x, own in zip(both, words, strict=True)]
            values = [number, None, None, None, ids.to_pylist(), *(_sizes(x) for x in both), *flat]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            _, cut = utf8(batch.column(1))
            at = 0
            while at < batch.num_rows:
                stop = min(batch.num_rows, max(at + 1, int(np.searchsorted(cut, cut[at] + SLICE_BYTES, side="right")) - 1))
                held.append((batch.column(0).slice(at, stop - at), _encoded(batch.column(1).slice(at, stop - at), run, words)))
                size += int(cut[stop] - cut[at])
                at = stop
                if size >= block_bytes:
                    yield from rows()
                    number, size, held = number + 1, 0, []
        if held:
            yield from rows()

    # files stay in the shared folder; the catalogue only says how they are dealt
    name = f"aligned_{uuid.uuid4().hex}"
    made = docs.select(F.col(id_column), F.col(column)).mapInArrow(blocks, schema)
    made.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").option("path", shared_dir(spark)).saveAsTable(name)
    table = spark.table(name)
    pairs = table.where("a is not null").select("block", "a", "b", "n")
    sums = pairs.groupBy("a", "b").agg(F.sum("n").alias("total"))
    highest = F.max("total").over(Window.partitionBy("a"))  # no more rows than B has ids
    sums = stage(sums.withColumn("best", F.col("total") == highest))
    known = pairs.select(F.col("block").alias("own"), "a", "b").join(sums, ["a", "b"])

    def counted(own: pa.Table, totals: pa.Table) -> pa.Table:
        out = []
        kind = own.schema.field("ids").type.value_type
        for row in own.to_pylist():
            both = [_lists(row[f"sizes_{k}"], pa.array(w.opened(row[f"tokens_{k}"], sum(row[f"sizes_{k}"])))) for k, w in zip("ab", words, strict=True)]
            for at, some in _slices(both, words[0]):
                n = len(some[0])
                met = _met(some, words)
                links = _links(some, met)
                n_groups, spelt = _groups(some, met)
                each = links.group_by(["doc", "a", "b"], use_threads=False).aggregate([([], "count_all")])
                each = each.join(totals.select(["a", "b", "total", "best"]), keys=["a", "b"], use_threads=False)
                doc, times = each.column("doc").to_numpy(), each.column("count_all").to_numpy()
                sums = np.zeros((2, n), np.int64)
                np.add.at(sums[0], doc, times * each.column("best").to_numpy())
                np.add.at(sums[1], doc, times * each.column("total").to_numpy())
                values = [*(_sizes(x) for x in some), n_groups, np.bincount(links.column("doc").to_numpy(), minlength=n), *sums]
                out.append(pa.table([pa.array(row["ids"][at : at + n], kind), *(pa.array(v, pa.int64()) for v in values), spelt], [id_column, *FIELDS, "groups"]))
        return pa.concat_tables(out)

    owned = table.where("a is null").select("block", *names[4:])
    result = f"`{id_column}` {id_type}, " + ", ".join(f"{c} long" for c in FIELDS) + ", groups string"
    return owned.groupBy("block").cogroup(known.groupBy("own")).applyInArrow(counted, result)
