"""Language identification by cross-parsing text against suffix automata of labelled text."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from sessionrank.llm.common import carried, stage, utf8

CHARS, PER_TEXT = 20_000, 400
#: Characters with a column of their own in a language's automaton, and columns that its rarer ones share by hash.
OWN, SHARED = 224, 30
SEGMENT, LANES = 512, 8_192
PAD, OTHER = 0, 1


def automaton(codes: np.ndarray, classes: int) -> np.ndarray:
    """Transitions of the suffix automaton of a sequence: states x classes, -1 where there is none."""
    link, length, moves = [-1], [0], [{}]
    last = 0
    for c in codes.tolist():
        cur = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    table = np.full((len(moves), classes), -1, np.int32)
    for s, own in enumerate(moves):
        for c, t in own.items():
            table[s, c] = t
    return table


class Parser:
    """The automata of all languages in one table; a text is cut into the longest matches of each.

    An entry holds the next state, or, where the match ends, the complement of the state with
    which the next phrase begins. Every character of any sample is a class; a language's automaton has columns for the
    characters of its own sample, and a class without a column ends its match. A language takes about
    2 * chars * columns * 4 bytes.
    """

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        chars: dict[str, int] = {}
        for text in samples.values():
            for ch in text.lower():
                chars[ch] = chars.get(ch, 0) + 1
        common = sorted(chars, key=lambda ch: (-chars[ch], ch))
        self.code = np.full(0x110000, OTHER, np.int32)
        own = {ch: i + 2 for i, ch in enumerate(common)}
        self.letter = np.zeros(0x110000, bool)
        for cp in range(0x110000):
            ch = chr(cp)
            self.letter[cp] = ch.isalpha()
            if (low := own.get(ch.lower())) is not None:
                self.code[cp] = low
        tables, base = [], 0
        self.start, self.cost = [], []
        self.column = np.full((len(self.names), len(common) + 2), OTHER, np.int32)
        self.column[:, PAD] = PAD
        for k, name in enumerate(self.names):
            text = self.code[np.frombuffer(samples[name].encode("utf-32-le"), np.uint32)]
            found, count = np.unique(text[text != OTHER], return_counts=True)
            order = np.lexsort((found, -count))
            self.column[k, found[order[:OWN]]] = np.arange(min(OWN, len(found))) + 2
            self.column[k, found[order[OWN:]]] = OWN + 2 + found[order[OWN:]] % SHARED
            width = int(self.column[k].max()) + 1
            t = automaton(self.column[k][text], width)
            fresh = np.maximum(t[0], 0).astype(np.int64)
            t = np.where(t < 0, ~(fresh * width + base)[None, :], t.astype(np.int64) * width + base)
            t[:, PAD] = np.arange(len(t)) * width + base
            tables.append(t.ravel())
            self.start.append(base)
            self.cost.append(np.log2(len(text) + 2))
            base += t.size
        self.kind = np.int32 if base < 2**31 else np.int64
        self.table = np.concatenate([np.zeros(0, np.int64), *tables]).astype(self.kind)

    def phrases(self, codes: np.ndarray) -> np.ndarray:
        """Finished phrases for (languages, lanes), from (steps, lanes) of character classes."""
        state = np.repeat(np.array(self.start, self.kind)[:, None], codes.shape[1], axis=1)
        count = np.zeros_like(state)
        at, column = np.empty_like(state), np.empty(state.shape, np.int32)
        sign = 8 * state.itemsize - 1
        for c in codes:
            np.take(self.column, c, axis=1, out=column)
            np.add(state, column, out=at)
            np.take(self.table, at, out=state)
            np.right_shift(state, sign, out=at)
            count -= at
            state ^= at
        return count

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        data, cut = utf8(texts)
        n, k = len(cut) - 1, len(self.names)
        total, length, letters = np.zeros((k, n)), np.zeros(n), np.zeros(n, bool)
        lanes: list[np.ndarray] = []
        owner: list[int] = []

        def flush() -> None:
            if lanes:
                codes = np.zeros((len(lanes), SEGMENT), np.int32)
                for i, x in enumerate(lanes):
                    codes[i, : len(x)] = x
                got = self.phrases(np.ascontiguousarray(codes.T))
                for i in range(k):
                    total[i] += np.bincount(owner, got[i] + 1, n)
                lanes.clear()
                owner.clear()

        for i in range(n):
            cps = np.frombuffer(data[cut[i] : cut[i + 1]].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
            length[i], letters[i] = len(cps), self.letter[cps].any()
            if letters[i] and k:
                codes = self.code[cps]
                for a in range(0, len(codes), SEGMENT):
                    lanes.append(codes[a : a + SEGMENT])
                    owner.append(i)
                    if len(lanes) == LANES:
                        flush()
        flush()
        names, score = ["und"] * n, np.zeros(n)
        if k:
            rate = total * np.array(self.cost)[:, None]
            best = rate.argmin(axis=0)
            for i in np.flatnonzero(letters):
                names[i] = self.names[best[i]]
                others = np.delete(rate[:, i], best[i])
                score[i] = others.min() / (others.min() + rate[best[i], i]) if len(others) else 1.0
        return names, score


def _first(spans: DataFrame, keys: list[str], chars: int) -> DataFrame:
    """Of each language the keys, in their order, before which the spans have fewer than ``chars`` characters."""
    before = Window.partitionBy("lang").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = spans.groupBy("lang", *keys).agg(F.sum("size").alias("size"))
    return sums.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).where(F.col("before") < chars).select("lang", *keys)


def samples(docs: DataFrame, chars: int = CHARS, per_text: int = PER_TEXT) -> dict[str, str]:
    """Text of each language for its automaton: from ``docs`` with text and lang, ``chars`` characters at most.

    A bounded sample of spans of ``per_text`` characters. Equal texts of a language count once.
    Texts are taken in the order of their hash, first one span of each, at a place that the hash
    chooses in the whole text, then the span after it (the first follows the last), and so on
    until ``chars`` are reached or all text is taken. Nothing depends on ids or order.

    The limit is looked for in numbers only: turns, slots of the hash in the turns that are
    needed, texts in the slots that are needed; texts are read again for the chosen spans.
    """
    usable = docs.where("lang is not null and text is not null and length(trim(text)) > 0").select("lang", "text", F.xxhash64("text").alias("h"))
    texts = stage(usable.groupBy("lang", "h").agg(F.min(F.length("text")).alias("n")))
    parts = F.ceil(F.col("n") / F.lit(float(per_text))).cast("long")
    turns = F.sequence(F.lit(0).cast("long"), F.least(F.col("parts"), F.lit(-(-chars // per_text))) - 1)
    spans = texts.withColumn("parts", parts).withColumn("turn", F.explode(turns)).select(
        "lang", "h", "turn", "n", F.shiftrightunsigned("h", 52).alias("slot"), F.pmod(F.pmod(F.xxhash64("h"), "parts") + F.col("turn"), "parts").alias("part")
    )
    spans = spans.withColumn("size", F.least(F.lit(per_text), F.col("n") - F.col("part") * per_text) + 1)
    chosen = spans
    for keys in (["turn"], ["turn", "slot"], ["turn", "slot", "h"]):
        chosen = chosen.join(F.broadcast(_first(chosen, keys, chars)), ["lang", *keys])
    at = (F.col("part") * per_text + 1).cast("int")
    cut = usable.join(F.broadcast(stage(chosen.select("lang", "h", "turn", "slot", "part"))), ["lang", "h"])
    cut = cut.groupBy("lang", "turn", "slot", "h").agg(F.min(F.substr("text", at, F.lit(per_text))).alias("text"))
    out: dict[str, str] = {}
    for r in sorted(cut.collect(), key=lambda r: (r["lang"], r["turn"], r["slot"], r["h"])):
        out[r["lang"]] = (out.get(r["lang"], "") + r["text"] + "\n")[:chars]
    return out


def identify(docs: DataFrame, train: DataFrame, chars: int = CHARS, per_text: int = PER_TEXT) -> Column:
    """Column of struct<lang_pred, score> for the text of ``docs``, learned from ``train``.

    Each language's sample becomes a suffix automaton. A text is cut into segments of
    ``SEGMENT`` characters (all of it), each parsed into longest matches with the automaton; a
    phrase costs log2 of the sample's length, and the cheapest language wins, the first in
    order among equals. The score is the runner-up's cost over the sum of both, 0.5 to 1.
    Characters count in lower case; one that a language's sample lacks ends its phrase, and beyond the ``OWN`` most
    frequent of a sample characters share columns by hash. ``und`` and score 0 for null texts, texts without a letter, and where
    nothing was learned. Languages that are null are not learned.
    """
    parser = carried(docs.sparkSession, Parser(samples(train, chars, per_text)))

    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
        for texts in batches:
            parts = []
            for a in range(0, len(texts), 4096):
                names, score = parser().predict(texts.slice(a, 4096))
                parts.append(pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score)], names=["lang_pred", "score"]))
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    return arrow_udf(predicted, "struct<lang_pred:string,score:double>")("text")
