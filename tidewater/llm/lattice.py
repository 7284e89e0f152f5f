"""Log probability of texts under a subword unigram model, summed over all segmentations of each word."""

from __future__ import annotations

import copy
import itertools
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .repeats import Slices

#: Stands for the start of a word: white space is in no word.
START = b" "
FREQUENT = 1 << 16
#: Share of the freed weight for words of other parts; the rest is for segmentations.
ELSEWHERE = 0.05


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a sentencepiece model and all single bytes, with their scores.

    The model's scores order the pieces; the weight of a piece falls as one over its place in that order.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        plain = not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        if plain and b" " not in piece[1:]:
            found[piece] = max(found.get(piece, -math.inf), model.get_score(i))
    last = min(found.values(), default=0.0) - 1000
    for b in range(256):
        found.setdefault(bytes([b]), last)
    weight = 1 / (10 - np.array(list(found.values())))
    return list(found), np.log(weight / weight.sum())


class Lattice:
    """Forward (and backward) recursion over the segmentations of many words at once, in log space.

    log_p has an entry for each piece, or a row of them for each model.
    """

    def __init__(self, pieces: list[bytes], log_p: np.ndarray) -> None:
        self.log_p = self._open(log_p)
        self.size = len(pieces)
        self.longest = max(map(len, pieces))
        self.slots: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_length: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            by_length.setdefault(len(piece), []).append(i)
        for m, ids in by_length.items():
            data = np.frombuffer(b"".join(pieces[i] for i in ids), dtype=np.uint8)
            at = np.arange(len(ids)) * m
            h = Slices(data).of(at, at + m)
            order = np.argsort(h)
            self.slots[m] = (h[order], np.array(ids)[order])
        self.tables = {m: self._table(*x) for m, x in self.slots.items()}

    @staticmethod
    def _open(log_p: np.ndarray) -> np.ndarray:
        return np.concatenate([log_p, np.full((*log_p.shape[:-1], 1), -np.inf)], axis=-1)

    def of(self, log_p: np.ndarray) -> Lattice:
        """The same pieces with other weights."""
        other = copy.copy(self)
        other.log_p = self._open(log_p)
        return other

    def _table(self, hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Open addressing in eight slots for each piece or more, filled in rounds: hash and piece of each slot, and how far an entry can lie from its own."""
        room = 1 << (8 * len(hashes)).bit_length()
        mask = room - 1
        keys, held = np.zeros(room, dtype=np.uint64), np.full(room, self.size)
        steps = 0
        while len(hashes):
            slot = ((hashes & np.uint64(mask)).astype(np.int64) + steps) & mask
            free = held[slot] == self.size
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            first = first[free[first]]
            keys[slot[first]], held[slot[first]] = hashes[first], ids[first]
            rest = np.ones(len(hashes), dtype=bool)
            rest[first] = False
            hashes, ids, steps = hashes[rest], ids[rest], steps + 1
        return keys, held, steps

    def _pieces(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Groups of words of one length: their places in `words`, and the piece from each place for each length."""
        lengths = np.array([len(w) for w in words])
        for length in np.unique(lengths):
            every = np.flatnonzero(lengths == length)
            room = max(1, (1 << 18) // int(length))
            for a in range(0, len(every), room):
                rows = every[a : a + room]
                data = np.frombuffer(b"".join(words[i] for i in rows), dtype=np.uint8)
                slices = Slices(data)
                most = min(self.longest, int(length))
                found = np.full((most + 1, len(data)), self.size)
                for m in range(1, most + 1):
                    if m not in self.tables:
                        continue
                    keys, held, steps = self.tables[m]
                    mask = np.int64(len(keys) - 1)
                    h = slices.each(m, 0, len(data) - m + 1)
                    for step in range(steps):
                        slot = ((h & np.uint64(mask)).astype(np.int64) + step) & mask
                        hit = keys[slot] == h
                        found[m, : len(h)][hit] = held[slot[hit]]
                found = found.reshape(most + 1, len(rows), length)
                for m in range(2, most + 1):
                    found[m, :, length - m + 1 :] = self.size
                yield rows, found

    @staticmethod
    def _sum(parts: list[np.ndarray]) -> np.ndarray:
        x = np.stack(parts)
        top = x.max(axis=0)
        return top + np.log(np.exp(x - np.where(np.isfinite(top), top, 0)).sum(axis=0))

    def _forward(self, found: np.ndarray) -> np.ndarray:
        most, n, length = found.shape
        alpha = np.full((length + 1, *self.log_p.shape[:-1], n), -np.inf)
        alpha[0] = 0
        for j in range(1, length + 1):
            alpha[j] = self._sum([alpha[j - m] + self.log_p[..., found[m, :, j - m]] for m in range(1, min(most, j + 1))])
        return alpha

    def score(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the summed probability of all segmentations of each word."""
        out = np.zeros((*self.log_p.shape[:-1], len(words)))
        for rows, found in self._pieces(words):
            out[..., rows] = self._forward(found)[-1]
        return out

    def expected(self, words: list[bytes], times: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece, over `times` of each word."""
        total = np.zeros(self.size + 1)
        for rows, found in self._pieces(words):
            most, n, length = found.shape
            alpha = self._forward(found)
            beta = np.full((length + 1, n), -np.inf)
            beta[length] = 0
            for i in range(length - 1, -1, -1):
                beta[i] = self._sum([beta[i + m] + self.log_p[found[m, :, i]] for m in range(1, min(most, length - i + 1))])
            uses = np.zeros(found.shape)
            for m in range(1, most):
                ends = length - m + 1
                uses[m, :, :ends] = np.exp(alpha[:ends].T + self.log_p[found[m, :, :ends]] + beta[m:].T - alpha[length][:, None]) * times[rows][:, None]
            total += np.bincount(found.ravel(), weights=uses.ravel(), minlength=self.size + 1)
        return total[:-1]


def gathered(batches: Iterator[pd.DataFrame], least: int = 100_000) -> Iterator[pd.DataFrame]:
    """The rows of the batches in tables of `least` rows or a little more: words of one length are worked on together."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= least:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def tokens(text: object) -> list[bytes]:
    """Words, A-Z lower-cased."""
    return text.encode().lower().split() if isinstance(text, str) else []


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts of words by group, in training texts and in all, passed on whenever they grow large."""
    counts: dict[tuple[int, bool], Counter] = {}

    def table() -> pd.DataFrame:
        parts = [pd.DataFrame({"word": pd.Series(list(c), dtype=object), "part": k, "n_train": n * (not held), "n_fold": n * fold, "n_all": n}) for (k, held, fold), c in counts.items() for n in [np.fromiter(c.values(), dtype=np.int64, count=len(c))]]
        return pd.concat(parts)

    for batch in batches:
        for text, held, fold, part in zip(batch["_text"], batch["_held_out"], batch["_fold"], batch["_part"], strict=True):
            counts.setdefault((part, held, fold), Counter()).update(tokens(text))
        if sum(map(len, counts.values())) > 500_000:
            yield table()
            counts.clear()
    if counts:
        yield table()


def score(
    docs: DataFrame, held_out: str, pieces_path: str, text: str = "text", part: str | None = "lang", carry: list[str] | None = None,
    rounds: int = 3, prior: float = 100.0, most_parts: int = 16,
) -> DataFrame:
    """Adds n_tokens, n_known, train_tokens, base_score and score (log10) to the columns `carry`.

    Rows whose `held_out` is false are the training texts. A word's probability is a sum over all its segmentations
    into pieces of the existing vocabulary, whose weights start from the vocabulary's scores and are refined by
    `rounds` of expectation-maximisation over all distinct training words, each once (with `prior` uses spread as at the start); a
    training word is a further piece on its own, weighted by its count less a discount, and what the discounts free
    weighs the segmentations: as much as the rate of new words in a fifth of the training texts against the others. Weights are kept per value of `part` in the training texts (the `most_parts` - 1 most
    frequent, the rest together); each text's probability is the mean over the parts, by their shares, of the product over its
    words and its end. Discounted counts, what they free and the end make a whole, and so do a part's segmentations, as
    the next word's START is what ends a word: probabilities of all texts sum to 1 at most. So it is marginal over segmentations and parts and needs no `part` of the text. base_score is that of
    whole words with half a count added.

    The most frequent words, FREQUENT at most (a fixed bound), are looked up in memory; the others by a join. How
    frequent they must be is read from a histogram of 64 steps a doubling, so the driver gets no more rows than that. A null text is
    empty (it is its end only); a null `held_out` is false; repeated rows are documents of their own; without
    training texts the weights stay as they start; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    carry = carry if carry is not None else [c for c in docs.columns if c not in (text, part)]
    own_names = [f"_c{i}" for i in range(len(carry))]
    held = F.coalesce(F.col(held_out), F.lit(False))
    labels = [r[0] for r in docs.filter(~held).groupBy(part).count().orderBy(F.col("count").desc(), part or "count").limit(most_parts - 1).collect()] if part else [0]
    k_all = len(labels) + 1
    number = F.lit(k_all - 1)
    for k, label in enumerate(labels):
        number = F.when(F.col(part).eqNullSafe(F.lit(label)) if part else F.lit(True), k).otherwise(number)
    given = docs.select(
        *(F.col(c).alias(n) for c, n in zip(carry, own_names, strict=True)), held.alias("_held_out"), number.alias("_part"), F.col(text).alias("_text"),
        (~held & (F.pmod(F.xxhash64(*carry, text), F.lit(5)) == 0)).alias("_fold"),
    )
    partial = given.select("_text", "_held_out", "_part", "_fold").mapInPandas(_count, "word binary, part int, n_train long, n_fold long, n_all long")
    words = shared.save(
        partial.groupBy("word").agg(
            F.sum("n_train").alias("n_train"), F.sum("n_fold").alias("n_fold"), F.sum("n_all").alias("n_all"),
            *(F.sum(F.when(F.col("part") == k, F.col("n_train")).otherwise(0)).alias(f"_k{k}") for k in range(k_all)),
        ),
        "words",
    )
    ends_by_part = dict(given.filter("NOT _held_out").groupBy("_part").count().collect())
    ends_k = np.array([ends_by_part.get(k, 0) for k in range(k_all)], dtype=float)
    ends = int(ends_k.sum())
    totals = words.agg(
        F.coalesce(F.sum("n_train"), F.lit(0)), F.count(F.when(F.col("n_train") > 0, 1)),
        *(F.coalesce(F.sum(f"_k{k}"), F.lit(0)) for k in range(k_all)), *(F.count(F.when(F.col(f"_k{k}") > 0, 1)) for k in range(k_all)),
        F.coalesce(F.sum("n_fold"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("n_fold") == F.col("n_train"), F.col("n_fold"))), F.lit(0)),
    ).first()
    n_train, distinct, (in_fold, new_in_fold) = totals[0] + ends, totals[1], totals[-2:]
    n_k, v_k = np.array(totals[2 : 2 + k_all]) + ends_k, np.array(totals[2 + k_all : 2 + 2 * k_all], dtype=float)
    discount = min(0.9, max(0.01, (new_in_fold + 1) / (in_fold + 2) * n_train / max(distinct, 1)))
    base_log = lambda c: np.log10((c + 0.5) / (n_train + 0.5 * (distinct + (ends > 0) + 1)))

    pieces, start = vocabulary(pieces_path)
    log_p = np.tile(start, (k_all, 1))
    for _ in range(rounds):
        model = spark.sparkContext.broadcast((pieces, log_p))

        def expect(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            lattice = Lattice(*model.value)
            total = np.zeros(model.value[1].shape)
            for batch in gathered(batches):
                words_ = np.array([START + bytes(w) for w in batch["word"]], dtype=object)
                for k in range(k_all):
                    own = words_[batch[f"_k{k}"].to_numpy() > 0]
                    total[k] += lattice.of(model.value[1][k]).expected(list(own), np.ones(len(own)))
            k, used = np.nonzero(total)
            yield pd.DataFrame({"k": k, "piece": used, "uses": total[k, used]})

        trained = words.filter("n_train > 0").drop("n_train", "n_fold", "n_all")
        uses = trained.mapInPandas(expect, "k int, piece int, uses double").groupBy("k", "piece").agg(F.sum("uses").alias("uses")).toPandas()
        total = np.tile(prior * np.exp(start), (k_all, 1))
        total[uses["k"].to_numpy(dtype=int), uses["piece"].to_numpy(dtype=int)] += uses["uses"].to_numpy()
        log_p = np.log(total / total.sum(axis=1, keepdims=True))
    model = spark.sparkContext.broadcast((pieces, log_p))
    free = (discount * v_k + 0.5) / (n_k + 1)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(*model.value)
        for batch in gathered(batches, 30_000):
            c = batch["n_train"].to_numpy(dtype=float)
            segmented = lattice.score([START + bytes(w) for w in batch["word"]])
            every = np.log(np.maximum(ELSEWHERE * np.maximum(c - discount, 0) / (n_train + 1), 1e-300))
            out = {"word": batch["word"], "n_all": batch["n_all"], "known": (c > 0).astype(int), "base": base_log(c)}
            for k in range(k_all):
                mine = np.log(np.maximum(np.maximum(batch[f"_k{k}"].to_numpy(dtype=float) - discount, 0) / (n_k[k] + 1), 1e-300))
                rest = np.logaddexp(segmented[k] + math.log(1 - ELSEWHERE), every) + math.log(free[k])
                out[f"_k{k}"] = np.logaddexp(mine, rest) / math.log(10)
            yield pd.DataFrame(out)

    sums = ["known", "base", *(f"_k{k}" for k in range(k_all))]
    kinds = "known long, base double, " + ", ".join(f"_k{k} double" for k in range(k_all))
    weighed = shared.save(words.mapInPandas(weigh, f"word binary, n_all long, {kinds}"), "words-weighed")
    step = F.floor(F.log2(F.col("n_all").cast("double")) * 64)
    room, least_step = FREQUENT, math.inf
    for row in sorted(weighed.groupBy(step.alias("step")).count().collect(), reverse=True):
        room -= row["count"]
        if room < 0:
            break
        least_step = row["step"]
    top = weighed.filter(step >= F.lit(float(least_step))).select("word", *sums).toPandas()
    frequent = spark.sparkContext.broadcast(({bytes(w): i for i, w in enumerate(top["word"])}, top[sums].to_numpy(dtype=float).reshape(-1, len(sums))))

    def look_up() -> Callable[[pd.DataFrame], Iterator[tuple[pd.DataFrame, np.ndarray]]]:
        """One row a document (word: none) and one for each of its words that isn't frequent."""
        (place_of, values), part_id, rows = frequent.value, TaskContext.get().partitionId(), itertools.count(1)

        def work(batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
            document, found, rest = [], [], []
            for text_ in batch["_text"]:
                row = part_id << 40 | next(rows)
                counts = Counter(tokens(text_))
                at = np.array([place_of.get(w, -1) for w in counts], dtype=np.int64)
                n = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
                inside = at >= 0
                document.append((row, int(n[inside].sum())))
                found.append(n[inside] @ values[at[inside]] if inside.any() else np.zeros(len(sums)))
                rest += [(row, w, k) for w, k, i in zip(counts, n.tolist(), inside.tolist(), strict=True) if not i]
            out = pd.DataFrame(document, columns=["_row", "n"])
            out["word"] = None
            out[sums] = np.array(found).reshape(-1, len(sums))
            yield out.astype({"known": "int64"}), np.arange(len(batch))
            for a in range(0, len(rest), 50_000):
                tail = pd.DataFrame(rest[a : a + 50_000], columns=["_row", "word", "n"]).reindex(columns=["_row", "word", "n", *sums])
                yield tail.astype({"known": "Int64"}), np.full(len(tail), -1)

        return work

    parts = shared.save(shared.beside(given.select(*own_names, "_text"), own_names, f"_row long, n long, word binary, {kinds}", look_up), "word-rows")
    rest = (
        parts.filter("word IS NOT NULL").select("_row", "word", "n").join(weighed.select("word", *sums), "word")
        .groupBy("_row").agg(F.sum("n").alias("_n"), *(F.sum(F.col("n") * F.col(c)).alias(f"_more_{c}") for c in sums))
    )
    zero = F.lit(0)
    joined = parts.filter("word IS NULL").join(rest, "_row", "left")
    added = lambda c: F.col(c) + F.coalesce(F.col(f"_more_{c}"), zero)
    share = (ends_k + 1 / k_all) / (ends + 1)
    end = (ends_k + 0.5) / (n_k + 1)
    each = [added(f"_k{k}") + float(math.log10(share[k]) + math.log10(end[k])) for k in range(k_all)]
    top_one = F.greatest(*each) if k_all > 1 else each[0]
    return joined.select(
        *(F.col(n).alias(c) for c, n in zip(carry, own_names, strict=True)),
        (F.col("n") + F.coalesce("_n", zero) + 1).alias("n_tokens"),
        (added("known") + int(ends > 0)).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (added("base") + float(base_log(ends))).alias("base_score"),
        (top_one + F.log10(sum((F.pow(F.lit(10.0), x - top_one) for x in each[1:]), F.pow(F.lit(10.0), each[0] - top_one)))).alias("score"),
    )
