"""Language-model scoring by a weighted backoff automaton (operator 1).

The model is a smoothed bigram model over words (Witten-Bell, interpolated). As an
automaton it has a root and a state for each word seen in training. The root has an
arc for each known word and one for the unknown word; a word's state has an arc for
each bigram seen in training, with its interpolated log probability, and a failure arc
to the root with the weight log(T / (c + T)), where c counts the word and T its
different followers. A text is read once from left to right: a known bigram follows its
arc, any other pays the failure arc and takes the root's; either leads to the state of
the word read, or to the root if that is unknown. All texts of a batch are read side by
side, each carrying its state and its sum.

The root: P(w) = c / (N + V) for a known word and V / (N + V) for the unknown one, with N
training tokens of V kinds; it sums to 1 over the V words and the unknown one.

The corpus's counts are exact and sharded (``sharded``): no table of words or bigrams is
ever whole anywhere. A block of documents sends its distinct bigrams and words with
counts, the shards add them up and find the followers of each word, and answer each
block with the arcs of its own words; that part of the automaton is all a block needs.
What a block isn't told it knows: a word or bigram of a training text that no answer
names was seen once, there; one of a held-out text was never seen. Words are told apart
by 64-bit fingerprints, a bigram's context by 48 bits of it, its follower and its answer
by 56: with 64 everywhere, what the shards are sent would pass four times the input.

Defined results: a null text is an empty one, of one token, the end; rows are scored one
by one, repeated rows train and score as often as they occur; without training rows
N and V are 0, base is 0 tokens' worth (log10(0.1 / 0.1) each) and the score is 0; an
empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prescriva.llm import shared, sharded
from prescriva.llm.wordhash import WHITE, mix, word_hashes

END = np.uint64(0xE5D1E5D1E5D1E5D1)
START = np.uint64(0x57A2757A2757A275)
SPREAD = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def sequences(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(tokens, the token before each or START, tokens in each text) of runs of texts; END ends each text."""
    for hashes, counts in word_hashes(column, WHITE):
        lengths = counts + 1
        ends = np.cumsum(lengths)
        tokens = np.full(ends[-1], END, dtype=np.uint64)
        word = np.ones(len(tokens), dtype=bool)
        word[ends - 1] = False
        tokens[word] = hashes
        before = np.concatenate([[START], tokens[:-1]])
        before[ends - lengths] = START
        yield tokens, before, lengths


def _context(words: np.ndarray) -> np.ndarray:
    return words >> np.uint64(16)


def _home(contexts: np.ndarray, shards: int) -> np.ndarray:
    return mix(contexts) % np.uint64(shards)


def _pair(contexts: np.ndarray, followers: np.ndarray) -> np.ndarray:
    """A bigram's 64-bit name from its context's 48 bits and its follower's 56."""
    return mix(mix(contexts) * _ODD + followers)


def _flags(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("train").to_pylist(), dtype=np.uint64)


def _count_words(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    train, at, parts = _flags(batch), 0, []
    for tokens, _, lengths in sequences(batch.column("text")):
        own = np.repeat(train[at : at + len(lengths)], lengths)
        parts.append(sharded.summed(tokens, own, np.uint64(1) - own))
        at += len(lengths)
    parts.append((np.array([START]), np.array([train.sum()], dtype=np.uint64), np.array([len(train)], dtype=np.uint64)))
    return sharded.summed(*map(np.concatenate, zip(*parts, strict=True)))


def _count_pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    train, at, parts = _flags(batch), 0, []
    for tokens, before, lengths in sequences(batch.column("text")):
        own = np.repeat(train[at : at + len(lengths)], lengths)
        contexts, followers = _context(before), tokens >> np.uint64(8)
        parts.append((_pair(contexts, followers), contexts, followers, own, np.uint64(1) - own))
        at += len(lengths)
    return _merge_pairs(parts)


def _merge_pairs(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    keys, contexts, followers, seen, held = map(np.concatenate, zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], contexts[order[starts]], followers[order[starts]], np.add.reduceat(seen[order], starts), np.add.reduceat(held[order], starts)


def _value(seen: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Count in training texts, and whether a held-out text of the block asks as well."""
    return seen * np.uint64(2) + (held > 0)


def ask_pairs(docs: DataFrame, shards: int) -> DataFrame:

    def merge(parts):
        _, contexts, followers, seen, held = _merge_pairs(parts)
        order = np.argsort(contexts, kind="stable")
        contexts, followers = contexts[order], followers[order]
        shard = (_home(contexts, shards) + followers % np.uint64(SPREAD)) % np.uint64(shards)
        return shard.astype(np.int64), [contexts, followers, _value(seen, held)[order]], 1

    return sharded.ask(docs, _count_pairs, merge)


def ask_words(docs: DataFrame, shards: int) -> DataFrame:

    def merge(parts):
        words, seen, held = sharded.summed(*map(np.concatenate, zip(*parts, strict=True)))
        return _home(_context(words), shards).astype(np.int64), [words, _value(seen, held)], 1

    return sharded.ask(docs, _count_words, merge)


def reply_pairs(shards: int):
    """Totals of bigrams to the blocks (kind 2), and each context's number of followers to its own shard (kind 1)."""

    def reply(shard: int, rows: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, int, bytes]]:
        bodies = [sharded.unpack(b) for _, _, b in rows]
        keys = [_pair(c, f) for c, f, _ in bodies]
        contexts = np.concatenate([b[0] for b in bodies])
        order = np.argsort(flat := np.concatenate(keys), kind="stable")
        flat, new = flat[order], np.ones(len(flat), dtype=bool)
        new[1:] = flat[1:] != flat[:-1]
        starts, group = np.flatnonzero(new), np.cumsum(new) - 1
        totals = np.add.reduceat(np.concatenate([b[2] >> np.uint64(1) for b in bodies])[order], starts)
        back = np.empty(len(flat), dtype=np.uint64)
        back[order] = totals[group]
        at = 0
        for (block, _, _), own, (_, _, value) in zip(rows, keys, bodies, strict=True):
            total = back[at : at + len(own)]
            at += len(own)
            told = (total >= 2) | ((value & np.uint64(1) > 0) & (total >= 1))
            names = own[told] >> np.uint64(8)
            by = np.argsort(names, kind="stable")
            if len(names):
                yield shard, block, 2, sharded.pack(names[by], total[told][by])
        alive = contexts[order[starts]][totals > 0]
        alive, followers = sharded.summed(alive, np.ones(len(alive), dtype=np.uint64))
        homes = _home(alive, shards)
        for home in np.unique(homes):
            own = homes == home
            yield int(home), -1, 1, sharded.pack(alive[own], followers[own])

    return reply


def reply_words(shard: int, rows: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, int, bytes]]:
    """Counts and followers of words to the blocks (kind 3), and the shard's training tokens and kinds (kind 9)."""
    asked = [(block, *sharded.unpack(b)) for block, kind, b in rows if kind == 0]
    told = [sharded.unpack(b) for _, kind, b in rows if kind == 1]
    if not asked:
        return
    words, counts = sharded.summed(np.concatenate([w for _, w, _ in asked]), np.concatenate([v >> np.uint64(1) for _, _, v in asked]))
    followers = np.zeros(len(words), dtype=np.uint64)
    if told:
        contexts, sums = sharded.summed(np.concatenate([t[0] for t in told]), np.concatenate([t[1] for t in told]))
        at = np.minimum(np.searchsorted(contexts, _context(words)), len(contexts) - 1)
        followers = np.where(contexts[at] == _context(words), sums[at], 0).astype(np.uint64)
    real = (words != START) & (counts > 0)
    yield shard, -1, 9, sharded.pack(np.array([counts[real].sum(), real.sum()], dtype=np.uint64), ascending=0)
    for block, own, value in asked:
        at = np.searchsorted(words, own)
        c, t = counts[at], followers[at]
        tell = (c >= 2) | (t >= 2) | ((value & np.uint64(1) > 0) & (c >= 1))
        if tell.any():
            yield shard, block, 3, sharded.pack(own[tell], c[tell], t[tell])


def _look_up(keys: np.ndarray, values: list[np.ndarray], wanted: np.ndarray) -> tuple[np.ndarray, ...]:
    """(found, value of each) for each wanted key."""
    distinct, inverse = np.unique(wanted, return_inverse=True)
    if not len(keys):
        return np.zeros(len(wanted), dtype=bool), *(np.zeros(len(wanted)) for _ in values)
    at = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
    found = keys[at] == distinct
    return found[inverse], *(np.where(found, v[at], 0).astype(np.float64)[inverse] for v in values)


class BlockAutomaton:
    """The states and arcs that a block's texts can reach."""

    def __init__(self, answers: dict[int, list[bytes]], tokens: int, kinds: int):
        self.n, self.v = tokens, kinds
        for kind, fields in ((2, 2), (3, 3)):
            parts = [sharded.unpack(b) for b in answers.get(kind, [])]
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.uint64)] * fields
            order = np.argsort(columns[0], kind="stable")
            setattr(self, f"kind{kind}", [c[order] for c in columns])

    def score(self, column: pa.Array, train: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(tokens, known tokens, base, score) for each text of runs of texts."""
        words, counts, followers = self.kind3
        at = 0
        for tokens, before, lengths in sequences(column):
            own = train[at : at + len(lengths)]
            at += len(lengths)
            alone = np.repeat(own, lengths).astype(np.float64)
            found, c, t = _look_up(words, [counts, followers], tokens)
            c, t = np.where(found, c, alone), np.where(found, t, alone)
            first = np.cumsum(lengths) - lengths
            known = c > 0
            base = np.add.reduceat(np.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1))), first)
            if not self.n:
                yield lengths, np.zeros(len(lengths)), base, np.zeros(len(lengths))
                continue
            found, pair = _look_up(self.kind2[0], [self.kind2[1]], _pair(_context(before), tokens >> np.uint64(8)) >> np.uint64(8))
            pair = np.where(found, pair, alone)
            c_before, t_before = np.concatenate([[0.0], c[:-1]]), np.concatenate([[0.0], t[:-1]])
            starts = np.searchsorted(words, START)
            seen = starts < len(words) and words[starts] == START
            c_before[first] = counts[starts] if seen else own
            t_before[first] = followers[starts] if seen else own
            root = np.where(known, c, self.v) / (self.n + self.v)
            with np.errstate(divide="ignore", invalid="ignore"):
                arc = np.where(pair > 0, np.log10((pair + t_before * root) / (c_before + t_before)), np.nan)
                failure = np.log10(t_before / (c_before + t_before))
            yield lengths, np.add.reduceat(known.astype(np.int64), first), base, _traverse(first, lengths, np.log10(root), arc, failure, known, c_before[first] > 0)


def _traverse(first: np.ndarray, lengths: np.ndarray, root: np.ndarray, arc: np.ndarray, failure: np.ndarray, known: np.ndarray, start: np.ndarray) -> np.ndarray:
    """One reading of all texts, token by token: carries for each whether it is in its last word's state or at the root, and its sum.

    ``arc`` and ``failure`` hold, at each token, the weights that leave the state of the
    token before (nan where that state has no arc for this token).
    """
    order = np.argsort(-lengths, kind="stable")
    at, left = first[order].copy(), lengths[order]
    alive, in_state, sums = len(order), start[order].copy(), np.zeros(len(order))
    for step in range(int(left[0]) if len(left) else 0):
        while alive and left[alive - 1] <= step:
            alive -= 1
        here = at[:alive] + step
        weight, lives = arc[here], in_state[:alive]
        backed = root[here] + np.where(lives, failure[here], 0.0)
        sums[:alive] += np.where(lives & ~np.isnan(weight), weight, backed)
        in_state[:alive] = known[here]
    out = np.empty(len(order))
    out[order] = sums
    return out


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """SCORED rows of all ``docs`` (doc_id, text), learned from those that aren't ``held_out``."""
    docs = sharded.from_files(docs)
    ready = sharded.with_blocks(docs.withColumn("train", ~held_out), ["doc_id", "text", "train"])
    texts, shards = ready.select("text", "train", "block"), sharded.shards_of(docs)
    told = shared.written(sharded.answer(ask_pairs(texts, shards), reply_pairs(shards)), "pairs")
    words = sharded.answer(ask_words(texts, shards).union(told.where("kind = 1")), reply_words)
    path = sharded.write_answers(words.union(told.where("kind = 2")), "automaton", shards)
    shared.drop_table(told)
    sums = [sharded.unpack(b, ascending=0)[0] for b in sharded.Answers(path).of(-1).get(9, [])]
    n, v = int(sum(int(s[0]) for s in sums)), int(sum(int(s[1]) for s in sums))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers, now, automaton = sharded.Answers(path), None, None
        for block, batch in sharded.by_block(batches):
            if block != now:
                now, automaton = block, BlockAutomaton(answers.of(block), n, v)
            train = np.array(batch.column("train").to_pylist(), dtype=bool)
            parts = list(automaton.score(batch.column("text"), train))
            tokens, known, base, total = (np.concatenate(c) for c in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(~train), pa.array(tokens.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(train), n, dtype=np.int64)), pa.array(base), pa.array(total)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )
        shared.give_back()

    return ready.mapInArrow(run, SCORED)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` scored; rows whose crc32(doc_id) mod 10 is 0 are held out."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared.crc_mod("doc_id", 10) == 0)
