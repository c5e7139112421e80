"""Language identification by cross-parsing entropy (operator 6).

A suffix automaton is built of labelled text of each language. A text is parsed from
left to right into phrases, each the longest match of what follows in that automaton
(and at least one character); the fewer phrases a character of text needs, the smaller
the cross entropy. The language with the fewest phrases for each letter wins; of equal
ones, the one whose name sorts first.

Training takes a bounded sample of labelled rows: for each language, rows in the order
of a hash of doc_id, whole texts, each if together with those before they are at most
``max_chars`` characters. Where that fills less than half, as in a language whose texts
are all longer, a span of one longer text, from its first letter on, fills up the rest.
Automata are built on the driver, become one transition table each (states
x alphabet) and are sent to the tasks; their size is bounded by ``max_chars`` and not by
the data. A text is reduced to small letters and single spaces and parsed whole. To read
long texts side by side, all segments of ``SEGMENT`` characters are first parsed as if a
phrase began with each; then the phrase that really enters a segment is followed until
its state is that of the first parse, from where on both agree, and the count is
corrected. So phrases cross segments, and counts are those of one reading.

Defined results: a null text, and one without a letter, is ``und`` with score 0, and so
is every text when nothing was learned. The score is the winner's share of
exp(-phrases for 100 letters) among all learned languages, from 0 to 1; ``lang_rate``
is the winner's phrases for 100 letters, null for ``und``. Rows are
independent, so repeated rows and other columns change nothing; an empty table gives an
empty one. Rows with a null label or null text are not learned from.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from prescriva.llm import shared

SEGMENT = 256
#: Counts of so many labels are sent to all tasks, and joined by a shuffle beyond.
MOST_LANGUAGES = 10_000
#: Characters of all languages' samples; a model has some fifty bytes for each.
ALL_CHARS = 4_000_000
#: Ranked rows of a language whose texts are too long to be taken whole; one is used.
LONG_ROWS = 8
NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Small letters, and one space for each run of anything else; empty without a letter (signs such as ½ are none)."""
    out = NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    return out if any(map(str.isalpha, out)) else ""


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the smallest automaton that reads exactly the substrings of ``text``; state 0 is the start."""
    moves: list[dict[str, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return moves


@dataclass
class Transitions:
    """An automaton's moves as a double array: that of a state by a code stands in slot ``base[state] + code``, if ``owner`` of the slot is the state.

    A state without a move by a code goes where the start does, by ``root``: its entries
    are negative, as a phrase ends before such a character: -1 - s, where s is the state
    after a new phrase has taken it. The last state has no moves; it stands before a text
    and behind an unknown character, a phrase of its own. Slots number about as many as
    moves, whatever the alphabet.
    """

    base: np.ndarray
    owner: np.ndarray
    to: np.ndarray
    root: np.ndarray

    @property
    def begin(self) -> int:
        return len(self.base) - 1

    @property
    def nbytes(self) -> int:
        return self.base.nbytes + self.owner.nbytes + self.to.nbytes + self.root.nbytes

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        at = self.base[state] + code
        return np.where(self.owner[at] == state, self.to[at], self.root[code])

    def step_one(self, state: int, code: int) -> int:
        at = self.base.item(state) + code
        return self.to.item(at) if self.owner.item(at) == state else self.root.item(code)

    @classmethod
    def of(cls, moves: list[dict[str, int]], code_of: dict[str, int], width: int) -> Transitions:
        """``width``: the codes' number, 0 for unknown characters included. States of most moves are placed first, each in the first slots that fit, near where the last one was; those of one move fill the gaps."""
        total, window = sum(map(len, moves)), 2048
        taken = np.zeros(2 * width + 2 * total + window, dtype=bool)
        taken[:width] = True
        base = np.zeros(len(moves) + 1, dtype=np.int64)
        codes = [np.sort(np.array([code_of[c] for c in own], dtype=np.int64)) for own in moves]
        last = width
        for s in sorted((s for s, own in enumerate(moves) if len(own) > 1), key=lambda s: -len(moves[s])):
            apart, at = codes[s] - codes[s][0], max(width, last - window)
            while True:
                if at + window + width >= len(taken):
                    taken = np.concatenate([taken, np.zeros(len(taken), dtype=bool)])
                free = at + np.flatnonzero(~taken[at : at + window])
                fits = np.flatnonzero(~taken[free[:, None] + apart].any(axis=1))
                if len(fits):
                    break
                at += window
            last = int(free[fits[0]])
            taken[last + apart] = True
            base[s] = last - codes[s][0]
        ones = [s for s, own in enumerate(moves) if len(own) == 1]
        gaps = np.flatnonzero(~np.concatenate([taken, np.zeros(len(ones), dtype=bool)]))[: len(ones)]
        base[ones] = gaps - np.array([codes[s][0] for s in ones], dtype=np.int64)
        size = int(base.max(initial=0)) + width + 1
        owner, to = np.full(size, -1, dtype=np.int32), np.zeros(size, dtype=np.int32)
        for s, own in enumerate(moves):
            for c, target in own.items():
                owner[base[s] + code_of[c]], to[base[s] + code_of[c]] = s, target
        root = np.full(width, -1 - len(moves), dtype=np.int32)
        for c, target in moves[0].items():
            root[code_of[c]] = -1 - target
        return cls(base, owner, to, root)


@dataclass
class LanguageModel:
    """``codes``: code point -> code, 0 for unknown ones; ``tables``: language -> transitions."""

    codes: np.ndarray
    tables: dict[str, Transitions]

    @classmethod
    def of(cls, samples: dict[str, str]) -> LanguageModel:
        alphabet = sorted({ord(c) for s in samples.values() for c in s})
        codes = np.zeros(max(alphabet, default=0) + 2, dtype=np.int32)
        codes[alphabet] = np.arange(1, len(alphabet) + 1)
        code_of = {chr(c): i for i, c in enumerate(alphabet, start=1)}
        return cls(codes, {name: Transitions.of(suffix_automaton(samples[name]), code_of, len(alphabet) + 1) for name in sorted(samples)})

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(characters of each text, phrases of each text for each language)."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        columns = self.codes[np.minimum(points, len(self.codes) - 1)]
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        segments = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), segments)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(segments) - segments, segments)
        starts = np.repeat(np.cumsum(sizes) - sizes, segments) + within * SEGMENT
        lengths = np.minimum(SEGMENT, np.repeat(sizes, segments) - within * SEGMENT)
        order = np.argsort(-lengths, kind="stable")
        lengths, starts, owner = lengths[order], starts[order], owner[order]
        # Where each segment that isn't its text's first stands, and the one before it.
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        later = np.flatnonzero(within > 0)
        place = (place[later], place[later - 1])
        lanes = np.searchsorted(-lengths, -np.arange(1, SEGMENT + 1), "right")
        out = np.zeros((len(texts), len(self.tables)))
        for k, table in enumerate(self.tables.values()):
            state, count = np.full(len(starts), table.begin), np.zeros(len(starts), dtype=np.int64)
            for t, n in enumerate(lanes):
                if not n:
                    break
                to = table.step(state[:n], columns[starts[:n] + t])
                ended = to < 0
                count[:n] += ended
                state[:n] = np.where(ended, -1 - to, to)
            out[:, k] = np.bincount(owner, count, len(texts)) + self._seams(table, columns, starts, lengths, owner, place, state, len(texts))
        return sizes, out

    @staticmethod
    def _seams(table: Transitions, columns, starts, lengths, owner, place, ends, texts: int) -> np.ndarray:
        """What the first parse, in which a phrase begins with each segment, has counted too few (or, negative, too many) in each text.

        ``ends``: the state behind each segment. The phrase that enters a segment is read
        on beside the first parse until their states are equal. The few lanes that are
        late are read one by one; where one differs to its segment's end, the next
        segment is entered otherwise and is read once more.
        """
        later, before = place
        begin = table.begin
        change = np.zeros(len(starts), dtype=np.int64)
        enters = np.full(len(starts), -1, dtype=np.int64)
        enters[later] = ends[before]
        follows = dict(zip(before.tolist(), later.tolist(), strict=True))
        lane, real, fresh, extra, t = later, enters[later], np.full(len(later), begin), np.zeros(len(later), dtype=np.int64), 0
        late: dict[int, tuple[int, int, int, int]] = {}
        while len(lane) > 48:
            c = columns[starts[lane] + t]
            real, fresh = table.step(real, c), table.step(fresh, c)
            extra = extra + (real < 0) - (fresh < 0)
            real, fresh = np.where(real < 0, -1 - real, real), np.where(fresh < 0, -1 - fresh, fresh)
            t += 1
            over = lengths[lane] <= t
            met = real == fresh
            change[lane[met]] = extra[met]
            for i in np.flatnonzero(over & ~met).tolist():
                late[int(lane[i])] = (int(real[i]), int(fresh[i]), int(extra[i]), t)
            goes = ~(met | over)
            lane, real, fresh, extra = lane[goes], real[goes], fresh[goes], extra[goes]
        late.update(zip(lane.tolist(), zip(real.tolist(), fresh.tolist(), extra.tolist(), [t] * len(lane), strict=True), strict=True))
        queue = [(int(starts[i]), i) for i in late]
        heapq.heapify(queue)
        while queue:
            _, i = heapq.heappop(queue)
            if i not in late:
                continue
            x, y, n, t = late.pop(i)
            for c in columns[starts[i] + t : starts[i] + lengths[i]].tolist():
                if x == y:
                    break
                x, y = table.step_one(x, c), table.step_one(y, c)
                if x < 0:
                    x, n = -1 - x, n + 1
                if y < 0:
                    y, n = -1 - y, n - 1
            change[i] = n
            following = follows.get(i)
            end = int(ends[i]) if x == y else x
            if following is not None and enters[following] != end:
                enters[following] = end
                late[following] = (end, begin, 0, 0)
                heapq.heappush(queue, (int(starts[following]), following))
        return np.bincount(owner, change, texts)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        sizes, count = self.phrases(texts)
        rate = 100 * count / np.maximum(sizes, 1)[:, None]
        best = rate.argmin(axis=1)
        share = np.exp(rate.min(axis=1, keepdims=True) - rate)
        names = list(self.tables)
        return [names[b] if n else "und" for b, n in zip(best, sizes, strict=True)], np.where(sizes > 0, 1 / share.sum(axis=1), 0.0), np.where(sizes > 0, rate.min(axis=1), np.nan)


def fit(labelled: DataFrame, max_chars: int = 20_000, rows: int = 400) -> LanguageModel | None:
    """Learn from (doc_id, text, lang): at most ``rows`` candidate rows and ``max_chars`` characters of a language.

    All languages together have at most ``ALL_CHARS`` characters: of very many, each has fewer.
    """
    kinds = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang").distinct().count()
    max_chars = min(max_chars, max(ALL_CHARS // max(kinds, 1), 200))
    usable = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    long = F.length("text") > max_chars
    hashed = usable.select("lang", "text", long.alias("long"), F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 40)).alias("h"))
    # Usable rows of a language are counted, and only those whose hash is among the smallest few are ranked: a bounded number, whatever the table's size.
    counts = usable.groupBy(F.col("lang").alias("of"), long.alias("of_long")).agg(F.count(F.lit(1)).alias("n"))
    most = F.when(F.col("long"), LONG_ROWS).otherwise(rows)
    counts = shared.written(counts, "languages")
    counts = F.broadcast(counts) if counts.count() <= MOST_LANGUAGES else counts
    few = hashed.join(counts, (F.col("lang") == F.col("of")) & (F.col("long") == F.col("of_long")))
    few = few.where(F.col("h") < F.least(F.lit(1.0), 4.0 * most / F.col("n")) * float(1 << 40))
    span = F.regexp_extract("text", rf"(?s)\p{{L}}.{{0,{max_chars - 1}}}", 0)
    few = few.select("lang", "long", "h", F.when(F.col("long"), span).otherwise(F.col("text")).alias("text"))
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("lang", "long").orderBy("h", "text"))).where(F.col("r") <= most)
    # Rows in order, each if it still fits.
    own = F.array_sort(F.collect_list(F.struct("r", F.length("text").alias("n"), "text")))
    none = F.struct(F.lit(0).alias("total"), F.array().cast("array<string>").alias("texts"))
    fits = lambda kept, row: F.when(kept.total + row.n <= max_chars, F.struct((kept.total + row.n).alias("total"), F.concat(kept.texts, F.array(row.text)).alias("texts"))).otherwise(kept)
    got = few.groupBy("lang", "long").agg(F.aggregate(own, none, fits).alias("kept")).select("lang", "long", "kept.texts").collect()
    samples: dict[str, list[str]] = {}
    for row in sorted(got, key=lambda x: (x.lang, x.long)):
        texts = samples.setdefault(row.lang, [])
        rest = max_chars - sum(map(len, texts))
        if row.long and 2 * rest > max_chars:
            texts.append(row.texts[0][:rest])
        elif not row.long:
            texts += row.texts
    return LanguageModel.of({k: " ".join(map(letters, v)) for k, v in samples.items()}) if samples else None


def identify(docs: DataFrame, model: LanguageModel | None, columns: list[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` and ``lang_rate``; columns of these names are replaced."""
    shared.small_batches(docs.sparkSession)
    new = ("lang_pred", "lang_score", "lang_rate")
    kept = [c for c in (columns or docs.columns) if c not in new]
    schema = StructType([docs.schema[c] for c in kept] + [StructField(new[0], StringType()), StructField(new[1], DoubleType()), StructField(new[2], DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            own = [letters(t) for t in batch.column("text").to_pylist()]
            names, scores, rates = m.predict(own) if m else (["und"] * len(own), np.zeros(len(own)), np.full(len(own), np.nan))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64(), mask=np.isnan(rates))], names=[*kept, *new])
        shared.give_back()

    return docs.select(*kept, *([] if "text" in kept else ["text"])).mapInArrow(run, schema)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all ``documents``, learned from rows whose crc32(doc_id) mod 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = shared.crc_mod("doc_id", 4) == 2
    model = fit(docs.where(~held_out))
    return identify(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
