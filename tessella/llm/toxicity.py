"""Toxicity by two Kneser-Ney models over the letters of words, one of toxic and one of ordinary text.

Each class has discounted counts of a letter after up to five letters of the same word. What is discounted goes to one
backoff that both classes share, built from continuation counts over both; so an expression too rare to tell the classes
apart gets the same probability from either, and variants of a toxic stem still differ. Expressions of
two and three words, which no letters show, are compared by their discounted frequencies in the two classes. N-grams are
packed into 64-bit numbers, so that the models are sorted arrays and all new words of a batch are looked up at once.

A document is judged in two ways and gets the higher score. One: the log-likelihoods of its text under the two models, divided
by its letters, together with what its words say one by one: the sums of the highest log ratios of its distinct words, whole
and up to their most telling letter, and the shares of words beyond a few marks. A logistic curve over these measures and their products tells
classes apart where no single word does, as in languages whose marks are frequent and mild. Two: the expression that speaks most for the toxic
model, its log ratio divided by its letters, against the highest that ordinary text with as many expressions reaches by chance (a Gumbel law), so that
one insult among thousands of ordinary words is seen and a long text isn't toxic for its length. Law and curves are fitted
on documents that the counts they use have not seen: the sample is cut in FOLDS, and each is measured by a model of the others.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import byte_words, dropped, mapped, sliced, steps, stored, text_bytes
from tessella.llm.labelled import fold, labelled, sample

#: Labelled documents of each class that a model is fitted on at most.
SAMPLE_ROWS = 4000
#: Letters (bytes) of an n-gram (at most 6, which pack into a number), words of an expression, letters of a longer word that are compared together.
ORDER, SPAN, WINDOW = 6, 3, 16
#: Times that an expression of several words must occur in the sample to be told from chance, and what is discounted.
PHRASE_LEAST, PHRASE_DISCOUNT = 3, 0.75
#: Parts of the sample that are measured by models of the others, bytes of a labelled document that are learnt from at most.
FOLDS, TEXT_BYTES = 4, 1 << 20
#: Marks for shares of telling words, and the measures of a document beyond the first four.
MARKS, MEASURES = (1.5, 2.5, 3.5), 12
HELD_PARTS, HELD = 5, 0
#: Words that a Python worker remembers, and their letters; letters looked up at once; bytes of a text that are cut into words at once.
REMEMBERED, REMEMBERED_BYTES, LETTERS, CHUNK = 200_000, 16_000_000, 400_000, 1 << 20
FIRST, LAST = b"\x02", b"\x03"
_BODY = (1 << 48) - 1
#: In the place of an n-gram: the number of texts.
TEXTS = -1


def packed(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the marked words one after another: place in its word of each letter, first place of each word, and for n from 1
    to order the n-gram that ends there (row n - 1; -1 where the word has no n letters up to there or the letter is the first mark).

    A number holds the length above 48 bits and the letters, first the highest, below.
    """
    line = np.frombuffer(b"".join([FIRST + w + LAST for w in words]), dtype=np.uint8).astype(np.int64)
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(line)) - np.repeat(starts, sizes)
    out = np.full((order, len(line)), -1, dtype=np.int64)
    body = np.zeros(len(line), dtype=np.int64)
    for n in range(1, order + 1):
        body[n - 1 :] |= line[: len(line) - n + 1] << (8 * (n - 1))
        ok = (place >= n - 1) & (place >= 1)
        out[n - 1, ok] = body[ok] | n << 48
    return place, starts, out


def _context(grams: np.ndarray) -> np.ndarray:
    """Without the last letter."""
    return ((grams >> 48) - 1) << 48 | (grams & _BODY) >> 8


def _suffix(grams: np.ndarray) -> np.ndarray:
    """Without the first letter."""
    n = (grams >> 48) - 1
    return n << 48 | grams & ((np.int64(1) << 8 * n) - 1)


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the wanted keys, and which there are; keys are sorted."""
    if not len(keys):
        return np.zeros(len(wanted)), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return np.where(hit, values[at], 0), hit


def phrases(words: list[bytes], span: int) -> Iterator[bytes]:
    """All runs of 2 to span words, joined by a blank."""
    for n in range(2, span + 1):
        yield from map(b" ".join, zip(*(words[i:] for i in range(n))))


class Letters:
    """Log ratios (toxic against ordinary) of the longest n-grams, and of the backoff weights by context: sorted keys and values."""

    def __init__(self, grams: np.ndarray, gain: np.ndarray, contexts: np.ndarray, backoff: np.ndarray, order: int):
        self.grams, self.gain, self.contexts, self.backoff, self.order = grams, gain.astype(np.float32), contexts, backoff.astype(np.float32), order

    def values(self, words: list[bytes]) -> np.ndarray:
        """Per letter, the log ratio of each word; of a word of more than WINDOW letters the best WINDOW in a row."""
        return self.ratios(words)[0]

    def ratios(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The log ratio of each word per letter, as a whole, and up to the letter where it is highest (0 at least).

        Of a word of more than WINDOW letters the first is that of its best WINDOW in a row, the others are 0: sums over so
        many letters would make text without blanks telling for its length.
        """
        if not words:
            return np.zeros(0), np.zeros(0), np.zeros(0)
        place, starts, grams = packed(words, self.order)
        longest = grams[np.minimum(place, self.order - 1), np.arange(len(place))]
        # at place k of a word the longest n-gram has min(k + 1, order) letters
        gain, known = _found(self.grams, self.gain, longest)
        away, _ = _found(self.contexts, self.backoff, _context(longest))
        value = np.where(place >= 1, np.where(known, gain, away), 0.0)
        sizes = np.array([len(w) + 1 for w in words])
        whole = np.add.reduceat(value, starts)
        best = whole / sizes
        run = np.cumsum(value)
        high = np.maximum.reduceat(run, starts) - run[starts]  # a word's first place is its mark, of value 0
        for k in np.nonzero(sizes > WINDOW)[0]:
            sums = np.concatenate([[0.0], np.cumsum(value[starts[k] + 1 : starts[k] + 1 + sizes[k]])])
            best[k] = (sums[WINDOW:] - sums[:-WINDOW]).max() / WINDOW
            whole[k] = high[k] = 0
        return best, whole, high


def fit_letters(grams: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray, order: int = ORDER) -> Letters:
    """From distinct packed n-grams and their counts in both classes: Kneser-Ney log ratios over one shared backoff.

    An n-gram that neither class has seen after a known context has the weights' ratio, as the shared backoff cancels;
    after an unknown context the ratio is 1.
    """
    if not len(grams):
        none = np.zeros(0, dtype=np.int64)
        return Letters(none, np.zeros(0), none, np.zeros(0), order)
    both = ordinary + toxic
    ones, twos = int((both == 1).sum()), int((both == 2).sum())
    d = min(0.95, max(0.3, ones / max(1, ones + 2 * twos)))
    followed, times = np.unique(_suffix(grams[grams >> 48 > 1]), return_counts=True)
    before, of = np.unique(_context(followed), return_inverse=True)
    mass, kinds = np.bincount(of, weights=times, minlength=len(before)), np.bincount(of, minlength=len(before))

    def shared(wanted: np.ndarray, n: int) -> np.ndarray:
        if not n:
            return np.full(len(wanted), 1 / 256)
        below = shared(_suffix(wanted), n - 1)
        context = _context(wanted)
        total, some = _found(before, mass, context)
        several, _ = _found(before, kinds, context)
        seen, _ = _found(followed, times, wanted)
        return np.where(some, (np.maximum(seen - d, 0) + d * several * below) / np.maximum(total, 1), below)

    length = grams >> 48
    top = (length == order) | ((grams & _BODY) >> 8 * (length - 1) == FIRST[0])
    order_ = np.argsort(grams[top])
    grams, counts = grams[top][order_], [c[top][order_].astype(float) for c in (ordinary, toxic)]
    length = grams >> 48
    below = np.zeros(len(grams))
    for n in range(1, order + 1):
        here = length == n
        below[here] = shared(_suffix(grams[here]), n - 1)
    contexts, of = np.unique(_context(grams), return_inverse=True)
    weights, chances = [], []
    for c in counts:
        total = np.bincount(of, weights=c, minlength=len(contexts))
        several = np.bincount(of, weights=c > 0, minlength=len(contexts))
        weights.append(np.where(total > 0, d * several / np.maximum(total, 1), 1.0))
        chances.append(np.where(total[of] > 0, np.maximum(c - d, 0) / np.maximum(total[of], 1), 0.0) + weights[-1][of] * below)
    return Letters(grams, np.log(chances[1] / chances[0]), contexts, np.log(weights[1] / weights[0]), order)


def fit_phrases(counts: dict[bytes, tuple[int, int]], sizes: tuple[int, int], discount: float = PHRASE_DISCOUNT) -> dict[bytes, float]:
    """Log ratio of the discounted frequencies (ordinary, toxic) of each expression that speaks for the toxic class.

    What is discounted goes to a floor that both classes share. The others could never decide and are left out.
    """
    floor = 1 / max(1, sum(sizes))
    p = {g: [max(c[k] - discount, 0) / max(1, sizes[k]) + floor for k in (0, 1)] for g, c in counts.items()}
    return {g: math.log(t / o) for g, (o, t) in p.items() if t > o}


def chunks(text: bytes, most: int = CHUNK) -> Iterator[list[bytes]]:
    """Words of a lower-cased text, of about ``most`` bytes at a time; no word is cut."""
    text, at = text.lower(), 0
    while len(text) - at > most:
        end = at + most
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield byte_words(text[at:end])
        at = end
    yield byte_words(text[at:] if at else text)


def chance(peaks: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """a, b of the likeliest law by which ordinary text exceeds v with each expression at the rate exp(a - b v).

    The highest of n expressions then follows a Gumbel law, and b v - a - log(n) says how far v is beyond chance.
    """
    best = (-math.inf, 0.0, 1.0)
    low = peaks.min()
    for b in np.geomspace(0.05, 32, 400):
        a = math.log(len(peaks)) - math.log((n * np.exp(-b * (peaks - low))).sum()) + b * low
        best = max(best, (len(peaks) * (math.log(b) + a) - b * peaks.sum(), a, b))
    return float(best[1]), float(best[2])


def beyond(law: tuple[float, float], peak, n):
    """How far a peak of n expressions is beyond chance, in natural logarithms of the odds against it."""
    return law[1] * peak - law[0] - np.log(n)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Slope and intercept of a one-dimensional logistic regression by Newton steps.

    Every row weighs the same: a score of a half is where both classes are as likely in the sample. Classes weighted alike
    would flag more ordinary texts the more of the toxic ones can't be told from them.
    """
    centre, scale = x.mean(), x.std() or 1.0
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    beta = np.zeros(2)
    penalty = np.diag([ridge, 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + penalty, z.T @ (y - p) - penalty @ beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1] - beta[0] * centre / scale)


class Curve:
    """A logistic regression over measures, each within the range it had in fitting, and the products of any two."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.low, self.high = x.min(axis=0), x.max(axis=0)
        self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self._terms(x)
        beta, penalty = np.zeros(z.shape[1]), np.diag([1e-6] + [ridge] * (z.shape[1] - 1))
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            step = np.linalg.solve((z.T * (p * (1 - p))) @ z + penalty, z.T @ (y - p) - penalty @ beta)
            beta += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-9:
                break
        self.beta = beta

    def _terms(self, x: np.ndarray) -> np.ndarray:
        z = (np.clip(x, self.low, self.high) - self.centre) / self.scale
        a, b = np.triu_indices(x.shape[1])
        return np.concatenate([np.ones((len(x), 1)), z, z[:, a] * z[:, b]], axis=1)

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the second class."""
        return self._terms(x) @ self.beta


def told(found: np.ndarray) -> np.ndarray:
    """What the curve is over: of measure()'s columns the expressions of several words and MEASURES."""
    return np.delete(found, [0, 2, 3], axis=1)


class Model:
    """Parts that travel to the executors: log ratios, laws of chance and the curve. Without both classes the score is constant.

    seen: expressions of several words and their log ratios, kept as sorted numbers in the base of their vocabulary.
    """

    def __init__(self, letters: Letters, seen: dict[bytes, float], span: int):
        self.letters, self.span = letters, span
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for g in seen for w in g.split(b" ")}))}
        self.phrases: list[tuple[np.ndarray, np.ndarray]] = []
        for n in range(2, span + 1):
            some = [(self._number([self.vocabulary[w] for w in g.split(b" ")]), v) for g, v in seen.items() if g.count(b" ") == n - 1]
            keys, values = np.array([k for k, _ in some], dtype=np.int64), np.array([v for _, v in some])
            order = np.argsort(keys)
            self.phrases.append((keys[order], values[order]))
        self.laws, self.slope, self.shift = ((0.0, 1.0), (0.0, 1.0)), 0.0, 0.0
        self.curve: Curve | None = None
        self._forget(0)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget(0)

    def _number(self, ids):
        out = 0
        for i in ids:
            out = out * len(self.vocabulary) + i
        return out

    def _forget(self, needed: int) -> None:
        """Room for the words that are remembered, by row: value, place in the vocabulary, runs of letters that are compared."""
        rows = max(needed, REMEMBERED if needed else 0)
        self._known: dict[bytes, int] = {}
        self._bytes = 0
        self._value, self._place, self._runs = np.zeros(rows), np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
        self._whole, self._high, self._letters = np.zeros(rows), np.zeros(rows), np.zeros(rows, dtype=np.int64)

    def _rows(self, words: list[bytes]) -> np.ndarray:
        """Rows of the words; those that aren't remembered are worked out."""
        distinct = set(words)
        new = [w for w in distinct if w not in self._known]
        self._bytes += sum(map(len, new))
        if len(self._known) + len(new) > len(self._value) or self._bytes > REMEMBERED_BYTES:
            self._forget(len(distinct))
            new = list(distinct)
        at = len(self._known)
        for a, b in steps(new, LETTERS):
            self._value[at + a : at + b], self._whole[at + a : at + b], self._high[at + a : at + b] = self.letters.ratios(new[a:b])
        here = slice(at, at + len(new))
        self._place[here] = np.fromiter(map(self.vocabulary.get, new, repeat(-1)), np.int64, len(new))
        self._letters[here] = np.fromiter(map(len, new), np.int64, len(new)) + 1
        self._runs[here] = np.maximum(self._letters[here] + 1 - WINDOW, 1)
        self._known.update(zip(new, range(at, at + len(new))))
        return np.fromiter(map(self._known.__getitem__, words), np.int64, len(words))

    def _best_phrases(self, place: np.ndarray, text: np.ndarray, best: np.ndarray) -> None:
        """Raise each text's best value to that of its best expression; place, text: vocabulary and text of each word."""
        number, inside = place, place >= 0
        for n, (keys, values) in enumerate(self.phrases, start=2):
            number = number[:-1] * len(self.vocabulary) + place[n - 1 :]
            inside = inside[:-1] & (place[n - 1 :] >= 0) & (text[: len(text) - n + 1] == text[n - 1 :])
            at = np.nonzero(inside)[0]
            gain, hit = _found(keys, values, number[at])
            np.maximum.at(best, text[at[hit]], gain[hit])

    def measure(self, texts: list[bytes]) -> np.ndarray:
        """For each text: highest value of a word, highest of an expression of several words, number of expressions, mean of the words' values; then MEASURES."""
        out = np.zeros((len(texts), 4 + MEASURES))
        for a, b in steps(texts, CHUNK):
            if len(texts[a]) > CHUNK:  # alone, piece by piece
                out[a] = self._long(texts[a])
                continue
            lists = [byte_words(t.lower()) for t in texts[a:b]]
            sizes = np.array([len(x) for x in lists])
            some = np.nonzero(sizes)[0]
            if not len(some):
                continue
            rows = self._rows([w for words in lists for w in words])
            starts, text = (np.cumsum(sizes) - sizes)[some], np.repeat(np.arange(b - a), sizes)
            value = self._value[rows]
            out[a + some, 0], out[a + some, 3] = np.maximum.reduceat(value, starts), np.add.reduceat(value, starts) / sizes[some]
            out[a + some, 2] = np.add.reduceat(self._runs[rows], starts)
            phrase = np.zeros(b - a)
            self._best_phrases(self._place[rows], text, phrase)
            out[a:b, 1] = phrase
            known = len(self._known)
            of, row = np.divmod(np.unique(text * known + rows), known)  # the distinct words of each text
            whole, high = (self._top(v[row], of, b - a) for v in (self._whole, self._high))
            per = lambda v: np.bincount(text, weights=v, minlength=b - a)  # noqa: E731, B023
            shares = [per(self._high[rows] > m) / np.maximum(sizes, 1) for m in MARKS]
            telling = np.bincount(of, weights=self._high[row] > MARKS[1], minlength=b - a)
            self._fill(out[a:b], whole, high, per(self._whole[rows]) / np.maximum(per(self._letters[rows]), 1), shares, telling, sizes)
        out[:, 2] = np.maximum(out[:, 2], 1)
        return out

    @staticmethod
    def _top(v: np.ndarray, of: np.ndarray, n: int, most: int = 6) -> np.ndarray:
        """The highest values of each text, descending, 0 where there are fewer."""
        out = np.zeros((n, most))
        order = np.lexsort((-v, of))
        v, of = v[order], of[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        out[of[place < most], place[place < most]] = v[place < most]
        return out

    @staticmethod
    def _fill(out: np.ndarray, whole: np.ndarray, high: np.ndarray, mean: np.ndarray, shares: list[np.ndarray], telling: np.ndarray, sizes: np.ndarray) -> None:
        columns = [whole[:, 0], whole[:, :3].sum(axis=1), high[:, 0], high[:, :3].sum(axis=1), high.sum(axis=1), mean, *shares]
        columns += [np.log1p(telling), np.log(np.maximum(sizes, 1)), np.log(1e-3 + shares[1])]
        out[:, 4:] = np.where((sizes > 0)[:, None], np.column_stack(columns), 0)

    def _long(self, text: bytes) -> np.ndarray:
        """The row of measure() for one text, piece by piece; of its words the six highest and the telling ones are kept."""
        best, total, n, size, phrase, tail = -math.inf, 0.0, 0, 0, np.zeros(1), np.zeros(0, dtype=np.int64)
        whole: dict[bytes, float] = {}
        high: dict[bytes, float] = {}
        telling: set[int] = set()
        over, summed, letters = np.zeros(len(MARKS)), 0.0, 0
        for words in chunks(text):
            rows = self._rows(words)
            value, place = self._value[rows], np.concatenate([tail, self._place[rows]])
            best, total = max(best, value.max(initial=-math.inf)), total + value.sum()
            n, size = n + self._runs[rows].sum(), size + len(words)
            self._best_phrases(place, np.zeros(len(place), dtype=np.int64), phrase)
            tail = place[max(0, len(place) - self.span + 1) :]
            row, first = np.unique(rows, return_index=True)
            for kept, v in ((whole, self._whole[row]), (high, self._high[row])):
                for k in np.argsort(-v, kind="stable")[:6]:
                    kept[words[first[k]]] = v[k]
                for w in sorted(kept, key=kept.get)[: max(0, len(kept) - 6)]:
                    del kept[w]
            telling |= {hash(words[k]) for k in first[self._high[row] > MARKS[1]]}
            over += [(self._high[rows] > m).sum() for m in MARKS]
            summed, letters = summed + self._whole[rows].sum(), letters + self._letters[rows].sum()
        out = np.zeros((1, 4 + MEASURES))
        if size:
            out[0, :4] = best, phrase[0], n, total / size
            tops = [np.array([[*sorted(v.values(), reverse=True), *[0.0] * (6 - len(v))]]) for v in (whole, high)]
            self._fill(out, *tops, np.array([summed / letters]), [np.array([x / size]) for x in over], np.array([len(telling)]), np.array([size]))
        return out[0]

    def evidence(self, found: np.ndarray) -> np.ndarray:
        """The more telling of the two peaks in each row of measure(), each against chance."""
        return np.maximum(beyond(self.laws[0], found[:, 0], found[:, 2]), beyond(self.laws[1], found[:, 1], found[:, 2]))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Rows of score, peak against chance, log ratio of the whole text by letter."""
        found = self.measure(texts)
        peak = self.evidence(found)
        odds = self.slope * peak + self.shift
        if self.curve is not None:
            odds = np.maximum(odds, self.curve.odds(told(found)))
        return np.column_stack([1 / (1 + np.exp(-np.clip(odds, -30, 30))), peak, found[:, 4 + 5]])


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS, order: int = ORDER, span: int = SPAN) -> Model:
    """Fit on at most ``most`` labelled documents of each class outside the held-out fold, one row an id, TEXT_BYTES of each.

    All of them give the counts. The curves are fitted on measures by models that haven't seen the document (by the same model where a
    class has under 40). The counts are summed on the executors; only sums over the bounded sample reach the driver, as columns.
    """
    rows = labelled(docs, sample(labels, "toxic", fold(F.col("doc_id"), HELD_PARTS) != HELD, most))
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int")
    rows = stored(rows.select("text", "y", part.alias("fold")), "toxicity-sample")  # read once for the counts and once for each fold
    try:
        return _train(rows, order, span)
    finally:
        dropped(rows)


def _train(rows: DataFrame, order: int, span: int) -> Model:
    spark = rows.sparkSession

    def counted(part: int, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        several: Counter[bytes] = Counter()
        for text in texts:
            tail: list[bytes] = []
            for line in chunks(text):
                words.update(line)
                line = tail + line
                several.update(phrases(line, span))
                tail = line[1 - span :] if span > 1 else []  # no expression of these alone is counted again: see below
                if len(tail) > 1:
                    several.subtract(phrases(tail, span))
            if len(tail) > 1:
                several.update(phrases(tail, span))
        codes, times = [], []
        every = list(words)
        for a, b in steps(every, LETTERS):
            place, starts, grams = packed(every[a:b], order)
            n = np.repeat([words[w] for w in every[a:b]], [len(w) + 2 for w in every[a:b]])
            for row in grams:
                found, of = np.unique(row[row >= 0], return_inverse=True)
                codes.append(found)
                times.append(np.bincount(of, weights=n[row >= 0], minlength=len(found)).astype(np.int64))
        for code, n in zip(codes, times):
            yield made(part, code, None, n)
        several = +several
        if several:
            yield made(part, None, list(several), np.array(list(several.values())))
        yield made(part, None, [None], np.array([words.total()]))
        yield made(part, np.array([TEXTS]), None, np.array([len(texts)]))

    def made(part: int, code: np.ndarray | None, phrase: list[bytes | None] | None, n: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(code) if code is not None else pa.nulls(len(n), pa.int64()), pa.array(phrase, pa.binary()) if phrase else pa.nulls(len(n), pa.binary())]
        return pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(n), pa.int32()), pa.array(n, pa.int64())], names=["gram", "phrase", "part", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, kind = [t[:TEXT_BYTES] for t in text_bytes(batch.column(0))], [y + 2 * f for y, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            for part in range(2 * FOLDS):
                if some := [t for t, k in zip(texts, kind) if k == part]:
                    yield from counted(part, some)

    parts = range(2 * FOLDS)
    sums = [F.sum(F.when(F.col("part") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in parts]
    table = mapped(rows, count, "gram long, phrase binary, part int, n long").groupBy("gram", "phrase").agg(*sums)
    often = F.col("phrase").isNull() | (sum(F.col(f"n{k}") for k in parts) >= PHRASE_LEAST)
    table = table.where(often).select("gram", "phrase", *(F.col(f"n{k}").cast("int") for k in parts)).toArrow().combine_chunks()
    n = np.column_stack([table.column(f"n{k}").to_numpy() for k in parts]) if table.num_rows else np.zeros((0, 2 * FOLDS), dtype=np.int32)
    gram, phrase = (table.column(k).combine_chunks() if table.num_rows else pa.array([], (pa.int64(), pa.binary())[k]) for k in range(2))
    del table
    no_gram, no_phrase = (c.is_null().to_numpy(zero_copy_only=False) for c in (gram, phrase))
    is_texts = gram.fill_null(0).to_numpy(zero_copy_only=False) == TEXTS
    words, sizes = n[no_gram & no_phrase].sum(axis=0, dtype=np.int64), n[is_texts].sum(axis=0, dtype=np.int64)
    no_gram |= is_texts
    letters, several = n[~no_gram], n[~no_phrase]
    gram, phrase = gram.filter(pa.array(~no_gram)).to_numpy(), phrase.filter(pa.array(~no_phrase)).to_pylist()
    classes = [int(sizes[y::2].sum()) for y in (0, 1)]

    def fitted(without: int | None) -> Model:
        """The model of all folds but one."""
        of = lambda counts, y: sum(counts[..., y + 2 * f] for f in range(FOLDS) if f != without)
        used = of(letters, 0) + of(letters, 1) > 0
        chosen = {g: (int(o), int(t)) for g, o, t in zip(phrase, of(several, 0), of(several, 1)) if o + t >= PHRASE_LEAST}
        return Model(fit_letters(gram[used], of(letters[used], 0), of(letters[used], 1), order), fit_phrases(chosen, (int(of(words, 0)), int(of(words, 1)))), span)

    if not min(classes):
        none = np.zeros(0, dtype=np.int64)
        model = Model(fit_letters(none, none, none, order), {}, span)
        model.shift = 30.0 if classes[1] else -30.0
        return model
    model = fitted(None)
    cross = min(classes) >= 40 and all(classes[y] > sizes[y + 2 * f] for y in (0, 1) for f in range(FOLDS))
    seen = []
    for f in range(FOLDS) if cross else [None]:
        draft = spark.sparkContext.broadcast(fitted(f) if cross else model)

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                found = draft.value.measure(text_bytes(batch.column(0)))  # noqa: B023
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(found), pa.list_(pa.float64()))], names=["y", "found"])

        some = rows.where(F.col("fold") == f) if cross else rows
        seen.append(mapped(some, measured, "y int, found array<double>").toArrow())
        draft.destroy()
    y = np.concatenate([t.column(0).to_numpy() for t in seen])
    found = np.concatenate([np.array(t.column(1).to_pylist(), dtype=float).reshape(-1, 4 + MEASURES) for t in seen])
    model.laws = (chance(found[y == 0, 0], found[y == 0, 2]), chance(found[y == 0, 1], found[y == 0, 2]))
    model.slope, model.shift = logistic(model.evidence(found), y)
    model.curve = Curve(told(found), y)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score``, ``peak``, ``mean_llr`` of every row's whole text, in one pass without a shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = shipped.value.scores(text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, k]) for k in range(3))], names=["doc_id", "score", "peak", "mean_llr"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(rows, run, "doc_id long, score double, peak double, mean_llr double")


def classify(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted``, ``peak``, ``mean_llr`` of every document.

    ``peak`` is the most telling expression against chance, ``mean_llr`` the log ratio of the whole text by letter. Expressions of several words seen
    under PHRASE_LEAST times in the sample are left out, a word over WINDOW letters counts by its best WINDOW. Null and empty texts score as a text without any evidence. Rows that repeat are scored each; a null doc_id is never
    held out or learnt from. Where a class has no labelled document, every score is that of the other class.
    """
    out = score(docs, train(docs, labels, most))
    held = F.coalesce(fold(F.col("doc_id"), HELD_PARTS) == HELD, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "peak", "mean_llr")


def keep_ordinary(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, that score under the threshold: slices go in and filtered slices come out, no shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield batch.filter(pa.array(shipped.value.scores(text_bytes(batch.column(at)))[:, 0] < threshold))

    return mapped(docs, run, docs.schema)
