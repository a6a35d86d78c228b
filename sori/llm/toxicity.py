"""Toxicity: a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks."""

from __future__ import annotations

import string
from collections import Counter
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sori.llm.store import cut, small_batches

#: Labelled documents that a fit uses at most, of each class (those of the smallest hashes of doc_id).
TOXIC_DOCS, CLEAN_DOCS = 3000, 5000
#: Words (the shortest sentences) that a fit uses at most: candidates, telling ones, others of clean documents; rounds of training.
CANDIDATES, TELLING_WORDS, CLEAN_WORDS, ROUNDS = 3000, 600, 8_000, 3
TOXIC_LANDMARKS, CLEAN_LANDMARKS, NEAR_LANDMARKS = 56, 16, 24
#: Kernel: length of the common subsequences, decay for each character that they span; longest piece of a word.
LENGTH, DECAY, PIECE = 3, 0.6, 24
#: Nats of evidence that a telling word may lack; the machine's other words outvote those taken by chance.
SLACK = 2.0
#: Lengths, with the edge mark, of the beginnings of words that count beside whole words when telling words are sought.
STEMS = (5, 6)
CACHE_WORDS = 250_000
#: Letters (and one for all others) up to which a model has a weight for every triple, found or not: 8 bytes for each.
DENSE_LETTERS = 96
EDGES = string.punctuation + "«»“”‘’„…–—¡¿"


def tokens(text: str | None) -> list[str]:
    """Lower-case words of a whole text; runs of three and more single characters are one word ("i d i o t")."""
    words = (text or "").lower().split()
    singles = [i for i, w in enumerate(words) if len(w) == 1]
    at = 0
    while at < len(singles):
        end = at
        while end + 1 < len(singles) and singles[end + 1] == singles[end] + 1:
            end += 1
        if end - at >= 2:
            words.append("".join(words[singles[at] : singles[end] + 1]))
        at = end + 1
    return words


def pieces(word: str) -> list[str]:
    """A word without punctuation at its ends, with an edge mark before it; long words as overlapping pieces.

    A word with other characters inside than letters and digits ("i-d*i.o-t") counts without these, too.
    """
    word = word.strip(EDGES)
    if not word:
        return []
    plain = word if word.isalnum() else "".join(c for c in word if c.isalnum())
    out = []
    for w in {"^" + word, "^" + plain} - {"^"}:
        out += [w] if len(w) <= PIECE else [w[i : i + PIECE] for i in range(0, len(w) - PIECE // 2, PIECE // 2)]
    return out


def signs(text: str | None) -> set[str]:
    """Distinct words of a text, and the first letters of each word, which inflected forms share."""
    words = {p for w in set(tokens(text)) for p in pieces(w)}
    return words | {p[:n] for p in words for n in STEMS if len(p) > n and p[0] == "^"}


def codes(words: list[str], width: int, pad: int) -> np.ndarray:
    out = np.full((len(words), width), pad, np.int32)
    for i, w in enumerate(words):
        out[i, : len(w)] = [ord(c) for c in w]
    return out


def kernel(words: list[str], others: list[str]) -> np.ndarray:
    """Gap-weighted subsequence kernel of LENGTH characters, not normalised (words x others), by dynamic programming."""
    out = np.zeros((len(words), len(others)), np.float32)
    if not words or not others:
        return out
    width = max(map(len, others))
    t = codes(others, width, -2).T  # place x other
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    decay = np.float32(DECAY)
    for length, places in by_length.items():
        step = max(1, 40_000 // (len(others) * 1))
        for at in range(0, len(places), step):
            rows = places[at : at + step]
            s = codes([words[i] for i in rows], length, -1)
            shape = (width + 1, len(rows), len(others))
            # open_[i][j]: weight of common subsequences of i characters that reach to the ends of s so far and t[:j]
            open_ = [np.ones(shape, np.float32)] + [np.zeros(shape, np.float32) for _ in range(LENGTH - 1)]
            total = np.zeros(shape[1:], np.float32)
            for a in range(length):
                same = (s[None, :, a, None] == t[:, None, :]).astype(np.float32) * decay * decay
                total += (same * open_[LENGTH - 1][:-1]).sum(axis=0)
                for i in range(LENGTH - 1, 0, -1):
                    run = np.zeros(shape[1:], np.float32)
                    grown = open_[i] * decay
                    hits = same * open_[i - 1][:-1]
                    for j in range(width):
                        run = run * decay + hits[j]
                        grown[j + 1] += run
                    open_[i] = grown
            out[rows] = total
    return out


def self_kernel(words: list[str]) -> np.ndarray:
    """The kernel of each word with itself."""
    out = np.zeros(len(words), np.float32)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    decay = np.float32(DECAY)
    for length, rows in by_length.items():
        s = codes([words[i] for i in rows], length, -1).T
        open_ = [np.ones((length + 1, len(rows)), np.float32)] + [np.zeros((length + 1, len(rows)), np.float32) for _ in range(LENGTH - 1)]
        total = np.zeros(len(rows), np.float32)
        for a in range(length):
            same = (s[a] == s).astype(np.float32) * decay * decay
            total += (same * open_[LENGTH - 1][:-1]).sum(axis=0)
            for i in range(LENGTH - 1, 0, -1):
                run, grown, hits = np.zeros(len(rows), np.float32), open_[i] * decay, same * open_[i - 1][:-1]
                for j in range(length):
                    run = run * decay + hits[j]
                    grown[j + 1] += run
                open_[i] = grown
        out[rows] = total
    return out


@lru_cache(maxsize=64)
def triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all subsequences of LENGTH (three) characters of a word of n."""
    at = np.array(list(combinations(range(n), LENGTH)), dtype=np.int64).reshape(-1, LENGTH)
    return at[:, 0], at[:, 1], at[:, 2]


class Model:
    """Margins of words; a document's margin is that of its most toxic word, its score a logistic function of it."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0, prior: float | None = None):
        self.landmarks, self.weights, self.bias, self.slope, self.shift, self.prior = landmarks, weights, bias, slope, shift, prior
        self.norm = np.sqrt(np.maximum(self_kernel(landmarks), 1e-12))
        self.cache: dict[str, float] = {}
        if landmarks:
            self.expand()

    def features(self, words: list[str]) -> np.ndarray:
        own = np.sqrt(np.maximum(self_kernel(words), 1e-12))
        return kernel(words, self.landmarks) / own[:, None] / self.norm[None, :]

    def expand(self) -> None:
        """The machine's weight of each subsequence: the sum over landmarks of what it holds of it.

        A margin is linear in the kernel, and the kernel is a product over subsequences; summed over the landmarks
        beforehand, a word's subsequences are looked up once instead of being compared with each landmark.
        """
        letters = sorted(set("".join(self.landmarks)))
        self.place = {ord(c): i + 1 for i, c in enumerate(letters)}  # 0: any other character
        self.width = len(letters) + 1
        codes, weights = [np.zeros(0, np.int64)], [np.zeros(0)]
        for word, w, norm in zip(self.landmarks, self.weights, self.norm, strict=True):
            s = np.array([self.place[ord(c)] for c in word], np.int64)
            i, j, k = triples(len(s))
            codes.append((s[i] * self.width + s[j]) * self.width + s[k])
            weights.append(w / norm * DECAY ** (k - i + 1.0))
        self.codes, which = np.unique(np.concatenate(codes), return_inverse=True)
        self.sums = np.bincount(which, np.concatenate(weights), minlength=len(self.codes))
        # A table of all triples where it is small; of many letters (scripts with thousands) only those that occur.
        self.table = None
        if self.width <= DENSE_LETTERS:
            self.table = np.zeros(self.width**3)
            self.table[self.codes] = self.sums

    def weight_of(self, codes: np.ndarray) -> np.ndarray:
        """Summed weights of triples, 0 for those that no landmark has."""
        if self.table is not None:
            return self.table[codes]
        if not len(self.codes):
            return np.zeros(codes.shape)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.sums[at], 0.0)

    def word_margins(self, words: list[str]) -> np.ndarray:
        """Margins of pieces: kernel sums with all landmarks at once, normalised by the word's own kernel."""
        out = np.zeros(len(words))
        by_length: dict[int, list[int]] = {}
        for x, w in enumerate(words):
            by_length.setdefault(len(w), []).append(x)
        for length, rows in by_length.items():
            i, j, k = triples(length)
            weight = DECAY ** (k - i + 1.0)
            step = max(1, 500_000 // max(1, len(i)))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                s = np.array([[self.place.get(ord(c), 0) for c in words[x]] for x in part], np.int64)
                out[part] = self.weight_of((s[:, i] * self.width + s[:, j]) * self.width + s[:, k]) @ weight
        return out / np.sqrt(np.maximum(self_kernel(words), 1e-12)) + self.bias

    def learn(self, words: list[str]) -> None:
        parts = {w: pieces(w) for w in words}
        distinct = list({p for ps in parts.values() for p in ps})
        found = dict(zip(distinct, self.word_margins(distinct).tolist(), strict=True)) if distinct else {}
        for w, ps in parts.items():
            self.cache[w] = max((found[p] for p in ps), default=self.bias)

    def margins(self, texts: list[str | None]) -> list[float]:
        if self.prior is not None:
            return [0.0] * len(texts)
        sets = [set(tokens(t)) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        self.learn([w for w in set().union(*sets) if w not in self.cache])
        get = self.cache.__getitem__
        return [max(map(get, s), default=self.bias) for s in sets]

    def scores(self, margins: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(margins), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -40, 40)))


def linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine in the primal, by Newton steps on the rows inside the margin."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        active = y * (z @ w) < 1
        za, wa = z[active], weight[active, None]
        new = np.linalg.solve(ridge + 2 * c * za.T @ (wa * za), 2 * c * za.T @ (wa[:, 0] * y[active]))
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


def logistic(m: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the score over margins, with slightly smoothed targets."""
    scale = max(float(np.abs(m).max()), 1e-6)
    x, w = np.column_stack([m / scale, np.ones(len(m))]), np.ones(len(m))
    target, b = np.where(y == 1, 0.995, 0.005), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = x.T @ (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]) + 1e-3 * np.eye(2)
        b = b + np.clip(np.linalg.solve(h, x.T @ (w * (target - p)) - 1e-3 * b), -5, 5)
    return float(b[0] / scale), float(b[1])


def held_out(doc_id) -> F.Column:
    """Rows that no label is learnt from: those whose CRC-32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of labelled rows that are not held out.

    Document frequencies of words in both classes, counted in Spark, show which words tell of toxic documents. Few
    such words that together occur in most toxic documents, and frequent words of clean documents, are the Nyström
    landmarks. Telling words against words of clean documents train the machine; in each further round the sampled
    documents' most toxic words join their class. Margins of the sampled documents fix the score.
    """
    rows = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    rows = cut(rows.where(~held_out(F.col("id"))), "labels")
    take = lambda y, n: rows.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n)
    chosen = take(1, TOXIC_DOCS).unionByName(take(0, CLEAN_DOCS))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    sample = cut(texts.join(F.broadcast(chosen), "id"), "toxicity-sample")  # TOXIC_DOCS + CLEAN_DOCS ids at most
    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return Model([], np.zeros(0), 0.0, prior=0.0 if not n1 else 1.0)

    def words(batches):
        for b in batches:
            out = [(p, y) for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for p in signs(t)]
            cols = list(zip(*out, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32())], ["word", "y"])

    counts = sample.select("y", "text").mapInArrow(words, "word string, y int").groupBy("word").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    counts = cut(counts, "toxicity-words")
    share = n1 / (n1 + n0)
    expected = F.lit(share) * (F.col("t") + F.col("c"))
    counts = counts.withColumn("z", (F.col("t") - expected) / F.sqrt(expected * (1 - share)))
    # Evidence against chance, in nats; a word must exceed what the luckiest of so many words would show.
    n = F.col("t") + F.col("c")
    chance = F.col("t") * F.log(F.col("t") / (n * share)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (n * (1 - share)))).otherwise(0.0)
    counts = counts.withColumn("sure", chance > float(np.log(max(2, counts.count()))) - SLACK)
    rated = {r["word"]: r["z"] for r in counts.where("sure AND t >= 3 AND c * 20 <= t").orderBy(F.desc("z"), "word").limit(CANDIDATES).collect()}
    common = [r["word"] for r in counts.where("c >= 1 AND z < 3").orderBy(F.desc("c"), "word").limit(CLEAN_WORDS // 2).collect()]
    other = [r["word"] for r in counts.where("c >= 1 AND z < 3").orderBy(F.xxhash64("word"), "word").limit(CLEAN_WORDS // 2).collect()]

    def telling_in(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([[p for p in signs(t) if p in rated] for t in b.column(0).to_pylist()], pa.list_(pa.string()))], ["words"])

    found = [r["words"] for r in sample.where("y = 1").select("text").mapInArrow(telling_in, "words array<string>").collect()]
    positives = witnesses(found, rated)
    if not positives:
        return Model([], np.zeros(0), 0.0, prior=0.0)
    landmarks = [*positives[:TOXIC_LANDMARKS], *common[:CLEAN_LANDMARKS]]
    negatives, near = list(dict.fromkeys([*common, *other])), []
    for _ in range(ROUNDS):
        held = list(dict.fromkeys([*landmarks, *near]))
        model = Model(held, np.zeros(len(held)), 0.0)
        k = model.features(held).astype(float)
        value, vector = np.linalg.eigh((k + k.T) / 2)
        root = vector / np.sqrt(np.maximum(value, 0) + 1e-3)
        x = np.vstack([model.features(positives), model.features(negatives)]) @ root
        y = np.array([1.0] * len(positives) + [-1.0] * len(negatives))
        weight = np.where(y > 0, 1 / len(positives), 1 / len(negatives))
        w, bias = linear_svm(x, y, weight / weight.mean())
        model = Model(held, root @ w, bias)
        got = best_words(sample, model)
        # A word is toxic if it tells more toxic documents than clean ones. The beginning of a telling word may be
        # a clean word by itself, so what counts here is the whole word, whatever its letters begin elsewhere.
        told = Counter()
        for r in got:
            told[r["word"]] += 1 if r["y"] == 1 else -1
        positives = list(dict.fromkeys([*positives, *(r["word"] for r in got if r["y"] == 1 and r["m"] > 0 and told[r["word"]] > 0)]))[:TELLING_WORDS]
        clean = [r["word"] for r in got if r["y"] == 0 and r["m"] > -1 and told[r["word"]] < 0]
        positives = [p for p in positives if told[p] >= 0] or positives
        near = [*near, *(n for n, _ in Counter(w for w in clean if w not in near).most_common(NEAR_LANDMARKS // ROUNDS))]
        negatives = list(dict.fromkeys([*clean, *negatives]))[: 2 * CLEAN_WORDS]
    model.slope, model.shift = logistic(np.array([r["m"] for r in got]), np.array([float(r["y"]) for r in got]))
    return model


def best_words(sample: DataFrame, model: Model) -> list:
    """The word of the largest margin in each sampled document."""
    model.cache = {}

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            margins = model.margins(texts)
            words = []
            for t, m in zip(texts, margins, strict=True):
                w = next((w for w in tokens(t) if model.cache[w] == m), "")
                words.append(max(pieces(w), key=len, default=""))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(margins, pa.float64()), pa.array(words, pa.string())], ["y", "m", "word"])

    return sample.select("y", "text").mapInArrow(run, "y int, m double, word string").where("word <> ''").collect()


def witnesses(found: list[list[str]], rated: dict[str, float]) -> list[str]:
    """Words that together occur in the toxic documents: always the one of most documents that have none so far.

    Words that merely share documents with a stronger one, as those of copies do, are not taken.
    """
    of: dict[str, set[int]] = {}
    for i, words in enumerate(found):
        for w in words:
            of.setdefault(w, set()).add(i)
    out: list[str] = []
    while of and len(out) < TELLING_WORDS:
        best = max(of, key=lambda w: (len(of[w]), rated[w], w))
        gain = of.pop(best)
        if len(gain) < 2:
            break
        out.append(best)
        of = {w: left for w, docs in of.items() if (left := docs - gain)}
    return out


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Every word of a whole text is compared with the landmarks; gaps and inserted characters only lower the kernel.
    A text that only a long word or few words make toxic is found wherever they stand. Inputs are texts alone.

    Very long text: every word counts, in time like its length. Ties: equal texts have equal scores. If no word passes
    the bound on evidence (few toxic labels), all scores are 0, as if the class were missing.

    Null or empty text: the score of a text without words (low). Null doc_id: scored, held_out true. Repeated rows:
    each is scored. Empty table: no rows. Labels that lack a class: a constant score of the class that is there
    (0 if there are none). Null labels are not learnt from; of several labels of a document the largest counts. Other
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    model = train(docs, labels)
    return _scored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model)


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for i in range(0, len(texts), 256):
                m = np.array(model.margins(texts[i : i + 256]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(m)), pa.array(model.scores(m))], ["doc_id", "score"])

    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that score 0.5 or more; all columns stay as they are."""
    small_batches(docs.sparkSession)
    model = train(docs, labels)
    name = "text"
    place, schema = docs.columns.index(name), docs.schema

    def run(batches):
        for b in batches:
            texts = b.column(place).cast(pa.string()).to_pylist()
            keep = np.concatenate([np.zeros(0, bool), *(model.scores(np.array(model.margins(texts[i : i + 256]))) < 0.5 for i in range(0, len(texts), 256))])
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
