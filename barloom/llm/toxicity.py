"""Toxicity by noisy-channel restoration.

Disguised words (leetspeak, spaced letters, repeated letters) become a lattice of what each character may
stand for. A character trigram model counted over all texts and the channel's costs find the best paths (Viterbi);
the restored words are scored by a lexicon and a small logistic model learned from labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import small_batches

LABELLED = 20_000  # labelled rows the classifier is fitted on, at most: those with the smallest hash of their id
EVIDENCE = 22.0  # log-likelihood ratio a word needs to enter the lexicon
MOST_WORDS = 50_000  # of the lexicon; it is learned from at most LABELLED texts

# What disguising characters stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "*": "", "_": "", "-": "", ".": "", "'": "", "^": "", "~": ""}
FOLD = str.maketrans("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy")

# Channel costs in nats.
SWAP, DROP, KEEP, DOUBLE = 0.5, 1.0, 8.0, 0.7
LETTERS = 28  # boundary, a to z, other
_TRAIL = ".,;:!?)]}>\"'`%&*#$+|/\\-_~^=…»”’"
_LEAD = "([{<\"'`#*&%/\\~^=-_«“‘¿¡"
_HARD = re.compile(r"[^\W\d_]")
_DISGUISED = re.compile(r"[\d@$!|+€£*_.'^~-]|(.)\1")
_SIGNS = "".join(c for c, x in LEET.items() if x)  # signs that stand for letters
_AROUND = "".join(c for c in _TRAIL + _LEAD if c not in _SIGNS)
WINDOW = 64  # lattice steps decoded at once; windows overlap by half
_CACHED = 1 << 25  # characters of tokens and words a worker remembers
_REMEMBERED = 256  # longest token that is worth remembering
_FEW_PATHS = 16


def letter(c: str) -> int:
    c = c.translate(FOLD)
    return ord(c) - 96 if "a" <= c <= "z" and len(c) == 1 else 27


_CODES = np.zeros(0x250, np.int64)
for _i in range(0x250):
    _c = chr(_i).lower()
    _CODES[_i] = letter(_c[0]) if _c[0].isalpha() else 0


def trigram_counts(docs: DataFrame, text: str) -> np.ndarray:
    """Letter trigram counts over all texts, 0 for anything between letters: ``LETTERS``^3 sums."""

    def count(batches):
        total = np.zeros(LETTERS**3, np.int64)
        for b in batches:
            for t in b["text"]:
                if t:
                    c = np.frombuffer((" " + t + " ").encode("utf-32-le", "replace"), "<u4")
                    c = np.where(c < 0x250, _CODES[np.minimum(c, 0x24F)], 27)
                    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
                    c = np.concatenate([[0], c])
                    total += np.bincount(c[:-2] * LETTERS * LETTERS + c[1:-1] * LETTERS + c[2:], minlength=LETTERS**3)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"g": at, "n": total[at]})

    out = np.zeros(LETTERS**3)
    for r in docs.select(F.col(text).alias("text")).mapInPandas(count, "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n")).collect():
        out[r.g] = r.n
    return out


def letter_model(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities of a letter after two, smoothed with shorter contexts."""
    c3 = counts.reshape(LETTERS, LETTERS, LETTERS)
    p = (c3.sum((0, 1)) + 1) / (c3.sum() + LETTERS)
    for c in (c3.sum(0), c3):
        p = (c + 5 * p) / (c.sum(-1, keepdims=True) + 5)
    return np.log(p)


def lattice(token: str, phrase: bool = False) -> list[list[tuple[str, float]]]:
    """For each character, or run of one letter, what it may stand for and at which cost.

    A long run of one sign is like one of three. In a ``phrase`` separators may end words, as spaces do.
    """
    out, i = [], 0
    while i < len(token):
        c, j = token[i], i + 1
        while j < len(token) and token[j] == c:
            j += 1
        if _HARD.match(c):
            out.append([(c, 0.0)] if j - i == 1 else [(c * 2, 0.0 if j - i == 2 else DOUBLE), (c, DOUBLE)])
        elif c == " " or phrase and LEET.get(c) == "":
            out.append([("", 0.2), (" ", 0.2)])
        elif c in LEET:
            for k in range(min(j - i, 3) if LEET[c] else 1):
                out.append([(x, SWAP) for x in LEET[c]] + [("", DOUBLE if k else DROP if j == len(token) or not LEET[c] else KEEP)])
        else:
            out.append([("", DROP), (" ", KEEP)])
        i = j
    return out


PATHS = 4  # best paths kept of a token: a short word's letters alone may not settle i against l


def decode(token: str, model: np.ndarray, paths: int = PATHS) -> list[str]:
    """The best paths through a token's lattice, best first."""
    return best_paths(lattice(token), flat(model), paths)


class _Letters(dict):
    """Letter codes of characters, worked out once each."""

    def __missing__(self, c: str) -> int:
        found = self[c] = 0 if c == " " else letter(c)
        return found


_LETTER = _Letters()
_STRIDE = LETTERS * LETTERS


def flat(model: np.ndarray) -> list[float]:
    """The model as a plain list, entry (a * LETTERS + b) * LETTERS + c: single look-ups in it are far cheaper than in an array."""
    return model.ravel().tolist()


def best_paths(steps: list[list[tuple[str, float]]], model: list[float], paths: int = PATHS) -> list[str]:
    """The best paths through a lattice, best first: a state is the code of the last two letters."""
    codes = _LETTER
    number = 1
    for options in steps:
        number *= len(options)
        if number > _FEW_PATHS:
            break
    states = {0: [(0.0, "")]}
    for options in steps:
        new: dict = {}
        for state, held in states.items():
            for piece, cost in options:
                gain, at = -cost, state
                for c in piece:
                    z = at * LETTERS + codes[c]
                    gain += model[z]
                    at = z % _STRIDE
                new.setdefault(at, []).extend([(score + gain, said + piece) for score, said in held])
        if number > _FEW_PATHS:
            for k, v in new.items():
                if len(v) > paths:
                    new[k] = sorted(set(v), key=lambda e: (-e[0], e[1]))[:paths]
        states = new
    ends = [(score + model[at * LETTERS], said) for at, held in states.items() for score, said in held]
    return list(dict.fromkeys([said for _, said in sorted(ends, key=lambda e: (-e[0], e[1]))]))[:paths]


def spaced_letters(tokens: list[str]) -> Iterator[str]:
    """Windows of runs of at least three tokens of one letter or sign: they overlap by half, a spaced word is far shorter."""
    single = [len(t) == 1 or (len(t) == 2 and not t[1].isalnum()) for t in tokens]
    i = 0
    while i < len(tokens):
        try:
            i = j = single.index(True, i)
        except ValueError:
            return
        while j < len(tokens) and single[j]:
            j += 1
        if j - i >= 3:
            for s in range(i, j, 32):
                yield " ".join(tokens[s : min(j, s + 64)])
        i = j


class Restorer:
    """Words of whole texts after restoration, with a cache of decoded tokens."""

    def __init__(self, model: np.ndarray | list[float]):
        self.model = model if isinstance(model, list) else flat(model)
        self.cache: dict[str, tuple[str, ...]] = {}
        self.decoded: dict[str, tuple[str, ...]] = {}
        self.held = 0

    def remember(self, cache: dict, key: str, found: tuple[str, ...]) -> tuple[str, ...]:
        """Keep what was worked out; memory is bounded by characters, long tokens are not kept."""
        if len(key) <= _REMEMBERED:
            self.held += 100 + len(key) + sum(map(len, found))
            if self.held > _CACHED:
                self.cache.clear()
                self.decoded.clear()
                self.held = 0
            cache[key] = found
        return found

    def read(self, core: str) -> tuple[str, ...]:
        """Words of the best paths of a token that may be disguised, none of another."""
        found = self.decoded.get(core)
        if found is None:
            words = [w for path in self.paths(core) for w in path.split()] if self.disguised(core) else []
            found = self.remember(self.decoded, core, tuple(dict.fromkeys(words)))
        return found

    def token(self, t: str) -> tuple[str, ...]:
        found = self.cache.get(t)
        if found is None:
            if t.isalpha() and not _DISGUISED.search(t):
                return (t,)
            core = t.strip(_TRAIL + _LEAD) if t[-1] in _TRAIL or t[0] in _LEAD else t
            found = (core,) if core else ()
            # Signs at the ends may be letters of the word.
            for c in dict.fromkeys((core, t.strip(_AROUND))):
                if c:
                    found = tuple(dict.fromkeys([*found, *self.read(c)]))
            # Words between signs that stand for no letter are disguised each on its own.
            parts = [p for p in re.split(r"[^\w@$!|+€£]+|_+", core) if len(p) > 1]
            if parts and parts != [core]:
                found = tuple(dict.fromkeys([*found, *(w for p in parts for w in self.token(p))]))
            if core and not core.isalpha():
                plain = tuple(p for p in re.split(r"[\W\d_]+", core) if len(p) > 1)
                found += tuple(p for p in plain if p not in found)
            self.remember(self.cache, t, found)
        return found

    @staticmethod
    def disguised(core: str) -> bool:
        """Whether a token may be a disguised word: not plain letters, and at least half letters, signs for them and separators."""
        if not (_DISGUISED.search(core) or core and not core.isalpha()):
            return False
        letters = sum(c.isalpha() or bool(LEET.get(c)) for c in core)
        return letters >= 2 and 2 * sum(c.isalpha() or c in LEET for c in core) >= len(core)

    def paths(self, core: str) -> list[str]:
        """The best paths of a token; of a long one, those of overlapping windows."""
        steps = lattice(core)
        if len(steps) <= WINDOW:
            return best_paths(steps, self.model)
        steps = lattice(core, phrase=True)
        return [p for s in range(0, len(steps), WINDOW // 2) for p in best_paths(steps[s : s + WINDOW], self.model)]

    def spaced(self, line: str) -> tuple[str, ...]:
        """Words of the best paths of letters with spaces between."""
        found = self.decoded.get(line)
        if found is None:
            found = self.remember(self.decoded, line, tuple(w for path in best_paths(lattice(line), self.model) for w in path.split()))
        return found

    def words(self, text: str | None) -> Counter:
        """Counts of restored words; a disguised token also counts as it stands."""
        if not text:
            return Counter()
        tokens = text.lower().split()
        out: Counter = Counter()
        for t, n in Counter(tokens).items():
            for w in self.token(t):
                out[w] += n
        for line in spaced_letters(tokens):
            for w in self.spaced(line):
                out[w] += 1
        return out


_RUNS = re.compile(r"(.)\1+")


def bare(word: str) -> str:
    """A word with each run of one letter as a single one."""
    return _RUNS.sub(r"\1", word)


class Scorer:
    """Features of whole texts against a lexicon.

    Restoring a token of letters only changes the lengths of its runs, so one whose ``bare`` form is no listed word's
    needs no decoding to know that it restores to none.
    """

    def __init__(self, model: np.ndarray | list[float], lexicon: dict[str, float]):
        self.restorer = Restorer(model)
        self.lexicon = lexicon
        self.listed = {bare(w) for w in lexicon}
        self.hot: dict[str, tuple[str, ...]] = {}
        self.cold: set[str] = set()
        self.held = 0

    def hits(self, token: str) -> tuple[str, ...]:
        """Listed words a token stands for."""
        found = self.hot.get(token)
        if found is None:
            core = token.strip(_AROUND)
            if core.isalpha() and bare(core) not in self.listed:
                found = ()
            else:
                found = tuple(w for w in self.restorer.token(token) if w in self.lexicon)
            if len(token) <= _REMEMBERED:
                self.held += 100 + len(token)
                if self.held > _CACHED:
                    self.hot.clear()
                    self.cold.clear()
                    self.held = 0
                if found:
                    self.hot[token] = found
                else:
                    self.cold.add(token)
        return found

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Whether listed words occur, how much weight the different ones have, and how many there are for each token."""
        tokens = text.lower().split() if text else []
        times: Counter = Counter()
        for t in set(tokens) - self.cold:
            found = self.hits(t)
            if found:
                n = tokens.count(t)
                for w in found:
                    times[w] += n
        for line in spaced_letters(tokens):
            for w in self.restorer.spaced(line):
                if w in self.lexicon:
                    times[w] += 1
        if not times:
            return 0.0, 0.0, 0.0
        return 1.0, math.log1p(sum(self.lexicon[w] for w in sorted(times))), math.log(sum(times.values()) / len(tokens))


def learn_lexicon(counted: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Words whose presence speaks for toxicity: (word, a, b) are the toxic and clean texts that hold each."""
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    base = toxic / max(toxic + clean, 1)
    term = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    ratio = 2 * (term(a, (a + b) * base) + term(b, (a + b) * (1 - base)))
    weight = F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (clean + 1))
    kept = counted.withColumn("ratio", ratio).withColumn("weight", weight).filter((F.col("ratio") >= EVIDENCE) & (F.col("weight") > 1.5))
    return {r.word: float(r.weight) for r in kept.orderBy(F.desc("ratio"), "word").limit(MOST_WORDS).select("word", "weight").collect()}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps with a small ridge; intercept first."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, trains, id_column: str = "doc_id", text: str = "text", most: int = LABELLED) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted.

    ``labels`` (id, toxic) where ``trains`` holds teach the lexicon and the logistic model; at most ``most`` of them
    are used. A word is listed if at least three toxic texts hold it and it has 64 characters or fewer; at most ``MOST_WORDS`` are. The letter model is counted over all texts. Scores depend on the text alone. A null or empty
    text has the score of a text without listed words; repeated rows stay; an id with two labels counts as toxic; without labels of both kinds
    every score is the share of toxic ones (0 without labels). Columns named score or predicted are replaced; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("score", "predicted")
    chosen = labels.filter(trains & F.col("toxic").isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))  # of two labels the toxic one
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(most)  # bounds what is broadcast
    model = spark.sparkContext.broadcast(flat(letter_model(trigram_counts(docs, text))))
    sample = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id").select("text", "toxic")

    def presence(batches):
        restorer, seen = Restorer(model.value), {}
        totals = [0, 0]
        for b in batches:
            for t, y in zip(b["text"], b["toxic"]):
                totals[y == 1] += 1
                for w in restorer.words(t):
                    if len(w) <= 64:
                        seen.setdefault(w, [0, 0])[y == 1] += 1
        rows = [(w, n[1], n[0]) for w, n in seen.items()]
        yield pd.DataFrame([(None, totals[1], totals[0]), *rows], columns=["word", "a", "b"])

    counted = sample.mapInPandas(presence, "word string, a bigint, b bigint").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counted = counted.filter("a > 2 OR word IS NULL").persist()
    try:
        totals = counted.filter("word IS NULL").select("a", "b").first()
        toxic, clean = (int(totals.a), int(totals.b)) if totals else (0, 0)
        lexicon = learn_lexicon(counted.filter("word IS NOT NULL"), toxic, clean) if toxic and clean else {}
    finally:
        counted.unpersist()
    words = spark.sparkContext.broadcast(lexicon)

    def measure(batches):
        scorer = Scorer(model.value, words.value)
        for b in batches:
            rows = [scorer.features(t) for t in b["text"]]
            yield pd.DataFrame([(*r, int(y)) for r, y in zip(rows, b["toxic"])], columns=["f1", "f2", "f3", "y"])

    if toxic and clean:
        seen = sample.mapInPandas(measure, "f1 double, f2 double, f3 double, y int").groupBy("f1", "f2", "f3").agg(F.sum("y").alias("a"), F.count("*").alias("n")).toPandas()  # at most ``most`` rows
        seen = seen.sort_values(["f1", "f2", "f3"])
        x, n, k = seen[["f1", "f2", "f3"]].to_numpy(), seen["n"].to_numpy(), seen["a"].to_numpy()
        weights = fit_logistic(np.repeat(np.vstack([x, x]), np.concatenate([k, n - k]), axis=0), np.repeat([1.0, 0.0], [k.sum(), (n - k).sum()]))
    else:
        share = toxic / max(toxic + clean, 1)
        weights = np.array([30.0 if share == 1 else -30.0, 0, 0, 0])

    @F.pandas_udf("score double, predicted int")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model.value, words.value)
        for texts in batches:
            f = np.array([scorer.features(t) for t in texts]).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip(weights[0] + f @ weights[1:], -30, 30)))
            yield pd.DataFrame({"score": p, "predicted": (p >= 0.5).astype("int32")})

    # The other columns stay out of Python: ids beside null ones would lose digits there.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), score(text).alias("made")).select("row.*", "made.score", "made.predicted")
