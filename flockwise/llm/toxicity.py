"""Toxicity of restored text: a noisy channel undoes leetspeak, spacing and repetition before scoring."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockwise.llm.common import offsets_of, slices, stored, text_or_empty

#: What a character may stand for besides itself.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = ".-_*~'"
#: Costs of the channel, in nats.
SWAP, SKIP, SQUEEZE, KEEP = 0.7, 0.3, 0.4, 4.0
#: Letters of the language model: a to z, the lower-case letters of Latin-1, one class for other letters, 0 for the rest.
ALPHABET = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
CLASSES = 64
CODE = {c: i + 1 for i, c in enumerate(ALPHABET)}
OTHER = len(ALPHABET) + 1
NOISY = re.compile(r"(?=.*[^\W\d_])(?:.*[0-9@$!|+(€£].*|.*[^\W\d_][.\-_*~']+[^\W\d_].*|.*([^\W\d_])\1\1.*)", re.S)
LETTERS = re.compile(r"[^\W\d_]+")
DOUBLED = re.compile(r"([^\W\d_])\1")
#: Three or more single symbols with up to three separators between any two: a word that is spelled out.
SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+(€£])(?:[ \t.\-_*~'/\\,:]{1,3}(?:[^\W_]|[@$!|+(€£])){2,}(?![^\W_])")
SPACED_RE2 = r"(?:[\pL\pN]|[@$!|+(€£])(?:[ \t.\-_*~'/\\,:]{1,3}(?:[\pL\pN]|[@$!|+(€£])){2}(?:$|[^\pL\pN])"
GAP = re.compile(r"[ \t.\-_*~'/\\,:]+")
#: Words of up to so many characters may be pieces of one word, and the cost of joining two of them.
PIECE, JOIN = 3, 1.0
NGRAMS = (4, 5, 6)


def _class_table() -> np.ndarray:
    table = np.zeros(0x3000, np.int64)
    for point in range(len(table)):
        if (c := chr(point).lower()[:1]).isalpha():
            table[point] = CODE.get(c, OTHER)
    return table


_TABLE = _class_table()


def _trigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of character trigrams within words over all texts of the task; 0 marks a word's bounds."""
    total = np.zeros(CLASSES**3, np.int64)
    for batch in slices(batches, 0):
        text = "  ".join(batch.column(0).to_pylist())
        points = np.frombuffer(f"  {text}  ".encode("utf-32-le"), "<u4")
        c = _TABLE[np.minimum(points, len(_TABLE) - 1)]
        code = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
        total += np.bincount(code, minlength=CLASSES**3)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["code", "n"])


class CharModel:
    """Trigram log-probabilities with back-off by interpolation."""

    def __init__(self, counts: dict[int, int]):
        n3 = np.full(CLASSES**3, 0.0)
        for code, n in counts.items():
            n3[code] = n
        n3 = n3.reshape(CLASSES, CLASSES, CLASSES)
        n3[0, 0, 0] = 0
        n2, n1 = n3.sum(0), n3.sum((0, 1))
        p1 = (n1 + 1) / (n1.sum() + CLASSES)
        p2 = (n2 + 8 * p1) / (n2.sum(1, keepdims=True) + 8)
        p3 = (n3 + 8 * p2[None]) / (n3.sum(2, keepdims=True) + 8)
        self.cost = -np.log(p3)
        self.flat: list[float] | None = None

    def __getstate__(self):
        return {"cost": self.cost, "flat": None}

    def steps(self) -> list[float]:
        """Costs by (letter before the last * CLASSES + last letter) * CLASSES + letter, as a list: quicker to look up one by one."""
        if self.flat is None:
            self.flat = self.cost.ravel().tolist()
        return self.flat


def options(run: str, ch: str) -> list[tuple[str, float]]:
    """What a run of one character may have been, with costs."""
    k = len(run)
    if ch.isalpha():
        return [(ch, 0.0)] if k == 1 else [(ch * 2, 0.0 if k == 2 else SQUEEZE), (ch, SQUEEZE)]
    out = [(" " * 1, KEEP if ch in LEET else 1.0)]
    if ch in SEPARATORS:
        out.append(("", SKIP))
    for letter in LEET.get(ch, ""):
        out += [(letter, SWAP)] if k == 1 else [(letter * 2, SWAP + (0.0 if k == 2 else SQUEEZE)), (letter, SWAP + SQUEEZE)]
    return out


def restore(word: str, model: CharModel) -> str:
    """The cheapest reading of ``word``."""
    return cheapest([options("".join(same), ch) for ch, same in groupby(word)], model)


def restore_spaced(run: str, model: CharModel) -> str:
    """The cheapest reading of a spelled-out run: each gap is nothing or a space."""
    lattice, at = [], 0
    for gap in [*GAP.finditer(run), None]:
        piece = run[at : gap.start()] if gap else run[at:]
        lattice += [options("".join(same), ch) for ch, same in groupby(piece)]
        if gap:
            lattice.append([("", SKIP), (" ", 1.0)])
            at = gap.end()
    return cheapest(lattice, model)


def joined(a: str, b: str, model: CharModel) -> str | None:
    """Two short words as one, if that is the cheaper reading."""
    out = cheapest([*(options("".join(s), c) for c, s in groupby(a)), [("", JOIN), (" ", 0.0)], *(options("".join(s), c) for c, s in groupby(b))], model)
    return None if " " in out else out


def cheapest(lattice: list[list[tuple[str, float]]], model: CharModel) -> str:
    """The cheapest path through a lattice of readings under the language model (Viterbi over the last two letters)."""
    costs = model.steps()
    best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}  # by the last two letters: one * CLASSES + other
    for choices in lattice:
        coded = [(text, [CODE.get(c, OTHER if c.isalpha() else 0) for c in text], extra) for text, extra in choices]
        step: dict[int, tuple[float, tuple]] = {}
        for last, (cost, path) in best.items():
            for text, letters, extra in coded:
                at, total = last, cost + extra
                for z in letters:
                    if at % CLASSES or z:
                        total += costs[at * CLASSES + z]
                    at = at % CLASSES * CLASSES + z
                if at not in step or total < step[at][0]:
                    step[at] = (total, (path, text))
        best = step
    _, path = min(((cost + costs[at * CLASSES], path) for at, (cost, path) in best.items()), key=lambda e: e[0])
    parts = []
    while path:
        path, text = path
        parts.append(text)
    return "".join(reversed(parts))


def features(word: str) -> set[str]:
    """Parts of a restored word: itself, and its n-grams with marked bounds."""
    out = set()
    for part in LETTERS.findall(word):
        marked = f"<{part}>"
        out.add(marked)
        for n in NGRAMS:
            out.update(marked[i : i + n] for i in range(len(marked) - n + 1))
    return out


class Restorer:
    """Restored words of whole batches; up to ``limit`` distinct words are kept with their values."""

    def __init__(self, model: CharModel, weigh=None, limit: int = 100_000):
        self.model, self.weigh, self.limit, self.memo, self.pairs = model, weigh, limit, {}, {}

    def restored(self, word: str) -> str:
        plain = word.isalpha()
        double = DOUBLED.search(word)
        if plain and not double:
            return word
        clean = restore(word, self.model) if NOISY.fullmatch(word) else word
        # doubled letters may be meant: both readings count
        return f"{word} {restore(word, self.model)}" if clean == word and double else clean

    def values(self, words: list[str]) -> list:
        """Restored words, or their weights; what is new is weighed together."""
        fresh = [w for w in words if w not in self.memo]
        if len(self.memo) + len(fresh) > self.limit:
            self.memo.clear()
            fresh = words
        if fresh:
            clean = [self.restored(w) for w in fresh]
            values = clean if self.weigh is None else self.weigh.many(clean) if isinstance(self.weigh, Weights) else map(self.weigh, clean)
            self.memo.update(zip(fresh, values, strict=True))
        out = [self.memo[w] for w in words]
        if len(self.memo) > self.limit:  # nothing beyond the limit outlives a batch
            self.memo.clear()
        return out

    def value(self, word: str):
        return self.values([word])[0]

    def words(self, texts: pa.StringArray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct words, the code of every word, and where each text starts; words that were spelled out or cut come as more words."""
        low = pc.utf8_lower(texts)
        spaced = pc.match_substring_regex(low, SPACED_RE2).to_numpy(zero_copy_only=False).astype(bool)
        if spaced.any():
            rows = low.to_pylist()
            for i in np.flatnonzero(spaced).tolist():
                rows[i] = " ".join([rows[i], *(restore_spaced(m, self.model) for m in SPACED.findall(rows[i]))])
            low = pa.array(rows, pa.string())
        lists = pc.utf8_split_whitespace(low)
        ends = offsets_of(lists)
        flat = lists.flatten().dictionary_encode()
        return self._with_pairs(flat.dictionary.to_pylist(), flat.indices.to_numpy(), ends - ends[0])

    def _with_pairs(self, names: list[str], codes: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Adds the joined word after two adjacent short words that read better as one."""
        cores = [w.rstrip(".,;:?!\"')") for w in names]
        right = np.fromiter((0 < len(c) <= PIECE and c.isalpha() for c in cores), bool, len(cores))
        left = right & np.fromiter((c == w for c, w in zip(cores, names, strict=True)), bool, len(cores))
        letters = np.fromiter(map(len, cores), int, len(cores))
        a, b = codes[:-1].astype(np.int64), codes[1:].astype(np.int64)
        ok = left[a] & right[b] & (letters[a] + letters[b] > 2)
        ok[ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(codes))] - 1] = False
        at = np.flatnonzero(ok)
        if not len(at):
            return names, codes, ends
        keys, which = np.unique(a[at] * len(names) + b[at], return_inverse=True)
        found = np.full(len(keys), -1, np.int64)
        names = list(names)
        for k, key in enumerate(keys.tolist()):
            pair = tuple(cores[i] for i in divmod(key, len(cores)))
            if pair not in self.pairs:
                if len(self.pairs) > self.limit:
                    self.pairs.clear()
                self.pairs[pair] = joined(*pair, self.model)
            if self.pairs[pair] is not None:
                found[k] = len(names)
                names.append(self.pairs[pair])
        more = found[which]
        at, more = at[more >= 0], more[more >= 0]
        return names, np.insert(codes.astype(np.int64), at + 2, more), ends + np.searchsorted(at + 1, ends, "left")


def _evidence(texts: pa.StringArray, restorer: Restorer) -> np.ndarray:
    """Per text: the sum of the words' weights, the greatest one, and the logarithm of the words."""
    names, codes, ends = restorer.words(texts)
    weights = np.array(restorer.values(names), float)[codes]
    total = np.concatenate(([0.0], np.cumsum(weights)))
    out = np.zeros((len(texts), 3))
    out[:, 0] = np.minimum(total[ends[1:]] - total[ends[:-1]], 60.0)
    hit = np.flatnonzero(weights > 0)
    rows = np.searchsorted(ends, hit, "right") - 1
    np.maximum.at(out[:, 1], rows, weights[hit])
    out[:, 2] = np.log1p(np.diff(ends))
    return out


class Weights:
    """The weight of a restored word: the largest log-odds of its telling parts, 0 without one."""

    def __init__(self, table: dict[str, float]):
        self.table = table
        self.automaton = None

    def __getstate__(self):
        return {"table": self.table, "automaton": None}

    def many(self, words: list[str]) -> list[float]:
        """One walk of an automaton over all marked words. A part with a mark at both ends is a whole word, so every hit is one of its ``features``."""
        if not self.table or not words:
            return [0.0] * len(words)
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for part, weight in self.table.items():
                self.automaton.add_word(part, weight)
            self.automaton.make_automaton()
        marked = [f"<{w}>" if w.isalpha() else "".join(f"<{part}>" for part in LETTERS.findall(w)) for w in words]
        ends = np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked)))
        out = np.zeros(len(words))
        hits = list(self.automaton.iter("".join(marked)))
        if hits:
            at, weight = zip(*hits, strict=True)
            np.maximum.at(out, np.searchsorted(ends, np.array(at), "right"), np.array(weight))
        return out.tolist()

    def __call__(self, word: str) -> float:
        return self.many([word])[0]


def telling(counts: list[tuple[str, int, int]], positive: int, negative: int) -> dict[str, float]:
    """Log-odds of the parts whose share of toxic texts can't be chance among that many parts."""
    if not positive or not negative or not counts:
        return {}
    base, out = positive / (positive + negative), {}
    bound = math.log(len(counts)) + 3
    for feature, p, n in counts:
        rate = p / (p + n)
        if rate <= base:
            continue
        gain = p * math.log(rate / base) + (n * math.log((1 - rate) / (1 - base)) if n else 0.0)
        if gain > bound:
            out[feature] = math.log((p + 0.5) / (positive + 1)) - math.log((n + 0.5) / (negative + 1))
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last is the intercept."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([*([ridge] * x.shape[1]), 1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


class ToxicityModel:
    """Character model, word weights and calibration, small enough to send to every task."""

    def __init__(self, chars: CharModel, table: dict[str, float], line: np.ndarray):
        self.chars, self.table, self.line = chars, table, line
        self.restorer: Restorer | None = None

    def score(self, texts: pa.StringArray) -> np.ndarray:
        if self.restorer is None:  # a broadcast model lives as long as its worker, and so do the words it has restored
            self.restorer = Restorer(self.chars, Weights(self.table))
        x = _evidence(texts, self.restorer)
        return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ self.line, -30, 30)))


def char_model(docs: DataFrame, text_col: str = "text") -> CharModel:
    """Trigram counts of all texts. The counts per task grow with the table; their sums have at most 64^3 rows."""
    parts = docs.select(text_or_empty(text_col)).mapInArrow(_trigram_counts, "code long, n long")
    return CharModel({r["code"]: r["n"] for r in parts.groupBy("code").agg(F.sum("n").alias("n")).collect()})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 20_000) -> ToxicityModel:
    """Learn from at most ``max_labelled`` labelled rows outside the held-out share, taken in hash order.

    Word parts are counted on two halves; the calibration is fitted on one half with the parts
    of the other, so that it meets parts as new as those of unseen texts; then both halves' parts are used.
    """
    chars = char_model(docs, text_col)
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    chosen = chosen.select(F.col(id_col).alias("__id"), (F.col(label_col) >= 1).cast("long").alias("y")).orderBy(F.xxhash64("__id"), "y").limit(max_labelled)
    sample = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "__id")
    sample = stored(sample.select("text", "y", F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(2)).alias("fold")), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, seen = Restorer(chars, features, limit=5_000), Counter()  # a word's parts take far more room than a weight
        for batch in slices(batches, 0, 1 << 19):
            names, codes, ends = restorer.words(batch.column(0).cast(pa.string()))
            parts = restorer.values(names)
            for i, (y, fold) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                own: set[str] = set().union(*(parts[c] for c in set(codes[ends[i] : ends[i + 1]].tolist())))
                seen.update((f, fold, y) for f in own)
            del parts, names  # before the next batch makes its own
            if len(seen) > 200_000:
                yield _counted(seen)
                seen.clear()
        yield _counted(seen)

    table = sample.mapInArrow(count, "feature string, fold long, y long, n long")
    when = lambda fold, y: F.sum(F.when((F.col("fold") == fold) & (F.col("y") == y), F.col("n")).otherwise(0))
    table = table.groupBy("feature").agg(when(0, 1).alias("p0"), when(0, 0).alias("n0"), when(1, 1).alias("p1"), when(1, 0).alias("n1"))
    rows = [tuple(r) for r in stored(table, "parts").where("p0 + p1 >= 3").collect()]  # bounded by max_labelled
    sizes = {(r["fold"], r["y"]): r["count"] for r in sample.groupBy("fold", "y").count().collect()}
    size = lambda fold, y: sizes.get((fold, y), 0)
    half = telling([(f, p, n) for f, p, n, _, _ in rows if p], size(0, 1), size(0, 0))
    full = telling([(f, p + q, n + m) for f, p, n, q, m in rows], size(0, 1) + size(1, 1), size(0, 0) + size(1, 0))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(chars, Weights(half))
        for batch in slices(batches, 0):
            x = _evidence(batch.column(0).cast(pa.string()), restorer)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), batch.column(1)], ["a", "b", "c", "y"])

    met = np.array([tuple(r) for r in sample.where("fold = 1").mapInArrow(weigh, "a double, b double, c double, y long").collect()], float).reshape(-1, 4)
    line = logistic(met[:, :3], met[:, 3]) if len(met) else np.array([0.0, 0.0, 0.0, -3.0])
    return ToxicityModel(chars, full, line)


def _counted(seen: Counter) -> pa.RecordBatch:
    keys = list(seen)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (1, 2)), pa.array([seen[k] for k in keys], pa.int64())],
        ["feature", "fold", "y", "n"],
    )


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` with ``toxicity`` (0 to 1) and ``toxic`` (1 from ``threshold`` on); nothing is shuffled.

    A null text counts as empty and gets the score of a text without words. Texts are scored whole; repeated rows get equal scores;
    columns of ``docs`` named ``toxicity`` or ``toxic`` are replaced. An empty table gives an empty result, and without
    labelled rows every text gets the same low score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("toxicity", "toxic")]
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).withColumn("__text", F.lit("")).withColumn("toxicity", F.lit(0.0)).drop("__text").schema
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, len(keep)):
            s = model.score(batch.column(len(keep)).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s)], names)

    out = docs.select(*[F.col(f"`{c}`") for c in keep], text_or_empty(text_col).alias("__text")).mapInArrow(run, schema)
    return out.withColumn("toxic", (F.col("toxicity") >= threshold).cast("int"))
