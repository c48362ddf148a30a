"""Toxic documents by a support vector machine over a subsequence string kernel, with Nystroem landmarks.

Two words are as similar as the character subsequences of length LENGTH they share, each weighted by
DECAY to the power of the stretch it spans: inserted, missing and swapped characters cost a factor of the similarity.
A text's kernel is that of its words, summed. The machine is trained on labelled texts in that space:

* A machine over whole texts, in the kernel of sums, gives every word a margin; a text's own part in it is taken out
  before its words are judged. What it can't explain may be a word that toxic texts share and no clean one has.
* Of each toxic text the words it names as the cause, and the worst mistaken words of clean texts, train a machine
  over words, on Nystroem features; in rounds, this one names the causes anew (multiple instances). It is always
  asked about texts that it was not trained on: the texts are two halves, and a word that only its own half
  calls toxic explains nothing.
* Each cause is also learned with a letter put in, left out or swapped.

The kernel's feature space is finite (32 folded letters), so the machine's landmarks collapse to one
weight for each subsequence, and a word is scored by adding up the weights of its own subsequences.

The machine is fitted on a bounded sample of labelled rows, SAMPLE of each label at most by order of a
hash; rows whose crc32(doc_id) mod 4 is 2 are held out. All words of all documents are scored.

Defined results: null and empty texts and texts without words of three letters get the score of no evidence;
repeated rows get equal scores; labels that repeat or are null teach nothing new. With no labelled rows of one kind,
every score is the share of toxic labels.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

#: Labelled rows of each label that the machine is fitted on, at most.
SAMPLE = 2000
#: Labelled texts of more characters are not in the sample, so that the driver's memory is bounded; others are, whole.
SAMPLE_CHARS = 100_000
LENGTH, SPAN, DECAY = 3, 6, 0.8
LANDMARKS, ROUNDS = 600, 2
#: Texts of each label that the machine over whole texts is trained on, at most.
WHOLE = 800
#: Spellings that each cause is learned in: with a letter put in, left out, swapped.
SPELLINGS = ("put_in", "put_in", "put_in", "put_in", "left_out", "left_out", "swapped")
THRESHOLD = 0.3
#: The margin of no evidence, below which none counts.
NOTHING = -1.0
#: Words of a document that its score rests on.
BEST = 1
#: Words whose scores a worker remembers.
REMEMBERED = 200_000
#: Longer words are scored in overlapping stretches of so many letters.
LONGEST = 32
_SPELLED = re.compile(r"(?<!\S)[^\W_](?:[ .\-_*][^\W_]){3,}(?!\S)")
#: Signs that stand for letters.
_SIGNS = str.maketrans("013457@$", "oieastas")


def _code(c: str) -> int:
    """1 to 26 for Latin letters, full-width and the like too; 28 to 31 for other letters; 0 for what is no letter."""
    c = unicodedata.normalize("NFKC", c.translate(_SIGNS).lower())[:1]
    if "a" <= c <= "z":
        return ord(c) - 96
    return 28 + ord(c) % 4 if c.isalpha() else 0


_START = bytes([27])


class _Codes(dict):
    """Code points to their codes as characters, for str.translate; worked out when first met."""

    def __missing__(self, point: int):
        k = _code(chr(point))
        self[point] = found = chr(k) if k else None
        return found


_CODES = _Codes()


def words_of(text: str | None) -> set[str]:
    """The words of a text, and letters spelled one by one as a word each."""
    if not text:
        return set()
    out = set(text.lower().split())
    for m in _SPELLED.finditer(text):
        out.add(m[0].lower())
    return out


def folded(word: str) -> list[bytes]:
    """A word's letters as codes after one that marks its start, in stretches of at most LONGEST."""
    codes = _START + word.translate(_CODES).encode("latin-1")
    if len(codes) <= LONGEST:
        return [codes]
    return [codes[i : i + LONGEST] for i in range(0, len(codes) - LONGEST // 2, LONGEST // 2)]


def subsequences(stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, subsequence, weight) of the subsequences of each stretch, by owner; weights have norm 1 over an owner."""
    n, length = len(stretches), np.fromiter(map(len, stretches), np.int64, len(stretches))
    flat = np.zeros((n, int(length.max(initial=0)) + SPAN), np.int32)
    row = np.repeat(np.arange(n), length)
    flat[row, np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)] = np.frombuffer(b"".join(stretches), np.uint8)
    width = flat.shape[1] - SPAN
    owners, subs, weights = [], [], []
    for places in _GAPS:
        i, j = np.nonzero(flat[:, places[-1] : places[-1] + width])
        sub = flat[i, j]
        for k in places:
            sub = sub * 32 + flat[i, j + k]
        owners.append(i)
        subs.append(sub)
        weights.append(np.full(len(i), DECAY ** (places[-1] + 1), np.float32))
    # a subsequence that occurs again adds to its first
    key = np.concatenate(owners) * SPACE + np.concatenate(subs)
    order = np.argsort(key)
    key, weight = key[order], np.concatenate(weights)[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    weight = np.add.reduceat(weight, first) if len(key) else weight
    owner, sub = np.divmod(key[first], SPACE)
    norm = np.sqrt(np.bincount(owner, weight**2, n)).astype(np.float32)
    return owner, sub, weight / np.maximum(norm, 1e-9)[owner]


_GAPS = list(combinations(range(1, SPAN), LENGTH - 1))
SPACE = 32**LENGTH


class Machine:
    """weights: of subsequences; a word's margin is their sum over it plus `bias`; a document's score is logistic in its BEST best."""

    def __init__(self, at: np.ndarray, weight: np.ndarray, bias: float, slope: np.ndarray, shift: float):
        self.at, self.weight, self.bias, self.slope, self.shift = at, weight.astype(np.float32), bias, slope, shift
        self._table: np.ndarray | None = None
        self._known: dict[str, float] = {}

    def __getstate__(self):
        return {"at": self.at, "weight": self.weight, "bias": self.bias, "slope": self.slope, "shift": self.shift, "_table": None, "_known": {}}

    def margins(self, words: list[str]) -> np.ndarray:
        if self._table is None:
            self._table = np.zeros(SPACE, np.float32)
            self._table[self.at] = self.weight
        stretches, owner = [], []
        for i, w in enumerate(words):
            for s in folded(w):
                if len(s) > LENGTH:  # words of fewer letters are no evidence
                    stretches.append(s)
                    owner.append(i)
        out = np.full(len(words), NOTHING)
        for a in range(0, len(stretches), 4096):
            part = stretches[a : a + 4096]
            o, sub, weight = subsequences(part)
            m = np.bincount(o, self._table[sub] * weight, len(part)) + self.bias
            np.maximum.at(out, owner[a : a + 4096], m)
        return out

    def learn(self, words: set[str]) -> dict[str, float]:
        """Margins by word, those of `words` among them."""
        new = [w for w in words if w not in self._known]
        if len(self._known) + len(new) > REMEMBERED:
            self._known, new = {}, list(words)
        self._known.update(zip(new, self.margins(new).tolist(), strict=True))
        return self._known

    def score(self, margins: list[float]) -> float:
        """The score of a document with these best margins."""
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.slope, margins) + self.shift, -30, 30))))


def best(words: set[str], margins: dict[str, float]) -> list[float]:
    """The BEST largest margins of a document's words, filled up with NOTHING."""
    return (heapq.nlargest(BEST, map(margins.__getitem__, words)) + [NOTHING] * BEST)[:BEST]


def _kernel(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Kernel values of words against words."""
    (oa, sa, wa), (ob, sb, wb) = subsequences(a), subsequences(b)
    space, sb_at = np.unique(sb, return_inverse=True)
    right = np.zeros((len(space), len(b)), np.float32)
    np.add.at(right, (sb_at, ob), wb)
    out = np.zeros((len(a), len(b)), np.float32)
    at = np.searchsorted(space, sa)
    hit = (at < len(space)) & (space[np.minimum(at, len(space) - 1)] == sa) if len(space) else np.zeros(len(sa), bool)
    oa, at, wa = oa[hit], at[hit], wa[hit]
    order = np.argsort(oa, kind="stable")
    oa, at, wa = oa[order], at[order], wa[order]
    for i in range(0, len(oa), 1 << 13):
        owner, first = np.unique(oa[i : i + (1 << 13)], return_index=True)
        out[owner] += np.add.reduceat(right[at[i : i + (1 << 13)]] * wa[i : i + (1 << 13), None], first)
    return out


def _spelled(word: bytes, how: str, rng: np.random.Generator) -> bytes:
    """A word with one letter put in, left out or swapped with the next; its start stays, short words keep their letters."""
    n = len(word)
    if how == "put_in":
        at = int(rng.integers(2, n)) if n > 2 else n
        return word[:at] + bytes([int(rng.integers(1, 27))]) + word[at:]
    if n < 6:
        return word
    at = int(rng.integers(2, n - 1))
    return word[:at] + (word[at + 1 :] if how == "left_out" else word[at + 1 : at + 2] + word[at : at + 1] + word[at + 2 :])


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 60) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps on the active rows; the last weight is the bias."""
    n, m = x.shape
    w, before = np.zeros(m + 1), None
    ridge = np.full(m + 1, 1.0)
    ridge[-1] = 1e-3
    for _ in range(steps):
        active = np.flatnonzero(y * (x @ w[:-1].astype(np.float32) + w[-1]) < 1)
        if before is not None and np.array_equal(active, before):
            break
        before = active
        square, right = np.diag(ridge), np.zeros(m + 1)
        for k in range(0, len(active), 2048):  # in parts, so that the rows are not held twice
            at = active[k : k + 2048]
            part = np.hstack([x[at], np.ones((len(at), 1))])
            weighed = part * cost[at, None]
            square += weighed.T @ part
            right += weighed.T @ y[at]
        w = np.linalg.solve(square, right)
    return w[:-1], float(w[-1])


def _weights(over: np.ndarray, words: list[bytes]) -> np.ndarray:
    """For each word the sum of `over`, a value for each subsequence, over its own."""
    out = np.zeros(len(words))
    for a in range(0, len(words), 4096):
        part = words[a : a + 4096]
        o, sub, weight = subsequences(part)
        out[a : a + 4096] = np.bincount(o, over[sub] * weight, len(part))
    return out


def _whole_texts(bags: list[list[bytes]], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a value for each subsequence, texts' weights, texts): the machine over whole texts, in the kernel of their words' sums."""
    x = np.zeros((len(bags), SPACE), np.float16)
    for i, bag in enumerate(bags):
        if bag:
            _, sub, weight = subsequences(bag)
            row = np.bincount(sub, weight, SPACE)
            x[i] = row / max(float(np.linalg.norm(row)), 1e-9)
    gram = np.zeros((len(bags), len(bags)))
    for k in range(0, SPACE, 4096):  # in parts, so that the texts are not held twice
        part = x[:, k : k + 4096].astype(np.float32)
        part -= part.mean(0)
        gram += part @ part.T
    # the dual of the squared hinge: kernel ridge on the texts within the margin
    active, alpha = np.ones(len(y), bool), np.zeros(len(y))
    ridge = 0.1 * np.trace(gram) / max(1, len(y))
    for _ in range(20):
        k = np.flatnonzero(active)
        alpha[:] = 0.0
        alpha[k] = np.linalg.solve(gram[np.ix_(k, k)] + ridge * np.eye(len(k)), y[k])
        now = y * (gram @ alpha) < 1
        if not now.any() or (now == active).all():
            break
        active = now
    alpha = alpha.astype(np.float32)
    over = np.concatenate([(alpha - alpha.mean()) @ x[:, k : k + 4096].astype(np.float32) for k in range(0, SPACE, 4096)])
    return over, alpha, x


def _words_machine(causes: Counter, clean: list[bytes], common: Counter, landmarks: int, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """(value for each subsequence, bias): the machine over words, on Nystroem features of their kernel. common: clean texts by word."""
    positive = [w for w, _ in sorted(causes.items(), key=lambda x: (-x[1], x[0]))][:1500]
    negative = [w for w in clean if w not in causes]
    marks = positive[: landmarks * 2 // 3] + [negative[i] for i in rng.permutation(len(negative))[: landmarks // 3]]
    value, vector = np.linalg.eigh(_kernel(marks, marks).astype(np.float64) + 1e-6 * np.eye(len(marks)))
    root = vector / np.sqrt(np.maximum(value, 1e-4))
    spelled = [(_spelled(w, how, rng), causes[w]) for w in positive for how in SPELLINGS]
    words = positive + [w for w, _ in spelled] + negative
    x = _kernel(words, marks) @ root.astype(np.float32)
    y = np.r_[np.ones(len(positive) + len(spelled)), -np.ones(len(negative))]
    often = lambda n: 1 + np.log1p(n)
    cost = np.r_[[2 * often(causes[w]) for w in positive], [often(n) for _, n in spelled], [4 * (1 + common[w]) for w in negative]]
    w, bias = _svm(x, y, cost)
    out = np.zeros(SPACE, np.float32)
    o, sub, weight = subsequences(marks)
    np.add.at(out, sub, (root @ w)[o] * weight)
    return out, bias


def fit(docs: list[tuple[str | None, int]], landmarks: int = LANDMARKS, rounds: int = ROUNDS, seed: int = 5) -> Machine:
    """The machine for (text, 0 or 1) rows."""
    n_toxic = sum(y for _, y in docs)
    n_clean = len(docs) - n_toxic
    none = np.zeros(0, np.int64)
    if not n_toxic or not n_clean:
        p = np.clip(n_toxic / max(1, len(docs)), 1e-6, 1 - 1e-6)
        return Machine(none, np.zeros(0), NOTHING, np.zeros(BEST), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    bags: dict[int, list[list[bytes]]] = {0: [], 1: []}
    for text, y in docs:
        bags[y].append(sorted({c for w in words_of(text) for c in folded(w) if len(c) > LENGTH}))
    common = Counter(w for b in bags[0] for w in b)
    often = Counter(w for b in bags[1] for w in b)
    some = bags[1][:WHOLE] + bags[0][:WHOLE]
    n_some = min(WHOLE, n_toxic)
    over, alpha, x = _whole_texts(some, np.r_[np.ones(n_some), -np.ones(len(some) - n_some)])
    halves = [{y: bags[y][h::2] for y in (0, 1)} for h in (0, 1)]
    own = [{y: {i // 2: i + (y == 0) * n_some for i in range(h, min(WHOLE, len(bags[y])), 2)} for y in (0, 1)} for h in (0, 1)]

    def without(h: int, label: int) -> list[dict[bytes, float]]:
        """The words of each text of a half with their margins, the text's own part taken out."""
        at = own[h][label]
        return [dict(zip(b, _weights(over - alpha[at[k]] * x[at[k]].astype(np.float32) if k in at else over, b).tolist(), strict=True)) for k, b in enumerate(halves[h][label])]

    best_clean = [max(m.values()) for h in (0, 1) for m in without(h, 0) if m]
    least = float(np.quantile(best_clean, 0.9)) if best_clean else 0.0  # above nearly all that is the best word of a clean text
    known = [sorted({w for b in half[0] for w in b}) for half in halves]
    pick = lambda margin, least: sorted((w for w, m in margin.items() if m > least), key=lambda w: (-margin[w], w))[:3]
    seen = [set(), set()]
    for step in range(rounds + 1):
        causes = [Counter(), Counter()]
        for h, half in enumerate(halves):
            if step:  # the other half's machine
                over, bias = machines[1 - h]
                words = sorted({w for b in half[1] for w in b})
                margin = dict(zip(words, (_weights(over, words) + bias).tolist(), strict=True))
                for b in half[1]:  # what the other half's machine doesn't explain, the first one may have
                    causes[h].update(pick({w: margin[w] for w in b}, 0.0) or [w for w in b if firm[w] > 1][:1])
            else:
                for m in without(h, 1):  # a text that the machine can't explain may have a word that clean texts never have, and toxic ones do
                    causes[h].update(pick(m, least) or sorted((w for w in m if not common[w] and often[w] > 2), key=lambda w: (-often[w], w))[:1])
            order = np.argsort(-_weights(over, known[h]), kind="stable")[:1500]
            seen[h] |= {known[h][i] for i in (*order, *rng.permutation(len(known[h]))[:1000])}
            # clean words in other spellings are no causes either: the worst mistaken of them
            other = [_spelled(known[h][i], SPELLINGS[k % len(SPELLINGS)], rng) for k, i in enumerate(rng.integers(0, len(known[h]), 20_000))] if known[h] else []
            seen[h] |= {other[i] for i in np.argsort(-_weights(over, other), kind="stable")[:1000]}
        if step == 0:
            firm = sum(causes, Counter())
            del x
        if not all(causes):  # nothing that one half learns explains the other
            causes = [sum(causes, Counter())] * 2
        if not causes[0]:
            causes = [Counter(w for b in bags[1] for w in b)] * 2
        if step < rounds:
            machines = [_words_machine(causes[h], sorted(seen[h]), common, landmarks, rng) for h in (0, 1)]
    every = sum(causes, Counter())
    over, bias = _words_machine(every, sorted(seen[0] | seen[1]), common, landmarks, rng)
    at = np.flatnonzero(over)
    machine = Machine(at, over[at], bias, np.zeros(BEST), 0.0)
    top, y = [], []
    for label in (1, 0):
        for a in range(0, len(bags[label]), 64):
            part = [b for b in bags[label][a : a + 64] if b]
            words = sorted(set().union(*map(set, part)))
            margin = dict(zip(words, (_weights(over, words) + bias).tolist(), strict=True))
            # a text counts as it is, and in other spellings: a toxic one's causes, some words of a clean one
            change = [w for w in words if margin[w] > 0] if label else sorted({b[int(rng.integers(len(b)))] for b in part})
            spelled = {w: _spelled(w, SPELLINGS[int(rng.integers(len(SPELLINGS)))], rng) for w in change}
            other = dict(zip(spelled, (_weights(over, list(spelled.values())) + bias).tolist(), strict=True))
            top += [best(set(b), {**margin, **other}) for b in part]
            top += [best(set(b), margin) for b in part]
            y += [label] * (len(top) - len(y))
    machine.slope, machine.shift = _calibrate(np.array(top), np.array(y, float))
    # a text whose words are all on the clean side of the machine is not toxic
    machine.shift = min(machine.shift, float(np.log(THRESHOLD / (1 - THRESHOLD))))
    return machine


def _calibrate(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic weights of the best margins, and the constant."""
    x, w = np.c_[m, np.ones(len(m))], np.zeros(m.shape[1] + 1)
    ridge = np.array([0.05] * m.shape[1] + [1e-4])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-6:
            break
    return np.maximum(w[:-1], 0.0), float(w[-1])


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine from at most `sample` labelled rows of each label that aren't held out."""
    known = labels.filter(F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(11))
    picked = known.filter("toxic = 1").orderBy(order, "doc_id").limit(sample).union(known.filter("toxic = 0").orderBy(order, "doc_id").limit(sample))
    rows = docs.select("doc_id", "text").filter(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic").orderBy("doc_id", "text").limit(2 * sample)
    return fit([(r["text"], r["toxic"]) for r in rows.toLocalIterator()])


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """docs with `score` and `predicted`, which replace columns of these names."""
    given = docs.sparkSession.sparkContext.broadcast(machine)

    @tidied
    def judge(batches):
        m = given.value
        for batch in batches:
            texts, out = batch.column("text"), []
            for a in range(0, len(texts), 128):
                part = [words_of(t.as_py()) for t in texts.slice(a, 128)]
                known = m.learn(set().union(*part))
                out += [m.score(best(b, known)) for b in part]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("text"), pa.array(out, pa.float64())], ["k", "text", "score"])

    # the other columns travel as one, so that names can't clash
    columns = [c for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(F.struct(F.lit(None).cast("int").alias("_"), *[F.col(f"`{c}`") for c in columns if c != "text"]).alias("k"), "text")
    scored = rows.mapInArrow(judge, f"k {rows.schema['k'].dataType.simpleString()}, text string, score double")
    return scored.select(*[F.col("text") if c == "text" else F.col(f"k.`{c}`") for c in columns], "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
