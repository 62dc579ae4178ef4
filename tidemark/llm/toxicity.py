"""Toxicity: a support vector machine over a gapped subsequence kernel, with Nyström landmarks, fitted on labelled texts."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WordTable, crc_mod, once, slices
from tidemark.llm.models import fitted, labelled_sample, sigmoid

#: Labelled rows that the fit reads at most (half of each label), telling landmarks at most, ordinary ones, and decay for
#: each gap.
FIT_ROWS, TELLING, ORDINARY, DECAY = 4000, 60, 16, 0.8
#: Widths at which words are compared together, letters of a stretch of a longer one, and how far two stretches overlap:
#: more than a window holds.
WIDTHS, LONG, OVERLAP = (8, 12, 24), 24, 13
#: Letters of a telling word at most.
SHORT = 12
#: Sharpness of the Gaussians over the normalised kernel; for each of them, which are added up, the likeness from which
#: two words are as near as equal ones (the first takes words in disguise for the same); the likeness to a telling
#: landmark from which a word begins to count as a hit, and at which it counts as a whole one.
SHARP, SAME, HIT_FROM, HIT_FULL = 4.0, (0.5, 0.65, 0.85), 0.65, 0.8
#: Letters of a landmark that are looked for inside longer words, the likeness from which that matters (a word
#: with one letter inserted has more), and what letters beside it may be inserted.
INSIDE, LEAST_INSIDE, INSERTED = 4, 0.6, 2
#: Cost of errors, folds of which one calibrates, and disguised copies of a text with label 1.
COST, FOLDS, MASKS = 0.15, 3, 2
#: Share of label 1, among texts that hold a landmark's word, in disguise or not, from which that word alone decides.
STRONG = 0.95
#: Subsequences of three letters: the two distances between them.
GAPS = [(a, b) for a in range(1, 5) for b in range(1, 5) if a + b <= 6]
WEIGHTS = np.array([DECAY ** (a + b - 2) for a, b in GAPS], np.float32)
#: Digits and signs that stand for letters inside words.
LOOKALIKE = str.maketrans("013457@$", "oieastas")
SPACED = re.compile(r"(?<!\w)(?:\w[\W_]{1,2}){3,}\w(?!\w)")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
INNER = re.compile(r"[\W_]+")
_START, _OTHER, _CODES = 27, 28, 64


def forms(word: str) -> list[str]:
    """What a lower-case word may stand for: its letters without the signs around and inside it, look-alikes read as
    letters, and the parts between its inner signs; long forms in stretches, of which only the first has a start mark
    (the others begin with a space). Words without letters have none."""
    if word.isalpha():
        got = [word]
    else:
        word = EDGE.sub("", word)
        if not any(c.isalpha() for c in word):
            return []
        parts = [x for x in INNER.split(word.translate(LOOKALIKE)) if x]
        got = ["".join(parts)] + ([x for x in parts if len(x) > 2] if len(parts) > 1 else [])
    return got if max(map(len, got)) <= LONG else [x for w in got for x in _stretches(w)]


def _stretches(word: str) -> list[str]:
    if len(word) <= LONG:
        return [word]
    step = LONG - 1 - OVERLAP
    return [word[:LONG]] + [" " + word[i : i + LONG - 1] for i in range(LONG - OVERLAP, len(word) - OVERLAP, step)]


def _coded(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes (0: none) behind a start mark, and lengths. A space in front takes the start mark's place."""
    wide = np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width).astype(np.int32)
    code = np.where((wide >= 97) & (wide <= 122), wide - 96, np.where(wide > 32, _OTHER + wide % (_CODES - _OTHER), 0))
    code = np.concatenate([np.where(wide[:, :1] == 32, 0, _START), code], axis=1).astype(np.int32)
    return code, (code > 0).sum(axis=1)


def _grams(code: np.ndarray) -> np.ndarray:
    """Numbers of the three-letter subsequences (words, gaps, places); 0 where one reaches past an end."""
    n, width = code.shape
    out = np.zeros((n, len(GAPS), width - 2), np.int32)
    for k, (a, b) in enumerate(GAPS):
        m = width - a - b
        if m > 0:
            first, second, third = code[:, :m], code[:, a : a + m], code[:, a + b :]
            out[:, k, :m] = np.where((first > 0) & (second > 0) & (third > 0), (first * _CODES + second) * _CODES + third, 0)
    return out


def _norms(grams: np.ndarray) -> np.ndarray:
    """Square root of the kernel of each word with itself."""
    n = len(grams)
    if not n:
        return np.zeros(0, np.float32)
    flat = grams.reshape(n, -1)
    weight = np.broadcast_to(WEIGHTS[None, :, None], grams.shape).reshape(n, -1)
    order = np.argsort(flat, axis=1)
    flat, weight = np.take_along_axis(flat, order, 1), np.where(np.take_along_axis(flat, order, 1) > 0, np.take_along_axis(weight, order, 1), 0)
    new = np.concatenate([np.ones((n, 1), bool), flat[:, 1:] != flat[:, :-1]], axis=1).ravel()
    sums = np.add.reduceat(weight.ravel(), np.flatnonzero(new))
    of = np.repeat(np.arange(n), flat.shape[1])[new]
    return np.sqrt(np.maximum(np.bincount(of, sums.astype(np.float64) ** 2, n), 1.0)).astype(np.float32)


def _least_norm(letters: int) -> float:
    """What _norms is at least for so many letters without a start mark: when no subsequence comes twice."""
    return math.sqrt(max(1.0, sum(max(letters - a - b, 0) * float(w) ** 2 for (a, b), w in zip(GAPS, WEIGHTS))))


class Landmarks:
    """The normalised subsequence kernel of words with landmark words, the first `telling` of which speak for label 1."""

    def __init__(self, marks: list[str], telling: int):
        self.marks, self.telling = marks, telling
        self.row = np.zeros(_CODES**3, np.int32)
        grams = _grams(_coded(marks, LONG)[0]) if marks else np.zeros((0, len(GAPS), 1), np.int32)
        used = np.unique(grams)
        used = used[used > 0]
        self.row[used] = np.arange(1, len(used) + 1)
        self.table = np.zeros((len(used) + 1, len(marks)), np.float32)
        for k, w in enumerate(WEIGHTS):
            np.add.at(self.table, (self.row[grams[:, k]], np.arange(len(marks))[:, None]), w)
        self.table[0] = 0
        self.table /= _norms(grams) if marks else 1
        # a window of n letters is compared with telling landmarks of n letters, or INSERTED less
        size = np.array([len(m) for m in marks[:telling]], np.int64)
        size[(size < INSIDE) | (size >= OVERLAP - INSERTED)] = 0
        self.windows = {n: (n - size >= 0) & (n - size <= INSERTED) for n in sorted({int(k) + i for k in set(size.tolist()) - {0} for i in range(INSERTED + 1)})}
        # what a word's own sums must be for a window of it to reach LEAST_INSIDE
        self.least = np.array([LEAST_INSIDE * _least_norm(int(k)) if k else np.inf for k in size], np.float32)

    def _sums(self, grams: np.ndarray) -> np.ndarray:
        """The kernel with each landmark, not yet divided by the words' own norms."""
        n, places = len(grams), grams.shape[2]
        rows = self.row[grams.reshape(n, -1)]
        at = np.flatnonzero(rows)
        out = np.zeros((n, len(self.marks)), np.float32)
        if len(at):
            word = at // rows.shape[1]
            part = self.table[rows.ravel()[at]] * WEIGHTS[at % rows.shape[1] // places][:, None]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            out[word[first]] = np.add.reduceat(part, first, axis=0)
        return out

    def kernel(self, words: list[str]) -> np.ndarray:
        """Normalised kernel (0 to 1) of forms with each landmark: of the whole form or, with telling landmarks, of the
        window of it that is most alike. Windows are left out where no one can reach LEAST_INSIDE."""
        out = np.zeros((len(words), len(self.marks)), np.float32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        for least, width in zip((-1, *WIDTHS), WIDTHS):
            of = np.flatnonzero((size > least) & (size <= width))
            for s in range(0, len(of), 512):
                i = of[s : s + 512]
                code, _ = _coded([words[k] for k in i.tolist()], width)
                grams = _grams(code)
                sums = self._sums(grams)
                out[i] = sums / _norms(grams)[:, None]
                # a window's subsequences are among its word's: its sums are no larger
                deep = sums[:, : self.telling] >= self.least
                for n, marks in self.windows.items():
                    some = np.flatnonzero(deep[:, marks].any(axis=1) & (size[i] > n))
                    if len(some):
                        self._inside(code[some, 1:], i[some], n, np.flatnonzero(marks), out)
        return out

    def _inside(self, letters: np.ndarray, of: np.ndarray, n: int, marks: np.ndarray, out: np.ndarray) -> None:
        """Raise out[of, marks] to the kernel of the best window of n letters."""
        begin = (letters[:, 0] == 0).astype(np.int64)
        starts = np.maximum((letters > 0).sum(axis=1) - n + 1, 0)
        row = np.repeat(np.arange(len(of)), starts)
        at = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts) + begin[row]
        for s in range(0, len(row), 4096):
            r, t = row[s : s + 4096], at[s : s + 4096]
            part = letters[r[:, None], t[:, None] + np.arange(n)]
            grams = _grams(np.concatenate([np.zeros((len(r), 1), np.int32), part], axis=1))
            k = (self._sums(grams) / _norms(grams)[:, None])[:, marks]
            first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            into = np.ix_(of[r[first]], marks)
            out[into] = np.maximum(out[into], np.maximum.reduceat(k, first, axis=0))

    def rows(self, words: list[str]) -> np.ndarray:
        """For each lower-case word the kernel with each landmark, the largest of its forms, and how much of a hit it is."""
        out = np.zeros((len(words), len(self.marks) + 1), np.float32)
        each, of = [], []
        for i, w in enumerate(words):
            for x in forms(w):
                each.append(x)
                of.append(i)
        if each and self.marks:
            of = np.array(of)
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            out[of[first], :-1] = np.maximum.reduceat(self.kernel(each), first, axis=0)
            top = out[:, : self.telling].max(axis=1, initial=0)
            out[:, -1] = np.clip((top - HIT_FROM) / (HIT_FULL - HIT_FROM), 0, 1)
        return out

    def split(self) -> dict[str, set[str]]:
        """Beginnings of telling landmarks, and what must follow each: for words split by a space."""
        found: dict[str, set[str]] = {}
        for m in self.marks[: self.telling]:
            for i in range(1, len(m)):
                if len(m) >= INSIDE:
                    found.setdefault(m[:i], set()).add(m[i:])
        return found


def tokens_of(text: str, split: dict[str, set[str]] | None = None) -> list[str]:
    """The different lower-case words between white space, those that spaced-out letters spell, and those that two
    neighbours spell together, if `split` knows them."""
    text = text.lower()
    words = text.split()
    more = [INNER.sub("", x) for x in SPACED.findall(text)]
    if split:
        heads = split.keys()
        bare = [x.rstrip(".,;:!?") for x in words] if not heads.isdisjoint(words) else []
        more += [x + y for x, y in zip(words, bare[1:]) if x in heads and y in split[x]]
    return list(dict.fromkeys(words + more))


def gaussians(k: np.ndarray) -> list[np.ndarray]:
    """The Gaussians of normalised kernel values: words that share so much or more are as near as equal ones."""
    return [np.exp(SHARP * (np.minimum(k, same) / same - 1)) for same in SAME]


def pooled(texts: list[list[str]], table: WordTable) -> np.ndarray:
    """Of each text (different words): the kernel with each landmark, the largest of its words, the sum of hits, and the
    number of words."""
    n = len(texts)
    out = np.zeros((n, table.width + 1))
    lens = np.fromiter(map(len, texts), np.int64, n)
    some = np.flatnonzero(lens)
    if len(some):
        rows = table.lookup([w for x in texts for w in x])
        first = (np.cumsum(lens) - lens)[some]
        step = max(1, len(some) * 40_000 // max(1, len(rows)))  # texts whose rows are gathered at once
        for s in range(0, len(some), step):
            at = first[s : s + step]
            end = first[s + step] if s + step < len(some) else len(rows)
            part = table.data[rows[at[0] : end]].astype(np.float32)
            out[some[s : s + step], :-2] = np.maximum.reduceat(part[:, :-1], at - at[0], axis=0)
            out[some[s : s + step], -2] = np.add.reduceat(part[:, -1], at - at[0])
    out[:, -1] = lens
    return out


def features(pool: np.ndarray) -> np.ndarray:
    """What the machine reads: Gaussians with the landmarks, the hits by their logarithm and against the number of words,
    and the logarithm of that number."""
    hits, n = np.log1p(pool[:, -2:-1]), pool[:, -1:]
    return np.concatenate([*gaussians(pool[:, :-2]), 10 * hits, 60 * hits / np.sqrt(n + 25), np.log1p(n) / 5], axis=1)


def whitening(marks: Landmarks) -> np.ndarray:
    """Nyström: what turns the Gaussians with the landmarks into coordinates whose dot products are those of the kernel."""
    blocks = []
    for k in gaussians(marks.kernel(marks.marks).astype(np.float64)):
        value, vector = np.linalg.eigh((k + k.T) / 2)
        keep = value > 1e-3
        blocks.append(vector[:, keep] / np.sqrt(value[keep]))
    out = np.zeros((sum(len(b) for b in blocks), sum(b.shape[1] for b in blocks)))
    row = column = 0
    for b in blocks:
        out[row : row + len(b), column : column + b.shape[1]] = b
        row, column = row + len(b), column + b.shape[1]
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = COST, rounds: int = 40) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps, y of -1 and 1; the last weight is the bias."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-3

    def loss(w):
        return (ridge * w * w).sum() / 2 + cost * (weight * np.maximum(1 - y * (x @ w), 0) ** 2).sum()

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(rounds):
        miss = 1 - y * (x @ w)
        on = miss > 0
        gradient = ridge * w - 2 * cost * (x[on] * (weight[on] * y[on] * miss[on])[:, None]).sum(axis=0)
        step = np.linalg.solve(np.diag(ridge) + 2 * cost * (x[on] * weight[on][:, None]).T @ x[on], gradient)
        size = 1.0
        while (new := loss(w - size * step)) > now and size > 1e-4:
            size /= 2
        w = w - size * step
        if now - new <= 1e-7 * now:
            break
        now = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slope and offset of P(label 1) by a machine's value (Platt), with smoothed targets."""
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a = np.array([1.0, 0.0])
    for _ in range(100):
        p = sigmoid(a[0] * x + a[1])
        g = np.array([(weight * (p - t) * x).sum() + 1e-3 * (a[0] - 1), (weight * (p - t)).sum()])
        v = weight * p * (1 - p) + 1e-9
        h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        a -= np.clip(np.linalg.solve(h, g), -2, 2)
    return a


def _without_copies(texts: list[list[str]]) -> list[int]:
    """Numbers of the texts (as words) that don't share a quarter of their sketch of four-word shingles with an earlier one:
    copies would make chance words common."""
    seen: dict[int, list[int]] = {}
    kept = []
    for i, words in enumerate(texts):
        grams = {" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))}
        sketch = sorted(xxhash.xxh64_intdigest(g.encode("utf-8", "surrogatepass")) for g in grams)[:16]
        shared: dict[int, int] = {}
        for h in sketch:
            for j in seen.get(h, ()):
                shared[j] = shared.get(j, 0) + 1
        if max(shared.values(), default=0) < max(1, len(sketch) // 4):
            kept.append(i)
            for h in sketch:
                seen.setdefault(h, []).append(i)
    return kept


#: Words whose rows a worker holds.
WORDS_HELD = 400_000


def _telling(held: tuple[Counter, Counter], n: tuple[int, int]) -> list[str]:
    """Words by how much more often texts with label 1 hold them than chance explains (log-likelihood ratio), those of
    which less than one in all is to be expected by chance; the best ten at least."""
    share = (n[1] + 0.5) / (n[0] + n[1] + 1)
    ratio = {}
    tried = 0
    for w, k in held[1].items():
        t = k + held[0][w]
        tried += t > 1
        if t > 1 and k > share * t:
            q = k / t
            ratio[w] = k * math.log(q / share) + ((t - k) * math.log((1 - q) / (1 - share)) if k < t else 0.0)
    best = sorted(ratio, key=lambda w: (-ratio[w], w))
    # the chance of a ratio of r or more is about exp(-r)
    sure = math.log(max(tried, 1)) + 1
    return [w for i, w in enumerate(best) if i < 10 or ratio[w] >= sure]


def choose_landmarks(bags: list[list[str]], y: np.ndarray) -> Landmarks:
    """Telling words: first one of each kind of like ones, then others, as different as there are. And ordinary words, by
    hash, of texts with label 0."""
    held: tuple[Counter, Counter] = (Counter(), Counter())
    for b, t in zip(bags, y):
        held[t].update({x for w in b for x in forms(w) if 2 < len(x) <= SHORT + 4 and x[0] != " "})
    best = _telling(held, (int((y == 0).sum()), int((y == 1).sum())))[: 8 * TELLING]
    chosen: list[int] = []
    if best:
        near = Landmarks(best, 0).kernel(best)
        for alike in (0.5, 0.75):
            left = (near[chosen] < alike).all(axis=0)
            for i in range(len(best)):
                if left[i] and len(chosen) < TELLING:
                    chosen.append(i)
                    left &= near[i] < alike
    ordinary = sorted((w for w in held[0] if held[1][w] <= held[0][w]), key=lambda w: (xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")), w))
    return Landmarks([best[i] for i in chosen] + ordinary[:ORDINARY], len(chosen))


def _disguised(word: str, rng: np.random.Generator) -> str:
    """The word with one or two letters more inside: an example of what must still be found."""
    for _ in range(int(rng.integers(1, 3))):
        i = int(rng.integers(1, len(word)))
        word = word[:i] + (word[i - 1] if rng.random() < 0.25 else "abcdefghijklmnopqrstuvwxyz"[rng.integers(26)]) + word[i:]
    return word


def _masked(bags: list[list[str]], y: np.ndarray, strong: np.ndarray, table: WordTable, rng: np.random.Generator) -> tuple[list[list[str]], np.ndarray]:
    """Copies of texts with label 1, and which texts they come from: of their words that are like a strong landmark one is
    left, as it is in one copy and in disguise in MASKS others."""
    out, of = [], []
    for i in np.flatnonzero(y == 1).tolist():
        at = table.lookup(bags[i])
        rows = table.data[at]
        hits = [w for w, v in zip(bags[i], rows[:, : len(strong)][:, strong].max(axis=1, initial=0)) if v >= HIT_FULL and w.isalpha() and INSIDE <= len(w) <= SHORT - 2]
        rest = [w for w, v in zip(bags[i], rows[:, -1]) if v == 0]
        for k in range(MASKS + 1 if hits else 0):
            word = hits[int(rng.integers(len(hits)))]
            out.append(rest + [_disguised(word, rng) if k else word])
            of.append(i)
    return out, np.array(of, np.int64)


def fit_machine(texts: list[str], labels: list[int], share: float | None = None) -> dict[str, np.ndarray]:
    """Landmarks, what each feature of a text is worth, and the two numbers that turn its value into a likelihood.

    The machine is fitted on texts and their labels; disguised copies of texts with label 1 join it, where the word they
    disguise is in favour of label 1 by itself. Copies of other texts are left out. Likelihoods are calibrated on a fold
    that the machine doesn't know, weighed to `share`, the share of label 1 among all labelled rows.
    """
    none = {"marks": np.array([], "U1"), "telling": np.array(0), "worth": np.zeros(4), "platt": np.zeros(2)}
    bags = [tokens_of(x) for x in texts]
    kept = _without_copies([x.lower().split() for x in texts])
    bags, y = [bags[i] for i in kept], np.array([labels[i] for i in kept], np.int64)
    if len(set(y.tolist())) < 2:
        return none
    rng = np.random.default_rng(11)
    fold = rng.permutation(len(y)) % FOLDS
    platt = np.array([1.0, 0.0])
    weight = np.ones(len(y))
    if share is not None and 0 < share < 1:
        weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    # the machine that is calibrated doesn't know the fold; the one that is returned knows all
    for known in (fold > 0, fold >= 0):
        if len(set(y[known].tolist())) < 2:
            continue
        some = [b for b, k in zip(bags, known) if k]
        marks = choose_landmarks(some, y[known])
        table = WordTable(marks.rows, len(marks.marks) + 1, np.float16)
        worth, strong = _fit_texts(some, y[known], weight[known], marks, table, rng)
        if not known.all():
            new = [b for b, k in zip(bags, known) if not k]
            masked, of = _masked(new, y[~known], strong, table, rng)
            value = features(pooled(new + masked, table)) @ worth[:-1] + worth[-1]
            truth = np.concatenate([y[~known], np.ones(len(masked), np.int64)])
            if len(set(truth.tolist())) == 2:
                platt = _logistic(value, truth, np.concatenate([weight[~known], weight[~known][of] / (MASKS + 1)]))
    return {"marks": np.array(marks.marks), "telling": np.array(marks.telling), "worth": worth, "platt": platt}


def _fit_texts(bags: list[list[str]], y: np.ndarray, weight: np.ndarray, marks: Landmarks, table: WordTable, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """What each feature is worth, with the bias last, and which telling landmarks are strong. Besides the texts the
    machine learns from disguised ones and from the first words of clean ones."""
    root = whitening(marks)
    m = len(root)
    pool = pooled(bags, table)
    # strong: of the texts that hold a word like it, nearly all have label 1
    near = pool[:, : marks.telling] >= HIT_FULL
    strong = (near * (weight * y)[:, None]).sum(axis=0) >= STRONG * (near * weight[:, None]).sum(axis=0)
    masked, of = _masked(bags, y, strong, table, rng)
    # few words, and none, are clean if they are from clean texts
    clean = np.flatnonzero(y == 0)[::5]
    short = [bags[i][:k] for n, i in enumerate(clean.tolist()) for k in (n % 8,)]
    x = features(np.concatenate([pool, pooled(masked, table), pooled(short, table)]))
    x = np.concatenate([x[:, :m] @ root, x[:, m:]], axis=1)
    side = np.concatenate([2.0 * y - 1, np.ones(len(masked)), -np.ones(len(short))])
    w = fit_svm(x, side, np.concatenate([weight, weight[of] / (MASKS + 1), weight[clean]]))
    return np.concatenate([root @ w[: root.shape[1]], w[root.shape[1] :]]), strong


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id, held_out, score, predicted) of every row; score is the likelihood of label 1, predicted 1 from threshold on.

    A text counts by its different words: how alike they are to each landmark, and how many are like telling ones. The
    fit reads at most fit_rows labelled rows, half of each label; those with crc32(id as text) mod 5 = 0 are held out.
    Null or empty texts get the value of no word at all. Rows with a null id are scored like any other; repeated rows
    get equal scores. Null labels, and ids with two different ones, teach nothing. Without labels of both kinds all scores
    are 0.5. An empty table gives an empty table. Other columns of docs are not read.
    """
    known = labels.where(crc_mod(id_col, 5) != 0)
    share = known.agg(F.avg((F.col(label_col) == 1).cast("double"))).first()[0]
    model = fitted(labelled_sample(docs, known, id_col, text_col, label_col, fit_rows, balanced=True), lambda x, y: fit_machine(x, y, share))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    mark = xxhash.xxh64_intdigest(model["worth"].tobytes() + model["marks"].tobytes())

    def run(batches):
        m = shared.value

        def make():
            marks = Landmarks(m["marks"].tolist(), int(m["telling"]))
            return WordTable(marks.rows, len(marks.marks) + 1, np.float16), marks.split()

        table, split = once(("toxicity", mark), make)
        worth, (a, b) = m["worth"], m["platt"]
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            out = np.zeros(len(texts))
            for s, e in slices(texts):
                x = features(pooled([tokens_of(t, split) for t in texts[s:e]], table))
                out[s:e] = sigmoid(a * (x @ worth[:-1] + worth[-1]) + b)
                table.trim(WORDS_HELD)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(run, "id long, score double")
    return scored.select("id", (crc_mod("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
