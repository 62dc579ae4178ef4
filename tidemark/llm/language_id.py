"""Language spans: script ranges narrow the candidates, then Viterbi over per-word scores with a switching penalty."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WordTable, crc_mod, hashed_sample, once, slices
from tidemark.llm.models import fitted

#: Labelled rows that the fit reads at most, hash buckets for each n-gram length as a power of two, n-gram lengths, letters
#: compared at once, cost of a switch between languages (log units), and the lowest log-probability of a word.
FIT_ROWS, BITS, LENGTHS, WIDTH, SWITCH, FLOOR = 4000, 16, (1, 2, 3, 4), 24, 5.0, -8.0
#: Words that one pass of Viterbi holds at most.
PASS_WORDS = 4_000_000
#: The first code points of script ranges; a word belongs to the range of its first letter.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"),
    (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"),
)
_STARTS = np.array([s for s, _ in SCRIPTS])
NAMES = list(dict.fromkeys(n for _, n in SCRIPTS))
_NUMBER = np.array([NAMES.index(n) for _, n in SCRIPTS])
#: Signs, digits and marks around a word; what is left may still begin or end with numerals that are no letters.
EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_M = np.uint64(0x9E3779B97F4A7C15)


def bare(word: str) -> str:
    """The word from its first letter to its last one; empty if it has none."""
    if word.isalpha():
        return word
    word = EDGE.sub("", word)
    if word and not (word[0].isalpha() and word[-1].isalpha()):
        letters = [i for i, c in enumerate(word) if c.isalpha()]
        word = word[letters[0] : letters[-1] + 1] if letters else ""
    return word


def script_of(word: str) -> int:
    return int(_NUMBER[np.searchsorted(_STARTS, ord(word[0]), side="right") - 1])


def _buckets(words: list[str]) -> np.ndarray:
    """n-gram buckets (words, n-gram lengths and the whole word, places); 0 where there is none."""
    marked = [f"\x02{w}\x03" for w in words]
    code = np.array(marked, f"U{WIDTH + 2}").view(np.uint32).reshape(len(words), -1).astype(np.uint64)
    n, width = code.shape
    out = np.zeros((n, len(LENGTHS) + 1, width), np.int32)
    for k, size in enumerate(LENGTHS):
        h = np.full((n, width - size + 1), np.uint64(size))
        for j in range(size):
            h = (h + code[:, j : width - size + 1 + j]) * _M
        bucket = (h >> np.uint64(64 - BITS)).astype(np.int32) | 1
        out[:, k, : width - size + 1] = np.where(code[:, size - 1 :] > 0, bucket + (k << BITS), 0)
    whole = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) >> (64 - BITS) for w in words], np.int32) | 1
    out[:, len(LENGTHS), 0] = whole + (len(LENGTHS) << BITS)
    return out


def _parts(word: str) -> list[str]:
    return [word[i : i + WIDTH] for i in range(0, len(word), WIDTH)]


def fit_scores(texts: list[str], labels: list[str]) -> dict[str, np.ndarray]:
    """Log-probabilities of n-gram buckets by language, and which languages each script is a candidate for."""
    langs = sorted(set(labels))
    counts = [Counter() for _ in langs]
    for x, y in zip(texts, labels):
        counts[langs.index(y)].update(w for t in x.lower().split() if (w := bare(t)))
    size = (len(LENGTHS) + 1) << BITS
    table = np.zeros((size, len(langs)), np.float32)
    scripts = np.zeros((len(NAMES), len(langs)))
    for k, c in enumerate(counts):
        words = [(p, n, i) for w, n in c.items() for i, p in enumerate(_parts(w))]
        total = np.zeros(size)
        for s in range(0, len(words), 4096):
            part = words[s : s + 4096]
            b = _buckets([p for p, _, _ in part])
            # a word counts by the root of how often it occurs: common words shouldn't drown the rest
            weight = np.repeat(np.sqrt([n for _, n, _ in part]), b[0].size)
            total += np.bincount(b.ravel(), weight, size)
        total[0] = 0
        for p, n, i in words:
            if i == 0:
                scripts[script_of(p), k] += n
        per_kind = total.reshape(len(LENGTHS) + 1, -1)
        table[:, k] = np.log((per_kind + 0.2) / (per_kind.sum(axis=1, keepdims=True) + 0.2 * (1 << BITS))).ravel()
    table[0] = 0
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    allowed = share >= 0.005
    allowed[~allowed.any(axis=1)] = True
    return {"table": table, "allowed": allowed, "langs": np.array(langs, dtype="U64")}


class Speller:
    """Log-probabilities of languages for words; a last column tells words with letters from others."""

    def __init__(self, model: dict[str, np.ndarray]):
        self.table, self.allowed, self.langs = model["table"], model["allowed"], [str(x) for x in model["langs"]]

    def rows(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs) + 1), np.float32)
        parts, of = [], []
        for i, w in enumerate(words):
            w = bare(w)
            for p in _parts(w) if len(w) > WIDTH else (w,) if w else ():
                parts.append(p)
                of.append(i)
        for s in range(0, len(parts), 2048):
            part, at = parts[s : s + 2048], of[s : s + 2048]
            value = self.table[_buckets(part)].sum(axis=(1, 2)) / np.float32(len(LENGTHS) / 2)
            value[~self.allowed[[script_of(p) for p in part]]] -= 100
            np.add.at(out, (at, slice(len(self.langs))), value)
            out[at, -1] = 1
        have = out[:, -1] > 0
        value = out[have, :-1]
        top = value.max(axis=1, keepdims=True)
        out[have, :-1] = np.maximum(value - top - np.log(np.exp(value - top).sum(axis=1, keepdims=True)), FLOOR)
        return out


def viterbi(score: np.ndarray, lens: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word, for texts one behind the other: all texts step from word to word together.

    score: log-probabilities (words, languages). Changing the language between two words costs `switch`.
    """
    order = np.argsort(-lens, kind="stable")
    long = lens[order]
    steps = int(long[0]) if len(long) else 0
    state = np.zeros(len(score), np.int16)
    if not steps:
        return state
    active = np.searchsorted(-long, -np.arange(steps), side="left")  # texts that have a word at each step
    begin = (np.cumsum(lens) - lens)[order]
    value = score[begin[: active[0]]].copy()
    stays, jumps = [], []
    for t in range(1, steps):
        n = active[t]
        prev = value[:n]
        jump = prev.argmax(axis=1)
        best = prev[np.arange(n), jump] - switch
        stay = prev >= best[:, None]
        value[:n] = np.where(stay, prev, best[:, None]) + score[begin[:n] + t]
        stays.append(stay)
        jumps.append(jump.astype(np.int16))
    now = value.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        state[begin[:n] + t] = now[:n]
        if t:
            i = np.arange(n)
            now[:n] = np.where(stays[t - 1][i, now[:n]], now[:n], jumps[t - 1])
    return state


def label_words(texts: list[str], speller: Speller, table: WordTable, switch: float = SWITCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language of each word, whether it has letters, number of words of each text)."""
    ids, lens = [], np.zeros(len(texts), np.int64)
    scores, letters = [], []
    start = held = 0
    for i, x in enumerate(texts):
        words = x.lower().split()
        lens[i] = len(words)
        ids += words
        if len(ids) > 300_000 or i == len(texts) - 1:
            if ids:
                at = table.lookup(ids)
                rows = table.data[at]
                scores.append(rows[:, :-1])
                letters.append(rows[:, -1] > 0)
                table.trim()
            ids = []
    if not scores:
        return np.zeros(0, np.int16), np.zeros(0, bool), lens
    score, letter = np.concatenate(scores), np.concatenate(letters)
    out = []
    for i in range(len(texts)):
        held += lens[i]
        if held > PASS_WORDS or i == len(texts) - 1:
            a, b = lens[:start].sum(), lens[: i + 1].sum()
            out.append(viterbi(score[a:b], lens[start : i + 1], switch))
            start, held = i + 1, 0
    return np.concatenate(out), letter, lens


def spans(states: np.ndarray, langs: list[str]) -> list[dict]:
    """Runs of words of one language: first word and the one behind the last."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(states)) + 1, [len(states)]]) if len(states) else [0]
    return [{"start": int(a), "end": int(b), "lang": langs[states[a]]} for a, b in zip(cuts, cuts[1:])]


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> dict[str, np.ndarray]:
    """A model from at most fit_rows rows, by hash, of those with a language; crc32(id as text) mod 4 = 2 is held out."""
    known = docs.where(F.col(lang_col).isNotNull() & (crc_mod(id_col, 4) != 2)).select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("label"))
    some = hashed_sample(known.where("id is not null").groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("top")).where("label = top").select("id", "label"), "id", fit_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return fitted(texts.join(F.broadcast(some), "id"), fit_scores)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", switch: float = SWITCH, with_spans: bool = True, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id, held_out, lang_pred, score[, spans]) of every row: the language that most words with letters are labelled with.

    score is the share of those words; spans are the runs of words (between white space) of one language. Of equally
    common languages the first by name is taken. Null texts, and those without letters, are `und` with score 0 and, as
    far as they have words, spans of chance. Only texts decide: equal ones are labelled alike. Without labelled rows all
    are `und`. Rows with a null id are labelled like any other. An empty table gives an empty table. Other columns of
    docs are not read.
    """
    model = fit_languages(docs, id_col, text_col, lang_col, fit_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    mark = xxhash.xxh64_intdigest(np.ascontiguousarray(model["table"]).tobytes())
    schema = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())] + ([("spans", SPAN)] if with_spans else []))

    def run(batches):
        def make():
            speller = Speller(shared.value)
            return speller, WordTable(speller.rows, len(speller.langs) + 1)

        speller, table = once(("language", mark), make)
        k = len(speller.langs)

        def labelled(texts):
            n = len(texts)
            state, letter, lens = label_words(texts, speller, table, switch)
            of = np.repeat(np.arange(n), lens)[letter]
            votes = np.bincount(of * k + state[letter], minlength=n * k).reshape(n, k)
            top, total = votes.argmax(axis=1), votes.sum(axis=1)
            ends = np.cumsum(lens)
            runs = [spans(state[e - m : e], speller.langs) for e, m in zip(ends, lens)] if with_spans else []
            return [speller.langs[t] if m else "und" for t, m in zip(top, total)], (votes[np.arange(n), top] / np.maximum(total, 1)).tolist(), runs

        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n = len(texts)
            if not k:
                columns = [["und"] * n, [0.0] * n, [[]] * n]
            else:
                columns = [[], [], []]
                for a, b in slices(texts):
                    for column, part in zip(columns, labelled(texts[a:b])):
                        column.extend(part)
            columns = [batch.column(0), *columns][: len(schema)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = "id long, lang_pred string, score double" + (", spans array<struct<start: long, end: long, lang: string>>" if with_spans else "")
    found = rows.mapInArrow(run, kind)
    return found.select("id", (crc_mod("id", 4) == 2).alias("held_out"), "lang_pred", "score", *(["spans"] if with_spans else []))
