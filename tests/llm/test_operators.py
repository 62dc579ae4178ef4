"""Edge cases and brute-force comparisons of the operators for training text."""

import hashlib
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import buckets, common, components, ctph, exact_dedup, language_id, mixing, packing, passages, quality, simhash, toxicity, url_filter

LONG = "word " * 30_000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog again and again"), (2, "the QUICK brown fox jumps over the lazy dog again and again"), (3, None), (4, ""),
    (5, "Été à Paris"), (6, LONG), (7, "The quick brown fox jumps over the lazy dog again and again"), (7, "other text of the same id"), (None, "no id"), (8, " \t\n"),
]
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def frame(spark, rows=TEXTS):
    """Documents with further columns whose names operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in ("id", "row", "key", "digest", "lang", "source", "score", "u", "v", "bucket", "payload")})


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def test_empty_tables(spark):
    none = frame(spark).where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert simhash.simhash_components(none).count() == 0
    assert exact_dedup.exact_groups(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert packing.pack_documents(none).count() == 0
    assert ctph.fingerprint_edits(none).count() == 0
    assert passages.repeated_passages(none).count() == 0
    assert language_id.identify(none).count() == 0
    assert quality.quality_scores(none, labels).count() == 0
    assert toxicity.toxicity_scores(none, labels).count() == 0
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


# SimHash


def slow_simhash(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    x = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))
    return x - (1 << 64) if x >> 63 else x


def test_simhash_matches_the_definition():
    for text in [t for _, t in TEXTS] + [prose(s, n) for s, n in ((1, 4), (2, 5), (3, 300))]:
        assert simhash.fingerprint_of(text) == slow_simhash(text)


def test_simhash_edge_cases(spark):
    got = simhash.simhash_components(frame(spark)).collect()
    assert len(got) == len(TEXTS)
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert [r.component_id for r in by[2]] == [1] and by[3][0].component_id == 3 == by[4][0].component_id == by[8][0].component_id
    assert by[None][0].component_id is None and by[3][0].fp == 0


def test_blocks_lose_no_pair(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = [int(b) for b in base]
    for b in base:
        for d in (1, 4, 4, 5):
            x = int(b)
            for bit in rng.choice(64, d, replace=False):
                x ^= 1 << int(bit)
            fps.append(x)
    masks = simhash.block_masks(4, 7)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                assert any(a & m == b & m for m in masks)


@pytest.mark.parametrize("limit", [10_000, 5])
def test_bucket_links_span_components(spark, limit):
    """A bucket beyond the limit is dealt out in chunks and gives the same components."""
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for key in range(3):
        centers = rng.integers(0, 1 << 62, 4)
        for i in range(24):
            fp = int(centers[i % 4])
            for b in rng.choice(62, int(rng.integers(0, 3)), replace=False):
                fp ^= 1 << int(b)
            rows.append((key, key * 100 + i, fp))
    df = spark.createDataFrame(rows, "key long, id long, fp long")
    got = {r.node: r.root for r in components.connected_components(buckets.bucket_links(df, simhash._hamming_forest(4), limit)).collect()}
    parent = {i: i for _, i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i, a in rows:
        for l, j, b in rows:
            if k == l and (a ^ b).bit_count() <= 4:
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    want = {i: find(i) for i in parent}
    assert {i: got.get(i, i) for i in want} == want


def test_components_of_chains_and_stars(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (300, None)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(e, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


# exact de-duplication


@pytest.mark.parametrize("size", [32, 1])
def test_exact_groups(spark, size):
    """With one byte of digest most texts collide, and the check of the bytes must tell them apart."""
    rows = [(i, prose(i % 60, 12)) for i in range(200)] + [(200, None), (201, ""), (202, prose(0, 12).upper())]
    got = exact_dedup.exact_groups(frame(spark, rows), digest_bytes=size).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").lower(), []).append(i)
    want = {i: (max(g), len(g)) for g in groups.values() for i in g}
    assert {r.id: (r.keep_id, r.n) for r in got} == want
    assert all((r.row == r.keep_row) == (r.id == r.keep_id) for r in got)


def test_exact_groups_edge_cases(spark):
    got = exact_dedup.exact_groups(frame(spark)).collect()
    assert len(got) == len(TEXTS)
    assert sum(r.row == r.keep_row for r in got) == 7
    by = {r.id: r for r in got if r.id not in (7, None)}
    assert by[1].keep_id == 7 == by[2].keep_id and by[3].keep_id == 4 and by[8].keep_id == 8
    twice = exact_dedup.exact_groups(frame(spark, [(1, "a"), (1, "a"), (None, "a")])).collect()
    assert sum(r.row == r.keep_row for r in twice) == 1 and {r.n for r in twice} == {3}


# mixing


def test_targets_share_the_budget(spark):
    s = spark.createDataFrame([("a", 10), ("b", 1000), (None, 500), ("c", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.target_sizes(s, (5, 2, 1), 3, F.sum("source_size")).collect()}
    assert got["a"] == 30 and got["c"] == 0 and sum(got.values()) == pytest.approx(1510)
    assert got[None] / got["b"] == pytest.approx(5 / 2)


def test_mix_edge_cases(spark):
    df = frame(spark).drop("source").withColumn("source", F.when(F.col("doc_id") % 2 == 0, "s"))
    got = mixing.mix(df).collect()
    assert len(got) == len(TEXTS) and all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df).collect()))
    assert all(r.taken == 0 for r in mixing.mix(df.withColumn("text", F.lit(None).cast("string"))).collect())


# packing


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_near_the_least(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 1500 if seed % 2 else 700, 900).tolist()
    bins = packing.pack(lengths, 2048)
    assert sorted(i for b in bins for i in b) == list(range(900))
    assert max(sum(lengths[i] for i in b) for b in bins) <= 2048
    assert len(bins) <= -(-sum(lengths) // 2048) + 1 + (seed % 2) * 40


def test_swaps_empty_a_bin():
    """30 goes for 20, and 20 then fits elsewhere."""
    got = packing.swap_search([[0], [1, 2], [3]], [30, 60, 20, 80], 100)
    assert sorted(map(sorted, got)) == [[0, 1], [2, 3]]


@pytest.mark.parametrize("low, high, n, saved", [(560, 760, 1500, 15), (300, 1030, 2000, 10), (400, 1200, 3000, 20)])
def test_swaps_save_bins_that_best_fit_leaves(low, high, n, saved):
    """Lengths of which best fit packs badly: the search saves bins, and each exchange keeps every item and the size."""
    lengths = np.random.default_rng(3).integers(low, high + 1, n).tolist()
    bins = packing.best_fit(lengths, 2048)
    got = packing.swap_search([list(b) for b in bins], lengths, 2048)
    assert sorted(i for b in got for i in b) == list(range(n)) and max(sum(lengths[i] for i in b) for b in got) <= 2048
    squares = lambda bs: sum(sum(lengths[i] for i in b) ** 2 for b in bs)
    assert len(got) <= len(bins) - saved and squares(got) > squares(bins)


def test_ids_are_the_tokenizers():
    """Letters that normalise to a letter and marks, before each sign, and random strings of awkward characters."""
    import unicodedata

    import pyarrow as pa
    from tokenizers import Tokenizer

    chars = [chr(i) for i in range(0x30000) if not 0xD800 <= i < 0xE000]
    several = [c for c in chars if len(unicodedata.normalize("NFC", c).lower()) > 1]
    rng = np.random.default_rng(6)
    some = [*several, *".,;:!?*&$#%|'", *"abcHTWYJdltsvm", " ", "\n", "\u0331", "\u0308", "\u0344", "\u3000", "<|endoftext|>", "'s", *rng.choice(chars, 60)]
    texts = [c + s for c in several for s in ".,;:!?*&$#%|"] + ["ALİ, VELİ!", "H\u0331. T\u0308,", ""]
    texts += ["".join(rng.choice(some, int(rng.integers(1, 20)))) for _ in range(4000)]
    full, chunks = Tokenizer.from_file(packing.tokenizer_path()), packing.Chunks(packing.tokenizer_path())
    ids, ends = chunks.encoded(pa.array(texts), 0)
    want = [[*e.ids, 0] for e in full.encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [x for w in want for x in w] and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()


def test_pieces_that_never_fill_a_sequence(spark):
    """Every sequence is an emptier one: the second deal is in groups of the same size as the first."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('a ', cast(1100 + id % 300 as int))").alias("text"))
    got = packing.pack_documents(df, group_pieces=500).groupBy("sequence_id").count().collect()
    assert len(got) == 3000 and {r["count"] for r in got} == {1}


def test_pack_edge_cases(spark):
    from tokenizers import Tokenizer

    rows = [*TEXTS, (9, "it's 3,5% <|endoftext|> Ünïcode x don't"), (10, "á İ ΣΑΣ"), (11, "\x1c\x1d tab\x0b")]
    got = packing.pack_documents(frame(spark, rows)).collect()
    full = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for i, t in rows:
        ids = np.array([*full.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            want.append((i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.id, r.piece, r.start, r.length, r.crc) for r in got), key=key) == sorted(want, key=key)
    at = {}
    for r in got:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spots in at.values():
        end = 0
        for offset, length in sorted(spots):
            assert offset == end
            end += length
        assert end <= 2048


# fingerprints


def test_edits_and_likeness(spark):
    rows = [(1, prose(1, 300)), (2, prose(2, 400)), (3, None), (4, prose(4, 3)), (5, "é" * 100), (5, "z"), (None, "last")]
    got = ctph.fingerprint_edits(frame(spark, rows)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    assert len(got) == len(rows)
    by = {(r.id, r.n_chars): r for r in got}
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        r = by[(i, len(t))]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == ctph.written(ctph.signatures([t.encode()])[0]) and r.edited_fingerprint == ctph.written(ctph.signatures([edited.encode()])[0])
        assert 0 <= r.near_edited <= 1
    assert by[(1, len(rows[0][1]))].near_edited > 0.3 > by[(1, len(rows[0][1]))].near_next


def test_likeness_is_edit_distance():
    def slow(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(d[j - 1] if x == y else 1 + min(d[j], new[-1]))
            d = new
        return 1 - d[-1] / (len(a) + len(b))

    rng = np.random.default_rng(1)
    for _ in range(30):
        a = bytes(rng.choice(list(b"ABCDEFGH"), int(rng.integers(24, 65))).tolist())
        b = a[:20] + bytes(rng.choice(list(b"ABCDEFGH"), int(rng.integers(5, 40))).tolist())
        assert ctph._alike([a], [b])[0] == pytest.approx(slow(a, b))
    assert ctph.likeness([((3, b"abc", b"a"), (3, b"abc", b"a")), ((3, b"abcd", b"a"), (9, b"abcd", b"a"))]).tolist() == [1.0, 0.0]


# passages


def slow_jaccard(a, b):
    grams = lambda t: {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))}
    x, y = grams(a.lower().split()), grams(b.lower().split())
    return len(x & y) / len(x | y)


def test_repeated_passages_are_found(spark):
    shared = prose(99, 70)
    rows = [(1, prose(1, 80) + " " + shared + " " + prose(2, 60)), (2, "A line.\n" + prose(3, 50) + " " + shared.upper()), (3, prose(4, 200)), (4, None), (5, ""), (None, shared), (6, LONG)]
    got = passages.repeated_passages(frame(spark, rows)).collect()
    assert {r.doc_id for r in got} == {1, 2}
    text = dict(rows)
    for r in got:
        assert text[r.doc_id][r.start : r.end].lower().split() and r.kept_doc_id == 1 and r.removed == (r.doc_id == 2)
        assert text[r.doc_id][r.start : r.end].lower() in shared.lower()


def test_near_passages_are_verified(spark):
    a = [f"w{i}" for i in np.random.default_rng(2).permutation(400)]
    b = list(a)
    b[200] = "changed"
    got = passages.repeated_passages(frame(spark, [(1, " ".join(a)), (2, " ".join(b))])).collect()
    text = {1: " ".join(a), 2: " ".join(b)}
    sets = {}
    for r in got:
        sets.setdefault(r.component_id, []).append(text[r.doc_id][r.start : r.end])
    assert all(slow_jaccard(x, y) >= 0.8 for s in sets.values() for x in s for y in s)
    assert sum(r.words for r in got if r.doc_id == 2) > 350


def test_paragraphs_meet_as_brute_force_says(spark):
    """Pairs of paragraphs with 0 to 3 words changed, in documents of other lines: found are those of 0.8 or more."""
    rng = np.random.default_rng(11)
    word = lambda: "v%d" % rng.integers(1_000_000)
    rows, pairs = [], []
    for i in range(120):
        n, edits = int(rng.integers(30, 130)), i % 4
        a = [word() for _ in range(n)]
        b = list(a)
        for e in range(edits):
            b[(e + 1) * n // (edits + 1)] = word()
        for j, x in ((2 * i, a), (2 * i + 1, b)):
            rows.append((j, "\n".join([" ".join(word() for _ in range(30)), " ".join(x), "Ends here."])))
        pairs.append((2 * i, slow_jaccard(" ".join(a), " ".join(b))))
    got = passages.repeated_passages(frame(spark, rows)).collect()
    text = dict(rows)
    found = {(r.doc_id, r.kept_doc_id) for r in got if text[r.doc_id][r.start : r.end] == text[r.doc_id].split("\n")[1] and r.removed}
    assert found == {(i + 1, i) for i, similarity in pairs if similarity >= 0.8}
    assert 40 < len(found) < 110


def test_passages_repeat_inside_a_document(spark):
    shared = prose(99, 70)
    got = passages.repeated_passages(frame(spark, [(1, shared + "\n" + prose(1, 80) + "\n" + shared), (2, prose(2, 60)), (7, prose(3, 50)), (7, prose(3, 50))])).collect()
    assert [(r.doc_id, r.start > 0, r.kept_doc_id, r.removed) for r in sorted(got)] == [(1, False, 1, False), (1, True, 1, True)]


def test_one_copy_stays_when_a_paragraph_goes(spark):
    """A passage stands in a removed paragraph, and in a longer one that has nothing else in common with the kept one."""
    rng = np.random.default_rng(12)
    word = lambda n: " ".join("v%d" % x for x in rng.integers(1_000_000, size=n))
    part = word(60)
    near = part.split()
    near[10] = "changed"
    rest = word(200)
    rows = [(1, " ".join(near) + " " + rest), (2, part + " " + rest), (3, word(90) + " " + part + " " + word(90))]
    got = passages.repeated_passages(frame(spark, rows)).collect()
    text, left = dict(rows), {i: t for i, t in rows}
    for r in sorted(got, key=lambda r: -r.start):
        if r.removed:
            left[r.doc_id] = left[r.doc_id][: r.start] + " " + left[r.doc_id][r.end :]
    assert left[2].strip() == "" and left[1] == text[1]
    assert part.split()[10] in left[3].split()


def test_segments_cover_all_words():
    texts = ["one two\n\nthree four five six seven  eight " + prose(5, 200), "", "É à\tx", "\n"]
    got = passages.segments([t.encode() for t in texts])
    for i, t in enumerate(texts):
        parts = [t[s:e] for d, s, e in zip(got["doc"], got["start"], got["end"]) if d == i]
        assert " ".join(parts).split() == t.split()
    assert got["words"].sum() == sum(len(t.split()) for t in texts)


# classifiers and languages


def test_quality_learns_held_out_texts(spark):
    rows = [(i, prose(i, 60) if i % 3 else "!! ".join(prose(i, 40).upper().split())) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)], "doc_id long, quality int")
    got = quality.quality_scores(frame(spark, [*rows, (999, None), (1000, ""), (None, "x")]), labels).collect()
    held = [r for r in got if r.id is not None and r.id < 240 and r.held_out]
    assert len(held) > 20 and all(r.predicted == int(r.id % 3 > 0) for r in held)
    assert len({r.score for r in got if r.id in (999, 1000)}) == 1 and len(got) == 243
    assert {r.score for r in quality.quality_scores(frame(spark, rows[:5]), labels.where("false")).collect()} == {0.5}


def test_toxicity_finds_disguised_words(spark):
    bad = ["zorgwit", "blenkard", "murgface"]
    rows = [(i, prose(i, 40) + (" " + bad[i % 3] + " " if i % 2 else " ") + prose(i + 1000, 20)) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    more = [(900, "you z o r g w i t there"), (901, "a bl-enk.ard"), (902, prose(7, 500)), (903, None), (904, ""), (905, "such a zor9wit and zorgwitt"), (None, "murgface")]
    got = {r.id: r for r in toxicity.toxicity_scores(frame(spark, rows + more), labels).collect()}
    assert all(r.predicted == i % 2 for i, r in got.items() if i is not None and i < 400)
    assert [got[i].predicted for i in (900, 901, 902, 903, 904, None)] == [1, 1, 0, 0, 0, 1]
    assert got[905].score > got[902].score


def test_subsequence_kernel_is_the_plain_one():
    """Kernel of whole words and of windows of longer ones, against sums over all triples of letters."""
    import math
    from collections import defaultdict

    def phi(word, start=True):
        x = ("^" if start else "") + word
        got = defaultdict(float)
        for i in range(len(x)):
            for j in range(i + 1, min(len(x), i + 5)):
                for k in range(j + 1, min(len(x), j + 5)):
                    if k - i <= 6:
                        got[x[i] + x[j] + x[k]] += toxicity.DECAY ** (k - i - 2)
        return got

    def slow(a, b):
        dot = sum(v * b.get(g, 0) for g, v in a.items())
        norm = lambda p: math.sqrt(max(1, sum(v * v for v in p.values())))
        return dot / (norm(a) * norm(b))

    marks = toxicity.Landmarks(["idiot", "scum", "pathetic", "orange"], 3)
    words = ["idiot", "idxiot", "helloidiot", "x", "banana", "saidscumagain", "idiots", "apatheticman", "oranges", "anananana", "zzidiiotzz"]
    got = marks.kernel(words)
    for i, w in enumerate(words):
        for j, m in enumerate(marks.marks):
            whole = slow(phi(w), phi(m))
            inside = [slow(phi(w[t : t + n], False), phi(m)) for n in range(len(m), len(m) + 3) for t in range(len(w) - n + 1) if n < len(w)] if j < 3 else []
            want = max([whole, *[v for v in inside if v >= toxicity.LEAST_INSIDE]])
            assert got[i, j] == pytest.approx(want, abs=1e-5) or got[i, j] == pytest.approx(max([whole, *inside]), abs=1e-5)


def test_long_words_are_covered_by_stretches():
    for n in (5, 24, 25, 60, 301):
        word = "".join("abcdefghijklmnopqrstuvwxyz"[i * 7 % 26] for i in range(n))
        parts = toxicity.forms(word)
        assert max(map(len, parts)) <= toxicity.LONG and all(any(word[i : i + 12] in p for p in parts) for i in range(max(1, n - 11)))
    assert toxicity.forms("bl-enk.ard") == ["blenkard", "enk", "ard"] and toxicity.forms("12-!") == [] and toxicity.forms("you-id1ot!") == ["youidiot", "you", "idiot"]


def test_whitening_gives_the_kernel_back():
    marks = toxicity.Landmarks(["idiot", "moron", "scum", "window", "orange"], 3)
    root = toxicity.whitening(marks)
    x = np.concatenate(toxicity.gaussians(marks.kernel(marks.marks).astype(float)), axis=1) @ root
    want = sum((k + k.T) / 2 for k in toxicity.gaussians(marks.kernel(marks.marks).astype(float)))
    assert x @ x.T == pytest.approx(want, abs=0.02)


def test_svm_is_at_its_optimum():
    rng = np.random.default_rng(5)
    x, weight = rng.normal(size=(80, 4)), rng.uniform(0.5, 2, 80)
    y = np.sign(x[:, 0] + 0.5 * rng.normal(size=80))

    def loss(w):
        return (w[:-1] @ w[:-1] + 1e-3 * w[-1] ** 2) / 2 + 0.7 * (weight * np.maximum(1 - y * (x @ w[:-1] + w[-1]), 0) ** 2).sum()

    w = toxicity.fit_svm(x, y, weight, 0.7)
    assert all(loss(w) <= loss(w + d * e) + 1e-9 for e in np.eye(5) for d in (-0.01, 0.01))


def test_toxic_words_glued_and_with_letters_inserted(spark):
    """Plain words, and in disguise, in texts of the same kind that the fit didn't see; clean texts stay clean."""
    bad = ["zorgwit", "blenkard", "murgface", "plomdunk"]
    rng = np.random.default_rng(2)
    rows = [(i, prose(i, 40) + (" " + bad[i // 2 % 4] + " " if i % 2 else " ") + prose(i + 1000, 20)) for i in range(500)]
    labels = spark.createDataFrame([(i, i % 2 if i % 50 else None) for i in range(500)], "doc_id long, toxic int")

    def more(word, n):
        for _ in range(n):
            i = int(rng.integers(1, len(word)))
            word = word[:i] + "qxyz"[rng.integers(4)] + word[i:]
        return word

    kinds = {"plain": lambda w: w, "one": lambda w: more(w, 1), "two": lambda w: more(w, 2), "glued": lambda w: "hello" + w, "inside": lambda w: "said" + w + "again", "sign": lambda w: "you-" + w, "split": lambda w: w[:3] + " " + w[3:], "none": lambda w: "such"}
    extra = [(10_000 + 100 * k + i, prose(7000 + i, 30) + " " + f(bad[i % 4]) + " " + prose(8000 + i, 30)) for k, f in enumerate(kinds.values()) for i in range(40)]
    again = [(20_000, LONG + " murgface"), (20_000, LONG + " murgface"), (20_001, LONG)]
    got = toxicity.toxicity_scores(frame(spark, rows + extra + again), labels).collect()
    by = {r.id: r.predicted for r in got}
    share = {name: np.mean([by[10_000 + 100 * k + i] for i in range(40)]) for k, name in enumerate(kinds)}
    assert len(got) == len(rows + extra + again) and share["none"] == 0
    assert min(share[k] for k in ("plain", "one", "glued", "inside", "sign", "split")) >= 0.95 and share["two"] >= 0.8, share
    assert len({r.score for r in got if r.id == 20_000}) == 1 and by[20_001] == 0


def test_viterbi_is_the_best_path():
    from itertools import product

    rng = np.random.default_rng(4)
    lens = np.array([5, 0, 3, 1])
    score = rng.normal(size=(9, 3)) * 3
    got = language_id.viterbi(score, lens, 2.0)
    for s, n in zip(np.cumsum(lens) - lens, lens):
        if n:
            value = lambda p: sum(score[s + i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023
            assert tuple(got[s : s + n]) == max(product(range(3), repeat=int(n)), key=value)


def test_spans_of_mixed_text(spark):
    en, ru = "the cat sat on the mat and the dog ran to the big house", "это было давно и никто не помнит как там жили люди"
    shuffled = lambda t, i: " ".join(np.random.default_rng(i).permutation(t.split()))
    de = "der hund lief durch den wald und die katze blieb zu haus"
    rows = [(i, shuffled((en, ru, de)[i % 3], i), ("en", "ru", "de")[i % 3]) for i in range(90)]
    more = [(900, en + " " + de, None), (901, None, None), (902, "12 34 !!", None), (903, "", "en"), (None, ru, None), (904, "½ ² Ⅷ ⅷ", None), (905, "½der", None)]
    df = spark.createDataFrame(rows + more, "doc_id long, text string, lang string").withColumn("id", F.lit(1))
    got = {r.id: r for r in language_id.identify(df).collect()}
    assert all(got[i].lang_pred == l for i, _, l in rows) and got[None].lang_pred == "ru"
    assert [got[i].lang_pred for i in (901, 902, 903, 904, 905)] == ["und"] * 4 + ["de"] and got[901].score == 0
    s = got[900].spans
    assert [x.lang for x in s] == ["en", "de"] and abs(s[0].end - len(en.split())) <= 1


# URLs


def test_rules_and_parts(spark):
    urls = [
        (1, "https://A.Example.ORG/en/17?x=http://b.com/", "a.example.org", "/en/17", "example.org/en/1", "block"), (2, "http://myexample.org/es/", "myexample.org", "/es/", "org/", "allow"),
        (3, "ftp://x.com/fr/a#b", "x.com", "/fr/a", "com/fr/", "allow"), (4, "http://x.com/de/", "x.com", "/de/", "com/de/", "block"), (5, "http://example.org", "example.org", "", None, None),
        (6, None, "", "", None, None), (7, "no scheme", "", "", None, None), (8, "http://com/de/?q", "com", "/de/", "com/de/", "block"), (9, "http://x.net/de/", "x.net", "/de/", None, None),
    ]
    df = spark.createDataFrame([u[:2] for u in urls], "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "row", "said", "id")})
    got = {r.id: r for r in url_filter.judge_urls(df).collect()}
    for i, _, host, path, rule, verdict in urls:
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")


def test_url_model_matches_a_plain_one(spark):
    import math
    from collections import Counter

    rows = [(i, f"h{i % 5}.good", f"/en/{i}", True) for i in range(60)] + [(100 + i, f"q{i % 4}.bad", f"/x{i % 7}/{i * 3}", False) for i in range(60)]
    df = spark.createDataFrame(rows, "row long, host string, path string, accepted boolean")
    got = {r.row: r.score for r in url_filter.score(df, url_filter.fit(df)).collect()}
    n, pad = url_filter.ORDER, url_filter.START * url_filter.ORDER
    texts = {r: (pad + h + p + url_filter.END, a) for r, h, p, a in rows}

    def model(side):
        c = Counter(t[i - k : i + 1] for t, a in texts.values() if a == side for i in range(n, len(t)) for k in range(n + 1))
        total, kinds = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            kinds[g[:-1]] += 1

        def p(g):
            if not g:
                return 1 / url_filter.SYMBOLS
            h = g[:-1]
            return p(g[1:]) if not total[h] else (c[g] + kinds[h] * p(g[1:])) / (total[h] + kinds[h])

        return p

    good, bad = model(True), model(False)
    for r, (t, _) in texts.items():
        want = np.mean([math.log(good(t[i - n : i + 1])) - math.log(bad(t[i - n : i + 1])) for i in range(n, len(t))])
        assert got[r] == pytest.approx(want, abs=1e-9)


def test_url_models_count_all_ruled_urls(spark):
    """The models are those of every ruled row, however many, and of a class that has one URL many times."""
    from unittest import mock

    rules = (("allow", "good.org/"), ("block", "bad.org/"))
    rows = [(i, f"http://good.org/a{i}") for i in range(25_000)] + [(30_000 + i, "http://bad.org/zz") for i in range(300)] + [(40_000, "http://badd.org/zz"), (40_001, "http://goood.org/a77")]
    models = []
    fit = url_filter.fit
    with mock.patch.object(url_filter, "fit", lambda *x: models.append(fit(*x)) or models[-1]):
        got = {r.id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(rows, "id long, url string"), "id", rules=rules).where("id >= 40000").collect()}
    assert got == {40_000: "block", 40_001: "allow"}
    texts = spark.createDataFrame([(u[7:].partition("/")[0], "/" + u[7:].partition("/")[2], i < 30_000) for i, u in rows[:-2]], "host string, path string, accepted boolean")
    want, model = ({r.s: r[1:] for r in m.collect()} for m in (fit(texts), models[-1]))
    assert want.keys() == model.keys()
    for s, x in want.items():
        assert [v is None for v in x] == [v is None for v in model[s]] and [v for v in model[s] if v is not None] == pytest.approx([v for v in x if v is not None])


def test_sample_and_crc(spark):
    df = spark.range(50)
    assert [r.m for r in df.select(common.crc_mod("id", 5).alias("m")).collect()] == [zlib.crc32(str(i).encode()) % 5 for i in range(50)]
    a, b = (sorted(r.id for r in common.hashed_sample(df.repartition(k), "id", 7).collect()) for k in (2, 5))
    assert a == b and len(a) == 7
