"""Spelling variants, tokenizer alignment and decontamination against brute force, recall of edited image copies, letters."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from workgraph.llm import alignment, decontamination, images, langid, subword, variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# --- 11 spelling variants ---


def brute_variants(rows):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                count[run] += 1
    n = {w: k for w, k in count.items() if k >= 5}
    near = defaultdict(set)
    for a, b in itertools.combinations(n, 2):
        if abs(len(a) - len(b)) < 2:
            s, t = sorted((a, b), key=len)
            one = sum(x != y for x, y in zip(s, t, strict=True)) == 1 if len(s) == len(t) else any(s == t[:k] + t[k + 1 :] for k in range(len(t)))
            if one:
                near[a].add(b)
                near[b].add(a)
    form = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= 5 * n[w]}
    root = lambda w: root(form[w]) if w in form else w
    return {w: (w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(8)
    stems = ["".join(rng.choice("abcdefgéÿ×") for _ in range(rng.randint(5, 12))) for _ in range(60)]
    rows = []
    for i in range(400):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = stems[min(int(rng.expovariate(0.08)), len(stems) - 1)]
            for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
                k = rng.randrange(len(w))
                w = rng.choice((w[:k] + w[k + 1 :], w[:k] + rng.choice("abcxÿ") + w[k:], w[:k] + rng.choice("abcxÿ") + w[k + 1 :]))
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((i % 390, rng.choice((" ", "-1", "\n")).join(words)))
    # chains of forms, ties, letters beyond the table and one-letter words
    rows += [(1000, " ".join(["aaaaaab"] * 400 + ["aaaaabb"] * 80 + ["aaaabbb"] * 16 + ["aaabbbb"] * 5)), (1001, " ".join(["tiesxa"] * 25 + ["tiesxb"] * 25 + ["tiesx"] * 5 + ["tiesxcc"] * 5)), (1002, "straße ŒUVRE œuvres " * 9)]
    return rows + [(None, "nullid " * 7), (1003, None), (1004, ""), (1005, "a " * 5000), (1006, "b" * 3000 + " ")]


def test_spelling_variants(spark, spelled):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in spelled], "doc_id long, text string, n long, word string")
    want = brute_variants(spelled)
    got = variants.spelling_variants(d)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {r.word: tuple(r) for r in got.collect()} == want and any(w[1] for w in want.values())
    # filters of a few blocks let much through, and lose nothing
    assert {r.word: tuple(r) for r in variants.spelling_variants(d, most_bits=4096).collect()} == want
    assert variants.spelling_variants(d.limit(0)).count() == 0


def test_roots_of_long_chains(spark):
    steps = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(27)] + [("lone", "w27")], "word string, form string")
    assert {r.root for r in variants.roots(steps).collect()} == {"w27"}


def test_filters_never_lose_a_word():
    rng = np.random.default_rng(2)
    points = rng.integers(97, 123, (500, 7)).astype(np.uint64)
    assert (variants.hashes(np.delete(points, 3, 1)) == variants.deletions(points)[:, 3]).all()
    other = points.copy()
    other[:, 5] = ord("ÿ")
    assert (variants.hashes(other) == variants.replacements(points, np.array([97, 255]))[:, 5, 1]).all()


# --- 12 tokenizer alignment ---

ODD = ["a\n b  c▁d", "foo\n\n  bar \t\r\n};\r x  ", "  lead", " ", "\n", "x\x1cy \x1cz q　 w", "<s>hi</s> <|endoftext|> ok", "tab\t\tx \n\ty\n\n\nz", "日本 語😀 é́  \r\n", "a" * 3000, "don't we've 'll  's\n's 3.14", "};\r\n\r", "x \u0085y\xa0z", "\ttab first", "zero\0byte \0 x", "plain words, and more words.\nNext line here", "plain words, and more words.\nNext line here"]


def brute_alignment(rows):
    import sentencepiece
    import tokenizers

    a_, b_ = tokenizers.Tokenizer.from_file(alignment.A), sentencepiece.SentencePieceProcessor(model_file=alignment.B)
    a_.encode_special_tokens = True
    table = alignment.tokenizer_pair(alignment.A, alignment.B)
    found, count = [], Counter()
    for i, t in rows:
        ids = [a_.encode(" " + t, add_special_tokens=False).ids, b_.encode(t)] if t else [[], []]
        texts = [[held[k] for k in x] for held, x in zip((table.a_bytes, table.b_bytes), ids, strict=True)]
        if not t or any(b"".join(x) != (" " + t).encode() for x in texts):
            found.append((i, None))
            continue
        ends = [list(itertools.accumulate(map(len, x))) for x in texts]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, at = [], [0, 0]
        for e in common:
            to = [x.index(e) + 1 for x in ends]
            groups.append([ids[k][at[k] : to[k]] for k in (0, 1)])
            at = to
        links = [(g[0][-1], g[1][-1]) for g in groups]
        count.update(links)
        found.append((i, (len(ids[0]), len(ids[1]), len(groups), links, ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups))))
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    none = (0, 0, 0, 0, 0, 0, "")
    out = [(i, *none) if x is None else (i, *x[:3], len(x[3]), sum(count[k] == top[k[1]] for k in x[3]), sum(count[k] for k in x[3]), hashlib.sha256(x[4].encode()).hexdigest()) for i, x in found]
    return out, count


def test_alignment(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghiou") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    rows = [(i, "".join(rng.choice(vocabulary) + rng.choice((" ", " ", " ", "\n", ", ", ".\n", "  ")) for _ in range(rng.randint(0, 80)))) for i in range(60)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (2000, None), (2001, ""), (2000, "again")]
    d = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, _row string, _links long").repartition(3)
    want, count = brute_alignment(rows)
    order = lambda r: tuple(map(str, r))
    for how in ({}, {"most_pairs": 0, "bucket": 16}, {"bucket": 50, "groups": "groups"}):
        out = alignment.aligned(d, **how)
        assert out.columns[:4] == d.columns
        assert sorted([tuple(r[c] for c in ("doc_id", *alignment.NEW)) for r in out.collect()], key=order) == sorted(want, key=order)
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in out.filter("groups <> ''").collect())
    table, buckets, total = alignment.count_pairs(d, bucket=50)
    assert total == len(count) and buckets == -(-total // 50)
    assert {(r.a, r.b): r.n for r in alignment.pair_counts(table).collect()} == dict(count)
    assert alignment.aligned(d.limit(0)).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**62, 5000))
    sizes, bits = alignment.perfect_hash(keys)
    slots = alignment._slots_of(keys, sizes, bits)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    by_slot = np.empty(len(keys), np.int64)
    by_slot[slots] = keys
    table = alignment.PairTable(1, [(0, sizes, np.packbits(bits).tobytes(), by_slot, by_slot % 97)], np.zeros(1))
    assert (table.keys[table.slots(keys)] == keys).all() and (table.slots(keys + 1)[~np.isin(keys + 1, keys)] == -1).all()


# --- 13 decontamination ---


def brute_decontamination(rows, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(len(w), size)
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    out = []
    for i, t in rows:
        w, hit, held = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    held |= found
        ids = sorted(str(x) for x in held if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination(spark):
    rng = random.Random(13)
    vocabulary = [rng.choice("abcdefgh") * rng.randint(1, 3) + rng.choice(("", "é", "9")) for _ in range(40)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    items = [(i, text(rng.randint(8, 40))) for i in range(30)]
    common = text(14)
    items += [(30 + i, text(5) + " " + common + " " + text(5)) for i in range(5)] + [(40, "only three words"), (41, "solo"), (42, None), (43, " -- "), (None, text(12)), (0, text(15)), (100, "same same same same same same same same same same same same")]
    rows = []
    for i in range(80):
        t = text(rng.randint(0, 120)).split()
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").upper().split()
            k = rng.randrange(max(1, len(w) - 9))
            t[k:k] = w[k : k + rng.randint(7, 14)]
        rows.append((i, rng.choice((" ", ", ", "\n")).join(t)))
    rows += [(200, None), (201, ""), (202, "!!"), (203, "same " * 300), (204, rows[3][1]), (3, rows[3][1]), (None, items[2][1]), (205, " ".join(x or "" for _, x in items) * 5), (206, "A solo; only THREE words"), (207, f"Ä {common}")]
    d = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, n_hit long, _h1 string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(d, b)
    order = lambda r: tuple(map(str, r))
    seen = got.collect()
    assert sorted([tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in seen], key=order) == sorted(brute_decontamination(rows, items), key=order)
    assert got.columns[:3] == ["doc_id", "text", "_h1"]
    assert all(sum(s["last"] - s["first"] + 1 for s in r.hit_spans) == r.n_hit for r in seen)
    assert decontamination.decontaminate(d.limit(0), b).count() == 0
    assert {r.n_hit for r in decontamination.decontaminate(d, b.limit(0)).collect()} == {0}


def test_fingerprints_of_shared_windows(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    words = [rng.choice("abc") for _ in range(60)]
    rows = [(words,), (["x"] * 7 + words[20:30] + ["y"] * 4,)]
    for size in (1, 2, 3, 10):
        a, b = ({r["print"]: (r.at, r.to) for r in x.p} for x in spark.createDataFrame(rows, "w array<string>").select(decontamination.fingerprints(F.col("w"), size).alias("p")).collect())
        assert set(a) & set(b) and max(to for _, to in a.values()) <= len(words) - size


# --- 9 edited copies ---


def _resized(img, scale):
    return np.clip(images._resized(img.astype(float), scale), 0, 255).astype(np.uint8)


def _turned(img, degrees):
    a = np.deg2rad(degrees)
    y, x = np.mgrid[14:82, 14:82] - 47.5
    yy, xx = 47.5 + y * np.cos(a) - x * np.sin(a), 47.5 + y * np.sin(a) + x * np.cos(a)
    y0, x0 = np.floor(yy).astype(int), np.floor(xx).astype(int)
    fy, fx, f = yy - y0, xx - x0, img.astype(float)
    return np.clip((f[y0, x0] * (1 - fx) + f[y0, x0 + 1] * fx) * (1 - fy) + (f[y0 + 1, x0] * (1 - fx) + f[y0 + 1, x0 + 1] * fx) * fy, 0, 255).astype(np.uint8)


def test_image_copies_by_edit(spark):
    """Copies that the tables find, of those that all corner pairs show; README gives the shares."""
    rng, n = np.random.default_rng(11), 24
    drawn = [images.draw(rng.normal(size=64)) for _ in range(n)]
    edits = {"crop": lambda m: m[10:90, 6:86], "noise": lambda m: np.clip(m.astype(float) + np.random.default_rng(1).normal(0, 6, m.shape), 0, 255).astype(np.uint8), "0.9": lambda m: _resized(m, 0.9), "0.8": lambda m: _resized(m, 0.8), "0.7": lambda m: _resized(m, 0.7), "5": lambda m: _turned(m, 5)}
    rows = [(k * 20, m) for k, m in enumerate(drawn)] + [(k * 20 + 1 + j, f(m)) for k, m in enumerate(drawn) for j, f in enumerate(edits.values())]
    media = spark.createDataFrame([(i, np.ascontiguousarray(m).tobytes(), m.shape[1]) for i, m in rows], "image_id long, pixels binary, width int")
    found = {(r.image_id, r.class_id) for r in images.find_copies(media).filter("kind = 'match'").collect()}
    corners = {i: images.packed(m) for i, m in rows}
    share = {}
    for j, name in enumerate(edits):
        want = {(k * 20, k * 20 + 1 + j) for k in range(n) if images.consensus(a := corners[k * 20], b := corners[k * 20 + 1 + j], images.near_corners(a, b, 22), 22) >= 5}
        share[name] = (len(want & found), len(want))
    print(share)
    assert share["crop"] == share["noise"] == (n, n)
    assert all(got >= 0.5 * want for got, want in share.values())
    assert sum(got for got, _ in share.values()) >= 0.85 * sum(want for _, want in share.values())


# --- 10 letters ---


def test_no_letters_no_language(spark):
    langs, logp = langid.train(spark.createDataFrame([("en", "the words of the text"), ("fr", "les mots du texte")], "lang string, text string"))
    d = spark.createDataFrame([(1, "½ ² 12"), (2, "²x"), (3, None), (4, "日")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred == "und" for r in langid.identify(d, langs, logp).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_remembered_merges_are_bounded_and_change_nothing(spark):
    words = [f"{a}{b}ation" for a in ("inter", "trans", "multi", "under") for b in ("nation", "form", "plic", "stand", "port")]
    docs = spark.createDataFrame([(i, " ".join(words[(i * k) % 20] for k in range(40))) for i in range(60)], "doc_id long, text string").coalesce(1)
    few, many = (sorted(map(str, subword.encode(docs, nodes=n).select("doc_id", "ids").collect())) for n in (50, subword.MOST_NODES))
    assert few == many
    v = subword.Vocabulary(subword.MODEL)
    v.paths.most = 50
    sizes = []
    for i in range(60):
        v.encode(" ".join(words), i, 0.1, 41)
        sizes.append(len(v.paths.step))
    assert max(sizes) <= 50 + 20 * 32
